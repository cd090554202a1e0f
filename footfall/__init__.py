"""User-behaviour analytics on PySpark."""
