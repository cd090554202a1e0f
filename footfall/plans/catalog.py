"""Queries by name, and their SQL."""

from footfall.plans import advertising, jobs, logs, products, scalars, sessions, streams, summaries, times

FAMILIES = (sessions, products, advertising, logs, scalars, streams, times, summaries, jobs)
QUERIES = {k: q for family in FAMILIES for k, q in family.QUERIES.items()}
SQL = {k: s for family in FAMILIES for k, s in family.SQL.items()}
