"""Task parameters: a JSON document whose fields are scalars or arrays of which the first element counts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first(value: Any) -> str | None:
    value = (value[0] if value else None) if isinstance(value, list) else value
    return None if value is None or str(value) == "" else str(value)


def listed(value: Any) -> list[str] | None:
    text = first(value)
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def whole(value: Any) -> int | None:
    text = first(value)
    return int(text) if text else None


@dataclass(frozen=True)
class TaskParams:
    """None means that a filter isn't set."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: list[str] | None = None
    cities: list[str] | None = None
    sex: str | None = None
    keywords: list[str] | None = None
    category_ids: list[str] | None = None
    page_flow: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> TaskParams:
        raw = json.loads(text)
        return cls(
            first(raw.get("startDate")), first(raw.get("endDate")), whole(raw.get("startAge")), whole(raw.get("endAge")),
            listed(raw.get("professionals")), listed(raw.get("cities")), first(raw.get("sex")),
            listed(raw.get("keywords")), listed(raw.get("categoryIds")), [int(x) for x in listed(raw.get("targetPageFlow")) or []],
        )


def task(tasks: DataFrame, task_id: int) -> TaskParams:
    """The parameters of one task of the task table; an unknown task is an error."""
    rows = tasks.filter(F.col("task_id") == task_id).select("task_param").take(1)
    if not rows:
        raise LookupError(f"there is no task {task_id}")
    return TaskParams.parse(rows[0]["task_param"])
