"""What a row gets when it is read or created (§2.10): derived columns and defaults, from tables of rules.

``read`` adds what the site shows beside the stored columns; it is lazy, so a plan that doesn't use a derived
column doesn't compute it. ``created`` fills what a new row may leave out. ``now`` is a parameter, in Unix seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK = 7 * 86_400
#: A deadline in this year stands for none.
NO_DEADLINE = 9999
C = F.col


def left(total: str, done: str) -> Callable[[int], Column]:
    return lambda now: C(total) - C(done)


def otherwise(column: str, value: str) -> Callable[[int], Column]:
    return lambda now: F.when(F.coalesce(C(column), F.lit("")) == "", value).otherwise(C(column))


def has_deadline() -> Column:
    return F.year(F.timestamp_seconds("deadline_unix")) != NO_DEADLINE


def used() -> dict:
    return {"has_used": lambda now: C("updated_unix") > C("created_unix"), "has_recent_activity": lambda now: C("updated_unix") + WEEK > now}


#: By table: columns and what they are made of; those whose stored columns a table lacks are left out.
READ: dict[str, dict[str, tuple[tuple[str, ...], Callable[[int], Column]]]] = {
    "repository": {
        "num_open_issues": (("num_issues", "num_closed_issues"), left("num_issues", "num_closed_issues")),
        "num_open_pulls": (("num_pulls", "num_closed_pulls"), left("num_pulls", "num_closed_pulls")),
        "num_open_milestones": (("num_milestones", "num_closed_milestones"), left("num_milestones", "num_closed_milestones")),
        "default_branch": (("default_branch",), otherwise("default_branch", "master")),
        "external_tracker_style": (("external_tracker_style",), otherwise("external_tracker_style", "numeric")),
    },
    "label": {"num_open_issues": (("num_issues", "num_closed_issues"), left("num_issues", "num_closed_issues"))},
    "milestone": {
        "num_open_issues": (("num_issues", "num_closed_issues"), left("num_issues", "num_closed_issues")),
        "completeness": (("num_issues", "num_closed_issues"), lambda now: F.when(C("num_issues") > 0, F.expr("num_closed_issues * 100 div num_issues")).otherwise(0).cast("int")),
        "deadline_string": (("deadline_unix",), lambda now: F.when(has_deadline(), F.date_format(F.timestamp_seconds("deadline_unix"), "yyyy-MM-dd")).otherwise("")),
        "is_overdue": (("deadline_unix",), lambda now: has_deadline() & (C("deadline_unix") < now)),
    },
    **{t: {k: (("created_unix", "updated_unix"), f) for k, f in used().items()} for t in ("public_key", "deploy_key", "access_token")},
}


def read(rows: DataFrame, table: str, now: int) -> DataFrame:
    """Rows with every ``x_unix`` as a timestamp ``x``, and with what ``READ`` has for the table."""
    has = set(rows.columns)
    times = {c.removesuffix("_unix"): F.timestamp_seconds(c) for c in rows.columns if c.endswith("_unix") and c.removesuffix("_unix") not in has}
    made = {name: f(now) for name, (needs, f) in READ.get(table, {}).items() if has.issuperset(needs)}
    return rows.withColumns(times | made)


def created(rows: DataFrame, now: int) -> DataFrame:
    """New rows: where ``created_unix`` is missing or not positive it is ``now``; ``updated_unix`` is then the same."""
    if "created_unix" not in rows.columns:
        return rows
    rows = rows.withColumn("created_unix", F.when(C("created_unix") > 0, C("created_unix")).otherwise(F.lit(now)).cast("bigint"))
    if "updated_unix" in rows.columns:
        rows = rows.withColumn("updated_unix", F.when(C("updated_unix") > 0, C("updated_unix")).otherwise(C("created_unix")).cast("bigint"))
    return rows
