"""Filters and projections (F1-F22, S7, S8): functions that return Columns or narrowed DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given (None: not set)."""
    found = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, found) if found else F.lit(True)


def match(df: DataFrame, **values) -> DataFrame:
    """Rows equal to a template; zero, empty and false values of the template are not compared."""
    return df.filter(every(*[F.col(k) == v for k, v in values.items() if v not in (0, "", False, None)]))


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a unique key: one at most."""
    return df.filter(every(*[F.col(k) == v for k, v in key.items()])).limit(1)


def before(key: str, after: int) -> Column | None:
    """Keyset predicate; no cursor, no predicate."""
    return F.col(key) < after if after > 0 else None


def in_profile(receiver: int, actor: int, is_profile: bool) -> Column | None:
    """On another user's profile only their public actions; everything else sees all."""
    return ~F.col("is_private") & (F.col("act_user_id") == receiver) if is_profile and actor != receiver else None


def public() -> Column:
    return ~F.col("is_private") & ~F.col("is_unlisted")


def open_parts() -> Column:
    """Private repositories with a public wiki or public issues."""
    return F.col("is_private") & (F.col("allow_public_wiki") | F.col("allow_public_issues"))


def members(column: str, ids: list | None) -> Column | None:
    """None: no filter. An empty list: no rows."""
    if ids is None:
        return None
    return F.col(column).isin(ids) if ids else F.lit(False)


def name_like(keyword: str, *columns: str) -> Column:
    """Case-folded substring in any column; a blank keyword finds nothing; ``%`` and ``_`` stay wildcards."""
    if not keyword.strip():
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).like(f"%{keyword.lower()}%") for c in columns])


def repo_like(keyword: str) -> Column | None:
    """Lower name or raw description contains the lower-cased keyword."""
    k = f"%{keyword.lower()}%"
    return F.col("lower_name").like(k) | F.col("description").like(k) if keyword else None


def assigned_or_posted(assignee: int = 0, poster: int = 0) -> Column | None:
    """The assignee wins; the poster counts only without one."""
    if assignee > 0:
        return F.col("assignee_id") == assignee
    return F.col("poster_id") == poster if poster > 0 else None


def login(name: str) -> Column:
    """By e-mail if there is an ``@``, else by lower-cased name."""
    return F.col("email") == name.lower() if "@" in name else F.col("lower_name") == name.lower()


#: Events that a webhook can choose.
EVENTS = ["create", "delete", "fork", "push", "issues", "pull_request", "issue_comment", "release"]
EVENTS_DDL = "push_only boolean, send_everything boolean, choose_events boolean, events struct<" + ",".join(f"{e}:boolean" for e in EVENTS) + ">"


def subscribed(settings: Column, event: str) -> Column:
    """Whether parsed hook settings want an event; only pushes honour ``push_only``."""
    wants = settings["send_everything"] | (settings["choose_events"] & settings["events"][event])
    wants = wants | settings["push_only"] if event == "push" else wants
    return F.coalesce(wants, F.lit(False))


def subscriptions(settings: Column) -> Column:
    """All events that the settings want, in fixed order."""
    return F.filter(F.array(*[F.when(subscribed(settings, e), F.lit(e)) for e in EVENTS]), lambda x: x.isNotNull())


def name_allowed(name: Column, reserved: list[str], patterns: list[str]) -> Column:
    """Not empty, not reserved, and no pattern ``*end`` or ``start*`` fits; names are trimmed and lower-cased."""
    n = F.lower(F.trim(name))
    bad = (n == "") | n.isin(reserved) if reserved else n == ""
    for p in patterns:
        if p.startswith("*"):
            bad = bad | n.endswith(p[1:])
        if p.endswith("*"):
            bad = bad | n.startswith(p[:-1])
    return ~bad


def masked(column: str, signed_in: bool) -> Column:
    """Anonymous callers get an empty text."""
    return F.col(column) if signed_in else F.lit("").alias(column)


def having(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows that exist in ``other`` by key."""
    return df.join(other.select(*keys), list(keys), "left_semi")
