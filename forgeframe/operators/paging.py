"""Sorting, keyset and offset paging, page-size rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, key: str, after: int = 0, size: int = 20) -> DataFrame:
    """Newest ``size`` rows with ``key`` below ``after`` (0: from the top). Plans to a top-k, not a sort."""
    rows = df.filter(F.col(key) < after) if after > 0 else df
    return rows.orderBy(F.col(key).desc()).limit(size)


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1; 0 or less: everything) of ``df`` in ``order``, which must end in a unique key."""
    rows = df.orderBy(*order)
    return rows if page <= 0 else rows.offset((page - 1) * size).limit(size)


def page_size(wanted: int, default: int = 10, maximum: int = 50) -> int:
    """Sizes of 0 or less become the default, larger ones the maximum."""
    return default if wanted <= 0 else min(wanted, maximum)


def sort_by(options: dict[str, Column], name: str, default: str, tie: Column) -> list[Column]:
    """The named order with a unique tie-breaker; unknown names get the default."""
    return [options.get(name, options[default]), tie]


def page_links(total: int, size: int, page: int) -> dict[str, int]:
    """Page numbers of the next, last, first and previous links that exist."""
    last = -(-total // size) if size > 0 else 0
    links = {"next": page + 1, "last": last} if page < last else {}
    return links | ({"first": 1, "prev": page - 1} if page > 1 else {})
