"""Issue listings (F2, F13, T2, T3) and paging by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeframe.operators import joins, paging
from forgeframe.operators import predicates as P

#: Sort options; every one ends with the id, so pages don't overlap.
SORTS = {
    "newest": F.desc, "oldest": F.asc, "recentupdate": F.desc, "leastupdate": F.asc, "mostcomment": F.desc, "leastcomment": F.asc, "priority": F.desc,
}
SORT_COLUMNS = {"newest": "created_unix", "oldest": "created_unix", "recentupdate": "updated_unix", "leastupdate": "updated_unix", "mostcomment": "num_comments", "leastcomment": "num_comments", "priority": "priority"}


def listing(issue: DataFrame, repo_id: int = 0, repo_ids: list[int] | None = None, closed: bool = False, assignee: int = 0, poster: int = 0, milestone: int = 0, pulls: bool = False, labels: list[int] | None = None, issue_label: DataFrame | None = None, mention: DataFrame | None = None, uid: int = 0, distinct: bool = False) -> DataFrame:
    """Issues by optional filters; labels keep an issue once for each that it has unless ``distinct``."""
    where = P.every(
        F.col("repo_id") == repo_id if repo_id > 0 else P.members("repo_id", repo_ids),
        F.col("is_closed") == closed,
        P.assigned_or_posted(assignee, poster),
        F.col("milestone_id") == milestone if milestone > 0 else None,
        F.col("is_pull") == pulls,
    )
    rows = issue.filter(where)
    if labels:
        rows = joins.with_labels(rows, issue_label, labels, distinct)
    return joins.mentioned(rows, mention, uid) if mention is not None else rows


def page(rows: DataFrame, sort: str = "newest", number: int = 1, size: int = 10) -> DataFrame:
    sort = sort if sort in SORTS else "newest"
    direction = SORTS[sort]
    return paging.offset_page(rows, [direction(SORT_COLUMNS[sort]), direction("id")], max(1, number), size)


def tags_after(tags: DataFrame, position: str, name: str, after: str, limit: int) -> DataFrame:
    """One row: tags (array, in order), has_latest, previous_after, has_next of the page after a tag.

    tags: one repository's, with a unique order column; an unknown cursor starts at the top.
    """
    rows = tags.select(F.col(position).alias("p"), F.col(name).alias("name"))
    at = rows.filter(F.col("name") == after).agg(F.max("p")).scalar()
    below = rows.filter(at.isNull() | (F.col("p") > at))
    pair = F.struct("p", "name")
    # top-k pages; one tag more tells whether there is a next page
    page = below.orderBy("p").limit(limit + 1) if limit > 0 else below
    page = page.agg(F.array_sort(F.collect_list(pair)).alias("page"))
    back = rows.filter(F.col("p") <= at).orderBy(F.desc("p")).limit(limit + 1) if after and limit > 0 else rows.limit(0)
    back = back.agg(F.array_sort(F.collect_list(pair))).scalar()
    out = page.withColumn("back", back)
    shown = F.slice("page", 1, limit) if limit > 0 else F.col("page")
    previous = F.when(F.size("back") > limit, F.try_element_at("back", F.lit(1))["name"]).otherwise("")
    unknown = rows.filter(F.col("name") == after).agg(F.count("*")).scalar() == 0
    next_ = F.size("page") > limit if limit > 0 else F.lit(False)
    return out.select(F.transform(shown, lambda x: x["name"]).alias("tags"), unknown.alias("has_latest"), F.coalesce(previous, F.lit("")).alias("previous_after"), next_.alias("has_next"))
