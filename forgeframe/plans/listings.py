"""Listings, searches, lookups and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgeframe.operators import aggregates, issues, joins, paging
from forgeframe.operators import hooks as H
from forgeframe.operators import predicates as P
from forgeframe.plans.site import RAW, query
from forgeframe.sources import archive

ISSUE = ("id", "repo_id", "poster_id", "is_closed", "num_comments")


def issue_list_page(s):
    rows = issues.listing(s.issue, repo_ids=list(range(1, 60)), closed=True, assignee=3, poster=9)
    return issues.page(rows, "mostcomment", 2, 10).select(*ISSUE)


def issue_list_by_labels(s):
    rows = issues.listing(s.issue, repo_ids=[1, 2, 3, 4, 5, 6], labels=[2, 5, 7], issue_label=s.issue_label)
    return rows.select("id", "repo_id")


def issue_list_by_labels_once(s):
    rows = issues.listing(s.issue, labels=[2, 5], issue_label=s.issue_label, pulls=True, distinct=True)
    return rows.select("id", "repo_id")


def issue_mentions(s):
    return issues.listing(s.issue, mention=s.issue_user, uid=5).select("id", "repo_id")


def issue_stats(s):
    return aggregates.open_closed(s.issue)


def mention_stats(s):
    return aggregates.open_closed(joins.mentioned(s.issue, s.issue_user, 3))


def issue_dashboard(s):
    return aggregates.dashboard(s.issue, 5, [1, 2, 3, 4], False, "created")


def repo_issue_counts(s):
    return aggregates.open_closed(s.issue, "repo_id", "is_pull")


def user_search(s):
    return s.users.filter(P.name_like("MER#00000001", "lower_name", "full_name")).orderBy(F.desc("id")).limit(15).select("id", "name")


def repo_search(s):
    rows = joins.visible_repos(s.repository, s.access, 3).filter(P.every(P.repo_like("a")))
    return paging.offset_page(rows, [F.asc("lower_name"), F.asc("id")], 2, 20).select("id", "name", "owner_id")


def repo_search_count(s):
    rows = joins.visible_repos(s.repository, s.access, 3).filter(P.every(P.repo_like("a")))
    return rows.agg(F.count_distinct("id").alias("n"))


def public_repos(s):
    return s.repository.filter(P.public()).select("id", "owner_id")


def open_parts(s):
    return joins.visible_repos(s.repository, s.access, 0).select("id")


def prefix_lookup(s):
    return s.public_key.filter(F.col("content").startswith("Supplier#00000001")).select("id", "content")


def template_match(s):
    return P.match(s.issue, repo_id=5, milestone_id=0, is_closed=False, name="").select("id", "repo_id")


def point_lookup(s):
    return P.lookup(s.repository, owner_id=8, lower_name="").select("id").unionByName(P.lookup(s.users, id=12).select("id"))


def login_lookup(s):
    return s.users.filter(P.login("Customer#000000011@example.com") | P.login("CUSTOMER#000000012")).select("id", "name")


def member_lists(s):
    some, none = s.issue.filter(P.members("repo_id", [2, 4])), s.issue.filter(P.members("repo_id", []))
    return some.select("id").unionByName(none.select("id"))


def name_rules(s):
    ok = P.name_allowed(F.col("name"), ["customer#000000003"], ["*7", "customer#00000001*"])
    return s.users.filter(ok).select("id")


def masked_users(s):
    return s.users.select("id", P.masked("email", False).alias("email"))


def existing(s):
    return P.having(s.users.select("id", "name"), s.star.select(F.col("uid").alias("id")), "id")


def at_least(s):
    return s.access.filter((F.col("mode") >= 2) & (F.col("user_id") != 4)).select("user_id", "repo_id", "mode")


def offset_pages(s):
    return paging.offset_page(s.users.select("id", "name"), [F.asc("id")], 3, paging.page_size(80))


def table_counts(s):
    return archive.counts({t: getattr(s, t) for t in RAW})


def sequence_reset(s):
    return archive.next_id(s.issue)


def user_count(s):
    return aggregates.count(s.users, F.col("type") == 0)


def derived_columns(s):
    from forgeframe.operators.mutations import completeness

    return s.milestone.select("id", (F.col("num_issues") - F.col("num_closed_issues")).cast("bigint").alias("num_open_issues"), completeness().alias("completeness"))


def row_hooks(s):
    """Milestones and keys as they are read, and users as they are created."""
    now = 1_700_050_000
    stones = H.read(s.milestone.withColumn("deadline_unix", F.when(F.col("id") % 3 == 0, 253_370_764_800).otherwise(now - 86_400 * 5 + F.col("id") * 86_400)), "milestone", now)
    keys = H.read(s.public_key.select("id", (F.lit(now) - F.col("id") * 90_000).alias("created_unix"), (F.lit(now) - F.col("id") % 20 * 45_000).alias("updated_unix")), "public_key", now)
    new = H.created(s.users.select("id", F.when(F.col("id") % 2 == 0, F.col("created_unix")).alias("created_unix"), F.lit(0).cast("bigint").alias("updated_unix")), now)
    one = stones.select(F.lit("milestone").alias("kind"), "id", F.concat_ws("|", "num_open_issues", "completeness", "deadline_string", "is_overdue").alias("x"))
    two = keys.select(F.lit("key").alias("kind"), "id", F.concat_ws("|", "has_used", "has_recent_activity", F.date_format("updated", "yyyy-MM-dd HH:mm:ss")).alias("x"))
    return one.unionByName(two).unionByName(new.select(F.lit("user").alias("kind"), "id", F.concat_ws("|", "created_unix", "updated_unix").alias("x")))


def api_users(s):
    return s.users.select("id", F.col("name").alias("username"), F.col("full_name"), F.concat(F.lit("/avatars/"), F.col("id").cast("string")).alias("avatar_url"), F.col("email"))


def valid_blobs(s):
    return s.lfs_object.groupBy(archive.valid_oid("oid").alias("sound")).agg(F.count("*").alias("n"))


VISIBLE = """(r.owner_id = 3 OR r.id IN (SELECT repo_id FROM access WHERE user_id = 3) OR (NOT r.is_private AND NOT r.is_unlisted)
    OR (r.is_private AND (r.allow_public_wiki OR r.allow_public_issues))) AND (r.lower_name LIKE '%a%' OR r.description LIKE '%a%')"""
QUERIES = {
    "issue_list_page": query(issue_list_page, "SELECT id, repo_id, poster_id, is_closed, num_comments FROM issue WHERE repo_id BETWEEN 1 AND 59 AND is_closed AND assignee_id = 3 AND NOT is_pull ORDER BY num_comments DESC, id DESC LIMIT 10 OFFSET 10"),
    "issue_list_by_labels": query(issue_list_by_labels, "SELECT i.id, i.repo_id FROM issue i JOIN issue_label l ON l.issue_id = i.id WHERE l.label_id IN (2, 5, 7) AND i.repo_id BETWEEN 1 AND 6 AND NOT i.is_closed AND NOT i.is_pull"),
    "issue_list_by_labels_once": query(issue_list_by_labels_once, "SELECT id, repo_id FROM issue WHERE NOT is_closed AND is_pull AND id IN (SELECT issue_id FROM issue_label WHERE label_id IN (2, 5))"),
    "issue_mentions": query(issue_mentions, "SELECT i.id, i.repo_id FROM issue i JOIN issue_user u ON u.issue_id = i.id WHERE u.is_mentioned AND u.uid = 5 AND NOT i.is_closed AND NOT i.is_pull"),
    "issue_stats": query(issue_stats, "SELECT COUNT(*) FILTER (WHERE NOT is_closed) AS n_open, COUNT(*) FILTER (WHERE is_closed) AS n_closed FROM issue"),
    "mention_stats": query(mention_stats, "SELECT COUNT(*) FILTER (WHERE NOT i.is_closed) AS n_open, COUNT(*) FILTER (WHERE i.is_closed) AS n_closed FROM issue i JOIN issue_user u ON u.issue_id = i.id WHERE u.is_mentioned AND u.uid = 3"),
    "issue_dashboard": query(
        issue_dashboard,
        """SELECT COUNT(*) FILTER (WHERE assignee_id = 5 AND NOT is_closed) AS assign_count, COUNT(*) FILTER (WHERE poster_id = 5 AND NOT is_closed) AS create_count,
           COUNT(*) FILTER (WHERE repo_id IN (1, 2, 3, 4) AND NOT is_closed) AS your_count, COUNT(*) FILTER (WHERE poster_id = 5 AND NOT is_closed) AS open_count,
           COUNT(*) FILTER (WHERE poster_id = 5 AND is_closed) AS closed_count FROM issue WHERE NOT is_pull""",
    ),
    "repo_issue_counts": query(repo_issue_counts, "SELECT repo_id, is_pull, COUNT(*) FILTER (WHERE NOT is_closed) AS n_open, COUNT(*) FILTER (WHERE is_closed) AS n_closed FROM issue GROUP BY repo_id, is_pull"),
    "user_search": query(user_search, "SELECT id, name FROM users WHERE lower_name LIKE '%mer#00000001%' OR lower(full_name) LIKE '%mer#00000001%' ORDER BY id DESC LIMIT 15"),
    "repo_search": query(repo_search, f"SELECT r.id, r.name, r.owner_id FROM repository r WHERE {VISIBLE} ORDER BY r.lower_name, r.id LIMIT 20 OFFSET 20"),
    "repo_search_count": query(repo_search_count, f"SELECT COUNT(DISTINCT r.id) AS n FROM repository r LEFT JOIN access a ON a.repo_id = r.id WHERE {VISIBLE}"),
    "public_repos": query(public_repos, "SELECT id, owner_id FROM repository WHERE NOT is_private AND NOT is_unlisted"),
    "open_parts": query(open_parts, "SELECT id FROM repository WHERE (NOT is_private AND NOT is_unlisted) OR (is_private AND (allow_public_wiki OR allow_public_issues))"),
    "prefix_lookup": query(prefix_lookup, "SELECT id, content FROM public_key WHERE content LIKE 'Supplier#00000001%'"),
    "template_match": query(template_match, "SELECT id, repo_id FROM issue WHERE repo_id = 5"),
    "point_lookup": query(point_lookup, "SELECT id FROM users WHERE id = 12"),
    "login_lookup": query(login_lookup, "SELECT id, name FROM users WHERE email = 'customer#000000011@example.com' OR lower_name = 'customer#000000012'"),
    "member_lists": query(member_lists, "SELECT id FROM issue WHERE repo_id IN (2, 4)"),
    "name_rules": query(name_rules, "SELECT id FROM users WHERE lower_name <> 'customer#000000003' AND lower_name NOT LIKE '%7' AND lower_name NOT LIKE 'customer#00000001%'"),
    "masked_users": query(masked_users, "SELECT id, '' AS email FROM users"),
    "existing": query(existing, "SELECT id, name FROM users WHERE EXISTS (SELECT 1 FROM star WHERE star.uid = users.id)"),
    "at_least": query(at_least, "SELECT user_id, repo_id, mode FROM access WHERE mode >= 2 AND user_id <> 4"),
    "offset_pages": query(offset_pages, "SELECT id, name FROM users ORDER BY id LIMIT 50 OFFSET 100"),
    "table_counts": query(table_counts, " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n FROM {t}" for t in RAW)),
    "sequence_reset": query(sequence_reset, "SELECT COALESCE(MAX(id) + 1, 1) AS next_id FROM issue"),
    "user_count": query(user_count, "SELECT COUNT(*) AS n FROM users WHERE type = 0"),
    "derived_columns": query(derived_columns, "SELECT id, CAST(num_issues - num_closed_issues AS BIGINT) AS num_open_issues, CAST(num_closed_issues * 100 // num_issues AS BIGINT) AS completeness FROM milestone"),
    "row_hooks": query(
        row_hooks,
        """SELECT 'milestone' AS kind, id, concat_ws('|', num_issues - num_closed_issues, num_closed_issues * 100 // num_issues, CASE WHEN id % 3 = 0 THEN '' ELSE strftime(make_timestamp((1699618000 + id * 86400) * 1000000), '%Y-%m-%d') END, id % 3 <> 0 AND id < 5) AS x FROM milestone
           UNION ALL SELECT 'key', id, concat_ws('|', id % 20 * 45000 < id * 90000, id % 20 * 45000 < 604800, strftime(make_timestamp((1700050000 - id % 20 * 45000) * 1000000), '%Y-%m-%d %H:%M:%S')) FROM public_key
           UNION ALL SELECT 'user', id, CASE WHEN id % 2 = 0 THEN created_unix || '|' || created_unix ELSE '1700050000|1700050000' END FROM users""",
    ),
    "api_users": query(api_users, "SELECT id, name AS username, full_name, '/avatars/' || CAST(id AS VARCHAR) AS avatar_url, email FROM users"),
    "valid_blobs": query(valid_blobs, "SELECT true AS sound, COUNT(*) AS n FROM lfs_object"),
}
