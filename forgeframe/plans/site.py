"""The driver's tables seen as the site's tables, by one SQL text each for Spark and DuckDB.

The queries run the site's operators on these views; the oracle runs its own SQL on the same
views as common table expressions.
"""

from __future__ import annotations

import re

from forgeframe.session import load

VIEWS: dict[str, str] = {
    "users": """SELECT c_custkey AS id, c_name AS name, lower(c_name) AS lower_name, c_mktsegment AS full_name,
        lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS type,
        c_acctbal >= 0 AS is_active, c_custkey % 9 AS num_repos, c_custkey % 4 AS num_followers, c_custkey % 3 AS num_following,
        c_custkey % 5 AS num_stars, 1700000000 + c_custkey AS created_unix FROM {customer}""",
    "email_address": """SELECT c_custkey AS id, c_custkey AS uid, 'second' || CAST(c_custkey % 40 AS VARCHAR(20)) || '@example.com' AS email,
        c_custkey % 2 = 0 AS is_activated FROM {customer}""",
    "repository": """SELECT p_partkey AS id, p_partkey % 150 + 1 AS owner_id, p_name AS name, lower(p_name) AS lower_name, p_type AS description,
        p_size AS size, p_size % 3 = 0 AS is_private, p_size % 7 = 0 AS is_unlisted, p_size % 6 = 0 AS allow_public_wiki,
        p_size % 9 = 0 AS allow_public_issues, p_size % 5 = 0 AS is_fork, CASE WHEN p_size % 5 = 0 THEN p_partkey % 20 + 1 ELSE 0 END AS fork_id,
        p_size % 8 = 0 AS is_mirror, CAST(p_size AS BIGINT) AS num_stars, CAST(p_size % 4 AS BIGINT) AS num_watches,
        CAST(p_size % 6 AS BIGINT) AS num_closed_issues, 1700000000 + p_partkey * 7 AS created_unix FROM {part}""",
    "issue": """SELECT o_orderkey AS id, o_custkey % 100 + 1 AS repo_id, o_custkey AS poster_id, o_orderpriority AS name,
        o_orderkey AS "index", o_orderstatus = 'F' AS is_closed, o_orderstatus = 'P' AS is_pull, o_custkey % 7 AS assignee_id,
        o_orderkey % 13 AS milestone_id, o_orderkey % 17 AS num_comments, o_orderkey % 5 AS priority,
        1700000000 + o_orderkey * 11 % 100000 AS created_unix, 1700000000 + o_orderkey * 13 % 90000 AS updated_unix FROM {orders}""",
    "issue_label": """SELECT DISTINCT l_orderkey AS issue_id, l_partkey % 12 + 1 AS label_id FROM {lineitem}""",
    "label": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, '#' || lower(substr(md5(n_name), 1, 6)) AS color,
        CAST(n_nationkey * 40 AS BIGINT) AS num_issues FROM {nation}""",
    "issue_user": """SELECT DISTINCT l_orderkey AS issue_id, l_suppkey AS uid, l_partkey % 4 = 0 AS is_mentioned, l_partkey % 3 = 0 AS is_read FROM {lineitem}""",
    "milestone": """SELECT CAST(m AS BIGINT) AS id, COUNT(*) AS num_issues, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS num_closed_issues
        FROM (SELECT o_orderkey % 13 AS m, o_orderstatus FROM {orders}) x GROUP BY m""",
    "access": """SELECT l_suppkey AS user_id, l_partkey % 100 + 1 AS repo_id, MAX(CAST(l_linenumber % 4 + 1 AS BIGINT)) AS mode
        FROM {lineitem} GROUP BY l_suppkey, l_partkey % 100 + 1""",
    "collaboration": """SELECT DISTINCT l_suppkey AS user_id, l_partkey % 100 + 1 AS repo_id, CAST(l_linenumber % 3 + 1 AS BIGINT) AS mode
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "watch": """SELECT DISTINCT l_suppkey * 1000 + l_partkey % 100 AS id, l_suppkey AS user_id, l_partkey % 100 + 1 AS repo_id FROM {lineitem} WHERE l_returnflag = 'A'""",
    "star": """SELECT DISTINCT o_custkey * 1000 + o_orderkey % 200 AS id, o_custkey AS uid, o_orderkey % 200 + 1 AS repo_id FROM {orders}""",
    "follow": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 150 + 1 AS follow_id FROM {orders}""",
    "org_user": """SELECT c_custkey AS id, c_custkey AS uid, (c_custkey % 15 + 1) * 10 AS org_id, c_custkey % 2 = 0 AS is_public, c_custkey % 6 = 0 AS is_owner FROM {customer}""",
    "team": """SELECT s_suppkey AS id, (s_suppkey % 15 + 1) * 10 AS org_id, CASE WHEN s_suppkey % 4 = 0 THEN 'owners' ELSE lower(s_name) END AS lower_name,
        CAST(s_suppkey % 4 + 1 AS BIGINT) AS authorize FROM {supplier}""",
    "team_user": """SELECT c_custkey AS id, c_custkey AS uid, c_custkey % 10 + 1 AS team_id, (c_custkey % 15 + 1) * 10 AS org_id FROM {customer}""",
    "team_repo": """SELECT p_partkey AS id, p_partkey AS repo_id, p_partkey % 10 + 1 AS team_id, ((p_partkey % 10 + 1) % 15 + 1) * 10 AS org_id FROM {part}""",
    "action": """SELECT event_id AS id, user_id, event_id % 100 + 1 AS repo_id, event_id % 40 + 1 AS act_user_id,
        'Customer#' || lpad(CAST(event_id % 40 + 1 AS VARCHAR(20)), 9, '0') AS act_user_name, event_type = 'purchase' AS is_private,
        event_type, event_id % 22 + 1 AS op_type, CAST(event_id % 400 AS VARCHAR(20)) || '|' || event_type AS content FROM {events}""",
    "comment": """SELECT event_id AS id, event_id % 1500 + 1 AS issue_id, user_id AS poster_id, event_id % 3 AS type, 1700000000 + event_id * 3 AS updated_unix FROM {events}""",
    "pull_request": """SELECT o_orderkey AS id, o_orderkey AS issue_id, o_orderkey % 3 = 0 AS has_merged, 'branch' || CAST(o_orderkey % 7 AS VARCHAR(20)) AS head_branch,
        o_custkey % 100 + 1 AS base_repo_id FROM {orders}""",
    "release": """SELECT p_partkey AS id, p_partkey % 20 + 1 AS repo_id, 'v' || CAST(p_partkey AS VARCHAR(20)) AS tag_name, p_name AS title, p_brand AS target,
        CAST(p_size AS BIGINT) AS num_commits, p_size % 10 = 0 AS is_draft, p_size % 4 = 0 AS is_prerelease, 1700000000 + p_partkey * 5 % 1000 AS created_unix FROM {part}""",
    "webhook": """SELECT s_suppkey AS id, s_suppkey % 20 + 1 AS repo_id, (s_suppkey % 15 + 1) * 10 AS org_id, 'http://' || lower(s_name) AS url,
        s_suppkey % 3 > 0 AS is_active, s_suppkey % 3 = 1 AS push_only, s_suppkey % 5 = 0 AS send_everything, s_suppkey % 7 = 0 AS on_issues FROM {supplier}""",
    "public_key": """SELECT s_suppkey AS id, s_suppkey % 150 + 1 AS owner_id, s_name AS content FROM {supplier}""",
    "lfs_object": """SELECT sha256(p_name || CAST(p_partkey AS VARCHAR(20))) AS oid, CAST(p_size AS BIGINT) AS size, p_partkey % 30 + 1 AS repo_id FROM {part}""",
}
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark, sf_dir: str, name: str):
    """A site table over the driver's tables of ``sf_dir``, lazily."""
    text = VIEWS[name].replace('"index"', "`index`").replace("VARCHAR(20)", "STRING").replace("sha256(", "sha2_256(")
    text = re.sub(r"sha2_256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", text)
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


class Site:
    """Site tables and raw tables as attributes."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str):
        return view(self.spark, self.dir, name) if name in VIEWS else load(self.spark, self.dir, name)


def sql(text: str) -> str:
    """Oracle SQL with the views that it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in RAW})})" for v in used)
    if not used:
        return text
    if text.strip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {text.strip()[15:]}"
    return f"WITH {views}, {text.strip()[5:]}" if text.strip().startswith("WITH ") else f"WITH {views} {text}"


def query(f, text: str | None = None):
    """(callable of the driver's form, oracle SQL) from a function of a Site."""
    return (lambda spark, sf_dir: f(Site(spark, sf_dir))), sql(text) if text else None
