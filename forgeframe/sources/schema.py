"""The data model: tables, columns, enumerations, and the field names of the archive format.

Times named ``*_unix`` are seconds since the epoch (UTC); 0 stands for "none" in references.
"""

from __future__ import annotations

import re

from pyspark.sql.types import StructType

#: Archive name and columns of every table.
TABLES: dict[str, tuple[str, str]] = {
    "access": ("Access", "id bigint, user_id bigint, repo_id bigint, mode bigint"),
    "access_token": ("AccessToken", "id bigint, uid bigint, name string, sha1 string, sha256 string, created_unix bigint, updated_unix bigint"),
    "action": ("Action", "id bigint, user_id bigint, op_type bigint, act_user_id bigint, act_user_name string, repo_id bigint, repo_user_name string, repo_name string, ref_name string, is_private boolean, content string, created_unix bigint"),
    "email_address": ("EmailAddress", "id bigint, uid bigint, email string, is_activated boolean"),
    "follow": ("Follow", "id bigint, user_id bigint, follow_id bigint"),
    "lfs_object": ("LFSObject", "repo_id bigint, oid string, size bigint, storage string, created_at timestamp"),
    "login_source": ("LoginSource", "id bigint, type bigint, name string, is_actived boolean, is_default boolean, cfg string, created_unix bigint, updated_unix bigint"),
    "notice": ("Notice", "id bigint, type bigint, description string, created_unix bigint"),
    "user": ("User", "id bigint, lower_name string, name string, full_name string, email string, passwd string, login_source bigint, login_name string, type bigint, location string, website string, rands string, salt string, created_unix bigint, updated_unix bigint, last_repo_visibility boolean, max_repo_creation bigint, is_active boolean, is_admin boolean, allow_git_hook boolean, allow_import_local boolean, prohibit_login boolean, avatar string, avatar_email string, use_custom_avatar boolean, num_followers bigint, num_following bigint, num_stars bigint, num_repos bigint, description string, num_teams bigint, num_members bigint"),
    "public_key": ("PublicKey", "id bigint, owner_id bigint, name string, fingerprint string, content string, mode bigint, type bigint, created_unix bigint, updated_unix bigint"),
    "two_factor": ("TwoFactor", "id bigint, user_id bigint, secret string, created_unix bigint"),
    "two_factor_recovery_code": ("TwoFactorRecoveryCode", "id bigint, user_id bigint, code string, is_used boolean"),
    "repository": ("Repository", "id bigint, owner_id bigint, lower_name string, name string, description string, website string, default_branch string, size bigint, use_custom_avatar boolean, num_watches bigint, num_stars bigint, num_forks bigint, num_issues bigint, num_closed_issues bigint, num_pulls bigint, num_closed_pulls bigint, num_milestones bigint, num_closed_milestones bigint, is_private boolean, is_unlisted boolean, is_bare boolean, is_mirror boolean, enable_wiki boolean, allow_public_wiki boolean, enable_external_wiki boolean, external_wiki_url string, enable_issues boolean, allow_public_issues boolean, enable_external_tracker boolean, external_tracker_url string, external_tracker_format string, external_tracker_style string, enable_pulls boolean, pulls_ignore_whitespace boolean, pulls_allow_rebase boolean, is_fork boolean, fork_id bigint, created_unix bigint, updated_unix bigint"),
    "deploy_key": ("DeployKey", "id bigint, key_id bigint, repo_id bigint, name string, fingerprint string, created_unix bigint, updated_unix bigint"),
    "collaboration": ("Collaboration", "id bigint, user_id bigint, repo_id bigint, mode bigint"),
    "upload": ("Upload", "id bigint, uuid string, name string"),
    "watch": ("Watch", "id bigint, user_id bigint, repo_id bigint"),
    "star": ("Star", "id bigint, uid bigint, repo_id bigint"),
    "issue": ("Issue", "id bigint, repo_id bigint, index bigint, poster_id bigint, name string, content string, milestone_id bigint, priority bigint, assignee_id bigint, is_closed boolean, is_pull boolean, num_comments bigint, deadline_unix bigint, created_unix bigint, updated_unix bigint"),
    "pull_request": ("PullRequest", "id bigint, type bigint, status bigint, issue_id bigint, index bigint, head_repo_id bigint, base_repo_id bigint, head_user_name string, head_branch string, base_branch string, merge_base string, has_merged boolean, merged_commit_id string, merger_id bigint, merged_unix bigint"),
    "comment": ("Comment", "id bigint, type bigint, poster_id bigint, issue_id bigint, commit_id bigint, line bigint, content string, created_unix bigint, updated_unix bigint, commit_sha string"),
    "attachment": ("Attachment", "id bigint, uuid string, issue_id bigint, comment_id bigint, release_id bigint, name string, created_unix bigint"),
    "issue_user": ("IssueUser", "id bigint, uid bigint, issue_id bigint, repo_id bigint, milestone_id bigint, is_read boolean, is_assigned boolean, is_mentioned boolean, is_poster boolean, is_closed boolean"),
    "label": ("Label", "id bigint, repo_id bigint, name string, color string, num_issues bigint, num_closed_issues bigint"),
    "issue_label": ("IssueLabel", "id bigint, issue_id bigint, label_id bigint"),
    "milestone": ("Milestone", "id bigint, repo_id bigint, name string, content string, is_closed boolean, num_issues bigint, num_closed_issues bigint, completeness bigint, deadline_unix bigint, closed_date_unix bigint"),
    "mirror": ("Mirror", "id bigint, repo_id bigint, interval bigint, enable_prune boolean, updated_unix bigint, next_update_unix bigint"),
    "release": ("Release", "id bigint, repo_id bigint, publisher_id bigint, tag_name string, lower_tag_name string, target string, title string, sha1 string, num_commits bigint, note string, is_draft boolean, is_prerelease boolean, created_unix bigint"),
    "webhook": ("Webhook", "id bigint, repo_id bigint, org_id bigint, url string, content_type bigint, secret string, events string, is_ssl boolean, is_active boolean, hook_task_type bigint, meta string, last_status bigint, created_unix bigint, updated_unix bigint"),
    "hook_task": ("HookTask", "id bigint, repo_id bigint, hook_id bigint, uuid string, type bigint, url string, signature string, payload_content string, content_type bigint, event_type string, is_ssl boolean, is_delivered boolean, delivered bigint, is_succeed boolean, request_content string, response_content string"),
    "protect_branch": ("ProtectBranch", "id bigint, repo_id bigint, name string, protected boolean, require_pull_request boolean, enable_whitelist boolean, whitelist_user_ids string, whitelist_team_ids string"),
    "protect_branch_whitelist": ("ProtectBranchWhitelist", "id bigint, protect_branch_id bigint, repo_id bigint, name string, user_id bigint"),
    "team": ("Team", "id bigint, org_id bigint, lower_name string, name string, description string, authorize bigint, num_repos bigint, num_members bigint"),
    "org_user": ("OrgUser", "id bigint, uid bigint, org_id bigint, is_public boolean, is_owner boolean, num_teams bigint"),
    "team_user": ("TeamUser", "id bigint, org_id bigint, team_id bigint, uid bigint"),
    "team_repo": ("TeamRepo", "id bigint, org_id bigint, team_id bigint, repo_id bigint"),
    "version": ("Version", "id bigint, version bigint"),
}

#: Enumerations.
ACCESS_MODES = {"none": 0, "read": 1, "write": 2, "admin": 3, "owner": 4}
ACTIONS = {
    "create_repo": 1, "rename_repo": 2, "star_repo": 3, "watch_repo": 4, "commit_repo": 5, "create_issue": 6,
    "create_pull_request": 7, "transfer_repo": 8, "push_tag": 9, "comment_issue": 10, "merge_pull_request": 11,
    "close_issue": 12, "reopen_issue": 13, "close_pull_request": 14, "reopen_pull_request": 15, "create_branch": 16,
    "delete_branch": 17, "delete_tag": 18, "fork_repo": 19, "mirror_sync_push": 20, "mirror_sync_create": 21,
    "mirror_sync_delete": 22,
}
PULL_STATES = {"conflict": 0, "checking": 1, "mergeable": 2}

#: Listing sizes.
PAGE_SIZES = {"feed": 20, "explore": 20, "issues": 10, "admin": 50, "notices": 25, "user_repos": 15, "commits": 30, "api_default": 10, "api_max": 50}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][1])


def archive_name(table: str) -> str:
    return TABLES[table][0]


#: Field names of the archive that aren't the camel-cased column name.
FIELDS = {("email_address", "uid"): "UserID", ("access_token", "uid"): "UserID", ("login_source", "is_actived"): "IsActived", ("login_source", "cfg"): "RawConfig", ("lfs_object", "oid"): "OID", ("access_token", "sha256"): "SHA256", ("issue", "name"): "Title"}
SHORT = {"id": "ID", "oid": "OID", "url": "URL", "uuid": "UUID", "ssl": "SSL", "uid": "UID", "sha": "SHA"}


def field(table: str, column: str) -> str:
    """The archive's name of a column: camel case with initialisms, or its exception."""
    named = FIELDS.get((table, column))
    return named or "".join(SHORT.get(p, p[:1].upper() + p[1:]) for p in column.split("_"))


def column(table: str, name: str) -> str:
    """The column of an archive's field; unknown fields get their snake case."""
    known = {field(table, c): c for c in schema(table).names}
    return known.get(name) or re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
