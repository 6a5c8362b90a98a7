"""Roles, permissions and routes: closed lists and the expressions that read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permissions in their groups.
READ = ("denial:read", "draft:read", "invoice:read", "org:read_dashboard")
SPECIALIST = (
    "denial:create", "denial:update", "draft:generate", "draft:submit_for_review",
    "draft:export", "outcome:record",
)
ORG_ADMIN = ("denial:delete", "org:read_members", "org:manage_members")
REVIEW = ("review:queue", "review:edit_assertion", "denial:read", "draft:read")
CONSOLE = (
    "admin:organizations", "admin:users", "admin:all_appeals", "admin:corpus", "admin:spend",
    "admin:jobs", "admin:email", "admin:demo_requests", "admin:delete_org_data",
)
BY_ORG_ROLE = {"readonly": READ, "appeal_specialist": READ + SPECIALIST, "org_admin": READ + SPECIALIST + ORG_ADMIN}
BY_PLATFORM_ROLE = {
    "none": (),
    "clinical_reviewer": (*REVIEW, "review:clinical"),
    "legal_reviewer": (*REVIEW, "review:legal"),
    "superadmin": tuple(dict.fromkeys((*READ, *SPECIALIST, *ORG_ADMIN, *REVIEW, "review:clinical", "review:legal", *CONSOLE))),
}
#: Tables that hold what comes from submitted records.
PHI_TABLES = (
    "denial", "denial_document", "denial_span", "clinical_fact", "appeal_draft", "assertion",
    "assertion_review", "review_action", "submission", "outcome",
)


def _granted(role: Column, by_role: dict[str, tuple[str, ...]]) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(reduce(lambda c, kv: F.when(role == kv[0], F.array(*map(F.lit, kv[1])) if kv[1] else none).otherwise(c), by_role.items(), none), none)


def permissions(platform_role: Column, org_role: Column) -> Column:
    """Everything a platform role and one organization's role allow; unknown and null roles allow nothing."""
    return F.sort_array(F.array_union(_granted(platform_role, BY_PLATFORM_ROLE), _granted(org_role, BY_ORG_ROLE)))


def can(platform_role: Column, org_role: Column, permission: str) -> Column:
    return F.array_contains(permissions(platform_role, org_role), permission)


def requires_two_factor(platform_role: Column, org_roles: Column) -> Column:
    """Everyone who can do more than read."""
    return (platform_role != "none") | F.exists(F.coalesce(org_roles, F.array().cast("array<string>")), lambda r: r != "readonly")


def route_group(path: Column) -> Column:
    under = lambda top: (path == top) | path.startswith(top + "/")
    return F.when(under("/admin"), "admin").when(under("/review"), "review").when(under("/app"), "app").otherwise("public")


def is_phi(table: Column) -> Column:
    return table.isin(*PHI_TABLES)
