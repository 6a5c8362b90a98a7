"""Governance queries: permissions, scopes, routes, redacted records, encrypted columns, table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import access
from docketry.operators import changes, governance
from docketry.plans.adapters import view, with_views
from docketry.runtime import table


def user_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each membership allows, counted, with the ones that matter most spelled out."""
    rows = view(spark, sf_dir, "member").join(view(spark, sf_dir, "app_user"), "user_id")
    p = access.permissions(F.col("platform_role"), F.col("role"))
    return rows.select(
        "user_id", "organization_id", F.size(p).alias("permissions"), access.can(F.col("platform_role"), F.col("role"), "draft:export").alias("may_export"),
        access.can(F.col("platform_role"), F.col("role"), "review:clinical").alias("may_review"),
    )


def two_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = view(spark, sf_dir, "member").where(F.col("role") != "visitor").groupBy("user_id").agg(F.collect_set("role").alias("roles"))
    rows = view(spark, sf_dir, "app_user").join(roles, "user_id", "left")
    return rows.select("user_id", access.requires_two_factor(F.col("platform_role"), F.col("roles")).alias("two_factor"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.element_at(F.array(*map(F.lit, ("/admin", "/admin/x", "/administer", "/app/denials", "/review", "/", "/app"))), (F.col("page_id") % 7 + 1).cast("int")), F.when(F.col("page_id") % 2 == 0, "/a").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), access.route_group(path).alias("route"))


def visible_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases, and how much money, each active user may see."""
    member = view(spark, sf_dir, "member").select("user_id", "organization_id").union(view(spark, sf_dir, "reviewer_assignment").select("user_id", "organization_id"))
    scope = member.groupBy("user_id").agg(F.collect_set("organization_id").alias("scope"))
    users = view(spark, sf_dir, "app_user").where("status = 'active'").join(scope, "user_id", "left")
    principals = users.select("user_id", (F.col("platform_role") == "superadmin").alias("superadmin"), "scope")
    totals = view(spark, sf_dir, "denial").groupBy("organization_id").agg(F.count("*").alias("n"), F.sum("claim_cents").alias("c"))
    return governance.totals_visible_to(totals, principals, ["n", "c"]).select("user_id", F.col("n").alias("cases"), F.col("c").alias("claim_cents"))


def visible_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organizations with cases that each active user may see, row by row."""
    scope = view(spark, sf_dir, "member").groupBy("user_id").agg(F.collect_set("organization_id").alias("scope"))
    users = view(spark, sf_dir, "app_user").where("status = 'active'").join(scope, "user_id", "left")
    principals = users.select("user_id", (F.col("platform_role") == "superadmin").alias("superadmin"), "scope")
    cases = view(spark, sf_dir, "denial").groupBy("organization_id").agg(F.count("*").alias("cases"))
    return governance.visible_to(cases, principals).select("user_id", "organization_id", "cases")


def redacted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a nested contact and notes, redacted by their schema."""
    contact = F.struct(F.col("c_name").alias("name"), F.concat(F.lit("call 555-123-4567 on 1/2/1999, "), "c_mktsegment").alias("remark"), F.struct(F.lit("x").alias("ssn"), "c_nationkey").alias("deep"))
    many = F.transform(F.sequence(F.lit(1), F.lit(34) - F.col("c_custkey").cast("int") % 4), lambda i: i.cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", contact.alias("contact"), many.alias("items"), F.repeat("c_mktsegment", 20).alias("longish"), F.encode("c_name", "UTF-8").alias("raw"))
    r = governance.redact_record(rows)
    return r.select("c_custkey", F.col("contact.name").alias("name"), F.col("contact.remark").alias("remark"), F.col("contact.deep.ssn").alias("ssn"), F.col("contact.deep.c_nationkey").alias("nation"),
        F.size("items").alias("items"), F.element_at("items", -1).alias("last_item"), "longish", "raw")


def redacted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties of unknown shape, redacted."""
    body = F.concat(F.lit('{"Patient-Name":"A","k":'), F.get_json_object("props", "$.k"), F.lit(',"list":["mail a@b.org",{"email":"x"}]}'))
    return table(spark, sf_dir, "events").select("event_id", governance.redact_json(body).alias("json"))


def redacted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with stacks, causes and the row that a driver attached to them, redacted."""
    k = F.col("event_id").cast("string")
    stack = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(F.lit("at line "), i.cast("string"), F.lit(" of a"), k, F.lit("@b.org"))), "\n")
    row = F.struct(F.lit("Ann").alias("Patient_Name"), F.col("event_id").alias("n"), F.array(F.lit("on 1/2/1999")).alias("seen"))
    root = F.struct(F.lit("TypeError").alias("name"), F.concat(F.lit("bad ssn 123-45-6789 in "), k).alias("message"))
    error = F.struct(F.lit("DatabaseError").alias("name"), F.concat(F.lit("mail a"), k, F.lit("@b.org refused")).alias("message"), stack.alias("stack"), row.alias("row"),
        F.when(F.col("event_id") % 3 == 0, root).alias("cause"))
    return table(spark, sf_dir, "events").select("event_id", governance.redact_error(F.to_json(error)).alias("error"))


def encrypted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that went through encryption and back; no two ciphertexts are alike."""
    key = governance.encryption_key("a secret that is no key")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("n"))
    sealed = rows.withColumn("s", governance.encrypt(F.col("n"), key))
    return sealed.select("c_custkey", governance.decrypt(F.col("s"), key).alias("name"), F.coalesce(F.contains("s", "n"), F.lit(False)).alias("leaks"), F.coalesce(F.col("s").startswith("v1."), F.lit(False)).alias("sealed"))


def fees_by_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-organization figure, checked to read no restricted table."""
    invoices = view(spark, sf_dir, "invoice")
    restricted = {"outcome": table(spark, sf_dir, "lineitem")}
    figure = invoices.groupBy("organization_id").agg(F.sum("fee_cents").alias("fee_cents"))
    return governance.analytics_safe(figure, restricted)


def contact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts after an import that renames some, adds some, and says nothing of others."""
    have = view(spark, sf_dir, "contact").select("contact_id", "full_name", "org_name")
    k = F.col("contact_id")
    new = have.where(k % 3 == 0).select((k + F.when(k % 2 == 0, F.lit(1_000_000)).otherwise(0)).alias("contact_id"), F.when(k % 9 != 0, F.lit("renamed")).alias("full_name"))
    return changes.upsert(have, new, "contact_id")


def ignored_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some new source documents go in beside those that are there, by content and by citation.

    Keys are made so that documents wait for one another: one that loses by its citation blocks no content.
    """
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(k, (k * k % 211).alias("content"), F.when(k % 17 != 0, k * 3 % 157).alias("citation"))
    return changes.insert_ignore(pages.where("page_id < 20"), pages.where("page_id >= 20"), ["content"], ["citation"], order=["page_id"])


def inserted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents go in, in the order of their ids, if both their content and their source with their length are unique."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("content"))
    return changes.insert_ignore(docs.limit(0), docs, ["content"], ["source", "n_chars"], order=["doc_id"])


def replaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages per document after every fourth document was parsed anew into two, every eighth into none."""
    old = view(spark, sf_dir, "source_span").select("span_id", "source_document_id", "heading")
    docs = old.select("source_document_id").distinct()
    again = docs.where("source_document_id % 4 = 0")
    new = again.where("source_document_id % 8 <> 0").select(F.explode(F.array(F.lit(-1), F.lit(-2)).cast("array<bigint>")).alias("span_id"), "source_document_id", F.lit("new").alias("heading"))
    return changes.replace_children(old, new, "source_document_id", again).groupBy("source_document_id").agg(F.count("*").alias("spans"), F.min("span_id").alias("first"))


def pruned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status once old limiter entries are deleted and stuck jobs put back."""
    jobs = changes.delete_where(view(spark, sf_dir, "job"), (F.col("kind") == "rate_limit") & (F.col("created_at") < F.lit("2024-01-19").cast("timestamp")))
    back = changes.update_where(jobs, F.col("status") == "running", status=F.lit("pending"), attempts=F.col("attempts") + 1)
    return back.groupBy("status").agg(F.count("*").alias("jobs"), F.sum("attempts").alias("attempts"))


QUERIES = {
    "user_permissions": user_permissions,
    "two_factor": two_factor,
    "routes": routes,
    "visible_cases": visible_cases,
    "visible_organizations": visible_organizations,
    "redacted_records": redacted_records,
    "redacted_json": redacted_json,
    "redacted_errors": redacted_errors,
    "encrypted_names": encrypted_names,
    "fees_by_organization": fees_by_organization,
    "contact_upsert": contact_upsert,
    "ignored_inserts": ignored_inserts,
    "inserted_documents": inserted_documents,
    "replaced_spans": replaced_spans,
    "pruned_jobs": pruned_jobs,
}
ORACLE = {
    "user_permissions": f"""{with_views("member", "app_user")} select user_id, organization_id, case platform_role when 'superadmin' then 26 else
  case role when 'readonly' then 4 when 'appeal_specialist' then 10 when 'org_admin' then 13 else 0 end
  + case when platform_role = 'none' then 0 when role = 'visitor' then 5 else 3 end end::integer as permissions,
  platform_role = 'superadmin' or role in ('appeal_specialist', 'org_admin') as may_export, platform_role in ('superadmin', 'clinical_reviewer') as may_review from member join app_user using (user_id)""",
    "two_factor": f"""{with_views("member", "app_user")} select user_id, platform_role <> 'none' or exists (select 1 from member m where m.user_id = u.user_id and role in ('org_admin', 'appeal_specialist')) as two_factor from app_user u""",
    "routes": """with p as (select page_id, (['/admin', '/admin/x', '/administer', '/app/denials', '/review', '/', '/app'])[page_id % 7 + 1] || case when page_id % 2 = 0 then '/a' else '' end as path from pages)
select page_id, path, case when regexp_matches(path, '^/admin(/|$)') then 'admin' when regexp_matches(path, '^/review(/|$)') then 'review' when regexp_matches(path, '^/app(/|$)') then 'app' else 'public' end as route from p""",
    "visible_cases": f"""{with_views("member", "reviewer_assignment", "app_user", "denial")}, s as (select user_id, organization_id from member union select user_id, organization_id from reviewer_assignment
  union select user_id, organization_id from app_user, (select distinct organization_id from denial) where platform_role = 'superadmin')
select user_id, count(*) as cases, sum(claim_cents)::bigint as claim_cents from app_user u join s using (user_id) join denial using (organization_id) where u.status = 'active' group by user_id""",
    "visible_organizations": f"""{with_views("member", "app_user", "denial")}, c as (select organization_id, count(*) as cases from denial group by organization_id),
s as (select user_id, organization_id from member union select user_id, organization_id from app_user, c where platform_role = 'superadmin')
select user_id, organization_id, cases from app_user u join s using (user_id) join c using (organization_id) where u.status = 'active'""",
    "redacted_records": """select c_custkey, '[redacted]' as name, 'call [redacted:phone] on [redacted:date], ' || c_mktsegment as remark, '[redacted]' as ssn, c_nationkey as nation,
  case when c_custkey % 4 < 2 then 33 else 34 - c_custkey % 4 end::integer as items, case when c_custkey % 4 < 2 then '[+' || (2 - c_custkey % 4) || ' more]' else (34 - c_custkey % 4)::varchar end as last_item,
  case when length(c_mktsegment) * 20 > 160 then '[redacted:' || length(c_mktsegment) * 20 || ' chars]' else repeat(c_mktsegment, 20) end as longish, '[binary:' || strlen(c_name) || ' bytes]' as raw from customer""",
    "redacted_json": """select event_id, '{"Patient-Name":"[redacted]","k":' || (props->>'$.k') || ',"list":["mail [redacted:email]",{"email":"[redacted]"}]}' as json from events""",
    "redacted_errors": """select event_id, '{"message":"mail [redacted:email] refused","name":"DatabaseError","row":{"Patient_Name":"[redacted]","n":' || event_id || ',"seen":["on [redacted:date]"]},"stack":"'
  || array_to_string(list_transform(range(1, 13), lambda i: 'at line ' || i || ' of [redacted:email]'), '\\n') || '"'
  || case when event_id % 3 = 0 then ',"cause":{"message":"bad ssn [redacted:ssn] in ' || event_id || '","name":"TypeError"}' else '' end || '}' as error from events""",
    "encrypted_names": "select c_custkey, case when c_custkey % 5 <> 0 then c_name end as name, false as leaks, c_custkey % 5 <> 0 as sealed from customer",
    "fees_by_organization": f"{with_views('invoice')} select organization_id, sum(fee_cents)::bigint as fee_cents from invoice group by organization_id",
    "contact_upsert": f"""{with_views("contact")}, n as (select case when contact_id % 2 = 0 then contact_id + 1000000 else contact_id end as contact_id, case when contact_id % 9 <> 0 then 'renamed' end as full_name from contact where contact_id % 3 = 0)
select coalesce(c.contact_id, n.contact_id) as contact_id, coalesce(n.full_name, c.full_name) as full_name, org_name from contact c full join n on n.contact_id = c.contact_id""",
    "ignored_inserts": """with recursive p as (select page_id, page_id * page_id % 211 as content, case when page_id % 17 <> 0 then page_id * 3 % 157 end as citation from pages),
n as (select *, row_number() over (order by page_id) as n from p where page_id >= 20),
r as (select 0::bigint as n, (select list(content) from p where page_id < 20) as contents, (select list(citation) from p where page_id < 20) as citations, false as ok
  union all select n.n, case when v.ok then list_append(contents, content) else contents end, case when v.ok then list_append(citations, citation) else citations end, v.ok
  from r join n on n.n = r.n + 1, lateral (select not list_contains(coalesce(contents, []), content) and not coalesce(list_contains(citations, citation), false) as ok) v)
select page_id, content, citation from n join r using (n) where ok""",
    "inserted_documents": """with recursive d as (select doc_id, source, n_chars, sha256(text) as content, source || ':' || n_chars as named, row_number() over (order by doc_id) as n from documents),
r as (select 0::bigint as n, []::varchar[] as contents, []::varchar[] as names, false as ok
  union all select d.n, case when v.ok then list_append(contents, content) else contents end, case when v.ok then list_append(names, named) else names end, v.ok
  from r join d on d.n = r.n + 1, lateral (select not coalesce(list_contains(contents, content), false) and not coalesce(list_contains(names, named), false) as ok) v)
select doc_id, source, n_chars, content from d join r using (n) where ok""",
    "replaced_spans": f"""{with_views("source_span")}, s as (select source_document_id, span_id from source_span where source_document_id % 4 <> 0
  union all select source_document_id, unnest([-1, -2]) from (select distinct source_document_id from source_span where source_document_id % 8 = 4))
select source_document_id, count(*) as spans, min(span_id) as first from s group by source_document_id""",
    "pruned_jobs": f"""{with_views("job")}, k as (select case status when 'running' then 'pending' else status end as status, attempts + (status = 'running')::integer as attempts from job
  where not (kind = 'rate_limit' and created_at < timestamp '2024-01-19')) select status, count(*) as jobs, sum(attempts)::bigint as attempts from k group by status""",
}
