"""Mixing sources to target weights: hierarchical budgeting over domain, language, source.

1. One pass over the texts gives each document's tokens and leaf, and each leaf's supply:
   its tokens times the epochs it may be repeated for.
2. A token budget goes down the tree. The children of a node share its budget by weight;
   one that cannot use its share is filled and its siblings share the rest. A node never
   gets more than its leaves can use together, so only what a whole family cannot use
   goes back up and to its parent's siblings.
3. Each leaf spends its target on whole epochs and a prefix of one more, whose order is
   drawn from seed, epoch and id. The prefix ends in one bucket of the drawn order, found
   from bucket sums, and only that bucket's documents are ordered.

Whole numbers throughout: shares are rounded by running sums, so they add up exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.columns import fresh
from docketry.runtime import checkpoint, table

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a bucket of a leaf's drawn order should hold.
BUCKET = 4096
#: Up to so many leaves their table is broadcast: some 30 MB.
BROADCAST_LEAVES = 100_000

#: Production parameters: share of the corpus's tokens to give out, epochs a leaf may be
#: repeated for, seed, and the weights of children by path; a child without one weighs 1.
SHARE, EPOCHS, SEED = 0.8, 4, 20
WEIGHTS = {
    ("web",): 40, ("reference",): 35, ("community",): 25,
    **{(d, lang): w for d in ("web", "reference", "community") for lang, w in (("en", 50), ("de", 20), ("fr", 15), ("es", 15))},
}


def mark(c: Column) -> Column:
    """A name of its own for null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def domain_of(source: Column) -> Column:
    """The domain of a source in the production tree."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "reference").otherwise("community")


def leaf_key(levels: list[Column]) -> Column:
    """One string for a path of names; a line break within a name is written out."""
    plain = lambda c: F.replace(F.replace(mark(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws("\n", *map(plain, levels))


def draw(seed: int, epoch: Column, id_col: str) -> Column:
    """Where a document stands in the order of an epoch, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), mark(F.col(id_col))))


def fill(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``target`` of each child from its parent's ``budget``, its ``weight`` and ``supply``.

    In the order of supply over weight a child is full if its share of what is left
    covers its supply; the others share the rest.
    """
    by = Window.partitionBy(*parent).orderBy((F.col("_s") / F.col("_w")), key)
    upto, after = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parent)
    big = lambda c: f"cast({c} as decimal(19,0))"
    rows = (
        children.withColumn("_w", F.greatest("weight", F.lit(1)))
        .withColumn("_s", F.when(F.col("weight") > 0, F.col("supply")).otherwise(F.lit(0)))
        .withColumn("_left", F.col("budget") - F.sum("_s").over(upto) + F.col("_s"))
        .withColumn("_rest", F.sum("_w").over(after))
        .withColumn("_full", F.expr(f"{big('_s')} * {big('_rest')} <= {big('_w')} * {big('_left')}"))
        .withColumn("_full", F.min("_full").over(upto))
        .withColumn("_open", F.when(F.col("_full"), 0).otherwise(F.col("_w")))
        .withColumn("_share", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("_s")).otherwise(0)).over(all_))
        .withColumn("_open_all", F.greatest(F.sum("_open").over(all_), F.lit(1)))
        .withColumn("_open_upto", F.sum("_open").over(upto))
    )
    part = lambda c: f"{big('_share')} * {big(c)} div {big('_open_all')}"
    share = F.expr(f"({part('_open_upto')}) - ({part('(_open_upto - _open)')})")
    return rows.withColumn("target", F.when(F.col("_full"), F.col("_s")).otherwise(F.least(share, F.col("_s"))).cast("long")).select(
        *children.columns, "target"
    )


def tree_targets(leaves: DataFrame, depth: int, budget: int) -> DataFrame:
    """leaves with ``target``; they have keys ``k1`` to ``k<depth>``, weights ``w1``... and ``supply``."""
    given = None
    for level in range(1, depth + 1):
        keys = [f"k{i}" for i in range(1, level + 1)]
        nodes = leaves.groupBy(*keys).agg(F.max(f"w{level}").alias("weight"), F.sum("supply").alias("supply"))
        if given is None:
            supply = F.sum("supply").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.least(F.lit(int(budget)).cast("long"), supply))
        else:
            nodes = nodes.join(given, keys[:-1])
        given = fill(nodes, keys[:-1] or [F.lit(0)], keys[-1]).select(*keys, F.col("target").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "target"), [f"k{i}" for i in range(1, depth + 1)])


def weight_of(levels: list[Column], weights: Mapping[tuple, int]) -> Column:
    """The weight of a node given by its path."""
    own = {path: w for path, w in weights.items() if len(path) == len(levels)}
    if not own:
        return F.lit(1).cast("long")
    known = F.create_map(*[x for path, w in own.items() for x in (leaf_key([F.lit(p) for p in path]), F.lit(int(w)).cast("long"))])
    return F.coalesce(F.element_at(known, leaf_key(levels)), F.lit(1).cast("long"))


def slim_rows(docs: DataFrame, levels: dict[str, Column], tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """id, the levels' columns, n_tokens and leaf of each document."""
    return docs.select(
        F.col(id_col), *[c.alias(name) for name, c in levels.items()], tokens.cast("long").alias("n_tokens"), leaf_key(list(levels.values())).alias("leaf")
    )


def leaf_plan(
    rows: DataFrame, levels: list[str], weights: Mapping[tuple, int], share: float, epochs: int, seed: int, id_col: str = "doc_id", budget: int | None = None
) -> DataFrame:
    """For each ``leaf`` of slim rows its ``target``, ``whole`` epochs and ``cut``, the last draw in the prefix."""
    columns = [F.col(c) for c in levels]
    leaves = rows.groupBy("leaf", *levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    leaves = checkpoint(
        leaves.select(
            "leaf", "tokens", "n", (F.col("tokens") * int(epochs)).alias("supply"),
            *[mark(c).alias(f"k{i}") for i, c in enumerate(columns, 1)],
            *[weight_of(columns[:i], weights).alias(f"w{i}") for i in range(1, len(columns) + 1)],
        )
    )
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = tree_targets(leaves, len(levels), budget)
    whole = F.expr("if(tokens > 0, target div tokens, 0)")
    plan = checkpoint(
        plan.select("leaf", "tokens", "n", "target", whole.cast("long").alias("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
    )
    places = F.greatest(F.ceil(F.col("n") / BUCKET), F.lit(1)).cast("long")
    drawn = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    open_ = sized(plan.where(F.col("rest") > 0).select("leaf", "whole", "rest", places.alias("places")))
    at = rows.join(open_, "leaf").withColumn("draw", draw(seed, F.col("whole"), id_col)).withColumn("bucket", F.shiftright(drawn * F.col("places"), 32))
    sums = checkpoint(at.groupBy("leaf", "bucket", "rest").agg(F.sum("n_tokens").alias("tokens")))
    upto = Window.partitionBy("leaf").orderBy("bucket")
    ends = sums.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens")).where(
        (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest"))
    )
    ends = sized(checkpoint(ends.select("leaf", "bucket", (F.col("rest") - F.col("before")).alias("room"))))
    inside = at.join(ends, ["leaf", "bucket"]).groupBy("leaf", "draw", "room", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy("leaf", "bucket").orderBy("draw"))
    fits = inside.withColumn("running", running).where(F.col("running") <= F.col("room")).groupBy("leaf").agg(F.max("draw").alias("fits"))
    # if nothing of the last bucket fits, all buckets before it are the prefix
    edge = F.lpad(F.lower(F.hex(F.expr("(shiftleft(bucket, 32) + places - 1) div places"))), 8, "0")
    edges = ends.join(open_.select("leaf", "places"), "leaf").select("leaf", edge.alias("edge"))
    return checkpoint(
        plan.join(fits, "leaf", "left").join(edges, "leaf", "left").select("leaf", "target", "whole", F.coalesce("fits", "edge").alias("cut"))
    )


def sized(small: DataFrame) -> DataFrame:
    """Broadcast if its rows are few enough, else left to the optimizer."""
    return F.broadcast(small) if small.count() <= BROADCAST_LEAVES else small


def with_copies(docs: DataFrame, leaf: Column, plan: DataFrame, seed: int, id_col: str = "doc_id", name: str = "copies") -> DataFrame:
    """docs and, under a name, how often the mixture takes each."""
    own_leaf, whole, cut = (fresh([*docs.columns, name], x) for x in ("_leaf", "_whole", "_cut"))
    plan = sized(plan).select(F.col("leaf").alias(own_leaf), F.col("whole").alias(whole), F.col("cut").alias(cut))
    joined = docs.withColumn(own_leaf, leaf).join(plan, own_leaf)
    extra = F.coalesce(draw(seed, F.col(whole), id_col) <= F.col(cut), F.lit(False)).cast("long")
    return joined.withColumn(name, F.col(whole) + extra).drop(own_leaf, whole, cut)


def production_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))


def mixture(
    docs: DataFrame,
    levels: dict[str, Column] | None = None,
    tokens: Column | None = None,
    weights: Mapping[tuple, int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    budget: int | None = None,
) -> DataFrame:
    """The id, levels, ``n_tokens`` and ``copies`` of every document, 0 for those left out.

    budget is the number of tokens to give out, or else share of all there are; tokens
    are words unless another column is given. A prefix takes whole documents while
    they fit, so a leaf falls short of its target by less than one document. Null
    levels are leaves of their own. Null and empty texts have no tokens; they are taken
    where they stand within a prefix, and a leaf without tokens gives nothing. Rows
    that repeat an id within a leaf stand or fall together. A weight of 0 leaves a node
    out. An empty table gives an empty result; further columns are not carried.
    """
    levels = levels or production_levels()
    rows = checkpoint(slim_rows(docs, levels, words() if tokens is None else tokens, id_col))
    plan = leaf_plan(rows, list(levels), weights, share, epochs, seed, id_col, budget)
    return with_copies(rows, F.col("leaf"), plan, seed, id_col).select(id_col, *levels, "n_tokens", "copies")


def apply_mixture(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, **parameters) -> DataFrame:
    """The rows of docs themselves, each as often as the mixture takes it, columns unchanged."""
    levels = parameters.pop("levels", None) or production_levels()
    tokens = parameters.pop("tokens", None)
    rows = checkpoint(slim_rows(docs, levels, words() if tokens is None else tokens, id_col))
    parameters = {"weights": WEIGHTS, "share": SHARE, "epochs": EPOCHS, **parameters}
    plan = leaf_plan(rows, list(levels), seed=seed, id_col=id_col, **parameters)
    copies = fresh(docs.columns, "_copies")
    taken = with_copies(docs, leaf_key(list(levels.values())), plan, seed, id_col, copies).where(F.col(copies) > 0)
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _fill_sql(name: str, source: str, parent: str, key: str) -> str:
    by = f"over (partition by {parent} order by s / w, {key} rows between unbounded preceding and current row)"
    after = f"over (partition by {parent} order by s / w, {key} rows between current row and unbounded following)"
    return f"""
{name}_1 as (select *, budget - sum(s) {by} + s as open_budget, sum(w) {after} as open_weight from {source}),
{name}_2 as (select *, bool_and(s::hugeint * open_weight::hugeint <= w::hugeint * open_budget::hugeint) {by} as filled from {name}_1),
{name}_3 as (select *, budget - coalesce(sum(s) filter (where filled) over (partition by {parent}), 0) as room,
    coalesce(sum(w) filter (where not filled) over (partition by {parent}), 0) as w_all,
    coalesce(sum(w) filter (where not filled) {by}, 0) as w_upto from {name}_2),
{name} as (select *, case when filled then s else least(s,
    (room::hugeint * w_upto::hugeint) // greatest(w_all, 1)::hugeint - (room::hugeint * (w_upto - w)::hugeint) // greatest(w_all, 1)::hugeint) end as target from {name}_3)"""


ORACLE = {
    "op10_mixing": rf"""
with d as (
  select doc_id, lang, source,
    case when source = 'src0' then 'web' when regexp_matches(source, '^src[1-9]$') then 'reference' else 'community' end as domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n_tokens
  from documents),
leaves as (
  select domain, coalesce('=' || lang, 'null') as k2, coalesce('=' || source, 'null') as k3, sum(n_tokens) as tokens, {EPOCHS} * sum(n_tokens) as supply,
    case domain when 'web' then 40 when 'reference' then 35 else 25 end as w1,
    case lang when 'en' then 50 when 'de' then 20 when 'fr' then 15 when 'es' then 15 else 1 end as w2
  from d group by domain, lang, source),
l1 as (select domain, domain as k1, max(w1) as w, sum(supply) as s,
    least(floor((select sum(tokens) from leaves)::double * {SHARE})::bigint, sum(sum(supply)) over ()) as budget from leaves group by domain),
{_fill_sql("t1", "l1", "1", "'=' || k1")},
l2 as (select l.domain, k2, max(w2) as w, sum(supply) as s, any_value(target) as budget from leaves l join t1 using (domain) group by l.domain, k2),
{_fill_sql("t2", "l2", "domain", "k2")},
l3 as (select l.domain, l.k2, k3, 1 as w, supply as s, tokens, target as budget from leaves l join t2 on t2.domain = l.domain and t2.k2 = l.k2),
{_fill_sql("t3", "l3", "domain, k2", "k3")},
p as (select domain, k2, k3, tokens, target, case when tokens > 0 then target // tokens else 0 end as whole from t3),
o as (
  select d.*, whole, target - whole * tokens as rest,
    sum(n_tokens) over (partition by p.domain, p.k2, p.k3 order by md5('{SEED}:' || whole::bigint || ':' || coalesce('=' || doc_id, 'null'))
      range between unbounded preceding and current row) as running
  from d join p on p.domain = d.domain and p.k2 = coalesce('=' || lang, 'null') and p.k3 = coalesce('=' || source, 'null'))
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens,
  (whole + case when rest > 0 and running <= rest then 1 else 0 end)::bigint as copies from o"""
}
QUERIES = {"op10_mixing": op10_mixing}
