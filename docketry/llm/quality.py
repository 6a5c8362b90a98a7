"""Quality rules: base counts and robust multivariate outliers, in DataFrame functions only.

Every text gets its counts within its own row. Documents of one language and source
form a group; their transformed counts are points. Each group's location and scatter are
minimum-covariance-determinant estimates: from two starts, concentration steps keep the
share H of points that are nearest by Mahalanobis distance and estimate anew, until a
start's determinant falls no more; the start that ends lower counts. Scatter is scaled so
that the median distance in a group is that of a chi-squared variable, which makes up for
the points left out. The estimate of n points counts n squared against SHRINK squared of
its language over all sources, whose own counts alike against that of all documents, so
groups of any size have one, and a document more changes none by a leap. A document far
from its group is rejected.

A step is one aggregation, combined before it is shuffled: counts and moments of the
points by fine bins of their distance, so shares and medians come from whole counts,
however the rows are dealt, and groups stay small tables that rows meet by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, table

#: Words are runs of other characters than these, symbols are these.
SPACES, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
FEW_WORDS = 50
#: Share of points kept by a step, the fall of a log determinant that asks for another,
#: bins of distance in a doubling, and the points that count as much as the wider group.
H, FALL, BINS, SHRINK = 0.75, 1e-3, 32, 50
#: Squared distance beyond which a document is an outlier, in units where the median is
#: that of a chi-squared variable with as many degrees as there are dimensions.
CUTOFF, MEDIAN = 250.0, 3.357
#: Up to so many groups and starts are broadcast.
BROADCAST_GROUPS = 100_000
#: The least standard deviation of each dimension: words, word length, symbols, repeats.
FLOOR = (0.35, 0.35, 0.06, 0.06)
P = len(FLOOR)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text.

    Windows of three words are sorted by a hash that keeps all bits but those that number
    the windows of its text; neighbours of one hash are compared word by word. A text in
    which two of them differ has its windows sorted by their words instead.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        *carry,
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.array_remove(F.split(text, SPACES + "+"), "").alias("_words"),
    )
    n = F.size("_words")
    bits = F.length(F.bin(n))
    numbered = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    rows = rows.withColumn("_bits", bits).withColumn("_hashes", numbered)
    keyed = F.expr("sort_array(transform(_hashes, (h, i) -> (shiftleft(shiftright(h, _bits), _bits) | cast(i as bigint))))")
    rows = rows.withColumn("_keyed", keyed)
    p, q = "cast(k & (shiftleft(1L, _bits) - 1) as int)", "cast(get(_keyed, i + 1) & (shiftleft(1L, _bits) - 1) as int)"
    same = " and ".join(f"get(_words, {p} + {d}) = get(_words, {q} + {d})" for d in range(3))
    rows = rows.withColumn("_next", F.expr(f"transform(_keyed, (k, i) -> if(shiftright(k, _bits) = shiftright(get(_keyed, i + 1), _bits), if({same}, 1, 2), 0))"))
    rows = rows.withColumn(
        "_by_words",
        F.expr(
            "if(array_contains(_next, 2), sort_array(transform(_hashes, (h, i) -> "
            "struct(get(_words, i) as a, get(_words, i + 1) as b, get(_words, i + 2) as c, cast(i as bigint) as p))), null)"
        ),
    )
    alike = lambda d: " and ".join(f"x.{c} = get(_by_words, i + {d}).{c}" for c in "abc")
    twice = F.expr(
        "sort_array(filter(if(_by_words is null, "
        f"transform(_keyed, (k, i) -> if(get(_next, i) = 1 or get(_next, i - 1) = 1, cast({p} as bigint), null)), "
        f"transform(_by_words, (x, i) -> if(({alike(-1)}) or ({alike(1)}), x.p, null))), p -> p is not null))"
    )
    rows = rows.withColumn("_twice", twice)
    return rows.select(
        id_col,
        *carry,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(_twice, (p, i) -> least(3L, coalesce(get(_twice, i + 1), p + 3) - p)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def points() -> list[Column]:
    """The transformed counts: log words, word length, symbol share, repeated share."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.least(F.col("word_chars") / words, F.lit(1e6)),
        F.log1p(10 * F.col("n_symbols") / words),
        F.col("n_repeat_words") / words,
    ]


def _squared_distance() -> Column:
    """Forward substitution through the Cholesky factor of the row's group."""
    y: list[Column] = []
    for i in range(P):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * y[j]
        y.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
MEANS, FACTOR, COVS = [f"m{i}" for i in range(P)], [f"l{i}{j}" for i, j in LOWER], [f"c{i}{j}" for i, j in LOWER]


def _factored(e: DataFrame) -> DataFrame:
    """e with the Cholesky factor of its covariances and ``det``, the log of the factor's determinant."""
    for i, j in LOWER:
        v = F.col(f"c{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        e = e.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    return e.withColumn("det", sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00")))


def _met(rows: DataFrame, groups: DataFrame, n: int, on: str = "grp", how: str = "inner") -> DataFrame:
    """rows with what is known of their n groups; a counted few are broadcast, so a large group's rows stay where they are."""
    return rows.join(F.broadcast(groups) if n <= BROADCAST_GROUPS else groups, on, how)


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts of each ``grp``: median and median deviation, mean and standard deviation, from bins of each coordinate."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(P)]))
    bins = rows.select("grp", each.alias("p")).select("grp", "p.*").groupBy("grp", "i", F.floor(64 * F.log1p("x")).alias("bin"))
    bins = bins.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).withColumn("x", F.col("s") / F.col("n"))
    whole = Window.partitionBy("grp", "i")
    half = lambda by: 2 * F.sum("n").over(whole.orderBy(by, "bin")) >= F.sum("n").over(whole)
    bins = bins.withColumn("upper", half("x"))
    bins = bins.withColumn("middle", F.min(F.when(F.col("upper"), F.col("x"))).over(whole))
    bins = bins.withColumn("off", F.abs(F.col("x") - F.col("middle"))).withColumn("wide", half("off"))
    mean = F.sum("s") / F.sum("n")
    of = bins.groupBy("grp", "i").agg(
        F.first("middle").alias("a"), F.min(F.when(F.col("wide"), F.col("off"))).alias("d"),
        mean.alias("b"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("s"),
    )
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    of = of.groupBy("grp").agg(*[at(c, i).alias(f"{c}{i}") for c in "adbs" for i in range(P)])
    first = lambda name, m, sd: of.select(
        "grp", F.lit(name).alias("start"), *[F.col(f"{m}{i}").alias(f"m{i}") for i in range(P)],
        *[(F.greatest(F.col(f"{sd}{i}"), F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in LOWER],
        *[F.lit(None).cast("double").alias(c) for c in COVS], F.lit(None).cast("double").alias("det"),
    )
    return first("median", "a", "d").unionByName(first("mean", "b", "s"))


def _step(rows: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """estimate with ``n``, ``scale``, the median distance of its group's points, and ``next``, what the nearest of them give."""
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    met = _met(rows, estimate.select("grp", "start", *MEANS, *FACTOR), groups)
    sums = {"n": F.count("*")} | {f"y{i}": F.sum(y[i]) for i in range(P)} | {f"y{i}{j}": F.sum(y[i] * y[j]) for i, j in LOWER}
    bin_of = F.floor(BINS * F.log2(F.greatest(_squared_distance(), F.lit(2.0**-20))))
    bins = met.groupBy("grp", "start", bin_of.alias("bin")).agg(*[v.alias(k) for k, v in sums.items()])
    whole = Window.partitionBy("grp", "start")
    bins = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
    near = F.col("upto") - F.col("n") < H * F.col("all")
    of = bins.groupBy("grp", "start").agg(
        F.first("all").alias("n"),
        F.pow(F.lit(2.0), (F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bin"))) + 0.5) / BINS).alias("scale"),
        *[F.sum(F.when(near, F.col(k))).alias(f"near_{k}") for k in sums],
    )
    share = lambda k: F.col(f"near_{k}") / F.col("near_n")
    of = estimate.select("grp", "start", *MEANS, F.col("det").alias("before"), *[F.col(c).alias(f"before_{c}") for c in COVS]).join(of, ["grp", "start"])
    floor = lambda i, j: FLOOR[i] ** 2 if i == j else 0.0
    of = of.withColumns({f"c{i}{j}": share(f"y{i}{j}") - share(f"y{i}") * share(f"y{j}") + F.lit(floor(i, j)) for i, j in LOWER})
    of = _factored(of.withColumns({f"next_m{i}": F.col(f"m{i}") + share(f"y{i}") for i in range(P)}))
    return of.withColumn("falls", F.col("before").isNull() | (F.col("det") < F.col("before") - FALL))


def minimum_determinants(rows: DataFrame) -> DataFrame:
    """The estimate of each ``grp`` of rows with coordinates x0...: ``n``, means and scaled covariances.

    A start that falls no more is put aside. Every other falls by FALL, and FLOOR bounds
    determinants from below, so all end.
    """
    estimate = checkpoint(_starts(rows))
    groups, ended = estimate.count(), []
    while True:
        stepped = checkpoint(_step(rows, estimate, groups))
        ended.append(stepped.where(~F.col("falls")).select("grp", "start", "n", "scale", "before", *MEANS, *[F.col(f"before_{c}").alias(c) for c in COVS]))
        estimate = stepped.where("falls").select("grp", "start", *[F.col(f"next_{m}").alias(m) for m in MEANS], *FACTOR, *COVS, "det")
        groups = estimate.count()
        if not groups:
            break
    best = reduce(DataFrame.unionByName, ended).groupBy("grp").agg(F.min_by(F.struct("n", "scale", *MEANS, *COVS), F.struct("before", "start")).alias("e")).select("grp", "e.*")
    return best.select("grp", "n", *MEANS, *[(F.col(c) * F.greatest("scale", F.lit(0.1)) / MEDIAN).alias(c) for c in COVS])


def judges(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """What judges each ``grp`` of ``lng`` and ``corpus``, an empty text: its estimate joined with its language's and that with the corpus's, by SHRINK."""
    out = groups
    for k, column in (("g", "grp"), ("l", "lng"), ("c", "corpus")):
        named = estimates.select(F.col("grp").alias("_pool"), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *MEANS, *COVS)])
        out = out.withColumn("_pool", F.concat(F.lit(k), column)).join(named, "_pool", "left").drop("_pool")

    def joined(k: str, c: str, wider: Column) -> Column:
        own = F.pow(F.coalesce(F.col(f"{k}_n"), F.lit(0)) / SHRINK, 2)
        return (own * F.coalesce(F.col(f"{k}_{c}"), F.lit(0.0)) + wider) / (own + 1)

    return _factored(out.select("grp", *[joined("g", c, joined("l", c, F.col(f"c_{c}"))).alias(c) for c in (*MEANS, *COVS)]))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The id column, the five counts, ``base_failed``, ``distance2`` and ``kept``.

    A null text has no words and fails. Null languages and sources form groups of their
    own. Documents that fail take no part in the estimates; those of groups in which all
    fail are measured by their language and the corpus. The distance is null only if no
    document passes. Repeated rows and null ids are judged each, an empty table gives an
    empty result, further columns are not carried.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), mark(lang_col).alias("lng"), F.concat(mark(lang_col), F.lit("\n"), mark(source_col)).alias("grp"))
    rows = text_counts(named, "_id", "_text", ("lng", "grp")).withColumn("base_failed", base_failed())
    rows = checkpoint(rows.withColumns({f"x{i}": x for i, x in enumerate(points())}))
    pools = F.array(F.concat(F.lit("g"), "grp"), F.concat(F.lit("l"), "lng"), F.lit("c"))
    members = rows.where(~F.col("base_failed")).select(F.explode(pools).alias("grp"), *[f"x{i}" for i in range(P)])
    estimates = checkpoint(minimum_determinants(members))
    groups = checkpoint(rows.select("grp", "lng", F.lit("").alias("corpus")).distinct())
    judge = checkpoint(judges(groups, estimates))
    judged = _met(rows, judge, judge.count(), how="left").withColumn("distance2", _squared_distance())
    fine = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", fine.alias("kept")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
