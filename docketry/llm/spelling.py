"""Spelling variant grouping: words one edit apart, found by a rare-first filter on bigrams.

Bigrams are ordered by how many words' places they stand at, rarest first, and every word
keeps its three rarest with their places. One edit takes at most two bigrams from a word
and shifts the places of the others by at most one, in order. So the first in order that
two words one edit apart both keep is among the three rarest of either: the words meet
there. The order counts a bigram at all places together, since an edit moves places and
an order that knew them would lose pairs.

The edit lies on one side of the bigram they meet at, and what is on the other side is
the same, up to the word's end: that fixes the bigram's place more tightly than a limit of
one. The open side has halves, one of which the edit leaves alone as well. Words are
joined by a hash of the bigram with its whole side and of one half of the open side, with
the length of the shorter word, so a bigram that a third of all words have makes no
group of its own. Every pair that meets is verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, table

#: Letters, those that are lower-cased, the shortest word, and how rare a word is dropped.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST = 7, 2
#: One run in so many loses a letter; a form is so many times as common as its word.
NOISE, TIMES = 31, 10
#: Letters of a word: a to z and the 64 of Latin-1; bigrams are at most their square.
ALPHABET = 26 + 64
#: Bigrams of a word that are joined: one edit takes two of them.
RAREST = 3


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, noise: int | None = NOISE) -> DataFrame:
    """(word, n): runs of letters of at least ``shortest`` code points, A to Z lower-cased, and how often they occur.

    With ``noise``, a run whose crc32 with the document's id is divisible by it loses the
    letter the crc32 names, before it is measured. Null texts have no words; a null id
    counts as an empty one; repeated rows count each. Runs are cut before they are
    counted, and counted before they are shuffled.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"),
    )
    word = F.translate("run", UPPER, LOWER)
    if noise:
        runs = runs.select(word.alias("run"), F.crc32(F.concat("id", F.lit(":"), word).cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % noise == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))


def _code(letter: Column) -> Column:
    """The place of a letter in the alphabet of words, from 0."""
    n = F.ascii(letter)
    return F.when(n < 128, n - ord("a")).otherwise(n - 0xC0 + 26)


def _bigrams(word: Column) -> Column:
    """Codes of a word's bigrams, in the order of their places."""
    letters = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: _code(F.substring(word, i, F.lit(1))))
    return F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda a, b: a * ALPHABET + b)


def rarest(vocabulary: DataFrame) -> DataFrame:
    """vocabulary with ``_at``: the places, from 1, of each word's RAREST rarest bigrams.

    The counts go to the driver and into the plan: there are at most ALPHABET squared, 8,100.
    """
    seen = vocabulary.select(F.explode(_bigrams(F.col("word"))).alias("code")).groupBy("code").count().collect()
    counts = [0] * ALPHABET**2
    for r in seen:
        counts[r["code"]] = r["count"]
    often = F.lit(counts)
    ordered = F.array_sort(F.transform(_bigrams(F.col("word")), lambda code, at: F.struct(F.get(often, code), code.alias("code"), (at + 1).alias("at"))))
    return vocabulary.withColumn("_at", F.transform(F.slice(ordered, 1, RAREST), lambda g: g["at"]))


def _keys(words_: DataFrame, longer: bool) -> DataFrame:
    """(key, word, n): where a word meets others of its length or longer by one, or, if ``longer``, shorter by one.

    The open side is halved as the shorter word's is.
    """
    word, size, at = F.col("word"), F.char_length("word"), F.col("at")
    cut = lambda start, length: F.substring(word, start, length)
    base, keys = size - int(longer), []
    for side in ("left", "right"):
        # the bigram with all before it is whole and the rest open, or the bigram with all behind it
        whole, start, open_ = (cut(F.lit(1), at + 1), at + 2, size - at - 1) if side == "left" else (cut(at, size), F.lit(1), at - 1)
        short = open_ - int(longer)
        half = F.floor(short / 2).cast("int")
        halves = (cut(start, half), cut(start + open_ - (short - half), short - half))
        keys += [F.when(short >= 0, F.xxhash64(F.lit(f"{side}{i}"), base, whole, part)) for i, part in enumerate(halves)]
    rows = words_.select("word", "n", F.explode("_at").alias("at"))
    return rows.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"), "word", "n").where(F.col("key").isNotNull())


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of different words one edit apart, both ways round, each once.

    vocabulary is (word, n) with unlike words of at least RAREST + 1 letters of the
    alphabet. A word has at most about 180 times its length of neighbours, so their lists are bounded.
    """
    ranked = checkpoint(rarest(vocabulary))
    own, longer = _keys(ranked, longer=False), _keys(ranked, longer=True)
    a, b, c = (t.select("key", F.col("word").alias(w), F.col("n").alias(f"n_{w}")) for t, w in ((own, "a"), (own, "b"), (longer, "b")))
    one = F.levenshtein("a", "b", 1) == 1
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & one).select("a", "n_a", "b", "n_b")
    met = met.union(a.join(c, "key").where(one).select("a", "n_a", "b", "n_b"))
    both = F.explode(F.array(F.struct("a", "n_a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))))
    return met.select(both.alias("p")).select("p.*").repartition("a").dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last that is reached by following forms.

    A form is many times as common as its word, so chains end, after at most 18 steps
    where counts are 64-bit; each round doubles the steps.
    """
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = checkpoint(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    n_near counts the words one edit away. The form is the most common of them, the
    first by code points among equals, if it is at least ``times`` as common as the word;
    else form and form_n are null. Without a form, a word is its own root. An empty
    vocabulary gives an empty result.
    """
    vocabulary = checkpoint(vocabulary.select("word", "n"))
    best = near_pairs(vocabulary).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    near = checkpoint(best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    rows = vocabulary.join(near, "word", "left")
    fits = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    rows = rows.select(
        "word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")
    )
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
#: crc32 bit by bit; pairs by the words that are left when one letter is taken out; roots by recursion.
ORACLE = {
    "op12_spelling_variants": r"""
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
        ), runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
            WHERE length(run) >= 7 GROUP BY ALL
        ), bytes AS (
            SELECT run, n, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM runs
        ), hashed AS (
            SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, bits
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
        ), less AS (
            SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), pairs AS (
            SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
            UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
        ), near AS (
            SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM pairs GROUP BY word
        ), forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
            FROM words w LEFT JOIN near USING (word)
        ), steps AS (
            SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
        FROM forms f JOIN steps s USING (word) JOIN forms e ON e.word = s.at WHERE e.form IS NULL"""
}
