"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the terms (lower-cased words) whose document frequency,
counted over all documents, lies in a band of normalised inverse document
frequency ``log(N / df) / log(N)``. A text is represented by its distinct
lexicon terms in sorted order; each of several randomised subsets of the
lexicon gives one hash of the terms that remain, and the list of hashes is
the fingerprint: first the whole lexicon, then ``SERIES`` independent series
of subsets, each halving the lexicon from level to level, so that texts of any length have
subsets in which few of their terms remain: these survive partial edits.

The likeness of two fingerprints is the share of equal hashes among the
subsets that are not empty in both; two fingerprints without any are alike
if they are equal.

The lexicon reaches the tasks as a bitmap of fixed size (a scalar subquery);
a term that shares its bit with a lexicon term is taken for one, alike in
every text. Terms are compared by 64-bit hashes.

Defined results: null text is empty; a text without lexicon terms is
represented by all its terms, one without words by empty subsets; equal
texts have equal fingerprints; an empty table gives no rows; extra columns
are ignored. Whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockflow.llm.common import words_of

#: Bits of the lexicon bitmap, independent series of subsets, and halvings of each.
LEXICON_BITS, SERIES, LEVELS = 21, 6, 10
#: Levels made in one projection.
STEP = 4
#: Documents of a range of ids, and ranges at most (a bound on parallelism, not on rows).
RANGE_DOCS, MOST_RANGES = 4000, 20000


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the lower-cased words."""
    return F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(F.lower(w))))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, df`` of every term over all documents."""
    return docs.select(F.explode(term_hashes(F.col(text_col))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def lexicon_bitmap(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = (0.2, 0.6)) -> DataFrame:
    """One row ``bits``: 2**LEXICON_BITS bits as an array of longs."""
    n = max(docs.count(), 2)
    least, most = n ** (1 - band[1]), n ** (1 - band[0])
    place = F.col("h").bitwiseAND(F.lit((1 << LEXICON_BITS) - 1))
    used = document_frequencies(docs, text_col).where((F.col("df") >= least) & (F.col("df") <= most))
    used = used.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    every = docs.sparkSession.range(1 << (LEXICON_BITS - 6)).join(used, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    return every.agg(F.transform(rows, lambda r: r["v"]).alias("bits"))


def fingerprints(df: DataFrame, texts: dict[str, Column], bits: Column, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` and, for each name, the fingerprint of its text
    (array of longs, null for an empty subset). The texts are left behind in
    the first projection; later ones narrow the term arrays level by level."""
    low = (1 << LEXICON_BITS) - 1
    df = df.select(*keep, bits.alias("_bits"), *[term_hashes(c).alias(f"_{n}") for n, c in texts.items()])
    kept = df.columns[:len(keep)]

    def known(n: str) -> Column:
        return F.filter(f"_{n}", lambda h: F.getbit(
            F.get("_bits", F.shiftright(h.bitwiseAND(F.lit(low)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1)

    df = df.select(*kept, *[f"_{n}" for n in texts], *[known(n).alias(f"_{n}_known") for n in texts])
    df = df.select(*kept, *[F.sort_array(F.when(F.size(f"_{n}_known") > 0, F.col(f"_{n}_known")).otherwise(F.col(f"_{n}"))).alias(f"_{n}")
                            for n in texts])

    def narrowed(terms: str, series: int, since: int, level: int) -> Column:
        # Series s halves by one bit after the other of its own 10-bit field of the term hash.
        mask = sum(1 << (LEVELS * series + i) for i in range(since, level + 1))
        return F.filter(terms, lambda h: h.bitwiseAND(F.lit(mask)) == 0)

    def subset(c: str) -> Column:
        return F.when(F.size(c) > 0, F.xxhash64(F.col(c)).bitwiseAND(F.lit((1 << 32) - 1)))

    prior = {(n, s): f"_{n}" for n in texts for s in range(SERIES)}
    df = df.select(*kept, *[f"_{n}" for n in texts], *[subset(f"_{n}").alias(f"_{n}_h") for n in texts])
    done = [f"_{n}_h" for n in texts]
    for since in range(0, LEVELS, STEP):
        levels = range(since, min(since + STEP, LEVELS))
        arrays = {(n, s, level): f"_{n}_{s}_{level}" for n in texts for s in range(SERIES) for level in levels}
        df = df.select(*kept, *done, *[narrowed(prior[n, s], s, since, level).alias(c) for (n, s, level), c in arrays.items()])
        prior = {(n, s): arrays[n, s, levels[-1]] for n in texts for s in range(SERIES)}
        carry = sorted(set(prior.values())) if levels[-1] < LEVELS - 1 else []
        df = df.select(*kept, *done, *carry, *[subset(c).alias(f"{c}h") for c in arrays.values()])
        done += [f"{c}h" for c in arrays.values()]
    return df.select(*kept, *[F.array(F.col(f"_{n}_h"), *[F.col(f"_{n}_{s}_{level}h") for s in range(SERIES) for level in range(LEVELS)]).alias(n)
                              for n in texts])


def as_text(fingerprint: Column) -> Column:
    """Eight hex digits per subset, '-' for an empty one."""
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 8, "0")), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets not empty in both."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda z: z["a"].isNotNull() | z["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda z: F.coalesce(z["a"] == z["b"], F.lit(False))))
    return F.when(used > 0, same / used).otherwise(F.lit(1.0))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, pid, no, text, next_text`` in descending ids, the last followed by the first.

    Ids are parted into ranges by quantiles; each range is one window
    partition, and only the head of every range is handed to the one before.
    ``k`` ascends as ids descend (null last); equal ids go by text hash.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    F.when(F.col(id_col).isNull(), F.lit((1 << 63) - 1)).otherwise(F.bitwise_not(F.col(id_col).cast("long"))).alias("k"))
    ranges = min(MOST_RANGES, max(8, d.count() // RANGE_DOCS))
    # Any splits are right; quantiles make the ranges nearly even.
    found = d.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("s")).first()["s"]
    splits = F.lit(sorted(set(found or [0]))).cast("array<bigint>")
    d = d.withColumns({"pid": F.size(F.filter(splits, lambda s: s <= F.col("k"))), "th": F.xxhash64("text")})
    # The first key of each range: at most MOST_RANGES rows of two numbers are broadcast.
    least = d.groupBy("pid").agg(F.min("k").alias("k"))
    heads = d.join(F.broadcast(least), ["pid", "k"]).groupBy("pid").agg(F.min_by("text", "th").alias("text"))
    along = W.orderBy("pid")  # one row per range
    first = F.first("text").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("pid", F.coalesce(F.lead("text").over(along), first).alias("head"))
    along = W.partitionBy("pid").orderBy("k", "th")
    d = d.withColumns({"lead": F.lead("text").over(along), "no": F.row_number().over(along)})
    # ``no`` keeps the order of equal rows for later windows.
    return d.join(heads, "pid").withColumn("is_last", F.col("lead").isNull()).withColumn(
        "next_text", F.coalesce("lead", "head")).drop("lead")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and
    the likeness to the next document's."""
    bits = lexicon_bitmap(docs, text_col).scalar()
    d = with_next(docs, id_col, text_col)
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m))
    d = d.withColumns({"n_chars": n.cast("long"), "edited": edited})
    # Only the last of a range takes the head's own fingerprint.
    texts = {"fp": F.col("text"), "efp": F.col("edited"), "hfp": F.when(F.col("is_last"), F.col("head"))}
    keep = [F.col(c) for c in ("doc_id", "pid", "no", "n_chars", "is_last")]
    d = fingerprints(d, texts, bits, [*keep, F.sha2("edited", 256).alias("edited_sha256")])
    following = F.lead("fp").over(W.partitionBy("pid").orderBy("no"))
    d = d.withColumn("nfp", F.when(F.col("is_last"), F.col("hfp")).otherwise(following))
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                    as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("nfp")).alias("near_next"))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every document."""
    bits = lexicon_bitmap(docs, text_col).scalar()
    found = fingerprints(docs, {"fp": F.col(text_col)}, bits, [F.col(id_col).alias("doc_id")])
    return found.select("doc_id", as_text(F.col("fp")).alias("fingerprint"))
