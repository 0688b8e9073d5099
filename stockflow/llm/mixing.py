"""Mixing sources to target weights by entropy balancing.

Every source gets a token target. The mix closest to "each document once"
(in relative entropy) that meets the targets has exponentially tilted rates
``min(cap, exp(lambda_s * size / scale_s))``; the multipliers ``lambda_s``
solve a convex dual, found here by safeguarded Newton steps. All documents
of one source and size share a rate, so the Newton sums run over the exact
histogram (source, size, count): one small aggregate per step, and a source
holding a third of all rows costs no more than its number of distinct sizes.

Rates become whole copies by systematic rounding along the sizes of a
source: the running sum of rates is rounded, so the words taken differ from
the balanced ones by at most about one document of the source. Within one
(source, size) bin the copies go to documents in a fixed pseudo-random order
of 256 salts, so that no bin has to be sorted in one task.

Defined results: null text has size 0; null source is a source of its own,
ordered last; repeated rows are documents like any other; documents of
size 0 keep rate 1, also where their source is at its cap; texts of any
length count whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockflow.llm.common import cut, n_words_of, null_key

SALTS = 256
#: Rounding offsets tried per source.
OFFSETS = 32


def source_targets(hist: DataFrame, weight_cycle=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source_size, target and the statistics Newton needs.

    Targets share ``share`` times all sizes by weight; none exceeds ``cap``
    times its source, and the excess goes to the others by weight. That is
    the water level ``theta`` with ``target = min(cap * S, w * theta)``: with
    sources ordered by ``cap * S / w``, theta is the largest of the levels
    left after capping a prefix. The windows see one row per source.
    """
    src = hist.groupBy("skey").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    cycle = F.array(*[F.lit(float(w)) for w in weight_cycle])
    # Binary string order is code point order; the null key is put last.
    rank = F.row_number().over(W.orderBy((F.col("skey") == "").asc(), F.col("skey").asc()))
    src = src.withColumn("w", F.element_at(cycle, ((rank - 1) % len(weight_cycle) + 1).cast("int")))
    src = src.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = W.partitionBy()
    order = W.orderBy((F.col("most") / F.col("w")).asc(), F.col("skey").asc())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    src = src.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    src = src.withColumn("level", level).withColumn("theta", F.max("level").over(whole))
    return src.withColumn("target", F.greatest(F.lit(0.0), F.least("most", F.col("w") * F.col("theta")))).select(
        "skey", "source_size", "docs", "least", "target")


def balance(hist: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-9, max_steps: int = 80) -> DataFrame:
    """Solve the dual per source; returns (skey, source_size, target, scale, lam, fixed).

    ``fixed`` holds the rate where no multiplier is needed (target 0, target
    at the cap, empty source). Sums are decimals, hence independent of the
    order of rows: reruns give the same multipliers bit for bit.
    """
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    s = targets.withColumn("scale", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    s = s.withColumn("fixed", F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0))
                     .when(F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)), F.lit(float(cap))))
    x_min = F.col("least") / F.col("scale")
    s = s.withColumns({
        "lam": F.lit(0.0),
        "lo": F.when(F.col("fixed").isNull() & (ratio < 1), F.log(ratio) / x_min).otherwise(F.lit(0.0)),
        "hi": F.when(F.col("fixed").isNull() & (ratio > 1), F.log(F.lit(float(cap))) / x_min).otherwise(F.lit(0.0)),
        "settled": F.col("fixed").isNotNull(),
    })
    keep = ["skey", "source_size", "target", "scale", "fixed", "lam", "lo", "hi", "settled"]
    state = cut(s.select(keep), "mix-state")
    for _ in range(max_steps):
        if state.where(~F.col("settled")).isEmpty():
            break
        open_ = hist.where(F.col("size") > 0).join(state.where(~F.col("settled")), "skey")
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.col("lam") * x)
        words = F.col("n") * F.col("size")
        sums = open_.groupBy("skey").agg(
            F.sum((words * F.least(F.lit(float(cap)), raw)).cast("decimal(32,6)")).cast("double").alias("got"),
            F.sum(F.when(raw < cap, words * x * raw).otherwise(0.0).cast("decimal(32,6)")).cast("double").alias("slope"))
        gap = F.col("got") - F.col("target")
        j = state.join(sums, "skey", "left")
        j = j.withColumns({
            "lo": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")),
            "hi": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")),
            "newton": F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope")),
            "settled": F.col("settled") | (F.abs(gap) <= F.col("target") * tolerance + 1e-5),
        })
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        step = F.when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        j = j.withColumn("settled", F.col("settled") | (~F.col("settled") & (step == F.col("lam"))))
        state = cut(j.withColumn("lam", F.when(F.col("settled"), F.col("lam")).otherwise(step)).select(keep), "mix-state")
    return state.select("skey", "source_size", "target", "scale", "fixed", "lam")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weight_cycle=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per document: its size, rate, whole copies and words taken.

    Returns ``doc_id, source, text_hash, size, source_size, target, rate,
    copies, taken``; ``copies`` never exceeds ``cap``.
    """
    text = F.col(text_col)
    sized = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), null_key(F.col(source_col)).alias("skey"),
        F.xxhash64(text).alias("text_hash"), n_words_of(text).alias("size")), "mix-sizes")
    sized = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    sized = sized.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    hist = cut(sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    state = balance(hist, source_targets(hist, weight_cycle, share, cap), cap)

    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.coalesce(F.col("fixed"), F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))))
    bins = hist.join(state, "skey").withColumn("rate", rate)
    along = W.partitionBy("skey").orderBy("size")
    upto = F.round(F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(W.unboundedPreceding, 0)), 6)
    bins = bins.withColumn("upto", upto)
    bins = cut(bins.withColumn("since", F.coalesce(F.lag("upto").over(along), F.lit(0.0))), "mix-bins")

    def given(offset):
        return F.least(F.floor(F.col("upto") + offset) - F.floor(F.col("since") + offset), F.floor(F.col("n") * F.lit(float(cap))))

    # Of a grid of rounding offsets each source takes the one that comes nearest to its target.
    grid = [(i + 0.5) / OFFSETS for i in range(OFFSETS)]
    tried = bins.groupBy("skey").agg(F.array_min(F.array(*[F.struct(
        F.abs(F.sum(F.col("size") * given(F.lit(u))) - F.max("target")).alias("gap"), F.lit(u).alias("offset"))
        for u in grid])).alias("best"))
    bins = bins.join(tried.select("skey", F.col("best.offset").alias("offset")), "skey").withColumn("given", given(F.col("offset")))
    bins = bins.select("skey", "size", "n", "source_size", "target", "rate",
                       F.floor(F.col("given") / F.col("n")).alias("base"), (F.col("given") % F.col("n")).alias("extra"))

    # Copies of a bin go to its documents in (salt, hash) order.
    keys = ["skey", "size", "salt"]
    chunks = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    prior = W.partitionBy("skey", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("prior", F.coalesce(F.sum("m").over(prior), F.lit(0))).join(bins, ["skey", "size"])
    place = F.row_number().over(W.partitionBy(*keys).orderBy("h", "doc_id")) - 1
    got = sized.withColumn("place", place).join(chunks, keys)
    copies = F.col("base") + F.when(F.col("prior") + F.col("place") < F.col("extra"), 1).otherwise(0)
    return got.select("doc_id", "source", "text_hash", F.col("size"), F.col("source_size"), F.col("target"), "rate",
                      copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mix: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as ``mix`` says, columns unchanged.

    Rows equal in id, source and text are told apart by a row number, so a
    repeated row gets the copies of one repetition each.
    """
    key = ["_k_id", "_k_src", "_k_text"]
    m = mix.select(F.col("doc_id").alias("_k_id"), null_key(F.col("source")).alias("_k_src"),
                   F.col("text_hash").alias("_k_text"), "copies")
    m = m.select(null_key(F.col("_k_id")).alias("_k_id"), "_k_src", "_k_text", F.col("copies").alias("_k_copies"))
    m = m.withColumn("_k_no", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_k_copies"))))
    d = docs.withColumns({"_k_id": null_key(F.col(id_col)), "_k_src": null_key(F.col(source_col)), "_k_text": F.xxhash64(text_col)})
    d = d.withColumn("_k_no", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1))))
    out = d.join(m.where(F.col("_k_copies") > 0), [*key, "_k_no"])
    out = out.withColumn("_k_copy", F.explode(F.sequence(F.lit(1), F.col("_k_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
