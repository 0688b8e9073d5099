"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after the other; the model of a category
gets the probabilities of all earlier ones as features. While training,
these are out-of-fold predictions (each row is predicted by a model that has
not seen it), so later models learn from errors as they will meet them.

Features are the presence of words and of word beginnings (4, 5 and 6
bytes), hashed to ``2**FEATURE_BITS`` places; words are runs of letters and
digits, A-Z folded. Models are logistic regressions with an L2 penalty.

Training uses a sample of at most ``sample_rows`` labelled documents (a
parameter), chosen by hash of the id, and runs as one Spark task per fold and
category. Scoring reads every whole text once; its only broadcast is the
weights, whose number is fixed by FEATURE_BITS.

Defined results: null text is empty; null labels are left out of a
category's training; a label repeated for one id counts as its largest; a
repeated id is trained on once, with its smallest text; a category without
both classes gets its base rate as probability (0 without rows); an empty
table gives no rows; extra columns are ignored or, with ``keep``, carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import cut, python_path, settled

FEATURE_BITS, PREFIXES = 18, (4, 5, 6)
#: Least documents of the sample that hold a feature, penalty and steps of a fit.
LEAST_DOCS, PENALTY, STEPS = 3, 0.5, 80


@dataclass(frozen=True)
class Category:
    """``label`` is a column of the labels table, ``positive`` the value that stands for the category."""
    name: str
    label: str
    positive: int


#: Categories that the labels table offers: junk and toxic text.
CATEGORIES = (Category("low_quality", "quality", 0), Category("toxic", "toxic", 1))


@dataclass(frozen=True)
class Chain:
    """Fitted models in order: weights of features and of earlier probabilities."""
    names: tuple[str, ...]
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    bias: list[float]
    thresholds: list[float]
    quality: list[dict] = field(default_factory=list)


def features(data: np.ndarray) -> np.ndarray:
    """Sorted distinct places of a text's features, from its UTF-8 bytes."""
    from stockflow.llm import shingling as S

    found = []
    for piece in S.pieces(data, _BREAK):
        edge = np.diff(np.concatenate([[True], _BREAK[piece], [True]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = S._powers(len(piece) + 1, S._BYTE_BASE)
        sums = S._sums(S._FOLDED[piece], up)
        found.append(S.mix((sums[ends] - sums[starts]) * down[starts]))
        for n in PREFIXES:
            at = starts[ends - starts > n]
            found.append(S.mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)))
    if not found:
        return np.empty(0, np.int32)
    return np.unique((np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))


_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, cols: np.ndarray, n: int, dim: int, dense: np.ndarray, y: np.ndarray):
    """Logistic regression on binary features (row, col pairs) and dense
    columns, by L-BFGS. Returns (weights, dense weights, bias)."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return np.zeros(dim), np.zeros(dense.shape[1]), _logit(rate)
    k = dense.shape[1]

    def loss(v):
        w, d, b = v[:dim], v[dim:dim + k], v[-1]
        z = np.bincount(rows, w[cols], n) + dense @ d + b
        r = sigmoid(z) - y
        grad = np.concatenate([np.bincount(cols, r[rows], dim) + PENALTY * w, dense.T @ r + PENALTY * d, [r.sum()]])
        return np.logaddexp(0, z).sum() - y @ z + PENALTY / 2 * (w @ w + d @ d), grad

    v = np.zeros(dim + k + 1)
    f, g = loss(v)
    steps: list[tuple] = []
    for _ in range(STEPS):
        q, alphas = g.copy(), []
        for s, t, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * t
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.abs(g).sum(), 1e-12)
        for (s, t, rho), a in zip(steps, reversed(alphas), strict=True):
            q += (a - rho * (t @ q)) * s
        size, slope = 1.0, g @ q
        while size > 1e-8:
            new_f, new_g = loss(v - size * q)
            if new_f <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, t = -size * q, new_g - g
        if s @ t > 1e-12:
            steps = [*steps[-7:], (s, t, 1 / (s @ t))]
        v, done = v - size * q, f - new_f < 1e-6 * max(1, abs(f))
        f, g = new_f, new_g
        if done:
            break
    return v[:dim], v[dim:dim + k], float(v[-1])


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 of out-of-fold predictions, halfway to the next lower one."""
    if not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0  # ties are cut together
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0.0)) / 2)


def training_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[Category], sample_rows: int, folds: int,
                    id_col: str, text_col: str) -> DataFrame:
    """``id, fold, y0.., feats`` of at most ``sample_rows`` labelled documents."""
    key = F.col(id_col).cast("long")
    hits = [F.max((F.col(c.label) == c.positive).cast("double")).alias(f"y{i}") for i, c in enumerate(categories)]
    chosen = labels.where(key.isNotNull()).groupBy(key.alias("id")).agg(*hits)
    chosen = chosen.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows)
    texts = docs.select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The chosen ids are bounded by the parameter, hence broadcast.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.first("h").alias("h"), *[F.first(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    keep = ["id", *[f"y{i}" for i in range(len(categories))]]

    def run(batches):
        import pyarrow as pa

        from stockflow.llm import shingling as S

        for batch in batches:
            feats = [features(S.utf8(t)) for t in batch.column(len(keep) + 1)]
            ends = np.cumsum([0, *map(len, feats)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*feats, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], lists], [*keep, "fold", "feats"])

    ys = ", ".join(f"{c} double" for c in keep[1:])
    rows = rows.select(*keep, F.pmod(F.shiftright("h", 20), F.lit(folds)).cast("int").alias("fold"), "text")
    return rows.mapInArrow(settled(run), f"id long, {ys}, fold int, feats array<int>")


def fold_fitter(step: int, dim: int):
    """The task of one (category, fold): fit on the other folds, predict this
    one; fold -1 leaves nothing out and returns the model. Rows are
    ``kind, i, v``: 0 weight, 1 weight of an earlier category, 2 bias, 3 prediction for an id."""
    earlier = [f"p{i}" for i in range(step)]

    def fit_fold(key, pdf):
        import pandas as pd

        left_out = key[0]
        pdf = pdf.sort_values("id")
        known = pdf[f"y{step}"].notna()
        used = known & (pdf["fold"] != left_out)
        counts = np.zeros(dim, np.int64)
        for f in pdf.loc[used, "feats"]:
            counts[f] += 1
        kept = counts >= LEAST_DOCS

        def pairs(part):
            lists = [f[kept[f]] for f in part["feats"]]
            cols = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)
            return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), cols

        part = pdf[used]
        rows, cols = pairs(part)
        w, d, b = fit(rows, cols, len(part), dim, part[earlier].to_numpy(float).reshape(len(part), step), part[f"y{step}"].to_numpy(float))
        if left_out < 0:
            at = np.flatnonzero(w)
            kinds = [0] * len(at) + [1] * step + [2]
            return pd.DataFrame({"kind": kinds, "i": [*at, *range(step), 0], "v": [*w[at], *d, b]})
        rest = pdf[pdf["fold"] == left_out]
        rows, cols = pairs(rest)
        z = np.bincount(rows, w[cols], len(rest)) + rest[earlier].to_numpy(float).reshape(len(rest), step) @ d + b
        return pd.DataFrame({"kind": 3, "i": rest["id"].to_numpy(), "v": sigmoid(z)})

    return fit_fold


def train(docs: DataFrame, labels: DataFrame, *, categories: Sequence[Category] = CATEGORIES, sample_rows: int = 5000, folds: int = 5,
          id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain. Every (category, fold) is one task over the bounded sample."""
    python_path(docs.sparkSession)
    sample = cut(training_sample(docs, labels, categories, sample_rows, folds, id_col, text_col), "toxicity-sample")
    dim = 1 << FEATURE_BITS
    chain = Chain(tuple(c.name for c in categories), [], [], [], [], [])
    for step, category in enumerate(categories):
        # Fold -1 leaves nothing out: the model that is kept.
        dealt = sample.withColumn("left_out", F.explode(F.array(*[F.lit(k) for k in range(-1, folds)])))
        fitted = cut(dealt.groupBy("left_out").applyInPandas(fold_fitter(step, dim), "kind int, i long, v double"), "toxicity-fit")
        w, d = np.zeros(dim), np.zeros(step)
        bias = _logit(0.0)
        for r in fitted.where("kind < 3").collect():  # at most one row per feature place
            if r.kind == 0:
                w[r.i] = r.v
            elif r.kind == 1:
                d[r.i] = r.v
            else:
                bias = r.v
        out_of_fold = fitted.where("kind = 3").select(F.col("i").alias("id"), F.col("v").alias(f"p{step}"))
        sample = cut(sample.join(out_of_fold, "id"), "toxicity-sample")
        held = sample.where(F.col(f"y{step}").isNotNull()).select(f"p{step}", f"y{step}").toPandas()  # bounded by sample_rows
        p, y = held[f"p{step}"].to_numpy(float), held[f"y{step}"].to_numpy(float)
        threshold = best_threshold(p, y)
        hit = p >= threshold
        chain.weights.append(w)
        chain.earlier.append(d)
        chain.bias.append(bias)
        chain.thresholds.append(threshold)
        chain.quality.append({"category": category.name, "rows": len(y), "positive": int(y.sum()), "threshold": threshold,
                              "precision": float(y[hit].mean()) if hit.any() else None, "recall": float(hit[y == 1].mean()) if y.sum() else None})
    return chain


def score(docs: DataFrame, chain: Chain, *, keep: list[str], text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``keep`` columns and the probability ``p_<category>`` (or with another
    ``prefix``) of every whole text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    python_path(spark)
    names, n = [f"{prefix}{x}" for x in chain.names], len(keep)
    if {x.lower() for x in names} & {c.lower() for c in keep}:
        raise ValueError("a kept column is named like a probability")
    model = spark.sparkContext.broadcast((chain.weights, chain.earlier, chain.bias))

    def run(batches):
        import pyarrow as pa

        from stockflow.llm import shingling as S

        weights, earlier, bias = model.value
        for batch in batches:
            out = np.empty((len(weights), batch.num_rows))
            for i, text in enumerate(batch.column(n)):
                f = features(S.utf8(text))
                for c, (w, d, b) in enumerate(zip(weights, earlier, bias, strict=True)):
                    out[c, i] = sigmoid(w[f].sum() + d @ out[:c, i] + b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(row) for row in out)], [*keep, *names])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(x, DoubleType()) for x in names)])
    return docs.select(*[docs[c] for c in keep], docs[text_col].alias("_text")).mapInArrow(settled(run), schema)


def is_in(chain: Chain, name: str, prefix: str = "p_") -> Column:
    """Whether a scored document belongs to the category."""
    return F.col(f"{prefix}{name}") >= chain.thresholds[chain.names.index(name)]
