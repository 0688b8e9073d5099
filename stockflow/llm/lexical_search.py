"""The best documents of every query by a lexical score, term at a time.

Terms are maximal runs of ASCII letters and digits (A-Z folded) and of
characters beyond ASCII. A document's score sums, over a query's terms with
repeats, weight times impact, all in whole numbers:

    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))
    impact = (10**9 tf) div (1000 tf + 12 m),   m = 75 + (25 n N) div L

Queries are a stated set and are taken in blocks of bounded size (a block's
terms are broadcast); documents are all of the table.

1. One pass over the texts writes a row a document: its length and the terms
   of the block that it holds, with counts. N, L, the number of documents and
   the largest impact of each term come from these rows.
2. A query's terms are taken rarest first. Documents that hold one of the
   first terms get an accumulator; the k-th best partial score over all
   documents bounds the final k-th from below. As soon as the largest impacts
   of the terms not yet taken add up to less, a document without an
   accumulator cannot come among the first k, and no more are created. Rounds
   take 8, 16, 32, ... terms; queries that have stopped leave the rounds.
3. Accumulators of the terms before the stop are created again, and only they
   are updated with all other terms, exactly.

Accumulators live in the task that holds their documents, a bounded number of
cells at a time, and only k rows per query leave a task. Each pass reads the
rows of step 1 anew, so a lost executor costs its tasks and nothing else; the
k-th scores, one number a query of the block, are all that the driver holds
between rounds.

Defined results: null and term-less texts are no documents for N and L and are
never found; queries without terms, or with none that a document holds, have
no rows. Equal scores are ordered by id, a null id last. Repeated rows are
documents of their own. Rows of the query table with equal id and text are one
query; with equal ids and other texts, each is ranked on its own. Texts of any
length are taken whole. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockflow.llm.common import cut, python_path, settled

NO_ID = (1 << 63) - 1
#: Pairs of a query and a distinct term of it in a block, about; cells and
#: matches that a task handles at a time; terms of the first round.
BLOCK_PAIRS, CELLS, MATCHES, FIRST_TERMS = 400_000, 1 << 21, 1 << 20, 8

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _bytes(scalar) -> bytes:
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, item_text, terms, times``: distinct terms of every query
    that has one, with their numbers of occurrences."""
    import pyarrow as pa

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("item_text")).where("item_text IS NOT NULL").distinct()

    def run(batches):
        from collections import Counter

        for batch in batches:
            counts = [Counter(terms_of(_bytes(t))) for t in batch.column(1)]
            lists = [pa.array([list(c.keys()) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["item_id", "item_text", "terms", "times"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(settled(run), f"item_id {kind}, item_text string, terms array<binary>, times array<long>").where("size(terms) > 0")


def postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``did, n, t, f``: documents with terms, their lengths, and the numbers
    and counts of the broadcast vocabulary's terms."""
    python_path(docs.sparkSession)

    def run(batches):
        from itertools import repeat

        import pyarrow as pa

        number = {w: i for i, w in enumerate(vocabulary.value)}.get
        for batch in batches:
            did, n, t, f = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(_bytes(text))
                if words:
                    known, times = np.unique(np.fromiter(map(number, words, repeat(-1)), np.int32, len(words)), return_counts=True)
                    first = int(known[0] < 0)
                    did.append(d)
                    n.append(len(words))
                    t.append(known[first:])
                    f.append(times[first:])
            ends = pa.array(np.cumsum([0, *map(len, t)]), pa.int32())
            flat = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], kind))
            yield pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(n, pa.int64()), flat(t, pa.int32()), flat(f, pa.int64())], ["did", "n", "t", "f"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).alias("text"))
    return rows.mapInArrow(settled(run), "did long, n long, t array<int>, f array<long>")


@dataclass(frozen=True)
class Terms:
    """Pairs of a query and a term, grouped by term: those of term t lie from
    ``start[t]`` to ``start[t + 1]``."""
    start: np.ndarray
    item: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, term, item, weight, n_terms: int) -> Terms:
        order = np.argsort(term, kind="stable")
        return cls(np.searchsorted(term[order], np.arange(n_terms + 1)), item[order], weight[order])

    def matches(self, row, term):
        """Rows, queries, weights and places of the postings (row, term) that meet a query's term."""
        first, n = self.start[term], self.start[term + 1] - self.start[term]
        place = np.repeat(np.arange(len(term)), n)
        pair = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return row[place], self.item[pair], self.weight[pair], place


@dataclass
class Best:
    """The k best documents of each query so far, of a task."""
    k: int
    least: np.ndarray  # score to reach, by query

    def __post_init__(self):
        self.item, self.score, self.did = (np.empty(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, did: np.ndarray) -> None:
        """``scores``: documents by queries."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score, did = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.did, did[row])))
        order = np.lexsort((did, -score, item))
        item, score, did = item[order], score[order], did[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        kept = place < self.k
        self.item, self.score, self.did = item[kept], score[kept], did[kept]


def _parts(did, n, ends, t, f, fan, n_items: int):
    """Slices of documents, so that neither cells nor matches are many."""
    most, load = max(1, CELLS // max(1, n_items)), np.concatenate([[0], np.cumsum(fan[t])])[ends]
    lo = 0
    while lo < len(did):
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(load, load[lo] + MATCHES, "right")) - 1), len(did))
        a, b = ends[lo], ends[hi]
        yield did[lo:hi], n[lo:hi], np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1])), t[a:b], f[a:b]
        lo = hi


def accumulate(index: DataFrame, n_items: int, k: int, created, updated, least, total: int, length: int) -> DataFrame:
    """``item, score, did``: each task's k best of every query, by the terms
    ``created`` and, for documents that those have given an accumulator, also
    the terms ``updated`` (both broadcast); scores under ``least`` are left out."""

    def run(batches):
        import pyarrow as pa

        first, rest, best = created.value, updated.value, Best(k, np.maximum(least.value, 1))
        fan = np.diff(first.start) + np.diff(rest.start)
        for batch in batches:
            did, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2), batch.column(3)
            ends = lists[0].offsets.to_numpy()
            a, b = ends[0], ends[-1]
            t, f = (x.values.to_numpy()[a:b] for x in lists)
            for d, length_, row, term, times in _parts(did, n, ends - a, t, f, fan, n_items):
                m = 75 + (25 * length_ * total) // length
                impact = (10**9 * times) // (1000 * times + 12 * m[row])
                scores = np.zeros(len(d) * n_items, np.int64)
                r, item, weight, place = first.matches(row, term)
                np.add.at(scores, r * n_items + item, weight * impact[place])
                has = scores > 0
                if len(rest.item) and has.any():
                    r, item, weight, place = rest.matches(row, term)
                    cell = r * n_items + item
                    kept = has[cell]
                    np.add.at(scores, cell[kept], (weight * impact[place])[kept])
                best.add(scores.reshape(len(d), n_items), d)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.score), pa.array(best.did)], ["item", "score", "did"])

    return index.mapInArrow(settled(run), "item int, score long, did long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "did"))).where(F.col("rank") <= k)


def _block(docs: DataFrame, queries: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """``item, rank, did, score`` for the queries (terms, times) of a block, by number."""
    spark, n_items = docs.sparkSession, len(queries)
    share = spark.sparkContext.broadcast
    vocabulary = sorted({t for terms, _ in queries for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    index = cut(postings(docs, share(vocabulary), id_col, text_col), "search-index")
    total, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # Documents and largest impact of every term; its size is the vocabulary's.
    m = f"(75 + (25 * n * {total}L) div {max(length, 1)}L)"
    each = index.select("n", F.explode(F.arrays_zip("t", "f")).alias("p")).select("n", "p.t", "p.f")
    stats = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max(F.expr(f"(1000000000L * f) div (1000 * f + 12 * {m})")).alias("top")).toArrow()
    df, top = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    at = stats["t"].to_numpy()
    df[at], top[at] = stats["df"].to_numpy(), stats["top"].to_numpy()

    item = np.repeat(np.arange(n_items), [len(terms) for terms, _ in queries])
    term = np.array([number[t] for terms, _ in queries for t in terms], np.int64)
    times = np.array([x for _, counts in queries for x in counts], np.int64)
    held = df[term] > 0
    item, term, times = item[held], term[held], times[held]
    weight = times * np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df[term].tolist()], np.int64)
    order = np.lexsort((term, df[term], item))
    item, term, weight = item[order], term[order], weight[order]
    size = np.bincount(item, minlength=n_items)
    begin = np.cumsum(size) - size
    rank = np.arange(len(item)) - begin[item]
    # What the terms from a place on can add at most, by query; none after the last.
    bound = np.zeros(len(item) + 1, np.int64)
    most = weight * top[term]
    bound[:-1] = np.cumsum(most[::-1])[::-1]
    ends = np.append(begin, len(item))[1:]
    left = lambda q, place: bound[begin[q] + place] - bound[ends[q]]

    def by_term(which) -> Terms:
        return Terms.of(term[which], item[which], weight[which], len(vocabulary))

    none = by_term(np.zeros(len(item), bool))
    stop, kth, taken, live = size.copy(), np.zeros(n_items, np.int64), FIRST_TERMS, size > FIRST_TERMS
    while live.any():
        rows = accumulate(index, n_items, k, share(by_term(live[item] & (rank < taken))), share(none), share(kth), total, length)
        found = _ranked(rows, k).where(F.col("rank") == k).select("item", "score").toArrow()
        kth[found["item"].to_numpy()] = found["score"].to_numpy()
        for q in np.flatnonzero(live):
            # Fewest terms whose documents need an accumulator, by the score known.
            need = next((p for p in range(min(taken, size[q]) + 1) if left(q, p) < kth[q]), None)
            if need is not None:
                stop[q], live[q] = need, False
        taken *= 2
        live &= size > taken
    before = rank < stop[item]
    rows = accumulate(index, n_items, k, share(by_term(before)), share(by_term(~before)), share(kth), total, length)
    return _ranked(rows, k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest
    scores above 0 of every query."""
    spark = docs.sparkSession
    python_path(spark)
    queries = cut(query_terms(items, item_col, item_text_col), "search-queries")
    pairs = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-pairs // block_pairs)
    kind = queries.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).select("item_id", "terms", "times").toArrow()
        if not mine.num_rows:
            continue
        terms, times = mine["terms"].to_pylist(), mine["times"].to_pylist()
        best = _block(docs, list(zip(terms, times, strict=True)), k, id_col, text_col)
        ids = spark.createDataFrame(list(enumerate(mine["item_id"].to_pylist())), f"item int, item_id {kind}")
        rows = best.join(ids, "item").select("item_id", "rank", F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "score")
        out = rows if out is None else out.unionAll(rows)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
