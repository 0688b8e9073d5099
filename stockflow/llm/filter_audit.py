"""How filters overlap: what each removes at every place of every order.

A document's failure mask holds a bit for each filter that it fails. Masks
are counted per part (all documents, labelled good ones, toxic ones), which
leaves at most 2**n rows a part; all orders of the filters are then read off
one decision diagram per part:

* Levels are filters in their current order; a node leads to a node for
  "passes" and one for "fails", equal nodes are shared and every node knows
  the counts below it. The ends are the counts of a mask.
* An adjacent level swap turns an order into the next: only the two levels
  are rebuilt, and the counts of all other nodes stay.
* In an order, the path on which everything passes meets a node a step: its
  failing branch is what the step removes, its passing branch what it keeps.

Five filters are given (``FILTERS``): too few words, too few distinct words,
too many capitals, a character of markup, and a text that a smaller id has
already. Only the last looks at other rows; equal texts have equal digests
(SHA-256) and equal masks otherwise, so texts are grouped, never joined with
each other, and groups of copies are added up before they meet.

Defined results: a null text is empty, a null part the empty string. An empty
text fails the first filter only (and the last if it repeats). A null id is
larger than all others, has no label and repeats only texts of rows with an
id. Rows that repeat text and id count each, and none is the other's repeat.
Several labels of one id count as good (toxic) if one says so. Texts of any
length are taken whole. An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import python_path, settled

NO_ID = (1 << 63) - 1
#: Rows without an id are spread over so many keys.
SALTS = 4096

#: Conditions on a row of :func:`measures` under which a text fails; ``REPEAT`` needs the other rows.
FILTERS: dict[str, str] = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "n_marks > 0",
}
REPEAT = "E"
LETTERS = "".join(FILTERS) + REPEAT
STEP = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``did, salt, part, digest, n_words, n_distinct, n_upper, n_chars,
    n_marks`` per row; ``salt`` spreads rows without an id."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        upper, marks = bytes(range(65, 91)), b"#$%&*|"
        not_upper, not_marks = (bytes(set(range(256)) - set(x)) for x in (upper, marks))
        seen = 0
        for batch in batches:
            digests, rows = [], []
            for text in batch.column(1):
                t = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = t.split()
                # Code points are the bytes that do not go on with one.
                chars = len(t) - int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) == 0x80))
                digests.append(hashlib.sha256(t).digest())
                rows.append((len(words), len(set(words)), len(t.translate(None, not_upper)), chars, len(t.translate(None, not_marks))))
            did = batch.column(0).to_numpy()
            salt = np.where(did == NO_ID, (seen + np.arange(len(did))) % SALTS + 1, 0)
            seen += len(did)
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(salt.astype(np.int32)), batch.column(2), pa.array(digests, pa.binary()), *(pa.array(c.copy()) for c in columns)],
                ["did", "salt", "part", "digest", "n_words", "n_distinct", "n_upper", "n_chars", "n_marks"])

    python_path(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(settled(run), "did long, salt int, part string, digest binary, n_words long, n_distinct long, n_upper long, n_chars long, n_marks long")


def failure_masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good and toxic ones by part
    and mask; bit i of the mask is the i-th of ``LETTERS``."""
    bits = sum((F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(FILTERS.values())), F.lit(0))
    rows = measures(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    rows = rows.groupBy("did", "salt", "digest", "part", bits.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    label = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("did")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    rows = rows.join(label.withColumn("salt", F.lit(0)), ["did", "salt"], "left")
    of = lambda c: (F.coalesce(c, F.lit(0)) * F.col("n"))
    rows = rows.select("did", "digest", "part", "mask", "n", of("is_good").alias("good"), of("is_toxic").alias("toxic"))
    # A text's rows by part, and those of them with the least id.
    texts = rows.groupBy("digest", "part", "mask").agg(
        F.min(F.struct("did", "n", "good", "toxic")).alias("least"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    first = texts.groupBy("digest").agg(F.min("least.did").alias("first"))
    texts = texts.join(first, "digest")
    # Without any id, no row of the text has a smaller one.
    stays = lambda c: F.when(F.col("first") == NO_ID, F.col(c)).when(F.col("least.did") == F.col("first"), F.col(f"least.{c}")).otherwise(F.lit(0))
    repeat = 1 << LETTERS.index(REPEAT)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[stays(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct(F.col("mask").bitwiseOR(F.lit(repeat)).alias("mask"), *[(F.col(c) - stays(c)).alias(c) for c in ("n", "good", "toxic")]))
    out = texts.select("part", F.explode(both).alias("m")).select("part", "m.*").where("n > 0")
    return out.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


class Diagram:
    """Counts by failure mask as a decision diagram whose levels can be swapped."""

    def __init__(self, counts: dict[int, tuple[int, ...]], n_filters: int, width: int = 3):
        self.order = list(range(n_filters))
        none = (0,) * width
        #: Ends are level ``n_filters``; ``weights[i][k]`` are the counts below node k of level i.
        ends: dict[tuple, int] = {}
        row = [ends.setdefault(counts.get(self._mask(path, n_filters), none), len(ends)) for path in range(1 << n_filters)]
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(n_filters)]
        self.weights: list[list[tuple[int, ...]]] = [[] for _ in range(n_filters)] + [list(ends)]
        for level in reversed(range(n_filters)):
            unique: dict[tuple[int, int], int] = {}
            row = [unique.setdefault(pair, len(unique)) for pair in zip(row[::2], row[1::2], strict=True)]
            self._set(level, unique)

    @staticmethod
    def _mask(path: int, n: int) -> int:
        """A path's branches from the top are bits from the highest; filter 0 is the top one."""
        return sum(1 << i for i in range(n) if path >> (n - 1 - i) & 1)

    def _set(self, level: int, unique: dict[tuple[int, int], int]) -> None:
        self.levels[level] = list(unique)
        below = self.weights[level + 1]
        self.weights[level] = [tuple(map(sum, zip(below[lo], below[hi], strict=True))) for lo, hi in unique]

    def swap(self, level: int) -> None:
        """Exchange a level and the one below it: the four branches that lie
        two levels down are paired the other way."""
        low, unique = self.levels[level + 1], {}
        node = lambda lo, hi: unique.setdefault((lo, hi), len(unique))
        self.levels[level] = [(node(low[a][0], low[b][0]), node(low[a][1], low[b][1])) for a, b in self.levels[level]]
        self._set(level + 1, unique)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def reorder(self, order: Iterable[int]) -> None:
        """Swap levels until the diagram has this order."""
        for to, f in enumerate(order):
            for level in range(self.order.index(f) - 1, to - 1, -1):
                self.swap(level)

    def steps(self) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """What each step of the order removes and keeps."""
        node = 0
        for level, nodes in enumerate(self.levels):
            node, fails = nodes[node]
            yield self.weights[level + 1][fails], self.weights[level + 1][node]


def plain_changes(n: int) -> Iterator[tuple[int, ...]]:
    """All orders, each from the last by one exchange of neighbours."""
    if n == 0:
        yield ()
        return
    for k, rest in enumerate(plain_changes(n - 1)):
        places = range(n - 1, -1, -1) if k % 2 == 0 else range(n)
        yield from ((*rest[:p], n - 1, *rest[p:]) for p in places)


def audit_part(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) of one part, over all orders."""
    n = len(letters)
    diagram, found = Diagram(counts, n), {}
    for order in plain_changes(n):
        diagram.reorder(order)
        found[order] = list(diagram.steps())
    fails, alone, shares = [0] * n, [0] * n, [0] * n
    for order, steps in found.items():
        fails[order[0]] = steps[0][0][0]
        alone[order[-1]] = steps[-1][0][0]
        for f, (removed, _) in zip(order, steps, strict=True):
            shares[f] += removed[0]
    assert len(found) == factorial(n)
    return [("".join(letters[f] for f in order), i + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shares[f])
            for order in permutations(range(n)) for i, (f, (removed, kept)) in enumerate(zip(order, found[order], strict=True))]


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The steps of all orders for every part of :func:`failure_masks`."""

    def run(key, pdf):
        import pandas as pd

        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(pdf["mask"], pdf["n"], pdf["good"], pdf["toxic"], strict=True)}
        return pd.DataFrame([(key[0], *row) for row in audit_part(counts, letters)], columns=[c.split()[0] for c in STEP.split(", ")])

    python_path(masks.sparkSession)
    return masks.groupBy("part").applyInPandas(run, STEP)


def audit_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``: a row per part, order and step."""
    return audit(failure_masks(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
