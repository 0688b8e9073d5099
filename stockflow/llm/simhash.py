"""SimHash near-duplicates by a hierarchical index in Gray order.

A text's fingerprint has 64 bits: bit i is set if it is set in over half of
the XXH64 values (seed 42) of its word shingles, repeats included. Equal
fingerprints are one row of the index, so copies cost nothing; fingerprints
that differ in at most ``bits`` bits link, and links make components.

The index sorts the distinct fingerprints by their rank in the reflected Gray
code, in which neighbours share most bits. Runs of neighbours are its nodes,
runs of nodes the nodes above. A node knows the bits in which all its members
agree (its mask) and their values (its pattern); bits that the parent has
settled are factored out of the child. Two nodes are compared on the bits that
both settle and that their parents did not: what differs is added to the
difference handed down, and beyond ``bits`` the pair falls with all members.
Pairs of the lowest nodes that remain are compared member by member.

The fingerprints are cut into blocks of the order, whose number grows with the
square root of theirs; the blocks are the index's uppermost nodes, and pairs of
blocks that remain are the tasks. A task forms its own components and returns
a spanning forest of its links, never the links of a group one by one; two
nodes whose members all belong to one component already are not compared
again. Forests are joined by the distributed components step.

Defined results: null and word-less texts have the fingerprint 0, which links
like any other; texts of fewer words than a shingle are one shingle. A null id
is larger than all others, and a component of null ids only has the id null.
Repeated rows are members of their own. Very long texts are hashed piece by
piece, whole. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import cut, python_path, settled
from stockflow.llm.components import components

NO_ID = (1 << 63) - 1
#: A task compares two blocks; of N fingerprints there are about sqrt(N / BLOCK_BASE) blocks.
BLOCK_BASE = 2000
#: Children of a node, fingerprints of a packed row, pairs of nodes handled at a time.
FAN, PACK, PAIRS = 8, 8192, 8192
#: Bytes of a text hashed at a time, about.
PIECE = 1 << 20


# -- fingerprints -----------------------------------------------------------

def _pieces(text: bytes):
    """Parts of about PIECE bytes, cut between words."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end]
        start = end


def _votes(words: list[bytes], k: int) -> np.ndarray:
    """Number of shingles by bit set in their hash."""
    from xxhash import xxh64_intdigest as h

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:len(words) - k + 1].tolist()
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1:] - 1).tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes


def fingerprint(text: bytes, k: int = 4) -> int:
    """SimHash of a text's UTF-8 bytes, as a signed integer."""
    text, votes, n, last = text.lower(), np.zeros(64, np.int64), 0, []
    for piece in _pieces(text):
        words = last + piece.split()
        if len(words) >= k:
            votes += _votes(words, k)
            n += len(words) - k + 1
        last = words[1 - k:] if k > 1 else []
    if not n and last:
        votes, n = _votes(last, len(last)), 1
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 4, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``did, fp`` per row; a null id is ``NO_ID``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["did", "fp"])

    python_path(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).alias("text"))
    return rows.mapInArrow(settled(run), "did long, fp long")


def gray_rank(fp: Column) -> Column:
    """Rank in the Gray code, as a signed integer in the order of the unsigned one."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-1 << 63))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    """The unsigned rank of fingerprints given as uint64."""
    for shift in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(shift))
    return fps


# -- the index inside a task ------------------------------------------------

class Tree:
    """Nodes over fingerprints (uint64) in Gray order: level 0 holds runs of
    FAN fingerprints, each level runs of FAN nodes of the one below."""

    def __init__(self, fps: np.ndarray, levels: int):
        self.fps, self.agreed, self.values = fps, [], []
        ones, any_ = fps, fps
        for _ in range(levels):
            starts = np.arange(0, len(ones), FAN)
            ones, any_ = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts)
            self.agreed.append(~(ones ^ any_))
            self.values.append(ones)

    def members(self, nodes: np.ndarray) -> np.ndarray:
        """Places of a lowest node's fingerprints; the last of the order fills a short run."""
        return np.minimum(nodes[:, None] * FAN + np.arange(FAN), len(self.fps) - 1)


class Forest:
    """Components of the places 0 to n - 1 and the links that have made them."""

    def __init__(self, n: int):
        self.root, self.a, self.b = np.arange(n), [], []

    def unite(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Link places; of the links, those that join components are kept. True if any did."""
        changed = False
        while True:
            r, s = self.root[i], self.root[j]
            apart = r != s
            if not apart.any():
                return changed
            changed = True
            i, j, high, low = i[apart], j[apart], np.maximum(r, s)[apart], np.minimum(r, s)[apart]
            # Every component takes one link to a smaller one: no circles.
            _, first = np.unique(high, return_index=True)
            self.a.append(i[first])
            self.b.append(j[first])
            to = np.arange(len(self.root))
            to[high[first]] = low[first]
            while not np.array_equal(again := to[to], to):
                to = again
            self.root = to[self.root]

    def whole(self, start: int, n: int, levels: int) -> list[np.ndarray]:
        """By level and node of the tree at ``start``: the root of all members, -1 if they have several."""
        low = high = self.root[start:start + n]
        out = []
        for _ in range(levels):
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out


def _descend(a, b, n_a: int, n_b: int, same: bool):
    """All pairs of children of pairs of nodes (places of the parent pair too)."""
    x = a[:, None, None] * FAN + np.arange(FAN)[None, :, None]
    y = b[:, None, None] * FAN + np.arange(FAN)[None, None, :]
    real = (x < n_a) & (y < n_b)
    if same:
        real &= x <= y
    parent, i, j = np.nonzero(real)
    return a[parent] * FAN + i, b[parent] * FAN + j, parent


def link_blocks(x: np.ndarray, y: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprints) that span the components of ``x`` with ``y``, or
    of ``x`` with itself; both are distinct fingerprints (uint64) in Gray order."""
    same = y is None
    most, levels = max(len(x), 0 if same else len(y)), 1
    while FAN**levels < most:
        levels += 1
    tx = Tree(x, levels)
    ty = tx if same else Tree(y, levels)
    everything = x if same else np.concatenate([x, y])
    shift = 0 if same else len(x)
    forest = Forest(len(everything))
    whole_x = whole_y = None

    def alive(level, a, b, acc, parents):
        """Differences of pairs of nodes, and those left."""
        both = tx.agreed[level][a] & ty.agreed[level][b]
        if level + 1 < levels:
            both &= ~(tx.agreed[level + 1][parents[0]] & ty.agreed[level + 1][parents[1]])
        acc = acc + np.bitwise_count((tx.values[level][a] ^ ty.values[level][b]) & both)
        left = acc <= bits
        return a[left], b[left], acc[left]

    top = levels - 1
    roots = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8)
    stack = [(top, *alive(top, *roots, None))]
    while stack:
        level, a, b, acc = stack.pop()
        if len(a) > PAIRS:
            stack.append((level, a[PAIRS:], b[PAIRS:], acc[PAIRS:]))
            a, b, acc = a[:PAIRS], b[:PAIRS], acc[:PAIRS]
        if whole_x is not None:
            joined = whole_x[level][a]
            open_ = (joined < 0) | (joined != whole_y[level][b])
            a, b, acc = a[open_], b[open_], acc[open_]
        if not len(a):
            continue
        if level:
            ca, cb, parent = _descend(a, b, len(tx.values[level - 1]), len(ty.values[level - 1]), same)
            stack.append((level - 1, *alive(level - 1, ca, cb, acc[parent], (a[parent], b[parent]))))
            continue
        i, j = tx.members(a), ty.members(b)
        pair, p, q = np.nonzero(np.bitwise_count(x[i][:, :, None] ^ ty.fps[j][:, None, :]) <= bits)
        if forest.unite(i[pair, p], j[pair, q] + shift):
            whole_x = forest.whole(0, len(x), levels)
            whole_y = whole_x if same else forest.whole(shift, len(y), levels)
    if not forest.a:
        none = np.empty(0, np.uint64)
        return none, none
    return everything[np.concatenate(forest.a)], everything[np.concatenate(forest.b)]


# -- the index over all fingerprints ----------------------------------------

def _blocks(fps: DataFrame, n_blocks: int) -> DataFrame:
    """``block, fps``: the fingerprints of the Gray order's blocks, packed."""
    spark = fps.sparkSession
    keyed = fps.select("fp", gray_rank(F.col("fp")).alias("rank"))
    shares = [i / n_blocks for i in range(1, n_blocks)]
    bounds = keyed.agg(F.percentile_approx("rank", shares, 100 * n_blocks)).first()[0] if shares else []
    bounds = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            block = np.searchsorted(bounds.value, batch.column(1).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *batch.columns], ["block", "fp", "rank"])

    def pack(batches):
        import pyarrow as pa

        key, held = None, []

        def rows():
            fp = np.concatenate(held)
            parts = [fp[i:i + PACK].tobytes() for i in range(0, len(fp), PACK)]
            return pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["block", "fps"])

        for batch in batches:
            block, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero(block[1:] != block[:-1]) + 1
            for lo, hi in zip([0, *new], [*new, len(block)], strict=True):
                if lo == hi:
                    continue
                if held and (block[lo] != key or sum(map(len, held)) >= PACK):
                    yield rows()
                    held = []
                key = int(block[lo])
                held.append(fp[lo:hi].copy())
        if held:
            yield rows()

    dealt = keyed.mapInArrow(settled(deal), "block int, fp long, rank long").repartition(n_blocks, "block").sortWithinPartitions("block", "rank")
    return dealt.mapInArrow(settled(pack), "block int, fps binary")


def links(fps: DataFrame, bits: int = 4, block_base: int = BLOCK_BASE) -> DataFrame:
    """``a, b``: links that span all components of distinct fingerprints ``fp``."""
    python_path(fps.sparkSession)
    n = fps.count()
    n_blocks = max(1, int(np.ceil(np.sqrt(n / block_base))))
    packed = cut(_blocks(fps, n_blocks), "simhash-blocks")

    def tops(batches):
        import pyarrow as pa

        for batch in batches:
            both = [(np.bitwise_and.reduce(f), np.bitwise_or.reduce(f)) for f in (np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i] for p in both], pa.int64()) for i in (0, 1))], ["block", "ones", "any"])

    # The uppermost nodes: one row a block.
    nodes = packed.mapInArrow(settled(tops), "block int, ones long, any long").groupBy("block").agg(
        F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any")).toArrow()
    block = nodes["block"].to_numpy()
    ones, any_ = nodes["ones"].to_numpy().view(np.uint64), nodes["any"].to_numpy().view(np.uint64)
    agreed = ~(ones ^ any_)
    upper = fps.sparkSession.sparkContext.broadcast((block, ones, agreed))

    def meet(batches):
        import pyarrow as pa

        block, ones, agreed = upper.value
        place = {int(b): i for i, b in enumerate(block)}
        for batch in batches:
            for b, packed_row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = place[b]
                near = block[np.bitwise_count((ones ^ ones[i]) & agreed & agreed[i]) <= bits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(near, b), pa.int32()), pa.array(np.maximum(near, b), pa.int32()), pa.array([b] * len(near), pa.int32()),
                     pa.array([packed_row] * len(near), pa.binary())], ["x", "y", "block", "fps"])

    def compare(table):
        import pyarrow as pa

        x = table["x"][0].as_py()
        y = table["y"][0].as_py()
        side, sides = table["block"].to_numpy(), []
        for b in dict.fromkeys((x, y)):
            fp = np.concatenate([np.frombuffer(table["fps"][int(i)].as_buffer(), np.uint64) for i in np.flatnonzero(side == b)] or [np.empty(0, np.uint64)])
            sides.append(fp[np.argsort(gray_ranks(fp))])
        a, b = link_blocks(sides[0], sides[1] if x != y else None, bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    met = packed.mapInArrow(settled(meet), "x int, y int, block int, fps binary")
    # A task a pair of blocks, about: they read little and compare much, so they are not put together.
    pairs = n_blocks * (n_blocks + 1) // 2
    return met.repartition(min(pairs, 20_000), "x", "y").groupBy("x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, *, id_col: str = "doc_id", text_col: str = "text",
                    block_base: int = BLOCK_BASE) -> DataFrame:
    """``doc_id, fp, component_id`` per row: fingerprint (signed) and smallest id reachable."""
    rows = cut(fingerprints(docs, k, id_col=id_col, text_col=text_col), "simhash-rows")
    fps = cut(rows.groupBy("fp").agg(F.min("did").alias("did"), F.count(F.lit(1)).alias("docs")), "simhash-distinct")
    roots = components(cut(links(fps, bits, block_base), "simhash-links")).withColumnRenamed("node", "fp")
    # Only fingerprints of several rows or with links have anything but their own id to tell.
    of = cut(fps.join(roots, "fp", "left").where((F.col("docs") > 1) | F.col("root").isNotNull()).select(
        "fp", "did", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = cut(of.groupBy("root").agg(F.min("did").alias("component")), "simhash-least")
    of = cut(of.join(least, "root").select("fp", "component"), "simhash-components")
    out = rows.join(of, "fp", "left").withColumn("component", F.coalesce("component", "did"))
    back = lambda x: F.when(F.col(x) != NO_ID, F.col(x))
    return out.select(back("did").alias("doc_id"), "fp", back("component").alias("component_id"))


def hex_of(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
