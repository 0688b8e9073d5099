"""Jaccard similarity join on word n-grams.

1. One pass over the texts gives every document the size and a class key of
   its distinct shingles (equal sets share a class; J = 1) and counts
   shingles in a sketch of fixed size, over all documents.
2. Shingles are ordered rare first (sketch count, then hash; any total order
   is valid). A document emits the prefix of its shingles in that order:
   sets with Jaccard >= t share a shingle within both prefixes.
3. Classes that share a prefix shingle are candidates, pruned by the length,
   positional and suffix filters. The suffix filter compares parity cells of
   the hash space (256 in the join, about one per shingle before the
   verification): every differing shingle flips one cell, so the number of
   differing cells never exceeds the symmetric difference.
4. Each candidate pair is verified once on the whole sets.

Shingles are 64-bit hashes; only prefix shingles of two or more classes go
through the join (a filter of fixed size keeps most others back).

Groups of near copies hold a number of links that is quadratic in their
size. For components they need not all be listed: first every class is
verified against one partner (the most popular class it meets) and components are formed; then only candidates in *different*
components are tested, all of them, leaving out the largest component of
each group on one side. No link between different components is lost, and a
group that has become one component makes no more pairs. With
``connected_only=False`` all candidates are tested and all links listed;
``count_links`` instead counts those of every class without listing them. Links
lie inside components, so the classes of a component are dealt into blocks and
every pair of blocks is one small matrix of intersections.

Defined results: null or word-less texts have no shingles and link with
nothing, their component is their own id; a null id counts as larger than
all others; repeated rows belong to one class; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from stockflow.llm import bloom
from stockflow.llm.common import cut, python_path, settled
from stockflow.llm.components import components

#: Cells of the shingle count sketch, bits of the filters of documents and of
#: shared prefix shingles: of fixed size whatever the input, as they pass the driver.
SKETCH_BITS, BLOOM_BITS, SHARED_BITS = 18, 23, 25
NO_ID = (1 << 63) - 1
#: Shingles by which a pair is known to have met before.
FIRST = 8
#: Rows of a shingle that more than HOT classes share carry the full signature, of up to HOT_LONGS longs.
HOT, HOT_LONGS = 64, 16
#: Classes and shingles of a block of a component, about, and columns of the matrices of a pair of blocks.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 400_000, 4096


@dataclass(frozen=True)
class JoinSpec:
    """``percent``: least Jaccard similarity in hundredths."""
    k: int = 5
    percent: int = 80
    lower: bool = True


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    python_path(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).alias("text"))


def _class_key(s) -> int:
    """64-bit key of a sorted set, as a signed integer."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
    return h - (1 << 64) if h >> 63 else h


def _cells(s, cells: int):
    """Parities as longs: cell i is odd if an odd number of shingles fall into it."""
    import numpy as np

    odd = np.bincount((s >> np.uint64(8)).astype(np.int64) & (cells - 1), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _signature(s):
    """Parity cells, about as many as shingles (a power of two from 256 to
    65,536), so that they tell near from not so near at any size."""
    return _cells(s, min(max(256, 1 << (len(s) - 1).bit_length() if len(s) else 0), 65536))


#: A signature of 256 cells for the join itself, and the full one.
_PROFILE = "did long, n long, c long, s0 long, s1 long, s2 long, s3 long, sig array<long>, cell int"


def profile(docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    """Per document its id, set size, class key and signature; besides, rows
    ``cell, n`` (did null) of the shingle count sketch, at most its size a task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from stockflow.llm import shingling as S

        names = [f.split()[0] for f in _PROFILE.split(", ")]
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, c, short, sig = [], [], [], []
            for text in batch.column(1):
                s = S.shingle_set(S.utf8(text), spec.k, spec.lower)
                n.append(len(s))
                c.append(_class_key(s))
                short.append(_cells(s, 256))
                sig.append(_signature(s))
                np.add.at(cells, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            if n:
                short = np.stack(short)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sig)]), pa.int32()), pa.array(np.concatenate(sig)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), *(pa.array(short[:, i].copy()) for i in range(4)),
                     lists, pa.nulls(len(n), pa.int32())], names)
        used = np.flatnonzero(cells)
        for i in range(0, len(used), 65536):
            part = used[i:i + 65536]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(cells[part]), none, none, none, none, none, pa.nulls(len(part), pa.list_(pa.int64())), pa.array(part, pa.int32())], names)

    return _scan(docs, id_col, text_col).mapInArrow(settled(run), _PROFILE)


def _order(s, counts):
    """Places of the shingles, rare first."""
    import numpy as np

    return np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))


def prefixes(docs: DataFrame, spec: JoinSpec, counts, known, id_col: str, text_col: str, shared=None) -> DataFrame:
    """``h, c, n, pos``: the prefix shingles, rare first, of one document of
    each class (``known``: filter of their keys; false hits are copies that
    add rows equal to others). With ``shared``, only shingles it lets through."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from stockflow.llm import shingling as S

        seen = counts.value
        for batch in batches:
            out, held = [], 0

            def rows():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["h", "c", "n", "pos"])

            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = S.shingle_set(S.utf8(text), spec.k, spec.lower)
                n, c = len(s), _class_key(s)
                if not n or not bloom.hits(known.value, np.array([c ^ did]).view(np.uint64), BLOOM_BITS)[0]:
                    continue
                p = n - -(-spec.percent * n // 100) + 1
                h, pos = s[_order(s, seen)[:p]], np.arange(p, dtype=np.int32)
                if shared is not None:
                    hit = bloom.hits(shared.value, h, SHARED_BITS)
                    h, pos = h[hit], pos[hit]
                out.append((h.view(np.int64), np.full(len(h), c, np.int64), np.full(len(h), n, np.int32), pos))
                held += len(h)
                if held > 500_000:
                    yield rows()
                    out, held = [], 0
            if out:
                yield rows()

    return _scan(docs, id_col, text_col).mapInArrow(settled(run), "h long, c long, n int, pos int")


def sets_of(docs: DataFrame, spec: JoinSpec, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``c, did, s``: whole shingle sets of at least the documents in ``ids``
    (``c, did``). A filter of fixed size keeps most others back; a false hit
    costs a row that no join asks for."""
    wanted = bloom.build(ids, F.col("c").bitwiseXOR(F.col("did")), BLOOM_BITS)
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from stockflow.llm import shingling as S

        filled = wanted.value
        for batch in batches:
            dids, cs, out, held = [], [], [], 0

            def rows():
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(dids, pa.int64()), lists], ["c", "did", "s"])

            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = S.shingle_set(S.utf8(text), spec.k, spec.lower)
                c = _class_key(s)
                if not len(s) or not bloom.hits(filled, np.array([c ^ did]).view(np.uint64), BLOOM_BITS)[0]:
                    continue
                dids.append(did)
                cs.append(c)
                out.append(s)
                held += len(s)
                if held > 500_000:
                    yield rows()
                    dids, cs, out, held = [], [], [], 0
            if out:
                yield rows()

    return _scan(docs, id_col, text_col).mapInArrow(settled(run), "c long, did long, s array<long>")


# -- filters on a pair of classes x, y with sizes and signatures ------------

def _need(spec: JoinSpec, nx: Column, ny: Column) -> Column:
    """Least intersection for the similarity: ceil(p (nx + ny) / (100 + p))."""
    return F.ceil((nx + ny) * spec.percent / F.lit(100.0 + spec.percent) - 1e-9)


def length_filter(spec: JoinSpec, nx: Column, ny: Column) -> Column:
    return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * spec.percent


def positional_filter(spec: JoinSpec, nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """With a common shingle at places px and py of the order, at most so many are common."""
    return F.least(px, py) + 1 + F.least(nx - px - 1, ny - py - 1) >= _need(spec, nx, ny)


def suffix_filter(spec: JoinSpec, x: str, y: str) -> Column:
    """Cells that differ are a lower bound of the symmetric difference."""
    apart = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(4)), F.lit(0))
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return apart <= n - 2 * _need(spec, F.col(f"{x}.n"), F.col(f"{y}.n"))


def full_suffix_filter(spec: JoinSpec, x: str, y: str) -> Column:
    """The same on the full signatures; of two sizes the larger is folded."""
    few, many = (F.when((F.size(f"{x}.sig") <= F.size(f"{y}.sig")) == flag, F.col(f"{x}.sig")).otherwise(F.col(f"{y}.sig")) for flag in (True, False))
    apart = F.aggregate(F.sequence(F.lit(0), F.size(few) - 1), F.lit(0), lambda a, j: a + F.bit_count(
        F.get(few, j).bitwiseXOR(F.get(many, j)).bitwiseXOR(F.when(F.size(many) > F.size(few), F.get(many, j + F.size(few))).otherwise(F.lit(0)))))
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    # Sizes further apart than twofold are left to the verification.
    return (F.size(many) > 2 * F.size(few)) | (apart <= n - 2 * _need(spec, F.col(f"{x}.n"), F.col(f"{y}.n")))


@dataclass(frozen=True)
class Joined:
    """``members`` (did, n, c), ``classes`` (c, did, n, docs, signatures) and
    ``links`` (a, b, common) between class keys. ``degrees`` (c, class_links)
    is there if all links are known, ``roots`` (c, root) if components are."""
    members: DataFrame
    classes: DataFrame
    links: DataFrame
    degrees: DataFrame | None = None
    roots: DataFrame | None = None


def verify(docs: DataFrame, spec: JoinSpec, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links among distinct pairs ``a, b`` of class keys, each checked once on whole sets."""
    x, y = classes.alias("x"), classes.alias("y")
    p = pairs.join(x, F.col("a") == F.col("x.c")).join(y, F.col("b") == F.col("y.c"))
    p = p.where(length_filter(spec, F.col("x.n"), F.col("y.n")) & full_suffix_filter(spec, "x", "y"))
    p = cut(p.select("a", "b", F.col("x.did").alias("a_did"), F.col("y.did").alias("b_did")), "join-pairs")
    ids = p.select(F.col("a").alias("c"), F.col("a_did").alias("did")).unionAll(p.select(F.col("b").alias("c"), F.col("b_did").alias("did")))
    sets = cut(sets_of(docs, spec, ids, id_col, text_col), "join-sets")
    # Rows repeated in the input give their set several times.
    one = lambda c, d, s: sets.select(F.col("c").alias(c), F.col("did").alias(d), F.col("s").alias(s))
    v = p.join(one("b", "b_did", "b_set"), ["b", "b_did"]).join(one("a", "a_did", "a_set"), ["a", "a_did"])
    v = v.select("a", "b", (F.size("a_set") + F.size("b_set")).alias("both"), F.size(F.array_intersect("a_set", "b_set")).alias("common"))
    return v.where(F.col("common") * 100 >= (F.col("both") - F.col("common")) * spec.percent).select("a", "b", "common").distinct()


def stars(shared: DataFrame) -> DataFrame:
    """For every class the one partner ``b`` it is verified against first: of
    the centres of its prefix shingles the one it meets most often. The centre
    of a shingle is its most popular class, by the classes met over all its
    prefix shingles; in a group of near copies that is the least edited one."""
    sizes = shared.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    popular = shared.select("h", "c").join(sizes, "h").groupBy("c").agg(F.sum("size").alias("popular"))
    rows = shared.select("h", "c").join(popular, "c")
    centre = rows.groupBy("h").agg(F.max(F.struct("popular", "c")).alias("m")).select("h", F.col("m.c").alias("b"), F.col("m.popular").alias("p"))
    met = shared.select("h", "c").join(centre, "h").where(F.col("c") != F.col("b"))
    met = met.groupBy("c", "b").agg(F.count(F.lit(1)).alias("k"), F.max("p").alias("p"))
    return met.groupBy("c").agg(F.max(F.struct("k", "p", "b")).alias("best")).select(F.col("c").alias("a"), F.col("best.b").alias("b"))


def meetings(rows: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs ``a, b`` of classes of different components ``comp`` that share a
    prefix shingle ``h`` and pass the filters; one of the two is outside the
    shingle's largest component ``main``.

    A pair that shares many shingles meets at all of them and is made at the
    one that most classes share (``size``; then by hash): rows carry their
    class's FIRST shingles of that order, and one of those shared and earlier
    than ``h`` drops the pair. Near copies have the popular shingles in common,
    so nearly every pair is made once. (Shingles beyond the FIRST may make it again.)
    Pairs of a shingle of many classes also pass the suffix filter on the full signatures."""
    place = F.struct((-F.col("size")).alias("rank"), "h")
    before = rows.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(place)), 1, FIRST).alias("least"))
    of = classes.select("c", "s0", "s1", "s2", "s3", F.when(F.size("sig") <= HOT_LONGS, F.col("sig")).alias("sig")).join(before, "c")
    # Similar sizes lie in the same band or in neighbours (bands a little wider than the least ratio, for rounding).
    width = 1.000001 * math.log(100.0 / min(spec.percent, 99))
    earlier = F.transform(F.filter("least", lambda p: p < place), lambda p: p["h"])
    rows = rows.join(of, "c").withColumn("earlier", earlier).withColumn("sig", F.when(F.col("size") > HOT, F.col("sig")))
    rows = rows.drop("least", "size").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width))
    rows = cut(rows, "join-rows")
    x = rows.where("comp != main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("x")
    y = rows.alias("y")
    c = F.col
    pairs = x.join(y, (c("x.h") == c("y.h")) & (c("x.band") == c("y.band")) & (c("x.comp") != c("y.comp"))
                   & ((c("y.comp") == c("y.main")) | (c("x.c") < c("y.c")))
                   & length_filter(spec, c("x.n"), c("y.n")) & positional_filter(spec, c("x.n"), c("x.pos"), c("y.n"), c("y.pos"))
                   & suffix_filter(spec, "x", "y") & ~F.arrays_overlap("x.earlier", "y.earlier")
                   & (c("x.sig").isNull() | c("y.sig").isNull() | full_suffix_filter(spec, "x", "y")))
    return pairs.select(F.greatest("x.c", "y.c").alias("a"), F.least("x.c", "y.c").alias("b"))


def candidates(rows: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """Distinct pairs ``a, b`` of :func:`meetings`."""
    return meetings(rows, classes, spec).distinct()


def ngram_join(docs: DataFrame, spec: JoinSpec = JoinSpec(), *, id_col: str = "doc_id", text_col: str = "text",
               connected_only: bool = True) -> Joined:
    """Classes of equal sets and links between similar classes."""
    import numpy as np

    seen = cut(profile(docs, spec, id_col, text_col), "join-profile")
    members = seen.where(F.col("cell").isNull()).drop("cell")
    classes = cut(members.where("n > 0").groupBy("c").agg(
        F.min("did").alias("did"), F.count(F.lit(1)).alias("docs"), *[F.first(x).alias(x) for x in ("n", "s0", "s1", "s2", "s3", "sig")]), "join-classes")
    cells = seen.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("n").alias("n"))
    counts = docs.sparkSession.sparkContext.broadcast(bloom.fixed_array(cells, 1 << SKETCH_BITS, np.int64))

    known = docs.sparkSession.sparkContext.broadcast(bloom.build(classes, F.col("c").bitwiseXOR(F.col("did")), BLOOM_BITS))
    groups = prefixes(docs, spec, counts, known, id_col, text_col).groupBy("h").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    groups = cut(groups.where("first < last").select("h"), "join-groups")
    several = docs.sparkSession.sparkContext.broadcast(bloom.build(groups, F.col("h"), SHARED_BITS))
    shared = cut(prefixes(docs, spec, counts, known, id_col, text_col, several).join(groups, "h"), "join-shared")

    found = None
    comp = F.col("c")
    if connected_only:
        star = stars(shared)
        found = cut(verify(docs, spec, star, classes, id_col, text_col), "join-links")
        roots = cut(components(found).withColumnRenamed("node", "c"), "join-roots")
        shared = shared.join(roots, "c", "left")
        comp = F.coalesce("root", "c")

    rows = shared.select("h", "c", "n", "pos", comp.alias("comp"))
    of = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(
        F.max(F.struct("k", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("size"))
    main = cut(of.where("comps > 1").select("h", F.col("m.comp").alias("main"), "size"), "join-main")
    rows = cut(rows.join(main, "h").distinct(), "join-rows")
    pairs = candidates(rows, classes, spec)
    more = verify(docs, spec, pairs, classes, id_col, text_col)
    links = cut(more if found is None else found.unionAll(more), "join-links")
    return Joined(members, classes, links, None if connected_only else _degrees(links))


def _degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("c")).unionAll(links.select(F.col("b").alias("c")))
    return ends.groupBy("c").agg(F.count(F.lit(1)).alias("class_links"))


def _linked(x, y, same: bool, percent: int, columns: int = COLUMNS):
    """Links of every set of ``x`` with sets of ``y``, and the other way round;
    ``x`` and ``y`` are (sizes, shingles one set after the other)."""
    import numpy as np

    (nx, vx), (ny, vy) = x, y
    _, col, times = np.unique(vx if same else np.concatenate([vx, vy]), return_inverse=True, return_counts=True)
    # Only shingles of several sets count for an intersection (of other sets than itself).
    place = np.cumsum(times > 1) - 1
    width = int(place[-1]) + 1 if len(place) else 0

    def cells(n, cols):
        row, keep = np.repeat(np.arange(len(n)), n), times[cols] > 1
        row, cols = row[keep], place[cols[keep]]
        order = np.argsort(cols, kind="stable")
        return row[order], cols[order]

    rx, cx = cells(nx, col[:len(vx)])
    ry, cy = (rx, cx) if same else cells(ny, col[len(vx):])
    common = np.zeros((len(nx), len(ny)), np.int64)
    for lo in range(0, width, columns):
        def part(n, r, c, lo=lo):
            a, b = np.searchsorted(c, [lo, lo + columns])
            m = np.zeros((len(n), min(columns, width - lo)), np.float32)
            m[r[a:b], c[a:b] - lo] = 1
            return m

        a = part(nx, rx, cx)
        common += (a @ (a if same else part(ny, ry, cy)).T).astype(np.int64)
    link = common * 100 >= (nx[:, None] + ny[None, :] - common) * percent
    if same:
        np.fill_diagonal(link, False)
    return link.sum(1), link.sum(0)


def count_links(docs: DataFrame, spec: JoinSpec, joined: Joined, *, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    """``joined`` with the number of links of every class, all of them: in a
    component whose links are not all listed, every two classes are compared."""
    roots = cut(components(joined.links).withColumnRenamed("node", "c"), "join-roots")
    of = joined.classes.select("c", "did", "n").join(roots, "c")
    listed = joined.links.select(F.col("a").alias("c")).join(roots, "c").groupBy("root").agg(F.count(F.lit(1)).alias("listed"))
    size = of.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).join(listed, "root")
    size = size.withColumn("open", F.col("listed") * 2 < F.col("m") * (F.col("m") - 1)).withColumn(
        "blocks", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)))
    of = cut(of.join(size.select("root", "m", "open", "blocks"), "root"), "join-open")
    rows = of.where("open")
    sets = sets_of(docs, spec, rows.select("c", "did"), id_col, text_col)
    # Rows repeated in the input give their set several times.
    sets = cut(sets.join(rows.select("c", "did", "root", "blocks"), ["c", "did"]).groupBy("c").agg(
        *[F.first(x).alias(x) for x in ("root", "blocks", "s")]), "join-sets")
    block = F.pmod(F.xxhash64("c"), F.col("blocks"))
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "c", "s")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        percent, key, held, out = spec.percent, None, [], []

        def counted():
            block, c, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            values, ends = np.concatenate([h[3] for h in held]), np.cumsum(n)
            sides = []
            for b in key[1:]:
                mine = block == b
                sides.append((c[mine], n[mine], values[np.repeat(mine, n)]))
            (c1, n1, v1), (c2, n2, v2) = sides
            same = key[1] == key[2]
            if ends[-1] and len(c1) and len(c2):
                k1, k2 = _linked((n1, v1), (n2, v2), same, percent)
                out.append((c1, k1))
                if not same:
                    out.append((c2, k2))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["c", "k"])

        for batch in batches:
            root, x, y, block, c = (batch.column(i).to_numpy() for i in range(5))
            lists = batch.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            new = np.flatnonzero((root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, len(c)], strict=True):
                if lo == hi:
                    continue
                now = (root[lo], x[lo], y[lo])
                if held and now != key:
                    counted()
                    held = []
                key = now
                held.append((block[lo:hi].copy(), c[lo:hi].copy(), np.diff(ends[lo:hi + 1]).astype(np.int64), values[ends[lo]:ends[hi]].copy()))
                if sum(len(a) for a, _ in out) > 100_000:
                    yield rows()
                    out.clear()
        if held:
            counted()
        if out:
            yield rows()

    dealt = sets.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    counts = dealt.mapInArrow(settled(run), "c long, k long").groupBy("c").agg(F.sum("k").alias("class_links"))
    whole = of.where("NOT open").select("c", (F.col("m") - 1).alias("class_links"))
    return replace(joined, degrees=cut(whole.unionAll(counts), "join-degrees"), roots=roots)


def _with_components(joined: Joined) -> DataFrame:
    """``did, n, c, component, first, docs, class_links`` per document;
    ``first`` is the class of the component's smallest id (of several, the
    least). All but the first three are null for classes of one document
    without links."""
    roots = components(joined.links).withColumnRenamed("node", "c") if joined.roots is None else joined.roots
    of = joined.classes.select("c", "did", "docs").join(roots, "c", "left")
    if joined.degrees is None:
        of = of.withColumn("class_links", F.lit(None).cast("long"))
    else:
        of = of.join(joined.degrees, "c", "left")
    of = cut(of.where((F.col("docs") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "c")), "join-roots")
    least = of.groupBy("root").agg(F.min(F.struct("did", "c")).alias("least"))
    of = of.join(least, "root").select("c", F.col("least.did").alias("component"), F.col("least.c").alias("first"), "docs", "class_links")
    m = joined.members.select("did", "n", F.when(F.col("n") > 0, F.col("c")).alias("c"))
    return m.join(of, "c", "left")


def component_ids(joined: Joined) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_docs``
    (rows with an equal set) and ``class_links`` (classes that its class is
    similar to; null unless ``joined`` has all links or counts them).
    ``component_id`` is the smallest id reachable."""
    back = lambda x: F.when(x != NO_ID, x)
    return _with_components(joined).select(
        back(F.col("did")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component", "did")).alias("component_id"),
        F.coalesce("docs", F.lit(1)).alias("class_docs"), (F.coalesce("class_links", F.lit(0)) if joined.degrees is not None else F.col("class_links")).alias("class_links"))


def keep_one(docs: DataFrame, spec: JoinSpec = JoinSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest
    id (of rows repeating that id, one, whatever their sets). Documents without words all
    stay. Rows that a filter of fixed size knows to be unaffected pass
    straight through; only the others are joined."""
    m = _with_components(ngram_join(docs, spec, id_col=id_col, text_col=text_col)).where("n > 0")
    marks = m.groupBy("did", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.coalesce("component", "did")).alias("component"), F.min(F.coalesce("first", "c")).alias("first"))
    # Ids may repeat, so the survivor is known by id and set.
    drop = (F.col("component") != F.col("did")) | (F.col("first") != F.col("c"))
    marks = cut(marks.where((F.col("k") > 1) | drop).select(F.col("did").alias("_did"), F.col("c").alias("_c"), drop.alias("_drop")), "join-marks")
    filled = bloom.build(marks, F.col("_c").bitwiseXOR(F.col("_did")), BLOOM_BITS)
    filled = docs.sparkSession.sparkContext.broadcast(filled)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from stockflow.llm import shingling as S

        for batch in batches:
            c = np.array([_class_key(S.shingle_set(S.utf8(t), spec.k, spec.lower)) for t in batch.column(at)], np.int64)
            hit = bloom.hits(filled.value, (c ^ batch.column(len(names)).to_numpy()).view(np.uint64), BLOOM_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c), pa.array(hit)], [*names, "_did", "_c", "_hit"])

    python_path(docs.sparkSession)
    schema = StructType([*docs.schema, StructField("_did", LongType()), StructField("_c", LongType()), StructField("_hit", BooleanType())])
    seen = docs.withColumn("_did", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).mapInArrow(settled(run), schema)
    held = seen.where("_hit").join(marks, ["_did", "_c"], "left")
    place = F.row_number().over(W.partitionBy("_did", "_c").orderBy(F.xxhash64(text_col)))
    held = held.withColumn("_place", place).where(F.col("_drop").isNull() | (~F.col("_drop") & (F.col("_place") == 1)))
    return seen.where("NOT _hit").select(*names).unionAll(held.select(*names))
