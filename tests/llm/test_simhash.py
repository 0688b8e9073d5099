"""SimHash near-duplicates against comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from stockflow.llm import queries
from stockflow.llm import simhash as S

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def roots_of(values, bits):
    """Index of the first value of each one's component."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def brute(rows, k=4, bits=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_fingerprint(t, k) for _, t in rows]
    return sorted(((d, f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, roots_of(fps, bits), strict=True)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(500)}"
    docs = [[word() for _ in range(rnd.randrange(1, 120))] for _ in range(120)]
    for base in docs[:15]:
        for _ in range(4):
            d = list(base)
            d[rnd.randrange(len(d))] = word()
            docs.append(d)
    hot = [word() for _ in range(400)]
    for _ in range(60):
        d = list(hot)
        for _ in range(rnd.randrange(4)):
            d[rnd.randrange(len(d))] = word()
        docs.append(d)
    docs += [["a"], ["A"], ["a", "b", "c"], ["a", "b", "c", "d"], ["é", "É", "x"]]
    rows = [(i * 3 % 1009, (" " if i % 3 else "\t\n").join(d).replace("w1", "W1")) for i, d in enumerate(docs)]
    rows += [(5000, None), (5001, ""), (5002, " \v\n"), (None, rows[2][1]), (None, "a text of a null id alone somewhere"), (None, "a text of a null id alone somewhere"),
             rows[7], rows[7], (6000, " ".join(word() for _ in range(40_000)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bits,base", [(1, 4, 2000), (2, 4, 3), (3, 9, 10)])
def test_equals_brute_force(spark, seed, bits, base):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS did", "2 AS fp", "3 AS block", "4 AS root")
    got = S.near_duplicates(df, bits=bits, block_base=base)
    got = got.select("doc_id", S.hex_of(got.fp), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, bits=bits)


def test_query(spark, tmp_path):
    rows = corpus(4)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 60


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    rnd = random.Random(5)
    text = "  ".join(rnd.choice(["lorem", "é", "Ipsum", "x" * 40]) for _ in range(3000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "PIECE", 64)
    assert S.fingerprint(text.encode()) == whole
    assert whole % (1 << 64) == plain_fingerprint(text)
    assert S.fingerprint(b"one two") % (1 << 64) == plain_fingerprint("one two")


@pytest.mark.parametrize("n,near,bits", [(1, 0, 4), (9, 0, 4), (700, 0, 20), (400, 600, 4), (30, 1500, 4)])
def test_blocks_span_all_components(n, near, bits):
    """Random fingerprints, and a dense group whose links are far more than its members."""
    rnd = random.Random(n)
    fps = {rnd.getrandbits(64) for _ in range(n)}
    base = rnd.getrandbits(64)
    for _ in range(near):
        v = base
        for _ in range(rnd.randrange(6)):
            v ^= 1 << rnd.randrange(64)
        fps.add(v)
    fps = np.array(sorted(fps), np.uint64)
    fps = fps[np.argsort(S.gray_ranks(fps))]

    def grouped(a, b):
        values = fps.tolist()
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= bits
            assert find(x) != find(y)  # a forest
            root[max(find(x), find(y))] = min(find(x), find(y))
        return [find(v) for v in values]

    want = roots_of(fps.tolist(), bits)
    same = lambda got: len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    assert same(grouped(*S.link_blocks(fps, None, bits)))
    if len(fps) > 1:
        half = len(fps) // 2
        parts = [S.link_blocks(fps[:half], None, bits), S.link_blocks(fps[half:], None, bits), S.link_blocks(fps[:half], fps[half:], bits)]
        root = {}
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        values = fps.tolist()
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if find(x) != find(y):
                root[max(find(x), find(y))] = min(find(x), find(y))
        assert same([find(v) for v in values])


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(1024, dtype=np.uint64)
    codes = codes[np.argsort(S.gray_ranks(codes))]
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()
