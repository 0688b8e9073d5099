"""I-Match fingerprints against a brute-force version in plain Python."""

import hashlib
import math
import random
import re

import xxhash

from stockflow.llm import imatch as I
from stockflow.llm import queries

LOW = (1 << I.LEXICON_BITS) - 1
signed = lambda h: h - (1 << 64) if h >> 63 else h


def terms(text):
    return {signed(xxhash.xxh64_intdigest(w.lower().encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")}


def brute(rows, band=(0.2, 0.6)):
    docs = sorted([(math.inf if d is None else -d, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), d, t or "") for d, t in rows],
                  key=lambda r: r[:2])
    df, n = {}, max(len(rows), 2)
    for *_, t in docs:
        for h in terms(t):
            df[h] = df.get(h, 0) + 1
    bits = {h & LOW for h, c in df.items() if n ** (1 - band[1]) <= c <= n ** (1 - band[0])}

    def subset(hs):
        h = 42
        for x in hs:
            h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=h)
        return h & 0xFFFFFFFF if hs else None

    def fingerprint(t):
        every = sorted(terms(t))
        base = [h for h in every if h & LOW in bits] or every
        out = [subset(base)]
        for s in range(I.SERIES):
            for level in range(I.LEVELS):
                mask = ((1 << level + 1) - 1) << I.LEVELS * s
                out.append(subset([h for h in base if h & mask == 0]))
        return out

    def near(a, b):
        used = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in used) / len(used) if used else 1.0

    text = lambda f: ".".join("-" if h is None else f"{h:08x}" for h in f)
    prints = [fingerprint(t) for *_, t in docs]
    out = []
    for i, (_, _, d, t) in enumerate(docs):
        j = (i + 1) % len(docs)
        m = len(t) // 3
        edited = t[:len(t) - m] + docs[j][3][:m]
        e = fingerprint(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(prints[i]), text(e), near(prints[i], e), near(prints[i], prints[j])))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"wé{i}" for i in range(300)]
    pick = lambda k: " ".join(vocab[min(299, int(rnd.expovariate(0.02)))] for _ in range(k))
    rows = [(rnd.randrange(-10**12, 10**12), pick(rnd.randrange(1, 200))) for _ in range(n)]
    rows += [(1, rows[0][1]), (2, rows[0][1].upper()), (3, None), (4, ""), (5, " \n"), (6, "solo"), (None, "null id text"), rows[3], rows[3],
             (7, pick(8000)), (8, "a"), (8, "b other")]
    rnd.shuffle(rows)
    return rows


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS pid", "'x' AS head", "3 AS th")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(queries.op10_imatch(spark, str(tmp_path))) == brute(rows)


def test_tiny_tables(spark):
    for rows in ([(5, "only one document here")], [(1, "x"), (2, "y")], [(None, None)]):
        assert as_rows(I.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert I.compare_with_edits(empty).count() == 0 == I.fingerprint_documents(empty).count()


def test_equal_texts_have_equal_fingerprints(spark):
    rows = corpus(2)
    got = {}
    for doc, text in rows:
        got.setdefault(text or "", set())
    out = I.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r.doc_id: r.fingerprint for r in out.collect() if r.doc_id not in (8, None)}
    for doc, text in rows:
        if doc in by:
            got[text or ""].add(by[doc])
    assert all(len(v) <= 1 for v in got.values())
