"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from stockflow.llm import lexical_search as L
from stockflow.llm import queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in counts for w in c)
    weight = {w: math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for w, d in df.items()}
    want = []
    for item, text in set(items):
        scored = []
        for (d, _), c, x in zip(docs, counts, n, strict=True):
            m = 75 + (25 * x * total) // max(length, 1)
            score = sum(times * weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, times in Counter(terms(text)).items() if w in c)
            if score > 0:
                scored.append((-score, L.NO_ID if d is None else d))
        want += [(item, i + 1, None if d == L.NO_ID else d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(want, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    # A few words are everywhere, most are rare.
    vocab = [f"w{i}" for i in range(300)]
    word = lambda: vocab[min(299, int(rnd.paretovariate(0.7)) - 1)]
    docs = [(i * 7 % 211, " ".join(word() for _ in range(rnd.randrange(1, 80)))) for i in range(211)]
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 40)))) for i in range(30)]
    # Passages of queries, ties, repeated rows and ids, letters beyond ASCII, a very long text.
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(1100 + i, f"x {items[i][1]} y") for i in range(8)]
    docs += [docs[5], docs[5], (None, docs[5][1]), (None, items[2][1]), (2000, None), (2001, ""), (2002, " .,!\n"), (2003, "É é_Ω-Ünï W1!w2\x85z"),
             (2004, " ".join(word() for _ in range(60_000)))]
    items += [(100, None), (101, ""), (102, "...?"), (103, "unknown words only"), (104, "ω Ω É w1 w1 w1 W1"), (None, "w1 w9 w9"),
              (105, "w2 w3 w4"), (105, "w2 w3 w4"), (106, "w5 w50"), (106, "w6 w60"), (107, " ".join(vocab * 3))]
    rnd.shuffle(docs)
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS did", "2 AS n", "3 AS item", "4 AS score"),
            spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS terms", "6 AS times", "7 AS rank"))


@pytest.mark.parametrize("seed,k,first,block,cells", [(1, 20, 8, 400_000, 1 << 21), (2, 3, 1, 400_000, 100), (3, 5, 2, 60, 1 << 21)])
def test_equals_brute_force(spark, monkeypatch, seed, k, first, block, cells):
    docs, items = corpus(seed)
    monkeypatch.setattr(L, "FIRST_TERMS", first)
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "MATCHES", cells)
    got = L.search(*frames(spark, docs, items), k, block_pairs=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, k)


def test_fewer_accumulators_than_matching_documents(spark, monkeypatch):
    """The stop leaves out documents that hold none of the rarest terms."""
    rnd = random.Random(4)
    rare = [f"r{i}" for i in range(30)]
    docs = [(i, " ".join(["the", "of", *rnd.sample(["and", "to", "in"], 2), *(rnd.sample(rare, 12) if i < 40 else [])])) for i in range(400)]
    items = [(0, " ".join(["the", "of", "and", "to", "in", *rare]))]
    made, parts = [], L.Terms.of

    def spy(term, item, weight, n_terms):
        made.append(len(item))
        return parts(term, item, weight, n_terms)

    monkeypatch.setattr(L.Terms, "of", spy)
    got = L.search(*frames(spark, docs, items), 10).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 10)
    # The last two are the terms that create accumulators, and the others: the five words of all documents only update.
    assert made[-1] >= 5 and made[-2] <= 30


def test_query(spark, tmp_path):
    docs, items = corpus(5)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_lexical_search(spark, str(tmp_path))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id string, text string")
    assert L.search(none, items).count() == 0
    assert L.search(none.union(spark.createDataFrame([(1, "a")], none.schema)), items.where("false")).count() == 0
