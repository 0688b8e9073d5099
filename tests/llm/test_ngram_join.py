"""Similarity join against brute force over all pairs."""

import random
import re

import pytest

from stockflow.llm import ngram_join as J
from stockflow.llm import queries


def shingle_set(text, k):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1)))


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = set()
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in by[x] if j > i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.add((s, sets[j]) if s != sets[j] else None)
                root[find(j)] = find(i)
    ids = [J.NO_ID if d is None else d for d, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), J.NO_ID), ids[i])
    want = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if sets[i] else ids[i]
        want.append((d, len(sets[i]), None if c == J.NO_ID else c))
    return sorted(want, key=str), len({frozenset(x) for x in links - {None}})


def corpus(seed):
    """Copies, near copies at and around the threshold, chains, a passage that
    all share, tiny texts, hot near-copy group."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    common = text(30)
    docs = []
    for _ in range(12):
        base = text(rnd.choice([5, 12, 40, 120]))
        docs.append(base)
        for _ in range(rnd.randrange(6)):
            d = list(base)
            for _ in range(rnd.randrange(4)):
                d[rnd.randrange(len(d))] = rnd.choice(vocab)
            docs.append(d)
    hot = text(150)
    for _ in range(60):
        d = list(hot)
        for _ in range(rnd.randrange(6)):
            d[rnd.randrange(len(d))] = rnd.choice(vocab)
        docs.append(d)
    chain = text(100)
    for _ in range(8):
        chain = list(chain)
        chain[rnd.randrange(100)] = rnd.choice(vocab)
        docs.append(chain)
    docs += [common + text(rnd.randrange(5)) for _ in range(15)] + [text(60) + common for _ in range(10)]
    docs += [["a"], ["A"], ["a", "b"], ["a", "b", "c", "d"], ["B", "a"], ["a", "b", "c"]]
    rnd.shuffle(docs)
    rows = [(i * 3 + 1, "  ".join(d).replace("w1", "W1") if i % 2 else "\n".join(d)) for i, d in enumerate(docs)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (None, rows[3][1]), (None, "lonely text of a null id that nothing else has"),
             rows[7], rows[7], (6000, " ".join(text(9000)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (4, 85, 3)])
def test_components_equal_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.selectExpr("*", "1 AS c", "2 AS n", "'x' AS h", "0 AS did")
    got = J.component_ids(J.ngram_join(df, J.JoinSpec(k, percent))).select("doc_id", "n_shingles", "component_id").collect()
    want, _ = brute(rows, k, percent)
    assert sorted(map(tuple, got), key=str) == want


def test_all_links_equal_brute_force(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    joined = J.ngram_join(df, J.JoinSpec(4, 85), connected_only=False)
    want, links = brute(rows, 4, 85)
    assert joined.links.count() == links
    assert sorted(map(tuple, J.component_ids(joined).select("doc_id", "n_shingles", "component_id").collect()), key=str) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.component_ids(J.ngram_join(df)).count() == 0


def test_query(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_ngram_join(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85)[0]


def test_query_counts_every_link(spark, tmp_path, monkeypatch):
    rows = corpus(6)
    sets = {shingle_set(t, 4) for _, t in rows} - {frozenset()}
    links = {s: sum(s != t and 100 * len(s & t) >= 85 * len(s | t) for t in sets) for s in sets}
    assert max(links.values()) >= 20
    want = sorted(((d, links.get(shingle_set(t, 4), 0)) for d, t in rows), key=str)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # The group of near copies in one block, and over many.
    for block in (J.BLOCK, 7):
        monkeypatch.setattr(J, "BLOCK", block)
        got = queries.op9_ngram_join(spark, str(tmp_path)).select("doc_id", "class_links").collect()
        assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("columns", [3, 4096])
def test_blocks_of_sets(columns):
    import numpy as np

    rnd = random.Random(7)
    x, y = ([{h for h in range(40) if rnd.random() < 0.9} for _ in range(n)] for n in (6, 9))
    flat = lambda sets: (np.array([len(s) for s in sets]), np.array([h for s in sets for h in sorted(s)], np.int64))
    near = lambda s, t: 100 * len(s & t) >= 85 * len(s | t)
    a, b = J._linked(flat(x), flat(y), False, 85, columns)
    assert a.tolist() == [sum(near(s, t) for t in y) for s in x] and b.tolist() == [sum(near(s, t) for s in x) for t in y] and a.any()
    a, _ = J._linked(flat(y), flat(y), True, 85, columns)
    assert a.tolist() == [sum(i != j and near(s, t) for j, t in enumerate(y)) for i, s in enumerate(y)]


def test_one_survivor_whatever_the_ids(spark):
    rnd = random.Random(8)
    words = [[f"w{rnd.randrange(500)}" for _ in range(120)] for _ in range(4)]
    near = lambda d, i: " ".join([*d[:i], "other", *d[i + 1:]])
    rows = [(None, near(words[0], 3)), (None, near(words[0], 90)), (7, near(words[1], 5)), (7, near(words[1], 60)), (7, near(words[1], 60)),
            (None, " ".join(words[2])), (7, " ".join(words[3])), (9, near(words[3], 8))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in J.keep_one(df, J.JoinSpec(5, 80)).collect()]
    groups = [rows[:2], rows[2:5], rows[5:6], rows[6:7]]
    assert len(got) == 4 and all(sum(r in g for r in got) == 1 for g in groups)


def outliers(seed):
    """Near copies of one text, half of them linked to it and half just too far from it and from each other."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]

    def edited(times):
        d = list(base)
        for i in rnd.sample(range(4, 296), times):
            d[i] = f"x{rnd.random()}"
        return " ".join(d)

    return [(i, edited(1 if i % 2 else 7 + i % 3)) for i in range(80)]


@pytest.mark.parametrize("hot", [2, 10_000])
def test_pairs_of_near_copies_are_made_once(spark, monkeypatch, hot):
    """A pair was made at nearly every shingle it shares beyond the rarest ones."""
    rows, made = outliers(9), []
    meetings = J.meetings
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "meetings", lambda *a: made.append(J.cut(meetings(*a), "made")) or made[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.component_ids(J.ngram_join(df, J.JoinSpec(5, 80))).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 80)[0]
    pairs, distinct = made[0].count(), made[0].distinct().count()
    assert pairs <= 1.5 * distinct
    assert distinct < 400 if hot == 2 else distinct > 600


def test_signatures_of_hot_shingles_lose_no_link(spark, monkeypatch):
    rows = corpus(10)
    monkeypatch.setattr(J, "HOT", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    joined = J.ngram_join(df, J.JoinSpec(4, 85), connected_only=False)
    want, links = brute(rows, 4, 85)
    assert joined.links.count() == links
    assert sorted(map(tuple, J.component_ids(joined).select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
