"""Entropy-balanced mix: targets, optimality of rates, rounding, edge rows."""

import math
import random
import re
from collections import defaultdict

import pytest

from stockflow.llm import mixing, queries


def targets(rows, share=1.5, cap=2.0, cycle=(3, 1, 2)):
    """Targets by the contract's own words: share by weight, stop at the cap, reshare the excess."""
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total = share * sum(size.values())
    target, open_, left = {}, set(order), total
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > cap * size[s]} if w else set()
        if not over:
            break
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
        open_ -= over
    for s in open_:
        target[s] = left * weight[s] / w
    return dict(size), target


def corpus(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choice(["b", "a", "Z", "é", "hot", "hot", "hot", None, "tiny" if i % 40 == 0 else "c"])
        rows.append((i, s, "w " * int(rnd.lognormvariate(3, 1.2))))
    return rows + [(900, "void", None), (901, "void", ""), (902, "a", " \n"), rows[0], rows[0], (None, "a", "x y z")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS n", "2 AS size", "'k' AS skey", "0 AS copies")
    got = mixing.mix_sources(df.repartition(5)).collect()
    size, target = targets(rows)
    assert sorted((str(r.doc_id), r.source, r.size) for r in got if r.source) == sorted(
        (str(d), s, len((t or "").split())) for d, s, t in rows if s)
    taken, largest = defaultdict(int), defaultdict(int)
    rates = defaultdict(dict)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        rates[r.source][r.size] = r.rate
    for s in size:
        assert abs(taken[s] - target[s]) <= max(1, 0.1 * largest[s])
        # Rates are exponential in the size below the cap, and meet the target.
        words = sum(r.rate * r.size for r in got if r.source == s)
        assert words == pytest.approx(target[s], rel=1e-6, abs=1e-3)
        slopes = [math.log(x) / k for k, x in rates[s].items() if k and 1e-9 < x < 2 - 1e-9]
        assert not slopes or max(slopes) - min(slopes) < 1e-9
    again = mixing.mix_sources(df.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken, r.rate)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_hot_bin_is_split_by_salt(spark):
    rows = [(i, "s" if i % 3 else "t", "one two three") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    _, target = targets(rows)
    for s in "st":
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 3


def test_apply_mix(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "doc_id % 5 AS copies", "1 AS _k_other")
    mix = mixing.mix_sources(df)
    out = mixing.apply_mix(df, mix)
    assert out.columns == df.columns
    assert out.count() == mix.agg({"copies": "sum"}).first()[0]
    assert set(map(tuple, out.collect())) <= set(map(tuple, df.collect()))


def test_query_and_empty_table(spark, tmp_path):
    rows = corpus(4)
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    out = queries.op2_entropy_mix(spark, f"{tmp_path}/a").collect()
    assert len(out) == len(rows) and out[0].__fields__[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    for n, part in (("b", []), ("c", [(1, None, None)]), ("d", [(1, "s", "a b")])):
        spark.createDataFrame(part, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert queries.op2_entropy_mix(spark, f"{tmp_path}/{n}").count() == len(part)


def test_documents_without_words_stay_once(spark):
    # "a" is at its cap, "b" is not, "c" has no words at all.
    rows = [(i, "a", "one two") for i in range(4)] + [(100 + i, "b", "one " * 50) for i in range(40)]
    rows += [(200, "a", ""), (201, "a", None), (202, "a", " \n"), (203, "b", ""), (204, "c", None), (205, "c", "")]
    got = {r.doc_id: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {got[i].copies for i in range(4)} == {2}
    assert [(got[i].rate, got[i].copies, got[i].taken) for i in range(200, 206)] == [(1.0, 1, 0)] * 6
