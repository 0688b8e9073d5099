"""Filter audit against counting every order by hand."""

import random
import re
from itertools import permutations

import pytest

from stockflow.llm import filter_audit as A
from stockflow.llm import queries


def brute(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks = []
    for d, text, part in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(ws) < 100:
            fails.add("A")
        if 100 * len(set(ws)) < 80 * len(ws):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if any((x or "") == t and i is not None and (d is None or i < d) for i, x, _ in rows):
            fails.add("E")
        masks.append((part or "", fails, d in good, d in toxic))
    want = []
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        out = []
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone, left = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                fail = sum(f in m[1] for m in mine)
                out.append((part, "".join(order), i + 1, len(left), len(gone), fail - len(gone), sum(m[1] == {f} for m in mine),
                            sum(m[2] for m in gone), sum(m[3] for m in gone)))
        want += [(*r, shapley[r[1][r[2] - 1]]) for r in out]
    return sorted(want)


def corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \n", "a", "word " * 200, "Ünïcode é " * 60, "|", "ABC def " * 70, " ".join(f"w{i}" for i in range(150))]
    texts += [" ".join(rnd.choice(["Foo", "bar%", "baz", f"w{rnd.randrange(400)}", f"W{rnd.randrange(400)}"][rnd.randrange(2):]) for _ in range(rnd.randrange(40, 240)))
              for _ in range(20)]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(120)]
    # Rows without an id, repeated rows, a text with null ids only, copies in several parts, a very long text.
    rows += [(None, texts[9], "en"), (None, texts[9], "de"), (None, "only without an id", "en"), (None, "only without an id", "en"),
             rows[5], rows[5], (900, "x y" * 100_000, "en"), (901, "x y" * 100_000, "de")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (5000, 1, 1)]
    rnd.shuffle(rows)
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows, labels = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    docs = docs.selectExpr("*", "1 AS did", "2 AS digest", "3 AS mask", "4 AS n", "5 AS quality", "6 AS salt")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "7 AS n", "8 AS part")
    got = sorted(map(tuple, A.audit_documents(docs, marks).collect()))
    assert got == brute(rows, labels)


def test_query(spark, tmp_path):
    rows, labels = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op11_filter_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_documents(none, marks).count() == 0
    one = spark.createDataFrame([(1, "a b", None)], none.schema)
    got = A.audit_documents(one, marks).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.part for r in got} == {""}


def test_diagram_keeps_counts_through_swaps():
    rnd = random.Random(4)
    counts = {m: (rnd.randrange(9), rnd.randrange(3)) for m in range(64) if rnd.random() < 0.5}
    diagram = A.Diagram(counts, 6, width=2)
    for _ in range(30):
        order = rnd.sample(range(6), 6)
        diagram.reorder(order)
        left = counts
        for f, (removed, kept) in zip(order, diagram.steps(), strict=True):
            gone, left = {m: c for m, c in left.items() if m >> f & 1}, {m: c for m, c in left.items() if not m >> f & 1}
            total = lambda x: tuple(sum(c[i] for c in x.values()) for i in range(2))
            assert (removed, kept) == (total(gone), total(left))
        # Equal nodes are one, and no node is out of use.
        assert all(len(set(level)) == len(level) for level in diagram.levels)


def test_neighbouring_orders():
    orders = list(A.plain_changes(5))
    assert len(set(orders)) == 120
    for a, b in zip(orders, orders[1:], strict=False):
        differ = [i for i in range(5) if a[i] != b[i]]
        assert len(differ) == 2 and differ[1] == differ[0] + 1
