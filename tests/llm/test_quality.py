"""Quality measures against brute force; the cascade's order and verdict."""

import random
import re

from pyspark.sql import functions as F

from stockflow.llm import quality as Q
from stockflow.llm import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for w in wins:
        counts[w] = counts.get(w, 0) + 1
    covered = set()
    for i, w in enumerate(wins):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 4, "x " * 17, "x " * 40, "# $ | <a>", "line\nline\n\n \nline", "é語 " * 30, "w " * 30000,
             "\n".join(["same line here"] * 30)]
    for _ in range(120):
        words = [rnd.choice(["aa", "b", "Ccc", "#", "dd|", "e.", "ééé"]) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(rnd.randrange(1, 90))]
        if rnd.random() < 0.4:
            a = rnd.randrange(len(words))
            words += words[a:a + rnd.randrange(20)]
        texts.append(rnd.choice([" ", "\n", " \t"]).join(words) + rnd.choice(["", "\n", " "]))
    texts += [" ".join(f"plain{i * j % 97}" for i in range(40)) + "." for j in range(1, 6)]
    return [(i if i % 50 else None, t) for i, t in enumerate([*texts, texts[20], texts[20]])]


def test_measures_and_base(spark, tmp_path):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS words", "2 AS kept", "3 AS wins")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_quality_cascade(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_verdict_is_the_conjunction_in_any_order(spark):
    rows = [(d, t) for d, t in corpus(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = Q.default_rules()
    every = Q.measures(df)
    for r in rules:
        every = every.withColumn(f"r_{r.name}", F.coalesce(r.rejects, F.lit(False)))
    want = {}
    for r in every.withColumn("b", Q.base_failed()).collect():
        want.setdefault((r.doc_id, r.n_words, r.word_chars), not (r.b or any(r[f"r_{x.name}"] for x in rules)))
    for order in (rules, rules[::-1]):
        got = Q.cascade(df, order).collect()
        assert all(want[r.doc_id, r.n_words, r.word_chars] == r.kept for r in got)


def test_rules_go_by_rejection_per_cost():
    a, b, c = (Q.Rule(n, F.lit(True)) for n in "abc")
    assert [r.name for r in Q.order_rules([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 2.0, 0.9)])] == ["b", "c", "a"]


def test_clean_text_stays_and_junk_goes(spark):
    clean = "It was a bright day in spring, and the people of the town walked along the river to see the boats come home.\n" * 1
    clean += "Children ran ahead of them, while the older ones sat down under trees that had only just begun to show their leaves again."
    junk = " ".join(f"w{i} |" for i in range(60))
    got = {r.doc_id: r.kept for r in Q.cascade(spark.createDataFrame([(1, clean), (2, junk), (3, "ab " * 9 + "same same " * 30)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_empty_table(spark):
    assert Q.cascade(spark.createDataFrame([], "doc_id long, text string")).count() == 0
