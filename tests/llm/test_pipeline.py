"""Every stage of the pipeline against a brute-force version on its own input."""

import random
from collections import Counter

import numpy as np
import pytest
import tokenizers

import corpus_pipeline as P
from stockflow.llm import mixing, pii, queries, toxicity
from tests.llm.test_ngram_join import shingle_set
from tests.llm.test_pii import card, valid_card

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(2000)]
    cards = [valid_card(rnd) for _ in range(5)]
    docs, labels = [], []
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(15, 150))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["vilthorn", "snerkish", "muckling"])
        if rnd.random() < 0.2:
            words.insert(3, rnd.choice(cards))
        text = " ".join(words)
        docs.append((i, text, "en", f"src{min(i % 7, 3)}"))
        labels.append((i, 1, int(toxic)))
        if rnd.random() < 0.3 and len(words) > 60:
            words[5] = "changed"
            docs.append((1000 + i, " ".join(words), "en", None))
            docs.append((2000 + i, text, "fr", "src9"))
    docs += [(5000, None, None, None), (5001, "", "en", "src0"), docs[0], docs[0], (None, "a text without id " * 9, "en", "src0")]
    return [(*d, len(d[1] or "")) for d in docs], labels, cards


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def near_groups(texts):
    """Index of the group of each text: links of Jaccard >= 0.8 on 5 words."""
    sets, root = [shingle_set(t, 5) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, _ = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    at, out = spark.read.parquet(f"{root}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, at, root).write.parquet(f"{root}/out{i}")
        out.append((at, at := spark.read.parquet(f"{root}/out{i}")))
    return root, out


def test_stage_columns(stages):
    for (_, after), (name, _) in list(zip(stages[1], P.STAGES, strict=True))[:-1]:
        assert after.columns == COLUMNS, name


def test_toxicity(spark, stages):
    before, after = stages[1][0]
    chain = toxicity.train(before, spark.read.parquet(f"{stages[0]}/labels.parquet"))

    def toxic(text):
        f, p = toxicity.features(np.frombuffer((text or "").encode(), np.uint8)), []
        for w, d, b in zip(chain.weights, chain.earlier, chain.bias, strict=True):
            p.append(toxicity.sigmoid(w[f].sum() + d @ np.array(p) + b))
        return p[-1] >= chain.thresholds[-1]

    want = [r for r in rows(before) if not toxic(r[1])]
    assert Counter(rows(after)) == Counter(want) and 0.6 < len(want) / before.count() < 0.9
    assert not any("vilthorn" in (r[1] or "") for r in rows(after))


def test_near_duplicates(stages):
    before, after = stages[1][1]
    had = sorted(rows(before), key=lambda r: (r[0] is None, r[0] or 0))
    group, kept, want = near_groups([r[1] for r in had]), set(), Counter()
    for g, r in zip(group, had, strict=True):
        if not shingle_set(r[1], 5) or g not in kept:
            want[r] += 1
            kept.add(g)
    assert Counter(rows(after)) == want and after.count() < len(had) - 50


def test_pseudonyms(stages):
    before, after = stages[1][2]
    new = {c: card(c) for c in corpus()[2]}

    def replaced(r):
        text = r[1]
        for a, b in new.items():
            text = text and text.replace(a, b)
        return (*r[:1], text, *r[2:4], None if text is None else len(text))

    assert Counter(rows(after)) == Counter(map(replaced, rows(before)))
    assert pii.ROUNDS >= 8 and not any(c in (r[1] or "") for r in rows(after) for c in new)


def test_source_mix(stages):
    before, after = stages[1][3]
    mix = mixing.mix_sources(before).collect()
    copies = Counter()
    for r in mix:
        copies[r.doc_id] += r.copies
    assert Counter(r[0] for r in rows(after)) == +copies
    assert set(rows(after)) <= set(rows(before)) and max(Counter(rows(after)).values()) <= 2


def test_encode(stages):
    before, after = stages[1][4]
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((r[0], r[3], r[2], tuple(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows(before))
    got = Counter((r.doc_id, r.source, r.lang, tuple(r.ids)) for r in after.collect())
    assert got == want and all(r.n_tokens == len(r.ids) for r in after.collect())


def test_run_and_empty_tables(spark, stages, tmp_path):
    root, out = stages
    key = lambda df: Counter((r.doc_id, r.source, tuple(r.ids)) for r in df.collect())
    assert key(P.run(spark, root)) == key(out[-1][1])
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{root}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_tables_scored_before(spark, tmp_path):
    docs, labels, _ = corpus()
    df = spark.createDataFrame(docs[:150], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = df.selectExpr("*", "'a' AS p_toxic", "2 AS P_low_quality", "3 AS _p_toxic")
    out = P.toxicity_filter(spark, scored, str(tmp_path))
    assert out.columns == scored.columns and {(r.p_toxic, r.P_low_quality, r._p_toxic) for r in out.collect()} == {("a", 2, 3)}
    assert sorted(rows(out), key=str) == sorted(rows(P.toxicity_filter(spark, df, str(tmp_path))), key=str)
