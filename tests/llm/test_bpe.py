"""BPE against the tokenizers library, on adversarial and random texts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def model():
    return bpe.Model(*bpe.read_tokenizer(PATH))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(5)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rnd.shuffle(every)
    yield from ["", " ", "  a  b", "a" * 3000, "ab" * 500, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|",
                "don't we'll I'M 's", "\t\n \r\n\x0b\x0c\x1c\x1d\x85\xa0 x", "é" * 200, "日本語" * 50, "\x00\x01", "..." * 100,
                "1234567890" * 30, "=" * 5000, " " * 1000 + "x", "🙂" * 80]
    for i in range(0, len(every), 9000):
        yield "".join(every[i:i + 3000])
        yield "a".join(every[i + 3000:i + 6000])
        yield " 1".join(every[i + 6000:i + 9000])


def test_matches_the_library(model, library):
    for text in texts():
        ids = list(model.encode(text))
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_random_texts(model, library, text):
    assert list(model.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_cut_places_are_certain(model):
    """Both merge loops agree and fragments concatenate to the uncut result."""
    rnd = random.Random(1)
    for _ in range(300):
        data = bytes(rnd.choice(b"etaoin shr<>=0123\xc3\xa9\xff") for _ in range(rnd.randrange(1, 90)))
        ids = [model.byte_id[b] for b in data]
        whole = model.merge_long(ids)
        assert [i for piece in model.cuts(data) for i in model.merge(piece)] == whole


def test_query_and_edge_rows(spark, tmp_path, library):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "plain text " * 5000, "y"), (1, "a b", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_bpe(spark, str(tmp_path)).collect()
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(empty, PATH, keep=["doc_id"], out_col="DOC_ID")


def test_decode_of_broken_ids(spark, library):
    ids = [[220, 99999, 64], [188, 50], None, [50256]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "k int, ids array<int>")
    got = dict(map(tuple, bpe.decode(df, PATH, keep=["k"]).collect()))
    assert got[1] == library.decode([188, 50], skip_special_tokens=False)
    assert got[2] == "" and got[3] == "<|endoftext|>" and got[0] == library.decode([220, 64])
