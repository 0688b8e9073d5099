"""Hashes of words and windows depend on their content alone."""

import random

import numpy as np
import pyarrow as pa

from stockflow.llm import shingling as S


def data(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_word_hashes_follow_the_words(monkeypatch):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abAB1é語|") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    words = [rnd.choice(vocab) for _ in range(5000)]
    text = "".join(w + rnd.choice([" ", "  ", "\n", "\t\r", "\x0b\x0c "]) for w in words)
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(S, "PIECE", piece)
        h = S.word_hashes(data(text))
        assert len(h) == len(words) and S.words(text) == [w.encode() for w in words]
        assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words, strict=True)))
    fold = str.maketrans("AB", "ab")
    low = S.word_hashes(data(text), lower=True)
    assert (low == S.word_hashes(data(text.translate(fold)))).all()


def test_windows_follow_their_words():
    rnd = random.Random(4)
    words = [rnd.choice("abcd") for _ in range(3000)]
    h = S.word_hashes(data(" ".join(words)))
    for k in (1, 4, 20):
        got = S.windows(h, k).tolist()
        want = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_empty_and_null():
    col = pa.array([None, "", " \n", "x"])
    assert [len(S.shingle_set(S.utf8(x), 4)) for x in col] == [0, 0, 0, 1]
    assert S.shingle_set(data("a b"), 4) != S.shingle_set(data("b a"), 4)
