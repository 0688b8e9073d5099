"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of bytes that stands inside no vocabulary token can never be merged
over, so every place where such a pair occurs is a certain cut. A pre-token
is split at its certain cuts, the fragments are encoded independently and the
ids concatenated. Fragments stay short even for degenerate pre-tokens (very
long runs without white space), and each is encoded once per worker and
cached; a fragment too long for the quadratic merge loop goes through a heap.

Spark deals out the documents; a task handles one Arrow batch at a time and
yields results in bounded slices. The tokenizer file is read on the driver
(its path is a parameter) and broadcast: vocabulary and merges, a size fixed
by the file.

Special tokens of the file found in a text become their ids, as the
tokenizers library does by default. Unicode classes of its regular
expression engine are probed once and replayed, so that pre-tokens agree
even where Unicode versions differ.

Defined results: null text is encoded as empty, null ids decode to the empty
text; ids outside the vocabulary decode to nothing; repeated rows are encoded
alike; an empty table gives no rows. Only the columns named in ``keep`` are
carried along; one that clashes with ``out_col`` raises ValueError.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from stockflow.llm.common import python_path, settled

#: The published pre-token pattern of the byte-level scheme (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker caches before it starts anew, length up to which they are cached, and ids a yielded slice holds at most (one document may exceed it).
CACHE_ENTRIES, CACHE_BYTES, SLICE_IDS = 250_000, 48, 1_000_000
#: Texts below this code point go through the standard regular expressions.
LOW = 0x250
#: Fragments longer than this are merged with a heap.
LONG = 48


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow at U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def char_classes(path: str) -> tuple[dict[str, str], dict[int, str]]:
    """How the library's engine classes characters: the letters, numbers and
    spaces below LOW, and for code points above that the regex module sees
    differently a stand-in of the same class."""
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    marks = {"L": "a", "N": "1", "S": "\t", "O": "!"}

    def one_class(run: str, kind: str) -> bool:
        # After a mark of its class, a run of one class stays in one pre-token.
        return len(split(marks[kind] + run)) == 1

    low = {k: "".join(c for c in map(chr, range(LOW)) if c != " " and one_class(c, k)) for k in "LNS"}
    low["S"] += " "
    odd: dict[int, str] = {}
    points = "".join(chr(c) for c in range(LOW, 0x110000) if not 0xD800 <= c < 0xE000)
    for m in regex.finditer(r"(?P<L>\p{L}+)|(?P<N>\p{N}+)|(?P<S>\s+)|(?P<O>[^\p{L}\p{N}\s]+)", points):
        runs = [m[0][i:i + 512] for i in range(0, len(m[0]), 512)]
        for c in (c for run in runs if not one_class(run, m.lastgroup) for c in run):
            kind = next(k for k in marks if one_class(c, k))
            if kind != m.lastgroup:
                odd[ord(c)] = marks[kind]
    return low, odd


class PreTokens(dict):
    """Ids of pre-tokens, computed on first use and kept up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.model.pre_token(token)
        if len(token) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = ids
        return ids


class Model:
    """Vocabulary, merges and certain cuts of one tokenizer file."""

    def __init__(self, vocab: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int], low: dict[str, str], odd: dict[int, str]):
        import regex

        self.vocab, self.special, self.odd = vocab, special, odd
        self.find_iter = regex.compile(PATTERN).finditer
        self.find = regex.compile(PATTERN).findall
        # Texts of low characters only go through the faster engine, with the classes spelled out.
        spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^LNS]").replace(r"\p{L}", "[L]").replace(r"\p{N}", "[N]").replace(r"\s", "[S]").replace(r"\S", "[^S]")
        self.find_low = re.compile(re.sub(r"(?<=[\[^LN])[LNS]", lambda m: re.escape(low[m[0]]), spelled)).findall
        self.high = re.compile(f"[{chr(LOW)}-\U0010ffff]").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ints = list(range(max(len(vocab), 256)))  # shared objects, so that cached ids take no memory of their own
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(merges)}
        self.made = [ints[c] for *_, c in merges]
        self.byte_id = [0] * 256
        inside = bytearray(65536)
        for i, token in enumerate(vocab):
            if len(token) == 1:
                self.byte_id[token[0]] = ints[i]
            for a, b in pairwise(token):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        self.cache = PreTokens(self)
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, data: bytes) -> list[bytes]:
        """Fragments of ``data`` between its certain cuts."""
        out, start, inside = [], 0, self.inside
        for i in range(1, len(data)):
            if not inside[data[i - 1] << 8 | data[i]]:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def merge(self, data: bytes) -> list[int]:
        """Ids of one fragment: the best-ranked pair, leftmost first, is merged until none is left."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > LONG:
            return self.merge_long(ids)
        get, made, none = self.rank.get, self.made, len(self.rank)
        ranks = [get(a << 20 | b, none) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same in O(n log n): a heap of (rank, place) over a linked list."""
        get, n = self.rank.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def pre_token(self, token: str) -> tuple[int, ...]:
        pieces = self.cuts(token.encode())
        if len(pieces) == 1:
            return tuple(self.merge(pieces[0]))
        out: list[int] = []
        for piece in pieces:
            ids = self.fragments.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece))
                if len(piece) <= CACHE_BYTES:
                    if len(self.fragments) >= CACHE_ENTRIES // 4:
                        self.fragments.clear()
                    self.fragments[piece] = ids
            out += ids
        return tuple(out)

    def split(self, text: str) -> list[str]:
        if not self.high(text):
            return self.find_low(text)
        if self.odd.keys().isdisjoint(map(ord, text)):
            return self.find(text)
        return [text[m.start():m.end()] for m in self.find_iter(text.translate(self.odd))]

    def encode(self, text: str) -> Iterator[int]:
        parts = self.specials.split(text) if self.specials else [text]
        return chain.from_iterable(
            (self.special[p],) if i % 2 else chain.from_iterable(map(self.cache.__getitem__, self.split(p))) for i, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        vocab, n = self.vocab, len(self.vocab)
        try:
            data = b"".join(map(vocab.__getitem__, ids))
        except IndexError:
            data = b"".join(vocab[i] for i in ids if 0 <= i < n)
        return data.decode("utf-8", "replace")


def read_tokenizer(path: str) -> tuple:
    """Arguments of :class:`Model` from a tokenizers JSON file of a byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    to_bytes = lambda token: bytes(alphabet[c] for c in token)
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        vocab[i] = to_bytes(token)
    for content, i in special.items():
        vocab[i] = content.encode()
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[a], ids[b], ids[a + b]))
    return vocab, merges, special, *char_classes(path)


_SHIPPED: dict[tuple[str, str], object] = {}
_MODELS: dict[object, Model] = {}


def _ship(spark: SparkSession, path: str):
    """Broadcast of the tokenizer, one per application and path."""
    python_path(spark)
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHIPPED:
        _SHIPPED[key] = spark.sparkContext.broadcast(read_tokenizer(path))
    return _SHIPPED[key]


def _model(shipped) -> Model:
    """The model of this worker process, kept from task to task."""
    key = shipped._path if hasattr(shipped, "_path") else id(shipped)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*shipped.value)
    return _MODELS[key]


def _schema(df: DataFrame, keep: list[str], out: StructField) -> StructType:
    if out.name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"column {out.name!r} is kept and produced")
    return StructType([*(df.schema[c] for c in keep), out])


def encode(df: DataFrame, path: str, *, text_col: str = "text", keep: list[str], out_col: str = "ids") -> DataFrame:
    """``keep`` columns and the ids (array<int>) of every whole text."""
    import numpy as np
    import pyarrow as pa

    shipped, n = _ship(df.sparkSession, path), len(keep)

    def run(batches):
        model = _model(shipped)
        for batch in batches:
            flat, ends, start = [], [0], 0
            for row, text in enumerate(batch.column(n)):
                text = text.as_py()
                ids = np.fromiter(model.encode(text), np.int32) if text else np.empty(0, np.int32)
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
                if ends[-1] >= SLICE_IDS or row == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(start, row + 1 - start) for c in batch.columns[:n]), lists], [*keep, out_col])
                    flat, ends, start = [], [0], row + 1

    schema = _schema(df, keep, StructField(out_col, ArrayType(IntegerType())))
    return df.select(*[df[c] for c in keep], df[text_col].alias("_text")).mapInArrow(settled(run), schema)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", keep: list[str], out_col: str = "text") -> DataFrame:
    """``keep`` columns and the text of every list of ids."""
    import numpy as np
    import pyarrow as pa

    shipped, n = _ship(df.sparkSession, path), len(keep)

    def run(batches):
        model = _model(shipped)
        for batch in batches:
            lists = batch.column(n)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [model.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*keep, out_col])

    import pyspark.sql.functions as F

    ids = F.coalesce(df[ids_col], F.array().cast("array<int>"))
    schema = _schema(df, keep, StructField(out_col, StringType()))
    return df.select(*[df[c] for c in keep], ids.alias("_ids")).mapInArrow(settled(run), schema)
