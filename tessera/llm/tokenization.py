"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

The vocabulary file gives the byte string and rank of every token.  From it a
sentencepiece BPE model is serialised directly: each token becomes a piece whose
bytes are mapped to printable characters, with the negative rank as score, so
that the model merges in order of rank; the normaliser is the identity.  Texts
are cut into pre-tokens by the vocabulary's pattern, each distinct pre-token is
encoded by the model once per worker, and decoding maps ids back to bytes.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; whole texts are encoded at any length.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie unless a path is given.
TOKENIZER_DIR = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")

# --- fixed value: the pattern that splits text before the merges -----------------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A worker forgets its pre-tokens when it holds this many (about 200 MB); results do not depend on it.
CACHE_ENTRIES = 400_000
#: A worker passes its rows on when it holds so many ids, so long texts do not pile up.
FLUSH_IDS = 1_000_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def read_ranks(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file, one "base64 rank" a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary.  Piece ids are ranks; the unknown piece comes last."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    model = bytearray()
    for token, rank in by_rank:
        piece = "".join(chars[b] for b in token).encode()
        model += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    model += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # model_type 2: BPE; ids of unknown, begin, end and padding
    model += _field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1))
    # identity: no dummy prefix, white space neither removed nor escaped
    model += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(model)


class Encoder:
    """Encodes and decodes texts with a serialised model."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(PATTERN).findall
        self._map = {b: c for b, c in enumerate(byte_characters())}
        self._unmap = {c: b for b, c in self._map.items()}
        self._known: dict[str, list[int]] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self._known) + len(words) > CACHE_ENTRIES:
            self._known.clear()
        mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self._map) for w in words]
        for w, ids in zip(words, self._sp.encode(mapped, out_type=int, num_threads=1)):
            self._known[w] = ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self._split(text)
        known = self._known
        new = {w for w in words if w not in known}
        if new:
            self._learn([*{*new, *(w for w in words if len(known) + len(new) > CACHE_ENTRIES)}])
            known = self._known
        out: list[int] = []
        for w in words:
            out += known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        chars = "".join(self._sp.id_to_piece(i) for i in ids)
        return bytes(self._unmap[c] for c in chars).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """The encoder of this Python worker, built once per model."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    return column.to_pylist()


def encode_corpus(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of each row.  A map without any shuffle; the model (about 1 MB) is broadcast."""
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))
    kind = dict(documents.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(model.value).encode
        for batch in batches:
            flat: list[int] = []
            offsets, begin = [0], 0
            for n, t in enumerate(_texts(batch.column(1))):
                flat += encode(t)
                offsets.append(len(flat))
                if len(flat) >= FLUSH_IDS or n == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n + 1 - begin), ids], names=[key, "ids"])
                    flat, offsets, begin = [], [0], n + 1

    return documents.select(key, text).mapInArrow(work, f"{key} {kind}, ids array<int>")


def count_tokens(spark: SparkSession, documents: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """All columns but ``text``, with ``n_tokens``.  Only the counts leave the Python workers."""
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))
    others = [c for c in documents.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes if c != text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(model.value).encode
        for batch in batches:
            counts = pa.array([len(encode(t)) for t in _texts(batch.column(len(others)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), counts], names=[*others, "n_tokens"])

    return documents.select(*others, text).mapInArrow(work, f"{schema}, n_tokens long")
