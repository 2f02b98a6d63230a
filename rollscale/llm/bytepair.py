"""Byte-level BPE through a serialised sentencepiece model (operator 4)."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rollscale.llm.common import Memo, body, documents, in_python, remembered, slices, texts

#: A byte as a character of the model: letters from U+0100 on, so that no piece has white space.
FIRST_CHAR = 0x100
#: Words whose ids a worker remembers.
MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by id."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


_AS_CHARS = {b: chr(FIRST_CHAR + b) for b in range(256)}


def to_piece(data: bytes) -> str:
    return data.decode("latin-1").translate(_AS_CHARS)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST_CHAR for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is token i as characters, with score -i.

    Field numbers and enum values are those of the public sentencepiece_model.proto. The unknown
    piece comes last, so ids equal ranks. The normaliser is the identity and adds no prefix.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, to_piece(token).encode()) + _field(2, float(-rank)) + _field(3, normal)
        for rank, token in enumerate(vocabulary)
    ]
    pieces.append(
        _field(1, b"<unk>") + _field(2, float(-len(vocabulary))) + _field(3, unknown)
    )
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(vocabulary))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Texts to ids as little-endian unsigned 32-bit bytes, and back."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.blank = regex.compile(r"\s \s*|\s* \s").search
        self.size = self.model.get_piece_size() - 1
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.tokens = [to_bytes(p) for p in pieces]
        #: A pre-token that is in the vocabulary is that token, whatever the merges give.
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.memo = Memo(MEMO)

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit; one call of the model for all of them."""
        split = [[t.encode() for t in self.split(u)] for u in units]
        fresh = list({t for own in split for t in own if t not in self.whole})
        found = {}
        if fresh:
            ids = self.model.encode([to_piece(t) for t in fresh], num_threads=1)
            found = {
                t: np.asarray(own, dtype="<u4").tobytes()
                for t, own in zip(fresh, ids, strict=True)
            }
        whole = self.whole
        return [b"".join([whole.get(t) or found[t] for t in own]) for own in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Where single spaces stand between other characters no pre-token crosses them: such a
        text is put together from its words. Any other spacing goes through the pattern whole."""
        by_word = [
            t.split(" ") if t and not (t[0].isspace() or t[-1].isspace() or self.blank(t)) else None
            for t in texts
        ]
        units = {" " + w for words in by_word if words for w in words[1:]}
        units.update(words[0] for words in by_word if words)
        fresh = self.memo.missing(units)
        self.memo.young.update(zip(fresh, self._units(fresh), strict=True))
        rest = iter(self._units([t for t, words in zip(texts, by_word, strict=True) if not words]))
        get = self.memo.young.__getitem__
        return [
            get(words[0]) + b"".join([get(" " + w) for w in words[1:]]) if words else next(rest)
            for words in by_word
        ]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(model: bytes, pattern: str) -> Codec:
    return remembered(("pairs", model, pattern), lambda: Codec(model, pattern))


def _run(batches: Iterator[pa.RecordBatch], model: bytes, pattern: str, work):
    codec = _codec(model, pattern)
    for batch in slices(batches):
        yield work(codec, batch)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row, null texts as empty.

    An empty text has no ids. Repeated rows and null ids pass through; other columns are unread.
    `ranks` is read on the driver, the model travels with the task.
    """
    model = serialise(read_ranks(ranks))

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec.encode(texts(batch))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]
        )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body().alias("text"))
    return in_python(
        rows, lambda b: _run(b, model, pattern, work), "doc_id long, ids binary"
    )


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table with doc_id and ids."""
    model = serialise(read_ranks(ranks))

    def work(batches):
        codec = _codec(model, pattern)
        for batch in slices(batches, "ids"):
            data = [codec.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"]
            )

    return in_python(encoded.select("doc_id", "ids"), work, "doc_id long, data binary")


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Token counts and hashes of the ids and of what they decode to, without moving either."""
    model = serialise(read_ranks(ranks))

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec.encode(texts(batch))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array(
                    [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string()
                ),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body().alias("text"))
    return in_python(
        rows,
        lambda b: _run(b, model, pattern, work),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return digest(
        documents(spark, sf_dir),
        vocabularies.path("byte_bpe_multi_50k.tiktoken"),
        vocabularies.PATTERN,
    )


SQL = None
