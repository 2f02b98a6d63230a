"""Packing by power-of-two decomposition (operator 1)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import Memo, body, documents, in_python, remembered, slices, texts

LONGEST = 2048
END_ID = 1
#: Words, and their parts, whose ids a worker remembers.
MEMO = 500_000


class _Kinds(dict):
    """Whether a character is the same kind of character (letter, digit, space, other) in every
    Unicode version of the last twenty years and no space, so that all libraries split it alike."""

    def __missing__(self, c: str) -> bool:
        old, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        self[c] = old != "Cn" and old[0] == now[0] and not c.isspace()
        return self[c]


class Words:
    """Ids of texts, word by word: the vocabulary drops white space and merges nothing over it.

    A word is normalised (NFC, each character lower-cased) and split by the pattern of the
    vocabulary's own pre-tokenizer; its ids are those of the parts, which few words have to
    themselves. Words with a character whose kind has changed are encoded whole by the library, as
    are all words of a vocabulary that is built otherwise.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer)
        self.pattern, rest = _split_rule(json.loads(tokenizer))
        self.parted = Tokenizer.from_str(json.dumps(rest)) if self.pattern else None
        self.words, self.parts, self.kinds = Memo(MEMO), Memo(MEMO), _Kinds()

    def _split(self, text: str) -> list[str] | None:
        if self.pattern is None:
            return None
        if not text.isascii():
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
            if not all(map(self.kinds.__getitem__, text)):
                return None
        elif not text.isprintable():
            return None
        return self.pattern.findall(text.lower() if text.isascii() else text)

    @staticmethod
    def _ids(tokenizer, text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        texts = [word.decode() for word in words]
        split = [self._split(text) for text in texts]
        for part in self.parts.missing({p for own in split if own for p in own}):
            self.parts.young[part] = self._ids(self.parted, part)
        get, known = self.parts.young.__getitem__, self.words.young
        for word, text, own in zip(words, texts, split, strict=True):
            known[word] = self._ids(self.whole, text) if own is None else b"".join(map(get, own))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        self._learn(self.words.missing({w for words in split for w in words}))
        get = self.words.young.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _split_rule(vocabulary: dict):
    """The pattern that splits normalised words, and the vocabulary without its normaliser; no
    pattern unless the vocabulary normalises and splits the way `Words` does."""
    kinds = [n["type"] for n in (vocabulary["normalizer"] or {}).get("normalizers", [])]
    steps = (vocabulary["pre_tokenizer"] or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None, vocabulary
    split, replaced = steps[0], vocabulary["normalizer"]["normalizers"][1]
    spaces = replaced["pattern"] == {"Regex": r"\s+"} and replaced["content"] == " "
    if not spaces or split["behavior"] != "Removed" or not split["invert"]:
        return None, vocabulary
    if steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None, vocabulary
    return regex.compile(split["pattern"]["Regex"]), {**vocabulary, "normalizer": None}


def _words(tokenizer: str) -> Words:
    return remembered(("packing", tokenizer), lambda: Words(tokenizer))


def pieces(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many ids: the document of every piece and its length. Whole sequences
    come first, then the binary digits of the rest, largest first."""
    digits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    many = np.column_stack([totals // longest, (totals[:, None] & digits) > 0]).astype(np.int64)
    sizes = np.tile(np.append(longest, digits), len(totals))
    return (
        np.repeat(np.arange(len(totals)), many.sum(axis=1)),
        np.repeat(sizes, many.reshape(-1)),
    )


def pack(
    docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID
) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, sequence_id, offset and ids.

    A document is its ids and `end_id`; a null or empty text is just that id. Pieces have power of
    two lengths up to `longest`, each piece is a sequence of its own (offset 0), so no sequence
    crosses documents and none needs padding. `length` is the bucket: batches are made of one
    length (see write_buckets). Each row of the input is packed, repeated ids too; a null id stays
    null. sequence_id is the partition's number and a running number, unique within one run of the
    job. No shuffle: nothing depends on other documents, so hot groups and skew do not arise.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = f.read()
    last = np.asarray([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids = [own + last for own in words(texts(batch))]
            totals = np.array([len(own) // 4 for own in ids], np.int64)
            doc, length = pieces(totals, longest)
            ends = np.cumsum(length)
            offsets = np.append(0, 4 * ends).astype(np.int32)
            whole = pa.py_buffer(b"".join(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(ends - length - (np.cumsum(totals) - totals)[doc]),
                    pa.array(length),
                    pa.array(totals[doc]),
                    pa.array(sequence + np.arange(len(doc))),
                    pa.BinaryArray.from_buffers(
                        pa.binary(), len(doc), [None, pa.py_buffer(offsets), whole]
                    ),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids"],
            )
            sequence += len(doc)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body().alias("text"))
    packed = in_python(
        rows,
        work,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, ids binary",
    )
    return packed.withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each sequence length, at most twelve of them."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return digest(pack(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json")))


SQL = None
