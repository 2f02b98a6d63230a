"""Quality rules as weak labelers whose accuracies are estimated (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import SPACE_CHARS, body, documents, in_python, slices, stored, texts

SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = SYMBOLS.encode()
COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_caps n_lines n_unique n_marks n_marked n_bytes".split()
#: A rule votes bad at or beyond the first bound, good at or below the second, else abstains.
#: Each is a share computed from the counts of a document.
RULES = {
    "symbols_per_word": (0.10, 0.03),
    "marks_per_byte": (0.09, 0.06),
    "marked_words": (0.30, 0.20),
    "repeated_words": (0.20, 0.05),
    "repeated_lines": (0.30, 0.10),
    "capital_words": (0.50, 0.15),
    "word_length_off": (0.50, 0.25),
    "missing_variety": (0.75, 0.55),
    "short": (0.80, 0.40),
}
#: Bytes that are no marks: letters of any script, digits and white space.
PLAIN = bytes([*b"0123456789", *SPACE_CHARS.encode(), *range(0x41, 0x5B), *range(0x61, 0x7B)])
PLAIN += bytes(range(0x80, 0x100))
ROUNDS = 50
PRIOR, START_ACCURACY, SMOOTHING, ANCHOR = 0.85, 0.85, 2.0, 0.05


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    data = text.encode()
    words = data.split()
    marks = data.translate(None, PLAIN)
    lines = [line for line in text.split("\n") if line.strip(SPACE_CHARS)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE_CHARS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        sum(map(bytes.isupper, words)),
        len(lines),
        len(set(words)),
        len(marks),
        sum(w[-1] in SYMBOL_BYTES or w[-2:] == b"!!" for w in words),
        sum(map(len, words)),
    )


def counts(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = zip(*map(measure, texts(batch)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", *COUNTS],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return in_python(rows, work, ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]))


def votes(measured: DataFrame) -> DataFrame:
    """Adds votes: one -1, 0 or 1 per rule. A document without words abstains everywhere."""

    def share(top: str, of: str) -> F.Column:
        return F.expr(f"CASE WHEN {of} > 0 THEN {top} / {of} END")

    values = {
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_byte": share("n_marks", "n_bytes"),
        "marked_words": share("n_marked", "n_words"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "capital_words": share("n_caps", "n_words"),
        "word_length_off": F.abs(F.ln(share("word_chars", "n_words") / 5.5)),
        "missing_variety": 1 - share("n_unique", "least(n_words, 200)"),
        "short": F.expr("CASE WHEN n_words > 0 THEN 40 / (40 + n_words) END"),
    }
    return measured.withColumn(
        "votes",
        F.array(
            *(
                F.when(values[rule] >= bad, -1).when(values[rule] <= good, 1).otherwise(0)
                for rule, (bad, good) in RULES.items()
            )
        ),
    )


def fit(patterns: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Posterior probability of good quality of each vote pattern, by expectation-maximisation.

    Each rule has a chance of voting good, bad or nothing under either class; rules vote
    independently given the class. Counts are smoothed, so no rule is ever certain. Unanimous
    patterns count ANCHOR of all documents more on either side, so that the classes keep their
    meaning in a corpus that is nearly all good.
    """
    seen = len(patterns)
    unanimous = np.stack([np.ones(len(RULES), int), -np.ones(len(RULES), int)])
    patterns = np.concatenate([patterns, unanimous])
    times = np.append(times, [ANCHOR * times.sum()] * 2)
    good, bad = patterns == 1, patterns == -1
    agree = np.log(START_ACCURACY / (1 - START_ACCURACY)) * (good.sum(1) - 2.0 * bad.sum(1))
    posterior = 1 / (1 + np.exp(-np.log(PRIOR / (1 - PRIOR)) - agree))
    kinds = np.stack([good, bad, ~(good | bad)], 2).astype(float)
    for _ in range(ROUNDS):
        score = []
        for weight in (posterior * times, (1 - posterior) * times):
            rate = np.einsum("p,prk->rk", weight, kinds) + SMOOTHING
            rate /= rate.sum(1, keepdims=True)
            prior = (weight.sum() + SMOOTHING) / (times.sum() + 2 * SMOOTHING)
            score.append(np.log(prior) + np.einsum("prk,rk->p", kinds, np.log(rate)))
        posterior = 1 / (1 + np.exp(np.clip(score[1] - score[0], -500, 500)))
    return posterior[:seen]


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, quality (posterior probability) and kept for every row of docs.

    Rules vote or abstain; the number of documents of each vote pattern (at most 3 ^ rules of them,
    whatever the input) goes to the driver, where expectation-maximisation finds each rule's
    accuracy; a pattern's posterior decides. base_failed: fewer than 50 words, or more than half of
    the words in repeated three-word windows; such documents are never kept. A null or empty text
    has no words, so it fails. Repeated rows are judged alike, a null doc_id stays null, an empty
    table gives no rows, other columns are unread.
    """
    voted = stored(votes(counts(docs)), "votes")
    seen = voted.groupBy("votes").agg(F.count("*").alias("times")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in seen], int).reshape(-1, len(RULES))
    quality = fit(patterns, np.array([r["times"] for r in seen], float))
    table = voted.sparkSession.createDataFrame(
        [(r["votes"], float(q)) for r, q in zip(seen, quality, strict=True)],
        "votes array<int>, quality double",
    )
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return voted.join(F.broadcast(table), "votes").select(
        "doc_id",
        *COUNTS,
        "votes",
        "quality",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= threshold)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", *COUNTS[:5], "base_failed", "kept"
    )


SQL = None
