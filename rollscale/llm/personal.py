"""Personal data: fixed patterns, and spans that weak labelers and a trained classifier add
(operator 2). DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import body, documents, stored

BASE = ["email", "ip", "card", "phone"]
ADDED = ["number", "secret"]
KINDS = BASE + ADDED
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_GAP, _END = r"[\x20().-]", r"(?![0-9A-Za-z@])"
#: Complete numbers, which end where their shape ends even if more digits follow.
_CARD = [rf"[0-9]{{4}}(?:{s}[0-9]{{4}}){{3}}" for s in (r"\x20", "-")]
_COMPLETE = [
    *_CARD,
    *(rf"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}" for s in (r"\x20", "-")),
    *(rf"[0-9]{{3}}{s}[0-9]{{2}}{s}[0-9]{{4}}" for s in (r"\x20", "-")),
    r"(?:[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)[\x20-]?|\(?[0-9]{3}\)?[\x20.-])[0-9]{3}[\x20.-][0-9]{4}",
    *(rf"0[1-9](?:{s}[0-9]{{2}}){{4}}" for s in (r"\x20", r"\.", "-")),
    r"0[0-9]{1,4}[\x20-][0-9]{5,8}",
    "[0-9]{13,19}",
]
_WHOLE = rf"(?:{'|'.join(_COMPLETE)}){_END}(?![.-][0-9])"
_NEXT = rf"{_GAP}{{1,2}}{_WHOLE}"
#: A card with three digits more, or fewer at the end of a list; none that begin the next number.
_LONG_CARD = "|".join(
    rf"{c}(?!{_NEXT}){s}(?:[0-9]{{3}}|[0-9]{{1,2}}(?!{_NEXT}))"
    for c, s in zip([*_CARD, "[0-9]{13,16}"], (r"\x20", "-", r"\x20"), strict=True)
)
_TIGHT = r"[0-9](?:[().-]{0,2}[0-9]){6,18}"
_SHORT = r"[0-9]{3}\x20[0-9]{4}"
#: Any other run of digits, up to where a complete number starts.
_LOOSE = rf"[0-9](?:(?:[0-9]|[().-]{{1,2}}[0-9]|(?!{_NEXT}){_GAP}{{1,2}}[0-9])){{6,18}}{_END}"
_REST = rf"{_GAP}{{1,2}}[0-9](?:{_GAP}{{0,2}}[0-9]){{0,5}}(?!{_GAP}{{0,2}}[0-9])"
#: One number, the next one left to itself: complete shapes, runs without spaces or of three and
#: four digits before another such, then runs that leave nothing or a number over, then any.
_NUMBER = "|".join(
    [
        rf"(?:{_LONG_CARD}){_END}(?![.-][0-9])",
        _WHOLE,
        rf"\(?{_TIGHT}(?=\x20{{1,2}}\(?{_TIGHT}(?![0-9]))",
        rf"{_SHORT}(?={_GAP}{{1,2}}{_SHORT}(?![0-9]))",
        rf"\(?{_LOOSE}(?!{_REST})",
        rf"\(?{_LOOSE}",
    ]
)
#: The patterns of the kinds. Loops are possessive (they can't give back anything that helps), those
#: of numbers bounded instead, as a number gives back what belongs to the next one; starts only where
#: a run of their first characters starts. So time is linear in any text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": rf"(?<![0-9A-Za-z.+@])\+?(?:{_NUMBER})",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+",
}
#: What a text must have for a pattern to be tried.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
#: Words before a value that speak for it (English, German, French, Spanish).
CUES = (
    "phone|tel|call|mobile|cell|fax|contact|card|visa|account|ssn|passport|iban|id|"
    "telefon|handy|anruf|konto|ausweis|portable|compte|carte|teléfono|llame|cuenta|tarjeta|"
    "password|passwd|pwd|token|secret|key|apikey|credential|kennwort|schlüssel|clave"
)
#: Words before a value that speak against it.
ANTI_CUES = "isbn|issn|order|page|version|year|seite|jahr|année|año|página|commit|sha1|md5|sha256"
FEATURES = 4096
ROUNDS = 40
PRIOR, START_ACCURACY, SMOOTHING, ANCHOR = 0.5, 0.8, 1.0, 0.25
STRIDE = 128


def _positions(found: Column, gaps: Column) -> Column:
    """start, end, value, before and after of each match; gaps are the texts between them.

    Offsets are sums of lengths, added up by blocks of STRIDE matches.
    """
    size = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.length(F.get(gaps, i)) + F.length(F.get(found, i)),
    )
    return F.when(F.size(found) > 0, size).otherwise(F.array().cast("array<int>"))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(kind: str) -> Column:
    """Spans of a kind from the columns found, gaps, size and block of that kind."""
    found, gaps = F.col(f"{kind}.found"), F.col(f"{kind}.gaps")
    size, block = F.col(f"{kind}.size"), F.col(f"{kind}.block")

    def one(value: Column, i: Column) -> Column:
        row = F.floor(i / STRIDE).cast("int")
        inside = F.aggregate(
            F.slice(size, row * STRIDE + 1, i - row * STRIDE), F.lit(0), _add
        )
        start = F.get(block, row) + inside + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
            F.right(F.get(gaps, i), F.lit(40)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(12)).alias("after"),
        )

    return F.when(F.size(found) > 0, F.transform(found, one)).otherwise(
        F.array().cast(
            "array<struct<start:int,end:int,value:string,before:string,after:string>>"
        )
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, s: Column) -> Column:
    """The rule a match must meet besides its pattern."""
    n = F.length(_digits(s["value"]))
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.coalesce((n <= 19) & F.call_function("luhn_check", _digits(s["value"])), F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _votes(kind: str, s: Column) -> Column:
    """What the labelers say of a candidate: 1 for, -1 against, 0 nothing."""
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    n = F.length(_digits(value))

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    if kind == "number":
        shape = vote(
            value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
            value.rlike(r"^(?:19|20)[0-9]{2}[ .-]|^[0-9]{1,3}(?:\.[0-9]{3})+$"),
        )
        length = vote((n >= 9) & (n <= 16), n == 8)
    else:
        shape = vote(
            value.rlike(r"^[0-9a-f]{32,}$") | value.rlike(r"[A-Z].*[a-z]|[a-z].*[A-Z]"),
            value.rlike(r"^[a-z]+[0-9]{1,4}$"),
        )
        length = vote(F.length(value) >= 32, F.length(value) < 24)
    cue = vote(
        before.rlike(rf"(?<!\p{{L}})(?:{CUES})\P{{L}}{{0,6}}$"),
        before.rlike(rf"(?<!\p{{L}})(?:{ANTI_CUES})\P{{L}}{{0,6}}$|[$€£#]\s?$"),
    )
    frame = vote(
        before.rlike("[:=(]\\s?[\"']?$") | (before.rlike("[\"']$") & after.rlike("^[\"']")),
        before.rlike(r"[\p{L}_/]$") | after.rlike(r"^[\p{L}_/%]"),
    )
    return F.array(shape, length, cue, frame)


def _features(kind: str, s: Column) -> Column:
    """Hashed features of the span classifier."""
    value = s["value"]
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[A-Za-z]+", "a")
    parts = [
        F.left(shape, F.lit(16)),
        F.regexp_extract(F.lower(s["before"]), r"(\p{L}+)\P{L}*$", 1),
        F.regexp_extract(s["before"], r"(\P{L}{0,3})$", 1),
        F.left(s["after"], F.lit(1)),
        F.length(value).cast("string"),
        F.length(_digits(value)).cast("string"),
    ]
    return F.array(
        *(
            F.pmod(F.xxhash64(F.lit(f"{kind}{i}"), p), F.lit(FEATURES)).cast("int")
            for i, p in enumerate(parts)
        )
    )


def _sum_before(size: Column):
    return lambda b: F.aggregate(F.slice(size, 1, b * STRIDE), F.lit(0), _add)


def _rule(kind: str):
    return lambda s: _passes(kind, s)


def _span(order: int):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end")
    )


def _candidate(order: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"),
        F.lit(order).alias("kind"),
        s["end"].alias("end"),
        _votes(kind, s).alias("votes"),
        _features(kind, s).alias("features"),
    )


def _weigh(table: Column):
    return lambda total, feature: total + F.get(table, feature)


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row: row (the kept columns as a struct), text, base (sorted spans with their kind's
    order) and more (candidates with votes and features)."""
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), body().alias("text"))
    for kind in KINDS:
        text = F.col("text")
        if kind in SIGNS:
            tried = text.contains(SIGNS[kind])
        elif kind == "card":
            tried = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
        else:
            tried = F.lit(True)
        hit = F.when(tried, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))
        rows = rows.withColumn(f"{kind}_found", F.coalesce(hit, F.array().cast("array<string>")))
    for kind in KINDS:
        found = F.col(f"{kind}_found")
        gaps = F.when(F.size(found) > 0, F.split("text", PATTERNS[kind], -1))
        rows = rows.withColumn(f"{kind}_gaps", gaps)
    rows = rows.select(
        "row",
        "text",
        *(
            F.struct(
                F.col(f"{k}_found").alias("found"),
                F.col(f"{k}_gaps").alias("gaps"),
                _positions(F.col(f"{k}_found"), F.col(f"{k}_gaps")).alias("size"),
            ).alias(k)
            for k in KINDS
        ),
    )
    for kind in KINDS:
        size = F.col(f"{kind}.size")
        block = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(size) - 1) / STRIDE).cast("int")),
            _sum_before(size),
        )
        rows = rows.withColumn(
            kind, F.col(kind).withField("block", F.when(F.size(size) > 0, block))
        )
    base, more = [], []
    for order, kind in enumerate(KINDS):
        spans = _spans(kind)
        if kind in BASE:
            base.append(F.transform(F.filter(spans, _rule(kind)), _span(order)))
        else:
            more.append(F.transform(spans, _candidate(order, kind)))
    rows = rows.select(
        "row",
        "text",
        F.array_sort(F.concat(*base)).alias("base"),
        F.array_sort(F.concat(*more)).alias("found"),
    )
    free = F.filter(
        "found",
        lambda c: ~F.exists(
            "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        ),
    )
    return rows.select("row", "text", "base", free.alias("more"))


@dataclass(frozen=True)
class Model:
    """Log odds of the span classifier, by kind: a bias and a weight per feature."""

    bias: dict[int, float]
    weights: dict[int, dict[int, float]]

    def accepts(self, c: Column) -> Column:
        yes = F.lit(False)
        for kind, bias in self.bias.items():
            table = F.array(
                *(F.lit(self.weights[kind].get(i, 0.0)) for i in range(FEATURES))
            )
            score = F.aggregate(c["features"], F.lit(bias), _weigh(table))
            yes = yes | ((c["kind"] == kind) & (score > 0))
        return yes


def reliabilities(patterns: dict[tuple[int, ...], float]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation over the counts of patterns.

    Unanimous patterns count ANCHOR of all candidates more on either side, so that the classes keep
    their meaning where nearly all candidates are of one kind.
    """
    patterns = dict(patterns)
    for side in (-1, 1):
        unanimous = (side,) * len(next(iter(patterns)))
        patterns[unanimous] = patterns.get(unanimous, 0.0) + ANCHOR * sum(patterns.values())
    odds = math.log(START_ACCURACY / (1 - START_ACCURACY))
    prior = math.log(PRIOR / (1 - PRIOR))
    post = {p: 1 / (1 + math.exp(-prior - odds * sum(p))) for p in patterns}
    total = sum(patterns.values())
    for _ in range(ROUNDS):
        rates = []
        for side in (0, 1):
            weight = {p: n * (post[p] if side else 1 - post[p]) for p, n in patterns.items()}
            mass = sum(weight.values())
            votes = [
                {
                    v: (sum(w for p, w in weight.items() if p[k] == v) + SMOOTHING)
                    / (mass + 3 * SMOOTHING)
                    for v in (-1, 0, 1)
                }
                for k in range(len(next(iter(patterns))))
            ]
            rates.append((math.log((mass + SMOOTHING) / (total + 2 * SMOOTHING)), votes))
        for p in patterns:
            yes, no = (
                share + sum(math.log(votes[k][v]) for k, v in enumerate(p))
                for share, votes in reversed(rates)
            )
            post[p] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
    return post


def train(found: DataFrame) -> Model:
    """Labelers' reliabilities, then a naive Bayes span classifier on the posteriors.

    Only counts by vote pattern (81 a kind) and sums by hashed feature (FEATURES a kind) reach
    the driver, whatever the input.
    """
    seen = found.select(F.explode("more").alias("c")).select("c.kind", "c.votes", "c.features")
    counts = seen.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    bias, weights = {}, {}
    posts = []
    for kind in sorted({r["kind"] for r in counts}):
        patterns = {tuple(r["votes"]): float(r["n"]) for r in counts if r["kind"] == kind}
        post = reliabilities(dict(sorted(patterns.items())))
        posts += [(kind, list(p), q) for p, q in post.items()]
        yes = sum(n * post[p] for p, n in patterns.items())
        no = sum((1 - post[p]) * n for p, n in patterns.items())
        bias[kind] = math.log((yes + SMOOTHING) / (no + SMOOTHING))
        weights[kind] = {}
    if not posts:
        return Model(bias, weights)
    table = found.sparkSession.createDataFrame(posts, "kind int, votes array<int>, p double")
    sums = (
        seen.join(F.broadcast(table), ["kind", "votes"])
        .select("kind", "p", F.explode("features").alias("f"))
        .groupBy("kind", "f")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    mass = {
        k: (
            sum(r["yes"] for r in sums if r["kind"] == k) + SMOOTHING * FEATURES,
            sum(r["no"] for r in sums if r["kind"] == k) + SMOOTHING * FEATURES,
        )
        for k in bias
    }
    for r in sums:
        yes, no = mass[r["kind"]]
        weights[r["kind"]][r["f"]] = math.log(
            (r["yes"] + SMOOTHING) / (r["no"] + SMOOTHING) * no / yes
        )
    return Model(bias, weights)


def spans(found: DataFrame, model: Model) -> DataFrame:
    """Adds `spans`: base spans and the candidates that the classifier accepts, in order."""
    taken = F.transform(
        F.filter("more", model.accepts),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )
    return found.withColumn("spans", F.array_sort(F.concat("base", taken)))


def _told(column: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            column,
            lambda s: F.concat_ws(
                ":",
                F.get(names, s["kind"]),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; n_chars, if there,
    follows the text. Overlapping spans become one. Null texts stay null. The model is trained on
    the same docs; the texts are read twice instead of being kept in between."""
    model = train(stored(detect(docs, ["doc_id"]).select("more"), "candidates"))
    found = spans(detect(docs), model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["at"]
        piece = F.concat(
            F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])
        )
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(apart, F.array_append(a["out"], piece)).otherwise(a["out"]).alias("out"),
        )

    def close(a: Column) -> Column:
        return F.concat(
            F.array_join(a["out"], ""), F.substring("text", a["at"] + 1, F.length("text"))
        )

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, close)).otherwise(
        F.col("text")
    )
    rows = found.select("row", clean.alias("clean"))
    out = []
    for name, kind in docs.dtypes:
        if name == "text":
            out.append(
                F.when(F.col("row.text").isNotNull(), F.col("clean")).cast(kind).alias(name)
            )
        elif name == "n_chars":
            out.append(F.length("clean").cast(kind).alias(name))
        else:
            out.append(F.col("row")[name].alias(name))
    return rows.select(*out)


def find(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans, of every row of docs.

    Base kinds follow fixed patterns, leftmost and without overlap within a kind; offsets count
    code points. Number-like and secret-like candidates outside base spans are voted on by shape,
    length, cue words and framing; expectation-maximisation over vote patterns gives posteriors,
    on which a hashed naive Bayes classifier is trained that decides each candidate. Null and
    empty texts have no spans; repeated rows are judged alike; a null id stays null; an empty
    table gives no rows; only doc_id and text are read.
    """
    found = stored(detect(docs, ["doc_id"]).select("row.doc_id", "base", "more"), "spans")
    rows = spans(found, train(found))

    def count(order: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == order)).cast("long")

    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_told("base"), 256).alias("base_sha256"),
        _told("spans").alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


SQL = None
