"""Operators against plain Python, and odd inputs."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken
from tokenizers import Tokenizer

from rollscale.llm import (
    bytepair,
    classifier,
    exact,
    htmltext,
    lines,
    neardup,
    packing,
    personal,
    rules,
    substrings,
    words,
)

SPACES = " \t\n\x0b\x0c\r"
RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = vocabularies.path("word_bpe_49k.json")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_packing_is_a_round_trip(request, which):
    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = collections.Counter(
        (d, tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (1,))
        for d, t in pairs(docs)
    )
    pieces = packing.pack(docs, WORD_BPE).collect()
    assert all(p.offset == 0 and p.length & (p.length - 1) == 0 for p in pieces)
    assert all(p.length <= 2048 and len(p.ids) == 4 * p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    got, ids, at = collections.Counter(), b"", 0
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        assert p.start == at
        ids, at = ids + p.ids, at + p.length
        if at == p.doc_tokens:
            got[p.doc_id, tuple(np.frombuffer(ids, "<u4").tolist())] += 1
            ids, at = b"", 0
    assert got == want
    crc = {r.sequence_id: r.ids_crc32 for r in packing.digest(packing.pack(docs, WORD_BPE)).collect()}
    assert crc == {p.sequence_id: zlib.crc32(p.ids) for p in pieces}


def test_packing_of_letters_that_normalise_to_marks(spark):
    text = "VERGİ, ALİ! ALİ क\u095e, \u092b\u093c, ש\ufb2a! Élan, ÉTÉ. stra\u00dfe; Word, word?"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = sorted(packing.pack(docs, WORD_BPE).collect(), key=lambda p: p.start)
    got = np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist()
    assert got == [*Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_byte_pairs_equal_the_library(request, which):
    docs = request.getfixturevalue(which)
    ranks = {t: i for i, t in enumerate(bytepair.read_ranks(RANKS))}
    library = tiktoken.Encoding(
        "own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = collections.Counter()
    for d, t in pairs(docs):
        ids = np.array(library.encode_ordinary(t), "<u4")
        want[d, len(ids), sha(ids.tobytes()), sha(t)] += 1
    got = bytepair.digest(docs, RANKS, vocabularies.PATTERN).collect()
    assert collections.Counter(map(tuple, got)) == want
    encoded = bytepair.encode(docs, RANKS, vocabularies.PATTERN)
    back = bytepair.decode(encoded, RANKS, vocabularies.PATTERN).collect()
    assert collections.Counter((r.doc_id, bytes(r.data).decode()) for r in back) == (
        collections.Counter(pairs(docs))
    )


def test_byte_pairs_in_odd_spacing():
    ranks = bytepair.read_ranks(RANKS)
    codec = bytepair.Codec(bytepair.serialise(ranks), vocabularies.PATTERN)
    library = tiktoken.Encoding(
        "own",
        pat_str=vocabularies.PATTERN,
        mergeable_ranks={t: i for i, t in enumerate(ranks)},
        special_tokens={},
    )
    odd = [" a", "a ", "a  b", "a \n b", "it's 'll", "\x1c x\x85y", "​z \xa0", "é́ 漢字"]
    got = [np.frombuffer(i, "<u4").tolist() for i in codec.encode(odd)]
    assert got == [library.encode_ordinary(t) for t in odd]
    assert base64.b64decode(base64.b64encode(codec.decode(codec.encode(["ß"])[0]))) == "ß".encode()


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            twice = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(digits[::-1])]
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(twice) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s[2] for s in sorted(out)]


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_personal_base_spans(request, which):
    docs = request.getfixturevalue(which)
    want = collections.Counter((d, sha(",".join(base_spans(t)))) for d, t in pairs(docs))
    got = personal.find(docs).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        told = r.spans.split(",") if r.spans else []
        assert sum(s.startswith("email:") for s in told) == r.n_email


def test_personal_data_is_masked(spark, odd, documents):
    secret = "t0k3n4f5a6b7c8d9e0f1a2b3c4d5e6f7a8b9c0d1"
    rows = [(900 + i, f'call me. token = "{secret}{i}" ok') for i in range(20)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    masked = {r.doc_id: r.text for r in personal.mask(docs).collect()}
    assert all(secret not in masked[d] for d, _ in rows)
    for d, t in pairs(documents):
        if not base_spans(t) and "token" not in t:
            assert masked[d] == t
        assert not base_spans(masked[d])
    out = personal.mask(odd)
    assert out.columns == odd.columns
    assert [r.text for r in out.collect() if r.doc_id == 2] == [None]


#: Numbers next to each other, parted by spaces; each is a number of its own.
ADJACENT = [
    ["7536784127813050", "4845168114407329"],
    ["123-45-6789", "987-65-4321", "111-22-3333"],
    ["555-123-4567", "555-123-4568"],
    ["(555) 123-4567", "(555) 123-4568", "(555) 123-4569"],
    ["4111 1111 1111 1112", "4242 4242 4242 4243"],
    ["4111-1111-1111-1112", "123-45-6789", "555-123-4567"],
    ["3782 822463 10006", "3714 496353 98432"],
    ["01 23 45 67 89", "01 23 45 67 98"],
    ["030 1234567", "4111 1111 1111 1112", "040 7654321"],
    ["1234567", "2345678", "3456789", "4567890"],
    ["555 1234", "555 1235", "555 1236"],
    ["+15551234567", "4111111111111112"],
    ["4111111111111112 123", "4242424242424243 456"],
    ["3704 0044 0532 0130 00"],
]


def test_adjacent_numbers_are_candidates(spark):
    rows = [(i, " ".join(numbers) + " 2nd") for i, numbers in enumerate(ADJACENT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in personal.detect(docs).collect():
        spans = [(s.start, s.end) for s in r.base] + [(s.start, s.end) for s in r.more]
        assert [r.text[a:b] for a, b in sorted(spans)] == ADJACENT[r.row.doc_id]


def test_adjacent_numbers_are_masked(spark, documents):
    lists = [" ".join(n) for n in ADJACENT[:6]]
    rows = [(900 + i, f"Call or pay with card: {t}\nthen go on.") for i, t in enumerate(lists)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    want = {(900 + i, n) for i, numbers in enumerate(ADJACENT[:6]) for n in numbers}
    told = {r.doc_id: r.spans for r in personal.find(docs).collect() if r.doc_id >= 900}
    text = dict(rows)
    got = set()
    for d, spans in told.items():
        for s in spans.split(","):
            _, a, b = s.split(":")
            got.add((d, text[d][int(a) : int(b)]))
    assert got == want
    masked = {r.doc_id: r.text for r in personal.mask(docs).collect()}
    assert all(n not in masked[d] for d, n in want)


@pytest.mark.parametrize("limits", [(3000, 4096), (3, 3)])
@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_near_duplicates(request, monkeypatch, which, limits):
    monkeypatch.setattr(neardup, "LEAF", limits[0])
    monkeypatch.setattr(neardup, "CHUNK", limits[1])
    docs = request.getfixturevalue(which)
    sets = []
    for d, t in pairs(docs):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets.append((d, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else ()))
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    want = collections.Counter()
    for i, (d, s) in enumerate(sets):
        same = [e for j, (e, _) in enumerate(sets) if find(j) == find(i) and e is not None]
        least = (min(same) if same else None) if s else d
        want[d, len(s), least, d == least if s else True] += 1
    got = neardup.assign(docs, width=4).collect()
    assert collections.Counter(map(tuple, got)) == want


@pytest.fixture
def templated(spark):
    """300 sets of one group that share 70 of 85 members, at about 0.7, and 20 pairs of them at 0.9.
    Keys, sets by key, rows, sizes."""
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    shared, sets = new(70), []
    for i in range(280):
        sets.append(np.concatenate([shared, new(15)]))
        if i < 20:
            sets.append(np.concatenate([sets[-1][:-4], new(4)]))
    sets = {neardup._key(np.sort(s)): np.sort(s) for s in sets}
    rows = [(bytearray(b"g"), bytearray(k), bytearray(s.tobytes())) for k, s in sets.items()]
    rows = spark.createDataFrame(rows, "group binary, key binary, payload binary")
    keys = list(sets)
    want = {frozenset(keys[2 * i : 2 * i + 2]) for i in range(20)}
    return rows, want


def test_near_duplicate_leaves_are_bounded(spark, templated, monkeypatch):
    rows, want = templated
    monkeypatch.setattr(neardup, "CHUNK", 30)
    held, compare = [], neardup._compare

    def spy(dealt, *args):
        name = "bucket" if "bucket" in dealt.columns else "leaf"
        held.append(max(r["count"] for r in dealt.groupBy(name).count().collect()))
        return compare(dealt, *args)

    monkeypatch.setattr(neardup, "_compare", spy)
    sizes = spark.createDataFrame([(bytearray(b"g"), 10)], "group binary, chunks long")
    found = neardup.links(rows, neardup._by_set, 0.8, 4, sizes).collect()
    assert {frozenset([bytes(r.a), bytes(r.b)]) for r in found} == want
    assert len(held) == 2 and max(held) <= 4 * 30


def test_near_duplicate_filter_leaves_similar_sets_together(spark, templated):
    rows, want = templated
    sizes = spark.createDataFrame([(bytearray(b"g"), 10)], "group binary, chunks long")
    finer, chunks = neardup.filtered(rows, sizes, 0.8)
    groups = collections.defaultdict(set)
    for r in finer.collect():
        groups[bytes(r.group)].add(bytes(r.key))
    assert {frozenset(g) for g in groups.values()} == want
    assert {(bytes(r.group), r.chunks) for r in chunks.collect()} == {(g, 1) for g in groups}


def test_near_duplicate_stage_keeps_one_row_each(odd):
    out = neardup.deduplicate(odd)
    assert out.columns == odd.columns
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert kept == {1: 1, 2: 1, None: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_lines(request, which):
    docs = request.getfixturevalue(which)
    top = 2**63
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = collections.defaultdict(set)
    rows = pairs(docs)
    for d, t in rows:
        for line in t.split("\n"):
            holders[line.strip(SPACES).translate(upper)].add(top if d is None else d)
    want = collections.Counter()
    for d, t in rows:
        own = t.split("\n")
        stay = [
            x
            for x in own
            if len(k := x.strip(SPACES).translate(upper)) < 10
            or len(holders[k]) < 2
            or min(holders[k]) == (top if d is None else d)
        ]
        want[d, "\n".join(stay), len(own), len(own) - len(stay)] += 1
    assert collections.Counter(map(tuple, lines.deduplicate(docs).collect())) == want


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
@pytest.mark.parametrize("window", [5, 35])
def test_repeats(request, which, window):
    docs = request.getfixturevalue(which)
    rows = [(d, t.encode().split()) for d, t in pairs(docs)]
    seen = collections.Counter(
        tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1)
    )
    want = collections.Counter()
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        stay = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        want[d, stay, len(w), sum(gone)] += 1
    got = substrings.remove_repeats(docs, window).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_rolling_and_squeezed_values():
    x = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for width in (1, 2, 3, 18, 35, 50, 51):
        want = []
        for i in range(50 - width + 1):
            value = 0
            for j in range(width):
                value = (value * (words.STEP | 1) + int(x[i + j])) % 2**64
            want.append(value)
        assert words.rolling(x, width).tolist() == words.mix(np.array(want, np.uint64)).tolist()
    for kind in (np.uint32, np.uint64):
        values = np.sort(x.astype(kind))
        assert words.unsqueeze(words.squeeze(values), kind).tolist() == values.tolist()


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_rule_counts(request, which):
    docs = request.getfixturevalue(which)
    want = collections.Counter()
    for d, t in pairs(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        own = [x for x in t.split("\n") if x.strip(SPACES)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
             len(own) - len(set(own)), len(hit), failed] += 1
    got = rules.judge(docs).collect()
    columns = [*rules.COUNTS[:5], "base_failed"]
    assert collections.Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_rules_and_classifier_on_held_out_labels(spark):
    directory = "/root/testdata/sf0.01"
    labels = {
        r.doc_id: r.quality for r in spark.read.parquet(f"{directory}/labels.parquet").collect()
    }
    scored = classifier.query(spark, directory).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    part = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in part) / len(part) > 0.95
    judged = [r for r in rules.query(spark, directory).collect() if not r.base_failed]
    part = [(int(r.kept), labels[r.doc_id]) for r in judged if r.doc_id in labels]
    assert sum(a == b for a, b in part) / len(part) > 0.95


def test_classifier_reads_one_row_for_each_label(spark, monkeypatch):
    rows = [(i % 6, f"text number {i} of some id") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2, 0) for i in range(6)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = labels.where(~classifier.held_out()).count()
    read = []
    monkeypatch.setattr(classifier, "train", lambda rows, *rest: read.append(len(rows)))
    classifier.fit(docs, labels)
    assert 0 < want and read == [want]


def test_classifier_odd_inputs(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    weights = classifier.fit(odd, labels)
    assert classifier.score(odd, weights).count() == odd.count()
    kept = classifier.accept(odd, weights)
    assert kept.schema == odd.schema and kept.count() <= odd.count()
    assert not classifier.fit(nothing, labels).any()
    assert classifier.score(nothing, weights).count() == 0


@pytest.mark.parametrize("fan_in", [2, 16])
@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_exact_copies(request, which, fan_in):
    docs = request.getfixturevalue(which)
    groups = collections.defaultdict(list)
    for d, t in pairs(docs):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        groups[norm].append((-len(t), d is None, d))
    want = collections.Counter()
    for norm, rows in groups.items():
        first = min(rows, key=lambda r: (r[0], r[1], r[2] or 0))
        for i, r in enumerate(sorted(rows, key=lambda r: r != first)):
            want[r[2], first[2], len(rows), i == 0, sha(norm)] += 1
    got = exact.assign(docs.repartition(5), fan_in).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_exact_stage_keeps_one_row_each(odd):
    out = exact.deduplicate(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 9]
    assert out.count() == 7


@pytest.fixture(scope="module")
def labeller(spark):
    return htmltext.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


PAGE = (
    "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>"
    "<header><p>Tagline of the site here</p></header><nav><a href='/'>Home</a></nav>"
    "<article><h1>The title</h1><p>First &amp; <b>bold</b>\n text, long enough to be a part.<p>"
    "Second one follows here, with a few more words in it.</p></article>"
    "<div class='comments'><p>Great work, thanks for this.</p></div>"
    "<footer>&copy; 2024 someone</footer></body></html>"
)


def test_html_main_text(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p<<a <b>x"), (None, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(pages, labeller).collect()}
    want = (
        "The title\n\nFirst & bold text, long enough to be a part.\n\n"
        "Second one follows here, with a few more words in it."
    )
    assert got[1] == want and got[None] == want and got[2] == "" and got[3] == ""
    assert htmltext.extract(pages.where("false"), labeller).count() == 0
    assert not htmltext.fit(pages.where("false")).trained


@pytest.mark.parametrize(
    "before",
    [
        "<datalist id=x><option value=A><option value=B></datalist>",
        "<select><option>A<option>B<optgroup><option>C</select>",
        *(f"<{t}>" for t in "button select object svg canvas video audio iframe".split()),
        "<button>One <button>Two</button>",
        "<object><param name=a>",
        "<p>A <svg><path d=x><g></g></svg></p>",
    ],
)
def test_html_after_silent_elements(before):
    page = f"<body><div>{before}</div>{before}<article><p>Kept text.</p></article>"
    for after in ("", "<button>Later</button><video>x</video><object>x</object><svg></svg>"):
        got = [b.text for b in htmltext.blocks(page + after + "</body>")]
        assert [t for t in got if t not in ("A", "One")] == ["Kept text."]


def test_html_keeps_formulas_and_silences_inside():
    page = (
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <button><div>Buy</div></button>"
        "<svg><g><text>no</text></g></svg>it.</p><template><article>no</article></template>"
        "<select><option>a<option>b</select><p>End"
    )
    assert [b.text for b in htmltext.blocks(page)] == ["Let x=2 be it.", "End"]


WRAPPERS = [
    ("<body class='has-sidebar'>", ""),
    ("<body class='single-post comments-open'>", ""),
    ("<body><div class='main-content with-sidebar'>", "</div>"),
    ("<body><div class='no-banner'>", "</div>"),
    ("<body><form id=f action=x>", "</form>"),
]


def test_html_names_of_wrappers_and_inner_notices():
    for start, end in WRAPPERS:
        page = htmltext.blocks(
            f"<html>{start}<nav>Menu</nav><article><p>Text<div class=notice>Note</div><p>More"
            f"</article><footer><div class=content>Foot</div></footer>{end}</html>"
        )
        assert [(b.text, htmltext.judged(b.path)) for b in page[1:]] == [
            ("Text", 1), ("Note", 0), ("More", 1), ("Foot", 0)
        ], start
        assert htmltext.judged(page[0].path) == 0


def test_html_main_text_in_wrappers(spark, labeller):
    page = lambda a, b: PAGE.replace("<body>", a).replace("</body>", b + "</body>")
    rows = [(i, "u", page(a, b)) for i, (a, b) in enumerate(WRAPPERS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in htmltext.extract(pages, labeller).collect():
        # A header inside an element named as main text belongs to it, as a title may.
        text = r.text.removeprefix("Tagline of the site here\n\n") if r.page_id == 2 else r.text
        assert text.startswith("The title\n\nFirst & bold text") and "Great" not in text


def test_html_on_held_out_pages(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in htmltext.extract(pages, labeller).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = "".join(htmltext.html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert "".join(texts[r.page_id].split()) == want


@pytest.mark.parametrize("stage", [exact.deduplicate, neardup.deduplicate])
def test_dedup_keeps_columns_of_any_type(odd, nothing, stage):
    from pyspark.sql import functions as F

    def with_map(docs):
        return docs.withColumn("extra", F.create_map(F.lit("a"), F.col("n_chars")))

    got = stage(with_map(odd))
    assert got.dtypes == with_map(odd).dtypes
    assert [r.doc_id for r in got.where("doc_id = 3").collect()] in ([3], [])
    assert got.count() == stage(odd).count() > 0
    assert stage(with_map(nothing)).collect() == []


def test_near_copies_without_an_id_do_not_multiply(spark):
    """Many near copies under one id, or none, are read once each for their full sets."""
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None if k % 2 else 5, f"{text} end{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    each = neardup.sketches(docs, 5)
    wanted = each.select("doc_id", "print", "key", F.col("key").alias("group"))
    assert neardup.full_sets(docs, wanted, 5).count() == 60
    got = neardup.assign(docs, width=5).collect()
    assert len(got) == 60 and {r.component_id for r in got} == {5}
