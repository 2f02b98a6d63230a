"""Main text of web pages by a recurrent block labeller (operator 6)."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import in_python, slices, texts

#: Elements that do not end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover none semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: of the first kind it has no tags and runs to
#: the end tag or the end of the page, the others are open elements that silence what is inside.
RAW = frozenset("script style textarea title".split())
SILENT = frozenset(
    "noscript template svg iframe object select option button canvas audio video".split()
)
#: Tags that end open silent elements whose end tag is missing, but for KEPT, which may hold them.
SECTIONS = frozenset("article aside body footer header main nav section".split())
KEPT = frozenset(("noscript", "template"))
#: An opening tag ends an open element of these names.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "button": {"button"},
}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
#: Words in tag, class and id names that mark main text, or anything else, in training pages.
GOOD = "article main content post entry story body-text article-body post-content".split()
BAD = (
    "nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsor "
    "notice cookie consent alert popup modal form search login subscribe newsletter share social "
    "comment comments reply replies discussion related recommended breadcrumb pagination widget "
    "copyright toolbar masthead"
).split()
_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)
#: Parts of names that tell a state of the page, not what an element holds, as first or last part.
STATE_FIRST = frozenset("has with without no not is hide show".split())
STATE_LAST = frozenset("open closed enabled disabled on off visible hidden".split())
#: What stays other text whatever is named inside it.
FIRM_TAGS = frozenset("nav footer aside header".split())
FIRM = frozenset("comment comments reply replies discussion related recommended".split())

PATH, WORDS, PLAIN = 96, 48, 8
SIZE = PATH + WORDS + PLAIN
HIDDEN = 16
#: A fit reads at most so many pages, of at most so many characters, and windows of so many blocks.
PAGES, PAGE_CHARS, STEPS = 240, 1 << 16, 64
EPOCHS, RATE = 8, 0.01

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, the words of its class, id and role, and their parts."""
    out = [tag]
    if "=" in attributes:
        for found in _NAMES.findall(attributes):
            for name in "".join(found).lower().split():
                out.append("." + name)
                out += ["." + p for p in _SPLIT.split(name) if p and p != name]
    return tuple(out)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: path of token tuples, text, and characters inside links."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked = 0
    path: tuple = ()

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
        parts, linked = [], 0

    def close(names, until=()):
        """Ends the innermost open element of these names."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def silent() -> bool:
        return any(t[0] in SILENT for t in stack)

    lasts: dict[str, int] = {}

    def ends(tag: str, at: int) -> bool:
        """Whether an end tag follows; option needs none."""
        if tag not in lasts:
            lasts[tag] = max(
                (m.start() for m in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1
            )
        return tag == "option" or lasts[tag] >= at

    def add(text: str):
        nonlocal linked, path
        if silent():
            return
        if not parts:
            if text.isspace():
                return
            path = tuple(stack)
        parts.append(text)
        if any(t[0] == "a" for t in stack):
            linked += len(text)

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        quiet = silent()
        if m[1]:
            if tag not in INLINE and not quiet:
                flush()
            close({tag}, until=() if tag not in INLINE else ("p", "div", "article", "li", "td"))
            if quiet and tag not in INLINE and tag not in ("button", "svg") and not silent():
                flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            if not quiet:
                flush()
            continue
        if quiet and tag in SECTIONS and not any(t[0] in KEPT for t in stack):
            while silent():
                close(SILENT)
            quiet = False
        if quiet or tag in SILENT:
            if not quiet and tag not in ("button", "svg"):
                flush()
            if tag in ENDS:
                close(ENDS[tag], until=("ul", "ol", "dl", "table", "select", "datalist"))
            if tag not in VOID and not m[3].endswith("/") and (tag not in SILENT or ends(tag, at)):
                stack.append(_tokens(tag, m[3]))
            continue
        if tag == "br" or tag == "wbr":
            if parts:
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                close({"p"}, until=("div", "article", "section", "li", "td", "body"))
            if tag in ENDS:
                close(ENDS[tag], until=("ul", "ol", "dl", "table"))
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(_tokens(tag, m[3]))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _named(element: tuple[str, ...]) -> set[str]:
    """Tag, names and their parts, without names that tell a state."""
    out, at = {element[0]}, 1
    while at < len(element):
        name = element[at].lstrip(".")
        parts = [p for p in _SPLIT.split(name) if p and p != name]
        at += 1 + len(parts)
        if len(parts) < 2 or not (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
            out |= {name, *parts}
    return out


def judged(path: tuple) -> int:
    """1 inside main text, 0 inside anything else that is named, -1 unknown.

    The innermost named element decides, but nothing inside FIRM ones is main text. Names of html
    and body, and a form that holds the page, say nothing.
    """
    state, outer = -1, True
    for element in path:
        tag = element[0]
        if tag in ("html", "body"):
            continue
        names = _named(element)
        if tag == "form" and outer:
            names.discard("form")
        outer = False
        if names & _BAD and not (state == 1 and tag == "header"):
            if tag in FIRM_TAGS or names & FIRM:
                return 0
            state = 0
        elif names & _GOOD:
            state = 1
    return state


@lru_cache(maxsize=1 << 18)
def _place(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(maxsize=1 << 14)
def _path_row(path: tuple) -> tuple[tuple[int, ...], int]:
    return tuple({_place(t, PATH) for element in path for t in element}), judged(path)


def features(page: list[Block]) -> np.ndarray:
    """A row per block: hashed tag path, hashed words, a few shares."""
    x = np.zeros((len(page), SIZE), np.float32)
    for i, b in enumerate(page):
        at, known = _path_row(b.path)
        x[i, list(at)] = 1
        words = b.text.split()
        n = np.bincount([_place(w, WORDS) for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] = n / max(1, len(words)) * 4
        chars = len(b.text)
        x[i, PATH + WORDS :] = (
            np.log1p(chars) / 6,
            np.log1p(len(words)) / 4,
            b.linked / chars,
            (b.text.count(".") + b.text.count(",")) / len(words),
            i / len(page),
            known == 0,
            known == 1,
            len(b.path) / 8,
        )
    return x


class Labeller:
    """Bidirectional LSTM over the blocks of a page, one logit per block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {"v": rng.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)}
            for way in "fb":
                weights["x" + way] = rng.normal(0, 0.1, (SIZE, 4 * HIDDEN))
                weights["h" + way] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
                bias = np.zeros(4 * HIDDEN)
                bias[HIDDEN : 2 * HIDDEN] = 1
                weights["b" + way] = bias
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str):
        """x: batch, step, feature. Steps past a page's end leave the state as it is."""
        steps = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        given = x @ self.w["x" + way] + self.w["b" + way]
        h = np.zeros((len(x), HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        trail = []
        for t in steps:
            z = given[:, t] + h @ self.w["h" + way]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = np.split(gate, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            s = np.tanh(new)
            trail.append((t, h, c, i, f, o, g, s, m))
            h = m * (o * s) + (1 - m) * h
            c = m * new + (1 - m) * c
            out[:, t] = h
        return out, trail

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, way)[0] for way in "fb"], axis=2)
        return both @ self.w["v"] + self.w["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        runs = {way: self._pass(x, mask, way) for way in "fb"}
        both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["v"] + self.w["c"], -30, 30)))
        d = (p - y) * mask / max(1.0, mask.sum())
        out = {"v": np.einsum("bt,bth->h", d, both), "c": d.sum(keepdims=True)[0]}
        for k, way in enumerate("fb"):
            v = self.w["v"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            dwh = np.zeros_like(self.w["h" + way])
            for t, h, c, i, f, o, g, s, m in reversed(runs[way][1]):
                dh = dh + d[:, t : t + 1] * v
                ds = dh * m * o * (1 - s * s) + dc * m
                dz = np.concatenate(
                    [
                        ds * g * i * (1 - i),
                        ds * c * f * (1 - f),
                        dh * m * s * o * (1 - o),
                        ds * i * (1 - g * g),
                    ],
                    axis=1,
                )
                dz_all[:, t] = dz
                dwh += h.T @ dz
                dh = dz @ self.w["h" + way].T + dh * (1 - m)
                dc = ds * f + dc * (1 - m)
            out["h" + way] = dwh
            out["x" + way] = np.einsum("bti,btj->ij", x, dz_all)
            out["b" + way] = dz_all.sum((0, 1))
        return out


def _padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, SIZE), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    y = np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
        if labels is not None:
            y[i, : len(p)] = labels[i]
    return x, mask, y


def _varied(page: list[Block], known: list[int], pool: list[str], rng) -> tuple[list, list]:
    """The page with other names for its parts and with more of what is no main text."""
    good = (("div", "." + rng.choice(GOOD)), ("section", "." + rng.choice(GOOD)), ("div",))
    wrap = {}
    new, labels = [], []
    state = f"{rng.choice(['has', 'with', 'no'])}-{rng.choice(BAD)}"
    state = tuple("." + n for n in (state, *state.split("-")))
    outer = (None, ("body", *state), ("div", *state), ("form",))[rng.integers(4)]

    def wrapped(path):
        """The path with a page wrapper whose names say nothing of the text."""
        if outer is None or ("body",) not in path:
            return path
        at = path.index(("body",))
        inner = () if outer[0] == "body" else (("body",),)
        return (*path[:at], *inner, outer, *path[at + 1 :])

    def renamed(element, label):
        names = {t.lstrip(".") for t in element}
        if names & _GOOD:
            return wrap.setdefault("good", good[rng.integers(3)])
        if names & _BAD:
            return wrap.setdefault(element, ("div", "." + rng.choice(BAD)))
        return element

    def intruder():
        tag = rng.choice(["p", "li", "div", "h3"])
        name = rng.choice(BAD)
        around = (name,) if rng.random() < 0.3 else ("div", "." + name)
        path = (("html",), ("body",))
        if rng.random() < 0.4:
            path += (wrap.get("good", ("article",)),)
        for text in rng.choice(pool, rng.integers(1, 4)):
            words = str(text).split()
            new.append(Block(wrapped((*path, around, (tag,))), " ".join(words[: rng.integers(1, 60)]), 0))
            labels.append(0)

    for b, y in zip(page, known, strict=True):
        if rng.random() < 0.08:
            intruder()
        path = wrapped(tuple(renamed(e, y) for e in b.path))
        new.append(Block(path, b.text, b.linked))
        labels.append(y)
    if rng.random() < 0.5:
        intruder()
    return new, labels


def fit(pages: DataFrame, seed: int = 7) -> Labeller:
    """A labeller trained on pages whose own names say what is main text.

    Reads at most PAGES pages of at most PAGE_CHARS characters, those with the smallest hashes,
    and two variations of each. Without such pages the labeller keeps its starting weights, and
    extract falls back on the names in the page.
    """
    keyed = pages.where(F.length("html").between(1, PAGE_CHARS)).select(
        F.xxhash64("html").alias("hash"), "page_id", "html"
    )
    # Hashes and ids find the pages; only those chosen send their html to the driver.
    chosen = keyed.select("hash", "page_id").distinct().orderBy("hash", "page_id").limit(PAGES)
    chosen = chosen.select(F.col("hash").alias("h"), F.col("page_id").alias("p"))
    same = (F.col("hash") == F.col("h")) & F.col("page_id").eqNullSafe(F.col("p"))
    rows = (
        keyed.join(F.broadcast(chosen), same, "left_semi")  # PAGES rows at most
        .groupBy("hash", "page_id")
        .agg(F.first("html").alias("html"))
        .collect()
    )
    rows.sort(key=lambda r: (r["hash"], r["page_id"] is not None, r["page_id"] or 0))
    rng = np.random.default_rng(seed)
    made = []
    for r in rows:
        page = blocks(r["html"])
        known = [max(0, judged(b.path)) for b in page]
        if any(known):
            made.append((page, known))
    pool = [b.text for page, _ in made for b in page]
    x, y = [], []
    for page, known in made:
        for own, labels in ((page, known), *(_varied(page, known, pool, rng) for _ in range(2))):
            rows_, marks = features(own), np.array(labels, np.float32)
            for at in range(0, len(own), STEPS):
                x.append(rows_[at : at + STEPS])
                y.append(marks[at : at + STEPS])
    model = Labeller(seed=seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            batch = _padded([x[i] for i in some], [y[i] for i in some])
            step += 1
            for k, g in model.gradients(*batch).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    model.trained = bool(x)
    return model


def _choose(model: Labeller | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of similar length share a batch."""
    if model is None:
        return [np.array([judged(b.path) == 1 for b in p], bool) for p in pages]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= 4096:
            end += 1
        some = order[at:end]
        x, mask, _ = _padded([features(pages[i]) for i in some])
        logits = model.logits(x, mask)
        for i, row in zip(some, logits, strict=True):
            out[i] = row[: len(pages[i])] >= 0
        at = end
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url and text of every page: blocks that the labeller calls main text, in order.

    White space inside a block is one space, character references are decoded, blocks are joined
    by two line ends. Null, empty and textless html gives an empty text; broken markup is read
    as far as it goes; repeated rows are read alike; null ids and urls stay null; an empty table
    gives no rows; other columns are unread. A page is labelled whole, whatever its length.
    """
    weights = {k: v.copy() for k, v in model.w.items()} if model.trained else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(weights) if weights else None
        for batch in slices(batches, "html"):
            read = [blocks(t) for t in texts(batch, "html")]
            found = [
                "\n\n".join(b.text for b, yes in zip(page, take, strict=True) if yes)
                for page, take in zip(read, _choose(own, read), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())],
                ["page_id", "url", "text"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )
    return in_python(rows, work, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


SQL = None
