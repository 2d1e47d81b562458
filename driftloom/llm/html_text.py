"""Main text of web pages: the maximum-scoring run of words and tags, with weights from labelled pages."""

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^<>]*>?|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_ATTR = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")

# HTML's elements without content, elements whose content is no text, elements that begin and end blocks, and
# elements within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PHRASE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold a whole article by their definition.
ROOTS = frozenset(("article", "main"))
#: The element of labelled pages that only marks main text.
MARKER = "x-main"
#: Made pages that the weights are learned from; pages' different tags that a task remembers.
LABELLED, REMEMBERED = 400, 20_000


def tokens(page: str):
    """(kind, name, text): kind is text, open, close; comments, declarations and raw elements' contents are left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        t = m.group()
        if t[0] != "<" or len(t) == 1:
            yield "text", "", t
            continue
        if t.startswith("<![CDATA["):
            yield "text", "", t[9:].removesuffix("]]>")
            continue
        if not (name := _NAME.match(t)):
            continue
        name = name.group(1).lower()
        if t[1] == "/":
            yield "close", name, t
            continue
        yield "open", name, t
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])|\\Z", re.I).search(page, at)
            at = end.start()


def features(tag: str, name: str, parent: str, inside: bool) -> tuple[str, ...]:
    """What an element says of its words: its name, its parent's, its class and id names whole and in parts (apart for
    those inside an article), its role, and whether it is unseen."""
    if name == MARKER:
        return ()
    out = [f"t:{name}", f"b:{'' if parent == MARKER else parent}>{name}"]
    if len(tag) > len(name) + 2:
        attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(tag[len(name) + 1 :])}
        for n in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
            out.append(f"n:{n}")
            for part in _PART.findall(n):
                out += [f"w:{part}", f"i:{part}"] if inside else [f"w:{part}"]
        if role := attrs.get("role", "").lower():
            out.append(f"r:{role}")
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
            out.append("hidden")
    return tuple(out)


def parse(page: str, value=features, zero=()) -> list[tuple]:
    """(name, words, text, value, inside, unit, main) of each token, in order; name is empty of words, text None of tags.

    value: the sum of value(tag, name, parent's name, inside) over the elements around it. inside: whether an article or
    main element is among them. unit numbers the stretches of one line of text: all but phrases' tags without names end
    them. main is what data-main marks in labelled pages, else None."""
    out, stack, open_names, unit = [], [], Counter(), 0  # of the stack: name, value, inside, breaks, main

    def leave():
        nonlocal unit
        gone = stack.pop()
        open_names[gone[0]] -= 1
        unit += gone[3]
        return gone

    for kind, name, t in tokens(page):
        if kind == "text":
            _, held, inside, _, main = stack[-1] if stack else ("", zero, False, True, None)
            text = html.unescape(t)
            out.append(("", len(text.split()), text, held, inside, unit, main))
        elif kind == "open":
            if name in BLOCK and any(s[0] == "p" for s in stack[-4:]):  # a block ends an open paragraph
                while leave()[0] != "p":
                    pass
            if name in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == name:
                leave()
            parent, held, inside, _, main = stack[-1] if stack else ("", zero, False, True, None)
            held = held + value(t, name, parent, inside)
            inside = inside or name in ROOTS
            breaks = name not in PHRASE or " class=" in t or " id=" in t or " role=" in t
            unit += breaks
            if mark := re.search(r"data-main=[\"']([01])", t):
                main = mark.group(1) == "1"
            out.append((name, 0, None, held, inside, unit, main))
            if name not in VOID and not t.endswith("/>"):
                stack.append((name, held, inside, breaks, main))
                open_names[name] += 1
        else:
            _, held, inside, _, main = stack[-1] if stack else ("", zero, False, True, None)
            if open_names[name]:
                while (last := leave())[0] != name:
                    pass
                _, held, inside, _, main = last
            unit += name not in PHRASE
            out.append((name, 0, None, held, inside, unit, main))
    return out


@dataclass
class Weights:
    """What labelled pages teach. words: of each feature, what it adds to the log-odds of the words under it to be main
    text; outside: what standing outside articles adds where most words stand inside; tags: the scores of tags of main
    text, by name, all negative ("" is a tag that no page has); gap: the most that a stretch between words of positive
    score can cost."""

    words: dict[str, float]
    bias: float = 0.0
    outside: float = 0.0
    tags: dict[str, float] = field(default_factory=lambda: {"": -0.5})
    gap: float = 16.0

    def __post_init__(self):
        self.seen: dict[tuple, float] = {}

    def of(self, tag: str, name: str, parent: str, inside: bool) -> float:
        key = (tag, parent, inside)
        if (found := self.seen.get(key)) is None:
            found = sum(self.words.get(f, 0.0) for f in features(tag, name, parent, inside))
            if len(self.seen) < REMEMBERED and len(tag) < 200:
                self.seen[key] = found
        return found

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}


def _beside(items: list[tuple], odds: list[float]) -> bool:
    """Whether of a page's words of positive log-odds most stand in article or main elements, the others beside them."""
    return sum(x[1] if x[4] else -x[1] for x, odd in zip(items, odds) if x[2] is not None and odd > 0) > 0


def scored(page: str, w: Weights) -> tuple[list[tuple], list[float], list[bool]]:
    """A page's tokens, each one's score, and whether it is a word of positive score.

    A word scores its log-odds of being main text, within 3 to both sides; the words of one line of text share their
    sign. A stretch of words of negative score and tags costs gap at most, all of it at its first token."""
    items = parse(page, w.of, 0.0)
    odds = [w.bias + x[3] for x in items]
    away = w.outside if _beside(items, odds) else 0.0
    word = [0.0 if x[2] is None else x[1] * min(3.0, max(-3.0, odd + (0.0 if x[4] else away))) for x, odd in zip(items, odds)]
    lines: dict[int, float] = {}
    for x, s in zip(items, word):
        if x[2] is not None:
            lines[x[5]] = lines.get(x[5], 0.0) + s
    kept = [x[2] is not None and lines[x[5]] > 0 for x in items]
    scores, at = [0.0] * len(items), -1  # at: where the stretch that costs began
    for k, (x, s) in enumerate(zip(items, word)):
        if kept[k]:
            scores[k] = abs(s)
            at = k if not s and at < 0 else -1 if s else at
            continue
        if at < 0:
            at = k
        scores[at] = max(-w.gap, scores[at] + (w.tags.get(x[0], w.tags[""]) if x[2] is None else -abs(s)))
    return items, scores, kept


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the first contiguous run of the greatest sum, in one pass; empty if none is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, found = run, (start, k + 1)
    return found


def chosen(items: list[tuple], kept: list[bool], low: int, high: int) -> str:
    """The blocks of the words of positive score in items[low:high], white space made single, joined by two line ends."""
    blocks, now = [], []
    for (name, _, text, _, _, _, _), good in zip(items[low:high], kept[low:high]):
        if text is not None:
            if good:
                now.append(text)
        elif name in BLOCK:
            blocks.append("".join(now))
            now = []
        elif name == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(b for x in blocks if (b := " ".join(x.split())))


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of a page: the words of positive score of its best run of tokens, block by block; empty if there are
    none. What stands within the run and scores negative, such as an advert between two paragraphs, is left out."""
    items, scores, kept = scored(page or "", weights)
    return chosen(items, kept, *best_run(scores))


def token_f1(found: str, true: str) -> float:
    """The F1 of the words found, as a bag, against the true ones; 1 if both are empty."""
    a, b = Counter(found.split()), Counter(true.split())
    if not a or not b:
        return float(a == b)
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values()))


def true_text(page: str) -> str:
    """The main text that a labelled page marks."""
    items = parse(page, lambda *_: 0, 0)
    return chosen(items, [bool(x[6]) for x in items], 0, len(items))


def _regress(texts) -> tuple[dict[str, float], float]:
    """Weights of features and a bias: a logistic regression of (features, main, words), by Newton's method."""
    rows: Counter = Counter()
    for held, main, n in texts:
        rows[tuple(sorted(held)), bool(main)] += min(n, 10)
    seen = Counter(f for held, _ in rows for f in set(held))
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n > 1), 1)}
    x, y, mass = np.zeros((len(rows), len(names) + 1)), np.zeros(len(rows)), np.zeros(len(rows))
    x[:, 0] = 1.0
    for k, ((held, main), n) in enumerate(rows.items()):
        y[k], mass[k] = main, n
        for f in held:
            if f in names:
                x[k, names[f]] += 1.0
    w, keep = np.zeros(x.shape[1]), np.append(1e-3, np.full(len(names), 2.0))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (p - y)) + keep * w
        bend = (x * (mass * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x
        w -= np.linalg.solve(bend + np.diag(keep), slope)
    return {f: float(w[k]) for f, k in names.items()}, float(w[0])


@lru_cache(maxsize=4)
def learn_weights(count: int = LABELLED, seed: int = 1) -> Weights:
    """Weights from the labelled pages of labelled_pages(count, seed).

    Features' weights are a logistic regression's, over the pages' texts (by Newton's method, with a squared penalty);
    a tag's is its log-odds of lying in main text, less a half, at most -0.05; gap is of some sizes the one with the best
    mean token F1 on the same pages."""
    pages = labelled_pages(count, seed)
    parsed = [parse(p) for p in pages]
    words, bias = _regress((held, main, n) for items in parsed for _, n, text, held, _, _, main in items if n)
    again = []
    for items in parsed:  # once more, with what stands beside articles
        away = ("outside",) if _beside(items, [bias + sum(words.get(f, 0.0) for f in x[3]) for x in items]) else ()
        again += [(held + (() if within else away), main, n) for _, n, _, held, within, _, main in items if n]
    words, bias = _regress(again)
    inside, beside = (Counter(x[0] for items in parsed for x in items if x[2] is None and bool(x[6]) == main) for main in (True, False))
    total_in, total_out = sum(inside.values()), sum(beside.values())
    odds = {k: math.log((inside[k] + 0.5) / (total_in + 1)) - math.log((beside[k] + 0.5) / (total_out + 1)) for k in inside | beside}
    found = Weights(words, bias, words.pop("outside", 0.0), {**{k: min(v - 0.5, -0.05) for k, v in odds.items()}, "": -0.5})
    truth = [true_text(p) for p in pages]

    def quality(gap: float) -> float:
        found.gap = gap
        return sum(token_f1(main_text(p, found), t) for p, t in zip(pages, truth))

    found.gap = max((0.5, 1.0, 2.0, 4.0, 16.0, 64.0), key=quality)
    return found


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the HTML, with text and n_chars (its code points).

    Null or empty HTML gives an empty text, and so does a page without words of positive score. Truncated and badly nested
    pages are read as far as they go; a page without any tag is one block. Repeated rows are read alike, an empty table
    gives an empty result, columns of pages named text or n_chars are replaced."""
    weights = learn_weights()
    own = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [main_text(t, weights) for t in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*(F.col(f"`{c}`") for c in own)).schema]
    return pages.select(*(F.col(f"`{c}`") for c in [*own, html_col])).mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
