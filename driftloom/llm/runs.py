"""Periodic runs of words: Kolpakov and Kucherov's algorithm on each stretch of a text that can hold a run."""

from bisect import bisect_left
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, mix, string_bytes, text_slices, word_hashes, word_spans


@dataclass(frozen=True)
class RunParams:
    """A run has at least least words and exponent times its period (a whole number of 2 or more)."""

    least: int = 6
    exponent: int = 4


class SuffixAutomaton:
    """The suffix automaton of a sequence of small whole numbers; ends holds where each state's strings first end."""

    def __init__(self, word: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [-1]
        last = 0
        for at, letter in enumerate(word):
            new = self._state({}, self.size[last] + 1, 0, at)
            p = last
            while p >= 0 and letter not in self.next[p]:
                self.next[p][letter] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][letter]
                if self.size[q] != self.size[p] + 1:
                    copy = self._state(dict(self.next[q]), self.size[p] + 1, self.link[q], self.ends[q])
                    while p >= 0 and self.next[p].get(letter) == q:
                        self.next[p][letter] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            last = new

    def _state(self, following: dict[int, int], size: int, link: int, end: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(end)
        return len(self.size) - 1


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors (start, end, source): each the longest stretch that also starts earlier, at source (the two
    may overlap), or one letter that is new, with source -1."""
    automaton = SuffixAutomaton(word)
    step, ends = automaton.next, automaton.ends
    out, start, n = [], 0, len(word)
    while start < n:
        state, at, source = 0, start, -1
        while at < n:
            following = step[state].get(word[at])
            if following is None or ends[following] >= at:
                break
            state, at = following, at + 1
            source = ends[state] - (at - start) + 1
        at = max(at, start + 1)
        out.append((start, at, source))
        start = at
    return out


def prefix_lengths(s: list[int]) -> list[int]:
    """For each place of s, how many letters from there equal those from the start (at 0: all)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching_runs(word: list[int], low: int, border: int, high: int, p: RunParams):
    """Main's step: the repetitions (start, end, period) of word[low:high] that cross or touch border, with at least the
    wanted length, a period on one side of it whole, and no longer within word[low:high]."""
    left, right = word[low:border], word[border:high]
    most = (high - low) // p.exponent  # a longer period doesn't fit often enough
    e, least = p.exponent, p.least
    if not most:
        return
    if right:
        ahead = prefix_lengths(right)
        back = prefix_lengths([*left[::-1], -1, *right[::-1], *left[::-1]])
        whole = len(left) + 1 + len(right)  # where the reversed whole of left stands: the suffix of left + right[:q] starts q before
        for q in range(1, min(most, len(right)) + 1):
            before, after = back[whole - q], ahead[q] if q < len(right) else 0
            if before + q + after >= max(least, e * q):
                yield border - before, border + q + after, q
    if left:
        back = prefix_lengths(left[::-1])
        ahead = prefix_lengths([*right, -1, *left, *right])
        whole = len(right) + 1 + len(left)
        for q in range(1, min(most, len(left)) + 1):
            before, after = back[q] if q < len(left) else 0, ahead[whole - q]
            if before + q + after >= max(least, e * q):
                yield border - q - before, border + after, q


def runs_of(word: list[int], p: RunParams = RunParams()) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of word, by start, then period.

    A run that ends in a factor either touches its start, and reaches back less than (exponent * the factor before + the
    factor) / (exponent - 1) letters (else the factor before would have been longer), or touches its end, where the next
    border finds it, or lies inside and is a copy of the run that the factor's source has there."""
    n, e = len(word), p.exponent
    parts = [*factors(word), (n, n, -1)]
    found: dict[int, dict[int, int]] = {}  # start: {end: period}
    before = 0
    for start, end, source in parts:
        low = max(0, start - (e * before + end - start) // (e - 1) - 1)
        for s, t, q in touching_runs(word, low, start, end, p):
            if (s == low and s > 0 and word[s - 1] == word[s - 1 + q]) or (t == end and t < n and word[t] == word[t - q]):
                continue  # goes on: ends in a later factor, and is found at its border
            ends = found.setdefault(s, {})
            ends[t] = min(q, ends.get(t, q))
        if source >= 0:
            shift = start - source
            for s in range(source + 1, source + end - start):
                for t, q in list(found.get(s, {}).items()):
                    if t + shift < end:
                        ends = found.setdefault(s + shift, {})
                        ends[t + shift] = min(q, ends.get(t + shift, q))
        before = end - start
    return sorted((s, t - s, q) for s, ends in found.items() for t, q in ends.items())


def stretches(data: np.ndarray, offsets: np.ndarray, p: RunParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends, each text's first word, and the first and last + 1 words of the stretches that can hold runs.

    In a run of period q and length n, n - q words from its start, and as many to its end, recur q words apart, and
    exponent >= 2 makes the two cover it. n - q is at least width, so each of its words lies in a stretch of width words
    that occurs twice in its text. Words are compared by 64-bit hashes here: a clash can only add a stretch."""
    width = min(max(p.least, p.exponent * q) - q for q in range(1, p.least + 1))
    starts, ends, first = word_spans(data, offsets)
    n = len(starts)
    if n < width:
        none = np.zeros(0, np.int64)
        return starts, ends, first, none, none
    h = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        key = mix(key * np.uint64(BASE_A) + h[k : n - width + 1 + k])
    key = mix(key ^ text[: n - width + 1].astype(np.uint64) * np.uint64(BASE_B))
    whole = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    order = np.argsort(key[whole])
    k = key[whole][order]
    same = k[1:] == k[:-1]
    at = whole[order[np.append(same, False) | np.append(False, same)]]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.cumsum(edge)[:-1] > 0
    bounds = np.zeros(n + 1, bool)
    bounds[first] = True
    a = np.flatnonzero(covered & (np.append(True, ~covered[:-1]) | bounds[:-1]))
    b = np.flatnonzero(covered & (np.append(~covered[1:], True) | bounds[1:])) + 1
    return starts, ends, first, a, b


def find_runs(docs: DataFrame, text_col: str = "text", params: RunParams = RunParams()) -> DataFrame:
    """docs with n_words, runs (array of start, length, period in words, by start, then period) and collapsed_text.

    Words are [^\\x20\\x09-\\x0D]+. collapsed_text is the words joined by one space, without those that any run holds after
    its first period. A null or empty text has no words and no runs; each row stands for itself, whatever its id. Columns
    of docs with the new names are replaced."""
    new = ("n_words", "runs", "collapsed_text")
    own = [c for c in docs.columns if c not in new]
    source = text_col if text_col in own else "_text"
    text_of = docs.select(*(F.col(f"`{c}`") for c in own), *([F.col(f"`{text_col}`").alias("_text")] if source == "_text" else []))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in (piece for whole in batches for piece in text_slices(whole, source)):
            data, offsets = string_bytes(batch.column(source))
            starts, ends, first, a, b = stretches(data, offsets, params)
            raw, texts, found = data.tobytes(), [], []
            owner = np.searchsorted(first, a, side="right") - 1
            for k in range(batch.num_rows):
                words, here, gone = raw[offsets[k] : offsets[k + 1]].split(), [], set()
                for i in range(bisect_left(owner, k), bisect_left(owner, k + 1)):
                    start = int(a[i] - first[k])
                    names: dict[bytes, int] = {}
                    for s, n, q in runs_of([names.setdefault(w, len(names)) for w in words[start : int(b[i] - first[k])]], params):
                        here.append({"start": start + s, "length": n, "period": q})
                        gone.update(range(start + s + q, start + s + n))
                texts.append(b" ".join([w for i, w in enumerate(words) if i not in gone] if gone else words))
                found.append(here)
            columns = [*(batch.column(c) for c in own), pa.array(np.diff(first)), pa.array(found, pa.list_(kind)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*own, *new])
            pa.default_memory_pool().release_unused()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in text_of.schema if f.name in own]
    return text_of.mapInArrow(run, ", ".join([*fields, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed_text string"]))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one text in ten made periodic from some word on, by a rule of its id: the queries' planted runs.

    h = crc32 of the id as text, g = h / 10: if h % 10 = 0, words from a = g % n on repeat with period
    1 + (n - a) / (3 + g % 8). Other texts, null ids and texts without words stay."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(F.col(text_col), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    picked = F.coalesce((h % 10 == 0) & F.col(text_col).isNotNull(), F.lit(False))
    n, g = F.size("_words").cast("long"), F.floor(h / 10).cast("long")
    a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
    p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
    at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    made = F.array_join(F.transform(at, lambda i: F.element_at("_words", (i + 1).cast("int"))), " ")
    out = docs.withColumn("_words", F.when(picked, words)).withColumn("_a", a).withColumn("_p", p)
    return out.withColumn(text_col, F.when(picked & (n > 0), made).otherwise(F.col(text_col))).drop("_words", "_a", "_p")
