"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit distances."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BASE_B, mix, segment_hashes, string_bytes, word_hashes
from .simhash import slices

#: Edits allowed as a share of an item's words; of fewer than five words, none.
EDITS = 0.2
#: Repetitions of the LSH, and symbols of the embedding that one repetition samples.
REPEATS, SAMPLED = 40, 4
#: Words of the windows that are compared at once, and bytes of text that are hashed at once.
WINDOW_WORDS, TEXT_BYTES = 1 << 20, 1 << 19
#: Characters of items that one pass over the documents holds.
BLOCK_CHARS = 8 << 20


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of letters and digits; any non-ASCII character counts as one), and each
    text's first word."""
    data, offsets = string_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    inside = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.append(False, inside[:-1]) if len(data) else inside
    after = np.append(inside[1:], False) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return word_hashes(data, starts, ends) | np.uint64(1), np.searchsorted(starts, offsets)  # 0 stands for no word


def words_in_parts(texts) -> tuple[np.ndarray, np.ndarray]:
    """As words_of(), but the arrays that hold a number for each byte are made for a part of the texts at once."""
    parts = [words_of(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", TEXT_BYTES)]
    if len(parts) < 2:
        return parts[0] if parts else words_of(texts)
    start = np.cumsum([0, *(len(words) for words, _ in parts)])
    return np.concatenate([words for words, _ in parts]), np.concatenate([*(first[:-1] + at for (_, first), at in zip(parts, start)), start[-1:]])


def allowed(n: int, share: float) -> int:
    return int(share * n)


class Items:
    """What a pass over the documents needs of a block of items."""

    def __init__(self, ids: list, texts: list[str], share: float = EDITS, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 7):
        hashes, first = words_of(pa.array([t or "" for t in texts], pa.string()))
        own = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        keep = [k for k, w in enumerate(own) if len(w)]
        self.ids, self.words = [ids[k] for k in keep], [own[k] for k in keep]
        self.share, self.repeats, self.sampled, self.seed = share, repeats, sampled, seed
        # k edits cut an item of n words into k + 1 runs at most, so one of at least (n - k) / (k + 1) words is whole.
        # Places that share no such run with an item are too far from it for any window, and none is embedded there.
        seeds: dict[int, list] = {}
        for k, w in enumerate(self.words):
            e = allowed(len(w), share)
            run = -(-(len(w) - e) // (e + 1))
            h = segment_hashes(w, np.arange(len(w) - run + 1), np.arange(len(w) - run + 1) + run, BASE_B)
            seeds.setdefault(run, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.seeds = {}
        for run, parts in seeds.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[run] = (h[order], item[order], at[order], bits)
        self.tables = {}
        for n in sorted({len(w) for w in self.words}):
            members = [k for k, w in enumerate(self.words) if len(w) == n]
            keys = self.keys(np.stack([self.words[k] for k in members]))
            order = np.argsort(keys, axis=None, kind="stable")  # a key tells its repetition
            self.tables[n] = (np.array(members), keys.ravel()[order], order // self.repeats)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, repeats) LSH keys of equally long windows.

        Each repetition walks the window at random (CGK): step j writes the word it stands on and moves on if a bit drawn
        for the step and the word says so. The key is made of the words at sampled steps of the 3 n
        (of one word, all three)."""
        count, n = windows.shape
        padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1)
        rng = np.random.default_rng(self.seed + n)
        out = np.empty((count, self.repeats), np.uint64)
        rows = np.arange(count)
        for r in range(self.repeats):
            salts = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            steps = np.sort(rng.choice(3 * n, min(self.sampled, 3 * n), replace=False))
            at, key = np.zeros(count, np.int64), np.full(count, np.uint64(r + 1))
            take = set(steps.tolist())
            for j in range(int(steps[-1]) + 1):
                word = padded[rows, at]
                if j in take:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
                at = np.minimum(at + (((word ^ salts[j]) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64), n)
            out[:, r] = key
        return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of a (m, n) and b (m, n), of words."""
    m, n = a.shape
    place = np.arange(n + 1)
    row = np.broadcast_to(place, (m, n + 1)).copy()
    for i in range(n):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - place, axis=1) + place
    return row[:, n]


def leaks_in(texts, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, first word of the window, distance) of the best window of each text for each item within the edits."""
    words, first = words_in_parts(texts)
    counts = np.diff(first)
    spans = []
    for run, (table, item, offset, bits) in items.seeds.items():
        n = np.maximum(counts - run + 1, 0)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
        h = segment_hashes(words, at, at + run, BASE_B)
        maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(table, h[maybe]), np.searchsorted(table, h[maybe], side="right")
        hits = high - low
        where = np.repeat(maybe, hits)
        entry = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        text = np.searchsorted(first, at[where], side="right") - 1
        spans.append(np.stack([text, item[entry], at[where] - first[text] - offset[entry]]))
    none = np.zeros(0, np.int64)
    if not spans or not (spans := np.unique(np.concatenate(spans, axis=1), axis=1)).size:
        return none, none, none, none
    lengths = np.array([len(w) for w in items.words])
    found = []
    for n in np.unique(lengths[spans[1]]).tolist():
        edits = allowed(n, items.share)
        text, _, shift = spans[:, lengths[spans[1]] == n]
        # Item-sized windows around the shared runs: a window within the edits starts at most that far away.
        spread = np.arange(-edits, edits + 1)
        windows = np.unique(np.stack([np.repeat(text, len(spread)), (shift[:, None] + spread).ravel()]), axis=1)
        windows = windows[:, (windows[1] > -n) & (windows[1] < counts[windows[0]])]
        members, known, owner = items.tables[n]
        at_once = max(1, WINDOW_WORDS // n)
        for k in range(0, windows.shape[1], at_once):
            w = windows[:, k : k + at_once]
            place = w[1][:, None] + np.arange(n)
            inside = (place >= 0) & (place < counts[w[0]][:, None])
            body = np.where(inside, words[np.where(inside, first[w[0]][:, None] + place, 0)], np.uint64(0))
            keys = items.keys(body)
            low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
            row, rep = np.nonzero(high > low)
            if not len(row):
                continue
            hits = (high - low)[row, rep]
            entry = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low[row, rep], hits)
            i, m = np.unique(np.stack([np.repeat(row, hits), owner[entry]]), axis=1)
            distance = np.concatenate([edit_distances(np.stack([items.words[x] for x in members[m[c : c + at_once]]]), body[i[c : c + at_once]]) for c in range(0, len(i), at_once)])
            ok = distance <= edits
            found.append(np.stack([w[0][i[ok]], members[m[ok]], w[1][i[ok]], distance[ok]]))
    if not found:
        return none, none, none, none
    found = np.concatenate(found, axis=1)
    found = found[:, np.lexsort((found[2], found[3], found[1], found[0]))]
    best = np.append(True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1]))
    return tuple(found[:, best])


def item_blocks(items: DataFrame, id_col: str, text_col: str, share: float):
    """The items in blocks of bounded size, however many they are: the documents pass each block in turn."""
    known = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = known.agg(F.sum(F.char_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        if len(rows):
            yield Items([r["id"] for r in rows], [r["text"] for r in rows], share)


def find_leaks(docs: DataFrame, items: DataFrame, share: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item of which the document holds a copy within the edits: id_col, item_id,
    first_word, n_words, distance (of the closest window, the first of equals).

    Words are lower-cased runs of letters and digits. An item of n words is held if a window of n words is at most
    share * n word edits from it; places over a text's end count as edits. An item of fewer
    than five words is held only as it stands. Null or empty texts match nothing. Ids may be of any type; null ids stay null;
    repeated rows are reported each. Without items or documents the result is empty; other columns are ignored. A
    ValueError tells of ids named alike or like a column of the result."""
    if id_col == item_id or {id_col, item_id} & {"first_word", "n_words", "distance"}:
        raise ValueError("the ids' columns need names of their own")
    kinds = (dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id])
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, first_word long, n_words long, distance long"
    item_kind = to_arrow_type(items.schema[item_id].dataType)
    base, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), None
    for block in item_blocks(items, item_id, item_text, share):

        def run(batches, block=block):
            for batch in batches:
                for part in slices(batch, "text"):
                    text, item, at, distance = leaks_in(part.column("text"), block)
                    found = pa.array([block.ids[k] for k in item.tolist()], item_kind)
                    size = np.array([len(block.words[k]) for k in item.tolist()], np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(text)), found, pa.array(at), pa.array(size), pa.array(distance)], [id_col, item_id, "first_word", "n_words", "distance"])

        got = base.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, share: float = EDITS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a copy of an item; nothing is shuffled. See find_leaks()."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in item_blocks(items, item_id, item_text, share):

        def run(batches, block=block):
            for batch in batches:
                for part in slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[leaks_in(part.column(text_col), block)[0]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, fields)
    return docs
