"""SimHash near-dedup: fingerprints, tiled exact comparison, components."""

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import materialise, mix, runs, shuffle_parts, string_bytes, word_spans
from .components import components

#: Fingerprints of a tile, at about: a task compares two tiles; shingles whose bits are counted at once; bytes of text taken at once.
TILE, CHUNK, SLICE = 8192, 131072, 4 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE):
    """The batch in runs of rows of at most limit bytes of text, or of one row."""
    col = batch.column(text)
    _, offsets = string_bytes(col)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each starts and ends in that."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - 1
    at = to - sizes
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    np.subtract.at(inside, ends, 1)
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    blank = np.zeros(len(out), bool)
    blank[to] = True
    out[~blank] = data[mask]
    return out, at, to


def fingerprint_words(texts: pa.Array, shingle: int, words: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, words) fingerprints as unsigned 64-bit words, and each text's number of shingles.

    distinct: a shingle that a text repeats counts once, in both."""
    data, offsets = string_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = word_spans(data, offsets)
    rows = len(offsets) - 1
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    ones = np.zeros((rows, 64 * words), np.int64)
    line, at, to = joined_words(data, starts, ends)
    line = memoryview(line)
    doc = np.repeat(np.arange(rows), n)
    from_word = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    to_word = np.minimum(from_word + shingle, np.repeat(first[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(doc), np.uint64)
    for k in range(0, len(doc), CHUNK):
        a, b = at[from_word[k : k + CHUNK]].tolist(), to[to_word[k : k + CHUNK]].tolist()
        hashes[k : k + CHUNK] = np.fromiter((digest(line[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
    if distinct:
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
        hashes, doc = hashes[new], doc[new]
        n = np.bincount(doc, minlength=rows)
    for k in range(0, len(doc), CHUNK):
        h, own = hashes[k : k + CHUNK], doc[k : k + CHUNK]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for w in range(words):
            stream = h if w == 0 else mix(h + np.uint64((w * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            bits = np.unpackbits(stream.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[own[edge], 64 * w : 64 * w + 64] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    set_bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(rows, words), n


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """id, n (shingles; distinct: each once) and the fingerprint's words f0, f1, ... of whole texts.

    Ids are whole numbers: the smallest names a group. A TypeError tells of others."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of a type of whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    names = [f"f{w}" for w in range(words)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp, n = fingerprint_words(part.column("text"), shingle, words, distinct)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), *(pa.array(fp[:, w].astype(np.int64)) for w in range(words))], ["id", "n", *names])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, " + ", ".join(f"{c} long" for c in names))


class _Sets:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(x) for x in range(len(self.up))), np.int64, len(self.up))


class _Tile:
    """The fingerprints a task holds; other fingerprints pass by and are linked to them."""

    def __init__(self, node: np.ndarray, fp: np.ndarray, n: np.ndarray, radius: int, total: int, ratio: float):
        order = np.argsort(np.bitwise_count(fp[0]), kind="stable")
        self.node, self.fp, self.n = node[order], np.ascontiguousarray(fp[:, order]), n[order]
        self.pop = np.bitwise_count(self.fp[0]).astype(np.int64)
        self.sets, self.radius, self.total, self.ratio = _Sets(len(node)), radius, total, ratio

    def hits(self, fp: np.ndarray, n: np.ndarray, own: bool = False, rows: int = 64, cols: int = 4096):
        """Pairs (held, passing) within both radii and of the ratio, tile by tile; tiles whose population counts are too far
        apart are skipped.

        own: the passing ones are the held ones, so each pair is met once."""
        pop = np.bitwise_count(fp[0]).astype(np.int64)
        for i in range(0, len(self.node), rows):
            low, high = self.pop[i] - self.radius, self.pop[min(i + rows, len(self.pop)) - 1] + self.radius
            a, b = i if own else np.searchsorted(pop, low), np.searchsorted(pop, high, side="right")
            for j in range(a, b, cols):
                k = min(j + cols, b)
                near = np.bitwise_count(self.fp[0, i : i + rows, None] ^ fp[0, None, j:k]) <= self.radius
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                x, y = x + i, y + j
                if len(fp) > 1:
                    far = sum(np.bitwise_count(self.fp[w, x] ^ fp[w, y]).astype(np.int64) for w in range(len(fp)))
                    x, y = x[far <= self.total], y[far <= self.total]
                if self.ratio:
                    like = np.minimum(self.n[x], n[y]) + 1e-9 >= self.ratio * np.maximum(self.n[x], n[y])
                    x, y = x[like], y[like]
                if len(x):
                    yield x, y

    def link(self, node: np.ndarray, fp: np.ndarray, n: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Link the passing ones; an edge for each that has a link, further links join sets of the held ones."""
        if not own:
            order = np.argsort(np.bitwise_count(fp[0]), kind="stable")
            node, fp, n = node[order], np.ascontiguousarray(fp[:, order]), n[order]
        held = np.full(len(node), -1, np.int64)
        for x, y in self.hits(fp, n, own):
            new = held[y] < 0
            held[y[new]] = x[new]  # of several, whichever is last; the others are joined with it below
            pairs = np.unique(np.stack([np.minimum(x, held[y]), np.maximum(x, held[y])]), axis=1) if len(x) < 4096 else self._thin(x, y, held)
            for p, q in pairs.T.tolist():
                if p != q:
                    self.sets.join(p, q)
        got = held >= 0
        return node[got], self.node[held[got]]

    def _thin(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Few pairs of held ones that join what the hits join: by sets so far, chained for each passing one."""
        roots = self.sets.roots()
        x, own = roots[x], roots[held[y]]
        order = np.lexsort((x, y))
        x, y, own = x[order], y[order], own[order]
        same = y[1:] == y[:-1]
        chain = np.stack([x[:-1][same], x[1:][same]])
        ends = np.stack([x, own])[:, np.append(True, ~same)]
        return np.unique(np.concatenate([chain, ends], axis=1), axis=1)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.sets.roots()
        own = root != np.arange(len(root))
        return self.node[own], self.node[root[own]]


def tile_edges(items: DataFrame, words: int, steps: list[int], radius: int, total: int, tile: int = TILE, ratio: float = 0.0) -> DataFrame:
    """Edges a, b that connect all nodes within the radii: a spanning forest of each task's links, not the pairs.

    items: node, key (the tile group; a bounded number of values), n, f0, ... Fingerprints with keys x and x + step, for a
    step of steps (0 among them), are compared; with ratio, those link whose n have it or more. A group of more than
    tile items is split into parts, and what passes a part (of its own group the parts after it, of the groups a step
    below all) into lots of about tile items: a task compares a part with a lot, however large the groups are."""
    spark = items.sparkSession
    fs = [f"f{w}" for w in range(words)]
    # The keys' number is bounded by their definition (see near_components), whatever the table's size.
    counts = items.groupBy("key").agg(F.count("*").alias("c"))
    passing = counts.withColumn("to_key", F.explode(F.array(*((F.col("key") + F.lit(s).cast("long")) for s in steps)))).groupBy("to_key").agg(F.sum("c").alias("p"))
    pieces = lambda c: F.ceil(F.col(c) / tile).cast("int")
    deal = F.broadcast(counts.join(passing, F.col("key") == F.col("to_key")).select("to_key", pieces("c").alias("parts"), pieces("p").alias("lots")))
    reach = items.withColumn("step", F.explode(F.array(*(F.lit(s).cast("long") for s in steps)))).withColumn("to_key", F.col("key") + F.col("step")).join(deal, "to_key")
    reach = reach.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("lot", F.pmod(F.xxhash64("node", F.lit(1)), F.col("lots")).cast("int"))
    place = lambda part, lot, passing: F.struct(part.alias("part"), lot.alias("lot"), F.lit(passing).alias("passing"))
    passes = lambda last: F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda p: place(p, F.col("lot"), 1))).otherwise(F.array().cast("array<struct<part:int,lot:int,passing:int>>"))
    holds = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda x: place(F.col("own"), x, 0))
    dealt = reach.withColumn("at", F.explode(F.when(F.col("step") == 0, F.concat(holds, passes(F.col("own") - 1))).otherwise(passes(F.col("parts") - 1))))
    keys = ["to_key", "part", "lot"]
    dealt = dealt.select("to_key", "at.part", "at.lot", "at.passing", "node", "n", *fs).repartition(shuffle_parts(spark), *keys).sortWithinPartitions(*keys, "passing")

    def run(batches):
        at, waiting, held = None, [], None
        table = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def close():
            """The held part is whole: compare it with itself, in one of its tasks."""
            tile_ = _Tile(np.concatenate([x for x, _, _ in waiting]), np.concatenate([x for _, x, _ in waiting], axis=1), np.concatenate([x for _, _, x in waiting]), radius, total, ratio)
            waiting.clear()
            if at[2] == 0:
                tile_.link(tile_.node, tile_.fp, tile_.n, own=True)
            return tile_

        for (*key, passing), batch in runs(batches, [*keys, "passing"]):
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            fp = np.stack([batch.column(c).to_numpy() for c in fs]).view(np.uint64)
            if key != at:
                if waiting:
                    held = close()
                if held is not None:
                    yield table(*held.edges())
                at, held = key, None
            if not passing:
                waiting.append((node, fp, n))
                continue
            if waiting:
                held = close()
            if held is not None:
                yield table(*held.link(node, fp, n))
        if waiting:
            held = close()
        if held is not None:
            yield table(*held.edges())

    return dealt.mapInArrow(run, "a long, b long")


def _population_key():
    """The population counts of the four 16-bit quarters, in base 32: at most 17 ** 4 = 83,521 keys."""
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("f0", 16 * k).bitwiseAND(F.lit(65535))).cast("long") + 2
    return sum((quarter(k) * F.lit(32**k) for k in range(1, 4)), quarter(0))


def _population_steps(radius: int) -> list[int]:
    """Differences of the keys whose quarters' counts differ by radius at most in all, one of each sign."""
    reach = [v for v in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, v)) <= radius]
    return sorted({s for v in reach if (s := sum(x * 32**k for k, x in enumerate(v))) >= 0})


def near_components(prints: DataFrame, words: int = 1, radius: int = 2, total: int | None = None, least_ratio: float | None = None) -> DataFrame:
    """Add component (smallest id reachable over links) to each row of prints.

    Two fingerprints link if their first words differ in at most radius bits and all words in at most total, and with
    least_ratio, if the smaller of their n is that share of the larger or more. Copies of a fingerprint (with least_ratio,
    of a fingerprint and an n) are one node. Tiles are groups of equal population counts of the quarters, compared only
    with those within the radius (radius 2 or less); with least_ratio, groups of like n in bands 5 % wide (under 1,000 for
    any text), compared with all those that an n of the ratio may be in: neither loses a link. Rows with a null id neither
    link nor get a component; equal ids are one document."""
    fs = [f"f{w}" for w in range(words)]
    if least_ratio is None:
        if radius > 2:
            raise ValueError("wider radii need least_ratio")
        key, steps, own = _population_key(), _population_steps(radius), fs
    else:
        key = F.when(F.col("n") < 1, F.lit(-1000)).otherwise(F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(1.05)))).cast("long")
        steps = list(range(math.ceil(-math.log(least_ratio) / math.log(1.05)) + 1))
        own = [*fs, "n"]
    size = [] if least_ratio is not None else [F.max("n").alias("n")]
    items = materialise(prints.groupBy(*own).agg(F.min("id").alias("node"), *size), "fingerprints").filter(F.col("node").isNotNull())
    found = components(tile_edges(items.withColumn("key", key), words, steps, radius, 64 * words if total is None else total, ratio=least_ratio or 0.0))
    named = items.join(found, "node", "left").select(*(F.col(f).alias(f"_{f}") for f in own), F.coalesce("component", "node").alias("component"))
    match = [F.col(f) == F.col(f"_{f}") for f in own]
    return prints.join(named, match, "left").withColumn("component", F.when(F.col("id").isNotNull(), F.col("component"))).select(*prints.columns, "component")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, f0 (the 64-bit fingerprint) and component of each document.

    Null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make one shingle.
    Repeated rows keep their rows and share a component. Empty tables give empty results, other columns are ignored."""
    return near_components(materialise(fingerprints(docs, shingle, 1, id_col, text_col), "prints"), 1, radius)


def near_dedup(docs: DataFrame, shingle: int = 5, words: int = 4, radius: int = 18, total: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest id of each group of near-copies, by longer fingerprints.

    A similarity of 0.8 of five-word shingles is a cosine of 0.89 or more, an angle of 0.15 pi or less: 39 of 256 bits
    differ on average, with a deviation of 6. 50 bits, and 18 of the first 64, catch 97 in 100 pairs at 0.8 exactly and
    nearly all above; unrelated texts differ in about 128. A text's shingles are a set: one that it repeats, such as a row
    of marks, counts once. Numbers of shingles below 0.8 of each other don't link, since no such texts have that similarity. Rows with a null id stay; repeated rows of the id that stays stay too."""
    prints = materialise(fingerprints(docs, shingle, words, id_col, text_col, distinct=True), "prints")
    gone = near_components(prints, words, radius, total, 0.8).filter("component <> id").select(F.col("id").alias("_driftloom_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_driftloom_gone"), "left_anti")
