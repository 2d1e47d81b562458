"""LM scoring: a hierarchical Pitman-Yor model of word pairs, its restaurants' seating drawn by Gibbs sampling.

Each word is a restaurant of what follows it; all share one parent, the restaurant of words, which stands on the uniform
distribution over known words and one unknown. A restaurant's tables are customers of its parent. Seating is held as the
number of tables of each dish: sizes are summed out, so a draw reseats all customers of a dish at once."""

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE_A, materialise, mix, shuffle_parts, string_bytes, text_slices, word_hashes, word_spans
from .packing import gaps, pack, unpack

#: Stand for a text's edges; word hashes have 64 bits and meet these no likelier than each other.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


@dataclass(frozen=True)
class PitmanYorParams:
    """strength and root_strength: of the words' restaurants and of their parent. burn sweeps come before each use of a
    seating, samples are averaged. Discounts are estimated from counts of counts.

    chunk_bytes of text are counted together, unit_bytes of text make up a group of restaurants; neither changes results
    but by the random numbers that each group draws."""

    strength: float = 1.0
    root_strength: float = 1.0
    burn: int = 2
    samples: int = 5
    seed: int = 11
    exact: int = 512
    chunk_bytes: int = 28 << 20
    unit_bytes: int = 20 << 20


# --- Seating


def stirling_logs(discount: float, most: int) -> np.ndarray:
    """At [c, t], the logarithm of the summed weights of all ways that c customers sit at t tables (a table of n weighs
    (1 - d)(2 - d) ... (n - 1 - d))."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + stay[1:])
    return out


def table_mean_spread(c: np.ndarray, p: np.ndarray, mass: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mode and standard deviation of the number of tables of c customers, for large c: the saddle point of the tables'
    generating function. mass: strength + discount * other tables; p: the parent's probability of the dish."""
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # of ln y, in which customers fall
    for _ in range(80):
        mid = (low + high) / 2
        y, yd = np.exp(mid), np.exp(discount * mid)
        seats = np.log(mass) + np.log(p) + (discount - 1) * mid + np.log1p(-y) - np.log1p(-p * (1 - yd))
        low, high = np.where(seats > np.log(c), mid, low), np.where(seats > np.log(c), high, mid)
    ln = (low + high) / 2
    y, yd = np.exp(ln), np.exp(discount * ln)
    t = mass / discount * p * (1 - yd) / (1 - p * (1 - yd))
    slope = (discount - 1) / y - 1 / (1 - y) + discount * yd / y / (1 - yd)
    bend = discount / (mass + discount * t) - 1 / t + discount * yd / y / (1 - yd) / (t * slope)
    return t, 1 / np.sqrt(np.maximum(-bend, 1e-12))


def draw_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator, logs: np.ndarray) -> np.ndarray:
    """A Gibbs draw of the tables t of each dish's c customers, given the restaurant's tables of other dishes.

    Its weights are those of the Chinese restaurant: prod over k < t of (strength + d (others + k)) p, times the ways to
    sit at t tables. Exact where c is within logs; beyond, normal about the mode, rounded."""
    out = np.minimum(c, 1)
    exact = logs.shape[0] - 1
    band = 2
    while band <= exact:  # dishes of like counts go together
        rows = np.flatnonzero((c >= band) & (c < 2 * band) & (c <= exact))
        for at in range(0, len(rows), max(1, (1 << 20) // band)):
            k = rows[at : at + max(1, (1 << 20) // band)]
            most = int(c[k].max())
            t = np.arange(1, most + 1)
            weight = np.cumsum(np.log(strength + discount * (others[k, None] + t[None] - 1)) + np.log(p[k, None]), axis=1) + logs[c[k], 1 : most + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[k] = 1 + (weight < (rng.random(len(k)) * weight[:, -1])[:, None]).sum(axis=1)
        band *= 2
    k = np.flatnonzero(c > exact)
    if len(k):
        mean, spread = table_mean_spread(c[k].astype(np.float64), p[k], strength + discount * others[k], discount)
        out[k] = np.clip(np.rint(mean + spread * rng.standard_normal(len(k))), 1, c[k]).astype(out.dtype)
    return out


@dataclass(frozen=True)
class Totals:
    """Of the whole corpus: discounts, words known, root customers and tables, training tokens."""

    discount: float
    root_discount: float
    known: int
    customers: int
    tables: int
    tokens: int

    def root(self, c: np.ndarray, t: np.ndarray, strength: float) -> np.ndarray:
        """The root restaurant's predictive probability of dishes with c customers at t tables."""
        return (c - self.root_discount * t + (strength + self.root_discount * self.tables) / (self.known + 1)) / (strength + self.customers)


class Restaurants:
    """The restaurants of one unit: pairs (context, word) with their training customers, seated anew by sweeps.

    A context held by several units has customers and tables elsewhere: away_c and away_t."""

    def __init__(self, ctx: np.ndarray, count: np.ndarray, root: np.ndarray, away_c: np.ndarray, away_t: np.ndarray, totals: Totals, p: PitmanYorParams, rng: np.random.Generator):
        self.ctx, self.count, self.root, self.away_t, self.totals, self.p, self.rng = ctx, count, root, away_t, totals, p, rng
        self.customers = np.bincount(ctx, count, len(away_c)) + away_c
        self.tables = np.minimum(count, 1)
        self.shared = np.flatnonzero(count > 1)
        self.logs = stirling_logs(totals.discount, min(p.exact, max(2, int(count.max(initial=0)))))

    def in_context(self) -> np.ndarray:
        return np.bincount(self.ctx, self.tables, len(self.away_t)) + self.away_t

    def sweep(self) -> None:
        """Draw the tables of every pair with more than one customer, a random half after the other."""
        half = self.rng.random(len(self.shared)) < 0.5
        for k in (self.shared[half], self.shared[~half]):
            others = self.in_context()[self.ctx[k]] - self.tables[k]
            self.tables[k] = draw_tables(self.count[k], self.root[k], others, self.totals.discount, self.p.strength, self.rng, self.logs)

    def predictive(self) -> np.ndarray:
        d, s = self.totals.discount, self.p.strength
        ctx_tables, size = self.in_context()[self.ctx], s + self.customers[self.ctx]
        return (self.count - d * self.tables) / size + (s + d * ctx_tables) / size * self.root


# --- Units of the corpus


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and ends of the texts, of the word before each, and the text of each. A-Z are lower-cased."""
    data, offsets = string_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_spans(data, offsets)
    word = np.insert(word_hashes(data, starts, ends), first[1:], END)
    size = np.diff(first) + 1
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(size) - size] = START
    return before, word, np.repeat(np.arange(len(size)), size)


def share_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges each hash falls in; it rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def chunk_slices(word: np.ndarray, sizes: np.ndarray, learn: np.ndarray, units: int, hot: np.ndarray, most: int = 1 << 18):
    """(unit, payload) of a chunk's tokens: sizes of them to each text. A unit has whole contexts, but of the hot ones a share
    of the words after. Units are taken in groups of about most tokens, so that what is made of them stays small."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = START
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    unit = np.empty(len(word), np.uint32)
    for a in range(0, len(word), most):
        v, w = before[a : a + most], word[a : a + most]
        unit[a : a + most] = share_of(v, units)
        if len(hot):
            split = np.isin(v, hot)
            unit[a : a + most][split] = share_of(mix(v[split] * np.uint64(BASE_A) + w[split]), units)
    group = (np.cumsum(np.bincount(unit, minlength=units)) // most).astype(np.int32)[unit]
    for k in range(int(group.max(initial=-1)) + 1):
        own = np.flatnonzero(group == k)
        if len(own):
            yield from unit_payloads(before[own], word[own], text[own], unit[own], learn)


def unit_payloads(before: np.ndarray, word: np.ndarray, text: np.ndarray, unit: np.ndarray, learn: np.ndarray):
    names, at = np.unique(np.concatenate([word, before]), return_inverse=True)
    w, v = at[: len(word)].astype(np.uint32), at[len(word) :].astype(np.uint32)
    own, u = np.unique(unit, return_inverse=True)
    bits = int(len(names)).bit_length()
    key = (u.astype(np.uint64) << np.uint64(2 * bits)) | (v.astype(np.uint64) << np.uint64(bits)) | w.astype(np.uint64)
    order = np.argsort(key)
    key, owner = key[order], text[order]
    pair = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    learned = np.add.reduceat(learn[owner].astype(np.int64), pair)
    times = np.diff(np.append(pair, len(key)))
    v, w, u = v[order][pair], w[order][pair], u[order][pair]
    cuts = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
    for a, b in zip(cuts[:-1], cuts[1:]):
        c = np.flatnonzero(np.append(True, v[a + 1 : b] != v[a : b - 1]))
        local, place = np.unique(w[a:b], return_inverse=True)
        entries = owner[pair[a] : pair[b] if b < len(pair) else len(owner)]
        yield int(own[u[a]]), pack(gaps(names[v[a:b][c]]), np.diff(np.append(c, b - a)), gaps(names[local]), place, times[a:b], learned[a:b], entries)


class Unit:
    """A unit's pairs, merged from all chunks: contexts and words by hash, and for each chunk its pairs and their texts."""

    def __init__(self, payloads: list[bytes]):
        parts = [unpack(x) for x in payloads]
        heads = [np.cumsum(x[0]) for x in parts]
        names = [np.cumsum(x[2]) for x in parts]
        self.contexts, head_at = np.unique(np.concatenate(heads), return_inverse=True)
        self.words, name_at = np.unique(np.concatenate(names), return_inverse=True)
        keys, h, m = [], 0, 0
        for x, head, name in zip(parts, heads, names):
            keys.append(np.repeat(head_at[h : h + len(head)], x[1]) * len(self.words) + name_at[m : m + len(name)][x[3]])
            h, m = h + len(head), m + len(name)
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.ctx, self.word = found // len(self.words), found % len(self.words)
        self.count = np.bincount(at, np.concatenate([x[5] for x in parts]), len(found)).astype(np.int64)
        edges = np.cumsum([0, *(len(x[4]) for x in parts)])
        self.chunks = [(at[a:b], x[4], x[6]) for a, b, x in zip(edges[:-1], edges[1:], parts)]


_UP = "part int, unit int, words binary, heads binary, ones long, twos long"
_DOWN = "unit int, part int, words binary, heads binary, known long, customers long, tables long, tokens long, ones long, twos long, root_ones long, root_twos long"


def up_rows(number: int, unit: Unit, tables: np.ndarray, hot: np.ndarray, parts: int, last: bool) -> list[dict]:
    """What a unit tells the parent: tables of each word (and customers, in the last round), by ranges of the hash, and
    tables and customers of the hot contexts."""
    seated = np.bincount(unit.word, tables, len(unit.words)).astype(np.int64)
    learned = np.bincount(unit.word, unit.count, len(unit.words)).astype(np.int64) if last else np.zeros(0, np.int64)
    own = np.flatnonzero(np.isin(unit.contexts, hot))
    held = np.bincount(unit.ctx, tables, len(unit.contexts)).astype(np.int64)[own], np.bincount(unit.ctx, unit.count, len(unit.contexts)).astype(np.int64)[own]
    a, b = np.searchsorted(share_of(unit.words, parts), np.arange(parts + 1)), np.searchsorted(share_of(unit.contexts[own], parts), np.arange(parts + 1))
    out = []
    for k in range(parts):
        if a[k] < a[k + 1] or b[k] < b[k + 1]:
            words, heads = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
            out.append({"part": k, "unit": number, "words": pack(gaps(unit.words[words]), seated[words], learned[words] if last else learned), "heads": pack(gaps(unit.contexts[own][heads]), held[0][heads], held[1][heads]), "ones": 0, "twos": 0})
    out[0] |= {"ones": int((unit.count == 1).sum()), "twos": int((unit.count == 2).sum())}
    return out


def parent_rows(rows: list[dict], totals: Totals | None, p: PitmanYorParams) -> list[dict]:
    """The parent's answers to the units, for one range of words: customers and tables of each (and training tokens), in
    the order asked. totals: of the round before; in the first, every word sits at one table."""

    def summed(column: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        parts = [unpack(r[column]) for r in rows]
        keys, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in parts]), return_inverse=True)
        edges = np.cumsum([0, *(len(x[0]) for x in parts)])
        sums = [np.bincount(at, np.concatenate([x[k] for x in parts]), len(keys)).astype(np.int64) if sum(len(x[k]) for x in parts) else np.zeros(len(keys), np.int64) for k in (1, 2)]
        return [at[a:b] for a, b in zip(edges[:-1], edges[1:])], sums

    places, (customers, learned) = summed("words")
    head_places, (held, seen) = summed("heads")
    tables = np.minimum(customers, 1)
    if totals:
        logs = stirling_logs(totals.root_discount, min(p.exact, max(2, int(customers.max(initial=0)))))
        uniform = np.full(len(customers), 1 / (totals.known + 1))
        rng = np.random.default_rng([p.seed, 7, rows[0]["part"]])
        tables = draw_tables(customers, uniform, np.full(len(customers), max(totals.tables - 1, 0)), totals.root_discount, p.root_strength, rng, logs)
    out = [
        {"unit": r["unit"], "part": r["part"], "words": pack(customers[a], tables[a], learned[a]), "heads": pack(held[b], seen[b]), "known": 0, "customers": 0, "tables": 0, "tokens": 0, "ones": r["ones"], "twos": r["twos"], "root_ones": 0, "root_twos": 0}
        for r, a, b in zip(rows, places, head_places)
    ]
    out[0] |= {"known": int((customers > 0).sum()), "customers": int(customers.sum()), "tables": int(tables.sum()), "tokens": int(learned.sum()), "root_ones": int((customers == 1).sum()), "root_twos": int((customers == 2).sum())}
    return out


def seated(number: int, unit: Unit, answers: list[dict], totals: Totals, p: PitmanYorParams, hot: np.ndarray, turn: int) -> tuple[Restaurants, np.ndarray, np.ndarray]:
    """A unit's restaurants under the parent's answers, one table for each pair, and which customers and tables its words
    have. Tables that other units hold of a hot context are as of the round before."""
    answers = sorted(answers, key=lambda r: r["part"])
    words, heads = [unpack(r["words"]) for r in answers], [unpack(r["heads"]) for r in answers]
    customers, tables, learned = (np.concatenate([x[k] for x in words]).astype(np.int64) for k in range(3))
    away_c, away_t = np.zeros(len(unit.contexts)), np.zeros(len(unit.contexts))
    own = np.flatnonzero(np.isin(unit.contexts, hot))
    if len(own):
        here_c, here_t = np.bincount(unit.ctx, unit.count, len(unit.contexts))[own], np.bincount(unit.ctx, np.minimum(unit.count, 1), len(unit.contexts))[own]
        away_t[own] = np.maximum(np.concatenate([x[0] for x in heads]) - here_t, 0)
        away_c[own] = np.concatenate([x[1] for x in heads]) - here_c
    root = totals.root(customers, tables, p.root_strength)[unit.word]
    rng = np.random.default_rng([p.seed, turn, number])
    return Restaurants(unit.ctx, unit.count, root, away_c, away_t, totals, p, rng), customers, learned


def discount_of(ones: int, twos: int) -> float:
    """From the numbers of things seen once and twice, held away from 0 and 1."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


# --- The operator


def score_texts(docs: DataFrame, learn: Column, text_col: str = "text", params: PitmanYorParams = PitmanYorParams()) -> DataFrame:
    """docs without their text, with n_tokens, n_known, train_tokens, base_score, score and perplexity of each whole text.

    Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and one end. The model learns from all texts where learn
    is true (null: false). score is the base-10 logarithm of the text's probability, predictive probabilities averaged over
    samples of the seating; base_score that of smoothed single words, log10((c + 0.5) / (tokens + 0.5 (known + 1))).
    perplexity is 10 ** (-score / n_tokens). A null text counts as empty: its end alone. Without any text to learn from
    every token is unknown, and has probability one. Each row stands for itself, whatever its id; columns of docs with the
    new names are replaced. Words are told apart by 64-bit hashes.

    Chunks of texts send each unit of contexts its pairs once; that table stays on the executors' disks (lost parts are
    computed again) while units and ranges of words tell each other tables and answers. The contexts that would overfill a
    unit are told from a sixteenth of the texts; they are split by the word after, which changes nothing but the deal."""
    spark, p = docs.sparkSession, params
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    own = [c for c in docs.columns if c not in new and c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{text_col}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    row_type = rows.schema["row"].dataType
    parts = shuffle_parts(spark)
    units = max(parts, ceil((rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) / p.unit_bytes))

    def heads(batches):
        for batch in (piece for whole in batches for piece in text_slices(whole, "text", 1 << 20)):
            names, n = np.unique(tokens_of(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["h", "n"])

    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(16), "text"), F.lit(16)) == 0).select("text").mapInArrow(heads, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    drawn = materialise(drawn, "heads")
    total = drawn.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = np.sort(np.array([r["h"] for r in drawn.filter(F.col("n") > max(8, total // (2 * units))).collect()], np.int64).view(np.uint64))  # at most 2 * units rows

    def chunks(batches):
        held, size, turn = [], 0, 0

        def close():
            nonlocal turn
            sizes = np.concatenate([x[2] for x in held])
            flags = np.concatenate([x[3] for x in held])
            row = pa.concat_arrays([x[0] for x in held])
            word = np.concatenate([x[1] for x in held])
            held.clear()
            number = (TaskContext.get().partitionId() << 24) + turn
            turn += 1
            lists = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
            counts = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), pa.array(sizes))
            yield pa.RecordBatch.from_arrays([pa.array([-1 - number % (1 << 30)], pa.int32()), pa.array([number]), pa.array([None], pa.binary()), lists, counts], names)
            for unit, payload in chunk_slices(word, sizes, flags, units, hot):
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([number]), pa.array([payload], pa.binary()), pa.nulls(1, lists.type), pa.nulls(1, counts.type)], names)

        names = ["unit", "chunk", "payload", "rows", "tokens"]
        for batch in (piece for whole in batches for piece in text_slices(whole, "text", 1 << 20)):
            _, word, text = tokens_of(batch.column("text"))
            held.append((batch.column("row"), word, np.bincount(text, minlength=batch.num_rows), batch.column("learn").to_numpy(zero_copy_only=False)))
            size += 6 * len(word)  # a word and a blank, about
            if size >= p.chunk_bytes:
                yield from close()
                size = 0
            pa.default_memory_pool().release_unused()
        if held:
            yield from close()

    kept = T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("rows", T.ArrayType(row_type)), T.StructField("tokens", T.ArrayType(T.LongType()))])
    corpus = rows.mapInArrow(chunks, kept).repartition(parts, "unit").persist(StorageLevel.DISK_ONLY)
    pairs = corpus.filter("unit >= 0").select("unit", "chunk", "payload")

    def ordered(table: pa.Table) -> tuple[int, list[int], Unit]:
        table = table.sort_by("chunk")
        return table.column("unit")[0].as_py(), table.column("chunk").to_pylist(), Unit(table.column("payload").to_pylist())

    def first(table: pa.Table) -> pa.Table:
        number, _, unit = ordered(table)
        return pa.Table.from_pylist(up_rows(number, unit, np.minimum(unit.count, 1), hot, parts, False), up_schema)

    def again(left: pa.Table, right: pa.Table, totals: Totals) -> pa.Table:
        if not left.num_rows:
            return up_schema.empty_table()
        number, _, unit = ordered(left)
        places, _, _ = seated(number, unit, right.to_pylist(), totals, p, hot, 1)
        for _ in range(p.burn):
            places.sweep()
        return pa.Table.from_pylist(up_rows(number, unit, places.tables, hot, parts, True), up_schema)

    def answer(table: pa.Table, totals: Totals | None) -> pa.Table:
        return pa.Table.from_pylist(parent_rows(table.sort_by("unit").to_pylist(), totals, p), down_schema)

    def final(left: pa.Table, right: pa.Table, totals: Totals) -> pa.Table:
        if not left.num_rows:
            return sum_schema.empty_table()
        number, chunk, unit = ordered(left)
        places, _, learned = seated(number, unit, right.to_pylist(), totals, p, hot, 2)
        for _ in range(p.burn):
            places.sweep()
        mean = np.zeros(len(unit.count))
        for _ in range(p.samples):
            places.sweep()
            mean += places.predictive() / p.samples
        score = np.log10(mean)
        base = np.log10((learned + 0.5) / (totals.tokens + 0.5 * (totals.known + 1)))[unit.word]
        seen = (learned > 0)[unit.word]
        out = []
        for name, (at, times, owner) in zip(chunk, unit.chunks):
            n = np.bincount(owner)
            some = np.flatnonzero(n)
            each = np.repeat(at, times)
            out.append({"chunk": name, "unit": number, "sums": pack(gaps(some), np.bincount(owner, score[each])[some].astype(np.float32), np.bincount(owner, base[each])[some], np.bincount(owner, seen[each])[some].astype(np.int64))})
        return pa.Table.from_pylist(out, sum_schema)

    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    up_schema, down_schema, sum_schema = (pa.schema([(a, arrow[b]) for a, b in (x.split() for x in s.split(", "))]) for s in (_UP, _DOWN, "chunk long, unit int, sums binary"))

    def asked(ups: DataFrame, totals: Totals | None) -> tuple[DataFrame, dict]:
        downs = materialise(ups.groupBy("part").applyInArrow(lambda t: answer(t, totals), _DOWN), "parents")
        names = ("known", "customers", "tables", "tokens", "ones", "twos", "root_ones", "root_twos")
        return downs.select("unit", "part", "words", "heads"), {k: v or 0 for k, v in downs.agg(*(F.sum(c).alias(c) for c in names)).first().asDict().items()}

    downs, sums = asked(pairs.groupBy("unit").applyInArrow(first, _UP), None)
    totals = Totals(discount_of(sums["ones"], sums["twos"]), discount_of(sums["root_ones"], sums["root_twos"]), sums["known"], sums["customers"], sums["tables"], 0)
    ups = pairs.groupBy("unit").cogroup(downs.groupBy("unit")).applyInArrow(lambda a, b: again(a, b, totals), _UP)
    downs, sums = asked(ups, totals)
    done = Totals(totals.discount, totals.root_discount, sums["known"], sums["customers"], sums["tables"], sums["tokens"])
    found = pairs.groupBy("unit").cogroup(downs.groupBy("unit")).applyInArrow(lambda a, b: final(a, b, done), "chunk long, unit int, sums binary")

    result = T.StructType([T.StructField("row", row_type), *(T.StructField(c, T.LongType()) for c in new[:3]), *(T.StructField(c, T.DoubleType()) for c in new[3:])])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        row, n = left.column("rows").combine_chunks().flatten(), left.column("tokens").combine_chunks().flatten().to_numpy()
        score, base, seen = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
        for data in right.sort_by("unit").column("sums").to_pylist():
            some, a, b, k = unpack(data)
            some = np.cumsum(some)
            score[some] += a
            base[some] += b
            seen[some] += k.astype(np.int64)
        return pa.Table.from_arrays([row, *(pa.array(x) for x in (n, seen, np.full(len(n), done.tokens), base, score, 10 ** (-score / n)))], ["row", *new])

    texts = corpus.filter("unit < 0").select("chunk", "rows", "tokens")
    out = materialise(texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(gather, result), "lm-scores")
    corpus.unpersist()
    return out.select(*(F.col(f"row.`{c}`") for c in own), *new)


def perplexities(scored: DataFrame, *by: str) -> DataFrame:
    """The perplexity and the base's of all tokens in each group."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy(*by).agg(F.sum("n_tokens").alias("n_tokens"), mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))
