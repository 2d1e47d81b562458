"""LM scoring: draws against enumerated seatings, scores against a sampler that moves one customer at a time."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm.packing import gaps, pack, unpack
from driftloom.llm.pitman_yor import PitmanYorParams, Restaurants, Totals, chunk_slices, discount_of, draw_tables, perplexities, score_texts, stirling_logs, table_mean_spread
from driftloom.llm.queries import op11_lm_scoring

from . import brute
from .test_operators import frame, make_docs


def partitions(items):
    if not items:
        yield []
        return
    head, rest = items[0], items[1:]
    for p in partitions(rest):
        yield [[head], *p]
        for k in range(len(p)):
            yield [*p[:k], [head, *p[k]], *p[k + 1 :]]


def seating_weight(sizes, d):
    return math.prod(math.prod(k - d for k in range(1, n)) for n in sizes)


@pytest.mark.parametrize("d", [0.1, 0.5, 0.9])
def test_stirling_numbers_sum_over_all_seatings(d):
    logs = stirling_logs(d, 8)
    for c in range(1, 8):
        want = Counter()
        for p in partitions(list(range(c))):
            want[len(p)] += seating_weight([len(t) for t in p], d)
        assert [math.exp(logs[c, t]) for t in range(1, c + 1)] == pytest.approx([want[t] for t in range(1, c + 1)])
    assert np.isinf(logs[3, 4]) and np.isinf(logs[0, 0])


def test_draws_have_the_restaurants_distribution():
    d, s, c, p, others, n = 0.6, 1.5, 6, 0.2, 3, 200_000
    weight = Counter()
    for seats in partitions(list(range(c))):
        t = len(seats)
        weight[t] += math.prod((s + d * (others + k)) * p for k in range(t)) * seating_weight([len(x) for x in seats], d)
    t = draw_tables(np.full(n, c), np.full(n, p), np.full(n, others), d, s, np.random.default_rng(0), stirling_logs(d, 10))
    got, total = np.bincount(t, minlength=c + 1)[1:] / n, sum(weight.values())
    assert got == pytest.approx([weight[k] / total for k in range(1, c + 1)], abs=5e-3)


def test_draws_equal_moving_a_customer_at_a_time():
    d, s, c, p, others = 0.5, 1.0, 9, 0.3, 2
    rnd, tables, seen = random.Random(3), [c], Counter()
    for step in range(40_000):
        k = rnd.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        tables = [x for x in tables if x]
        k = rnd.choices(range(len(tables) + 1), [*(x - d for x in tables), (s + d * (others + len(tables))) * p])[0]
        tables = [x + (i == k) for i, x in enumerate(tables)] if k < len(tables) else [*tables, 1]
        seen[len(tables)] += 1
    t = draw_tables(np.full(50_000, c), np.full(50_000, p), np.full(50_000, others), d, s, np.random.default_rng(1), stirling_logs(d, 10))
    assert np.bincount(t, minlength=c + 1)[1:] / 50_000 == pytest.approx([seen[k] / 40_000 for k in range(1, c + 1)], abs=0.02)


@pytest.mark.parametrize("d,p,others", [(0.5, 0.1, 500), (0.75, 0.3, 2000), (0.8, 0.02, 90_000)])
def test_many_customers_sit_as_few_do(d, p, others):
    """The normal draw beyond the exact table against the exact one, at counts that both can tell."""
    c, n = 2000, 400
    exact = draw_tables(np.full(n, c), np.full(n, p), np.full(n, others), d, 1.0, np.random.default_rng(2), stirling_logs(d, c))
    mean, spread = table_mean_spread(np.array([float(c)]), np.array([p]), np.array([1.0 + d * others]), d)
    assert mean[0] == pytest.approx(exact.mean(), rel=0.02) and spread[0] == pytest.approx(exact.std(), rel=0.15)
    normal = draw_tables(np.full(n, c), np.full(n, p), np.full(n, others), d, 1.0, np.random.default_rng(2), stirling_logs(d, 100))
    assert normal.mean() == pytest.approx(exact.mean(), rel=0.03)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    words, contexts = 12, 7
    ctx, word = np.divmod(np.arange(words * contexts), words)
    count = rng.poisson(1.2, len(ctx))
    tables = Counter({w: int(np.minimum(count, 1)[word == w].sum()) for w in range(words)})
    c = np.array([tables[w] for w in range(words)])
    totals = Totals(0.6, 0.4, words, int(c.sum()), int((c > 0).sum()), int(count.sum()))
    root = totals.root(c, np.minimum(c, 1), 1.0)
    unknown = totals.root(np.zeros(1), np.zeros(1), 1.0)[0]
    assert root.sum() + unknown == pytest.approx(1)
    r = Restaurants(ctx, count, root[word], np.zeros(contexts), np.zeros(contexts), totals, PitmanYorParams(), rng)
    for _ in range(3):
        r.sweep()
        assert ((r.tables >= np.minimum(count, 1)) & (r.tables <= count)).all()
        for u in range(contexts):
            left = (1.0 + totals.discount * r.tables[ctx == u].sum()) / (1.0 + count[ctx == u].sum())
            assert r.predictive()[ctx == u].sum() + left * unknown == pytest.approx(1)


def plain_tokens(text):
    return [*brute.WORD.findall(brute.low(text or "")), "</end>"]


def plain_scores(docs, held, sweeps=60, seed=0):
    """A sampler with every table in the open: one customer after another leaves and sits down again."""
    rnd = random.Random(seed)
    pairs = [(u, w) for k, t in docs if not held(k) for u, w in zip(["<start>", *plain_tokens(t)], plain_tokens(t))]
    count = Counter(pairs)
    d = discount_of(sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values()))
    followers = Counter(w for _, w in count)
    d0 = discount_of(sum(c == 1 for c in followers.values()), sum(c == 2 for c in followers.values()))
    known, s = len(followers), 1.0
    top, low, size = defaultdict(list), defaultdict(list), Counter()  # tables by dish; by pair; customers of contexts
    held_tables = Counter()

    def root(w):
        t, n = sum(map(len, top.values())), sum(map(sum, top.values()))
        return (sum(top[w]) - d0 * len(top[w]) + (s + d0 * t) / (known + 1)) / (s + n)

    def sit(tables, fresh, dd):
        k = rnd.choices(range(len(tables) + 1), [*(x - dd for x in tables), fresh])[0]
        if k < len(tables):
            tables[k] += 1
        else:
            tables.append(1)
        return k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = rnd.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(u, w):
        if sit(low[u, w], (s + d * held_tables[u]) * root(w), d):
            held_tables[u] += 1
            sit(top[w], (s + d0 * sum(map(len, top.values()))) / (known + 1), d0)
        size[u] += 1

    def drop(u, w):
        if leave(low[u, w]):
            held_tables[u] -= 1
            leave(top[w])
        size[u] -= 1

    for u, w in pairs:
        add(u, w)
    wanted = {(u, w) for k, t in docs for u, w in zip(["<start>", *plain_tokens(t)], plain_tokens(t))}
    total, n = Counter(), 0
    for sweep in range(sweeps):
        for u, w in pairs:
            if count[u, w] > 1:
                drop(u, w)
                add(u, w)
        if sweep >= sweeps // 3 and sweep % 4 == 0:
            n += 1
            for u, w in wanted:
                total[u, w] += (count[u, w] - d * len(low[u, w])) / (s + size[u]) + (s + d * held_tables[u]) / (s + size[u]) * root(w)
    return {k: sum(math.log10(total[u, w] / n) for u, w in zip(["<start>", *plain_tokens(t)], plain_tokens(t))) for k, t in docs}


def plain_base(docs, held):
    tokens = Counter(w for k, t in docs if not held(k) for w in plain_tokens(t))
    n, v = sum(tokens.values()), len(tokens)
    return n, {k: (len(plain_tokens(t)), sum(tokens[w] > 0 for w in plain_tokens(t)), sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in plain_tokens(t))) for k, t in docs}


def is_held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == 1


def run_query(spark, tmp_path, docs):
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    return op11_lm_scoring(spark, str(tmp_path)).collect()


def test_query_equals_counts_and_follows_the_plain_sampler(spark, tmp_path):
    rnd = random.Random(8)
    follow = {w: rnd.sample("abcdefghijklmnopqrst", 4) for w in "abcdefghijklmnopqrst"}

    def say(n):
        w, out = rnd.choice("abcdefghijklmnopqrst"), []
        for _ in range(n):
            w = rnd.choice(follow[w])
            out.append(rnd.choice([w, w.upper()]) if rnd.random() < 0.97 else f"new{rnd.randrange(400)}")
        return " ".join(out)

    docs = [(k, say(rnd.randrange(1, 40))) for k in range(90)] + [(200, ""), (201, None), (202, " \n "), (203, "É é")]
    got = {r["doc_id"]: r for r in run_query(spark, tmp_path, docs)}
    n, base = plain_base(docs, is_held)
    want = plain_scores(docs, is_held)
    assert len(got) == len(docs)
    for k, _ in docs:
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held(k), base[k][0], base[k][1], n)
        assert r["base_score"] == pytest.approx(base[k][2], rel=1e-12)
        assert r["score"] == pytest.approx(want[k], rel=0.06, abs=0.6)  # the plain sampler differs by 0.3 between its own seeds
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
    out = [k for k, _ in docs if is_held(k)]
    assert sum(got[k]["score"] for k in out) == pytest.approx(sum(want[k] for k in out), rel=0.01)
    assert sum(got[k]["score"] for k in out) > sum(got[k]["base_score"] for k in out)


def test_units_and_chunks_change_only_the_draws(spark):
    docs = make_docs() + [(2000 + k, "the " * 60 + f"end{k}") for k in range(40)]
    rows = frame(spark, docs)
    learn = F.col("doc_id") % 3 != 0
    one = {r["doc_id"]: r for r in score_texts(rows, learn).collect()}
    for p in (PitmanYorParams(unit_bytes=1500, chunk_bytes=2000), PitmanYorParams(unit_bytes=40_000, chunk_bytes=1)):
        for r in score_texts(rows, learn, params=p).collect():
            o = one[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (o["n_tokens"], o["n_known"], o["train_tokens"])
            assert r["base_score"] == pytest.approx(o["base_score"], rel=1e-12) and r["score"] == pytest.approx(o["score"], rel=0.03, abs=0.3)


def test_held_out_rows_teach_nothing(spark):
    docs = make_docs()
    learn = F.coalesce(F.col("doc_id") < 30, F.lit(False))
    a = {r["doc_id"]: r["score"] for r in score_texts(frame(spark, docs), learn).collect()}
    other = [(k, t if k < 30 or k == 35 else "entirely other words " * 30) for k, t in docs]
    b = {r["doc_id"]: r["score"] for r in score_texts(frame(spark, other), learn).collect()}
    assert a[35] == pytest.approx(b[35], rel=0.02)


def test_nothing_to_learn_from_and_empty_tables(spark):
    assert score_texts(frame(spark, []), F.lit(True)).count() == 0
    rows = score_texts(frame(spark, [(1, "a b"), (2, None), (None, "a")]), F.lit(None).cast("boolean")).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in rows} == {(0, 0, 0.0, 0.0)}
    rows = score_texts(frame(spark, [(1, None), (1, None)]), F.lit(True)).collect()
    assert [r["n_tokens"] for r in rows] == [1, 1] and all(r["train_tokens"] == 2 for r in rows)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b c", 5, "x"), (None, "a b c", 5, "x"), (7, "c b a", 6, None), (7, "c b a", 6, None), (8, None, None, "z")]
    got = score_texts(frame(spark, rows, "doc_id long, score string, n_tokens int, row string"), F.lit(True), text_col="score").collect()
    assert sorted((r["n_tokens"] for r in got)) == [1, 4, 4, 4, 4] and all(r["train_tokens"] == 17 for r in got)
    assert {r["row"] for r in got} == {"x", None, "z"} and got[0].asDict().keys() == {"doc_id", "row", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"}


def test_texts_of_megabytes(spark):
    docs = [(1, "a b c " * 400_000), (2, "x" * 3_000_000), (3, " ".join(f"w{i % 5000}" for i in range(300_000)))]
    got = {r["doc_id"]: r for r in score_texts(frame(spark, docs), F.lit(True)).collect()}
    assert [got[k]["n_tokens"] for k in (1, 2, 3)] == [1_200_001, 2, 300_001]
    assert got[1]["perplexity"] < 1.01 and got[3]["perplexity"] < 1.3


def test_model_tells_word_order(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {r["held_out"]: r for r in perplexities(op11_lm_scoring(spark, sf), "held_out").collect()}
    assert found[True]["perplexity"] < found[True]["base_perplexity"] / 3 and found[False]["perplexity"] < found[True]["perplexity"]
    assert sum(r["n_tokens"] for r in found.values()) == docs.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\x0b\x0c\r]+"), lambda w: w != "")) + 1)).first()[0]


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    arrays = [np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64)), np.array([0, 255]), np.array([70_000]), rng.random(9), np.zeros(0, np.int64)]
    back = unpack(pack(gaps(arrays[0]), *arrays[1:]))
    assert (np.cumsum(back[0]) == arrays[0]).all() and all((a == b).all() and len(a) == len(b) for a, b in zip(arrays[1:], back[1:]))


def test_chunks_are_sorted_by_groups_of_units():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2)
    word, sizes = pool[(rng.pareto(1.0, 1_000_000) * 20).astype(np.int64) % len(pool)], np.full(1000, 1000)
    learn, hot = np.arange(1000) % 5 != 1, np.sort(pool[:3])
    tracemalloc.start()
    count = pairs = 0
    for _, data in chunk_slices(word, sizes, learn, 40, hot, 1 << 16):
        count, pairs = count + len(unpack(data)[6]), pairs + len(unpack(data)[3])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(word)  # bytes; 63 when a chunk was sorted whole
    whole = {u: unpack(x) for u, x in chunk_slices(word, sizes, learn, 40, hot, 1 << 30)}
    parts = {u: unpack(x) for u, x in chunk_slices(word, sizes, learn, 40, hot, 1 << 16)}
    assert count == len(word) and whole.keys() == parts.keys() and pairs == sum(len(x[3]) for x in whole.values())
    assert all((a == b).all() for u in whole for a, b in zip(whole[u][:6], parts[u][:6]))  # the seventh lists texts in any order
