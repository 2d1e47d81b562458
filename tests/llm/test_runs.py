"""Periodic runs: factors and runs against plain searches, the query against a document at a time."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm.queries import op13_periodic_runs
from driftloom.llm.runs import RunParams, SuffixAutomaton, factors, find_runs, prefix_lengths, repeat_tails, runs_of

from . import brute
from .test_operators import frame, make_docs


def plain_runs(word, p=RunParams()):
    """Every period's longest stretches, one period after another."""
    found = {}
    for q in range(1, len(word) // p.exponent + 1):
        i = 0
        while i + q < len(word):
            start = i
            while i + q < len(word) and word[i] == word[i + q]:
                i += 1
            if i + q - start >= max(p.least, p.exponent * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


@st.composite
def repetitive(draw):
    word = draw(st.lists(st.integers(0, 3), max_size=60))
    for a, q, n in draw(st.lists(st.tuples(st.integers(0, 59), st.integers(1, 7), st.integers(1, 40)), max_size=4)):
        for i in range(a + q, min(len(word), a + q + n)):
            word[i] = word[i - q]
    return word


@settings(max_examples=400, deadline=None)
@given(repetitive(), st.sampled_from([RunParams(), RunParams(2, 2), RunParams(3, 2), RunParams(7, 3), RunParams(4, 5)]))
def test_runs_equal_the_plain_search(word, p):
    assert runs_of(word, p) == plain_runs(word, p)


@settings(max_examples=200, deadline=None)
@given(repetitive())
def test_factors_are_the_longest_that_start_earlier(word):
    at = 0
    for start, end, source in factors(word):
        assert start == at < end
        earlier = [s for s in range(start) if word[s : s + end - start] == word[start:end]]
        longer = [s for s in range(start) if end < len(word) and word[s : s + end - start + 1] == word[start : end + 1]]
        assert (source in earlier if source >= 0 else end == start + 1 and not earlier) and not longer
        at = end
    assert at == len(word)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30))
def test_automaton_holds_where_strings_first_end(word):
    a = SuffixAutomaton(word)
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            state = 0
            for x in word[i:j]:
                state = a.next[state][x]
            assert a.ends[state] == min(s + j - i - 1 for s in range(i + 1) if word[s : s + j - i] == word[i:j])
    z = prefix_lengths(word)
    for i in range(len(word)):
        n = 0
        while i + n < len(word) and word[n] == word[i + n]:
            n += 1
        assert z[i] == n


def plain_rows(docs):
    out = []
    for doc_id, text in docs:
        words = brute.WORD.findall(text or "")
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), brute.sha(kept)))
    return sorted(out, key=repr)


def planted():
    """Documents whose ids have a hash that plants a run, beside ones with runs of their own."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rnd = random.Random(4)
    texts = ["a b c d e f " * 9, "x " * 6, "x " * 5, "a b a b a b a b", "a b a b a b a", "é \U0001f642 " * 30, "ab ab " * 7, "p q r\n" * 4 + "tail", "same " * 2 + "p q " * 5 + "q " * 8]
    own = [(20000 + k, t) for k, t in enumerate(texts)] + [(20000, texts[0]), (None, texts[0]), (None, None)]
    return make_docs() + [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(3)) for _ in range(rnd.randrange(0, 300)))) for i in ids] + own


def test_query_equals_plain_search(spark, tmp_path):
    docs = planted()
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_rows(docs)
    assert sum(r[1] > 0 for r in got) > 40


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_periodic_runs(spark, sf).collect()), key=repr) == plain_rows(docs)


def test_clashing_columns_and_empty_table(spark):
    odd = spark.createDataFrame([("a a a a a a a", 5, None, "t")], "runs string, n_words int, doc_id long, collapsed_text string")
    row = find_runs(odd, text_col="runs").first()
    assert row["n_words"] == 7 and [tuple(r) for r in row["runs"]] == [(0, 7, 1)] and row["collapsed_text"] == "a"
    assert find_runs(frame(spark, [])).count() == 0
    assert repeat_tails(frame(spark, [])).columns == ["doc_id", "text"]


@pytest.mark.parametrize("text", ["a b c " * 300_000, "x" * 3_000_000 + " " + "y " * 20, " ".join(map(str, range(400_000)))])
def test_texts_of_megabytes(spark, text):
    began = time.time()
    row = find_runs(frame(spark, [(1, text)])).select("n_words", "runs", "collapsed_text").first()
    assert row["n_words"] == len(text.split()) and len(row["runs"]) == int(text[0] != "0")
    assert row["runs"] == [] or row["collapsed_text"] == {"a": "a b c", "x": "x" * 3_000_000 + " y"}[text[0]]
    assert time.time() - began < 60
