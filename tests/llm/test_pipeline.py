"""The pipeline's stages against plain versions, one after the other, on a small folder of tables."""

import random
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from driftloom.llm.common import materialise
from driftloom.llm.queries import PIECE_MODEL, QUERIES
from driftloom.llm.simhash import fingerprint_words

from . import brute
from .test_operators import sentences

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, ids string, _key int, kept boolean"


def make(rnd: random.Random) -> list[tuple]:
    say = lambda lang, k: " ".join(sentences(lang, rnd).split()[:1] + [w + str(rnd.randrange(10)) * (rnd.random() < 0.2) for w in sentences(lang, rnd).split()] * k)
    rows = []
    for i in range(240):
        lang = rnd.choice(["aa", "bb", "cc"])
        rows.append((i, " ".join(sentences(lang, rnd) + f" w{rnd.randrange(9999)}" for _ in range(rnd.randrange(3, 9))), lang))
    base = rows[7][1]
    rows += [(300, base + " ", "aa"), (301, " " + base, "aa"), (302, rows[9][1], "bb"), (None, rows[11][1], "cc"), (None, "unï dans été même où très garçon", None)]
    long = " ".join(f"{w}{k}" for k, w in enumerate(sentences("aa", rnd).split() * 40))
    words = long.split()
    words[20] = "changed"
    rows += [(310, long, "aa"), (311, " ".join(words), "aa"), (312, " ".join(words[:-1]), None)]
    rows += [(320, None, "aa"), (321, "", "bb"), (322, "12 34 %%", None), (323, "this with leak " + ITEM + " there width", "aa"), (324, ITEM.upper() + ".", "aa"), (325, "thing " * 9000, "aa"), (5, rows[5][1], rows[5][2])]
    return [(d, t, lang, "src", len(t or ""), "p", "x", 1, None) for d, t, lang in rows]


ITEM = "the quick brown fox jumps over the lazy dog while thinking of width and thing"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = make(random.Random(11))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
        out.append(docs)
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_keep_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and {(r["lang_pred"], r["ids"], r["_key"], r["kept"]) for r in df.collect()} == {("p", "x", 1, None)}
    assert {"ids", "n_tokens", "round_trip"} <= set(steps[-1].columns)


def test_language_stage_keeps_clean_documents(steps):
    gone = set(pairs(steps[0])) - set(pairs(steps[1]))
    assert {d for d, _ in gone} == {320, 321, 322}


def test_exact_stage(steps):
    rows = pairs(steps[1])
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(t.split())].append((-len(t), d is None, d or 0, d, t))
    assert pairs(steps[2]) == sorted(((min(g)[3], min(g)[4]) for g in groups.values()), key=repr)


def test_near_stage(steps):
    rows = [r for r in pairs(steps[2]) if r[0] is not None]
    import pyarrow as pa

    fp, n = fingerprint_words(pa.array([t for _, t in rows]), 5, 4)
    far = lambda i, j: (int(np.bitwise_count(fp[i, 0] ^ fp[j, 0])), int(np.bitwise_count(fp[i] ^ fp[j]).sum()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and far(i, j)[0] <= 18 and far(i, j)[1] <= 50]
    groups = defaultdict(list)
    for i, r in enumerate(brute.roots(len(rows), links)):
        groups[r].append(rows[i])
    want = [min(g) for g in groups.values()] + [r for r in pairs(steps[2]) if r[0] is None]
    assert pairs(steps[3]) == sorted(want, key=repr)
    assert {d for d, _ in pairs(steps[2])} - {d for d, _ in pairs(steps[3])} == {311, 312}


def test_decontamination_stage(steps):
    assert {d for d, _ in pairs(steps[3])} - {d for d, _ in pairs(steps[4])} == {323, 324}


def test_encoding_stage(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = steps[5].collect()
    assert len(got) == steps[4].count() and all(r["ids"] == library.encode(r["text"]) and r["round_trip"] for r in got)


def test_run_is_the_stages(spark, folder, steps):
    assert pairs(corpus_pipeline.run(spark, folder)) == pairs(steps[5])


def test_stages_take_empty_tables(spark, folder, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op1_simhash_near_dedup", "op2_benchmark_decontamination", "op4_exact_dedup", "op5_substring_dedup", "op6_language_id", "op7_line_dedup", "op9_sentencepiece"])
def test_queries_over_the_folder(spark, folder, steps, name):
    got = QUERIES[name](spark, folder)
    rows = got.count()
    assert got.columns[0] == "doc_id" and (rows == 2 if name.startswith("op2") else rows == steps[0].count())
