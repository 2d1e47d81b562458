"""Each operator against its plain version, on small tables with nulls, empties, ties, repeats and clashing columns."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.llm import chat, decontamination, exact_dedup, html_text, labelled_pages, language, line_dedup, pieces, quality, simhash, substring_dedup
from driftloom.llm.components import components
from driftloom.llm.queries import PIECE_MODEL

from . import brute

WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty kelp ledge marsh north ocean pine quay reef shore tide".split()


def make_docs(n: int = 40, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, empties and nulls, and one long text."""
    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", ",", "\n"]) + str(rnd.randrange(50)) for _ in range(k))
    shared, line = say(60).replace("\n", " "), "The same long line everywhere"
    docs = [(i, say(rnd.randrange(1, 120))) for i in range(n)]
    for k in range(n, n + 12):
        base = docs[rnd.randrange(n)][1]
        docs.append((k, rnd.choice([base, base + " ", base.replace("\n", " \n "), base + "\n" + line, "x " + base, say(10) + " " + shared + " " + say(10), shared, line + "\n" + line + "\n" + base])))
    docs += [(900, ""), (901, None), (902, " \n\t "), (903, "one"), (904, "É à 漢字 🙂 é"), (905, "\n\n"), (906, say(4000)), (907, "  a b"), (908, "ONE")]
    rnd.shuffle(docs)
    return docs


SCHEMA = "doc_id long, text string"
EMPTY = "the empty table"


@pytest.fixture(scope="module")
def docs():
    return make_docs()


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- SimHash


def simhash_rows(df):
    return {tuple(r) for r in df.select("id", F.lower(F.lpad(F.hex("f0"), 16, "0")), "component").collect()}


def test_simhash_equals_brute_force(spark, docs):
    assert simhash_rows(simhash.simhash_components(frame(spark, docs))) == brute.simhash(docs)


def test_simhash_links_chains_of_prints(spark):
    rnd = np.random.default_rng(0)
    base = [int(x) for x in rnd.integers(0, 1 << 62, 6)]
    prints = [p ^ (1 << i) ^ (1 << j) for p in base for i in range(0, 30, 3) for j in range(0, 12, 4)] + base[:3] + [0]
    rows = [(i, 1, p) for i, p in enumerate(prints)] + [(500, 1, prints[0]), (None, 1, prints[0])]
    got = {r["id"]: r["component"] for r in simhash.near_components(frame(spark, rows, "id long, n long, f0 long"), 1, 2).collect()}
    order = [r for r in rows if r[0] is not None]
    links = [(i, j) for i in range(len(order)) for j in range(i) if (order[i][2] ^ order[j][2]).bit_count() <= 2]
    want = brute.roots(len(order), links)
    assert got == {None: None, **{order[i][0]: order[r][0] for i, r in enumerate(want)}}


def test_small_tiles_give_the_same_links(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    base = [int(x) for x in rnd.integers(0, 1 << 62, 3)]
    prints = sorted({p ^ (1 << int(i)) ^ (1 << int(j)) for p in base for i, j in rnd.integers(0, 62, (60, 2))})
    items = frame(spark, [(i, 0, 1, p) for i, p in enumerate(prints)], "node long, key long, n long, f0 long")
    for tile in (7, 1000):
        found = {(r["node"], r["component"]) for r in components(simhash.tile_edges(items, 1, [0], 2, 64, tile)).collect()}
        links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
        want = {(i, r) for i, r in enumerate(brute.roots(len(prints), links)) if i != r}
        assert found == want


def test_parts_and_lots_meet_all_their_neighbours(spark):
    """Several keys, each in many parts and passed by many lots, against all pairs whose keys a step allows."""
    rnd = np.random.default_rng(6)
    base = int(rnd.integers(0, 1 << 62))
    rows = [(i, int(rnd.integers(0, 5)), int(rnd.integers(80, 121)), base ^ (1 << int(rnd.integers(0, 60))) ^ (1 << int(rnd.integers(0, 60)))) for i in range(260)]
    df = frame(spark, rows, "node long, key long, n long, f0 long")
    for tile in (9, 40, 5000):
        got = {(r["node"], r["component"]) for r in components(simhash.tile_edges(df, 1, [0, 1, 3], 1, 64, tile, 0.9)).collect()}
        links = [(i, j) for i in range(len(rows)) for j in range(i) if abs(rows[i][1] - rows[j][1]) in (0, 1, 3) and (rows[i][3] ^ rows[j][3]).bit_count() <= 1 and 10 * min(rows[i][2], rows[j][2]) >= 9 * max(rows[i][2], rows[j][2])]
        assert got == {(i, r) for i, r in enumerate(brute.roots(len(rows), links)) if i != r}


def test_simhash_takes_whole_numbers_for_ids_only(spark):
    with pytest.raises(TypeError, match="doc_id"):
        simhash.simhash_components(frame(spark, [("a", "x")], "doc_id string, text string"))
    assert simhash.simhash_components(frame(spark, [(3, "x y z")], "doc_id smallint, text string")).first()["component"] == 3


def test_simhash_of_very_long_texts(spark):
    rnd = random.Random(3)
    long, word = " ".join(rnd.choice(WORDS) for _ in range(400_000)), "x" * (1 << 20)
    rows = [(1, long), (2, long + " end"), (3, word), (4, word), (5, "short one here")]
    assert simhash_rows(simhash.simhash_components(frame(spark, rows))) == brute.simhash(rows)


def test_simhash_empty_and_other_columns(spark, docs):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    clash = frame(spark, [(d, t, 1, 2, "x") for d, t in docs], SCHEMA + ", id long, n long, component string")
    assert simhash_rows(simhash.simhash_components(clash)) == brute.simhash(docs)


def test_near_dedup_keeps_one_of_each_group(spark):
    rnd = random.Random(4)
    text = lambda k: " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(1000)}" for _ in range(k))
    rows = []
    for g in range(6):
        base = text(300)
        rows.append((10 * g, base))
        for c in range(1, 4):
            words = base.split()
            words[rnd.randrange(300)] = "changed"
            rows.append((10 * g + c, " ".join(words)))
    rows += [(100 + k, text(200)) for k in range(20)] + [(None, "a null id stays"), (200, ""), (201, None)]
    got = {r["doc_id"] for r in simhash.near_dedup(frame(spark, rows)).collect()}
    assert got == {0, 10, 20, 30, 40, 50, None, 200} | {100 + k for k in range(20)}


def test_near_dedup_counts_a_repeated_shingle_once(spark):
    rnd = random.Random(8)
    text = lambda k, marks: " ".join([*(f"{rnd.choice(WORDS)}{rnd.randrange(10000)}" for _ in range(k)), *["-"] * marks])
    rows = [(1, text(200, 220)), (2, text(200, 220)), (3, text(2000, 2200)), (4, text(30, 3000))]
    assert {r["doc_id"] for r in simhash.near_dedup(frame(spark, rows)).collect()} == {1, 2, 3, 4}


def test_near_dedup_meets_texts_written_twice(spark):
    rnd = random.Random(9)
    text = lambda k: " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(10000)}" for _ in range(k))
    a, b = text(300), text(300)
    rows = [(1, a), (2, f"{a} {a}"), (3, b), (4, b + f" {b[: len(b) // 2]}" * 3), (5, text(300))]
    assert {r["doc_id"] for r in simhash.near_dedup(frame(spark, rows)).collect()} == {1, 3, 5}


def test_near_components_seek_copies_in_every_band(spark):
    rows = [(1, 100, 7), (2, 200, 7), (3, 190, 3), (4, 100, 1 << 40)]
    got = {r["id"]: r["component"] for r in simhash.near_components(frame(spark, rows, "id long, n long, f0 long"), 1, 2, None, 0.8).collect()}
    assert got[1] == 1 and got[2] == got[3] == 2


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5), (None, 3), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, n)}, 1001: 1000}
    assert components(frame(spark, [], "a long, b long")).count() == 0


# --- decontamination


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    items = [(k, " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(rnd.randrange(8, 40)))) for k in range(15)] + [(90, None), (91, ""), (92, "two words"), (None, "alpha beta gamma delta epsilon zeta")]
    noise = lambda k: " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(k))
    docs = [(0, None), (1, ""), (2, noise(5)), (3, "Alpha, BETA gamma: delta epsilon zeta!"), (None, items[0][1])]
    for d in range(4, 120):
        words = items[rnd.randrange(15)][1].split()
        for _ in range(int(rnd.choice([0, 0.1, 0.2, 0.5]) * len(words))):
            words[rnd.randrange(len(words))] = "changed"
        docs.append((d, f"{noise(rnd.randrange(40))} {' '.join(words)} {noise(rnd.randrange(40))}"))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    want, split = set(), lambda t: [w.strip(".,:!").lower() for w in (t or "").split()]
    for i, t in items:
        item = split(t)
        n, k = len(item), int(0.2 * len(item))
        if n < 5:
            continue
        for d, text in docs:
            words = [None] * (n - 1) + split(text) + [None] * (n - 1)
            best = min((levenshtein(item, words[s : s + n]) for s in range(len(words) - n + 1)), default=n) if any(words) else n
            if best <= k:
                want.add((d, i, best))
    assert got <= want
    assert len(got) >= 0.99 * len(want)
    assert (3, None, 0) in got and any(d is None for d, _, _ in got)
    clean = {r["doc_id"] for r in decontamination.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _, _ in got}


def test_short_items_match_as_they_stand(spark):
    items = frame(spark, [(1, "Yes!"), (2, "two words"), (3, "it is three"), (4, "one of four words")], "item_id long, text string")
    docs = [(1, "He said: yes."), (2, "Two, words"), (3, "two more words"), (4, "say it is three or so"), (5, "it was three"), (6, "one of four words"), (7, "yesterday"), (8, "words two"), (9, None)]
    got = {tuple(r) for r in decontamination.find_leaks(frame(spark, docs), items).collect()}
    assert got == {(1, 1, 2, 1, 0), (2, 2, 0, 2, 0), (4, 3, 1, 3, 0), (6, 4, 0, 4, 0)}
    assert {r["doc_id"] for r in decontamination.decontaminate(frame(spark, docs), items).collect()} == {3, 5, 7, 8, 9}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaks_of_empty_tables(spark, docs):
    items = frame(spark, [(1, " ".join(WORDS))], "item_id long, text string")
    assert decontamination.find_leaks(frame(spark, []), items).count() == 0
    assert decontamination.find_leaks(frame(spark, docs), items.limit(0)).count() == 0
    assert decontamination.decontaminate(frame(spark, docs), items.limit(0)).count() == len(docs)
    clash = frame(spark, [(1, "x " + " ".join(WORDS), 5, "y")], SCHEMA + ", item_id long, distance string")
    assert rows_of(decontamination.find_leaks(clash, items)) == [(1, 1, 1, len(WORDS), 0)]
    assert decontamination.decontaminate(clash, items).columns == clash.columns


# --- chats


def test_chats_collapse_snapshots(spark):
    turn = lambda c, *texts: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows = turn(1, "a") + turn(2, "a", "b") + turn(3, "a", "b", "c") + turn(4, "a", "x") + turn(5, "a", "b", "c") + turn(6, "b", "c") + turn(7, None) + turn(8, "") + turn(9, "q", None)
    rows += [(10, 0, None, "r"), (None, 0, "user", "nobody's"), (None, 1, "user", "turn"), (11, None, "user", "first"), (11, 3, "user", "last"), (12, 1, "user", "tie b"), (12, 1, "user", "tie a"), (13, 0, "user", "twice"), (13, 0, "user", "twice"), (14, 0, "user", "twice")]
    random.Random(1).shuffle(rows)
    df = frame(spark, [(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, h1 string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 4, 6, 7, 8, 9, 10, None, 11, 12, 13}
    assert got[3] == (3, "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n")
    assert got[7] == (1, "<|user|>\n<|end|>\n") == got[8] and got[10][1].startswith("<|unknown|>")
    assert got[12][1].index("tie a") < got[12][1].index("tie b") and got[13][0] == 2
    assert chat.format_chats(df.limit(0)).count() == 0


# --- exact dedup


def exact_rows(df):
    return rows_of(df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def test_exact_equals_brute_force(spark, docs):
    got = exact_rows(exact_dedup.exact_dedup(frame(spark, docs)))
    assert got == sorted(brute.exact(docs), key=repr)


def test_exact_over_many_shards_and_salts(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 5)
    real = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda rows, history, shards, spread: real(rows, history, shards, {k: 3 for k in range(0, shards, 2)}))
    assert exact_rows(exact_dedup.exact_dedup(frame(spark, docs))) == sorted(brute.exact(docs), key=repr)


def test_exact_with_history(spark):
    past = exact_dedup.distinct_digests(exact_dedup.digest_rows(frame(spark, [(1, "old text"), (2, "older"), (3, "oldtext")]), "doc_id", "text"))
    now = frame(spark, [(10, "old  text"), (11, "new"), (12, "n e w"), (13, None), (14, "")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(now, past).collect()}
    assert got == {10: (1, 2, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 2, True), 14: (13, 2, False)}
    assert {r["doc_id"] for r in exact_dedup.drop_copies(now, past).collect()} == {12, 13}


def test_exact_takes_ids_of_other_types(spark):
    docs = [(1, "a b"), (2, "ab"), (3, "c"), (None, "a  b"), (None, None), (5, "")]
    want = sorted(brute.exact([(d, t) for d, t in docs if d is not None] + [(9, "a  b"), (9, None)]), key=repr)
    for kind in ("smallint", "string", "date"):
        df = frame(spark, docs, "doc_id long, text string").withColumn("doc_id", F.expr("date_add(date'2020-01-01', cast(doc_id as int))") if kind == "date" else F.col("doc_id").cast(kind))
        got = exact_dedup.exact_dedup(df)
        assert dict(got.dtypes)["keep_id"] == kind and got.count() == 6
        assert sorted(r["group_size"] for r in got.collect()) == sorted(r[2] for r in want) and got.filter("kept").count() == 3


def test_exact_repeats_nulls_and_clashes(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "ab "), (2, "ab"), (None, None), (None, "")]
    df = frame(spark, [(*r, 1, "k") for r in rows], SCHEMA + ", kept int, _digest string")
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 2
    assert {r["keep_id"] for r in got if r["group_size"] == 4} == {1}
    out = exact_dedup.drop_copies(df.drop("_digest"))
    assert out.count() == 2 and out.columns == ["doc_id", "text", "kept"]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        digests = rnd.integers(0, 256, (n, 32), dtype=np.uint8)
        seeds, slots = exact_dedup.build_mph(digests)
        assert sorted(slots.tolist()) == list(range(n))
        assert (exact_dedup.mph_slots(seeds, n, digests) == slots).all()


# --- substring dedup


@pytest.mark.parametrize("window", [35, 12, 5, 1])
def test_substring_equals_brute_force(spark, docs, window):
    found = substring_dedup.substring_dedup(frame(spark, docs), window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(found) == sorted(brute.substring(docs, window), key=repr)


def test_substring_within_a_text_and_edges(spark):
    passage = " ".join(f"w{i}" for i in range(36))
    docs = [(1, f"{passage} between {passage}"), (2, f"{passage[3:]}"), (3, passage + " tail"), (4, None), (5, ""), (6, "w1 " * 200), (None, passage), (7, passage), (7, passage)]
    df = frame(spark, [(*d, "x", 2) for d in docs], SCHEMA + ", id string, places int")
    got = rows_of(substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))
    assert got == sorted(brute.substring(docs), key=repr)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_covers_hold_every_difference():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- languages


def sentences(lang: str, rnd: random.Random) -> str:
    stems = {"aa": ["thing", "with", "there", "this", "width"], "bb": ["über", "schön", "straße", "nicht", "auch"], "cc": ["été", "garçon", "où", "très", "même"]}[lang]
    return " ".join(rnd.choice(stems) + rnd.choice(["", "s", "n"]) for _ in range(rnd.randrange(3, 40)))


def test_language_held_out(spark):
    rnd = random.Random(3)
    rows = [(i, sentences(lang, rnd), lang) for i, lang in enumerate(rnd.choice(["aa", "bb", "cc"]) for _ in range(400))]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !!", "cc"), (503, sentences("aa", rnd), None), (None, sentences("bb", rnd), "bb"), (504, sentences("cc", rnd) * 200, "cc")]
    docs = frame(spark, [(*r, "s", 1.0) for r in rows], SCHEMA + ", lang string, source string, lang_score double")
    train = language.train_rows(docs)
    assert all(r["id"] is not None and r["label"] is not None for r in train.collect())
    model = language.train_language(train, language.LanguageParams(per_label=100))
    got = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    assert len(got) == len(rows)
    right = [got[d]["lang_pred"] == lang for d, t, lang in rows[:400]]
    assert sum(right) >= 0.98 * len(right)
    assert all(got[d]["lang_pred"] == "und" and got[d]["lang_score"] == 0 for d in (500, 501, 502))
    assert got[None]["lang_pred"] == "bb" and got[504]["lang_pred"] == "cc"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in language.keep_identified(docs, params=language.LanguageParams(per_label=100)).collect()}
    assert kept >= {d for d, _, _ in rows[:400]} - {d for (d, _, _), ok in zip(rows, right) if not ok} and not kept & {500, 501, 502}


def test_marks_and_private_characters_are_no_letters(spark):
    """A text of marks, private-use or unassigned characters only is undetermined; letters beyond the basic plane aren't."""
    rnd = random.Random(2)
    rows = [(i, sentences(lang, rnd), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    model = language.train_language(language.train_rows(frame(spark, rows, SCHEMA + ", lang string")), language.LanguageParams(per_label=50))
    texts = ["\u0301", "\u0301 \u20dd", "\U000f0000", "\U0010fffd 12", "\u0378", "\U00020000", "e\u0301", "\u0915\u093f"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(frame(spark, list(enumerate(texts))), model).collect()}
    assert [got[i] == "und" for i in range(8)] == [True] * 5 + [False] * 3


def test_ftrl_against_a_plain_loop():
    """The fit against the update written a coordinate at a time."""
    rnd = random.Random(11)
    p = language.LanguageParams(dims=12, epochs=2, l1=0.05)
    rows = [(np.array(sorted(rnd.sample(range(12), 4))), np.array([rnd.random() for _ in range(4)], np.float32)) for _ in range(30)]
    labels = np.array([rnd.randrange(3) for _ in rows])
    z, n = [[0.0] * 13 for _ in range(3)], [[0.0] * 13 for _ in range(3)]

    def weight(c, i):
        if abs(z[c][i]) <= p.l1:
            return 0.0
        return -(z[c][i] - (p.l1 if z[c][i] > 0 else -p.l1)) / ((p.beta + n[c][i] ** 0.5) / p.alpha + p.l2)

    draw = np.random.default_rng(1)
    for _ in range(p.epochs):
        for k in draw.permutation(len(rows)):
            x = [*zip(rows[k][0].tolist(), map(float, rows[k][1])), (12, 1.0)]
            w = {(c, i): weight(c, i) for c in range(3) for i, _ in x}
            logits = [sum(w[c, i] * v for i, v in x) for c in range(3)]
            top = max(logits)
            odds = [np.exp(a - top) for a in logits]
            for c in range(3):
                for i, v in x:
                    g = (odds[c] / sum(odds) - (c == labels[k])) * v
                    sigma = ((n[c][i] + g * g) ** 0.5 - n[c][i] ** 0.5) / p.alpha
                    z[c][i] += g - sigma * w[c, i]
                    n[c][i] += g * g
    got, bias = language.fit_ftrl(rows, labels, 3, p)
    assert got == pytest.approx(np.array([[weight(c, i) for i in range(12)] for c in range(3)]), abs=1e-4)
    assert bias == pytest.approx([weight(c, 12) for c in range(3)], abs=1e-4) and (got == 0).any()


def test_weights_of_n_grams_by_hand():
    grams = language.Grams(1 << 16, 2)
    slots, value = grams.weights("Ab, ab!", np.ones(1 << 16))
    # " ab ab " : one character: space 3, a 2, b 2; two: " a" 2, "ab" 2, "b " 2.
    raw = sorted([1 + np.log(3)] + [1 + np.log(2)] * 5)
    assert sorted(value) == pytest.approx(np.array(raw) / np.sqrt(sum(v * v for v in raw)), abs=1e-6) and len(slots) == 6


def test_language_without_rows(spark):
    empty = frame(spark, [], SCHEMA + ", lang string")
    model = language.train_language(language.train_rows(empty))
    assert language.identify_language(empty, model).count() == 0
    assert [r["lang_pred"] for r in language.identify_language(frame(spark, [(1, "words")]), model).collect()] == ["und"]


def test_temperature_flattens_overconfidence():
    rnd = np.random.default_rng(2)
    labels = rnd.integers(0, 3, 2000)
    logits = np.where(rnd.random((2000, 1)) < 0.7, np.eye(3)[labels], np.eye(3)[rnd.integers(0, 3, 2000)]) * 20
    t = language.fit_temperature(logits, labels)
    assert 0.75 < language.softmax(logits / t).max(axis=1).mean() < 0.85


# --- lines


def test_lines_equal_brute_force(spark, docs):
    found = line_dedup.line_dedup(frame(spark, docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    assert rows_of(found) == sorted(brute.lines(docs), key=repr)


def test_common_lines_and_copies_take_their_own_way(spark, docs, monkeypatch):
    many = docs + [(1000 + k, f"A line that very many documents hold\nown line number {k}\n{' '.join(WORDS * 3)}") for k in range(60)]
    for module in (line_dedup, substring_dedup):
        monkeypatch.setattr(module, "HOT_ROWS", 3)
        monkeypatch.setattr(module, "HOT", 40)
    found = line_dedup.line_dedup(frame(spark, many)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    assert rows_of(found) == sorted(brute.lines(many), key=repr)
    many += [(2000 + k, many[-1][1]) for k in range(40)]
    got = substring_dedup.substring_dedup(frame(spark, many)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(got) == sorted(brute.substring(many), key=repr)


def test_lines_edges(spark):
    same = "A line that repeats"
    docs = [(3, f"{same}\nb\n{same}"), (1, f"  {same.upper()}\t\nshort"), (2, "short"), (None, same), (4, None), (5, f"{same}\r\n\n"), (6, "x"), (6, "x")]
    df = frame(spark, [(*d, "z", 1) for d in docs], SCHEMA + ", kept_text string, n_lines int")
    got = sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(df).collect()), key=repr)
    assert got == sorted([(3, "b", 3, 2), (1, f"  {same.upper()}\t\nshort", 2, 0), (2, "short", 1, 0), (None, same, 1, 0), (4, "", 1, 0), (5, "\n", 3, 1), (6, "x", 1, 0), (6, "x", 1, 0)], key=repr)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    three = line_dedup.line_dedup(df, min_docs=4)
    assert {r["n_dropped"] for r in three.collect()} == {0}


# --- pages


def test_pages():
    weights = html_text.learn_weights()
    assert max(weights.tags.values()) < 0
    for page in labelled_pages.PAGES:
        text = html_text.main_text(page, weights)
        assert text and not any(x in text for x in ("cookies", "Subscribe", "Most read", "Imprint", "Buy now", "squeaks", "Maps"))
    page = "<nav><a>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;three<p>Four<br>five<aside>No no no no</aside><p>Six</article><footer>End</footer>"
    assert html_text.main_text(page, weights) == "T & U\n\nOne two three\n\nFour five\n\nSix"
    assert html_text.main_text("<article><p>a</article><section id='comments'><article><p>Reader said a very long thing here today</article></section>", weights) == "a"
    assert [html_text.main_text(x, weights) for x in (None, "", "<article></article>", "just words", "<p>cut <b", "<", "<script>var a = 1")] == ["", "", "", "just words", "cut", "<", ""]
    body = "<p>The words of the article stand here in one plain line.</p>"
    for page in (f'<div class="page has-sidebar"><div class="content">{body}</div><div class="sidebar-content"><p>Other things to read now</p></div></div>', f'<article><div class="article-header"><h1>Head</h1></div>{body}<div class="article-footer">Filed</div><div class="ad-slot">Buy this thing now</div></article>',
                 f'<div id="main">{body}</div><div class="comment-content"><p>I say that it is so</p></div><div role="complementary">More</div><div style="display: none">unseen words here</div>', f'<main><div class="post">{body}</div><form>mail <input></form></main>'):
        text = html_text.main_text(page, weights)
        assert text.removeprefix("Head\n\n") == "The words of the article stand here in one plain line."
    long = "<article>" + "<p>word word word</p>" * 20000 + "</article>"
    assert len(html_text.main_text(long, weights)) == 20000 * 16 - 2


def test_pages_keep_text_on_both_sides_of_an_aside():
    weights = html_text.learn_weights()
    first, rest = " ".join(f"first{k}" for k in range(30)), " ".join(f"rest{k}" for k in range(60))
    links = "".join(f"<li><a href='#'>offer {k}</a></li>" for k in range(40))
    for aside in (f"<div class='advert'>{'buy this now ' * 20}</div>", f"<div class='related'><ul>{links}</ul></div>", f"<aside><p>{'note ' * 50}</p></aside>"):
        assert html_text.main_text(f"<body><div><h1>Head</h1><p>{first}</p>{aside}<p>{rest}</p></div></body>", weights) == f"Head\n\n{first}\n\n{rest}"


def test_pages_keep_all_articles_and_blocks_with_telling_names():
    weights = html_text.learn_weights()
    one, two = "The first article stands here, word for word.", "The second one is no longer than the first."
    assert html_text.main_text(f"<body><nav><a>Menu</a></nav><article><p>{one}</p></article><div class='ad'>Buy this now</div><article><p>{two}</p></article><footer>End</footer></body>", weights) == f"{one}\n\n{two}"
    for block in ("<div class='popular-science'>Inner words stay</div>", "<p class='recommended-dose'>Inner words stay</p>", "<div class='warning'>Inner words stay</div>", "<div class='unheard-of-name'>Inner words stay</div>"):
        assert html_text.main_text(f"<article><p>{one}</p>{block}<p>{two}</p></article>", weights) == f"{one}\n\nInner words stay\n\n{two}"


def test_labelled_pages_held_out():
    weights = html_text.learn_weights()
    held = labelled_pages.labelled_pages(200, seed=99)[len(labelled_pages.PAGES) :]
    scores = [html_text.token_f1(html_text.main_text(p, weights), html_text.true_text(p)) for p in held]
    assert sum(scores) / len(scores) > 0.98 and html_text.learn_weights() is weights


def test_pages_equal_the_best_of_all_runs():
    """Against every run of tokens, its words of positive score joined block by block in a plain way."""
    weights = html_text.learn_weights()
    rnd = random.Random(4)
    pieces_ = ["<div class='ad'>", "</div>", "<p>", "</p>", "<article>", "</article>", "<nav>", "</nav>", "<b>", "</b>", "<br>", "<aside>", "</aside>", "one two three ", "four", "<a href='#'>five six</a>", " seven &amp; eight nine ten ", "<h1>", "</h1>", "<section>", "</form>"]
    for _ in range(300):
        page = "".join(rnd.choice(pieces_) for _ in range(rnd.randrange(1, 25)))
        items, scores, kept = html_text.scored(page, weights)
        assert len(items) == len(scores) == len(kept)
        best = max([0.0, *(sum(scores[a:b]) for a in range(len(items)) for b in range(a + 1, len(items) + 1))])
        low, high = html_text.best_run(scores)
        assert sum(scores[low:high]) == pytest.approx(best)
        text = "".join("\x00" if x[0] in html_text.BLOCK else " " if x[0] == "br" else x[2] if x[2] is not None and k else "" for x, k in zip(items[low:high], kept[low:high]))
        assert html_text.main_text(page, weights) == "\n\n".join(" ".join(b.split()) for b in text.split("\x00") if b.strip())


def test_pages_of_many_and_deep_tags():
    weights = html_text.learn_weights()
    body = "<p>The words of the article stand here in one plain line.</p>"
    start = time.time()
    assert "plain line" in html_text.main_text(f"<article>{body}{'</b>' * 200_000}</article>", weights)
    assert "plain line" in html_text.main_text("<div>" * 50_000 + f"<article>{body}</article>" + "</span></div>" * 50_000, weights)
    assert html_text.main_text("<!" * 100_000, weights) == ""
    assert len(html_text.main_text(f"<article><p>{'word ' * 1_000_000}</p><p>{'w' * (1 << 20)}</p></article>", weights)) == 5_000_000 - 1 + 2 + (1 << 20)
    assert time.time() - start < 30


def test_pages_table(spark):
    df = frame(spark, [(1, "u", "<p>Some words stand here</p>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert rows_of(html_text.extract_text(df)) == [(1, "u", "Some words stand here", 21), (2, None, "", 0), (2, None, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_best_run():
    for _ in range(200):
        rnd = random.Random(_)
        scores = [rnd.randrange(-5, 6) for _ in range(rnd.randrange(12))]
        low, high = html_text.best_run(scores)
        assert sum(scores[low:high]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])


# --- pieces

ODD = ["Hello  world\n x", " a", "", " ﬁ½ é é", "a\tb", "▁x", "x  ", "漢字かな🙂 z\x00", "     many   spaces", "http://a.b/c?d=1&e=2", "don't “quote” it’s", "1234567890 3.14", "<s> </s> <unk> <0x41>", "ab" * 3000]


def test_pieces_equal_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    codec = pieces.Codec(pieces.read_model(PIECE_MODEL))
    for text in [*(t or "" for _, t in docs), *ODD]:
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text), text
        assert codec.decode(ids) == text.replace("▁", " ")


def test_pieces_of_long_words_and_long_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    codec = pieces.Codec(pieces.read_model(PIECE_MODEL))
    rnd = random.Random(2)
    word, text = "".join(rnd.choice("abcdeé漢") for _ in range(1 << 20)), " ".join(rnd.choice(WORDS) for _ in range(600_000))
    ids, first = codec.encode_all(pa.array(["a b", word, None, "", text, "a b"]))
    assert first[1] == first[-1] - first[-2] and first[2] == first[3] == first[4]
    assert codec.round_trips(pa.array(["a b", word, None, "", text, "a b"]), ids, first).all()
    assert ids[first[4] : first[5]].tolist() == library.encode(text)
    assert codec.held <= pieces.REMEMBERED and max(map(len, codec.known)) <= pieces.LONGEST
    lost = pa.array(["a", "x▁y", "b"])
    assert codec.round_trips(lost, *codec.encode_all(lost)).tolist() == [True, False, True]
    wrong, first = codec.encode_all(pa.array(["one two", "three"]))
    assert codec.round_trips(pa.array(["one tow", "three"]), wrong, first).tolist() == [False, True]


def test_pieces_of_a_unigram_model_are_the_best_path():
    rnd = random.Random(9)
    names = ["<unk>", "<s>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁c", "bca", "dd"]
    model = {"pieces": names, "scores": [0.0, 0.0] + [-rnd.uniform(1, 9) for _ in names[2:]], "types": [2, 3] + [1] * (len(names) - 2), "bpe": False, "prefix": True, "unknown_surface": " ⁇ ", "key": "test"}
    codec = pieces.Codec(model)
    score = dict(zip(names[2:], model["scores"][2:]))

    def best(text):
        if not text:
            return 0.0
        options = [score[text[:k]] + best(text[k:]) for k in range(1, 4) if text[:k] in score]
        if text[0] not in score:
            options.append(codec.worst + best(text[1:]))
        return max(options)

    for _ in range(150):
        text = "".join(rnd.choice("abc d") for _ in range(rnd.randrange(1, 12)))
        ids = codec.encode(text).tolist()
        total = sum(codec.worst if i == 0 else model["scores"][i] for i in ids)
        assert total == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_pieces_table(spark, docs):
    df = frame(spark, [(*d, "x") for d in docs] + [(1, t, "y") for t in ODD], SCHEMA + ", ids string")
    coded = pieces.encode_pieces(df, PIECE_MODEL)
    got = pieces.decode_pieces(coded, PIECE_MODEL).collect()
    assert len(got) == df.count() and all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert all(r["round_trip"] == ("▁" not in (r["text"] or "")) for r in got)
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert pieces.encode_pieces(df.limit(0), PIECE_MODEL).count() == 0


# --- quality


def test_quality_held_out(spark):
    rnd = random.Random(5)
    good = lambda: ". ".join(" ".join(rnd.choice(WORDS) for _ in range(8)).capitalize() for _ in range(rnd.randrange(2, 12)))
    bad = lambda: " ".join(rnd.choice(WORDS).upper() + rnd.choice(["!!", "###", " |"]) for _ in range(rnd.randrange(20, 90)))
    rows, labels = [], []
    for i in range(600):
        y = int(rnd.random() < 0.8)
        rows.append((i, good() if y else bad()))
        labels.append((i, y))
    docs, known = frame(spark, rows, "id long, text string"), frame(spark, labels[:300] + labels[:5] + [(None, 1), (7, None), (9999, 1)], "id long, label int")
    model = quality.train_quality(docs, known)
    assert model.prior == pytest.approx(sum(y for _, y in labels) / 600, abs=0.1)
    odd = frame(spark, [(*r, "q") for r in rows] + [(1000, None, "q"), (1001, "", "q"), (1002, good() * 300, "q")], "id long, text string, quality_score string")
    got = {r["id"]: r["quality_score"] for r in quality.score_quality(odd, model).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.3) == (y == 1) for i, y in labels[300:]]
    assert sum(right) >= 0.95 * len(right)
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a")], "id long, text string")
    model = quality.train_quality(docs, frame(spark, [], "id long, label int"))
    assert [r["quality_score"] for r in quality.score_quality(docs, model).collect()] == [0.5]


def test_prior_is_near_the_true_share():
    rnd = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        y = rnd.random(6000) < share
        xu, xp = rnd.normal(np.where(y, 2, -2)[:, None], 1, (6000, 4)), rnd.normal(2, 1, (2000, 4))
        assert quality.fit_with_prior(xp, xu, quality.QualityParams(epochs=20))[2] == pytest.approx(share, abs=0.04)
    assert 0 < quality.fit_with_prior(xp[:1], xu[:1], quality.QualityParams(epochs=1))[2] < 1


def test_nnpu_gradient_and_the_sign_of_its_step():
    """A first step of the fit against the risk's numeric gradient: with the first batch Adam goes against its sign."""
    rnd = np.random.default_rng(2)
    xp, xu, prior = rnd.normal(1, 1, (50, 3)), rnd.normal(0, 1, (70, 3)), 0.4
    p = quality.QualityParams(epochs=1, batch=70, decay=0.0)  # one step

    def risk(w, a, b):
        negative = np.logaddexp(0, b @ w).mean() - prior * np.logaddexp(0, a @ w).mean()
        return prior * np.logaddexp(0, -(a @ w)).mean() + max(0.0, negative)

    draw = np.random.default_rng(3)
    one = lambda x, k: np.hstack([x, np.ones((len(x), 1))])[k]
    a, b = one(xp, draw.integers(0, 50, 70)), one(xu, draw.integers(0, 70, 70))
    slope = np.array([(risk(np.eye(4)[k] * 1e-6, a, b) - risk(np.eye(4)[k] * -1e-6, a, b)) / 2e-6 for k in range(4)])
    w, bias = quality.fit_nnpu(xp, xu, prior, p)
    assert (np.sign([*w, bias]) == -np.sign(slope)).all()
    assert np.abs([*w, bias]) == pytest.approx(p.rate + 1e-4, rel=1e-3)


def test_nnpu_beats_the_prior():
    rnd = np.random.default_rng(0)
    xp, xn = rnd.normal(1, 1, (800, 3)), rnd.normal(-1, 1, (200, 3))
    w, b = quality.fit_nnpu(xp[:300], np.vstack([xp[300:], xn]), 500 / 700, quality.QualityParams())
    assert ((xp @ w + b) > 0).mean() > 0.9 and ((xn @ w + b) < 0).mean() > 0.8


def test_word_spans_end_at_texts():
    from driftloom.llm.common import string_bytes, word_spans

    data, offsets = string_bytes(pa.array(["ab", "cd e", None, "", " f"]))
    starts, ends, first = word_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "cd", "e", "f"] and first.tolist() == [0, 1, 3, 3, 3, 4]


def test_words_of_leaks_are_hashed_in_bounded_memory():
    """Arrays with a number for each byte were made for a whole slice of texts."""
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = pa.array([None, "", *(" ".join(f"Wé{k}" for k in rng.integers(0, 90, 2000)) for _ in range(350)), "last"])
    want = decontamination.words_of(texts)
    items = decontamination.Items(["a"], ["some other words that are in none of the texts here"])
    tracemalloc.start()
    found = decontamination.leaks_in(texts, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = decontamination.words_in_parts(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and len(got[0]) == len(want[0])
    assert not len(found[0]) and peak < 100e6
