"""Substring dedup with difference-cover anchors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, materialise, mix, segment_hashes, shuffle_parts, string_bytes, word_hashes, word_spans
from .simhash import joined_words, slices

#: Perfect difference sets by period: every difference modulo the period is one of two members. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


#: A group of copies is large if it has more than this share (1 / HOT) of all rows, and more than HOT_ROWS.
HOT, HOT_ROWS = 512, 4096


def period_for(window: int) -> int:
    """The longest period that leaves anchors of at least a third of the window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= max(4, window // 3))


def _texts(part: pa.RecordBatch):
    data, offsets = string_bytes(part.column("text"))
    starts, ends, first = word_spans(data, offsets)
    return data, starts, ends, first


def _positions(first: np.ndarray, length: int):
    """Each run of length words within one text: global index of its first word, its text, its place in the text."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][doc] + place, doc, place


def _combine(h: np.ndarray) -> np.ndarray:
    """Per row: 0 alone in this batch, 1 the first of several, 2 one of the rest."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    again = np.append(s[1:] == s[:-1], False)
    kind = np.empty(len(h), np.int8)
    kind[order] = np.where(~new, 2, np.where(again, 1, 0))
    return kind


def _pack(high: np.ndarray, kind: np.ndarray, place: np.ndarray) -> pa.Array:
    """32 bits, the kind and a place below 2 ** 30 in one long: narrow rows shuffle best."""
    return pa.array((high.astype(np.int64) << 32) | (kind.astype(np.int64) << 30) | place)


def _repeated(rows: DataFrame, wide: bool) -> DataFrame:
    """doc, check and place of the rows whose hash occurs more than once, in one shuffle.

    rows: h, doc, packed (check, kind and place), or with wide h, doc, check, packed (more bits of the hash, kind, place).
    Repeats within a batch were marked before: the first (kind 1) goes to its hash's task, the rest (2) anywhere. So a hash
    that fills the corpus sends one row a batch to that task. Sorted tasks find the other repeats from neighbour to
    neighbour."""
    kind = F.shiftrightunsigned("packed", 30).bitwiseAND(F.lit(3))
    deal = F.when(kind == 2, F.xxhash64("doc", "packed")).otherwise(F.col("h"))
    dealt = rows.repartition(shuffle_parts(rows.sparkSession), deal).sortWithinPartitions("h", *(["packed"] if wide else []))

    def run(batches):
        held, tail = None, None  # a last row of unknown fate; the last row's hash if it is known to repeat
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            packed = table.column("packed").to_numpy()
            cols = [table.column("h").to_numpy(), *([packed >> 32] if wide else [])]
            same = np.ones(table.num_rows - 1, bool)
            for c in cols:
                same &= c[1:] == c[:-1]
            twice = (packed >> 30 & 3) > 0
            twice[1:] |= same
            twice[:-1] |= same
            if tail is not None:
                lead = np.ones(table.num_rows, bool)
                for c, t in zip(cols, tail):
                    lead &= c == t
                twice |= lead
            last = table.num_rows - 1
            if twice[last]:
                held, tail = None, tuple(c[last] for c in cols)
            else:
                held, tail = table.slice(last).combine_chunks().to_batches()[0], None
            check = table.column("check").to_numpy() if wide else (packed >> 32).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(table.column("doc").to_numpy()[twice]), pa.array(check[twice]), pa.array((packed[twice] & 0x3FFFFFFF).astype(np.int32))], ["doc", "check", "place"])

    return dealt.mapInArrow(run, "doc long, check int, place int")


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of words whose sequence also starts anywhere else in docs.

    Returns id_col, kept_text (kept words joined by one space), n_words, n_removed: a row for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+, compared unchanged; windows lie within a text and are judged on the input. Null text has
    no words. Repeated rows are occurrences of their own, so their windows repeat. A null id is kept as null. An empty
    table gives an empty result; other columns are ignored.

    0. Of equal texts, one stands for all in the search; all of a group of equal texts of a window or more goes.
    1. Anchors (window - period + 1 words) are hashed at the cover's places modulo the period only. Two equal windows
       share an anchor at an offset under the period where both are at places of the cover.
    2. Repeated anchors extend: the full windows around them, and only those, are hashed (96 bits) and matched.
    3. Words of repeated windows are marked and left out.
    Rows of hashes travel, no pairs are made, and the texts are shuffled once for all steps."""
    period = period_for(window)
    cover, anchor = np.isin(np.arange(period), COVERS[period]), window - period + 1
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("doc", F.xxhash64("id", "text")).withColumn("check", F.hash("text", "id"))
    key = ["doc", "check"]  # 96 bits that tell the rows' ids and texts apart

    same = materialise(base.select(*key, F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2")), "texts")
    groups = materialise(same.groupBy("c1", "c2").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    # Groups of so many rows that at most HOT can exist are broadcast, so that no task gets all rows of one.
    limit = max(HOT_ROWS, -(-same.count() // HOT))
    marked = same.join(F.broadcast(groups.filter(F.col("n") > limit).select("c1", "c2", F.col("first").alias("hot"))), ["c1", "c2"], "left")
    rest = marked.filter("hot IS NULL").join(groups.filter(F.col("n") <= limit).select("c1", "c2", "first"), ["c1", "c2"])
    pairs = rest.select(*key, "first").unionByName(marked.filter("hot IS NOT NULL").select(*key, F.col("hot").alias("first")))
    copies = pairs.groupBy(*key).agg(F.min(F.struct(*key) != F.col("first")).alias("rest"))
    # Every step reads the same columns of the same shuffle, which Spark then runs once. The other sides are small next
    # to the texts, so each task hashes them and need not sort texts.
    parts = base.repartition(shuffle_parts(spark), *key).join(copies.hint("shuffle_hash"), key, "left")
    shown = parts.filter(~F.coalesce("rest", F.lit(False)))

    def anchors(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, first = _texts(part)
                at, doc, place = _positions(first, anchor)
                # Anchors of texts shorter than a window can't extend.
                take = cover[place % period] & (np.diff(first)[doc] >= window)
                at, doc, place = at[take], doc[take], place[take]
                h = segment_hashes(word_hashes(data, starts, ends), at, at + anchor, BASE_B)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), part.column("doc").take(pa.array(doc)), _pack(part.column("check").to_numpy()[doc], _combine(h), place)], ["h", "doc", "packed"])

    found = _repeated(shown.select("id", "text", *key).mapInArrow(anchors, "h long, doc long, packed long"), wide=False)
    anchored = found.groupBy(*key).agg(F.collect_set("place").alias("places"))

    def extend(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, starts, ends, first = _texts(part)
                places = part.column("places")
                n = pa.compute.list_value_length(places).to_numpy()
                row = np.repeat(np.arange(part.num_rows), n)
                near = places.flatten().to_numpy()
                sizes = np.diff(first)
                # Windows that hold a repeated anchor: up to period - 1 words before it. Marked, so that each counts once.
                marks = np.zeros(int(first[-1]) + len(sizes) + 1, np.int32)
                low = np.maximum(near - (period - 1), 0)
                high = np.minimum(near, sizes[row] - window)
                shift = first[:-1] + np.arange(len(sizes))  # one spare place between texts
                np.add.at(marks, shift[row] + low, 1)
                np.add.at(marks, shift[row] + high + 1, -1)
                spot = np.flatnonzero(np.cumsum(marks) > 0)
                doc = np.searchsorted(shift, spot, side="right") - 1
                place = spot - shift[doc]
                at = first[:-1][doc] + place
                words = word_hashes(data, starts, ends)
                h, g = segment_hashes(words, at, at + window, BASE_A), segment_hashes(mix(words + np.uint64(1)), at, at + window, BASE_B)
                own = pa.array(doc)
                g = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *(part.column(c).take(own) for c in key), _pack(g, _combine(h), place)], ["h", *key, "packed"])

    windows = shown.join(anchored.hint("shuffle_hash"), key).select("id", "text", *key, "places").mapInArrow(extend, "h long, doc long, check int, packed long")
    again = _repeated(windows, wide=True)
    marked = again.groupBy(*key).agg(F.collect_set("place").alias("places"))
    joined = parts.join(marked.hint("shuffle_hash"), key, "left").select("id", "text", *key, "places", F.col("rest").isNotNull().alias("copied"))

    id_type = base.schema["id"].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, first = _texts(part)
                places = part.column("places")
                n = pa.compute.fill_null(pa.compute.list_value_length(places), 0).to_numpy()
                row, spot = np.repeat(np.arange(part.num_rows), n), places.flatten().to_numpy()
                marks = np.zeros(len(starts) + 1, np.int32)
                at = first[:-1][row] + spot
                np.add.at(marks, at, 1)
                np.add.at(marks, at + window, -1)
                stay = np.cumsum(marks[:-1]) == 0
                sizes = np.diff(first)
                stay &= ~np.repeat(np.asarray(part.column("copied").to_numpy(zero_copy_only=False), bool) & (sizes >= window), sizes)
                line, _, to = joined_words(data, starts[stay], ends[stay])
                kept_first = np.searchsorted(np.flatnonzero(stay), first)
                edge = np.append(0, to + 1)[kept_first]  # each text's words with a space after the last
                size = np.maximum(np.diff(edge) - 1, 0)
                ends_at = np.append(0, np.cumsum(size))
                drop = edge[1:][np.diff(edge) > 0] - 1
                body = np.delete(line, drop)
                text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(ends_at.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), text, pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(kept_first), pa.int64())], [id_col, "kept_text", "n_words", "n_removed"])

    return joined.mapInArrow(keep, f"{id_col} {id_type}, kept_text string, n_words long, n_removed long")
