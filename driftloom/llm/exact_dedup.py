"""Exact dedup against a minimal perfect hash over historical distinct digests."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACES, materialise, mix, runs, shuffle_parts

#: Digests that one shard of the history holds on average, and keys of one bucket of its perfect hash.
SHARD_KEYS, BUCKET_KEYS = 32768, 4


def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each 32-byte digest; the digest is uniform already."""
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1], words[:, 2]


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: a seed for each bucket, largest buckets first, so that n distinct digests fill n slots.

    digests: (n, 32) bytes. Returns the seeds and each digest's slot."""
    n = len(digests)
    a, b = _parts(digests)
    m = max(1, -(-n // BUCKET_KEYS))
    bucket = (a % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    first = np.concatenate([[0], np.cumsum(sizes)])
    seeds, slots, taken = np.zeros(m, np.uint32), np.full(n, -1, np.int64), np.zeros(n, bool)
    tries = np.arange(256, dtype=np.uint64)
    for k in np.argsort(-sizes, kind="stable"):
        own = order[first[k] : first[k + 1]]
        if not len(own):
            break
        base = 0
        while True:
            seed = tries + np.uint64(base)
            spot = (mix(b[own][None, :] + seed[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
            fits = ~taken[spot].any(axis=1)
            if len(own) > 1:
                ordered = np.sort(spot, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                i = int(np.argmax(fits))
                seeds[k] = base + i
                slots[own] = spot[i]
                taken[spot[i]] = True
                break
            base += 256
    return seeds, slots


def mph_slots(seeds: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    a, b = _parts(digests)
    seed = seeds[(a % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64)
    return (mix(b + seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def normalised(col):
    """The text without any white space."""
    return F.translate(F.coalesce(col.cast("string"), F.lit("")), SPACES, "")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, _id, _len (code points of the original), _digest (SHA-256 of the normalised text)."""
    return docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_len"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_digest"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """A row for each digest: the winner's length, id and row, and the number of rows. Combined before the shuffle."""
    rank = F.struct((-F.col("_len")).alias("len"), F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    return rows.groupBy("_digest").agg(F.min(rank).alias("_win"), F.count("*").alias("_size"))


def _blob_schema(id_type: str) -> str:
    return f"shard int, keys int, seeds binary, slots binary, ids array<{id_type}>, lens binary, rows binary, sizes binary"


def build_history(distinct: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: seeds and, by slot, full digests and the winners' locators (id, length, row, group size)."""
    id_type = distinct.schema["_win"].dataType["id"].dataType.simpleString()
    shaped = (
        distinct.select(shard_of(shards).alias("shard"), "_digest", F.col("_win.id").alias("id"), F.col("_win.len").alias("len"), F.col("_win.row").alias("row"), F.col("_size").alias("size"))
        .repartition(max(shuffle_parts(distinct.sparkSession), 1), "shard")
    )

    def build(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group.column("_digest").to_pylist()), np.uint8).reshape(-1, 32)
        seeds, slots = build_mph(raw)
        at = np.argsort(slots)
        num = lambda c: np.asarray(group.column(c).to_numpy(), np.int64)[at].tobytes()
        return pa.table(
            {
                "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "keys": pa.array([len(raw)], pa.int32()), "seeds": pa.array([seeds.tobytes()], pa.binary()),
                "slots": pa.array([raw[at].tobytes()], pa.binary()), "ids": pa.array([group.column("id").take(pa.array(at)).to_pylist()], pa.list_(group.schema.field("id").type)),
                "lens": pa.array([num("len")], pa.binary()), "rows": pa.array([num("row")], pa.binary()), "sizes": pa.array([num("size")], pa.binary()),
            }
        )

    return shaped.groupBy("shard").applyInArrow(build, _blob_schema(id_type))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("_digest"), F.lit(shards)).cast("int")


def look_up(rows: DataFrame, history: DataFrame, shards: int, spread: dict[int, int]) -> DataFrame:
    """Pass every row through its shard's perfect hash: rows and member, keep, keep_row, size.

    The shard's row precedes the documents in a sorted partition, so a task holds one shard and one batch. spread names
    the shards that hold many rows (at most as many as its builder allows) and over how many tasks each is dealt."""
    id_type = rows.schema["_id"].dataType.simpleString()
    copies = F.coalesce(F.create_map(*(F.lit(x) for kv in spread.items() for x in kv))[F.col("shard")], F.lit(1)) if spread else F.lit(1)
    none = lambda kind: F.lit(None).cast(kind)
    left = rows.select(shard_of(shards).alias("shard"), "*").withColumn("salt", F.pmod(F.xxhash64("_row"), copies).cast("int"))
    left = left.select("shard", "salt", F.lit(1).alias("kind"), "_row", "_id", "_len", "_digest", *(none(t).alias(c) for c, t in (("keys", "int"), ("seeds", "binary"), ("slots", "binary"), ("ids", f"array<{id_type}>"), ("lens", "binary"), ("rows", "binary"), ("sizes", "binary"))))
    right = history.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    right = right.select("shard", "salt", F.lit(0).alias("kind"), none("long").alias("_row"), none(id_type).alias("_id"), none("int").alias("_len"), none("binary").alias("_digest"), "keys", "seeds", "slots", "ids", "lens", "rows", "sizes")
    dealt = left.unionByName(right).repartition(shuffle_parts(rows.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    id_pa = to_arrow_type(rows.schema["_id"].dataType)

    def probe(batches):
        held, at = None, None
        for key, run in runs(batches, ["shard", "salt", "kind"]):
            if key[2] == 0:
                one = run.slice(0, 1)
                get = lambda c: one.column(c)[0].as_py()
                held, at = (np.frombuffer(get("seeds"), np.uint32), get("keys"), np.frombuffer(get("slots"), np.uint8).reshape(-1, 32), one.column("ids").flatten(), *(np.frombuffer(get(c), np.int64) for c in ("lens", "rows", "sizes"))), key[:2]
                continue
            raw = np.frombuffer(b"".join(run.column("_digest").to_pylist()), np.uint8).reshape(-1, 32)
            n = len(raw)
            if held is not None and at == key[:2]:
                seeds, keys, slots, ids, lens, rws, sizes = held
                spot = mph_slots(seeds, keys, raw)
                member = (slots[spot] == raw).all(axis=1)  # every byte: a perfect hash sends strangers to some slot too
                keep, keep_row, keep_len, size = ids.take(pa.array(spot)), rws[spot], -lens[spot], sizes[spot]
            else:
                member, keep, keep_row, keep_len, size = np.zeros(n, bool), pa.nulls(n, id_pa), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([run.column("_row"), run.column("_id"), run.column("_len"), run.column("_digest"), pa.array(member), keep.cast(id_pa), pa.array(keep_row), pa.array(keep_len), pa.array(size)], ["_row", "_id", "_len", "_digest", "member", "keep", "keep_row", "keep_len", "size"])

    return dealt.mapInArrow(probe, f"_row long, _id {id_type}, _len int, _digest binary, member boolean, keep {id_type}, keep_row long, keep_len long, size long")


def probe_history(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """rows with member, keep, keep_row and size, through the perfect hash over distinct; shards that hold many rows are
    dealt over many tasks."""
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    limit = max(2048, -(-rows.count() // 512))
    # At most rows / limit <= 512 shards exceed the limit, however large the table.
    spread = {r["shard"]: -(-r["count"] // limit) for r in rows.groupBy(shard_of(shards).alias("shard")).count().filter(F.col("count") > limit).collect()}
    return look_up(rows, build_history(distinct, shards), shards, spread)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for each row which row of the same normalised text stays. Keeps no text: id_col, _row and the decision.

    Returns _row (the row's number in this reading of docs), _len (code points of its text), id_col, keep_id, group_size, kept, text_sha256.

    history: distinct digests of an earlier corpus (as distinct_digests() gives them), whose rows are then the winners
    of their groups: kept is false for every member. Rows that the history doesn't hold group separately.

    Without it, a half of the rows (by a hash of their number) is the history of the other: the other half's rows are
    looked up in the perfect hash over the first half's distinct digests, the members' best rows are merged into the
    locators, nonmembers group separately. A group of many rows has some in the history, so nonmembers' groups are small.

    Ids may be of any type that has an order. Null text is empty; a null id loses against any other of the same length,
    and of rows alike in length and id exactly one stays. Empty tables give empty results; other columns are ignored."""
    rows = materialise(digest_rows(docs, id_col, text_col), "digests")
    if history is None:
        first = F.pmod(F.xxhash64("_row", F.lit(4)), F.lit(2)) == 0
        known = materialise(distinct_digests(rows.filter(first)), "distinct")
        fresh = materialise(probe_history(rows.filter(~first), known), "probed")
        strangers = fresh.filter(~F.col("member"))
        more = distinct_digests(fresh.filter("member")).select("_digest", F.col("_win").alias("_win2"), F.col("_size").alias("_size2"))
        best = F.when(F.col("_win2").isNull(), F.col("_win")).otherwise(F.least("_win", "_win2"))
        known = materialise(known.join(more, "_digest", "left").select("_digest", best.alias("_win"), (F.col("_size") + F.coalesce("_size2", F.lit(0))).alias("_size")), "merged")
        members = probe_history(rows.filter(first).unionByName(fresh.filter("member").select(*rows.columns)), known).filter("member")
        kept = F.col("keep_row") == F.col("_row")
    else:
        found = materialise(probe_history(rows, materialise(history, "distinct")), "probed")
        members, strangers, kept = found.filter("member"), found.filter(~F.col("member")), F.lit(False)
    members = members.select("_row", "_id", "_len", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "_digest")
    strangers = strangers.select("_row", "_id", "_len", "_digest")
    fresh = strangers.join(distinct_digests(strangers), "_digest").select("_row", "_id", "_len", F.col("_win.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_win.row") == F.col("_row")).alias("kept"), "_digest")
    return members.unionByName(fresh).select("_row", "_len", F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row that stays of each group of equal texts only, by exact_dedup(); of repeated rows one stays."""
    kept = exact_dedup(docs, history, id_col, text_col).filter("kept")
    keys = ["_driftloom_none", "_driftloom_key", "_driftloom_sha", "_driftloom_chars"]
    name = lambda df, sha, chars: df.withColumns({"_driftloom_none": F.col(id_col).isNull(), "_driftloom_key": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_driftloom_sha": sha, "_driftloom_chars": chars})
    winners = name(kept, F.col("text_sha256"), F.col("_len")).select(*keys)
    named = name(docs, F.sha2(normalised(F.col(text_col)), 256), F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    # Ids spread the rows of a large group over the tasks; the last step has the join's partitioning.
    return named.join(winners, keys).dropDuplicates(keys).select(*docs.columns)
