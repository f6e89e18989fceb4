"""Sharding over fixed virtual slots.

A record's slot is a hash of its id, modulo a fixed number of slots. Bytes are aggregated per slot, and a versioned table
maps slots to shards. Rebalancing and growing edit that table: a new version moves a few slots, and no record is hashed anew.
The first version gives every shard as many slots; each call of :func:`assign` measures the bytes per slot and edits the latest version where its shards aren't even.

The law is ``bytes``: sizes near equal. Equal texts aren't held together, for a group of copies can be larger than a shard.

Defined results: a null text has size 1, an empty text too; repeated rows are placed one by one (equal ids share a slot and
so a shard); an empty table gives no rows; a null id hashes like any value. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 8192
#: In an assignment a shard may be over the mean by this share before slots move.
TOLERANCE = 0.001


def sized(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot): UTF-8 bytes plus one, checksum and virtual slot of each record."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, n): one row a slot, summed before the shuffle."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def even_slots(shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """The first version of a map: slots dealt in turn."""
    return {slot: slot % shards for slot in range(n_slots)}


def rebalance(current: dict[int, int], loads: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """An edited map: slots leave the heaviest shards for the lightest until all are within ``tolerance`` of the mean.

    Growing is a call with more shards than ``current`` uses: slots then move into the new shards alone while these are light.
    """
    out, totals = dict(current), dict.fromkeys(range(shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in out.items():
        totals[shard] += loads.get(slot, 0)
        held[shard].append((loads.get(slot, 0), slot))
    mean = sum(totals.values()) / shards
    for x in held.values():
        x.sort()
    for _ in range(4 * len(out)):
        high, low = max(totals, key=lambda s: (totals[s], s)), min(totals, key=lambda s: (totals[s], s))
        if totals[high] <= mean * (1 + tolerance):
            break
        # The load nearest to half the difference evens the two out most; one beyond the difference would make it worse.
        gap = totals[high] - totals[low]
        fit = [(abs(2 * load - gap), i) for i, (load, _) in enumerate(held[high]) if 0 < load < gap]
        if not fit:
            break
        load, slot = held[high].pop(min(fit)[1])
        out[slot] = low
        totals[high] -= load
        totals[low] += load
        held[low].append((load, slot))
        held[low].sort()
    return out


def map_frame(spark: SparkSession, mapping: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, k, v) for k, v in sorted(mapping.items())], "version int, vslot int, shard int")


def store_map(spark: SparkSession, path: str, mapping: dict[int, int]) -> int:
    """Append a new version to the map table at ``path`` and return its number."""
    version = latest_version(spark, path) + 1
    map_frame(spark, mapping, version).coalesce(1).write.mode("append").parquet(path)
    return version


def latest_version(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.schema("version int, vslot int, shard int").parquet(path).agg(F.max("version")).first()[0] or 0


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = version or latest_version(spark, path)
    return spark.read.schema("version int, vslot int, shard int").parquet(path).where(F.col("version") == version).drop("version")


def assign(docs: DataFrame, map_path: str, shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """Place all records: doc_id, size, text_crc32, vslot, shard, slot (a record's number in its shard, gapless from 0).

    The map has one row a slot, so planning it on the driver and broadcasting it are bounded by ``n_slots``. Numbers in a
    shard are a slot's base, from counts per slot, plus a number in the slot: no task sorts a whole shard.
    """
    spark = docs.sparkSession
    rows = sized(docs, n_slots)
    stats = {r["vslot"]: (r["bytes"], r["n"]) for r in slot_loads(rows).collect()}
    if not latest_version(spark, map_path):
        store_map(spark, map_path, even_slots(shards, n_slots))
    mapping = {r["vslot"]: r["shard"] for r in load_map(spark, map_path).collect()}
    edited = rebalance(mapping, {k: v[0] for k, v in stats.items()}, shards, TOLERANCE)
    if edited != mapping:
        store_map(spark, map_path, edited)
        mapping = {r["vslot"]: r["shard"] for r in load_map(spark, map_path).collect()}
    bases, filled = [], dict.fromkeys(range(shards), 0)
    for slot in sorted(stats):
        bases.append((slot, mapping[slot], filled[mapping[slot]]))
        filled[mapping[slot]] += stats[slot][1]
    base = spark.createDataFrame(bases, "vslot int, shard int, base long")
    in_slot = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("k", F.row_number().over(in_slot) - 1)
    return numbered.join(F.broadcast(base), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("k")).alias("slot"))
