"""Exact top-k inner-product search by MaxScore over sharded postings.

Vectors are quantised to whole numbers, component by component. A query term is a dimension with a non-zero weight; the posting of a
vector in it is the vector's distance from the step's least useful value of the dimension, so every impact is at least zero and
a constant per query restores the score. Per query, terms are ordered by their bounds; those whose bounds together cannot lift a
vector over the current k-th score are non-essential. The essential postings of a step are traversed, and the other terms are probed,
largest bound first, only for vectors that can still compete. Shards return k rows a query, and a window merges them.

The first shard is searched before the others: its k-th scores are the floors from which these start. Shards have a bounded number of rows and queries stand in blocks. A task
has one shard and streams the blocks of queries from their table in the shared folder, a few at a time, so neither shards nor blocks are multiplied by a shuffle. Only while there are
fewer shards than tasks at a time are the blocks divided into groups, each with a copy of the shard. The folder is reached through ``pyarrow.fs`` (file, hdfs, s3, gs, abfs).

Vectors of any finite size take part. A shard holds vectors of one magnitude. Where sums in doubles could round (``EXACT`` and more), bounds
and thresholds are widened by the largest possible rounding, and the vectors that still compete are scored in whole numbers without limit.

Defined results: null vectors and those with null or non-finite components take no part (nor do components that the scale lifts beyond
a double's range); a vector of another length than ``dim`` has zeros where it is shorter, and components beyond ``dim`` count for nothing;
a row with the query's own id is no candidate; repeated rows with other ids are candidates; an id with several vectors is one query, ranked over the scores of all of them, and a candidate once for each; ties go to
the smaller id; a query with fewer candidates than k returns all; scores beyond a 64-bit number are ranked as they are and shown
as the nearest such number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

SHARD_ROWS, BLOCK_ROWS = 16_384, 512
#: Tasks wanted for each core, from which the groups of query blocks follow; blocks that a task reads at a time.
TASKS_EACH, READ_BLOCKS = 4, 4
#: A shard is traversed in steps; each has bounds of its own, and its scores raise the threshold of the next.
STEP = 4_096
#: Non-essential terms are probed so many at a time, the largest bounds first.
PROBE = 8
#: Sums under it are exact in doubles, and under the square root of it in single precision.
EXACT = float(1 << 53)
#: Components under it make up the ordinary shards; the others are shards of similar magnitude each.
ORDINARY_BITS, CLASS_BITS = 23, 24
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, cls): whole components (as doubles) of the vectors that take part, ``dim`` of them, and their class of magnitude."""
    e = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", whole))
    # Beyond 2^53 every double is whole, and Spark's floor would end at a long's range.
    floor = F.transform(F.slice("e", 1, dim), lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    padded = F.concat(floor, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size("e"), F.lit(0))))
    most = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    cls = F.when(most < float(1 << ORDINARY_BITS), 0).otherwise(F.floor((F.log2(most) - ORDINARY_BITS) / CLASS_BITS) + 1).cast("int")
    return rows.select("vec_id", padded.alias("v")).select("vec_id", "v", cls.alias("cls"))


def packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per group of ``key``: ids and matrix as little-endian bytes, ids ascending. Groups have a bounded number of rows."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        m = np.asarray(t["v"].combine_chunks().flatten().to_numpy(), "<f8").reshape(len(ids), -1)[order]
        return pa.table({key: [keys[0].as_py()], "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})

    return rows.select(key, "vec_id", "v").groupBy(key).applyInArrow(run, f"{key} long, ids binary, m binary")


def two_power(most: float) -> int:
    """The exponent by which numbers up to ``most`` are brought under one; none for ordinary ones, so that they stay whole."""
    return 0 if most < float(1 << ORDINARY_BITS) else int(np.frexp(most)[1])


def order_key(score: int) -> bytes:
    """Bytes that sort scores beyond a 64-bit number; all others have the same."""
    if -LONG - 1 <= score <= LONG:
        return b"\x80\x00"
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return struct.pack(">H", 0x8000 + size) + score.to_bytes(size, "big")
    return struct.pack(">H", 0x8000 - size) + ((1 << 8 * size) + score).to_bytes(size, "big")


class Postings:
    """Impacts of one shard per step and dimension: how far each vector is over the step's least value."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        # Similar vectors stand together, so the bounds of a step are narrow: by the dimension that sets them apart most.
        order = np.argsort(m[:, int(np.argmax(m.std(axis=0)))], kind="stable") if len(ids) > STEP else np.arange(len(ids))
        self.ids, self.whole = ids[order], m[order]
        self.shift = two_power(float(np.abs(m).max(initial=0.0)))
        cols = np.ascontiguousarray(np.ldexp(self.whole, -self.shift).T)
        self.steps = []
        for lo in range(0, len(ids), STEP):
            part = cols[:, lo : lo + STEP]
            low, high = part.min(axis=1), part.max(axis=1)
            wide = part - low[:, None]
            self.steps.append((lo, low, high, wide, wide.astype(np.float32) if not self.shift else None))
        self.seen = self.skipped = 0

    def search(self, qid: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[list[int], list[int]]:
        """Ids and exact scores of the best k candidates; those below ``floor`` may be left out."""
        shift = two_power(float(np.abs(q).max(initial=0.0)))
        all_terms = np.flatnonzero(q)
        all_weight = np.ldexp(q[all_terms], -shift)
        total = self.shift + shift
        best: list[tuple[int, int]] = []  # (-score, id), the best first
        # Steps whose bounds promise most come first.
        plans = []
        for lo, low, high, wide, single in self.steps:
            base = float(np.where(all_weight > 0, all_weight * low[all_terms], all_weight * high[all_terms]).sum())
            bound = np.abs(all_weight) * (high - low)[all_terms]
            plans.append((-(base + float(bound.sum())), lo, base, bound, wide, single, float((np.abs(all_weight) * np.maximum(np.abs(low), np.abs(high))[all_terms]).sum())))
        plans.sort(key=lambda x: x[:2])
        for _, lo, base, bound, wide, single, size in plans:
            order = np.argsort(bound, kind="stable")
            terms, weight, bound = all_terms[order], all_weight[order], bound[order]
            sums = np.concatenate([[0.0], np.cumsum(bound)])  # sums[i]: bound of the i weakest terms together
            lift = np.where(weight < 0, bound, 0.0)  # a negative weight counts down from its bound
            exact = not total and size + sums[-1] < EXACT
            slack = 0.0 if exact else (size + sums[-1]) * 2.0**-40
            # Whole numbers under 2**24 are exact in single precision, partial sums included.
            impact, signed = (single, weight.astype(np.float32)) if exact and single is not None and sums[-1] < 1 << 24 else (wide, weight)
            known = [x for x in (floor, -best[k - 1][0] if len(best) >= k else None) if x is not None]
            need = scaled_down(max(known), total) - base - slack if known else -np.inf
            n = wide.shape[1]
            self.seen += n * len(terms)
            if sums[-1] < need:
                self.skipped += n * len(terms)
                continue
            split = max(0, min(int(np.searchsorted(sums, need, side="left")) - 1, len(terms))) if need > 0 else 0
            score = signed[split:] @ impact[terms[split:]] + lift[split:].sum()
            at = np.flatnonzero(score + sums[split] >= need)
            self.skipped += (n - len(at)) * split
            score = score[at]
            for j in range(split, 0, -PROBE):
                if not len(at):
                    break
                g = slice(max(0, j - PROBE), j)
                if 4 * len(at) > n:  # many still compete: a run over the postings is cheaper than picking from them
                    more = (signed[g] @ impact[terms[g]])[at]
                else:
                    more = signed[g] @ impact[terms[g, None], at]
                score = score + more + lift[g].sum()
                left = score + sums[g.start] >= need
                self.skipped += int(len(at) - left.sum()) * g.start
                at, score = at[left], score[left]
            at, score = at[self.ids[lo + at] != qid], score[self.ids[lo + at] != qid]
            if len(at) > k:  # rows at the k-th score stay: ties go by id below
                fair = score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * slack
                at, score = at[fair], score[fair]
            if exact:
                found = zip((-np.rint(score + base)).astype(np.int64).tolist(), self.ids[lo + at].tolist(), strict=True)
            else:
                mine = [int(x) for x in q]
                found = ((-sum(a * int(b) for a, b in zip(mine, self.whole[lo + i].tolist(), strict=True) if a), int(self.ids[lo + i])) for i in at.tolist())
            best = sorted([*best, *found])[:k]
        return [i for _, i in best], [-s for s, _ in best]


def scaled_down(score: int, bits: int) -> float:
    """``score`` times two to the power of minus ``bits``, not more than that."""
    if not bits:
        return float(score) if abs(score) < EXACT else float(np.nextafter(float(score), -np.inf))
    drop = max(0, abs(score).bit_length() - 53)
    return float(np.ldexp(float(score >> drop), drop - bits))


SCHEMA = "query_id long, vec_id long, score long, beyond binary"


def query_blocks(files: list[str], grp: int) -> Iterator[tuple[bytes, bytes, list[dict] | None]]:
    """(ids, matrix, floors) of a group's blocks, read where the task runs."""
    if not files:
        return
    stores = [fs.FileSystem.from_uri(f) for f in files]
    table = ds.dataset([name for _, name in stores], filesystem=stores[0][0], format="parquet")
    for b in table.to_batches(columns=["q_ids", "q_m", "floors"], filter=ds.field("grp") == grp, batch_size=READ_BLOCKS, batch_readahead=1, fragment_readahead=1):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def search(vectors: DataFrame, is_query: Column, k: int = 20, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every row that ``is_query`` (over vec_id) picks."""
    rows = materialize(quantised(vectors, dim, scale, id_col, vec_col), "vectors")
    # A few dozen classes of magnitude at most, as doubles have so many.
    counts = [(r["cls"], r["n"], r["q"]) for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).orderBy("cls").collect()]
    parts = [(c, max(1, -(-n // SHARD_ROWS))) for c, n, _ in counts]
    shards, blocks = max(1, sum(p for _, p in parts)), max(1, -(-sum(q for *_, q in counts) // BLOCK_ROWS))
    first = 0
    shard = F.lit(None).cast("long")
    for c, p in parts:
        shard = F.when(F.col("cls") == c, F.pmod(F.xxhash64("vec_id"), F.lit(p)) + first).otherwise(shard)
        first += p
    # As many groups as keep all cores busy where shards are few; with more shards than that, one.
    groups = max(1, min(blocks, -(-TASKS_EACH * vectors.sparkSession.sparkContext.defaultParallelism // shards)))
    held = materialize(packed(rows.withColumn("shard", shard.cast("long")), "shard"), "shards")
    asked = packed(rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long")), "block").withColumnsRenamed({"ids": "q_ids", "m": "q_m"})
    asked = materialize(asked.withColumn("grp", F.pmod("block", F.lit(groups)).cast("long")), "asked")

    def searched(numbers: range, with_floor: DataFrame) -> DataFrame:
        """Every block against the shards of these numbers, a task for a shard and a group of blocks."""
        files = [f for f in with_floor.inputFiles() if f.endswith(".parquet")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, m, grp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    postings = Postings(np.frombuffer(ids, "<i8"), np.frombuffer(m, "<f8").reshape(-1, dim))
                    for q_ids, q_m, floors in query_blocks(files, grp):
                        start = {f["query_id"]: f["floor"] for f in floors or ()}
                        out: list[tuple] = []
                        for qid, q in zip(np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q_m, "<f8").reshape(-1, dim), strict=True):
                            found, score = postings.search(qid, q, k, start.get(qid))
                            out += [(qid, i, max(-LONG - 1, min(LONG, s)), order_key(s)) for i, s in zip(found, score, strict=True)]
                        columns = list(zip(*out, strict=True)) or [()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["query_id", "vec_id", "score", "beyond"])

        here = held.where(F.col("shard").between(numbers[0], numbers[-1])).select("ids", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
        return here.repartition(max(1, len(numbers) * groups)).mapInArrow(run, SCHEMA)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.lit(None).cast("array<struct<query_id:long,floor:long>>")
    plain = materialize(asked.withColumn("floors", none), "asked-first")
    found = early = materialize(merged(searched(range(1), plain)).drop("rank"), "first")
    if shards > 1:
        # A k-th score that isn't a 64-bit number is left out where it is below, and a floor as well where it is above.
        kth = found.groupBy("query_id").agg(F.min_by("score", F.struct("score", "beyond")).alias("floor"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= k) & (F.col("floor") > -LONG - 1))
        mine = kth.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("long"))
        floors = mine.groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))  # the queries of a block
        informed = materialize(asked.join(floors, "block", "left"), "asked-then")
        found = found.unionByName(searched(range(1, shards), informed))
    out = materialize(merged(found).select("query_id", "rank", "vec_id", "score"), "topk")
    for df in (rows, held, asked, plain, early, *([informed] if shards > 1 else [])):
        drop_table(df)
    return out
