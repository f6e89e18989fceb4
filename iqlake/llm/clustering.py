"""Centroid clustering (Lloyd's rounds) filtered by ball trees.

Vectors become whole numbers. Every task cuts its vectors into stretches of at most ``TREE_ROWS`` and builds a metric tree over each: a node
is a ball with its radius (squared), its count and the integer sum of its vectors. The trees are written once to the shared folder and serve all
rounds. A round walks each tree with the centroids: by the triangle inequality a centroid that is farther from a ball's middle than the nearest
one by more than twice the radius is nearest to none of the ball's vectors. Where one centroid is left, the ball's count and sum go to it
as they stand; otherwise the walk descends, and a leaf compares its vectors with the centroids that are left, exactly. Only counts and
sums of clusters leave a task, as limbs of 32 bits, so their totals have no limit.

The driver holds ``k`` centroids and nothing else; they travel to the tasks with the function. Vectors aren't shuffled, so a vector that
makes up a third of the table is no hot key: its copies are balls of radius 0.

Defined results: vectors of another length than ``dim``, null ones and those with null or non-finite components (also after scaling) are left
out; a table without any gives no rows; with fewer than ``k`` vectors every one of them is a first centroid; ties of a first centroid's hash (repeated ids)
go by the components, and a null id comes last; an empty cluster keeps its centroid; repeated rows and ids are rows of their
own; components of 2^22 and more take part in whole numbers without limit, without a tree; distances and sums beyond a 64-bit number are null.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Vectors under one tree, and in one of its leaves.
TREE_ROWS, LEAF_ROWS = 8192, 64
#: Squared distances of up to a thousand components under it are exact in doubles.
SMALL = 1 << 22
LIMB_BITS = 32
LONG = (1 << 63) - 1
TREE_SCHEMA = "ids array<long>, code string, points binary, spans binary, radii binary, sums binary"


def scaled(vectors: DataFrame, dim: int, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, e): the vectors that take part, times ``scale``, not rounded down yet."""
    e = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e"))
    return rows.where(F.col("e").isNotNull() & (F.size("e") == dim) & F.forall("e", fine))


def first_centroids(rows: DataFrame, k: int, key: Column) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``key``, in that order."""
    found = rows.select(F.sha2(key, 256).alias("__h"), "e").orderBy(F.asc_nulls_last("__h"), "e").limit(k).collect()
    return [[int(np.floor(x)) for x in r["e"]] for r in found]


@dataclass
class Tree:
    """Vectors in the order of the leaves, and balls over stretches of them. ``spans`` has a ball's first and last row and its two children (-1: a leaf)."""

    points: np.ndarray
    spans: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree over the rows of ``x`` (whole numbers in doubles, under ``SMALL``), and the order that its leaves give them."""
        order = np.arange(len(x))
        spans, radii, sums = [[0, len(x), -1, -1]], [], []
        at = 0
        while at < len(spans):
            lo, hi, *_ = spans[at]
            part = x[order[lo:hi]]
            total = part.sum(axis=0)
            far = ((part - np.floor(total / (hi - lo))) ** 2).sum(axis=1)
            radii.append(far.max())
            sums.append(total)
            if hi - lo > LEAF_ROWS and radii[-1] > 0:
                # Halves along the line between two vectors that lie far apart.
                one = part[int(np.argmax(far))]
                other = part[int(np.argmax(((part - one) ** 2).sum(axis=1)))]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part @ (other - one), half)]
                spans[at][2:] = [len(spans), len(spans) + 1]
                spans += [[lo, lo + half, -1, -1], [lo + half, hi, -1, -1]]
            at += 1
        return cls(x[order], np.array(spans, "<i4"), np.array(radii), np.array(sums)), order

    @classmethod
    def flat(cls, x: np.ndarray) -> Tree:
        """One leaf whose ball is never taken whole: for components too large for exact doubles."""
        return cls(x, np.array([[0, len(x), -1, -1]], "<i4"), np.array([np.inf]), np.zeros((1, x.shape[1])))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Each row's centroid, and the balls (ball, centroid) that were taken whole."""
        label, whole = np.empty(len(self.points), np.int64), []
        if not (small(self.points) and small(centroids)):
            for lo in range(0, len(label), LEAF_ROWS):
                label[lo : lo + LEAF_ROWS] = np.argmin(squares(self.points[lo : lo + LEAF_ROWS], centroids), axis=1)
            return label, whole
        middles = np.floor(self.sums / (self.spans[:, 1] - self.spans[:, 0])[:, None])
        far, reach = np.sqrt(squares(middles, centroids)), 2 * np.sqrt(self.radii)
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            ball, left = stack.pop()
            lo, hi, one, other = self.spans[ball].tolist()
            d = far[ball, left]
            # Roots are rounded, so what lies at the limit stays.
            left = left[d <= (d.min() + reach[ball]) * (1 + 1e-9)]
            if len(left) == 1:
                label[lo:hi] = left[0]
                whole.append((ball, int(left[0])))
            elif one < 0:
                label[lo:hi] = left[np.argmin(squares(self.points[lo:hi], centroids[left]), axis=1)]
            else:
                stack += [(one, left), (other, left)]
        return label, whole

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and sum per centroid as whole numbers without limit, and how many vectors went there with their ball."""
        label, whole = self.assign(centroids)
        k = len(centroids)
        counts, sums, loose = np.bincount(label, minlength=k).astype(object), np.zeros((k, self.points.shape[1]), object), np.ones(len(label), bool)
        for ball, c in whole:
            sums[c] += whole_numbers(self.sums[ball])
            loose[self.spans[ball, 0] : self.spans[ball, 1]] = False
        for c in np.unique(label[loose]).tolist():
            mine = self.points[loose & (label == c)]
            sums[c] += whole_numbers(mine.sum(axis=0)) if small(mine) else whole_numbers(mine).sum(axis=0)
        return counts, sums, int((~loose).sum())

    def distances(self, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Each row's centroid and its squared distance."""
        label, _ = self.assign(centroids)
        if small(self.points) and small(centroids):
            return label, ((self.points - centroids[label].astype(float)) ** 2).sum(axis=1).astype(np.int64).tolist()
        return label, [int(((whole_numbers(p) - centroids[c]) ** 2).sum()) for p, c in zip(self.points, label.tolist(), strict=True)]


def small(x: np.ndarray) -> bool:
    return not x.size or bool(np.abs(x).max() < SMALL)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole as Python's numbers, which don't round."""
    return np.frompyfunc(int, 1, 1)(x)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    if small(x) and small(c):
        c = c.astype(float)
        return (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
    x = whole_numbers(x)
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def trees(rows: DataFrame, dim: int) -> DataFrame:
    """One row per tree (``TREE_SCHEMA``) over (vec_id, e), built where the vectors lie."""

    def packed(ids: list, x: np.ndarray) -> pa.RecordBatch:
        if small(x):
            tree, order = Tree.build(x)
            code = "<i2" if np.abs(x).max() < 1 << 15 else "<i4"
            ids = [ids[i] for i in order.tolist()]
        else:
            tree, code = Tree.flat(x), "<f8"
        values = [[ids], [code], [tree.points.astype(code).tobytes()], [tree.spans.tobytes()], [tree.radii.tobytes()], [tree.sums.tobytes()]]
        kinds = [pa.list_(pa.int64()), pa.string(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["ids", "code", "points", "spans", "radii", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            ids = b.column(0).to_pylist()
            ordinary = np.abs(x).max(axis=1, initial=0) < SMALL
            for kind, (have, parts) in held.items():
                mine = np.flatnonzero(ordinary == kind)
                for lo in range(0, len(mine), TREE_ROWS):
                    some = mine[lo : lo + TREE_ROWS]
                    have += [ids[i] for i in some.tolist()]
                    parts.append(x[some])
                    if len(have) >= TREE_ROWS:
                        m = np.concatenate(parts)
                        yield packed(have[:TREE_ROWS], m[:TREE_ROWS])
                        have[:], parts[:] = have[TREE_ROWS:], [m[TREE_ROWS:]]
        for have, parts in held.values():
            if have:
                yield packed(have, np.concatenate(parts))

    return rows.select("vec_id", "e").mapInArrow(run, TREE_SCHEMA)


def opened(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Scalar, Tree]]:
    for r in range(b.num_rows):
        ids, code, points, spans, radii, sums = (b.column(c)[r] for c in range(6))
        x = np.frombuffer(points.as_py(), code.as_py()).astype(float).reshape(-1, dim)
        yield ids, Tree(x, np.frombuffer(spans.as_py(), "<i4").reshape(-1, 4), np.frombuffer(radii.as_py()), np.frombuffer(sums.as_py()).reshape(-1, dim))


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(position, limb) of a whole number in base 2^32, each with the number's sign."""
    sign, value, at = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << LIMB_BITS) - 1):
            yield at, sign * (value & ((1 << LIMB_BITS) - 1))
        value, at = value >> LIMB_BITS, at + 1


#: What takes a dimension's place in the rows that hold counts.
COUNT, WHOLE = -1, -2


@dataclass
class Model:
    centroids: list[list[int]]
    #: Share of the vectors that were assigned with their ball, per round.
    whole: list[float] = field(default_factory=list)

    def sha256(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[c])).encode()).hexdigest()


def fit(built: DataFrame, model: Model, dim: int, rounds: int) -> Model:
    """``rounds`` times: every vector to its nearest centroid, then every centroid with vectors to the floor of their mean."""
    for _ in range(rounds if model.centroids else 0):
        current = np.array(model.centroids, object).reshape(-1, dim)

        def run(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            k = len(centroids)
            n, s, whole = np.zeros(k, object), np.zeros((k, dim), object), 0
            for b in batches:
                for _, tree in opened(b, dim):
                    counts, sums, with_ball = tree.totals(centroids)
                    n, s, whole = n + counts, s + sums, whole + with_ball
            cells = [(c, COUNT, n[c]) for c in range(k)] + [(0, WHOLE, whole)] + [(c, d, s[c, d]) for c in range(k) for d in range(dim)]
            out = [(c, d, at, limb) for c, d, v in cells for at, limb in limbs(int(v))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "dim", "limb", "value"])

        parts = built.mapInArrow(run, "cluster int, dim int, limb int, value long")
        total: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():
            key = (r["cluster"], r["dim"])
            total[key] = total.get(key, 0) + (r["value"] << LIMB_BITS * r["limb"])
        count = [total.get((c, COUNT), 0) for c in range(len(current))]
        model.centroids = [[total.get((c, d), 0) // count[c] for d in range(dim)] if count[c] else old for c, old in enumerate(model.centroids)]
        model.whole.append(total.get((0, WHOLE), 0) / max(1, sum(count)))
    return model


def assigned(built: DataFrame, model: Model, dim: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    centroids = np.array(model.centroids, object).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, tree in opened(b, dim):
                label, far = tree.distances(centroids)
                far = [d if d <= LONG else None for d in far]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return built.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int, rounds: int, dim: int = 64, scale: float = 256.0, seed: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part; ``seed`` (over vec_id) is what first centroids are drawn by."""
    spark = vectors.sparkSession
    rows = scaled(vectors, dim, scale, id_col, vec_col)
    key = F.concat(F.lit("2:"), F.col("vec_id").cast("string")) if seed is None else seed
    model = Model(first_centroids(rows, k, key))
    built = materialize(trees(rows, dim), "trees")
    fit(built, model, dim, rounds)
    out = materialize(assigned(built, model, dim), "clusters")
    drop_table(built)
    beyond = F.count_if(F.col("distance").isNull())
    sums = {r["cluster"]: None if r["beyond"] else int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), beyond.alias("beyond")).collect()}
    number = lambda x: x if x is not None and x <= LONG else None
    inertia = number(None if None in sums.values() else sum(sums.values()))
    facts = [(c, number(s), inertia, model.sha256(c)) for c, s in sorted(sums.items())]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
