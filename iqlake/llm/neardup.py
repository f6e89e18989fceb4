"""Near-duplicate groups by a MinHash LSH forest.

A document's set is its distinct 5-word shingles. Equal sets form one class, which has a number of its own and a MinHash signature; forest, texts and groups
are keyed by that number, so an id with several texts stands for several classes, and ids come in again at the end. The forest holds the signatures in several sorted orders, each starting at other hash functions. In an order, a row's
candidates are its neighbours: those in a window before it that share a prefix of the order of at least ``DEPTH`` values. Where a
region is dense, the window spans only the longest common prefixes, so the prefix depth adapts to the region and no bucket grows.
Orders are cut into ranges, a task each; rows within the window on either side of a cut are compared after that.

The forest is searched twice. First each row proposes its best neighbour on either side in every order; these pairs are compared
on full sets (100 * intersection >= 75 * union), and links join rows into groups. Then every neighbour pair between different groups
whose signatures agree loosely is compared too. Pairs inside a group can't change the result, so a dense group costs a few
comparisons a document and not one a pair; no partner is dropped for a count.

A region (rows with a common prefix of ``DEPTH``) wider than the window can hold links that the window doesn't reach. So the rows of
such regions, where more than one group stands in them, are compared exactly. A prefix filter on their full sets tells apart which can be linked at all: shingles of one group
alone can't join groups, and the others are ordered by how many of these rows have them; two sets similar enough share one among their first few. Rows
that share such a shingle, in chains, are one block. A block is cut into cells, and a task counts the intersections of all sets of two cells by products of
sparse columns; only links between groups that aren't joined yet leave it.

Full sets meet by region (a component of the pairs to compare): in one task while a region's texts and pairs are few; a larger region is cut
into cells, and a document goes only to the cells that hold one of its pairs.
Defined results: a null or word-less text has an empty set and stays alone; fewer words than five are one shingle; equal texts are
one group; ties go to the smallest id; rows that repeat an id with other texts are documents of their own, each with the group of its text; a row without an
id takes the group of an equal text, else null, and isn't kept; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .components import connected
from .shingles import overlaps, shingle_set

HASHES, ORDERS, DEPTH, WINDOW = 256, 32, 4, 40
#: Loose agreement of signatures: 4.8 standard deviations under 0.75, which a pair at 0.75 misses with less than 1e-6.
LOOSE = 0.62
#: Bytes of text, documents and pairs in a region's task before the region is cut into cells.
CELL_BYTES, CELL_ROWS, CELL_PAIRS = 24 << 20, 500, 20_000
#: Documents and shingles of a cell in the exact comparison, and columns that it multiplies at a time.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1_000, 2_000_000, 4_096
#: What the scan of a range gives: pairs, and the rows at its ends.
SCANNED = {"a": pa.int64(), "b": pa.int64(), "number": pa.int64(), "at": pa.int64(), "rows": pa.int64(), "t": pa.int32(), "label": pa.binary(), "doc_id": pa.int64(), "grp": pa.int64()}
_RNG = np.random.RandomState(20240229)
MULTIPLY = (_RNG.randint(0, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
ADD = _RNG.randint(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32)


def orders(count: int = ORDERS, hashes: int = HASHES) -> np.ndarray:
    """Permutations of the hash functions: disjoint beginnings as far as they go, then the others in turn."""
    rng = np.random.RandomState(7)
    lead = hashes // count
    return np.stack([np.concatenate([np.arange(t * lead, (t + 1) * lead), rng.permutation(np.setdiff1d(np.arange(hashes), np.arange(t * lead, (t + 1) * lead)))]) for t in range(count)])


def signature(shingles: np.ndarray) -> bytes:
    """Eight bits of each hash function's minimum."""
    h = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.empty(HASHES, np.uint32)
    for i in range(0, HASHES, 16):
        low = np.full(16, 0xFFFFFFFF, np.uint32)
        for s in range(0, len(h), 4096):
            low = np.minimum(low, (h[None, s : s + 4096] * MULTIPLY[i : i + 16, None] + ADD[i : i + 16, None]).min(axis=1))
        out[i : i + 16] = low
    return ((out * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sketched(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, bytes, key, sig): hash of the text, set size, text size, a 128-bit digest of the set and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, last, made = [], None, None
            for text in b.column(2).to_pylist():
                if made is None or text != last:
                    s = shingle_set(text, n)
                    last, made = text, (len(s), len(text or ""), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, signature(s) if len(s) else None)
                rows.append(made)
            if rows:
                made_of = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made_of], names=["doc_id", "th", "n_shingles", "bytes", "key", "sig"])

    return named_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, n_shingles long, bytes long, key binary, sig binary")


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): id, hash of the text, text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def prefixes(depth: int = DEPTH) -> Column:
    """(t, p): order and hash of the signature's prefix in it."""
    prefix = F.array(*(F.xxhash64(F.concat(*(F.substring("sig", int(i) + 1, 1) for i in p[:depth]))) for p in orders()))
    return F.posexplode(prefix).alias("t", "p")


def dense_rows(reps: DataFrame) -> DataFrame:
    """The ids that share a prefix with another one in some order; the others have no candidate. Counting prefixes finds them early."""
    keys = reps.select("doc_id", prefixes())
    shared = keys.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(shared.select("t", "p").hint("shuffle_hash"), ["t", "p"], "left_semi").select("doc_id").distinct()


def crowded_rows(grouped: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, grp): the rows of regions wider than the window in which several groups stand. Any other region has been compared whole."""
    keys = grouped.select("doc_id", "grp", prefixes())
    wide = keys.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where((F.col("n") > window + 1) & (F.col("lo") != F.col("hi")))
    return keys.join(wide.select("t", "p").hint("shuffle_hash"), ["t", "p"], "left_semi").select("doc_id", "grp").distinct()


def prefix_blocks(texts: DataFrame, crowded: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """(node, component): blocks of ``crowded`` rows (doc_id, grp); rows of different groups that are similar enough stand in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, grp, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle_set(text, n)
                for i in range(0, len(s), 10_000):
                    part = s[i : i + 10_000]
                    full = lambda v: pa.array(np.full(len(part), v, np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([full(doc), full(grp), full(len(s)), pa.array(part.view(np.int64))], names=["doc_id", "grp", "size", "h"])

    own = texts.join(crowded.hint("shuffle_hash"), "doc_id").select("doc_id", "grp", "text")
    sets = materialize(own.mapInArrow(run, "doc_id long, grp long, size long, h long"), "sets")
    counts = sets.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where(F.col("lo") != F.col("hi"))
    mixed = materialize(sets.join(counts.select("h", "df").hint("merge"), "h"), "mixed")
    mine = Window.partitionBy("doc_id")
    size = F.col("size")
    # Shingles of one group come first and join nothing. Sets of sizes y <= x with 100 I >= percent U share one of the first
    # x - ceil(percent x / 100) + 1 of x and of the first y - ceil(2 percent y / (100 + percent)) + 1 of y.
    place = size - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "h"))
    placed = mixed.withColumn("pos", place).where(F.col("pos") <= size - F.ceil(percent * size / 100) + 1)
    placed = materialize(placed.select("doc_id", "grp", "h", (F.col("pos") <= size - F.ceil(2 * percent * size / (100 + percent)) + 1).alias("first")), "placed")
    hubs = placed.groupBy("h").agg(F.min("doc_id").alias("b"), F.max("first").alias("first"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where(F.col("first") & (F.col("lo") != F.col("hi")))
    edges = materialize(placed.select("h", F.col("doc_id").alias("a")).join(hubs.select("h", "b").hint("merge"), "h").select("a", "b").distinct(), "edges")
    blocks = materialize(connected(edges, "blocks"), "blocks")
    for df in (sets, mixed, placed, edges):
        drop_table(df)
    return blocks


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets on the left with all on the right, some thousand shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    at = []
    for values, row in zip((a, b), rows, strict=True):
        i = np.searchsorted(both, values)
        held = np.flatnonzero(both[np.minimum(i, len(both) - 1)] == values) if len(both) else np.zeros(0, int)
        order = held[np.argsort(i[held], kind="stable")]
        at.append((row[order], i[order]))
    for lo in range(0, len(both), COLUMNS):
        parts = []
        for (row, column), x in zip(at, (left, right), strict=True):
            s, e = np.searchsorted(column, [lo, lo + COLUMNS])
            part = np.zeros((len(x), COLUMNS), np.float32)
            part[row[s:e], column[s:e] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def block_links(texts: DataFrame, crowded: DataFrame, blocks: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """Links (a, b) between groups among the rows of each block, enough to join all that are similar enough."""
    spread = blocks.join(texts.select("doc_id", "bytes"), blocks.node == texts.doc_id).groupBy("component").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # A shingle takes two bytes of text at least, and six or so as a rule.
    cells = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / (6 * BLOCK_SHINGLES)), F.lit(1)).cast("int")
    placed = blocks.join(spread.select("component", cells.alias("cells")), "component").join(crowded, F.col("node") == F.col("doc_id"))
    placed = placed.select("component", "doc_id", "grp", "cells", F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int").alias("c"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    sent = materialize(sent.select("component", "doc_id", "grp", "c", F.least("c", "other").alias("x"), F.greatest("c", "other").alias("y")), "sent")
    rows = texts.select("doc_id", "text").join(sent.hint("shuffle_hash"), "doc_id").select("component", "x", "y", "c", "doc_id", "grp", "text")

    def compare(keys: tuple, t: pa.Table) -> pa.Table:
        x, y = keys[1].as_py(), keys[2].as_py()
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {x: [], y: []}
        for c, doc, grp, text in zip(*(t[k].to_pylist() for k in ("c", "doc_id", "grp", "text")), strict=True):
            held[c].append((doc, grp, shingle_set(text, n)))
        root: dict[int, int] = {}

        def find(g: int) -> int:
            root.setdefault(g, g)
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        out: list[tuple[int, int]] = []
        left, right = held[x], held[y]
        if left and right:
            (na, ga), (nb, gb) = ([np.array(v) for v in zip(*((len(s), g) for _, g, s in side), strict=True)] for side in (left, right))
            both = common_counts([s for *_, s in left], [s for *_, s in right])
            alike = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ga[:, None] != gb[None, :])
            for i, j in zip(*np.nonzero(alike), strict=True):
                g, k = find(int(ga[i])), find(int(gb[j]))
                if g != k:
                    root[max(g, k)] = min(g, k)
                    out.append((left[i][0], right[j][0]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    links = materialize(rows.groupBy("component", "x", "y").applyInArrow(compare, "a long, b long"), "links")
    drop_table(sent)
    return links


def neighbours(dense: DataFrame, best_only: bool, window: int = WINDOW, depth: int = DEPTH, loose: float = LOOSE) -> DataFrame:
    """Pairs (a, b), a < b, of neighbours in some order of (doc_id, sig, grp): loosely agreeing ones of different groups.

    With ``best_only`` a row proposes the neighbour that agrees most among those before it and among those after it.
    """
    perms = orders()

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                c = b.slice(s, 1000)
                if not c.num_rows:
                    continue
                sigs = np.frombuffer(b"".join(c.column(1).to_pylist()), np.uint8).reshape(-1, HASHES)
                for t, p in enumerate(perms):
                    rows = np.ascontiguousarray(sigs[:, p])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array([r.tobytes() for r in rows], pa.binary()), c.column(0), c.column(2)], names=["t", "label", "doc_id", "grp"])

    def best(at: np.ndarray, score: np.ndarray) -> np.ndarray:
        order = np.lexsort((-score, at))
        first = np.ones(len(at), bool)
        first[1:] = at[order][1:] != at[order][:-1]
        return order[first]

    def pairs_of(t: np.ndarray, sig: np.ndarray, grp: np.ndarray, first: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Later row, earlier row and agreement of the neighbours of sorted rows, the later one from ``first`` on; with ``apart``, of rows that differ in it."""
        head = sig[:, :depth]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, min(window, len(t) - 1) + 1):
            i = np.arange(max(k, first), len(t))
            i = i[(t[i] == t[i - k]) & (head[i] == head[i - k]).all(axis=1)]
            if not len(i):
                break
            i = i[grp[i] != grp[i - k]]
            if apart is not None:
                i = i[apart[i] != apart[i - k]]
            agree = (sig[i] == sig[i - k]).mean(axis=1)
            ok = agree >= loose
            found.append((i[ok], i[ok] - k, agree[ok]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        x, y, agree = (np.concatenate(v) for v in zip(*found, strict=True))
        if best_only and len(x):
            kept = np.union1d(best(x, agree), best(y, agree))
            x, y, agree = x[kept], y[kept], agree[kept]
        return x, y, agree

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs inside a range, then the range's first and last ``window`` rows with their place and the range's row count."""
        held: tuple | None = None
        begin: list[tuple] = []
        seen, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                b = batch.slice(s, 2000)
                if not b.num_rows:
                    continue
                now = (b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, HASHES), b.column(2).to_numpy(), b.column(3).to_numpy())
                new = len(now[0])
                if seen < window:
                    begin.append(tuple(x[: window - seen] for x in now))
                seen += new
                t, sig, ids, grp = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
                x, y, _ = pairs_of(t, sig, grp, len(ids) - new)
                held = tuple(v[-window:] for v in (t, sig, ids, grp))
                if len(x):
                    yield mixed(a=np.minimum(ids[x], ids[y]), b=np.maximum(ids[x], ids[y]))
        if held is not None:
            rest = min(len(held[0]), max(0, seen - window))  # rows of the end that aren't in the beginning
            t, sig, ids, grp = (np.concatenate([*v, h[len(h) - rest :]]) for v, h in zip(zip(*begin, strict=True), held, strict=True))
            at = np.concatenate([np.arange(min(window, seen)), np.arange(seen - rest, seen)])
            yield mixed(number=np.full(len(t), number), at=at, rows=np.full(len(t), seen), t=t, label=[r.tobytes() for r in sig], doc_id=ids, grp=grp)

    def mixed(**columns: np.ndarray | list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in SCANNED.items()], names=[*SCANNED])

    def across(rows: pa.Table) -> pa.Table:
        """Pairs of a range's first rows and the rows before the range."""
        rows = rows.sort_by("place")
        sig = np.frombuffer(b"".join(rows["label"].to_pylist()), np.uint8).reshape(-1, HASHES)
        ids, own = rows["doc_id"].to_numpy(), rows["number"].to_numpy() == rows["range"].to_numpy()
        x, y, _ = pairs_of(rows["t"].to_numpy(), sig, rows["grp"].to_numpy(), 1, own)
        return pa.table({"a": pa.array(np.minimum(ids[x], ids[y]), pa.int64()), "b": pa.array(np.maximum(ids[x], ids[y]), pa.int64())})

    trees = dense.select("doc_id", "sig", "grp").mapInArrow(widen, "t int, label binary, doc_id long, grp long")
    trees = materialize(trees, "trees")
    parts = int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = trees.repartitionByRange(parts, "t", "label", "doc_id").sortWithinPartitions("t", "label", "doc_id")
    scanned = materialize(ordered.mapInArrow(scan, "a long, b long, number long, at long, rows long, t int, label binary, doc_id long, grp long"), "scanned")
    drop_table(trees)
    # A range's first rows meet the rows before it, from as many ranges as these stand in. The driver sees one number a range.
    ends = scanned.where("number is not null")
    lengths = sorted((r["number"], r["rows"]) for r in ends.select("number", "rows").distinct().collect())
    inside = scanned.where("a is not null").select("a", "b")
    if len(lengths) > 1:
        starts = np.cumsum([0, *(n for _, n in lengths)])
        sent = []
        for i, (number, n) in enumerate(lengths):
            sent.append((number, number, int(starts[i]), int(starts[i])))
            for j in range(i + 1, len(lengths)):
                if starts[j] - starts[i + 1] >= window:
                    break
                sent.append((number, lengths[j][0], int(starts[i]), int(starts[j])))
        to = dense.sparkSession.createDataFrame(sent, "number long, range long, start long, cut long")
        met = ends.join(F.broadcast(to), "number").withColumn("place", F.col("start") + F.col("at"))
        met = met.where(F.when(F.col("number") == F.col("range"), F.col("at") < window).otherwise(F.col("place") >= F.col("cut") - window))
        met = met.select("range", "number", "place", "t", "label", "doc_id", "grp")
        inside = inside.unionByName(met.groupBy("range").applyInArrow(across, "a long, b long"))
    pairs = materialize(inside.where("a <> b").distinct(), "pairs")
    drop_table(scanned)
    return pairs


def verified(texts: DataFrame, pairs: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """Exact links (a, b) among the pairs, enough to join all that the pairs link; ``texts`` is (doc_id, text, bytes)."""
    regions = materialize(connected(pairs, "regions"), "region")
    loads = regions.join(texts.select("doc_id", "bytes"), regions.node == texts.doc_id).groupBy("component").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    asked = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(regions.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.sum("pairs").alias("pairs"))
    cells = F.greatest(F.ceil(F.col("bytes") / CELL_BYTES), F.ceil(F.col("rows") / CELL_ROWS), F.ceil(F.sqrt(2 * F.col("pairs") / CELL_PAIRS)), F.lit(1))
    loads = materialize(loads.join(asked, "component").select("component", cells.cast("int").alias("cells")), "loads")
    placed = materialize(regions.join(loads, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("c")), "placed")
    one, two = placed.select(F.col("node").alias("a"), F.col("component").alias("region"), F.col("c").alias("ca")), placed.select(F.col("node").alias("b"), F.col("c").alias("cb"))
    celled = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "region", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")), "celled")
    wanted = celled.select(F.col("a").alias("doc_id"), "region", "x", "y").unionByName(celled.select(F.col("b").alias("doc_id"), "region", "x", "y")).distinct()
    sent = texts.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id")
    links = celled.groupBy("region", "x", "y", "a").agg(F.collect_list("b").alias("bs"))  # neighbours of one row: bounded by the windows
    rows = sent.select("region", "x", "y", F.col("doc_id").alias("a"), "text", F.lit(None).cast("array<long>").alias("bs")).unionByName(links.select("region", "x", "y", "a", F.lit(None).cast("string").alias("text"), "bs"))

    def compare(t: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        todo: list[tuple[int, list[int]]] = []
        for doc, text, bs in zip(t["a"].to_pylist(), t["text"].to_pylist(), t["bs"].to_pylist(), strict=True):
            if bs is None:
                if doc not in sets:
                    sets[doc] = shingle_set(text, n)
            else:
                todo.append((doc, bs))
        root = {d: d for d in sets}

        def find(d: int) -> int:
            while root[d] != d:
                root[d] = root[root[d]]
                d = root[d]
            return d

        out = []
        for a, bs in sorted(todo):
            own = sets[a]
            bs = sorted(b for b in bs if 100 * min(len(own), len(sets[b])) >= percent * max(len(own), len(sets[b])) > 0)
            for i in range(0, len(bs), 64):
                # Links inside a group change nothing, so pairs that are joined already aren't compared.
                some = [b for b in bs[i : i + 64] if find(b) != find(a)]
                for b, both in zip(some, overlaps(own, [sets[b] for b in some]) if some else (), strict=True):
                    ra, rb = find(a), find(b)
                    if ra != rb and 100 * both >= percent * (len(own) + len(sets[b]) - both):
                        root[max(ra, rb)] = min(ra, rb)
                        out.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    found = materialize(rows.groupBy("region", "x", "y").applyInArrow(compare, "a long, b long"), "links")
    for df in (regions, loads, placed, celled):
        drop_table(df)
    return found


def groups(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group), kept (that id is the document's own)."""
    sketches = materialize(sketched(docs, n, id_col, text_col), "sketches")
    # From here on doc_id is a class's number, written once with the table; rep_id and th name a row that has its text.
    rep = F.min(F.struct("doc_id", "th")).alias("rep")
    classes = sketches.where("key is not null and doc_id is not null").groupBy("key").agg(rep, F.first("sig").alias("sig"))
    classes = materialize(classes.select("key", F.monotonically_increasing_id().alias("doc_id"), F.col("rep.doc_id").alias("rep_id"), "rep.th", "sig"), "classes")
    paired = materialize(dense_rows(classes), "paired")
    dense = materialize(classes.drop("key").join(paired.hint("shuffle_hash"), "doc_id", "left_semi"), "dense")
    own = named_texts(docs, id_col, text_col).withColumnRenamed("doc_id", "rep_id")
    once = own.join(dense.select("rep_id", "th", "doc_id").hint("shuffle_hash"), ["rep_id", "th"]).dropDuplicates(["rep_id", "th"])
    texts = materialize(once.select("doc_id", "text", F.octet_length("text").alias("bytes")), "texts")

    def linked(so_far: DataFrame, links: DataFrame) -> DataFrame:
        """Groups (node, component) after the links."""
        merged = materialize(connected(so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "groups"), "groups")
        drop_table(links)
        return merged

    def searched(so_far: DataFrame, pairs: DataFrame) -> DataFrame:
        merged = linked(so_far, verified(texts, pairs, percent, n))
        drop_table(pairs)
        return merged

    def grouped(so_far: DataFrame) -> DataFrame:
        return dense.join(so_far, dense.doc_id == so_far.node, "left").select("doc_id", "sig", F.coalesce("component", "doc_id").alias("grp"))

    none = docs.sparkSession.createDataFrame([], "node long, component long")
    first = searched(none, neighbours(dense.withColumn("grp", F.col("doc_id")), True))
    merged = searched(first, neighbours(grouped(first), False))
    crowded = materialize(crowded_rows(grouped(merged)), "crowded")
    if not crowded.isEmpty():
        blocks = prefix_blocks(texts, crowded, percent, n)
        merged = linked(merged, block_links(texts, crowded, blocks, percent, n))
    ids = classes.select(F.col("doc_id").alias("node"), "rep_id")
    lows = materialize(merged.join(ids, "node").groupBy("component").agg(F.min("rep_id").alias("low")), "lows")
    joined = materialize(merged.join(lows, "component").select(F.col("node").alias("doc_id"), "low"), "joined")
    named = materialize(classes.select("key", "doc_id", "rep_id").join(joined, "doc_id", "left").select("key", F.coalesce("low", "rep_id").alias("component_id")), "named")
    for df in (texts, paired, dense, crowded, first, merged, lows, joined, classes):
        drop_table(df)
    out = sketches.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"))
