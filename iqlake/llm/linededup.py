"""Line deduplication by pairwise alignment; it pairs by runs of ``MIN_WORDS`` words, not by single lines, frequent runs included, and also deletes what patience diff leaves.

A text is cut into units: lines, and the sentences of each line. Units are hashed, and so is the shortest run of units from each unit
on that has ``MIN_WORDS`` words: two texts have a common block to delete only if they share such a run. A run that few documents share
(up to ``RARE``) pairs each of them with each earlier one; a run that more share pairs them with the earliest document that has it,
so a hot line costs one pair a document. Pairs are aligned by patience diff over their unit hashes, and aligned common blocks of at
least ``MIN_WORDS`` words are deleted from the later document (the larger id). What patience diff can't align (a passage that stands several times, or
passages in another order) isn't lost: runs of ``MIN_WORDS`` words that the rest of the later document still shares with the earlier one, anywhere in it, are
deleted until none is left. The earliest document with a block keeps it. So no document keeps a run of ``MIN_WORDS`` words that an earlier
one has, whether rare or frequent: for each of its runs it is paired with the earliest document that has the run.

Lines of fewer words stay where they stand alone, however often: a short line that recurs (a heading, a greeting) isn't a copied
passage, and deleting it harms clean documents. README says how much that leaves.

Only hashes and word counts travel to the alignment. Defined results: a null text stays null, an empty one empty; rows that repeat
an id and its text are one document; an id with two texts counts as two documents, ordered by a hash; a row without an id has no place in the order and stays as it is; an
empty table stays empty; all columns come back unchanged but for the text, and the columns added are named by the caller, so
nothing clashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .shingles import mix

RARE, MIN_WORDS = 8, 20
#: A unit ends after a line break, or after a sentence's end and the white space behind it.
UNIT = re.compile(r"[^\n]*?(?:[.!?][ \t]+|\n|\Z)|\n")


def units(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    return [u for u in UNIT.findall(text) if u]


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word count of each unit; blank units hash to 0."""
    found = [u.strip() for u in units(text)]
    return np.array([xxhash.xxh3_64_intdigest(u) >> 1 if u else 0 for u in found], np.int64), np.array([len(u.split()) for u in found], np.int32)


#: An odd multiplier and its inverse among 64-bit words.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def runs(hs: np.ndarray, ws: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Distinct hashes of the shortest runs of units with ``min_words`` words, one for each unit that isn't blank."""
    upto = np.concatenate([[0], np.cumsum(ws, dtype=np.int64)])
    start = np.flatnonzero(hs != 0)
    end = np.searchsorted(upto, upto[start] + min_words)
    start, end = start[end <= len(hs)], end[end <= len(hs)]
    up, down = np.full(len(hs) + 1, STEP, np.uint64), np.full(len(hs) + 1, BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(len(hs) + 1, np.uint64)
    np.cumsum(mix(hs.astype(np.uint64)) * up[:-1], out=sums[1:])
    return np.unique(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def text_key(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(text or "") >> 1


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Patience diff: (start in a, start in b, length) of the aligned common blocks, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, x, y = todo.pop()
        while lo < hi and x < y and a[lo] == b[x]:
            pairs.append((lo, x))
            lo, x = lo + 1, x + 1
        while lo < hi and x < y and a[hi - 1] == b[y - 1]:
            hi, y = hi - 1, y - 1
            pairs.append((hi, y))
        if lo >= hi or x >= y:
            continue
        in_a, in_b = Counter(a[lo:hi]), Counter(b[x:y])
        at = {v: j for j, v in enumerate(b[x:y], x) if in_b[v] == 1}
        once = [(i, at[v]) for i, v in enumerate(a[lo:hi], lo) if v in at and in_a[v] == 1]
        piles: list[int] = []
        back: list[int] = []
        tops: list[int] = []
        for n, (_, j) in enumerate(once):
            k = bisect_left(piles, j)
            if k == len(piles):
                piles.append(j)
                tops.append(n)
            else:
                piles[k] = j
                tops[k] = n
            back.append(tops[k - 1] if k else -1)
        chain, n = [], tops[-1] if tops else -1
        while n >= 0:
            chain.append(once[n])
            n = back[n]
        i0, j0 = lo, x
        for i, j in reversed(chain):
            pairs.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        if chain:
            todo.append((i0, hi, j0, y))
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def shortest_runs(hs: list[int], words: dict[int, int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest run with ``min_words`` words from each unit on and up to each unit; a unit that ``words`` lacks is in none."""
    out = []
    start = words_in = 0
    last = -1
    for end, h in enumerate(hs, 1):
        if h and h not in words:
            start, words_in, last = end, 0, -1
            continue
        words_in += words.get(h, 0)
        # Each start whose shortest run ends here, then the shortest run that ends here.
        while words_in >= min_words:
            if hs[start]:
                out.append((start, end))
                last = start
            words_in -= words.get(hs[start], 0)
            start += 1
        if h and last >= 0:
            x, n = end, 0
            while n < min_words:
                x -= 1
                n += words.get(hs[x], 0)
            out.append((x, end))
    return out


def shared_ranges(a: list[int], b: list[int], ws: list[int], min_words: int) -> list[tuple[int, int]]:
    """Unit ranges (start, end) of b, given with its word counts, after which b shares no run of ``min_words`` words with a.

    The aligned blocks come first. A passage that stands several times in a text has no unique unit and may be aligned nowhere; so the
    runs of what is left of b that stand anywhere in a go too, until there are none.
    """
    gone = [False] * len(b)
    out = []
    for _, j, n in common_blocks(a, b):
        if sum(ws[j : j + n]) >= min_words:
            out.append((j, j + n))
            gone[j : j + n] = [True] * n
    known = set(a)
    while True:
        left = [j for j, x in enumerate(gone) if not x]
        if sum(ws[j] for j in left if b[j] in known) < min_words:
            return out
        words = {b[j]: ws[j] for j in left if b[j] and b[j] in known}
        there = {tuple(a[i:e]) for i, e in shortest_runs(a, words, min_words)}
        rest = [b[j] for j in left]
        found = [j for x, e in shortest_runs(rest, words, min_words) if tuple(rest[x:e]) in there for j in left[x:e]] if there else []
        if not found:
            return out
        for j in sorted(set(found)):
            gone[j] = True
            if out and out[-1][1] == j:
                out[-1] = (out[-1][0], j + 1)
            else:
                out.append((j, j + 1))


def unit_table(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, hs, ws, rs): unit hashes and word counts of each text, and the hashes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, text_key(t), *u, runs(*u, min_words)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for u in (hashed(t or ""),)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], names=["id", "th", "hs", "ws", "rs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, th long, hs array<long>, ws array<int>, rs array<long>")


def removals(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, cuts): unit ranges to delete, as an array of (start, end)."""
    rows = materialize(unit_table(docs.where(F.col(id_col).isNotNull()), min_words, id_col, text_col).dropDuplicates(["id", "th"]), "units")
    shared = materialize(rows.select(F.explode("rs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    # Joins are by shuffle at every size: no side is bounded, and a merge join lets Spark split a hot unit or document.
    me = F.struct("id", "th")
    kept = materialize(rows.select("id", "th", F.explode("rs").alias("h")).join(shared.hint("merge"), "h").select("h", "df", me.alias("d")), "repeated")
    few = kept.where(F.col("df") <= rare).groupBy("h").agg(F.array_sort(F.collect_list("d")).alias("at"))  # at most ``rare``
    few = few.select(F.posexplode("at").alias("k", "d"), "at").select("d", F.explode(F.slice("at", 1, F.col("k"))).alias("a"))
    hot = kept.where(F.col("df") > rare).select("h", "d")
    first = materialize(hot.groupBy("h").agg(F.min("d").alias("a")), "first")
    many = hot.join(first.hint("merge"), "h").where(F.col("d") > F.col("a")).select("d", "a")
    pairs = few.unionByName(many).distinct()
    pairs = materialize(pairs.select(F.col("d.id").alias("id"), F.col("d.th").alias("th"), F.col("a.id").alias("ai"), F.col("a.th").alias("at")), "pairs")
    both = pairs.join(rows.select(F.col("id").alias("ai"), F.col("th").alias("at"), F.col("hs").alias("ah")).hint("merge"), ["ai", "at"]).select("id", "th", "ah")
    both = both.join(rows.hint("merge"), ["id", "th"]).select("id", "th", "ah", "hs", "ws")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, th, ah, hs, ws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cuts = [{"s": s, "e": e} for s, e in shared_ranges(ah, hs, ws, min_words)]
                if cuts:
                    out.append((i, th, cuts))
            if out:
                kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), kind), strict=True)], names=["id", "th", "cuts"])

    found = both.mapInArrow(align, "id long, th long, cuts array<struct<s:int,e:int>>")
    # Ranges of one document: at most a few for each of its units.
    cuts = materialize(found.select("id", "th", F.explode("cuts").alias("c")).distinct().groupBy("id", "th").agg(F.collect_list("c").alias("cuts")), "cuts")
    for df in (rows, shared, kept, first, pairs):
        drop_table(df)
    return cuts


def dedup_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed: str = "removed_words") -> DataFrame:
    """All rows and columns of ``docs``, the text without its deleted blocks, and the words deleted in the column ``removed``."""
    cuts = removals(docs, rare, min_words, id_col, text_col)
    body = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    names = [*docs.columns]
    at_text = names.index(text_col)
    marked = body.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"))
    some = cuts.select("id", F.struct("th", "cuts").alias("c")).groupBy("id").agg(F.collect_list("c").alias("cs"))
    joined = marked.join(some.hint("shuffle_hash"), "id", "left").select("row.*", F.col("cs").alias("__cuts"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b.column(at_text).to_pylist(), [0] * b.num_rows
            for k, cs in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if cs and texts[k]:
                    th = text_key(texts[k])
                    ranges = [r for c in cs if c["th"] == th for r in c["cuts"]]
                    if ranges:
                        us = units(texts[k])
                        out = np.zeros(len(us), bool)
                        for r in ranges:
                            out[r["s"] : r["e"]] = True
                        gone[k] = sum(len(u.split()) for u, o in zip(us, out, strict=True) if o)
                        texts[k] = "".join(u for u, o in zip(us, out, strict=True) if not o)
            columns = list(b.columns[:-1])
            columns[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=[*names, removed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != text_col else 'string'}" for f in docs.schema.fields)
    return joined.mapInArrow(rewrite, f"{schema}, `{removed}` long")
