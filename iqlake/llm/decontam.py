"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Words are lower-cased runs of letters and digits. A document meets an item only if it holds one of the item's seeds: its rarest 5-word shingles, as many as
hold more than a quarter of its weight. A leak misses a quarter at most, so it holds one; a phrase that many items share is a seed of none that has rarer ones.
Windows have the size of a benchmark item. They stand where the document shares a shingle with the item, at the offset (alignment) that the shingle has there, and
at every offset between two alignments of an item that lie close together. No other window of the document can be more similar to the item: one whose first shared shingle is aligned at or behind its
start holds only foreign words before it, so the window at that alignment shares as much or more; so it is at the end, with the
last shared shingle; and one between the two alignments is in the set, since a gap of more than a seventh of the item's shingles
leaves less than ``SIMILAR``.

Each window and each item has a 64-bit SimHash of its words. Two fingerprints within ``RADIUS`` bits agree in at least one
of ``RADIUS + 1`` blocks, so an equality join on blocks returns all items within the radius of a window. An edit can leave a similarity
of ``SIMILAR`` and yet move more bits than the radius; so all windows at an item's own alignments are candidates too if the document holds
``SIMILAR`` or more of the item's shingle weight, which no leak falls short of. This bound alone determines the result: the Hamming index finds a part of the same
candidates (three quarters of those edited down to 0.75, all near exact ones), and none beside them can pass. Candidates are verified by the exact
weighted Jaccard similarity of their shingles; a shingle that many items share weighs less.

Documents and items are keyed by id and a hash of their words up to the last aggregation, and only keys, offsets and hashes travel; texts
with a window are read once more to cut it. The item side is broadcast while its row count is under ``BROADCAST_ROWS`` and joined by shuffle
beyond; results are the same. Defined results: null and word-less texts match nothing, nor do rows and items without an id; items with
fewer than five words are one shingle; an id that repeats with other texts stands for all of them, and the best window counts; ties go to the
earlier window; repeated rows count as one document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

RADIUS, SHINGLE, SIMILAR = 11, 5, 0.75
BROADCAST_ROWS = 400_000
#: A document, a window of it, an item.
DOC, ITEM = ["doc_id", "th"], ["item_id", "ih"]
PLACE = [*DOC, "start", "n", "k"]


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def lane_width(most_words: int) -> int:
    """Bits of a counter; the counter of a window's words must stay under half its range."""
    return next(w for w in (8, 16, 32) if most_words < 1 << (w - 1))


def simhash(words: str, width: int) -> Column:
    """64-bit majority of the word hashes' bits: ``width`` packed sums of every ``width``-th bit, then one comparison a bit."""
    mask = sum(1 << (width * k) for k in range(64 // width))
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    hashes = f"transform({words}, w -> xxhash64(w))"
    lanes = f"transform(sequence(0, {width - 1}), k -> aggregate({hashes}, 0L, (s, h) -> s + (shiftrightunsigned(h, k) & {mask}L)))"
    lane = (1 << width) - 1
    bit = f"(shiftrightunsigned(x.l[b % {width}], cast((b div {width}) * {width} as int)) & {lane}L) * 2 > x.n"
    start = f"named_struct('l', {lanes}, 'n', cast(size({words}) as bigint), 'f', 0L)"
    step = f"named_struct('l', x.l, 'n', x.n, 'f', if({bit}, x.f | shiftleft(1L, b), x.f))"
    return F.expr(f"aggregate(sequence(0, 63), {start}, (x, b) -> {step}, x -> x.f)")


def blocks(fp: str, radius: int) -> Column:
    """(block, value) pairs of a fingerprint, ``radius + 1`` of them."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    value = lambda lo, hi: F.expr(f"shiftrightunsigned({fp}, {lo}) & {(1 << (hi - lo)) - 1}L").alias("value")
    return F.explode(F.array(*(F.struct(F.lit(i).alias("block"), value(lo, hi)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)))))


def shingles(words: str, k: str) -> Column:
    hashes = f"transform(sequence(0, size({words}) - {k}), i -> xxhash64(slice({words}, i + 1, {k})))"
    return F.expr(f"if(size({words}) < {k}, cast(array() as array<bigint>), array_distinct({hashes}))")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its measured row count allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, ih, words, n (words), k (words a shingle), hs (distinct shingles)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    items = items.withColumn("ih", F.xxhash64("words")).dropDuplicates(ITEM).withColumn("n", F.size("words"))
    return items.withColumn("k", F.least("n", F.lit(SHINGLE))).withColumn("hs", shingles("words", "k"))


def rare_shingles(items: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """item, k, h: the rarest shingles of each item, as many as hold more than 1 - ``similarity`` of its weight."""
    rows = items.select(*ITEM, "k", F.explode("hs").alias("h")).join(weights, "h")
    mine = Window.partitionBy(*ITEM)
    before = F.coalesce(F.sum("w").over(mine.orderBy(F.desc("w"), "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumns({"before": before, "total": F.sum("w").over(mine)}).where(F.col("before") <= (1 - similarity) * F.col("total") + 1e-9).select(*ITEM, "k", "h")


def shingle_places(texts: DataFrame, k: int) -> DataFrame:
    """doc, p, h: the hash of every shingle of ``k`` words of (doc, words) and its place."""
    # A condition instead of a filter: that would be pushed below the words and make them twice.
    places_of = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))
    at = texts.select(*DOC, "words", F.explode(places_of).alias("p"))
    return at.select(*DOC, "p", F.xxhash64(*(F.col("words")[F.col("p") + j] for j in range(k))).alias("h"))


def seeded(texts: DataFrame, rare: DataFrame, ks: list[int], n_words: int) -> DataFrame:
    """doc, item: the documents that hold a seed of the item."""
    found = [shingle_places(texts, k).join(bounded(rare.where(F.col("k") == k).select(*ITEM, "h"), n_words), "h").select(*DOC, *ITEM) for k in ks]
    return reduce(DataFrame.unionByName, found).distinct()


def alignments(texts: DataFrame, items: DataFrame, ks: list[int], n_words: int, pairs: DataFrame | None = None) -> DataFrame:
    """doc, start, n, k, item, hs: the offsets that shared shingles give an item in a document (of one of the ``pairs``), and the shingles' hashes."""
    held = items.select(*ITEM, "n", "k", F.posexplode(F.expr("transform(sequence(0, n - k), i -> xxhash64(slice(words, i + 1, k)))")).alias("at", "h"))
    found = [shingle_places(texts, k).join(bounded(held.where(F.col("k") == k), n_words), "h") for k in ks]
    hits = reduce(DataFrame.unionByName, found).select(*DOC, F.greatest(F.col("p") - F.col("at"), F.lit(0)).alias("start"), "n", "k", *ITEM, "h")
    if pairs is not None:
        hits = hits.join(pairs.hint("shuffle_hash"), [*DOC, *ITEM], "left_semi")
    # Hashes of one item at one place: at most its shingles.
    return hits.groupBy(*PLACE, *ITEM).agg(F.collect_set("h").alias("hs"))


def places(seeds: DataFrame) -> DataFrame:
    """Windows by item: its alignments, and the offsets between two that lie close together."""
    before = F.lag("start").over(Window.partitionBy(*DOC, *ITEM).orderBy("start"))
    # A gap of more shingles than this leaves less than three quarters: (N - g) / (N + g) >= 3/4 ends at N / 7.
    near = F.col("start") - F.col("before") <= F.greatest(F.ceil((F.col("n") - F.col("k") + 1) / 7), F.lit(1))
    first = F.when(F.col("before").isNotNull() & near, F.col("before") + 1).otherwise(F.col("start"))
    return seeds.withColumn("before", before).withColumn("start", F.explode(F.sequence(first, F.col("start")))).select(*PLACE, *ITEM)


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start (word offset of the best window), n_words, similarity: a row per document and item found in it."""
    items = materialize(item_table(benchmark, item_col, item_text_col), "items")
    size = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.collect_set("k").alias("ks"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    width = lane_width(size["most"])
    weights = items.select(F.explode("hs").alias("h")).groupBy("h").agg(F.log(1 + size["items"] / F.count(F.lit(1))).alias("w"))
    weights = materialize(weights, "weights")
    top = F.log(F.lit(1.0 + size["items"]))
    totals = items.select(*ITEM, F.explode("hs").alias("h")).join(weights, "h").groupBy(*ITEM).agg(F.sum("w").alias("total"))
    totals = materialize(totals, "totals")

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    texts = texts.select("doc_id", F.xxhash64("words").alias("th"), "words")
    ks = sorted(size["ks"]) or [SHINGLE]
    rare = materialize(rare_shingles(items, weights, similarity), "rare")
    pairs_of = materialize(seeded(texts, rare, ks, size["words"]), "pairs")
    # Only documents with a seed are looked at more closely: they are read again, once.
    hit = materialize(pairs_of.select(*DOC).distinct(), "hit")
    again = materialize(texts.join(bounded(hit, hit.count()), DOC, "left_semi").dropDuplicates(DOC), "hit-texts")
    seeds = materialize(alignments(again, items, ks, size["words"], pairs_of), "seeds")
    asked = materialize(places(seeds), "places")
    where = asked.select(*PLACE).distinct()
    windows = again.join(where.hint("merge"), DOC).select(*PLACE, F.expr("slice(words, start + 1, n)").alias("window"))
    windows = materialize(windows.withColumn("fp", simhash("window", width)), "windows")

    index = items.withColumn("item_fp", simhash("words", width)).select(*ITEM, F.col("k").alias("item_k"), "item_fp", blocks("item_fp", radius).alias("x")).select(*ITEM, "item_k", "item_fp", "x.*")
    near = windows.select(*PLACE, "fp", blocks("fp", radius).alias("x")).select(*PLACE, "fp", "x.*")
    near = near.join(bounded(index, size["items"] * (radius + 1)), ["block", "value"]).where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (F.col("k") == F.col("item_k")))
    # A window can't share more of an item's weight than its document does, and shares ``similarity`` of it if it is a leak.
    held_weight = seeds.select(*DOC, *ITEM, F.explode("hs").alias("h")).distinct().join(bounded(weights, size["words"]), "h").groupBy(*DOC, *ITEM).agg(F.sum("w").alias("both"))
    enough = held_weight.join(bounded(totals, size["items"]), ITEM).where(F.col("both") >= similarity * F.col("total") - 1e-9).select(*DOC, *ITEM)
    beyond = asked.join(enough.hint("shuffle_hash"), [*DOC, *ITEM], "left_semi")
    near = materialize(near.select(*PLACE, *ITEM).unionByName(beyond.select(*PLACE, *ITEM)).distinct(), "near")

    pairs = near.join(windows.select(*PLACE, "window"), PLACE)
    parts = pairs.select(*DOC, "start", "n", *ITEM, F.explode(shingles("window", "k")).alias("h"))
    own = items.select(*ITEM, F.explode("hs").alias("h"), F.lit(True).alias("own"))
    parts = parts.join(bounded(weights, size["words"]), "h", "left").join(bounded(own, size["words"]), [*ITEM, "h"], "left").withColumn("w", F.coalesce("w", top))
    sums = parts.groupBy(*DOC, "start", "n", *ITEM).agg(F.sum("w").alias("wide"), F.sum(F.when(F.col("own"), F.col("w")).otherwise(0.0)).alias("both"))
    scored = sums.join(bounded(totals, size["items"]), ITEM).withColumn("similarity", F.col("both") / (F.col("wide") + F.col("total") - F.col("both")))
    good = scored.where(F.col("similarity") >= similarity - 1e-9)
    best = F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"), "n")).alias("b")
    leaks = good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), F.col("b.similarity").alias("similarity"))
    leaks = materialize(leaks, "leaks")
    for df in (items, weights, totals, rare, pairs_of, again, seeds, asked, hit, windows, near):
        drop_table(df)
    return leaks
