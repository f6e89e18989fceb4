"""Language identification by compression.

Per language a zstandard raw-content dictionary is made of sampled labelled texts: their words, the commonest last, where matches
are nearest. A text is cut into chunks, each chunk is compressed under every dictionary, and the language with the smallest total
wins. If the runner-up's total is hardly larger, the margin is too narrow and the text is rejected. Only letters count: case is
folded and other characters become spaces.

The sample is bounded: ``SAMPLE`` texts over all languages (but ``LEAST`` of each), chosen by a hash of the id; of a text longer than ``STRETCH``
characters, a stretch of that length at a place that the hash gives. Predictions see the whole text and nothing else.
Every language with labelled rows is learned, however many there are: the model has up to ``DICT_BYTES`` a language, and predicting takes time in proportion.
Defined results: a null text or one without letters is ``und`` with score 0 and rejected; repeated rows get equal results; without
training rows every text is ``und``; a language whose sampled texts hold no letter isn't learned; ties go to the language with more training rows;
sizes are whole bytes, so a text of a few words isn't rejected for a tie; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts sampled over all languages, the least of one, characters of a text, and bytes of each dictionary: what fitting sees is bounded by them.
SAMPLE, LEAST, STRETCH, DICT_BYTES = 2400, 20, 20_000, 24 << 10
#: Languages up to which their counts are broadcast, and the least bytes that zstandard takes as a dictionary.
BROADCAST_ROWS, LEAST_BYTES = 10_000, 16
CHUNK = 4096
#: A margin below this share of the smallest size, less half a byte, is narrow.
NARROW_SHARE = 0.004
UNKNOWN = "und"


#: ASCII bytes that are not letters become spaces; texts with other characters than these letters take the slower general way.
BLANKS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
BEYOND = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-ɏ]")


def folded(text: str | None) -> bytes:
    """Lower-case letters and marks, other runs of characters being one space; empty if there is no letter."""
    text = (text or "").lower()
    if not BEYOND.search(text):
        return b" ".join(text.encode().translate(BLANKS).split())
    import regex

    text = regex.sub(r"[^\p{L}\p{M}]+", " ", text).strip()
    return text.encode() if regex.search(r"\p{L}", text) else b""


def word_counts(picked: DataFrame) -> DataFrame:
    """(lang, word, n) of folded sampled texts (lang, text), summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(folded(text).decode().split(" "))
        for lang, counted in seen.items():
            counted.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["lang", "word", "n"])

    return picked.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> dict[str, bytes]:
    """Dictionary per language, the language with most rows first, from labelled rows; a training filter belongs before this call."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    langs = [r["lang"] for r in counts.orderBy(F.desc("rows"), "lang").select("lang").collect()]
    if not langs:
        return {}
    hashed = F.xxhash64("id")
    draw = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(counts) if len(langs) <= BROADCAST_ROWS else counts.hint("merge"), "lang").where(draw * F.col("rows") < max(least, sample / len(langs)))
    start = F.pmod(F.shiftright(hashed, 30), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1) + 1
    picked = picked.withColumn("text", F.col("text").substr(start.cast("int"), F.lit(STRETCH)))
    # The commonest words of a language, while they fit into its dictionary; a task sees the sampled words of one.
    commonest = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    kept = word_counts(picked).withColumn("bytes", F.sum(F.octet_length("word") + 1).over(commonest)).where(F.col("bytes") <= DICT_BYTES)
    words: dict[str, list[tuple[int, str]]] = {}
    for r in kept.select("lang", "word", "n").collect():
        words.setdefault(r["lang"], []).append((-r["n"], r["word"]))
    out = {lang: (" " + " ".join(w for _, w in sorted(words[lang], reverse=True)) + " ").encode() for lang in langs if lang in words}
    return {lang: d.rjust(LEAST_BYTES) for lang, d in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = list(dictionaries)
        self.by = []
        # Matches of four bytes, found by binary trees: short words count, and sizes of short texts tell languages apart.
        how = z.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.by.append(z.ZstdCompressor(compression_params=how, dict_data=d).compress)

    def sizes(self, data: bytes) -> list[int]:
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(c(x)) for x in chunks) for c in self.by]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        data = folded(text)
        if not data or not self.by:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(b" " + data + b" ")
        best = min(sizes)
        at = sizes.index(best)
        others = sizes[:at] + sizes[at + 1 :]
        margin = min(others) - best if others else best
        score = 1 / (1 + sum(math.exp(-min(60.0, (s - best) / 3)) for s in others))
        return self.langs[at], score, bool(others) and margin < NARROW_SHARE * best - 0.5


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row, and the columns ``carry`` names (they must not clash with these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for b in batches:
            found = [model(t) for t in b.column(1).to_pylist()]
            made = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)] if found else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[2:]], names=["doc_id", "lang_pred", "score", "rejected", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    extra = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean" + extra)


def held_out(id_col: str = "doc_id") -> Column:
    from .common import id_crc

    return id_crc(id_col) % 4 == 2
