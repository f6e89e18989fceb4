"""Phrase collocation mining over generalised suffix automata.

Every task reads its texts into shards of at most ``SHARD_WORDS`` words and builds, per shard and language, the suffix automaton of all pieces, to the depth of
the longest phrase. It is built level by level, in arrays: a transition is a pair of a state and a word, the suffix link of a state is the state of the
window that ends at the same word and is one word shorter. Every word is an end position of the deepest state that ends there, and
these counts flow down the suffix links. States of one end-position class aren't merged: a class differs from shard to shard, and counts are added by phrase.

1. Automata one word less deep give hashes of all phrases of two words and more with their counts; only hashes and counts are shuffled. Those that reach the
   least count make up a Bloom filter, which may hold others too but misses none.
2. Full automata give the phrases themselves: a state is left out if it, or for the deepest ones its suffix link or its prefix, isn't in the filter, for no phrase
   is more frequent than its parts. The counts are added up exactly, by the phrase's text.
3. A phrase's cuts meet the counts of their parts. A candidate is subsumed by one that is a word longer if it is that one's suffix link or prefix; phrases longer by
   more words need no look, as the one between is at least as frequent as these.

The Bloom filter has at most ``MOST_BITS`` bits (16 MB); with more frequent phrases than it can tell apart, more rows are shuffled in the second step, with equal results.

Defined results: null and empty texts hold no words; a null language is ``und`` (as one that is called so); a word of any length is one word; a phrase never spans a piece's end;
repeated rows count each; bytes that aren't UTF-8 are replaced first; an empty table gives no rows; other columns are ignored. Counts up to 10^15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Words in one shard's automata; what a task holds is bounded by them.
SHARD_WORDS = 2_000_000
#: Bytes that are read into words at a time.
SLICE = 1 << 20
#: Bits of the Bloom filter: so many for a phrase, and in all at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Parts in which a language's phrases are ranked before the first of each part meet.
RANK_PARTS = 16
UNKNOWN = "und"
BREAK = b"\xff"  # never a byte of UTF-8

_FOLD = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = BREAK[0]
_FOLD = bytes(_FOLD)


class Vocabulary(dict):
    """Word to number from 1 on; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Automaton:
    """Suffix automaton of the pieces in ``words`` (numbers from 1, 0 between pieces), of windows up to ``depth`` words.

    ``state[m]`` holds the state of the window of m words that ends at each word (0: none). ``prefix[m]``, ``last[m]`` and ``link[m]`` hold a state's
    prefix and last word (its transition) and its suffix link, ``count[m]`` the size of its end-position set. The first ``context`` words open windows but are no end positions.
    """

    def __init__(self, words: np.ndarray, n_words: int, depth: int, context: int = 0):
        words = words.astype(np.int64)
        self.depth = depth
        state = words
        none = np.zeros(1, np.int64)
        self.prefix, self.last, self.link = [none, np.zeros(n_words, np.int64)], [none, np.arange(n_words)], [none, np.zeros(n_words, np.int64)]
        ends = np.arange(len(words)) >= context
        self.words = int((ends & (words > 0)).sum())
        held: list[tuple[np.ndarray, int]] = [(state, n_words)]
        for _ in range(2, depth + 1):
            before = np.concatenate([none, state[:-1]])
            at = np.flatnonzero((before > 0) & (words > 0))
            codes, pairs = pd.factorize(before[at] * n_words + words[at])
            longer = np.zeros(len(words), np.int64)
            longer[at] = codes + 1
            link = np.zeros(len(pairs) + 1, np.int64)
            link[longer[at]] = state[at]
            self.prefix.append(np.concatenate([none, pairs // n_words]))
            self.last.append(np.concatenate([none, pairs % n_words]))
            self.link.append(link)
            state = longer
            held.append((state, len(pairs) + 1))
        self.count = [np.zeros(1, np.int64)] * (depth + 1)
        flow = np.zeros(held[-1][1])
        for m in range(depth, 0, -1):
            state, n = held[m - 1]
            deepest = ends & (state > 0) & (held[m][0] == 0 if m < depth else True)
            flow = (flow if m < depth else 0) + np.bincount(state[deepest], minlength=n)
            self.count[m] = flow.astype(np.int64)
            if m > 1:
                flow = np.bincount(self.link[m], weights=flow, minlength=held[m - 2][1])

    def spelled(self, m: int, states: np.ndarray) -> list[np.ndarray]:
        """Word numbers of states of m words, first word first."""
        out = []
        for level in range(m, 0, -1):
            out.append(self.last[level][states])
            states = self.prefix[level][states]
        return out[::-1]

    def hashes(self, of_words: np.ndarray) -> list[np.ndarray]:
        """Per level the states' hashes, from those of the words alone: equal phrases have equal hashes in all shards."""
        out = [np.zeros(1, np.uint64), of_words]
        for m in range(2, self.depth + 1):
            out.append(mixed(out[m - 1][self.prefix[m]] * np.uint64(0x9E3779B97F4A7C15) + of_words[self.last[m]] + np.uint64(m)))
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the input moves about half of the output's."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shard:
    """Words of one language on their way to an automaton."""

    def __init__(self, lang: str):
        self.lang, self.vocabulary, self.parts, self.context = lang, Vocabulary(), [], 0

    def add(self, text: bytes) -> int:
        words = text.replace(BREAK, b" " + BREAK + b" ").split()
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        return len(words)

    def automaton(self, depth: int) -> Automaton:
        return Automaton(np.concatenate(self.parts), len(self.vocabulary), depth, self.context)

    def word_hashes(self) -> np.ndarray:
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))

    def rest(self, words: int) -> Shard:
        """A shard that goes on within the last text: its last words are context only."""
        out, spelled = Shard(self.lang), list(self.vocabulary)
        tail = np.concatenate(self.parts)[-words:].tolist() if words else []
        out.parts = [np.array([out.vocabulary[spelled[i]] for i in tail], np.int32)]
        out.context = len(tail)
        return out


def slices(text: bytes) -> Iterator[bytes]:
    """A folded text in slices of about ``SLICE`` bytes that end between words."""
    lo = 0
    while len(text) - lo > SLICE:
        cut = max(text.rfind(x, lo + 1, lo + SLICE) for x in (b" ", b"\t", BREAK))
        if cut < 0:
            cut = min((i for i in (text.find(x, lo + SLICE) for x in (b" ", b"\t", BREAK)) if i >= 0), default=len(text))
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Shard]:
    """Shards of (lang, text) rows, all languages together at most about ``SHARD_WORDS`` words at a time."""
    open_: dict[str, Shard] = {}
    held = 0
    for b in batches:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_buffer().to_pybytes().translate(_FOLD) if text.is_valid else b""
            waiting.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw)
            if size[lang] < SLICE:
                continue
            held = yield from _read(open_, lang, waiting.pop(lang), held, depth)
            size[lang] = 0
        for lang, texts in waiting.items():
            held = yield from _read(open_, lang, texts, held, depth)
    yield from (s for s in open_.values() if s.parts)


def _read(open_: dict[str, Shard], lang: str, texts: list[bytes], held: int, depth: int) -> Iterator[Shard]:
    """Hands out full shards and returns the number of words still held."""
    whole = BREAK.join([*texts, b""])
    for part in slices(whole):
        if lang not in open_:
            open_[lang] = Shard(lang)
        held += open_[lang].add(part)
        if held >= SHARD_WORDS:
            yield from open_.values()
            # The next slice may go on within a piece.
            open_[lang] = open_.pop(lang).rest(depth - 1)
            for other in [x for x in open_ if x != lang]:
                del open_[other]
            held = 0
    return held


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.make_valid_utf8(F.col(text_col).cast("string")).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"))


def hash_counts(texts: DataFrame, depth: int) -> DataFrame:
    """(h, n): hashes of all phrases from 2 to ``depth`` words, per shard, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, depth):
            a = shard.automaton(depth)
            h = a.hashes(shard.word_hashes())
            for m in range(2, depth + 1):
                at = np.flatnonzero(a.count[m])
                yield pa.RecordBatch.from_arrays([pa.array(h[m][at].view(np.int64)), pa.array(a.count[m][at])], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long")


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a hash stands in a filter of ``bits`` (a power of two) bits."""
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def bloom(frequent: DataFrame) -> tuple[bytes, int]:
    """The filter over the hashes in ``frequent`` and its size in bits. At most ``MOST_BITS`` / 64 numbers come to the driver."""
    n = frequent.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_EACH * n).bit_length()))
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))))
    words = frequent.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    out = np.zeros(bits // 64, "<i8")
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.tobytes(), bits


def phrase_counts(texts: DataFrame, depth: int, filter_bytes: bytes, bits: int) -> DataFrame:
    """(lang, m, phrase, n): counts per shard of all words, and of the phrases that the filter lets pass; m = 0 counts the words of a language."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of_bits = np.frombuffer(shared.value, "<u8")
        seen = lambda p: (words_of_bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0
        for shard in shards(batches, depth):
            a = shard.automaton(depth)
            spelling = pa.array(list(shard.vocabulary), pa.binary())
            h = a.hashes(shard.word_hashes())
            passed = [np.ones(1, bool), np.ones(len(a.count[1]), bool)]
            for m in range(2, depth + 1):
                if m < depth or depth == 2:
                    passed.append(np.logical_and(*(seen(p) for p in positions(h[m], bits))))
                else:
                    passed.append(passed[m - 1][a.prefix[m]] & passed[m - 1][a.link[m]])
            for m in range(depth + 1):
                at = np.flatnonzero(passed[m] & (a.count[m] > 0)) if m else np.zeros(1, np.int64)
                words = [spelling.take(pa.array(w)) for w in a.spelled(m, at)]
                text = pc.binary_join_element_wise(*words, b" ") if m > 1 else words[0] if m else pa.array([b""], pa.binary())
                n = a.count[m][at] if m else [a.words]
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(at), pa.string()), pa.array([m] * len(at), pa.int32()), text.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "m", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, m int, phrase string, n long")


def frequent_phrases(docs: DataFrame, max_words: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, m, phrase, a): exact counts of all words and phrases up to ``max_words`` words that occur ``least`` times; m = 0 holds each language's number of words."""
    texts = _texts(docs, text_col, lang_col)
    shorter = max(2, max_words - 1)
    hashes = hash_counts(texts, shorter).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")
    held = materialize(hashes, "phrase-hashes")
    filter_bytes, bits = bloom(held)
    drop_table(held)
    counts = phrase_counts(texts, max_words, filter_bytes, bits).groupBy("lang", "m", "phrase").agg(F.sum("n").alias("a"))
    return counts.where((F.col("a") >= least) | (F.col("m") == 0))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of two words and more.

    The score is floor(10^6 a^2 / (l r)) at the cut where it is lowest; a phrase goes if a longer candidate that holds it has at least ``share`` hundredths of its count.
    """
    counted = materialize(frequent_phrases(docs, max_words, least, text_col, lang_col), "phrases")
    phrases = counted.where("m >= 2")
    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, m - 1)"))).withColumn("first", first).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    parts = counted.where(F.col("m").between(1, max(1, max_words - 1)))
    heads, tails = (parts.select("lang", F.col("phrase").alias(p), F.col("a").alias(f)) for p, f in (("first", "l"), ("rest", "r")))
    whole = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"({whole('a')} * {whole('a')} * 1000000) div ({whole('l')} * {whole('r')})")
    scored = cuts.join(heads, ["lang", "first"]).join(tails, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Suffix link and prefix of each longer candidate.
    links = F.expr("array(substring(phrase, length(substring_index(phrase, ' ', 1)) + 2), substring_index(phrase, ' ', m - 1))")
    longer = phrases.where("m >= 3").select("lang", F.explode(links).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    alone = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    found = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    for keys in ([F.col("lang"), part], [F.col("lang")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counted.where("m = 0").select("lang", F.col("a").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
