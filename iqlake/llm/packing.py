"""Concatenate-and-cut packing of tokenised documents into fixed-length sequences.

Pass one tokenises each document once and notes how many tokens stand before it in its partition. The totals of the
partitions are prefix-summed into global offsets. Pass two cuts every document at the multiples of the sequence length;
a document over a boundary leaves one record on each side. Both passes are narrow: only partition totals are shuffled.

Defined results: a null text counts as empty, an empty text is the end id alone, repeated rows are packed once per row,
an empty table gives no pieces, very long texts are cut as often as needed, and columns other than the id and the text are
ignored, so their names can't clash. Only the last sequence of the corpus can be shorter than the sequence length.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The pre-tokeniser's pattern in word_bpe_49k.json (a fixed value of that public file).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How a tokeniser must normalise and split for its texts to be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Texts of other characters than these go through the tokeniser whole: normalisation may change them.
PLAIN = "[^\\x00-\\x84\\x86-\\u024f\\u2010-\\u2027\\u20ac]"
#: So do texts with separators that only some libraries count as white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
END_ID = 2
#: Offsets are 16 bytes a partition: up to this many rows (16 MB) they are broadcast, beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_ENCODERS: dict[str, Callable] = {}


class Numbers(dict):
    """A number for each string, in the order in which strings are first asked for; new ones are listed until they are taken."""

    def __init__(self, strings: Iterable[str] = ()):
        super().__init__(zip(strings, itertools.count()))
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def of(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, strings), np.int64, len(strings))

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Lists:
    """Lists of ids by number, in one array that grows."""

    def __init__(self):
        self.starts, self.flat, self.count = np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.starts[self.count])
        while len(self.starts) < self.count + len(lengths) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.flat) < used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.starts[self.count + 1 : self.count + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.count += len(lengths)

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists ``at`` in a row, and the length of each."""
        lo = self.starts[at]
        n = self.starts[at + 1] - lo
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n)], n


class CachedEncoder:
    """Ids of texts under a word-level BPE tokeniser; each distinct pre-token is encoded once, and put together once for each distinct word (a run without white space).

    The tokeniser lower-cases, drops white space and never merges over pre-tokens, so a text's ids are its words' ids in a row, and these are their pre-tokens'. The
    last id of each pre-token is one whose string ends in ``</w>``, which splits the ids of a joined string of new ones. What is held is bounded: beyond
    ``most`` words or pre-tokens the words that were met again stay, half of ``most`` at the most. A tokeniser that splits or normalises in another way gets every text whole.
    """

    def __init__(self, path: str, most: int = 200_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.most = path, most
        self.tok = Tokenizer.from_file(path)
        self.find, self.odd = regex.compile(PRE_TOKEN + "|\n").findall, re.compile(PLAIN).search
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for word, i in self.tok.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.whole = [*SEPARATORS, *(x.content for x in self.tok.get_added_tokens_decoder().values())]
        made = json.loads(self.tok.to_str(pretty=False))
        self.by_word = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
        # Words come in lower case and pre-tokens one by one: neither is done again. Texts that go whole have a tokeniser as it was, from the first one on.
        self.plain = None if self.by_word else self.tok
        if self.by_word:
            self.tok.normalizer = None
            self.tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        """Number 0 is the end of a text; no word holds white space."""
        self.words, self.word_ids, self.used = Numbers(["\n"]), Lists(), np.zeros(1024, np.int64)
        self.word_ids.append(np.array([END_ID], np.uint32), np.array([1]))
        self.parts, self.part_ids = Numbers(), Lists()

    def shrink(self) -> None:
        """Keeps the words that were met again, the most frequent ones."""
        used, names = self.used[: len(self.words)], list(self.words)
        used[0] = 0
        again = np.flatnonzero(used > 1)
        kept = np.sort(again[np.argsort(-used[again], kind="stable")][: self.most // 2])
        ids, n = self.word_ids.joined(kept)
        self.forget()
        self.words = Numbers(["\n", *(names[i] for i in kept.tolist())])
        self.word_ids.append(ids, n)

    def encode_parts(self, new: list[str]) -> None:
        ids = np.array(self.tok.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(new) or len(ids) != stops[-1]:
            raise ValueError("pre-tokens and word ends don't match; the tokeniser isn't a word-end BPE")
        self.part_ids.append(ids, np.diff(stops, prepend=0))

    def learn(self, new: list[str]) -> None:
        found = self.find("\n".join(new))
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
        counts = np.diff(np.concatenate([[-1], breaks, [len(found)]])) - 1
        at = self.parts.of([x for x in found if x != "\n"])
        if self.parts.new:
            self.encode_parts(self.parts.taken())
        ids, n = self.part_ids.joined(at)
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        self.word_ids.append(ids, np.diff(upto))

    def encode_whole(self, text: str) -> np.ndarray:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return np.array([*self.plain.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        if max(len(self.words), len(self.parts)) > self.most:
            self.shrink()
        out: list[np.ndarray | None] = []
        rows: list[np.ndarray] = []
        for t in texts:
            if t and (not self.by_word or not t.isascii() and self.odd(t) or any(s in t for s in self.whole)):
                out.append(self.encode_whole(t))
                continue
            ws = t.lower().split() if t else []
            ws.append("\n")
            rows.append(self.words.of(ws))
            out.append(None)
        if self.words.new:
            self.learn(self.words.taken())
        if not rows:
            return out
        at = np.concatenate(rows)
        while len(self.used) < len(self.words):
            self.used = np.concatenate([self.used, np.zeros_like(self.used)])
        met = np.bincount(at)
        self.used[: len(met)] += met
        ids, n = self.word_ids.joined(at)
        upto = np.cumsum(n)[np.cumsum([len(r) for r in rows]) - 1]
        made = iter(np.split(ids, upto[:-1]))
        return [next(made) if x is None else x for x in out]


def encoder(path: str) -> Callable[[list[str | None]], list[np.ndarray]]:
    """One encoder a worker process; its cache is bounded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def by_bytes(texts: list[str | None], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about ``most`` characters, so that what a batch needs in memory is bounded by it or by its longest text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def token_table(docs: DataFrame, tokenizer: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, before, doc_id, n, ids): tokens of each document, and how many stand before it in its partition.

    ``tokenizer`` is a file's path, or a file's name in the public_tokenizers package, resolved where it is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, before = encoder(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), 0
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for s in by_bytes(texts):
                ids = encode(texts[s])
                n = np.array([len(x) for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                small = [x.astype("<u4").tobytes() if x.max() > 0xFFFF else x.astype("<u2").tobytes() for x in ids]
                wide = [bool(x.max() > 0xFFFF) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(at), keys.slice(s.start, len(n)).cast(pa.int64()), pa.array(n), pa.array(wide), pa.array(small, pa.binary())], names=["part", "before", "doc_id", "n", "wide", "ids"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "part long, before long, doc_id long, n long, wide boolean, ids binary")


def tokenizer_path(name: str | None) -> str:
    if name and "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name or "word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (binary, little-endian 32 bit), doc_tokens, sequence_id, offset."""
    tokens = materialize(token_table(docs, tokenizer, id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row a partition. Blocks of partitions are summed first, so no single task orders more than sqrt-many rows of a huge job.
    blocks = totals.withColumn("block", F.floor(F.col("part") / 4096))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("block").agg(F.sum("total").alias("t")).select("block", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("base"))
    offsets = blocks.withColumn("inner", F.coalesce(F.sum("total").over(within), F.lit(0))).join(bases, "block").select("part", (F.col("inner") + F.col("base")).alias("part_start"))
    offsets = materialize(offsets.coalesce(1), "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("at"), "n", "wide", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            rows: list[tuple] = []
            for doc, at, n, wide, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    rows.append((doc, start, size, ids[start : start + size].tobytes(), n, seq, off))
                    start += size
                if len(rows) >= 2000:
                    yield to_batch(rows, names)
                    rows = []
            if rows:
                yield to_batch(rows, names)

    def to_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = 4096) -> DataFrame:
    """The digest of :func:`pack`: crc32 of the ids in place of the ids."""
    return pack(docs, tokenizer, length).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc_of(ids: list[int]) -> int:
    """What :func:`pieces` has for these ids; tests use it."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
