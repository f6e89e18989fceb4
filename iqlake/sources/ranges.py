"""Long recordings by ranges: ``spark.read.format("iq_file")`` cuts every file into ranges of samples that tasks read by themselves.

The driver reads headers only and tells each partition where its samples lie; a task seeks there. Supported are .npy (one-dimensional, or the rows of a two-dimensional
array in C order as ports), interleaved int16 (``.int16``, ``.bin``, ``.dat``), TDMS recordings of two int16 channels in any number of segments, and level-5 .mat variables that aren't compressed
(a compressed one has no ranges; ``files.read_iq_files`` reads it whole). Ranges begin at multiples of ``block``, so rows are the same for every ``range``.

Options: the path (a file or a folder, in any store that ``pyarrow.fs`` reaches), ``form`` (npy, int16, tdms, mat, or auto for the suffix), ``key`` (variable of a .mat
file), ``block`` (samples a row), ``left`` and ``right`` (samples before and behind a row's own that it holds too, as far as there are any), ``range`` (samples a partition), ``skip`` and ``count`` (samples left out first, and read at most), ``loop`` (true: a file that is shorter than
``count`` begins again), ``frame`` (samples: the end that doesn't fill a frame is left out).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import MAT_NUMBERS, MAT_TYPES, TDMS_BIG, TDMS_INTERLEAVED, TDMS_NEW_LIST, TDMS_RAW, TDMS_TYPES, npy_header

#: ``own`` is a row's first sample, ``n0`` the first of its context.
SCHEMA = "path string, port int, own long, n0 long, re array<double>, im array<double>"
SUFFIXES = {"npy": "npy", "tdms": "tdms", "mat": "mat", "int16": "int16", "bin": "int16", "dat": "int16"}
NAMES = ["path", "port", "own", "n0", "re", "im"]


@dataclass(frozen=True)
class Extent:
    """Numbers of one kind that lie ``stride`` bytes apart in a file."""

    at: int
    count: int
    dtype: str
    stride: int


@dataclass(frozen=True)
class Piece:
    """Samples from ``first`` on: an extent of complex numbers, or one of real and maybe one of imaginary parts."""

    first: int
    count: int
    re: Extent
    im: Extent | None
    scale: float = 1.0


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file's ports lie."""

    length: int
    ports: tuple[tuple[Piece, ...], ...]


def read_extent(f, e: Extent, lo: int, hi: int) -> np.ndarray:
    """The numbers from ``lo`` up to ``hi``; only their stretch of the file is read."""
    size = np.dtype(e.dtype).itemsize
    f.seek(e.at + lo * e.stride)
    raw = f.read((hi - lo - 1) * e.stride + size)
    if len(raw) < (hi - lo - 1) * e.stride + size:
        raise ValueError("the file ends before its samples do")
    return np.ndarray((hi - lo,), e.dtype, raw, 0, (e.stride,))


def read_samples(f, pieces: tuple[Piece, ...], first: int, end: int) -> np.ndarray:
    """Samples ``first`` to ``end`` of one port."""
    out = np.empty(end - first, complex)
    for p in pieces:
        lo, hi = max(first, p.first), min(end, p.first + p.count)
        if lo >= hi:
            continue
        x = read_extent(f, p.re, lo - p.first, hi - p.first).astype(complex)
        if p.im is not None:
            x.imag = read_extent(f, p.im, lo - p.first, hi - p.first)
        out[lo - first : hi - first] = x * p.scale
    return out


def npy_layout(f, key: str) -> Layout:
    head = f.read(10)
    size = struct.unpack("<H", head[8:10])[0] + 10 if head[6:7] < b"\x02" else struct.unpack("<I", head[8:10] + f.read(2))[0] + 12
    f.seek(0)
    raw = f.read(size)
    dtype, count, at = npy_header(raw)
    shape, fortran = _npy_shape(raw)
    if len(shape) > 2 or (len(shape) == 2 and fortran and shape[0] > 1):
        raise ValueError("a .npy recording has one axis, or ports by samples in C order")
    ports = shape[0] if len(shape) == 2 else 1
    n = count // max(1, ports)
    one = lambda p: (Piece(0, n, Extent(at + p * n * dtype.itemsize, n, dtype.str, dtype.itemsize), None),)
    return Layout(n, tuple(one(p) for p in range(ports)))


def _npy_shape(raw: bytes) -> tuple[tuple[int, ...], bool]:
    import ast

    head = ast.literal_eval(raw[raw.index(b"{") :].decode("latin1"))
    return tuple(head["shape"]), bool(head["fortran_order"])


def int16_layout(f, key: str) -> Layout:
    n = f.size() // 4
    return Layout(n, ((Piece(0, n, Extent(0, n, "<i2", 4), Extent(2, n, "<i2", 4), 1 / 32767),),))


def mat_layout(f, key: str) -> Layout:
    """Extents of the numeric variable ``key``; only heads of elements are read."""
    f.seek(126)
    order = {b"IM": "<", b"MI": ">"}.get(f.read(2))
    if order is None:
        raise ValueError("not a level-5 .mat file")

    def element(at: int) -> tuple[int, int, int, int]:
        """Type, size, place of the content and of the next element."""
        f.seek(at)
        kind, size = struct.unpack(order + "II", f.read(8))
        if kind >> 16:
            return kind & 0xFFFF, kind >> 16, at + 4, at + 8
        return kind, size, at + 8, at + 8 + size + (-size % 8 if kind != 15 else 0)

    at, end, names, packed = 128, f.size(), [], False
    while at + 8 <= end:
        kind, size, body, after = element(at)
        packed |= kind == 15
        if kind == 14:
            parts, pos = [], body
            while pos < body + size:
                parts.append(element(pos))
                pos = parts[-1][3]
            f.seek(parts[0][2])
            flags = struct.unpack(order + "I", f.read(4))[0]
            f.seek(parts[1][2])
            shape = struct.unpack(f"{order}{parts[1][1] // 4}i", f.read(parts[1][1]))
            f.seek(parts[2][2])
            name = f.read(parts[2][1]).decode("latin1")
            if (flags & 0xFF) in MAT_NUMBERS:
                names.append(name)
                if name == key:
                    extents = []
                    for t, n, place, _ in parts[3 : 5 if flags & 0x800 else 4]:
                        dtype = np.dtype(order + MAT_TYPES[t])
                        extents.append((place, n // dtype.itemsize, dtype))
                    count = extents[0][1]
                    # Column order: the ports of a (ports, samples) array alternate.
                    ports = shape[0] if len(shape) == 2 and 1 < shape[0] < shape[1] else 1
                    n = count // ports

                    def port(p: int) -> tuple[Piece, ...]:
                        one = [Extent(place + p * d.itemsize, n, d.str, ports * d.itemsize) for place, _, d in extents]  # noqa: B023
                        return (Piece(0, n, one[0], one[1] if len(one) > 1 else None),)  # noqa: B023

                    return Layout(n, tuple(port(p) for p in range(ports)))
        at = after
    raise KeyError(f"no numeric variable {key!r} that isn't compressed; there are {names}" + (" and compressed ones" if packed else ""))


def tdms_layout(f, key: str) -> Layout:
    """Extents of the two int16 channels of a group, segment by segment; only the segments' heads are read."""
    end_of_file, at = f.size(), 0
    layout: dict[str, tuple[str, int]] = {}
    active: list[str] = []
    found: dict[str, list[Extent]] = {}
    while at + 28 <= end_of_file:
        f.seek(at)
        lead = f.read(28)
        if lead[:4] != b"TDSm":
            break
        flags = struct.unpack_from("<I", lead, 4)[0]
        order = ">" if flags & TDMS_BIG else "<"
        after, skip = struct.unpack_from(order + "QQ", lead, 12)
        data, end = at + 28 + skip, min(end_of_file, at + 28 + after)
        head, pos = f.read(skip), 0

        def take(form: str) -> int:
            nonlocal pos
            value = struct.unpack_from(order + form, head, pos)[0]  # noqa: B023
            pos += struct.calcsize(form)
            return value

        def text() -> str:
            nonlocal pos
            size = take("I")
            pos += size
            return head[pos - size : pos].decode()  # noqa: B023

        if flags & TDMS_NEW_LIST:
            active = []
        for _ in range(take("I") if skip else 0):
            path, index = text(), take("I")
            if index not in (0, 0xFFFFFFFF):
                kind, _, count = take("I"), take("I"), take("Q")
                if kind not in TDMS_TYPES:
                    raise ValueError(f"channel {path} has values of type {kind:#x}, not numbers")
                layout[path] = (order + TDMS_TYPES[kind], count)
            if index != 0xFFFFFFFF and path not in active:
                active.append(path)
            for _ in range(take("I")):
                text()
                kind = take("I")
                if kind == 0x20:
                    text()
                else:
                    pos += 16 if kind == 0x44 else np.dtype(TDMS_TYPES[kind]).itemsize
        if flags & TDMS_RAW and active:
            widths = {p: np.dtype(layout[p][0]).itemsize * (1 if flags & TDMS_INTERLEAVED else layout[p][1]) for p in active}
            record = sum(widths.values())
            times = (end - data) // record if record else 0
            offset = data
            for p in active if times else []:
                dtype, count = layout[p]
                if flags & TDMS_INTERLEAVED:
                    found.setdefault(p, []).append(Extent(offset, times, dtype, record))
                else:
                    size = np.dtype(dtype).itemsize
                    found.setdefault(p, []).extend(Extent(offset + i * record, count, dtype, size) for i in range(times))
                offset += widths[p]
        at = end
    by_name = {p.rpartition("/")[2].strip("'"): e for p, e in found.items()}
    one = lambda name: float(read_extent(f, by_name[name][0], 0, 1)[0]) if name in by_name else None
    groups: dict[str, list[str]] = {}
    for p in found:
        groups.setdefault(p.rpartition("/")[0], []).append(p)
    pairs = [ps for ps in groups.values() if len(ps) == 2 and all(np.dtype(found[p][0].dtype).str[1:] == "i2" for p in ps)]
    if not pairs:
        raise ValueError("no group of two int16 channels")
    level, total = one("reference_level_dBm") or 0.0, one("total_samples")
    scale = 10 ** (level / 20) / 32767
    pieces, first = [], 0
    for i, q in zip(*(found[p] for p in pairs[0]), strict=True):
        pieces.append(Piece(first, i.count, i, q, scale))
        first += i.count
    return Layout(min(first, int(total)) if total is not None else first, (tuple(pieces),))


LAYOUTS: dict[str, Callable[..., Layout]] = {"npy": npy_layout, "int16": int16_layout, "mat": mat_layout, "tdms": tdms_layout}


@dataclass
class Range(InputPartition):
    """Samples ``first`` to ``end`` of ``total``, numbered from ``skip`` on in the file and, in a loop, through its length again and again."""

    path: str
    layout: Layout
    first: int
    end: int
    skip: int
    total: int


@dataclass(frozen=True)
class Options:
    path: str
    form: str = "auto"
    key: str = "waveform"
    block: int = 1 << 18
    range: int = 1 << 24
    skip: int = 0
    count: int = -1
    loop: bool = False
    frame: int = 1
    left: int = 0
    right: int = 0

    @classmethod
    def of(cls, options: dict[str, str]) -> Options:
        given = {k.lower(): v for k, v in options.items()}
        kinds = {"path": str, "form": str, "key": str, "loop": lambda x: str(x).lower() == "true"}
        made = cls(**{k: kinds.get(k, int)(given[k]) for k in cls.__dataclass_fields__ if k in given})
        if min(made.block, made.range, made.frame) < 1 or min(made.skip, made.left, made.right) < 0 or made.form not in ("auto", *LAYOUTS):
            raise ValueError(f"form must be auto or one of {sorted(LAYOUTS)}; block, range and frame positive, skip, left and right not negative")
        if made.loop and made.count < 0:
            raise ValueError("a loop needs a count")
        return made


def files_of(path: str) -> list[tuple[fs.FileSystem, str, str]]:
    """Store, name in it and full path of the files under ``path``, in order."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(store, name, path)]
    found = sorted(x.path for x in store.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File)
    return [(store, x, prefix + x) for x in found]


def ranges(o: Options) -> list[Range]:
    out = []
    step = -(-o.range // o.block) * o.block
    for store, name, full in files_of(o.path):
        form = o.form if o.form != "auto" else SUFFIXES.get(name.rpartition(".")[2].lower())
        if form is None:
            continue
        with store.open_input_file(name) as f:
            layout = LAYOUTS[form](f, o.key)
        have = max(0, layout.length - o.skip)
        if o.count >= 0:
            if o.loop and layout.length:
                have = o.count
            elif o.count > have:
                raise ValueError(f"{full} has {have} samples, not {o.count}")
            else:
                have = o.count
        have = have // o.frame * o.frame
        out += [Range(full, layout, a, min(a + step, have), o.skip, have) for a in range(0, have, step)]
    return out


def read_range(r: Range, block: int, left: int = 0, right: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of a range; those with context begin before their own samples, which begin at multiples of ``block``."""
    (store, name, _), length, kind = files_of(r.path)[0], r.layout.length, pa.list_(pa.float64())
    with store.open_input_file(name) as f:
        for begin in range(r.first, r.end, block):
            a, b = max(0, begin - left), min(begin + block + right, r.total)
            for port, pieces in enumerate(r.layout.ports):
                x, at = [], a + r.skip
                while at < b + r.skip:
                    lo = at % length
                    hi = min(length, lo + b + r.skip - at)
                    x.append(read_samples(f, pieces, lo, hi))
                    at += hi - lo
                y = np.concatenate(x)
                yield pa.RecordBatch.from_arrays([pa.array([r.path]), pa.array([port], pa.int32()), pa.array([begin], pa.int64()), pa.array([a], pa.int64()), pa.array([y.real], kind), pa.array([y.imag], kind)], names=NAMES)


class RangeReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Range]:
        # Spark asks for a partition at least; an empty one has nothing to read.
        return ranges(self.options) or [Range("", Layout(0, ()), 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.first:
            yield from read_range(partition, self.options.block, self.options.left, self.options.right)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iq_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RangeReader:
        return RangeReader(Options.of(self.options))


def read_iq_ranges(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Blocks (capture_id, port, n0, re, im, path) of the files under ``path``; a capture is a file."""
    spark.dataSource.register(RangeSource)
    found = spark.read.format("iq_file").options(**{k: str(v) for k, v in options.items()}).load(path)
    return found.select(F.xxhash64("path").alias("capture_id"), "port", "n0", "re", "im", "path")


def read_iq_chunks(spark: SparkSession, path: str, size: int, left: int = 0, right: int = 0, **options: object) -> DataFrame:
    """Files as chunks of ``size`` samples that hold their context: what filters, resamplers, correlations and corrections take in place of blocks, without any shuffle.

    Each task reads the context with its own samples, from the neighbouring range if need be.
    """
    spark.dataSource.register(RangeSource)
    found = spark.read.format("iq_file").options(**{k: str(v) for k, v in options.items()}, block=str(size), left=str(left), right=str(right)).load(path)
    chunk = F.floor(F.col("own") / size).cast("long")
    piece = F.struct("n0", "re", "im")
    return found.select(F.xxhash64("path").alias("capture_id"), "port", chunk.alias("chunk"), F.array(piece).alias("pieces"), *(F.lit(v).cast("long").alias(n) for n, v in (("size", size), ("left", left), ("right", right))), "path")
