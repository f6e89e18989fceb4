"""IQ files as blocks: .npy, raw int16, level-5 .mat and TDMS files, each file parsed in the task that reads it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def npy_header(raw: bytes) -> tuple[np.dtype, int, int]:
    """Type, samples and header size of a one-dimensional .npy file."""
    import ast

    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = raw[6] >= 2
    size = struct.unpack("<I" if wide else "<H", raw[8 : 12 if wide else 10])[0]
    start = 12 if wide else 10
    head = ast.literal_eval(raw[start : start + size].decode("latin1"))
    return np.dtype(head["descr"]), int(np.prod(head["shape"])), start + size


#: Fixed values of the level-5 MAT format: element types, and the array classes that hold numbers.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_NUMBERS = range(6, 16)
#: Fixed values of the TDMS format: numeric types by code, and bits of a segment's flags.
TDMS_TYPES = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8", 0x21: "?"}
TDMS_NEW_LIST, TDMS_RAW, TDMS_INTERLEAVED, TDMS_BIG = 1 << 2, 1 << 3, 1 << 5, 1 << 6


def mat_elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the elements in a row; compressed ones come opened."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # a small element: size and type share a word, up to four bytes follow
            kind, size, body = kind & 0xFFFF, kind >> 16, at + 4
            end = at + 8
        else:
            body = at + 8
            end = body + size + (-size % 8 if kind != 15 else 0)
        if kind == 15:
            yield from mat_elements(zlib.decompress(raw[body : body + size]), order)
        else:
            yield kind, raw[body : body + size]
        at = end


def mat_variable(raw: bytes, key: str = "waveform") -> np.ndarray:
    """The numeric variable ``key`` of a level-5 file as complex numbers, in the file's (column) order."""
    order = {b"IM": "<", b"MI": ">"}.get(raw[126:128])
    if order is None:
        raise ValueError("not a level-5 .mat file")
    names = []
    for kind, body in mat_elements(raw[128:], order):
        if kind != 14:
            continue
        parts = list(mat_elements(body, order))
        flags = struct.unpack_from(order + "I", parts[0][1])[0]
        name = parts[2][1].decode("latin1")
        if (flags & 0xFF) in MAT_NUMBERS:
            names.append(name)
            if name == key:
                re, *im = (np.frombuffer(x, order + MAT_TYPES[t]).astype(float) for t, x in parts[3 : 5 if flags & 0x800 else 4])
                return re + 1j * im[0] if im else re.astype(complex)
    raise KeyError(f"no numeric variable {key!r}; there are {names}")


def tdms_channels(raw: bytes) -> dict[str, np.ndarray]:
    """Numeric channels by path, over all segments."""
    found: dict[str, list[np.ndarray]] = {}
    layout: dict[str, tuple[str, int]] = {}
    active: list[str] = []
    at = 0
    while at + 28 <= len(raw) and raw[at : at + 4] == b"TDSm":
        flags = struct.unpack_from("<I", raw, at + 4)[0]
        order = ">" if flags & TDMS_BIG else "<"
        after, skip = struct.unpack_from(order + "QQ", raw, at + 12)
        data, end = at + 28 + skip, min(len(raw), at + 28 + after)
        pos = at + 28

        def take(form: str) -> int:
            nonlocal pos
            value = struct.unpack_from(order + form, raw, pos)[0]  # noqa: B023
            pos += struct.calcsize(form)
            return value

        def text() -> str:
            nonlocal pos
            size = take("I")
            pos += size
            return raw[pos - size : pos].decode()

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
        if flags & TDMS_RAW:
            record = np.dtype([(p, *((layout[p][0],) if flags & TDMS_INTERLEAVED else (layout[p][0], (layout[p][1],)))) for p in active])
            for p in active if record.itemsize else []:
                found.setdefault(p, []).append(np.frombuffer(raw, record, (end - data) // record.itemsize, data)[p].ravel())
        at = end
    return {p: np.concatenate(x) for p, x in found.items()}


def tdms_iq(raw: bytes) -> np.ndarray:
    """Samples of a recording whose first group describes it and whose second one holds two int16 channels, scaled by the reference level."""
    channels = tdms_channels(raw)
    by_name = {p.rpartition("/")[2].strip("'"): x for p, x in channels.items()}
    groups: dict[str, list[str]] = {}
    for p in channels:
        groups.setdefault(p.rpartition("/")[0], []).append(p)
    pairs = [ps for ps in groups.values() if len(ps) == 2 and all(channels[p].dtype.kind == "i" and channels[p].dtype.itemsize == 2 for p in ps)]
    if not pairs:
        raise ValueError("no group of two int16 channels")
    i, q = (channels[p].astype(float) for p in pairs[0])
    size = int(by_name["total_samples"][0]) if "total_samples" in by_name else len(i)
    level = float(by_name["reference_level_dBm"][0]) if "reference_level_dBm" in by_name else 0.0
    return (i + 1j * q)[:size] * (10 ** (level / 20) / 32767)


def read_iq_files(spark: SparkSession, path: str, form: str = "auto", block: int = 1 << 18, key: str = "waveform") -> DataFrame:
    """Blocks of every file under ``path``; ``form`` is npy, mat (variable ``key``), tdms or int16 (interleaved), or auto for the suffix.

    The files come through Spark's binaryFile reader, so any store that Spark reads will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind_of = form if form != "auto" else name.rpartition(".")[2].lower()
                if kind_of == "npy":
                    dtype, n, at = npy_header(raw)
                    x = np.frombuffer(raw, dtype, n, at).astype(complex)
                elif kind_of == "mat":
                    x = mat_variable(raw, key)
                elif kind_of == "tdms":
                    x = tdms_iq(raw)
                else:
                    pairs = np.frombuffer(raw, "<i2").astype(float) / 32767
                    x = pairs[0::2] + 1j * pairs[1::2]
                for s in range(0, max(1, len(x)), block):
                    y = x[s : s + block]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s], pa.int64()), pa.array([y.real], kind), pa.array([y.imag], kind)], names=["path", "n0", "re", "im"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "path string, n0 long, re array<double>, im array<double>")
    return found.select(F.xxhash64("path").alias("capture_id"), F.lit(0).alias("port"), "n0", "re", "im", "path")
