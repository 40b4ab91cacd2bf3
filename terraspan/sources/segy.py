"""SEG-Y: a head of 3600 bytes, then traces of one size, each a header of 240 bytes and samples.

Since traces have one size, a task finds those that begin in its range of bytes without reading what is before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from terraspan.sources.splits import SPLIT, Part, Pushed, Ranged, opened, read_ranges

#: Sample formats by their codes in a SEG-Y header.
SAMPLES = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 6: ">f8", 8: ">i1", 10: ">u4", 11: ">u2", 16: ">u1"}
HEAD, TRACE = 3600, 240
#: Bytes of traces that are decoded at a time.
STEP = 8 << 20


def ibm_floats(raw: np.ndarray) -> np.ndarray:
    """Big-endian words of the base-16 format as doubles."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    return sign * (raw & 0xFFFFFF) / float(1 << 24) * 16.0 ** ((raw >> 24 & 0x7F).astype(float) - 64)


class _Traces:
    """Reads the traces of a part of a file."""

    early = ("n", "iline", "xline", "x", "y", "traceid", "z0", "dz")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, path, _ = opened(part.path)
        with store.open_input_file(path) as f:
            head = f.read_at(HEAD, 0)
            dt, ns, code = (struct.unpack(">h", head[3200 + k : 3202 + k])[0] for k in (16, 20, 24))
            if code not in SAMPLES:
                raise ValueError(f"{part.path}: samples of code {code} can't be read")
            ns &= 0xFFFF
            size = TRACE + np.dtype(SAMPLES[code]).itemsize * ns
            low, high = part.share((part.size - HEAD) // size)
            step = max(1, STEP // size)
            for at in range(low, high, step):
                n = min(step, high - at)
                yield from self.batches(part.path, at, np.frombuffer(f.read_at(n * size, HEAD + at * size), np.uint8).reshape(n, size), code, dt / 1000.0)

    def batches(self, file: str, first: int, traces: np.ndarray, code: int, dz: float) -> Iterator[pa.RecordBatch]:
        def word(at: int, kind: str = ">i4") -> np.ndarray:
            return np.ascontiguousarray(traces[:, at - 1 : at - 1 + np.dtype(kind).itemsize]).view(kind).ravel()

        def place(at: int) -> np.ndarray:
            scale = word(71, ">i2").astype(float)
            return word(at) * np.where(scale < 0, -1 / np.where(scale == 0, 1, scale), np.where(scale == 0, 1, scale))

        make = {
            "n": lambda: np.arange(first, first + len(traces), dtype=np.int64), "iline": lambda: word(int(self.options.get("iline", 189))).astype(np.int32), "xline": lambda: word(int(self.options.get("xline", 193))).astype(np.int32),
            "x": lambda: place(181), "y": lambda: place(185), "traceid": lambda: word(29, ">i2").astype(np.int32), "z0": lambda: word(109, ">i2").astype(float), "dz": lambda: np.full(len(traces), dz),
        }
        needed = {*self.columns, *(f.attribute[0] for f in self.filters)} & set(make)
        early = {c: make[c]() for c in needed}
        keep = self.kept(early, len(traces))
        if not keep.any():
            return
        columns = []
        for c in self.columns:
            if c == "file":
                columns.append(pa.array([file] * int(keep.sum())))
            elif c == "amp":
                body = np.ascontiguousarray(traces[keep, TRACE:]).view(SAMPLES[code])
                amp = (ibm_floats(body.astype(np.int64)) if code == 1 else body).astype(np.float32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(amp) + 1, dtype=np.int32) * amp.shape[1]), pa.array(amp.ravel())))
            else:
                columns.append(pa.array(early[c][keep]))
        yield pa.RecordBatch.from_arrays(columns, names=list(self.columns))


class SegyRanges(_Traces, Ranged):
    pass


class SegyPushed(_Traces, Pushed):
    pass


class SegySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy_ranges"

    def schema(self) -> str:
        return "file string, n long, iline int, xline int, x double, y double, traceid int, z0 double, dz double, amp array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (SegyPushed if self.options.get("pushed") == "true" else SegyRanges)(self.options, schema)


def read_segy(spark: SparkSession, path: str, iline: int = 189, xline: int = 193, columns: Sequence[str] | None = None, split: int = SPLIT) -> DataFrame:
    """(file, n, iline, xline, x, y, traceid, z0, dz, amp) of SEG-Y files, a row a trace, or some of these columns. n counts a file's traces from 0.

    path is a file, a folder or a pattern; iline and xline are byte places in trace headers. A file of any size is read by as
    many tasks as it has ranges of `split` bytes, each some MB at a time. Samples that aren't asked for are not decoded;
    comparisons of the header's columns with values are applied before samples are decoded, where the session has
    spark.sql.python.filterPushdown.enabled. Samples of SAMPLES' codes are read; any other code is an error.
    """
    return read_ranges(spark, SegySource, path, columns, split, iline=iline, xline=xline)


def segy_bytes(traces: pd.DataFrame, dz: float, z0: float = 0.0) -> bytes:
    """A SEG-Y file (IEEE floats) of traces(iline, xline, x, y, traceid, amp) in the order given."""
    ns = len(traces["amp"].iloc[0])
    head = bytearray(400)
    for at, v in ((16, round(dz * 1000)), (20, ns), (24, 5), (300, 0x0100), (302, 1)):
        head[at : at + 2] = struct.pack(">h", v)
    out = [b" " * 3200, bytes(head)]
    for k, r in enumerate(traces.itertuples()):
        t = bytearray(240)
        for at, kind, v in ((1, ">i", k + 1), (29, ">h", r.traceid), (71, ">h", -100), (109, ">h", round(z0)), (115, ">h", ns), (117, ">h", round(dz * 1000)), (181, ">i", round(r.x * 100)), (185, ">i", round(r.y * 100)), (189, ">i", r.iline), (193, ">i", r.xline)):
            t[at - 1 : at - 1 + struct.calcsize(kind)] = struct.pack(kind, v)
        out += [bytes(t), np.asarray(r.amp, ">f4").tobytes()]
    return b"".join(out)


def segy_files(traces: DataFrame, dz: float, z0: float = 0.0, by: str = "iline") -> DataFrame:
    """(name, content): a SEG-Y file for each line of traces(iline, xline, x, y, traceid, amp), its traces in order. A line is put together by one task."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{by}_{key[0]}.sgy"], "content": [segy_bytes(pdf.sort_values(["iline", "xline"]), dz, z0)]})

    own = traces.select("iline", "xline", "x", "y", "traceid", "amp")
    return own.groupBy(F.col(by).alias("__by")).applyInPandas(write, "name string, content binary")
