"""Files of one map or one set of traces, decoded where they are read: a file is a row of Spark's binaryFile source.

numpy turns a file's bytes into rows; nothing passes the driver. Writers make a table (name, content), a row a file, which
any sink takes; save_files() puts them in a folder, from the tasks that made them. SEG-Y is read in ranges of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.sources.segy import SAMPLES, ibm_floats, read_segy, segy_bytes, segy_files
from terraspan.sources.splits import save_files
from terraspan.sources.tables import UNDEF_IRAP_TEXT, UNDEF_MAP

__all__ = ["SAMPLES", "ibm_floats", "ijxyz_lines", "map_files", "read_ijxyz", "read_maps", "read_segy", "save_files", "segy_bytes", "segy_files"]

NODES = "file string, i int, j int, value double"
HEADERS = "file string, ncol int, nrow int, xori double, yori double, xinc double, yinc double, rotation double, yflip int"


def irap_binary_header(data: bytes) -> dict:
    """Two records of big-endian numbers, each between its lengths, then one of seven zeros."""
    _, _, nrow, xori, _, yori, _, xinc, yinc, _, _, ncol, rotation = struct.unpack(">3i6f3if", data[:52])
    return {"ncol": ncol, "nrow": nrow, "xori": xori, "yori": yori, "xinc": xinc, "yinc": abs(yinc), "rotation": rotation, "yflip": -1 if yinc < 0 else 1}


def irap_binary_values(data: bytes) -> np.ndarray:
    at, out = 100, []
    while at < len(data):
        n = struct.unpack(">i", data[at : at + 4])[0]
        out.append(np.frombuffer(data, ">f4", n // 4, at + 4))
        at += n + 8
    return np.concatenate(out).astype(float) if out else np.zeros(0)


def irap_text(data: bytes) -> tuple[dict, np.ndarray]:
    words = data.split()
    head = [float(x) for x in words[:12]]
    yinc = head[3]
    header = {"ncol": int(head[8]), "nrow": int(head[1]), "xori": head[10], "yori": head[11], "xinc": head[2], "yinc": abs(yinc), "rotation": head[9], "yflip": -1 if yinc < 0 else 1}
    return header, np.array(words[19:], float)


def zmap_text(data: bytes) -> tuple[dict, np.ndarray]:
    """Lines of comments (!), a head between @ signs, then columns from the west, each from the north down."""
    lines = [x for x in data.decode("latin-1").splitlines() if x.strip() and not x.startswith("!")]
    starts = [k for k, x in enumerate(lines) if x.startswith("@")]
    undef = float(lines[starts[0] + 1].split(",")[1])
    size = [x.strip() for x in lines[starts[0] + 2].split(",")]
    nrow, ncol, xmin, xmax, ymin, ymax = int(size[0]), int(size[1]), *map(float, size[2:6])
    values = np.array(" ".join(lines[starts[1] + 1 :]).split(), float)
    values[values == undef] = np.nan
    values = values.reshape(ncol, nrow)[:, ::-1].T.ravel()  # to rows from the south
    return {"ncol": ncol, "nrow": nrow, "xori": xmin, "yori": ymin, "xinc": (xmax - xmin) / (ncol - 1), "yinc": (ymax - ymin) / (nrow - 1), "rotation": 0.0, "yflip": 1}, values


def gxf_text(data: bytes) -> tuple[dict, np.ndarray]:
    """Keys in lines that begin with #, each with its value in the next line; the values follow #GRID, row by row. Double keys and comments are passed over."""
    keys, lines = {}, data.decode("latin-1").splitlines()
    for k, line in enumerate(lines):
        own = line.strip()
        if not own.startswith("#") or own.startswith("##"):
            continue
        key = own[1:].split()[0].upper() if own[1:].split() else ""
        if key == "GRID":
            values = np.array(" ".join(lines[k + 1 :]).split(), float)
            break
        keys[key] = next((x.strip() for x in lines[k + 1 :] if x.strip()), "")
    else:
        raise ValueError("a GXF file has to have #GRID")
    if float(keys.get("GTYPE", 0)) or float(keys.get("SENSE", 1)) != 1:
        raise ValueError("compressed grids, and grids of another sense than 1, can't be read")
    number = lambda key, default: float(keys.get(key, default))
    ncol, nrow, yinc = int(number("POINTS", 0)), int(number("ROWS", 0)), number("RWSEPARATION", 1)
    if ncol * nrow != len(values):
        raise ValueError(f"{len(values)} values for {ncol} by {nrow} nodes")
    if "DUMMY" in keys:
        values[values == number("DUMMY", 0)] = np.nan
    return {"ncol": ncol, "nrow": nrow, "xori": number("XORIGIN", 0), "yori": number("YORIGIN", 0), "xinc": number("PTSEPARATION", 1), "yinc": abs(yinc), "rotation": number("ROTATION", 0), "yflip": -1 if yinc < 0 else 1}, values


def _map(data: bytes, file_format: str) -> tuple[dict, np.ndarray]:
    if file_format == "irap_binary":
        return irap_binary_header(data), irap_binary_values(data)
    return {"irap_ascii": irap_text, "zmap": zmap_text, "gxf": gxf_text}[file_format](data)


def read_maps(spark: SparkSession, path: str, file_format: str = "irap_binary") -> tuple[DataFrame, DataFrame]:
    """(headers, nodes) of map files (irap_binary, irap_ascii, zmap, gxf); masked nodes are left out. Reading headers alone decodes no values in text formats' place: both are lazy."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"file": f} | (irap_binary_header(c) if file_format == "irap_binary" else _map(c, file_format)[0]) for f, c in zip(b["file"], b["content"], strict=True)])

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = UNDEF_IRAP_TEXT if file_format == "irap_ascii" else UNDEF_MAP * 0.99
        for b in batches:
            for f, c in zip(b["file"], b["content"], strict=True):
                header, values = _map(c, file_format)
                at = np.flatnonzero(np.isfinite(values) & (values < limit))
                yield pd.DataFrame({"file": f, "i": (at % header["ncol"] + 1).astype(np.int32), "j": (at // header["ncol"] + 1).astype(np.int32), "value": values[at]})

    return files.mapInPandas(headers, HEADERS), files.mapInPandas(nodes, NODES)


def map_files(nodes: DataFrame, header: MapHeader, file_format: str = "irap_binary", name: str = "name") -> DataFrame:
    """(name, content): a file for each map of nodes(name, i, j, value); maps share the header. A map is put together by one task."""
    h = header

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        undef = UNDEF_IRAP_TEXT if file_format == "irap_ascii" else UNDEF_MAP
        values = np.full((h.nrow, h.ncol), undef)
        own = pdf[pdf["value"].notna()]
        values[own["j"].to_numpy() - 1, own["i"].to_numpy() - 1] = own["value"].to_numpy()
        yinc = h.yinc * h.yflip
        if file_format == "irap_binary":
            data = struct.pack(">3i6f3i3f10i", 32, -996, h.nrow, h.xori, h.xori + h.xinc * (h.ncol - 1), h.yori, h.yori + yinc * (h.nrow - 1), h.xinc, yinc, 32, 16, h.ncol, h.rotation, h.xori, h.yori, 16, 28, *(0,) * 7, 28)
            size = struct.pack(">i", h.ncol * 4)
            data += b"".join(size + row.astype(">f4").tobytes() + size for row in values)
        elif file_format == "irap_ascii":
            head = f"-996 {h.nrow} {h.xinc} {yinc}\n{h.xori} {h.xori + (h.ncol - 1) * h.xinc} {h.yori} {h.yori + (h.nrow - 1) * yinc}\n{h.ncol} {h.rotation} {h.xori} {h.yori}\n0  0  0  0  0  0  0\n"
            flat = values.ravel()
            data = (head + "\n".join(" ".join(f"{v:f}" for v in flat[k : k + 6]) for k in range(0, len(flat), 6)) + "\n").encode()
        elif file_format == "zmap":
            if h.rotation or h.yflip != 1:
                raise ValueError("ZMAP has no rotation: resample to an unrotated map first")
            head = f"! Export\n@ MAP, GRID, 5\n20, {UNDEF_MAP:g},  , 6, 1\n{h.nrow}, {h.ncol}, {h.xori}, {h.xori + (h.ncol - 1) * h.xinc}, {h.yori}, {h.yori + (h.nrow - 1) * h.yinc}\n0.0, 0.0, 0.0\n@\n"
            flat = values.T[:, ::-1].ravel()
            data = (head + "\n".join(" ".join(f"{v:19.6f}" if v < UNDEF_MAP else f"{v:19.6g}" for v in flat[k : k + 5]) for k in range(0, len(flat), 5)) + "\n").encode()
        elif file_format == "gxf":
            keys = {"POINTS": h.ncol, "ROWS": h.nrow, "PTSEPARATION": h.xinc, "RWSEPARATION": yinc, "XORIGIN": h.xori, "YORIGIN": h.yori, "ROTATION": h.rotation, "DUMMY": f"{UNDEF_MAP:g}"}
            rows = "\n".join(" ".join(f"{v:.6f}" if v < UNDEF_MAP else f"{v:g}" for v in row) for row in values)
            data = ("".join(f"#{k}\n{v}\n" for k, v in keys.items()) + f"#GRID\n{rows}\n").encode()
        else:
            raise ValueError(f"unknown format {file_format}")
        return pd.DataFrame({name: [key[0]], "content": [data]})

    return nodes.select(F.col(name).cast("string").alias(name), "i", "j", "value").groupBy(name).applyInPandas(write, f"{name} string, content binary")


def read_ijxyz(spark: SparkSession, path: str) -> tuple[MapHeader, DataFrame, DataFrame]:
    """(header, nodes, lines) of one map as lines of inline, xline, x, y and value: the map's geometry comes from the places.

    nodes(i, j, value) count lines from 1; lines(i, j, iline, xline) keep their numbers. Lines that are skipped are masked
    nodes. x and y have to be linear in the line numbers, to a hundredth of the smaller increment.
    """
    words = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where(F.col("value").rlike(r"^\s*[-+0-9]")).select(*(F.get(words, F.lit(k)).cast("double").alias(c) for k, c in enumerate(("il", "xl", "x", "y", "value"))))
    steps, first, count = [], [], []
    for c in ("il", "xl"):
        own = np.sort([r[0] for r in raw.select(c).distinct().collect()])  # a line each
        step = int(np.gcd.reduce(np.diff(own).astype(int))) if len(own) > 1 else 1
        steps, first, count = [*steps, step], [*first, int(own[0])], [*count, int((own[-1] - own[0]) // step) + 1]
    nodes = raw.withColumns({a: F.rint((F.col(c) - f) / n).cast("int") + 1 for a, c, f, n in zip("ij", ("il", "xl"), first, steps, strict=True)})
    # least squares of x and y on (1, i, j), from sums that one row holds
    u = {"o": F.lit(1.0), "i": F.col("i") - 1.0, "j": F.col("j") - 1.0}
    sums = nodes.agg(*(F.sum(p * q).alias(f"{a}{b}") for a, p in u.items() for b, q in u.items()), *(F.sum(p * F.col(c)).alias(f"{a}_{c}") for a, p in u.items() for c in "xy")).first()
    left = np.array([[sums[a + b] for b in u] for a in u])
    (x0, xi, xj), (y0, yi, yj) = (np.linalg.lstsq(left, np.array([sums[f"{a}_{c}"] for a in u]), rcond=None)[0] for c in "xy")
    xinc, yinc = float(np.hypot(xi, yi)), float(np.hypot(xj, yj))
    header = MapHeader(count[0], count[1], float(x0), float(y0), xinc, yinc, float(np.degrees(np.arctan2(yi, xi)) % 360), 1 if xi * yj - yi * xj >= 0 else -1)
    off = nodes.agg(F.max(F.hypot(header.x(F.col("i"), F.col("j")) - F.col("x"), header.y(F.col("i"), F.col("j")) - F.col("y")))).first()[0]
    if off > 0.01 * min(xinc, yinc or xinc):
        raise ValueError(f"places are {off} off a regular map")
    return header, nodes.where("value is not null").select("i", "j", "value"), nodes.select("i", "j", F.col("il").cast("int").alias("iline"), F.col("xl").cast("int").alias("xline"))


def ijxyz_lines(nodes: DataFrame, header: MapHeader, lines: DataFrame | None = None) -> DataFrame:
    """(value): a line of inline, xline, x, y and value for each defined node; without lines(i, j, iline, xline) the node's i and j."""
    own = nodes.where(F.col("value").isNotNull())
    own = own.join(lines, ["i", "j"]) if lines is not None else own.withColumns({"iline": F.col("i"), "xline": F.col("j")})
    place = [F.format_string("%.6f", c) for c in (header.x(F.col("i"), F.col("j")), header.y(F.col("i"), F.col("j")), F.col("value"))]
    return own.orderBy("xline", "iline").select(F.concat_ws("\t", F.col("iline").cast("string"), F.col("xline").cast("string"), *place).alias("value"))
