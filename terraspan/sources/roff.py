"""ROFF files: tagged arrays in binary or text; corner-point grids and their properties.

A file's tags are decoded where the file is read. Nodes count from the south-west and from the bottom layer up, cells here
from the top layer down. At a node up to eight cells meet, and each may have a depth of its own there.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from terraspan.operators.cells import CORNERS, ENDS, IJK
from terraspan.sources.splits import SPLIT, Part, Pushed, Ranged, opened, read_ranges

#: The format's types, and what is undefined in each.
KINDS = {"int": "i4", "float": "f4", "double": "f8", "bool": "u1", "byte": "u1"}
UNDEFINED = {"int": -999, "float": -999.0, "double": -999.0, "byte": 255, "bool": 255}
#: Places, in a node's eight depths (below, then above: sw, se, nw, ne), of the cell whose corner the node is; by our corners 0 to 7.
PLACES = (3, 2, 0, 1, 7, 6, 4, 5)
#: How many depths a node has, and which of them each of the eight places takes.
SPLITS = {1: (0,) * 8, 2: (0,) * 4 + (1,) * 4, 4: (0, 1, 2, 3) * 2, 8: tuple(range(8))}


def _binary(data: bytes) -> Iterator[tuple]:
    at, order = data.index(b"\0") + 1, "<"

    def word() -> str:
        nonlocal at
        end = data.index(b"\0", at)
        out, at = data[at:end].decode("latin-1"), end + 1
        return out

    def numbers(kind: str, n: int) -> np.ndarray:
        nonlocal at
        form = np.dtype(KINDS[kind]).newbyteorder(order)
        out = np.frombuffer(data, form, n, at)
        at += out.nbytes
        return out

    tag = ""
    while at < len(data):
        token = word()
        if token.startswith("#"):
            continue
        if token == "tag":
            tag = word()
        elif token == "endtag":
            if tag == "eof":
                return
        else:
            many = token == "array"
            kind, key = (word(), word()) if many else (token, word())
            n = int(numbers("int", 1)[0]) if many else 1
            value = [word() for _ in range(n)] if kind == "char" else numbers(kind, n)
            if key == "byteswaptest" and value[0] != 1:
                order = ">"
            yield tag, key, kind, value


def _text(data: bytes) -> Iterator[tuple]:
    tokens = iter(re.findall(r'"[^"]*"|[^\s"]+', re.sub(r"#[^#\n]*#", " ", data.decode("latin-1"))))
    next(tokens)
    tag = ""
    for token in tokens:
        if token == "tag":
            tag = next(tokens)
        elif token == "endtag":
            if tag == "eof":
                return
        else:
            many = token == "array"
            kind, key = (next(tokens), next(tokens)) if many else (token, next(tokens))
            own = [next(tokens) for _ in range(int(next(tokens)) if many else 1)]
            yield tag, key, kind, [x.strip('"') for x in own] if kind == "char" else np.array(own, float).astype(KINDS[kind])


def tags(data: bytes) -> Iterator[tuple]:
    """(tag, key, kind, values) in the order of the file."""
    head = data[:8]
    if head not in (b"roff-bin", b"roff-asc"):
        raise ValueError("not a ROFF file")
    return _binary(data) if head == b"roff-bin" else _text(data)


@dataclass
class Stored:
    """An array of a binary file that isn't read yet."""

    file: object
    at: int
    form: np.dtype
    size: int

    def __getitem__(self, part: slice) -> np.ndarray:
        low, high, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at((high - low) * self.form.itemsize, self.at + low * self.form.itemsize), self.form)


class Scan:
    """The tags of a binary file, with arrays of numbers left where they are: only their places are worked out."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.order = file, size, 0, "<"

    def word(self) -> str:
        out = b""
        while True:
            own = self.file.read_at(min(256, self.size - self.at), self.at)
            end = own.find(b"\0")
            out += own if end < 0 else own[:end]
            self.at += len(own) if end < 0 else end + 1
            if end >= 0 or not own:
                return out.decode("latin-1")

    def items(self) -> Iterator[tuple]:
        tag = self.word() and ""
        while self.at < self.size:
            token = self.word()
            if token == "tag":
                tag = self.word()
            elif token == "endtag":
                if tag == "eof":
                    return
            elif token and not token.startswith("#"):
                many = token == "array"
                kind, key = (self.word(), self.word()) if many else (token, self.word())
                n = int(self._numbers("int", 1)[:][0]) if many else 1
                value = [self.word() for _ in range(n)] if kind == "char" else self._numbers(kind, n)
                if key == "byteswaptest" and value[:][0] != 1:
                    self.order = ">"
                yield tag, key, kind, value

    def _numbers(self, kind: str, n: int) -> Stored:
        out = Stored(self.file, self.at, np.dtype(KINDS[kind]).newbyteorder(self.order), n)
        self.at += n * out.form.itemsize
        return out


def _items(file, size: int) -> tuple[bool, list[tuple]]:
    """Is the file one that can be read in parts; (tag, key, kind, values), values of a binary file being Stored."""
    head = file.read_at(8, 0)
    return (True, list(Scan(file, size).items())) if head == b"roff-bin" else (False, list(tags(file.read_at(size, 0))))


class GridRanges(Ranged):
    """Cells of a part of a file's columns: those of a range of i, whose numbers lie together in all its arrays."""

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, path, _ = opened(part.path)
        with store.open_input_file(path) as f:
            ranged, items = _items(f, part.size)
            found = {(t, k): v for t, k, _, v in items}
            nx, ny, nz = (int(found["dimensions", k][:][0]) for k in ("nX", "nY", "nZ"))
            low, high = part.share(nx) if ranged else (0, nx if part.number == 0 else 0)
            if low < high:
                for frame in _cells(_of_columns(found, low, high, ny, nz), int(self.options.get("at_once", 16))):
                    frame = frame.assign(file=part.path, i=frame["i"] + low)
                    yield pa.RecordBatch.from_pandas(frame[list(self.columns)].astype({c: np.int32 for c in ("i", "j", "k", "subgrid", "actnum") if c in self.columns}), preserve_index=False)


def _of_columns(found: dict, low: int, high: int, ny: int, nz: int) -> dict:
    """The arrays of the columns from low to high, as a file of those columns alone would have them."""
    out = {key: v[:] for key, v in found.items() if key[1] != "data" and key[1] != "splitEnz"} | {("dimensions", "nX"): [high - low]}
    out["cornerLines", "data"] = found["cornerLines", "data"][low * (ny + 1) * 6 : (high + 1) * (ny + 1) * 6]
    plane, before = (ny + 1) * (nz + 1), low * (ny + 1) * (nz + 1)
    size = (high - low + 1) * plane
    if ("zvalues", "splitEnz") in found:
        split = found["zvalues", "splitEnz"]
        # depths of a node follow those of all nodes before it: count these, some MB at a time
        first = sum(int(np.asarray(split[k : min(k + (1 << 22), before)]).astype(np.int64).sum()) for k in range(0, before, 1 << 22))
        out["zvalues", "splitEnz"] = split[before : before + size]
        before, size = first, int(np.asarray(out["zvalues", "splitEnz"]).astype(np.int64).sum())
    out["zvalues", "data"] = found["zvalues", "data"][before : before + size]
    if ("active", "data") in found:
        out["active", "data"] = found["active", "data"][low * ny * nz : high * ny * nz]
    return out


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roff_grid_ranges"

    def schema(self) -> str:
        return "file string, i int, j int, k int, subgrid int, actnum int, " + ", ".join(f"{c} double" for c in CORNERS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridRanges(self.options, schema)


def read_roff_grid(spark: SparkSession, path: str, columns: int = 16, fields: Sequence[str] | None = None, split: int = SPLIT) -> DataFrame:
    """(file, i, j, k, subgrid, actnum, c0x .. c7z) of grid files, a row a cell, or some of these fields.

    A binary file is read by as many tasks as it has ranges of `split` bytes, each a range of i, `columns` of them at a
    time; a text file by one.
    """
    return read_ranges(spark, GridSource, path, fields, split, at_once=columns)


def _cells(found: dict, columns: int) -> Iterator[pd.DataFrame]:
    nx, ny, nz = (int(found["dimensions", k][0]) for k in ("nX", "nY", "nZ"))
    move = [(float(found.get(("translate", f"{a}offset"), [0])[0]), float(found.get(("scale", f"{a}scale"), [-1.0 if a == "z" else 1.0])[0])) for a in "xyz"]
    lines = found["cornerLines", "data"].astype(float).reshape(nx + 1, ny + 1, 2, 3)
    lines = (lines + [o for o, _ in move]) * [s for _, s in move]
    split = np.asarray(found.get(("zvalues", "splitEnz"), np.ones((nx + 1) * (ny + 1) * (nz + 1), np.uint8))).astype(np.int64)
    first = (np.cumsum(split) - split).reshape(nx + 1, ny + 1, nz + 1)
    table = np.full((9, 8), -1)
    for n, places in SPLITS.items():
        table[n] = places
    if not np.isin(split, list(SPLITS)).all():
        raise ValueError("a node has 1, 2, 4 or 8 depths")
    split, values = split.reshape(first.shape), found["zvalues", "data"].astype(float)
    active = np.asarray(found.get(("active", "data"), np.ones(nx * ny * nz, np.uint8))).reshape(nx, ny, nz)
    layers = np.asarray(found.get(("subgrids", "nLayers"), [nz])).astype(int)
    subgrid = np.repeat(np.arange(1, len(layers) + 1), layers)
    for low in range(0, nx, columns):
        i, j, c = np.meshgrid(np.arange(low, min(nx, low + columns)), np.arange(ny), np.arange(nz), indexing="ij")
        frame = {"i": (i + 1).ravel(), "j": (j + 1).ravel(), "k": (nz - c).ravel(), "subgrid": subgrid[nz - 1 - c].ravel(), "actnum": active[i, j, c].astype(int).ravel()}
        for n, (di, dj, below) in enumerate(ENDS):
            node = i + di, j + dj, c + 1 - below
            z = (values[first[node] + table[split[node], PLACES[n]]] + move[2][0]) * move[2][1]
            foot, head = lines[node[:2]][..., 0, :], lines[node[:2]][..., 1, :]
            height = head[..., 2] - foot[..., 2]
            t = np.where(height == 0, 1.0, (z - foot[..., 2]) / np.where(height == 0, 1.0, height))
            for a, at in (("x", 0), ("y", 1)):
                frame[f"c{n}{a}"] = (foot[..., at] + t * (head[..., at] - foot[..., at])).ravel()
            frame[f"c{n}z"] = z.ravel()
        yield pd.DataFrame(frame)


class _Properties:
    early = ("i", "j", "k")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, path, _ = opened(part.path)
        names = self.options.get("names")
        with store.open_input_file(path) as f:
            ranged, items = _items(f, part.size)
            for name, shape, kind, values, codes in _properties(items):
                if names is not None and name not in names.split("\n"):
                    continue
                plane = shape[1] * shape[2]
                low, high = part.share(shape[0]) if ranged else (0, shape[0] if part.number == 0 else 0)
                step = max(1, (1 << 20) // max(1, plane))
                for at in range(low, high, step):
                    to = min(at + step, high)
                    yield from self.batches(part.path, name, at, to, shape, kind, np.asarray(values[at * plane : to * plane]), codes)

    def batches(self, file: str, name: str, low: int, high: int, shape: tuple, kind: str, values: np.ndarray, codes: dict) -> Iterator[pa.RecordBatch]:
        i, j, c = (x.ravel() for x in np.meshgrid(np.arange(low, high), np.arange(shape[1]), np.arange(shape[2]), indexing="ij"))
        own = {"i": (i + 1).astype(np.int32), "j": (j + 1).astype(np.int32), "k": (shape[2] - c).astype(np.int32)}
        keep = self.kept(own, len(values))
        values, n = values[keep], int(keep.sum())
        known = values != UNDEFINED[kind]
        make = {a: (lambda a=a: pa.array(own[a][keep])) for a in own} | {
            "file": lambda: pa.array([file] * n, pa.string()), "name": lambda: pa.array([name] * n, pa.string()), "value": lambda: pa.array(values.astype(float), mask=~known),
            "code": lambda: pa.array([codes.get(int(v)) if ok else None for v, ok in zip(values, known, strict=True)] if codes else [None] * n, pa.string()),
        }
        if n:
            yield pa.RecordBatch.from_arrays([make[x]() for x in self.columns], names=list(self.columns))


class PropertyRanges(_Properties, Ranged):
    pass


class PropertyPushed(_Properties, Pushed):
    pass


class PropertySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roff_property_ranges"

    def schema(self) -> str:
        return "file string, name string, i int, j int, k int, value double, code string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PropertyPushed if self.options.get("pushed") == "true" else PropertyRanges)(self.options, schema)


def read_roff_property(spark: SparkSession, path: str, names: Sequence[str] | None = None, fields: Sequence[str] | None = None, split: int = SPLIT) -> DataFrame:
    """(file, name, i, j, k, value, code) of property files, or of the named ones; code: the name of a discrete value. Undefined values are null.

    A binary file is read by ranges, as by read_roff_grid(). Comparisons of i, j and k (a layer, a box) are applied before
    rows are made, where the session has spark.sql.python.filterPushdown.enabled.
    """
    return read_ranges(spark, PropertySource, path, fields, split, **({} if names is None else {"names": "\n".join(names)}))


def _properties(items: Sequence[tuple]) -> Iterator[tuple]:
    shape, own = None, {}
    for tag, key, kind, value in items:
        if tag == "dimensions":
            own[key] = int(value[:][0])
            shape = tuple(own.get(k, 0) for k in ("nX", "nY", "nZ"))
        elif tag == "parameter":
            if key == "name":
                own |= {"name": value[0], "codeNames": (), "codeValues": ()}
            elif key == "data":
                yield own["name"], shape, kind, value, dict(zip(map(int, own["codeValues"]), own["codeNames"], strict=True))
            else:
                own[key] = value[:]


def _item(kind: str, key: str, value, many: bool = False) -> bytes:
    head = f"{'array' + chr(0) if many else ''}{kind}\0{key}\0".encode()
    if kind == "char":
        return head + (struct.pack("<i", len(value)) + b"".join(v.encode() + b"\0" for v in value) if many else value.encode() + b"\0")
    own = np.asarray(value, "<" + KINDS[kind])
    return head + (struct.pack("<i", own.size) if many else b"") + own.tobytes()


def _file(filetype: str, parts: Sequence[tuple[str, list[bytes]]]) -> bytes:
    every = [("filedata", [_item("int", "byteswaptest", 1), _item("char", "filetype", filetype), _item("char", "creationDate", "unknown")]), *parts, ("eof", [])]
    return b"roff-bin\0#ROFF file#\0" + b"".join(f"tag\0{t}\0".encode() + b"".join(items) + b"endtag\0" for t, items in every)


def _dimensions(nx: int, ny: int, nz: int) -> tuple[str, list[bytes]]:
    return "dimensions", [_item("int", k, n) for k, n in (("nX", nx), ("nY", ny), ("nZ", nz))]


def roff_grid_bytes(cells: pd.DataFrame, layers: Sequence[int] | None = None) -> bytes:
    """A binary grid file of all cells of a grid; layers: how many each subgrid has, from the top. Each node keeps the depths of its eight cells."""
    nx, ny, nz = (int(cells[a].max()) for a in IJK)
    cells = cells.sort_values(IJK)
    corner = {c: cells[c].to_numpy().reshape(nx, ny, nz)[:, :, ::-1] for c in CORNERS}  # layers from the bottom
    depth = np.full((nx + 1, ny + 1, nz + 1, 8), np.nan)
    lines = np.full((nx + 1, ny + 1, 2, 3), np.nan)
    for n, (di, dj, below) in enumerate(ENDS):
        where = slice(di, nx + di), slice(dj, ny + dj)
        depth[(*where, slice(1 - below, nz + 1 - below), PLACES[n])] = corner[f"c{n}z"]
        end = 0 if below else nz - 1
        for a, x in enumerate("xyz"):
            lines[(*where, 1 - below, a)] = corner[f"c{n}{x}"][:, :, end]
    # at the rim, a place without a cell takes the depth of one that is there
    some = np.take_along_axis(depth, np.isfinite(depth).argmax(axis=-1)[..., None], -1)
    depth = np.where(np.isfinite(depth), depth, some)
    lines[..., 2] *= -1
    active = cells["actnum"].to_numpy().reshape(nx, ny, nz)[:, :, ::-1]
    parts = [_dimensions(nx, ny, nz), ("translate", [_item("float", f"{a}offset", 0.0) for a in "xyz"]), ("scale", [_item("float", f"{a}scale", v) for a, v in zip("xyz", (1, 1, -1), strict=True)])]
    if layers:
        parts.append(("subgrids", [_item("int", "nLayers", layers, True)]))
    parts += [("cornerLines", [_item("float", "data", lines.ravel(), True)]), ("zvalues", [_item("byte", "splitEnz", np.full((nx + 1) * (ny + 1) * (nz + 1), 8), True), _item("float", "data", -depth.ravel(), True)]), ("active", [_item("bool", "data", active.ravel(), True)])]
    return _file("grid", parts)


def roff_grid_files(cells: DataFrame, layers: Sequence[int] | None = None, name: str = "name") -> DataFrame:
    """(name, content): a grid file for each name of cells(name, i, j, k, actnum, c0x .. c7z). A grid is put together by one task."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({name: [key[0]], "content": [roff_grid_bytes(pdf, layers)]})

    return cells.select(F.col(name).cast("string").alias(name), *IJK, "actnum", *CORNERS).groupBy(name).applyInPandas(write, f"{name} string, content binary")


def roff_property_bytes(values: pd.DataFrame, name: str, column: str = "value", codes: dict[int, str] | None = None) -> bytes:
    """A binary property file of values(i, j, k, value), one for each cell; with codes it is discrete. Undefined ones are null."""
    nx, ny, nz = (int(values[a].max()) for a in IJK)
    own = values.sort_values(IJK)[column].astype(float).to_numpy().reshape(nx, ny, nz)[:, :, ::-1]
    kind = "float" if codes is None else "int"
    items = [_item("char", "name", name)]
    if codes is not None:
        items += [_item("char", "codeNames", list(codes.values()), True), _item("int", "codeValues", list(codes), True)]
    items.append(_item(kind, "data", np.where(np.isfinite(own), own, UNDEFINED[kind]).ravel(), True))
    return _file("parameter", [_dimensions(nx, ny, nz), ("parameter", items)])
