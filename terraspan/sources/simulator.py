"""Simulator grids and results: keyword arrays in text (GRDECL) or binary files, and the tables made of them.

A binary file's records are decoded where the file is read, to rows of (file, n, keyword, type, values). All that follows
(catalogues, dates, the scatter of values over active cells, corner geometry) is queries on those rows, so only the keywords
that are asked for go further.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraspan.operators.cells import ENDS, from_pillars

RECORDS = "file string, n int, keyword string, kind string, count int, numbers array<double>, texts array<string>"
#: The format's types, as big-endian numbers, and the items in a block of each.
KINDS = {"INTE": (">i4", 1000), "REAL": (">f4", 1000), "DOUB": (">f8", 1000), "LOGI": (">i4", 1000), "CHAR": ("S8", 105), "MESS": ("", 1000)}
#: Where INTEHEAD holds day, month and year.
DAY, MONTH, YEAR = 64, 65, 66


def _records(data: bytes, wanted: set[str] | None) -> Iterator[tuple]:
    at, n = 0, 0
    while at + 24 <= len(data):
        keyword, count, kind = data[at + 4 : at + 12].decode("latin-1").strip(), struct.unpack(">i", data[at + 12 : at + 16])[0], data[at + 16 : at + 20].decode("latin-1")
        at += 24
        width, block = (int(kind[1:]), 105) if kind[0] == "C" and kind[1:].isdigit() else (np.dtype(KINDS[kind][0]).itemsize if KINDS[kind][0] else 0, KINDS[kind][1])
        parts, left = [], count if width else 0
        keep = wanted is None or keyword in wanted
        while left > 0:
            size = struct.unpack(">i", data[at : at + 4])[0]
            if keep:
                parts.append(data[at + 4 : at + 4 + size])
            at, left = at + size + 8, left - size // width
        body = b"".join(parts)
        if kind[0] == "C":
            yield n, keyword, kind, count, None, [body[k : k + width].decode("latin-1").strip() for k in range(0, len(body), width)] if keep else None
        else:
            yield n, keyword, kind, count, np.frombuffer(body, KINDS[kind][0]).astype(float) if keep and width else None, None
        n += 1


def read_records(spark: SparkSession, path: str, keywords: Sequence[str] | None = None) -> DataFrame:
    """All records of binary files (EGRID, INIT, UNRST); of keywords that aren't wanted, the values are skipped and null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    wanted = None if keywords is None else set(keywords)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, c in zip(b["path"], b["content"], strict=True):
                for record in _records(c, wanted):
                    yield pd.DataFrame([(f, *record)], columns=["file", "n", "keyword", "kind", "count", "numbers", "texts"])

    return files.mapInPandas(decode, RECORDS)


def record_bytes(keyword: str, kind: str, values: Sequence) -> bytes:
    """A record as a file holds it."""
    wrap = lambda b: struct.pack(">i", len(b)) + b + struct.pack(">i", len(b))
    form, block = KINDS[kind]
    items = [str(v).ljust(8).encode() for v in values] if kind == "CHAR" else np.asarray(values, form or ">i4")
    out = [wrap(keyword.ljust(8).encode() + struct.pack(">i", len(values)) + kind.encode())]
    for k in range(0, len(values), block):
        own = items[k : k + block]
        out.append(wrap(b"".join(own) if kind == "CHAR" else own.tobytes()))
    return b"".join(out)


def catalog(records: DataFrame) -> DataFrame:
    """(file, n, keyword, kind, count, section, date): what is in files, with the date of a restart section; reads no values but the heads'."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = records.withColumn("section", F.sum((F.col("keyword") == "SEQNUM").cast("int")).over(w).cast("int"))
    part = lambda k: F.get("numbers", F.lit(k)).cast("int")
    dates = own.where("keyword = 'INTEHEAD'").groupBy("file", "section").agg(F.first(F.make_date(part(YEAR), part(MONTH), part(DAY))).alias("date"))
    return own.join(dates, ["file", "section"], "left").select("file", "n", "keyword", "kind", "count", "section", "date", "numbers")


def values(records: DataFrame, keywords: Sequence[str], dates: Sequence[str] | str | None = None) -> DataFrame:
    """(file, date, keyword, pos, value). dates: days as YYYY-MM-DD, or "first" or "last"; null for files without dates."""
    own = catalog(records).where(F.col("keyword").isin(list(keywords)))
    if dates in ("first", "last"):
        edge = Window.partitionBy("file")
        own = own.withColumn("__e", (F.min if dates == "first" else F.max)("date").over(edge)).where("date <=> __e").drop("__e")
    elif dates is not None:
        own = own.where(F.col("date").cast("string").isin(list(dates)))
    return own.select("file", "date", "keyword", F.posexplode("numbers").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def with_remainder(found: DataFrame, name: str = "SOIL", others: Sequence[str] = ("SWAT", "SGAS")) -> DataFrame:
    """Adds the keyword that files leave out: one less the others' sum, where there are any."""
    rest = found.where(F.col("keyword").isin(list(others))).groupBy("file", "date", "pos").agg((F.lit(1.0) - F.sum("value")).alias("value"))
    have = found.where(F.col("keyword") == name).select("file", "date").distinct()
    return found.unionByName(rest.join(have, ["file", "date"], "left_anti").withColumn("keyword", F.lit(name)).select(*found.columns))


def active_order(cells: DataFrame) -> DataFrame:
    """(i, j, k, pos): the place of each active cell in arrays that hold only those, i fastest. Layers are numbered apart, then shifted by the layers above."""
    on = cells.where("actnum = 1").select("i", "j", "k")
    within = on.withColumn("__n", F.row_number().over(Window.partitionBy("k").orderBy("j", "i")) - 1)
    layers = on.groupBy("k").agg(F.count(F.lit(1)).alias("__c")).withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a layer
    return within.join(F.broadcast(layers), "k").select("i", "j", "k", (F.col("__b") + F.col("__n")).cast("long").alias("pos"))


def scatter(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(file, date, keyword, i, j, k, value) of values that are held for active cells only."""
    return found.join(active_order(cells), "pos").select("file", "date", "keyword", "i", "j", "k", "value")


# --- dual porosity --------------------------------------------------------------------------------------------------

#: ACTNUM of cells that are active in the matrix, and in the fractures.
MEDIA = {"matrix": (1, 3), "fracture": (2, 3)}


def dual_order(cells: DataFrame) -> DataFrame:
    """(medium, i, j, k, pos) of cells with ACTNUM 0 to 3: places in arrays that hold active cells only, the matrix's before the fractures'."""
    matrix, fracture = (active_order(cells.withColumn("actnum", F.col("actnum").isin(*codes).cast("int"))).withColumn("medium", F.lit(m)) for m, codes in MEDIA.items())
    before = matrix.agg(F.count(F.lit(1)).alias("__n"))  # one row
    fracture = fracture.join(F.broadcast(before)).withColumn("pos", F.col("pos") + F.col("__n")).drop("__n")
    return matrix.unionByName(fracture).select("medium", "i", "j", "k", "pos")


def scatter_dual(found: DataFrame, cells: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """(file, date, keyword, medium, i, j, k, value) of values of dual-porosity runs; cells that a medium isn't active in are left out.

    A record has a value for every cell of both media, matrix first, or for those that are active in each; its length tells.
    """
    n = nx * ny * nz
    length = found.groupBy("file", "date", "keyword").agg((F.max("pos") + 1).alias("__length"))
    known = ["file", "keyword"]
    told = found.join(length.withColumnRenamed("date", "__date"), known).where(F.col("date").eqNullSafe(F.col("__date"))).drop("__date")
    cell = F.col("pos") % n
    whole = told.where(F.col("__length") == 2 * n).select("file", "date", "keyword", F.when(F.col("pos") < n, "matrix").otherwise("fracture").alias("medium"), (cell % nx + 1).cast("int").alias("i"), (F.floor(cell / nx) % ny + 1).cast("int").alias("j"), (F.floor(cell / (nx * ny)) + 1).cast("int").alias("k"), "value")
    order = dual_order(cells)
    whole = whole.join(order.select("medium", "i", "j", "k"), ["medium", "i", "j", "k"], "left_semi")
    some = told.where(F.col("__length") != 2 * n).join(order, "pos")
    columns = ["file", "date", "keyword", "medium", "i", "j", "k", "value"]
    return whole.select(*columns).unionByName(some.select(*columns))


def dual_arrays(values_: DataFrame, cells: DataFrame) -> DataFrame:
    """(keyword, pos, value): values(keyword, medium, i, j, k, value) as records of active cells hold them; the inverse of scatter_dual()."""
    return values_.join(dual_order(cells), ["medium", "i", "j", "k"]).select("keyword", "pos", "value")


# --- geometry -------------------------------------------------------------------------------------------------------


def corner_grid(arrays: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """cells with corners of arrays(keyword, pos, value): COORD, ZCORN and, if it is there, ACTNUM (else all are active)."""
    at = F.col("pos")
    pick = lambda c, n: F.max(F.when(F.col("__c") == n, F.col("value"))).alias(c)
    p = F.floor(at / 6)
    pillars = arrays.where("keyword = 'COORD'").withColumns({"__p": p, "__c": at - p * 6}).groupBy("__p").agg(*(pick(c, n) for n, c in enumerate(("x_top", "y_top", "z_top", "x_bot", "y_bot", "z_bot"))))
    pillars = pillars.withColumns({"i": (F.col("__p") % (nx + 1) + 1).cast("int"), "j": (F.floor(F.col("__p") / (nx + 1)) + 1).cast("int")}).drop("__p")
    row, layer = F.floor(at / (2 * nx)), F.floor(at / (4 * nx * ny))
    half = lambda c: F.floor(c / 2)
    ends = {(di, dj, dk): n for n, (di, dj, dk) in enumerate(ENDS)}
    code = F.create_map(*(F.lit(x) for (di, dj, dk), n in ends.items() for x in (di + 2 * dj + 4 * dk, n)))
    z = arrays.where("keyword = 'ZCORN'").select((half(at % (2 * nx)) + 1).cast("int").alias("i"), (half(row % (2 * ny)) + 1).cast("int").alias("j"), (half(layer) + 1).cast("int").alias("k"), code[(at % 2 + 2 * (row % 2) + 4 * (layer % 2)).cast("int")].alias("__c"), "value")
    depths = z.groupBy("i", "j", "k").agg(*(pick(f"z{n}", n) for n in range(8)))
    act = arrays.where("keyword = 'ACTNUM'").select((at % nx + 1).cast("int").alias("i"), (F.floor(at / nx) % ny + 1).cast("int").alias("j"), (F.floor(at / (nx * ny)) + 1).cast("int").alias("k"), F.col("value").cast("int").alias("actnum"))
    return from_pillars(depths.join(act, ["i", "j", "k"], "left").withColumn("actnum", F.coalesce("actnum", F.lit(1))), pillars)


def corner_arrays(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """(keyword, pos, value): COORD, ZCORN and ACTNUM of cells on straight pillars; the inverse of corner_grid()."""
    corner = F.explode(F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(dk).alias("dk"), *(F.col(f"c{n}{a}").alias(a) for a in "xyz")) for n, (di, dj, dk) in enumerate(ENDS))))
    own = cells.select("i", "j", "k", corner.alias("c"))
    pos = (((F.col("k") - 1) * 2 + F.col("c.dk")) * (2 * ny) + (F.col("j") - 1) * 2 + F.col("c.dj")).cast("long") * (2 * nx) + (F.col("i") - 1) * 2 + F.col("c.di")
    zcorn = own.select(F.lit("ZCORN").alias("keyword"), pos.alias("pos"), F.col("c.z").alias("value"))
    place = F.struct("c.x", "c.y", "c.z")
    pillar = own.groupBy((F.col("i") + F.col("c.di")).alias("i"), (F.col("j") + F.col("c.dj")).alias("j")).agg(F.min_by(place, F.struct("c.z", "c.x", "c.y")).alias("t"), F.max_by(place, F.struct("c.z", "c.x", "c.y")).alias("b"))
    first = ((F.col("j") - 1) * (nx + 1) + F.col("i") - 1).cast("long") * 6
    coord = pillar.select(F.lit("COORD").alias("keyword"), first.alias("__f"), F.posexplode(F.array(*(F.col(f"{e}.{a}") for e in "tb" for a in "xyz"))).alias("__n", "value")).select("keyword", (F.col("__f") + F.col("__n")).alias("pos"), "value")
    actnum = cells.select(F.lit("ACTNUM").alias("keyword"), (((F.col("k") - 1) * ny + F.col("j") - 1).cast("long") * nx + F.col("i") - 1).alias("pos"), F.col("actnum").cast("double").alias("value"))
    return coord.unionByName(zcorn).unionByName(actnum)


def grdecl_lines(arrays: DataFrame, keyword: str, per_line: int = 6, digits: int | None = 4) -> DataFrame:
    """(n, value): the lines of a keyword in GRDECL text, from its keyword to its slash; digits: None writes whole numbers."""
    shown: Column = F.col("value").cast("long").cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col("value"))
    own = arrays.where(F.col("keyword") == keyword).withColumns({"n": F.floor(F.col("pos") / per_line) + 1, "__s": shown})
    rows = own.groupBy("n").agg(F.concat(F.lit(" "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__s"))), lambda s: s["__s"]), " ")).alias("value"))
    ends = arrays.sparkSession.createDataFrame([(0, keyword), (1 << 60, "/")], "n long, value string")
    return rows.unionByName(ends)


#: Values of a record that are put together at a time: whole blocks.
TOGETHER = 100_000


def record_parts(arrays: DataFrame, kinds: dict[str, tuple[str, int]], first: int = 1) -> DataFrame:
    """(seq, content): the records of arrays(keyword, pos, value) as a file holds them, in pieces to be written by seq.

    kinds: type and number of values of each keyword, in the file's order. Values that arrays lack are zero.
    """
    names = list(kinds)
    wrap = lambda b: struct.pack(">i", len(b)) + b + struct.pack(">i", len(b))
    heads = [((first + n) << 40, wrap(k.ljust(8).encode() + struct.pack(">i", count) + kind.encode())) for n, (k, (kind, count)) in enumerate(kinds.items())]
    wanted = arrays.sparkSession.createDataFrame([(k, n, c) for n, (k, (_, count)) in enumerate(kinds.items()) for c in range(-(-count // TOGETHER))], "keyword string, n int, chunk long")
    values_ = arrays.where(F.col("keyword").isin(names)).withColumn("chunk", F.floor(F.col("pos") / TOGETHER))

    def write(key: tuple, pieces: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n in pieces["n"]:
            kind, count = kinds[key[0]]
            form, block = KINDS[kind]
            own = np.zeros(min(TOGETHER, count - key[1] * TOGETHER))
            own[pdf["pos"].to_numpy() - key[1] * TOGETHER] = pdf["value"].to_numpy()
            own = own.astype(form)
            out.append(((first + int(n)) << 40 | key[1] + 1, b"".join(wrap(own[k : k + block].tobytes()) for k in range(0, len(own), block))))
        return pd.DataFrame(out, columns=["seq", "content"])

    made = wanted.groupBy("keyword", "chunk").cogroup(values_.groupBy("keyword", "chunk")).applyInPandas(write, "seq long, content binary")
    return arrays.sparkSession.createDataFrame(heads, "seq long, content binary").unionByName(made)


def egrid_parts(cells: DataFrame, nx: int, ny: int, nz: int, dual: bool = False, unit: str = "METRES") -> DataFrame:
    """(seq, content): an EGRID file of cells on straight pillars, to be written by seq (splits.save_parts()).

    Pillars and depths are worked out of the cells where these are, and put together some 100 000 values at a time; a file
    of any size passes through no one task as a whole. dual: ACTNUM is 0 to 3. All cells have to be there (see
    cells.rectangular()).
    """
    kinds = {"COORD": ("REAL", (nx + 1) * (ny + 1) * 6), "ZCORN": ("REAL", 8 * nx * ny * nz), "ACTNUM": ("INTE", nx * ny * nz)}
    head = record_bytes("FILEHEAD", "INTE", [3, 2007, 0, 0, 0, int(dual), 0, *(0,) * 93]) + record_bytes("GRIDUNIT", "CHAR", [unit, ""]) + record_bytes("GRIDHEAD", "INTE", [1, nx, ny, nz, *(0,) * 20, 1, 1, *(0,) * 74])
    spark = cells.sparkSession
    rim = spark.createDataFrame([(0, head), (1 << 60, record_bytes("ENDGRID", "INTE", []))], "seq long, content binary")
    return rim.unionByName(record_parts(corner_arrays(cells, nx, ny), kinds))
