"""Readers and writers of the object tables in the usual exchange formats.

Tables (CSV, Parquet) are Spark's own. Text formats are read as lines, or as whole small files where one file is one
object, and parsed by SQL functions. Many files are read at once: paths may be globs, and each row says its file.
Undefined values of a format (999.0, -999, 1e30, 9999900) are null in tables, and only there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the formats: end of a polyline, undefined in wells, in Irap text files, in Irap binary and ZMAP files.
END_OF_LINE, UNDEF_WELL, UNDEF_IRAP_TEXT, UNDEF_MAP = 999.0, -999.0, 9999900.0, 1e30


# --- points and polygons --------------------------------------------------------------------------------------------


def by_position(df: DataFrame, polygons: bool = False) -> DataFrame:
    """The first columns are x, y, z (and poly_id), whatever their names; a first column without a name is left out, further ones are attributes. Polygons of three columns have poly_id 0."""
    columns = [c for k, c in enumerate(df.columns) if not (k == 0 and (c.startswith("Unnamed") or c in ("", "_c0")))]
    fixed = ["x", "y", "z", *(["poly_id"] if polygons and len(columns) > 3 else [])]
    out = df.select(*(F.col(f"`{c}`").cast("int" if n == "poly_id" else "double").alias(n) for c, n in zip(columns, fixed, strict=False)), *(F.col(f"`{c}`") for c in columns[len(fixed) :]))
    return out.withColumn("poly_id", F.lit(0)) if polygons and "poly_id" not in fixed else out


def read_points(spark: SparkSession, path: str, file_format: str = "csv", polygons: bool = False) -> DataFrame:
    """csv, parquet, xyz, zmap or rms_attr. Polygons of text formats have seq, the order in their file."""
    if file_format == "csv":
        return by_position(spark.read.option("comment", "#").csv(path, header=True, inferSchema=True), polygons)
    if file_format == "parquet":
        return by_position(spark.read.parquet(path), polygons)
    lines = numbered_lines(spark, path)
    if file_format == "xyz":
        return read_xyz(lines, polygons)
    if file_format == "zmap":
        body = lines.where(~F.col("value").rlike("^[!@]") & F.col("value").rlike(r"^\s*[-+0-9.]+\s+[-+0-9.]")).withColumn("w", F.split(F.trim("value"), r"\s+"))
        z = F.get("w", F.lit(2)).cast("double")
        return body.select(F.col("n").alias("seq"), F.get("w", F.lit(0)).cast("double").alias("x"), F.get("w", F.lit(1)).cast("double").alias("y"), F.when(z < UNDEF_MAP, z).alias("z"), F.get("w", F.lit(3)).cast("int").alias("poly_id"))
    if file_format == "rms_attr":
        return read_rms_attr(lines)
    raise ValueError(f"unknown format {file_format}")


def points_from_list(spark: SparkSession, rows: Sequence[Sequence[float]], attributes: Sequence[str] = ()) -> DataFrame:
    """(x, y, z, attributes) of a short list."""
    return spark.createDataFrame([tuple(r) for r in rows], "x double, y double, z double" + "".join(f", `{a}` double" for a in attributes))


def random_points(spark: SparkSession, n: int, seed: int = 0, size: float = 1.0) -> DataFrame:
    """(pid, x, y, z): n points, uniform from 0 to size in each direction."""
    return spark.range(n).select(F.col("id").alias("pid"), *((F.rand(seed + k) * size).alias(c) for k, c in enumerate("xyz")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): the lines of text files with their number. A file's lines are put in order together, so a file should fit a task's memory."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("__all"))
    return whole.select("file", F.posexplode(F.split("__all", "\r?\n")).alias("n", "value")).where("value <> ''")


def read_xyz(lines: DataFrame, polygons: bool) -> DataFrame:
    """Rows of x y z; with polygons, a row of three 999.0 ends a polyline."""
    own = lines.withColumn("w", F.split(F.trim("value"), r"[\s,]+")).select("file", "n", *(F.get("w", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))
    end = (F.col("x") == END_OF_LINE) & (F.col("y") == END_OF_LINE) & (F.col("z") == END_OF_LINE)
    if not polygons:
        return own.where(~end & F.col("z").isNotNull()).select("x", "y", "z")
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = own.withColumn("poly_id", F.sum(end.cast("int")).over(w).cast("int")).where(~end)
    return numbered.select("file", "poly_id", (F.row_number().over(Window.partitionBy("file", "poly_id").orderBy("n")) - 1).alias("seq"), "x", "y", "z")


def read_rms_attr(lines: DataFrame) -> DataFrame:
    """Lines "type name" describe attributes, then come rows of x y z and the attributes' values. Attributes are a map from name to text."""
    own = lines.withColumn("head", F.regexp_extract("value", r"^(Discrete|String|Float|Int|Integer)\s+(\S.*)$", 2))
    names = own.where("head <> ''").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("head").alias("name")))), lambda s: s["name"]).alias("names"))
    body = own.where("head = ''").withColumn("w", F.split(F.trim("value"), r"\s+")).join(names, "file", "left")
    values = F.transform(F.slice("w", 4, F.size("w")), lambda v: F.when(~v.isin("UNDEF", "-999", "999.0"), v))
    return body.select("file", "n", *(F.get("w", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")), F.map_from_arrays(F.coalesce("names", F.array().cast("array<string>")), F.slice(values, 1, F.coalesce(F.size("names"), F.lit(0)))).alias("attributes"))


def write_points(points: DataFrame, path: str, file_format: str = "csv", attributes: Sequence[str] = (), where: dict[str, Sequence] | None = None, undefined: float | None = END_OF_LINE) -> None:
    """csv (null as `undefined`), parquet (null as null), xyz (text). where: allowed values by column."""
    for c, allowed in (where or {}).items():
        points = points.where(F.col(c).isin(list(allowed)))
    own = points.select(*(c for c in ("x", "y", "z", "poly_id") if c in points.columns), *attributes)
    if file_format == "parquet":
        own.write.parquet(path)
    elif file_format == "csv":
        (own.fillna(undefined) if undefined is not None else own).write.csv(path, header=True)
    elif file_format == "xyz":
        xyz_lines(points).write.text(path)
    else:
        raise ValueError(f"unknown format {file_format}")


def number(c: str, digits: int = 6) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c)))


def xyz_lines(points: DataFrame) -> DataFrame:
    """Lines of x y z; polylines in order, each ended by a row of 999.0."""
    row = F.concat_ws(" ", number("x"), number("y"), number("z"))
    if "poly_id" not in points.columns:
        return points.select(row.alias("value"))
    end = F.concat_ws(" ", *(F.lit(f"{END_OF_LINE:.6f}"),) * 3)
    ends = points.groupBy("poly_id").agg((F.max("seq") + 1).alias("seq")).select("poly_id", "seq", end.alias("value"))
    every = points.select("poly_id", "seq", row.alias("value")).unionByName(ends)
    return every.repartitionByRange("poly_id").sortWithinPartitions("poly_id", "seq").select("value")


def wellpick_lines(picks: DataFrame, horizon: str, well: str, md: str | None = None) -> DataFrame:
    """Lines of horizon, well and md, or x y z where there is no md."""
    place = number(md) if md else F.concat_ws(" ", number("x"), number("y"), number("z"))
    return picks.select(F.concat_ws(" ", F.concat(F.lit('"'), F.col(horizon), F.lit('"')), F.concat(F.lit('"'), F.col(well), F.lit('"')), place).alias("value"))


# --- wells ----------------------------------------------------------------------------------------------------------


def read_wells_csv(spark: SparkSession, path: str, well: str = "WELLNAME", x: str = "X_UTME", y: str = "Y_UTMN", z: str = "Z_TVDSS", logs: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Any number of wells in CSV tables, with or without indices of cells. seq follows the column `order`, or the order of rows in a file."""
    raw = spark.read.csv(path, header=True, inferSchema=True).withColumn("__row", F.monotonically_increasing_id())
    keep = [c for c in raw.columns if c not in (well, x, y, z, "__row") and (logs is None or c in logs)]
    seq = F.row_number().over(Window.partitionBy("well").orderBy("__row"))
    raw = raw.withColumn("__row", F.col(order)) if order else raw
    keep = [c for c in keep if c != order]
    own = raw.select(F.col(well).cast("string").alias("well"), *(F.col(a).cast("double").alias(b) for a, b in ((x, "x"), (y, "y"), (z, "z"))), *(F.col(f"`{c}`") for c in keep), "__row")
    return own.withColumn("seq", seq).drop("__row").select("well", "seq", "x", "y", "z", *keep)


def write_wells_csv(samples: DataFrame, path: str) -> None:
    logs = [c for c in samples.columns if c not in ("well", "seq", "x", "y", "z")]
    samples.select(F.col("well").alias("WELLNAME"), F.col("x").alias("X_UTME"), F.col("y").alias("Y_UTMN"), F.col("z").alias("Z_TVDSS"), "seq", *logs).write.csv(path, header=True)


def read_wells_rms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RMS text files, a well each: headers(well, x, y, rkb), log_types(well, log, n, type, codes), samples(well, seq, x, y, z, logs).

    logs is an array in the order of n, null for -999; log(samples, types, name) makes a column of one.
    """
    lines = numbered_lines(spark, path)
    w = Window.partitionBy("file").orderBy("n")
    own = lines.withColumns({"line": F.row_number().over(w), "w": F.split(F.trim("value"), r"\s+")})
    k = F.size("w")
    numeric = lambda c: c.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$")
    rkb = (k >= 4) & numeric(F.element_at("w", -3))
    at = lambda n: F.element_at("w", n).cast("double")
    head = own.where("line = 3").select("file", F.array_join(F.slice("w", 1, F.when(rkb, k - 3).otherwise(k - 2)), " ").alias("well"), F.when(rkb, at(-3)).otherwise(at(-2)).alias("x"), F.when(rkb, at(-2)).otherwise(at(-1)).alias("y"), F.when(rkb, at(-1)).otherwise(0.0).alias("rkb"))
    count = own.where("line = 4").select("file", F.get("w", F.lit(0)).cast("int").alias("nlogs"))
    rest = own.where("line > 4").join(count, "file").join(head.select("file", "well"), "file")
    # codes come in pairs: number, name
    pairs = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), k - 2)), lambda p: (p % 2 == 0) & (p + 1 < k)), lambda p: F.struct(F.get("w", p).cast("int").alias("code"), F.get("w", p + 1).alias("name")))
    kind = F.when(F.upper(F.get("w", F.lit(1))) == "DISC", "DISC").otherwise("CONT")
    types = rest.where(F.col("line") <= F.col("nlogs") + 4).select("well", F.get("w", F.lit(0)).alias("log"), (F.col("line") - 5).alias("n"), kind.alias("type"), F.when(kind == "DISC", pairs).alias("codes"))
    values = F.transform(F.slice("w", 4, F.greatest(k - 3, F.lit(1))), lambda v: F.when(v.cast("double") != UNDEF_WELL, v.cast("double")))
    samples = rest.where(F.col("line") > F.col("nlogs") + 4).select("well", (F.col("line") - F.col("nlogs") - 4).alias("seq"), *(F.get("w", F.lit(n)).cast("double").alias(c) for n, c in enumerate("xyz")), values.alias("logs"))
    return head.drop("file"), types, samples


def log(samples: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """Adds a log of read_wells_rms() as a column; null in wells that lack it."""
    place = types.where(F.col("log") == name).select("well", F.col("n").alias("__n"))
    return samples.join(place, "well", "left").withColumn(name, F.when(F.col("__n").isNotNull(), F.get("logs", F.coalesce("__n", F.lit(0))))).drop("__n")


def wells_rms_lines(samples: DataFrame, headers: DataFrame, types: dict[str, dict[int, str] | None]) -> DataFrame:
    """(well, n, value): the lines of a file for each well. types: of each log, its codes, or None for a continuous one."""
    logs = [f"{name} DISC " + " ".join(f"{c} {n}" for c, n in codes.items()) if codes else f"{name} UNK lin" for name, codes in types.items()]
    top = F.array(F.lit("1.0"), F.lit("Unknown"), F.concat_ws(" ", "well", number("x", 4), number("y", 4), number("rkb", 4)), F.lit(str(len(logs))), *map(F.lit, logs))
    head = headers.select("well", F.posexplode(top).alias("n", "value"))
    value = lambda c, codes: F.coalesce(F.col(c).cast("int").cast("string") if codes else number(c, 4), F.lit("-999"))
    body = samples.select("well", (F.col("seq") + 4 + len(logs)).alias("n"), F.concat_ws(" ", number("x", 4), number("y", 4), number("z", 4), *(value(c, codes) for c, codes in types.items())).alias("value"))
    return head.unionByName(body)


def blocked(samples: DataFrame, types: DataFrame | None = None, names: Sequence[str] = ("I_INDEX", "J_INDEX", "K_INDEX"), from_zero: bool = False) -> DataFrame:
    """Wells whose samples are cells of a grid: the cells' indices, logs by the usual names, become i, j and k, from 1.

    samples: of read_wells_csv(), or of read_wells_rms() with its log types. Samples without an index are left out.
    """
    own = samples
    if types is not None:
        for name in names:
            own = log(own, types, name)
    missing = [n for n in names if n not in own.columns]
    if missing:
        raise ValueError(f"no blocked wells: {missing} are missing")
    index = {a: F.rint(F.col(n).cast("double")).cast("int") + int(from_zero) for a, n in zip("ijk", names, strict=True)}
    return own.withColumns(index).where("i is not null and j is not null and k is not null").drop(*names)


# --- triangulated surfaces and cell properties ----------------------------------------------------------------------


def read_tsurf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(file, vid, x, y, z), triangles(file, tid, v0, v1, v2) of TSurf text files; ids count from 0 in each file."""
    lines = numbered_lines(spark, path).withColumn("w", F.split(F.trim("value"), r"\s+"))
    at = lambda k, t: F.get("w", F.lit(k)).cast(t)
    vertices = lines.where(F.get("w", F.lit(0)).isin("VRTX", "PVRTX")).select("file", (at(1, "long") - 1).alias("vid"), at(2, "double").alias("x"), at(3, "double").alias("y"), at(4, "double").alias("z"))
    tid = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    triangles = lines.where(F.get("w", F.lit(0)) == "TRGL").select("file", tid.alias("tid"), *((at(k + 1, "long") - 1).alias(f"v{k}") for k in range(3)))
    return vertices, triangles


def tsurf_lines(vertices: DataFrame, triangles: DataFrame, name: str) -> DataFrame:
    """(part, n, value): the lines of a TSurf file, in order of part and n."""
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, k, v) for k, v in enumerate(("GOCAD TSurf 1", "HEADER {", f"name:{name}", "}", "TFACE"))] + [(3, 0, "END")], "part int, n long, value string")
    rows = vertices.select(F.lit(1).alias("part"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("VRTX"), (F.col("vid") + 1).cast("string"), number("x"), number("y"), number("z"), F.lit("CNXYZ")).alias("value"))
    faces = triangles.select(F.lit(2).alias("part"), F.col("tid").cast("long").alias("n"), F.concat_ws(" ", F.lit("TRGL"), *((F.col(f"v{k}") + 1).cast("string") for k in range(3))).alias("value"))
    return head.unionByName(rows).unionByName(faces)


def read_grdecl(spark: SparkSession, path: str, keywords: Sequence[str]) -> DataFrame:
    """(file, keyword, pos, value): the values of keywords in GRDECL text files, pos from 0; N*value stands for N values.

    Comments (--) are left out. Repeats are exploded by Spark, so a long run costs nothing while it is read.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"--[^\n]*", "").alias("text"))
    sections = whole.select("file", F.explode(F.split("text", r"(?m)^\s*/\s*$|\s/\s*(?=\n|$)")).alias("s")).withColumn("w", F.filter(F.split(F.trim("s"), r"\s+"), lambda v: v != ""))
    start = F.array_position(F.transform("w", lambda v: v.isin(list(keywords))), True)
    own = sections.withColumn("__at", start).where("__at > 0").select("file", F.element_at("w", F.col("__at").cast("int")).alias("keyword"), F.posexplode(F.slice("w", F.col("__at").cast("int") + 1, F.size("w"))).alias("k", "token"))
    times = F.coalesce(F.regexp_extract("token", r"^(\d+)\*", 1).try_cast("int"), F.lit(1))
    runs = own.withColumns({"times": times, "value": F.regexp_replace("token", r"^\d+\*", "").cast("double")})
    before = F.coalesce(F.sum("times").over(Window.partitionBy("file", "keyword").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("__b", before).select("file", "keyword", F.posexplode(F.array_repeat(F.col("value"), F.col("times"))).alias("r", "value"), "__b").select("file", "keyword", (F.col("__b") + F.col("r")).cast("long").alias("pos"), "value")


def with_ijk(values: DataFrame, nx: int, ny: int) -> DataFrame:
    """Adds i, j, k from pos, where i runs fastest."""
    from terraspan.functions.geometry import cell_index

    i, j, k = cell_index(F.col("pos"), nx, ny)
    return values.withColumns({"i": i, "j": j, "k": k})


def guess_format(name: str, head: bytes = b"") -> str:
    """By the first bytes if they are a format's own, else by the suffix."""
    for mark, found in ((b"\x00\x00\x00 \xff\xff\xfc\x1c", "irap_binary"), (b"-996", "irap_ascii"), (b"GOCAD TSurf", "tsurf"), (b"roff-bin", "roff_binary"), (b"roff-asc", "roff_ascii"), (b"PAR1", "parquet"), (b"\x89HDF", "hdf"), (b"!", "zmap")):
        if head.startswith(mark):
            return found
    suffix = name.rsplit(".", 1)[-1].lower()
    return {"gri": "irap_binary", "bin": "irap_binary", "irapbin": "irap_binary", "fgr": "irap_ascii", "asc": "irap_ascii", "poi": "xyz", "pol": "xyz", "xyz": "xyz", "csv": "csv", "parquet": "parquet", "zmap": "zmap", "rmsattr": "rms_attr", "rmswell": "rms_ascii", "w": "rms_ascii", "ts": "tsurf", "grdecl": "grdecl", "sgy": "segy", "segy": "segy"}.get(suffix, "unknown")
