"""Files that many tasks read by ranges of bytes, and files that tasks write and the driver only commits.

Stores are those that Arrow opens: local and shared folders, HDFS, S3 and the like. Spark plans a task a range, so a file's
size doesn't matter; a task opens its file, finds what begins in its range, and holds a chunk of it at a time.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range.
SPLIT = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path, the path in it, and what goes before paths of that store."""
    scheme, mark, _ = path.partition("://")
    if mark and scheme != "file":
        store, inside = fs.FileSystem.from_uri(path)
        return store, inside, path[: path.index(inside)] if inside in path else scheme + mark
    plain = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.LocalFileSystem(), plain, ""


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, of the folder's files, or of the files whose names fit a pattern; hidden ones are passed over."""
    store, inside, before = opened(path)
    name = inside.rsplit("/", 1)[-1]
    if any(x in name for x in "*?["):
        entries = [e for e in store.get_file_info(fs.FileSelector(inside.rpartition("/")[0] or "/")) if fnmatch.fnmatch(e.base_name, name)]
    else:
        [info] = store.get_file_info([inside])
        entries = store.get_file_info(fs.FileSelector(inside, recursive=True)) if info.type == fs.FileType.Directory else [info]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
    return sorted((before + e.path, e.size) for e in entries if e.type == fs.FileType.File and not e.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    """One of so many ranges of a file."""

    path: str
    size: int
    number: int
    of: int

    def __init__(self, path: str, size: int, number: int, of: int):
        super().__init__(number)
        self.path, self.size, self.number, self.of = path, size, number, of

    def share(self, n: int) -> tuple[int, int]:
        """This part's share of n things in a row: from, to."""
        return n * self.number // self.of, n * (self.number + 1) // self.of


def parts(path: str, split: int) -> list[Part]:
    """All files' ranges of about so many bytes."""
    return [Part(f, size, k, n) for f, size in listed(path) for n in [max(1, -(-size // split))] for k in range(n)]


#: Comparisons that a reader applies before it decodes.
COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class Ranged(DataSourceReader):
    """A reader of ranges. Columns that the schema doesn't ask for are not made; comparisons of `early` columns with
    values are applied before the rest of a row is decoded, where Spark pushes them down."""

    early: Sequence[str] = ()

    def __init__(self, options: dict, schema: StructType):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.options, self.columns, self.filters = options, schema.names, []

    def partitions(self) -> Sequence[InputPartition]:
        return parts(self.path, self.split)

    def kept(self, early: dict[str, np.ndarray], n: int) -> np.ndarray:
        keep = np.ones(n, bool)
        for f in self.filters:
            own = early[f.attribute[0]]
            keep &= np.isin(own, list(f.value)) if isinstance(f, In) else COMPARED[type(f)](own, f.value)
        return keep


class Pushed(Ranged):
    """A reader that Spark may give its filters to; it hands back those that it can't apply itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (*COMPARED, In)) and len(f.attribute) == 1 and f.attribute[0] in self.early:
                self.filters.append(f)
            else:
                yield f


def read_ranges(spark: SparkSession, source: type[DataSource], path: str, columns: Sequence[str] | None, split: int, **options) -> DataFrame:
    """The source's rows, with these columns or all. Filters are pushed where spark.sql.python.filterPushdown.enabled is on."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("split", split).option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for k, v in options.items():
        reader = reader.option(k, v)
    if columns is not None:
        every = StructType.fromDDL(source({}).schema())
        reader = reader.schema(StructType([every[c] for c in columns]))
    return reader.load(path)


# --- sink -----------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Tasks write each row's content to a file of a temporary folder; the commit gives all their names, or none."""

    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.together = options.get("together") == "true"  # rows of one name that follow each other are one file
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, temporary, _ = opened(self.temporary)
        store.create_dir(temporary, recursive=True)
        out, before, to = [], None, None
        for name, content in iterator:
            if to is None or not self.together or name != before:
                if to:
                    to.close()
                at = f"{temporary}/{uuid.uuid4().hex}"  # of its own for each attempt of a task
                to, before = store.open_output_stream(at), name
                out.append((at, str(name).replace("/", "_") + self.suffix))
            to.write(content if content is not None else b"")
        if to:
            to.close()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder, _ = opened(self.folder)
        store.create_dir(folder, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        for at, name in files:
            store.move(at, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, temporary, _ = opened(self.temporary)
        if store.get_file_info([temporary])[0].type == fs.FileType.Directory:
            store.delete_dir(temporary)


class FilesSink(DataSource):
    """Rows (name, content) as files of a folder that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "content_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options)


def save_files(files: DataFrame, folder: str, name: str = "name", suffix: str = "") -> int:
    """Write (name, content) rows as files of a folder; returns how many.

    Tasks write, so all executors have to reach the folder. Files get their names when all are there: a job that fails
    leaves none. Rows that share a name are an error; files of before stay, but for those of the same names.
    """
    spark, seen = files.sparkSession, Observation()
    spark.dataSource.register(FilesSink)
    own = files.select(F.col(name).cast("string").alias("name"), "content").observe(seen, F.count(F.lit(1)).alias("n"))
    own.write.format(FilesSink.name()).mode("append").option("suffix", suffix).save(folder)
    return int(seen.get["n"])


def save_parts(parts: DataFrame, folder: str, name: str = "name", seq: str = "seq", suffix: str = "") -> None:
    """Write files of (name, seq, content) rows: a file's pieces one after the other by seq, from one task that holds one piece at a time. Else as save_files()."""
    parts.sparkSession.dataSource.register(FilesSink)
    own = parts.select(F.col(name).cast("string").alias("name"), F.col(seq).alias("seq"), "content").repartition("name").sortWithinPartitions("name", "seq")
    own.select("name", "content").write.format(FilesSink.name()).mode("append").option("suffix", suffix).option("together", "true").save(folder)
