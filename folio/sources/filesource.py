"""Data sources of files: `folio_files` scans files through a parser, `folio_packages` writes packages as whole files.

    spark.dataSource.register(FileScan)
    spark.read.format("folio_files").option("paths", json.dumps(paths)).load().where("page_no between 3 and 5")

Files are reached by pyarrow's file systems, so paths are local or of a store that these know (file, s3, gs, hdfs, abfs)."""

from __future__ import annotations

import importlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from folio.runtime import deal_unions_again

SCAN = "position int, path string, name string, pages int, error string, page_no int, ord int, text string, x double, y double, height double"
ENTRIES = "book_id string, ord long, path string, content binary, stored boolean"
COMMITTED = "_committed"
#: Bytes that are read from a file at once.
PIECE = 1 << 20


def reached(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    uri = re.sub("^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    files: list[tuple[int, str]]  # position and path


class FileScan(DataSource):
    """Rows of SCAN. Options: paths, a JSON list, in whose order files have their position; parser, `module:function` from
    bytes to pages of (text, x, y, height), with an attribute `stream` if it can do without the whole file; filesPerTask, 1 unless files are small.

    Each file is known by its whole path. It gives a row for each fragment of the pages asked for; a file without any there,
    and one that is missing or that the parser refuses, gives one row without a page. Conditions on page_no are pushed down:
    other pages aren't sent on."""

    @classmethod
    def name(cls) -> str:
        return "folio_files"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options.get("paths") or "[]")
        if not self.paths:
            raise ValueError("Add at least one file to convert.")
        self.parser = options.get("parser") or "folio.sources.files:text_pages"
        self.group = max(1, int(options.get("filespertask") or options.get("filesPerTask") or 1))
        self.first, self.last, self.pushed = 1, None, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("page_no",) or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            low = f.value + 1 if isinstance(f, GreaterThan) else f.value if isinstance(f, (GreaterThanOrEqual, EqualTo)) else None
            high = f.value - 1 if isinstance(f, LessThan) else f.value if isinstance(f, (LessThanOrEqual, EqualTo)) else None
            if low is None and high is None:
                yield f
                continue
            self.pushed = True
            self.first = max(self.first, low) if low is not None else self.first
            self.last = high if self.last is None else self.last if high is None else min(self.last, high)

    def partitions(self) -> list[InputPartition]:
        files = list(enumerate(self.paths))
        return [Files(files[i : i + self.group]) for i in range(0, len(files), self.group)]

    def read(self, partition: Files) -> Iterator[tuple]:
        module, function = self.parser.split(":")
        parse = getattr(importlib.import_module(module), function)
        for position, path in partition.files:
            name = path.rsplit("/", 1)[-1]
            try:
                fs, at = reached(path)

                def pieces(fs=fs, at=at) -> Iterator[bytes]:
                    with fs.open_input_stream(at) as f:
                        while piece := f.read(PIECE):
                            yield piece

                if stream := getattr(parse, "stream", None):
                    n, found = stream(pieces)
                else:
                    pages = [list(p) for p in parse(b"".join(pieces()))]
                    n, found = len(pages), ((i, k, x) for i, p in enumerate(pages, 1) for k, x in enumerate(p))
                error = None
            except FileNotFoundError:
                n, found, error = None, (), "file not found"
            except Exception as e:  # noqa: BLE001  whatever a parser raises is that file's error
                n, found, error = None, (), str(e) or type(e).__name__
            some = False
            for i, k, (text, x, y, height) in found:
                if self.last is not None and i > self.last:
                    break
                if i >= self.first:
                    some = True
                    yield (position, path, name, n, error, i, k, text, x, y, height)
            if not some and not self.pushed:
                yield (position, path, name, n, error, *[None] * 6)


def scan_files(spark: SparkSession, paths: list[str], parser: str = "folio.sources.files:text_pages", files_per_task: int = 1) -> DataFrame:
    """Rows of SCAN; see FileScan."""
    if not paths:
        raise ValueError("Add at least one file to convert.")
    spark.dataSource.register(FileScan)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folio_files").option("paths", json.dumps(paths)).option("parser", parser).option("filesPerTask", files_per_task).load()


# Packages as files


@dataclass
class Part(WriterCommitMessage):
    folder: str
    books: int


class PackageFiles(DataSource):
    """Writes rows of ENTRIES, a book's together and in order, as packages into the folder `path`. A task's packages are in
    a folder of its own, and only folders that the run's committed list names are part of the table, so what failed, lost or
    repeated tasks leave is never read. Overwriting makes the run the only one that is listed."""

    @classmethod
    def name(cls) -> str:
        return "folio_packages"

    def schema(self) -> str:
        return ENTRIES

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], schema, overwrite)


class PackageWriter(DataSourceWriter):
    def __init__(self, path: str, schema, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.at = {f.name: i for i, f in enumerate(schema.fields)}

    def write(self, iterator: Iterator) -> Part:
        folder, book, rows, books = f"{self.run}/{uuid.uuid4().hex}", None, [], 0
        fs, base = reached(self.path)

        def flush() -> int:
            if not rows:
                return 0
            sink = io.BytesIO()
            with zipfile.ZipFile(sink, "w") as z:
                for path, content, stored in rows:
                    z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
            fs.create_dir(f"{base}/{folder}", recursive=True)
            with fs.open_output_stream(f"{base}/{folder}/{quote(str(book), safe='')}.epub") as f:
                f.write(sink.getvalue())
            rows.clear()
            return 1

        for row in iterator:
            if row[self.at["book_id"]] != book:
                books += flush()
                book = row[self.at["book_id"]]
            if row[self.at["content"]] is None:
                raise ValueError(f"{book}: no content for {row[self.at['path']]}")
            rows.append((row[self.at["path"]], row[self.at["content"]], row[self.at["stored"]]))
        books += flush()
        return Part(folder, books)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs as pafs

        fs, base = reached(self.path)
        fs.create_dir(f"{base}/{COMMITTED}", recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/{COMMITTED}"))]
        with fs.open_output_stream(f"{base}/{COMMITTED}/{self.run}.json") as f:
            f.write(json.dumps([m.folder for m in messages if m and m.books]).encode())
        if self.overwrite:
            for path in before:
                fs.delete_file(path)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs as pafs

        fs, base = reached(self.path)
        if fs.get_file_info(f"{base}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.run}")


def write_packages(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Writes entries(book_id, ord, path, content, stored) as packages, a file a book; see PackageFiles."""
    deal_unions_again(entries.sparkSession)
    entries.sparkSession.dataSource.register(PackageFiles)
    rows = entries.select(F.col("book_id").cast("string").alias("book_id"), F.col("ord").cast("long").alias("ord"), "path", "content", "stored")
    rows.repartition("book_id").sortWithinPartitions("book_id", "ord").write.format("folio_packages").mode(mode).option("path", path).save()


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """book_id, package: the packages of all committed runs under path."""
    from pyarrow import fs as pafs

    fs, base = reached(path.rstrip("/"))
    folders = []
    for f in fs.get_file_info(pafs.FileSelector(f"{base}/{COMMITTED}", allow_not_found=True)):
        with fs.open_input_stream(f.path) as s:
            folders += json.loads(s.read())
    if not folders:
        return spark.createDataFrame([], "book_id string, package binary")
    found = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{x}" for x in folders])
    return found.select(F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.epub\z", "")).alias("book_id"), F.col("content").alias("package"))
