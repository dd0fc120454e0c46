"""A sink of page files: one file a page, at chapter/slug.html below the bundle's path.

read_pages() reads a bundle back: chapters are listed by tasks and their files dealt out by number, so neither the driver nor a
task holds the names of a whole bundle, as a listing by Spark's file index would.

Executors write straight to the store, any that Arrow's file systems reach (local or mounted folders, hdfs, s3, gs). A job writes
into a folder of its own beside the bundle; each file is put in its place so that an attempt that is repeated, or runs twice at a time, leaves the same file.
Moves between folders, of which a local file system does one at a time, are needed only where a file is there already, or in other stores. When all tasks are done, that folder takes the bundle's place. A job that ends
before leaves the bundle as it was; what it wrote is removed by the next one that succeeds.
"""

from __future__ import annotations

import html
import io
import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COLUMNS = ("chapter", "slug", "title", "html")
#: Files that one task reads, about, bytes of files that go on together, and folders that are removed at a time.
FILES, BYTES, REMOVED = 20_000, 8 << 20, 16


@dataclass
class Written(WriterCommitMessage):
    """How many pages a task wrote."""

    pages: int


def page_file(slug: str, title: str, body: str) -> bytes:
    """The page as a file, with its identifier and title in the head."""
    quoted = html.escape(slug, quote=True)
    return f'<html><head><title>{html.escape(title, quote=False)}</title><meta name="identifier" content="{quoted}"></head><body>{body}</body></html>'.encode()


def _safe(name: str) -> str:
    """A name that stays inside its folder."""
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"not a file name: {name!r}")
    return name


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _put(store: fs.FileSystem, own: str, at: str, content: bytes) -> None:
    """The content as a file at its place; `own` is a name that no other attempt uses.

    On a local folder the file is made at its place, if none is there: one entry instead of two and a move. One that is there may be another
    attempt's, whole or not: then a whole one is moved over it. So the attempt that succeeds has left a whole file, whatever others did before, beside or after it.
    """
    if not isinstance(store, fs.LocalFileSystem):
        with store.open_output_stream(own) as out:
            out.write(content)
        return store.move(own, at)
    try:
        with open(at, "xb", buffering=0) as out:
            _all(out, content)
    except FileExistsError:
        with open(own, "wb", buffering=0) as out:
            _all(out, content)
        os.replace(own, at)


def _all(out: io.RawIOBase, content: bytes) -> None:
    rest = memoryview(content)
    while rest:
        rest = rest[out.write(rest) :]


def _names(store: fs.FileSystem, folder: str) -> Iterator[str]:
    """Names of the files of a folder."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            yield from (e.name for e in entries if e.is_file())
    else:
        yield from (posixpath.basename(i.path) for i in store.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File)


def _content(store: fs.FileSystem, path: str) -> bytes:
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb", buffering=0) as file:
            return file.read()
    with store.open_input_stream(path) as file:
        return file.read()


class PageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _at(self, suffix: str = "") -> tuple[fs.FileSystem, str]:
        return _store(self.path + suffix)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self._at(f".new-{self.job}")
        _, scratch = self._at(f".tmp-{self.job}")
        scratch = f"{scratch}/{TaskContext.get().taskAttemptId()}"  # a folder of its own: in a shared one tasks wait for each other
        own, made, pages = f"{scratch}/page", set(), 0
        store.create_dir(scratch)
        for row in iterator:
            chapter, slug = _safe(str(row["chapter"])), _safe(str(row["slug"]))
            if chapter not in made:
                store.create_dir(f"{folder}/{chapter}")
                made.add(chapter)
            _put(store, own, f"{folder}/{chapter}/{slug}.html", page_file(slug, row["title"] or "", row["html"] or ""))
            pages += 1
        return Written(pages)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self._at()
        new = f"{path}.new-{self.job}"
        store.create_dir(new)
        with store.open_output_stream(f"{new}/_SUCCESS") as out:
            out.write(str(sum(m.pages for m in messages if m)).encode())
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.move(path, f"{path}.old-{self.job}")
        store.move(new, path)
        self._clear(store, path, (".new-", ".tmp-", ".old-"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self._at()
        self._clear(store, path, (f".new-{self.job}", f".tmp-{self.job}"))

    def _clear(self, store: fs.FileSystem, path: str, suffixes: tuple[str, ...]) -> None:
        for info in store.get_file_info(fs.FileSelector(posixpath.dirname(path))):
            if info.type == fs.FileType.Directory and info.path.startswith(tuple(path + s for s in suffixes)):
                inner = [i.path for i in store.get_file_info(fs.FileSelector(info.path)) if i.type == fs.FileType.Directory]
                with ThreadPoolExecutor(REMOVED) as threads:
                    list(threads.map(store.delete_dir, inner))
                store.delete_dir(info.path)


class PageBundle(DataSource):
    """Rows (chapter, slug, title, html) as files. Only mode "overwrite": a bundle is written whole."""

    @classmethod
    def name(cls) -> str:
        return "page_bundle"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        if not overwrite:
            raise ValueError("a bundle is written whole: use mode('overwrite')")
        if not set(COLUMNS) <= set(schema.fieldNames()):
            raise ValueError(f"a bundle needs the columns {', '.join(COLUMNS)}")
        return PageWriter(self.options["path"])


def write_pages(targets: DataFrame, path: str) -> None:
    """One file for each row of targets (chapter, slug, title, html); slugs are unique in their chapter. Exactly these files are in the bundle afterwards."""
    targets.sparkSession.dataSource.register(PageBundle)
    targets.select(*COLUMNS).write.format("page_bundle").mode("overwrite").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, name, content) of all page files of a bundle."""
    store, at = _store(path)
    with store.open_input_stream(f"{at}/_SUCCESS") as told:
        pages = int(told.read())
    chapters = [(posixpath.basename(i.path),) for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory]

    def listed(batches):
        for batch in batches:
            for chapter in batch.column(0).to_pylist():
                store, at = _store(path)
                names = (n for n in _names(store, f"{at}/{chapter}") if n.endswith(".html"))
                while part := list(islice(names, FILES)):
                    yield pa.RecordBatch.from_arrays([pa.array([chapter] * len(part)), pa.array(part)], ["chapter", "name"])

    def read(batches):
        store, at = _store(path)
        for batch in batches:
            begin, held, size = 0, [], 0
            for i, (chapter, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                held.append(_content(store, f"{at}/{chapter}/{name}"))
                size += len(held[-1])
                if size >= BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(held)) for c in batch.columns), pa.array(held, pa.binary())], ["chapter", "name", "content"])
                    begin, held, size = i + 1, [], 0

    parts = max(spark.sparkContext.defaultParallelism, -(-pages // FILES))
    found = spark.createDataFrame(chapters, "chapter string").repartition(max(1, len(chapters)), "chapter") if chapters else spark.createDataFrame([], "chapter string")
    return found.mapInArrow(listed, "chapter string, name string").repartition(parts, "name").mapInArrow(read, "chapter string, name string, content binary")
