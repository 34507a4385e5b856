"""Folders of page-marked texts as a Spark format: `paged_texts`, for batch and stream, in and out.

A row is a file: its stem, its bytes, its text without the page map in front, and that map. `cut_pages` gives a row a page.

Options: `path`; `glob` of the names (*.md); `split_bytes`, how much one task reads, whole files (64 MB); `settle_seconds`
(streams): how long a file must have been left alone before it counts as complete (1).

Files are listed once, on the driver, by name, size and time; tasks open what they are dealt. Conditions on `stem`
(equal, in, starts with, ends with, contains) leave files out before any is opened. Any file system that Arrow knows will do;
a path without a scheme has to be shared by the driver and all executors.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..operators.linking import pages_in
from .store import PAGE_MAP

NAME, SCHEMA = "paged_texts", f"stem string, bytes long, text string, pages {PAGE_MAP}"
_PAGE = pa.struct([("page", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())])
_ARROW = pa.schema([("stem", pa.string()), ("bytes", pa.int64()), ("text", pa.string()), ("pages", pa.list_(_PAGE))])
_OPEN, _CLOSE = "<!-- PAGE_MAP: ", " -->"

#: Conditions on a stem that files can be left out by.
_TESTS = {
    EqualTo: lambda stem, x: stem == x,
    In: lambda stem, x: stem in x,
    StringStartsWith: lambda stem, x: stem.startswith(x),
    StringEndsWith: lambda stem, x: stem.endswith(x),
    StringContains: lambda stem, x: x in stem,
}


@dataclass
class Files(InputPartition):
    """What one task reads: (place, bytes) of whole files."""

    dealt: list[tuple[str, int]]


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)


def stem_of(place: str) -> str:
    return posixpath.splitext(posixpath.basename(place))[0]


def split_header(text: str) -> tuple[str, list[dict] | None]:
    """A text without its page map, and the map; without one, or with one that doesn't parse, the text as it stands and None."""
    if not text.startswith(_OPEN):
        return text, None
    end = text.find(_CLOSE)
    if end < 0:
        return text, None
    try:
        pages = [{k: int(p[k]) for k in ("page", "start_char", "end_char")} for p in json.loads(text[len(_OPEN) : end])]
    except (ValueError, TypeError, KeyError):
        return text, None
    return text[end + len(_CLOSE) :].removeprefix("\n\n"), pages


class _Folder:
    """Listing, dealing and reading: what the batch reader and the stream reader share."""

    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.md")
        self.split_bytes = int(options.get("split_bytes", 64 << 20))

    def listed(self) -> list[files.FileInfo]:
        system, path = opened(self.path)
        found = system.get_file_info(files.FileSelector(path, allow_not_found=True))
        # names with a dot or a low line in front are files that are still being written
        return sorted((f for f in found if f.is_file and f.base_name[0] not in "._" and fnmatchcase(f.base_name, self.glob)), key=lambda f: f.base_name)

    def dealt(self, found: list[files.FileInfo]) -> list[Files]:
        """Neighbours by name, until a task has split_bytes."""
        out, held = [], 0
        for f in found:
            if not out or held + f.size > self.split_bytes:
                out.append(Files([]))
                held = 0
            out[-1].dealt.append((f.path, f.size))
            held += f.size
        return out or [Files([])]

    def read(self, partition: Files):
        system, _ = opened(self.path)
        for place, _ in partition.dealt:
            with system.open_input_stream(place) as source:
                raw = source.read()
            text, pages = split_header(raw.decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_pylist([{"stem": stem_of(place), "bytes": len(raw), "text": text, "pages": pages}], schema=_ARROW)


class _Reader(_Folder, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.conditions = []

    def pushFilters(self, filters):
        for f in filters:
            test = _TESTS.get(type(f))
            if test and f.attribute == ("stem",):
                self.conditions.append((test, f.value))
            else:
                yield f

    def partitions(self):
        return self.dealt([f for f in self.listed() if all(test(stem_of(f.path), x) for test, x in self.conditions)])


class _Stream(_Folder, DataSourceStreamReader):
    """Files in the order of (time of change, name); the offset is the last one's, so its size doesn't grow with the folder."""

    def __init__(self, options):
        super().__init__(options)
        self.settle = float(options.get("settle_seconds", 1))

    def place(self, f: files.FileInfo) -> tuple[int, str]:
        return f.mtime_ns, f.base_name

    def initialOffset(self):
        return {"at": 0, "name": ""}

    def latestOffset(self):
        quiet = time.time_ns() - int(self.settle * 1e9)
        at, name = max((self.place(f) for f in self.listed() if f.mtime_ns <= quiet), default=(0, ""))
        return {"at": at, "name": name}

    def partitions(self, start, end):
        after, upto = ((x["at"], x["name"]) for x in (start, end))
        return self.dealt([f for f in self.listed() if after < self.place(f) <= upto])


class _Writer(DataSourceWriter):
    """A file a row. A task that is run again writes the same names with the same content; a file appears whole or not at all."""

    def __init__(self, options, schema):
        self.path, self.ending = options["path"], options.get("ending", ".md")
        if missing := {"stem", "text"} - set(schema.names):
            raise ValueError(f"{NAME} needs the columns {sorted(missing)}")

    def write(self, iterator):
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        for row in iterator:
            fields = row.asDict(recursive=True)
            if not fields["stem"] or "/" in fields["stem"] or fields["stem"][0] in "._":
                raise ValueError(f"no name for a file: {fields['stem']!r}")
            text, pages = fields["text"] or "", fields.get("pages")
            if pages is not None:
                text = f"{_OPEN}{json.dumps(pages)}{_CLOSE}\n\n{text}"
            aside = posixpath.join(path, f".{uuid.uuid4().hex}")
            with system.open_output_stream(aside) as sink:
                sink.write(text.encode())
            system.move(aside, posixpath.join(path, fields["stem"] + self.ending))
        return WriterCommitMessage()


class PagedTexts(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError(f"{NAME} only appends; a file of the same name is replaced")
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with the conditions on stems pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedTexts)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """(stem, bytes, text, pages) of the files in a folder."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(path)


def watch(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream: each file once, and again when it has changed."""
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(path)


def write(texts: DataFrame, path: str, **options) -> None:
    """A file for each row of (stem, text) and, if there is one, its page map `pages`. Stems are told apart by the caller."""
    register(texts.sparkSession)
    texts.write.format(NAME).options(**options).mode("append").save(path)


def cut_pages(texts: DataFrame) -> DataFrame:
    """(stem, page, start_char, end_char, text), a row a page: by the map of the file, else by the page marks in its text."""
    page = texts.select("stem", F.col("text").alias("_text"), F.inline(F.coalesce("pages", pages_in(F.col("text")).cast(PAGE_MAP))))
    part = F.expr("substring(_text, start_char + 1, greatest(end_char - start_char, 0))")
    return page.select("stem", "page", "start_char", "end_char", part.alias("text"))
