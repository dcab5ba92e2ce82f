"""Python data sources for inputs Spark can't split: tar archives and giant JSON objects.

``spark.read.format("tartext").load(path)`` reads the text members of archives,
``spark.read.format("pagesjson").load(path)`` the pages of objects of documents.

Paths are local or on any file system pyarrow knows by its scheme (hdfs, s3, gs,
abfs).  One partition a file, since neither can be split; an archive's members
are read one at a time in the archive's order (the name is a column), and
``suffix`` and ``contains`` filter on it before the bytes are read.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import tarfile
from collections.abc import Iterator
from typing import IO

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TarText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tartext"

    def schema(self) -> str:
        return "archive string, name string, text string"

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def matching(path: str) -> list[str]:
    """Files a path names: itself, those a pattern in its last part matches, or those below a folder; sorted."""
    files, place = located(path)
    folder, _, last = place.rpartition("/")
    pattern = any(c in last for c in "*?[")
    info = None if pattern else files.get_file_info(place)
    if info is not None and info.type == pafs.FileType.File:
        return [path]
    found = files.get_file_info(pafs.FileSelector(folder if pattern else place))
    names = [f.path for f in found if f.type == pafs.FileType.File and (not pattern or fnmatch.fnmatch(f.base_name, last))]
    head = path[: len(path) - len(place)]
    return sorted(head + n for n in names)


class TarReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = matching(options["path"])
        self.suffix, self.contains = options.get("suffix", ""), options.get("contains", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, place = located(partition.value)
        with files.open_input_stream(place, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
            for member in archive:
                if member.isfile() and member.name.endswith(self.suffix) and self.contains in member.name:
                    data = archive.extractfile(member).read()
                    try:
                        text = data.decode("utf-8-sig")
                    except UnicodeDecodeError:
                        text = data.decode("latin-1")
                    yield partition.value, member.name, text


class PagesJson(DataSource):
    """(document_id, page, language, text) of files that hold one object of documents with page triples.

    The object is never held whole: one document's entry is decoded at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "pagesjson"

    def schema(self) -> str:
        return "document_id string, page int, language string, text string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class PagesReader(TarReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, place = located(partition.value)
        with io.TextIOWrapper(files.open_input_stream(place), encoding="utf-8") as file:
            for document, entries in object_items(file, int(self.chunk)):
                for e in entries:
                    if not (isinstance(e, list) and len(e) == 3 and all(isinstance(x, str) for x in e)):
                        raise ValueError(f"a page entry of {document} is not three strings")
                    yield document, int(e[0]), e[1], e[2]

    def __init__(self, options) -> None:
        super().__init__(options)
        self.chunk = options.get("chunk", str(1 << 20))


class _Window:
    """What has been read of a text file and not yet used up."""

    def __init__(self, file: IO[str], size: int) -> None:
        self.file, self.size, self.text = file, size, ""

    def more(self) -> None:
        part = self.file.read(self.size)
        if not part:
            raise ValueError("the object ends too early")
        self.text += part

    def sign(self) -> str:
        """The next character that is no white space, which stays."""
        while not (rest := self.text.lstrip()):
            self.more()
        self.text = rest
        return rest[0]

    def take(self, sign: str) -> None:
        if self.sign() != sign:
            raise ValueError(f"expected {sign}, found {self.text[0]}")
        self.text = self.text[1:]

    def value(self):
        """The next JSON string, array or object; read on until its brackets are closed, each character looked at once."""
        if self.sign() not in '"[{':
            raise ValueError("expected a string, array or object")
        at, depth, quoted = 0, 0, False
        while True:
            for m in _MARK.finditer(self.text, at):
                sign = m.group()
                if sign == '"':
                    quoted = not quoted
                elif sign[0] == "\\":
                    if len(sign) == 1:  # its other half is not read yet
                        break
                elif not quoted:
                    depth += 1 if sign in "[{" else -1
                at = m.end()
                if not depth and not quoted:
                    found, self.text = json.loads(self.text[:at]), self.text[at:]
                    return found
            else:
                at = len(self.text)
            self.more()


#: What opens, closes or quotes; an escaped character is one mark.
_MARK = re.compile(r'\\.?|["\[\]{}]', re.S)


def object_items(file: IO[str], size: int = 1 << 20) -> Iterator[tuple[str, list]]:
    """Key and value of each entry of the one object a file holds."""
    w = _Window(file, size)
    w.take("{")
    while w.sign() != "}":
        key = w.value()
        if not isinstance(key, str):
            raise ValueError("a key is not a string")
        w.take(":")
        yield key, w.value()
        if w.sign() == ",":
            w.take(",")
        elif w.sign() != "}":
            raise ValueError("expected , or }")


def register(spark: SparkSession) -> None:
    for source in (TarText, PagesJson):
        spark.dataSource.register(source)
