"""Bibliographies and documents by format name: ``spark.read.format("ris")``, ``("bib")``, ``df.write.format("files")``.

``register(spark)`` makes the names known. Reading: files below ``path`` are listed once and dealt into partitions by
their sizes; a file is read line by line, so its size does not matter, and its references are those of
``bibliography.read_ris`` and ``read_bibtex``, as the columns of a reference.

Writing: rows (name, text) become files; rows of one name that follow each other in a task are one file (deal and sort them by
name if they are many). A task writes into a folder of its attempt, and the job moves the folders' files to their
places when all tasks are done; a task that fails, or a job that does, leaves nothing. A file that is there already is replaced, and
``mode("overwrite")`` removes all others. Names may have folders, but not lead out of ``path``; two tasks with one name are an error.

Paths are those of any store that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docloom.schemas import FLAG_FIELDS, LIST_FIELDS, REFERENCE, TEXT_FIELDS

#: Bytes of files that a task reads, about, and references that travel together.
PARTITION, BATCH = 64 << 20, 2048
STAGED = "_staged-"


def store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(path))


# Parsing, a line at a time ------------------------------------------------------------------------------


class Line(NamedTuple):
    tag: str
    value: str


def _reference(fields: dict) -> dict:
    return {f: "" for f in TEXT_FIELDS} | {f: [] for f in LIST_FIELDS} | {f: False for f in FLAG_FIELDS} | {"pdf_path": None} | fields


def _ris_reference(lines: list[Line]) -> dict:
    """Of fields that come several times the last counts; pages are joined as they come."""
    from docloom.sources.bibliography import RIS_FIELDS, RIS_TYPES

    last = {x.tag: x.value for x in lines}
    of = {f: next((x.value for x in reversed(lines) if x.tag in tags), "") for f, tags in RIS_FIELDS.items()}
    pages = ""
    for x in lines:
        if x.tag in ("SP", "EP"):
            pages = x.value if not pages else f"{x.value}-{pages}" if x.tag == "SP" else f"{pages}-{x.value}"
    numbers = [x.value for x in lines if x.tag == "SN"]
    whole = lambda n: len(n.encode()) in (10, 13)
    return _reference(
        of | {
            "reference_type": RIS_TYPES.get(last["TY"], "Journal Article"), "year": of["year"][:4], "pages": pages,
            "isbn": next((n for n in reversed(numbers) if whole(n)), ""), "issn": next((n for n in reversed(numbers) if not whole(n)), ""),
            "authors": [x.value for x in lines if x.tag in ("AU", "A1")], "tags": [x.value for x in lines if x.tag == "KW"]
        }
    )


def ris_references(lines: Iterator[str]) -> Iterator[tuple[int, dict]]:
    """(number, fields) of each record."""
    number, record = 0, None
    for raw in lines:
        line = raw.strip(" ")
        if len(line) < 7 or line[2:6] != "  - ":
            continue
        x = Line(line[:2], line[6:].strip(" "))
        if x.tag == "TY":
            if record:
                yield number, _ris_reference(record)
            number, record = number + 1, [x]
        elif x.tag == "ER":
            if record:
                yield number, _ris_reference(record)
            record = None
        elif record:
            record.append(x)
    if record:
        yield number, _ris_reference(record)


def _bibtex_reference(lines: list[str]) -> dict | None:
    """A field stands on a line; nothing for entries with neither title nor authors."""
    from docloom.sources.bibliography import BIBTEX_TYPES

    fields = {}
    for line in lines:
        name, is_, value = line.strip(" ").partition("=")
        if is_:
            value = value.strip(" ").rstrip(",").strip(" ")
            quoted = len(value) > 1 and (value[0], value[-1]) in (("{", "}"), ('"', '"'))
            fields[name.strip(" ").lower()] = (len(fields), value[1:-1] if quoted else value)
    last = lambda *names: max((fields[n] for n in names if n in fields), default=(0, ""))[1]
    bare = lambda value: value.replace("{", "").replace("}", "")
    parts = lambda value, sep: [x for x in (y.strip(" ") for y in value.split(sep)) if x]
    kind = lines[0].partition("{")[0].strip(" ").lower()
    out = {"title": bare(last("title")), "authors": parts(last("author"), " and ")}
    if not out["title"] and not out["authors"]:
        return None
    out |= {f: bare(last(*names)) for f, names in (("journal", ("journal", "booktitle")), ("publisher", ("publisher",)), ("abstract_text", ("abstract",)))}
    out |= {f: last(n) for f, n in (("year", "year"), ("volume", "volume"), ("issue", "number"), ("doi", "doi"), ("isbn", "isbn"), ("issn", "issn"), ("url", "url"), ("notes", "note"), ("language", "language"))}
    return _reference(out | {"reference_type": BIBTEX_TYPES.get(kind, "Journal Article"), "pages": last("pages").replace("--", "-"), "tags": parts(last("keywords"), ",")})


def bibtex_references(lines: Iterator[str]) -> Iterator[tuple[int, dict]]:
    """(number, fields) of each entry between two ``@``."""
    number, entry = 0, []
    for line in lines:
        first, *more = line.split("@")
        entry.append(first)
        for part in more:
            if number and (found := _bibtex_reference(entry)):
                yield number, found
            number, entry = number + 1, [part]
    if number and (found := _bibtex_reference(entry)):
        yield number, found


# Reading ------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str]


class ReferenceReader(DataSourceReader):
    def __init__(self, path: str, ending: str, parse):
        self.path, self.ending, self.parse = path, ending, parse

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        files, root = store(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part[:1] in "._" for part in posixpath.relpath(p, root).split("/") if part != ".")
        found = [f for f in found if f.type == fs.FileType.File and (f is info or f.path.lower().endswith(self.ending) and not hidden(f.path))]
        out, size = [Files([])], 0
        for f in sorted(found, key=lambda f: f.path):
            if out[-1].paths and size + f.size > PARTITION:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files):
        import io

        import pyarrow as pa

        text, flag = pa.string(), pa.bool_()
        kinds = {"id": text} | dict.fromkeys(TEXT_FIELDS, text) | dict.fromkeys(LIST_FIELDS, pa.list_(text)) | dict.fromkeys(FLAG_FIELDS, flag)
        schema = pa.schema(kinds | {"pdf_path": text})
        files, _ = store(self.path)
        rows = []
        for path in partition.paths:
            with files.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n") as lines:
                for number, fields in self.parse(line.rstrip("\n").removesuffix("\r") for line in lines):
                    rows.append(fields | {"id": f"{path}#{number}"})
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# Writing ------------------------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite = path, ending, overwrite
        self.staged = f"{STAGED}{uuid.uuid4().hex}"
        files, root = store(path)
        files.create_dir(posixpath.join(root, self.staged), recursive=True)

    def write(self, iterator) -> Staged:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = store(self.path)
        folder = posixpath.join(root, self.staged, str(TaskContext.get().taskAttemptId()))
        now, out = object(), None
        try:
            for batch in iterator:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if name != now:
                        if out:
                            out.close()
                        clean = posixpath.normpath(name or ".")
                        at = posixpath.join(folder, clean + self.ending)
                        if clean.startswith(("/", "..", STAGED)) or clean == "." or files.get_file_info(at).type != fs.FileType.NotFound:
                            raise ValueError(f"no name for a file, or one that came before: {name!r}")
                        parts = posixpath.relpath(posixpath.dirname(at), folder).split("/")
                        for depth in range(len(parts) + 1):
                            # Never the job's own folder, which is gone when the job is.
                            files.create_dir(posixpath.join(folder, *parts[:depth]), recursive=False)
                        now, out = name, files.open_output_stream(at)
                    out.write((text or "").encode())
            if out:
                out.close()
        except BaseException:
            if out and not out.closed:
                out.close()
            self._forget(files, folder)
            raise
        return Staged(folder)

    def _forget(self, files, folder: str) -> None:
        """Deletes a folder that a task which has not noticed the end may still be writing to: moved away first, so it can add no file."""
        gone = f"{folder}.gone"
        try:
            files.move(folder, gone)
        except OSError:  # a store that moves no folders, or it isn't there
            gone = folder
        for wait in (0, 0.1, 0.5, 2):
            time.sleep(wait)
            try:
                return files.delete_dir(gone)
            except FileNotFoundError:
                return None
            except OSError:  # something came into it meanwhile
                continue

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(info.path) != self.staged:
                    (files.delete_dir if info.type == fs.FileType.Directory else files.delete_file)(info.path)
        folders = [m.folder for m in messages if m is not None]
        inside = lambda folder: [x for x in files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File]
        moves, targets = [], set()
        for folder in folders:
            for info in inside(folder):
                to = posixpath.join(root, posixpath.relpath(info.path, folder))
                if to in targets:
                    raise ValueError(f"two tasks have written {to}")
                targets.add(to)
                moves.append((info.path, to))
        for parent in {posixpath.dirname(to) for _, to in moves}:
            files.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: files.move(*move), moves))
        self._forget(files, posixpath.join(root, self.staged))

    def abort(self, messages) -> None:
        files, root = store(self.path)
        self._forget(files, posixpath.join(root, self.staged))


class _Source(DataSource):
    ending, parse = "", None

    def schema(self) -> str:
        return REFERENCE

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("no path")
        return self.options["path"]

    def reader(self, schema) -> ReferenceReader:
        if self.parse is None:
            raise ValueError(f"{self.name()} is written only")
        return ReferenceReader(self._path(), self.ending, type(self).parse)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"name", "text"} <= set(schema.names):
            raise ValueError("files are written of columns name and text")
        ending = self.options.get("extension", self.ending.lstrip("."))
        return FileWriter(self._path(), f".{ending}" if ending else "", overwrite)


class RisSource(_Source):
    ending, parse = ".ris", staticmethod(ris_references)

    @classmethod
    def name(cls) -> str:
        return "ris"


class BibSource(_Source):
    ending, parse = ".bib", staticmethod(bibtex_references)

    @classmethod
    def name(cls) -> str:
        return "bib"


class FilesSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "files"


def register(spark: SparkSession) -> None:
    """Makes the formats ``ris``, ``bib`` and ``files`` known to the session."""
    for source in (RisSource, BibSource, FilesSource):
        spark.dataSource.register(source)


def write_references(refs: DataFrame, fmt: str, path: str, name: str = "name", mode: str = "append") -> None:
    """Writes references as ``ris`` or ``bib`` files, one for each value of the column ``name``, whose rows are in the order of their ids."""
    from docloom.operators import citations

    register(refs.sparkSession)
    text = {"ris": citations.ris, "bib": citations.bibtex}[fmt]()
    rows = refs.select(F.col(name).cast("string").alias("name"), "id", text.alias("text")).repartition("name").sortWithinPartitions("name", "id")
    rows.select("name", "text").write.format(fmt).mode(mode).save(path)
