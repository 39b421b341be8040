"""Source trees as tables of files."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ToolkitError
from lodestone.languages import language_of
from lodestone.staging import numbered

#: Names of folders and files that are skipped, and the largest file that is read.
DEFAULT_IGNORE = ("node_modules", ".git", ".codegraph", "dist", "build", "out", "coverage", ".next", ".nuxt", ".turbo", "vendor", "__pycache__")
MAX_FILE_BYTES = 1_500_000
#: Folders that may wait to be listed on the driver before the tasks take over.
FOLDERS_AT_ONCE = 256
LISTING = "file_no long, path string, language string, size long, mtimeMs double"


def open_root(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder given as a local path or a URI."""
    files, path = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{posixpath.abspath(root)}")
    kind = files.get_file_info(path).type
    if kind == pyarrow.fs.FileType.NotFound:
        raise ToolkitError("CODEGRAPH_DIR_NOT_FOUND", f"no such folder: {root}")
    if kind != pyarrow.fs.FileType.Directory:
        raise ToolkitError("CODEGRAPH_NOT_A_DIRECTORY", f"not a folder: {root}")
    return files, path.rstrip("/")


def is_ignored(path: str | None, ignore) -> bool:
    """Whether any segment of a path, by either kind of slash, is in ``ignore``."""
    return path is not None and any(s in ignore for s in path.replace("\\", "/").split("/"))


def ignored_column(path: Column, ignore) -> Column:
    """``is_ignored`` as a column."""
    return F.coalesce(F.arrays_overlap(F.split(path, r"[/\\\\]"), F.array(*[F.lit(x) for x in sorted(ignore)])), F.lit(False))


@dataclass(frozen=True)
class Choice:
    """Which files of a tree count."""

    skip: frozenset
    languages: frozenset | None
    max_file_bytes: int

    @classmethod
    def of(cls, languages=None, ignore=(), replace_ignore: bool = False, max_file_bytes: int = MAX_FILE_BYTES) -> Choice:
        return cls(frozenset(ignore) if replace_ignore else frozenset({*DEFAULT_IGNORE, *ignore}), None if languages is None else frozenset(languages), max_file_bytes)

    def folder(self, files: pyarrow.fs.FileSystem, top: str, folder: str) -> tuple[list[str], list[tuple[str, str, int, float]]]:
        """The folders in ``folder`` that are entered, and (path, language, size, mtime in ms) of its files that count."""
        folders, found = [], []
        for info in files.get_file_info(pyarrow.fs.FileSelector(folder)):
            if info.base_name in self.skip:
                continue
            if info.type == pyarrow.fs.FileType.Directory:
                folders.append(info.path)
            elif info.type == pyarrow.fs.FileType.File and (language := language_of(info.base_name)):
                if (self.languages is None or language.id in self.languages) and info.size <= self.max_file_bytes:
                    found.append((info.path[len(top) + 1 :], language.id, info.size, info.mtime_ns / 1e6))
        return folders, found


def _entered(files, top: str, choice: Choice, pending: list[str], cancelled: Callable[[], bool] | None, most: int | None = None) -> list[tuple]:
    """The files below ``pending``, which is used up, or cut short once more than ``most`` folders wait in it."""
    found = []
    while pending and (most is None or len(pending) <= most):
        if cancelled is not None and cancelled():
            raise ToolkitError("CODEGRAPH_ABORTED", "the scan was cancelled")
        folders, here = choice.folder(files, top, pending.pop(0))
        pending += folders
        found += here
    return found


def walk(root: str, cancelled: Callable[[], bool] | None = None, **options) -> Iterator[tuple[str, str, int, float]]:
    """(path, language, size, mtime in ms) of each file to parse, by relative path; ignored folders are not entered."""
    files, top = open_root(root)
    yield from sorted(_entered(files, top, Choice.of(**options), [top], cancelled))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "language", "size", "mtimeMs"])


def scan(spark: SparkSession, root: str, cancelled: Callable[[], bool] | None = None, folders_at_once: int = FOLDERS_AT_ONCE, **options) -> DataFrame:
    """The files of ``walk`` as a table (LISTING), numbered by path. Contents are not read.

    The driver lists folders until more than ``folders_at_once`` wait; those are listed by the tasks, each with all below
    it, and numbered by a range sort. A small tree never leaves the driver.
    """
    files, top = open_root(root)
    choice, pending = Choice.of(**options), [top]
    found = _entered(files, top, choice, pending, cancelled, folders_at_once)
    if not pending:
        listing = pa.Table.from_batches([_table(sorted(found))])
        return spark.createDataFrame(listing.add_column(0, "file_no", pa.array(range(len(found)), pa.int64())), LISTING)

    def run(batches):
        files, _ = open_root(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                yield _table(_entered(files, top, choice, [folder], None))

    kinds = LISTING.removeprefix("file_no long, ")
    below = spark.createDataFrame([(f,) for f in pending], "folder string").repartition(len(pending)).mapInArrow(run, kinds)
    both = below if not found else below.unionByName(spark.createDataFrame(pa.Table.from_batches([_table(found)]), kinds))
    return numbered(both.orderBy("path"), "file_no").select("file_no", "path", "language", "size", "mtimeMs")


def with_content(listing: DataFrame, root: str) -> DataFrame:
    """``listing`` with content and hash (hex SHA-1 of it); files are read by the tasks, one batch after another."""
    names = listing.columns

    def run(batches):
        files, top = open_root(root)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                bodies = []
                for path in part.column("path").to_pylist():
                    with files.open_input_stream(f"{top}/{path}", compression=None) as stream:
                        bodies.append(stream.read())
                hashes = [hashlib.sha1(b).hexdigest() for b in bodies]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary()), pa.array(hashes, pa.string())], [*names, "content", "hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInArrow(run, f"{schema}, content binary, hash string")
