"""A versioned index of files and graph in a folder, and incremental builds over it.

Every commit writes a new version folder and then one small file, numbered one above the last, that names what is current.
That file is created exclusively, so of two writers who began from one version the second is refused; it holds a checksum,
so a half-written one does not count. A reader takes the highest number once; a writer that dies leaves the version before.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ToolkitError
from lodestone.operators.build import graph_of
from lodestone.operators.graph import CodeGraph
from lodestone.parsing import parse_files
from lodestone.schema import EDGES, FILES, NODES
from lodestone.sources.tree import MAX_FILE_BYTES, scan, with_content
from lodestone.staging import file_system, staged

SCHEMA_VERSION, PARSER_VERSION = 3, "lodestone-parsers-1"
#: Folders that files are dealt to by a hash of their path.
BUCKETS = 64
_POINTER = "_CURRENT-"
_FILE_COLUMNS = ["path", "language", "hash", "mtimeMs", "size", "facts"]


@dataclass(frozen=True)
class StoreMeta:
    schema_version: int
    parser_version: str
    config_hash: str
    root: str | None = None


@dataclass(frozen=True)
class BuildStats:
    files: int
    parsed: int
    reused: int
    deleted: int


def _bucket():
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")


def config_hash(languages, max_file_bytes: int) -> str:
    """What facts depend on: the languages and the size limit; ignore lists don't matter."""
    chosen = None if languages is None else sorted(languages)
    return hashlib.sha1(json.dumps({"languages": chosen, "maxFileBytes": max_file_bytes}, separators=(",", ":")).encode()).hexdigest()


def global_index_name(folder: str) -> str:
    return f"{hashlib.sha1(folder.encode()).hexdigest()[:16]}.index"


class GraphStore(ABC):
    """What an index backend offers; tables are DataFrames."""

    @abstractmethod
    def meta(self) -> StoreMeta | None: ...

    @abstractmethod
    def files(self) -> DataFrame: ...

    @abstractmethod
    def load_graph(self) -> CodeGraph | None: ...

    @abstractmethod
    def commit(self, meta: StoreMeta, put: DataFrame | None = None, delete: DataFrame | None = None, reset: bool = False, graph: CodeGraph | None = None) -> None: ...


class ParquetStore(GraphStore):
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder if "://" in folder else f"file://{folder}"
        try:
            self._root, self._fs = file_system(spark, self.folder)
            self._fs.mkdirs(self._root)
            self._current()
        except (Py4JError, ValueError, KeyError, TypeError) as cause:
            raise ToolkitError("CODEGRAPH_INDEX_UNREADABLE", f"cannot read the index in {folder}", cause) from cause

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, path) of all pointer files, the latest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [(int(n[len(_POINTER) :]), f"{self.folder}/{n}") for n in names if n.startswith(_POINTER) and n[len(_POINTER) :].isdecimal()]
        return sorted(found, reverse=True)

    def _pointer(self) -> tuple[int, dict | None]:
        """The number of the last whole commit (0: none) and what it says."""
        damaged = None
        for number, path in self._pointers():
            stream = self._fs.open(file_system(self.spark, path)[0])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            head, _, body = text.partition("\n")
            if hashlib.sha1(body.encode()).hexdigest() == head:
                return number, json.loads(body)
            damaged = path if text else damaged
        if damaged:
            raise ValueError(f"{damaged} is damaged and there is no version before it")
        return 0, None

    def _current(self) -> dict | None:
        found = self._pointer()[1]
        return found if found and found["meta"]["schema_version"] == SCHEMA_VERSION else None

    def version(self) -> int:
        """The number of the last commit, whatever its schema; 0 before the first."""
        return next((number for number, _ in self._pointers()), 0)

    def _table(self, name: str, schema: str) -> DataFrame | None:
        place = (self._current() or {}).get(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{place}") if place else None

    def meta(self) -> StoreMeta | None:
        found = self._current()
        return StoreMeta(**found["meta"]) if found else None

    def _files(self, buckets: dict[str, str]) -> DataFrame:
        places = [f"{self.folder}/{v}" for v in buckets.values()]
        return self.spark.read.schema(FILES).parquet(*places) if places else self.spark.createDataFrame([], FILES)

    def files(self) -> DataFrame:
        return self._files((self._current() or {}).get("files", {}))

    def file_hashes(self) -> DataFrame:
        return self.files().select("path", "hash")

    def file_stamps(self) -> DataFrame:
        return self.files().select("path", "hash", "mtimeMs", "size")

    def get_facts(self, paths: DataFrame) -> DataFrame:
        """Facts of those of ``paths(path)`` that the index has."""
        return self.files().join(paths.select("path").distinct(), "path", "left_semi").select("path", "facts")

    def load_graph(self) -> CodeGraph | None:
        nodes, edges = self._table("nodes", NODES), self._table("edges", EDGES)
        if nodes is None or nodes.isEmpty():
            return None
        return CodeGraph(nodes, edges)

    def commit(self, meta: StoreMeta, put: DataFrame | None = None, delete: DataFrame | None = None, reset: bool = False, graph: CodeGraph | None = None, expected: int | None = None) -> None:
        """One atomic step: forget (all or some) files, put others by path, replace the graph if one is given.

        Files lie in BUCKETS folders by a hash of their path; only buckets that a change falls in are written, the
        others are named as they are. ``expected``: the version that the changes were worked out from, by default the
        current one; if another commit comes between, this one is refused.
        """
        expected, now, version = self.version() if expected is None else expected, self._current() or {}, f"v-{uuid.uuid4().hex}"
        places = {k: now[k] for k in ("nodes", "edges") if now.get(k)}
        buckets = {} if reset else dict(now.get("files", {}))
        touched = [t.select("path").distinct() for t in (delete, put) if t is not None]
        if touched:
            gone = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1]).distinct()
            hit = [str(r[0]) for r in gone.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
            kept = self._files({k: v for k, v in buckets.items() if k in hit}).join(gone, "path", "left_anti").select(_FILE_COLUMNS)
            rows = kept if put is None else kept.unionByName(put.select(_FILE_COLUMNS))
            # a bucket may stay without rows, and then without a folder
            rows.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}/files")
            written = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(file_system(self.spark, f"{self.folder}/{version}/files")[0])}
            buckets = {k: v for k, v in buckets.items() if k not in hit} | {k: f"{version}/files/bucket={k}" for k in hit if k in written}
        places["files"] = buckets
        if graph is not None:
            for name, table in (("nodes", graph.raw_nodes), ("edges", graph.edges())):
                places[name] = f"{version}/{name}"
                table.write.parquet(f"{self.folder}/{places[name]}")
        self._point(places | {"meta": asdict(meta)}, expected)

    def _point(self, current: dict, expected: int) -> None:
        body = json.dumps(current)
        path = f"{self.folder}/{_POINTER}{expected + 1:012d}"
        try:
            out = self._fs.create(file_system(self.spark, path)[0], False)
        except Py4JJavaError as cause:
            if "FileAlreadyExists" in str(cause.java_exception) or "already exists" in str(cause.java_exception):
                raise ToolkitError("CODEGRAPH_INDEX_CONFLICT", f"another commit to {self.folder} came first", cause) from cause
            raise
        out.write(bytearray(f"{hashlib.sha1(body.encode()).hexdigest()}\n{body}".encode()))
        out.close()

    def vacuum(self) -> int:
        """Removes versions that the current one does not use, and pointers before it; how many versions."""
        number, found = self._pointer()
        found = found or {}
        used = {p.split("/")[0] for p in (*found.get("files", {}).values(), *(found[k] for k in ("nodes", "edges") if found.get(k)))}
        gone = [s.getPath() for s in self._fs.listStatus(self._root) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used]
        for path in gone:
            self._fs.delete(path, True)
        for old, path in self._pointers():
            if old < number:
                self._fs.delete(file_system(self.spark, path)[0], False)
        return len(gone)

    def status(self) -> DataFrame:
        """One row: counts, bytes of source, and the meta fields."""
        meta, files = self.meta(), self.files()
        nodes, edges = self._table("nodes", NODES), self._table("edges", EDGES)
        row = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes"))
        return row.withColumns({"nodes": F.lit(nodes.count() if nodes is not None else 0), "edges": F.lit(edges.count() if edges is not None else 0), "config_hash": F.lit(meta.config_hash if meta else None), "root": F.lit(meta.root if meta else None)})


def list_indexes(spark: SparkSession, home: str) -> DataFrame:
    """One row for each index in the folder ``home``: its name and what ``status`` says of it."""
    root, fs = file_system(spark, home if "://" in home else f"file://{home}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().endswith(".index")) if fs.exists(root) else []
    rows = [(name, *ParquetStore(spark, f"{home}/{name}").status().first()) for name in names]
    return spark.createDataFrame(rows, "name string, files long, source_bytes long, nodes long, edges long, config_hash string, root string")


@contextmanager
def open_store(spark: SparkSession, folder: str):
    yield ParquetStore(spark, folder)


def _compatible(store: GraphStore | None, wanted: StoreMeta) -> bool:
    found = store.meta() if store is not None else None
    return found is not None and (found.schema_version, found.parser_version, found.config_hash) == (wanted.schema_version, wanted.parser_version, wanted.config_hash)


def compared(listing: DataFrame, known: DataFrame) -> DataFrame:
    """``listing(path, mtimeMs, size, ...)`` with fresh, whether ``known`` has the file with equal time and size (and
    facts), and old_hash, the hash it knows."""
    stamps = known.where("facts is not null").select("path", F.col("mtimeMs").alias("old_mtime"), F.col("size").alias("old_size"), F.col("hash").alias("old_hash"))
    same = (F.col("mtimeMs") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    return listing.join(stamps, "path", "left").withColumn("fresh", F.coalesce(same, F.lit(False))).drop("old_mtime", "old_size")


def changed(read: DataFrame) -> DataFrame:
    """``read(hash, old_hash, ...)`` with stale: whether the content is new and has to be parsed."""
    return read.withColumn("stale", F.coalesce(F.col("hash") != F.col("old_hash"), F.lit(True)))


def gone_files(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of ``known`` that are not listed any more."""
    return known.select("path").join(listing.select("path"), "path", "left_anti")


@contextmanager
def _stoppable(spark: SparkSession, cancelled: Callable[[], bool] | None):
    """Asks ``cancelled`` while jobs run, between the files that tasks read and parse, and stops them when it says so."""
    if cancelled is None:
        yield
        return
    tag, done, fired = f"build-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        while not done.wait(0.05):
            if cancelled():
                fired.set()
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
        if fired.is_set() or cancelled():
            raise ToolkitError("CODEGRAPH_ABORTED", "the build was cancelled")
    except Exception as cause:
        if fired.is_set() and not isinstance(cause, ToolkitError):
            raise ToolkitError("CODEGRAPH_ABORTED", "the build was cancelled", cause) from cause
        raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)


def build_code_graph(
    spark: SparkSession, folder: str, languages=None, ignore=(), replace_ignore: bool = False, max_file_bytes: int = MAX_FILE_BYTES, store: GraphStore | None = None, persist_graph: bool = True,
    on_stats: Callable[[BuildStats], None] | None = None, cancelled: Callable[[], bool] | None = None,
) -> CodeGraph:
    """The graph of a source tree; with a store, only files that changed are read and only new contents parsed.

    Equal time and size: taken from the index unread. Else read and hashed; an equal hash: facts from the index, the
    stamp refreshed. Else parsed. A store of another version or configuration is built anew. ``cancelled`` is asked all
    along, also while files are parsed; a cancelled build commits nothing.
    """
    with _stoppable(spark, cancelled):
        listing = scan(spark, folder, languages=languages, ignore=ignore, replace_ignore=replace_ignore, max_file_bytes=max_file_bytes, cancelled=cancelled)
        meta = StoreMeta(SCHEMA_VERSION, PARSER_VERSION, config_hash(languages, max_file_bytes), folder)
        warm = _compatible(store, meta)
        known = store.files() if warm else spark.createDataFrame([], FILES)
        joined = compared(listing, known)
        untouched = joined.where("fresh").select("file_no", "path", "language")
        read = changed(with_content(joined.where("not fresh").select(*listing.columns, "old_hash"), folder))
        # one pass over the contents: parsed where the hash is new; where it is not, facts come from the index
        parsed = parse_files(read.withColumn("content", F.when(F.col("stale"), F.col("content"))))
        parsed = staged(parsed.drop("old_hash"), "parsed")
        new = parsed.where("stale").select("file_no", *_FILE_COLUMNS)
        refreshed = parsed.where("not stale").drop("facts").join(known.select("path", "facts"), "path").select("file_no", *_FILE_COLUMNS)
        reused = untouched.join(known.drop("language"), "path").select("file_no", *_FILE_COLUMNS)
        gone = gone_files(known, listing)
        put = new.unionByName(refreshed)
        graph = graph_of(staged(put.unionByName(reused).select("file_no", "path", "language", "facts"), "facts")).staged()
        total, fresh = listing.count(), new.count()
        stats = BuildStats(total, fresh, total - fresh, gone.count() if warm else 0)
        put, gone = staged(put.select(_FILE_COLUMNS), "put"), staged(gone, "gone") if warm else None
    if store is not None:
        store.commit(meta, put, gone, not warm, graph if persist_graph else None)
    if on_stats:
        on_stats(stats)
    return graph


def load_code_graph(store: GraphStore) -> CodeGraph | None:
    return store.load_graph()
