"""Queries of the index, the source tree and the builds, over documents and the source tree in ``corpus``."""

from __future__ import annotations

import posixpath

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.languages import languages_table
from lodestone.operators.build import graph_of
from lodestone.operators.graph import CodeGraph
from lodestone.operators.retrieval import context_rows
from lodestone.operators.store import PARSER_VERSION, SCHEMA_VERSION, ParquetStore, StoreMeta, build_code_graph, changed, compared, config_hash, gone_files, list_indexes
from lodestone.parsing import parse_files
from lodestone.plans import register
from lodestone.plans.corpus import CALLS_SQL, CONTAINS_SQL, FILES_SQL, IMPORTS_SQL, REFERENCES_SQL, SYMBOLS_SQL, code_graph, files
from lodestone.plans.fkgraph import GRAPH_SQL, graph, table
from lodestone.plans.graph_queries import pagerank_sql
from lodestone.operators.rank import ITERATIONS
from lodestone.schema import FACTS_TYPE
from lodestone.sources.tree import DEFAULT_IGNORE, ignored_column, scan
from lodestone.staging import new_path, staged

# Graphs built from sources: parsing of eight languages, and every rule of resolution.


@register("corpus_symbols", SYMBOLS_SQL)
def _corpus_symbols(spark, sf_dir):
    return code_graph(spark, sf_dir).symbols().select("path", "name", "symbol_kind", "start_line", "end_line")


@register("corpus_contains", CONTAINS_SQL)
def _corpus_contains(spark, sf_dir):
    return code_graph(spark, sf_dir).edges().where("kind = 'contains'").select("src", "dst")


@register("corpus_imports", IMPORTS_SQL)
def _corpus_imports(spark, sf_dir):
    return code_graph(spark, sf_dir).edges().where("kind = 'imports'").select("src", "dst")


@register("corpus_references", REFERENCES_SQL)
def _corpus_references(spark, sf_dir):
    return code_graph(spark, sf_dir).edges().where("kind = 'references'").select("src", "dst")


@register("corpus_calls", CALLS_SQL)
def _corpus_calls(spark, sf_dir):
    return code_graph(spark, sf_dir).edges().where("kind = 'calls'").select("src", "dst", "confidence", "call_kind", "receiver_type", "call_count", "line")


@register("corpus_facts", f"SELECT path, count(*) AS definitions FROM ({SYMBOLS_SQL}) GROUP BY path")
def _corpus_facts(spark, sf_dir):
    return parse_files(files(spark, sf_dir)).select("path", F.size("facts.definitions").cast("long").alias("definitions"))


# The index: all documents stand for files. Some came after the first build, some were changed or touched and some were
# deleted before the second; which, their ids say.
_STAMP = "doc_id, 'docs/' || doc_id || '.py' AS path"
_INDEX_SQL = f"""WITH known AS (SELECT {_STAMP}, sha1(text) AS hash, CAST(doc_id AS DOUBLE) AS mtime, CAST(length(text) AS BIGINT) AS size FROM documents WHERE doc_id % 7 <> 0),
listed AS (SELECT {_STAMP}, sha1(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS hash, CAST(doc_id + CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mtime,
    CAST(length(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM documents WHERE doc_id % 11 <> 0),
put AS (SELECT l.* FROM listed l LEFT JOIN known k USING (path) WHERE k.path IS NULL OR l.mtime <> k.mtime OR l.size <> k.size),
gone AS (SELECT path FROM known WHERE path NOT IN (SELECT path FROM listed)),
now AS (SELECT * FROM known WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM put) UNION ALL SELECT * FROM put)"""
META = StoreMeta(SCHEMA_VERSION, PARSER_VERSION, config_hash(["python"], 1000), "docs")


def _known(spark, sf_dir) -> DataFrame:
    facts = F.struct(
        F.array(F.struct(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("function"), F.lit(1), F.lit(2), F.lit(0), F.lit(9))), F.array(), F.array(), F.array()
    ).cast(FACTS_TYPE)
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    return docs.select(_path(), F.lit("python").alias("language"), F.sha1("text").alias("hash"), F.col("doc_id").cast("double").alias("mtimeMs"), F.length("text").cast("long").alias("size"), facts.alias("facts"))


def _path():
    return F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path")


def _listed(spark, sf_dir) -> DataFrame:
    grown, touched = (F.col("doc_id") % 5 == 0), (F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0)
    docs = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    text = F.when(grown, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.select(_path(), F.lit("python").alias("language"), F.sha1(text).alias("hash"), (F.col("doc_id") + touched.cast("int")).cast("double").alias("mtimeMs"), F.length(text).cast("long").alias("size"))


def _store(spark, sf_dir) -> ParquetStore:
    """An index that was built once, with the foreign-key graph in it."""
    store = ParquetStore(spark, new_path(spark, "index"))
    store.commit(META, _known(spark, sf_dir), reset=True, graph=graph(spark, sf_dir))
    return store


def _updated(spark, sf_dir) -> ParquetStore:
    """The same after a second build's commit: changed and new files put, those no longer listed deleted."""
    store, listed = _store(spark, sf_dir), _listed(spark, sf_dir)
    put = compared(listed, store.files()).where("not fresh").withColumn("facts", F.lit(None).cast(FACTS_TYPE))
    store.commit(META, put.select(store.files().columns), gone_files(store.files(), listed))
    return store


@register("index_changes", f"""{_INDEX_SQL} SELECT coalesce(l.path, k.path) AS path, CASE WHEN l.path IS NULL THEN 'deleted' WHEN l.mtime = k.mtime AND l.size = k.size THEN 'stamp' WHEN l.hash = k.hash THEN 'hash' ELSE 'parsed' END AS status
FROM known k FULL JOIN listed l ON k.path = l.path""")
def _index_changes(spark, sf_dir):
    known, listed = _store(spark, sf_dir).files(), _listed(spark, sf_dir)
    read = changed(compared(listed, known))
    status = F.when(F.col("fresh"), "stamp").when(~F.col("stale"), "hash").otherwise("parsed")
    return read.select("path", status.alias("status")).unionByName(gone_files(known, listed).withColumn("status", F.lit("deleted")))


@register("index_files", f"{_INDEX_SQL} SELECT path, hash, size FROM now")
def _index_files(spark, sf_dir):
    return _updated(spark, sf_dir).files().select("path", "hash", "size")


@register("index_stamps", f'{_INDEX_SQL} SELECT path, hash, mtime AS "mtimeMs", size FROM now')
def _index_stamps(spark, sf_dir):
    return _updated(spark, sf_dir).file_stamps()


@register("index_hashes", f"{_INDEX_SQL} SELECT path, hash FROM known")
def _index_hashes(spark, sf_dir):
    return _store(spark, sf_dir).file_hashes()


@register("index_facts", f"{_INDEX_SQL} SELECT path, 'doc' || doc_id AS names FROM known WHERE path IN (SELECT path FROM listed)")
def _index_facts(spark, sf_dir):
    found = _store(spark, sf_dir).get_facts(_listed(spark, sf_dir))
    return found.select("path", F.array_join("facts.definitions.name", ",").alias("names"))


@register("index_reset", f"{_INDEX_SQL} SELECT path, hash FROM listed")
def _index_reset(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.commit(META, _listed(spark, sf_dir).withColumn("facts", F.lit(None).cast(FACTS_TYPE)), reset=True)
    return store.files().select("path", "hash")


@register("index_meta", f"SELECT {SCHEMA_VERSION} AS schema_version, '{PARSER_VERSION}' AS parser_version, sha1('{{\"languages\":[\"python\"],\"maxFileBytes\":1000}}') AS config_hash, 'docs' AS root, FALSE AS other_version")
def _index_meta(spark, sf_dir):
    store = _store(spark, sf_dir)
    found = store.meta()
    store.commit(StoreMeta(SCHEMA_VERSION - 1, PARSER_VERSION, found.config_hash, found.root))
    row = (found.schema_version, found.parser_version, found.config_hash, found.root, store.meta() is not None)
    return spark.createDataFrame([row], "schema_version int, parser_version string, config_hash string, root string, other_version boolean")


@register("index_status", f"""{GRAPH_SQL}, d AS (SELECT * FROM documents WHERE doc_id % 7 <> 0)
SELECT (SELECT count(*) FROM d) AS files, (SELECT CAST(sum(length(text)) AS BIGINT) FROM d) AS source_bytes, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 'docs' AS root""")
def _index_status(spark, sf_dir):
    found = _store(spark, sf_dir).status()
    return found.select("files", "source_bytes", F.col("nodes").cast("long").alias("nodes"), F.col("edges").cast("long").alias("edges"), "root")


@register("index_graph", f"{GRAPH_SQL} SELECT kind, count(*) AS n, CAST(sum(ord % 1000003) AS BIGINT) AS marks FROM edges GROUP BY kind")
def _index_graph(spark, sf_dir):
    loaded = _updated(spark, sf_dir).load_graph()  # the second commit had no graph and left the first one's
    return loaded.edges().groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("ord") % 1000003).alias("marks"))


@register("index_list", "SELECT 'a.index' AS name, count(*) AS files FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'b.index', 0")
def _index_list(spark, sf_dir):
    home = new_path(spark, "indexes")
    ParquetStore(spark, f"{home}/a.index").commit(META, _known(spark, sf_dir), reset=True)
    ParquetStore(spark, f"{home}/b.index").commit(META, reset=True)
    return list_indexes(spark, home).select("name", "files")


@register("index_conflict", "SELECT 'CODEGRAPH_INDEX_CONFLICT' AS code, count(*) AS files FROM documents WHERE doc_id % 7 <> 0")
def _index_conflict(spark, sf_dir):
    """Two writers that began from one version: the second is refused and what the first wrote stays."""
    from lodestone.errors import ToolkitError

    store, code = ParquetStore(spark, new_path(spark, "index")), None
    before = store.version()
    store.commit(META, _known(spark, sf_dir), reset=True)
    try:
        ParquetStore(spark, store.folder).commit(META, reset=True, expected=before)
    except ToolkitError as error:
        code = error.code
    return store.files().agg(F.count("*").alias("files")).select(F.lit(code).alias("code"), "files")


# A tree of real files: written to the shared folder, scanned, built, changed and built again.


def _write_tree(rows: DataFrame, root: str) -> None:
    def run(batches):
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                fs.create_dir(posixpath.dirname(f"{top}/{path}"))
                with fs.open_output_stream(f"{top}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    rows.select("path", "content").mapInArrow(run, "path string").count()


def _tree(spark, sf_dir) -> str:
    root = new_path(spark, "tree")
    _write_tree(files(spark, sf_dir, ("nation", "supplier")), root)
    return root


_TREE_SQL = f"tree AS (SELECT * FROM ({FILES_SQL}) WHERE path NOT LIKE 'part/%')"


@register("tree_scan", f"WITH {_TREE_SQL} SELECT path, language, CAST(strlen(content) AS BIGINT) AS size FROM tree WHERE language = 'typescript' AND path NOT LIKE 'geo/%' AND strlen(content) <= 215")
def _tree_scan(spark, sf_dir):
    root = _tree(spark, sf_dir)
    extra = [("node_modules/x.ts", b"function a() {}"), ("sup/build/y.ts", b"function b() {}"), ("notes.md", b"# none"), ("sup/deep/er/huge.ts", b"/" * 5000)]
    _write_tree(spark.createDataFrame(extra, "path string, content binary"), root)
    return scan(spark, root, languages=["typescript"], ignore=["geo"], max_file_bytes=215, folders_at_once=1).select("path", "language", "size")


@register("tree_builds", f"""WITH {_TREE_SQL}, n AS (SELECT count(*) AS files, count(*) FILTER (WHERE path LIKE 'sup/%') AS sup FROM tree)
SELECT 1 AS build, files, files AS parsed, 0 AS reused, 0 AS deleted, sup AS functions FROM n UNION ALL SELECT 2, files, 0, files, 0, sup FROM n
UNION ALL SELECT 3, files, 1, files - 1, 0, sup + 1 FROM n UNION ALL SELECT 4, files - 1, 0, files - 1, 1, sup - 1 FROM n UNION ALL SELECT 5, files - 1, files - 1, 0, 0, sup - 1 FROM n""")
def _tree_builds(spark, sf_dir):
    """From nothing; unchanged; one file changed; that file gone; the configuration changed."""
    root, store, stats, rows = _tree(spark, sf_dir), ParquetStore(spark, new_path(spark, "index")), [], []

    def build(**options):
        built = build_code_graph(spark, root, store=store, on_stats=stats.append, **options)
        s = stats[-1]
        rows.append((len(rows) + 1, s.files, s.parsed, s.reused, s.deleted, built.symbols().where("symbol_kind = 'function' and path like 'sup/%'").count()))

    build()
    build()
    _write_tree(spark.createDataFrame([("sup/s1.ts", b"export function supply1() {}\nfunction more() {}\n")], "path string, content binary"), root)
    build(persist_graph=False)
    fs, top = pyarrow.fs.FileSystem.from_uri(root)
    fs.delete_file(f"{top}/sup/s1.ts")
    build()
    build(max_file_bytes=100_000)
    return spark.createDataFrame(rows, "build int, files long, parsed long, reused long, deleted long, functions long")


_COUNTED = "kind, count(*) AS n, count(confidence) AS with_confidence, CAST(sum(coalesce(call_count, 0)) AS BIGINT) AS calls"


@register("graph_json", f"{GRAPH_SQL}, files AS (SELECT id FROM nodes WHERE kind = 'file') SELECT 'lines' AS form, {_COUNTED} FROM edges GROUP BY kind UNION ALL SELECT 'document', {_COUNTED} FROM edges WHERE src IN (SELECT id FROM files) AND dst IN (SELECT id FROM files) GROUP BY kind")
def _graph_json(spark, sf_dir):
    """The whole graph as JSON lines and back; what lies between files, of which there are 30 at every size, as one document
    and back."""
    path = new_path(spark, "json")
    graph(spark, sf_dir).write_json(path)
    lines = CodeGraph.read_json(spark, path, unique_ids=True)
    ends = [lines.files().select(F.col("id").alias(c)) for c in ("src", "dst")]
    own = lines.edges().join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi")
    again = CodeGraph.from_json(spark, CodeGraph(lines.files(), own, True).to_json())
    both = lines.edges().withColumn("form", F.lit("lines")).unionByName(again.edges().withColumn("form", F.lit("document")))
    return both.groupBy("form", "kind").agg(F.count("*").alias("n"), F.count("confidence").alias("with_confidence"), F.sum(F.coalesce("call_count", F.lit(0))).alias("calls"))


@register("ignored_paths", "SELECT doc_id, list_has_any(string_split(replace(path, chr(92), '/'), '/'), ['node_modules', '.git', '.codegraph', 'dist', 'build', 'out', 'coverage', '.next', '.nuxt', '.turbo', 'vendor', '__pycache__']) AS ignored FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a/node_modules/b.ts' WHEN 1 THEN 'a' || chr(92) || 'dist' || chr(92) || 'x.js' WHEN 2 THEN 'building/out.ts' WHEN 3 THEN source || '/x.py' ELSE 'vendor' END AS path FROM documents)")
def _ignored_paths(spark, sf_dir):
    kind = F.col("doc_id") % 5
    path = F.when(kind == 0, "a/node_modules/b.ts").when(kind == 1, "a\\dist\\x.js").when(kind == 2, "building/out.ts").when(kind == 3, F.concat("source", F.lit("/x.py"))).otherwise("vendor")
    return table(spark, sf_dir, "documents").select("doc_id", ignored_column(path, DEFAULT_IGNORE).alias("ignored"))


@register("languages", """SELECT * FROM (VALUES ('.js', 'javascript', 'esm-relative', 'js'), ('.jsx', 'javascript', 'esm-relative', 'js'), ('.mjs', 'javascript', 'esm-relative', 'js'), ('.cjs', 'javascript', 'esm-relative', 'js'),
('.ts', 'typescript', 'esm-relative', 'js'), ('.mts', 'typescript', 'esm-relative', 'js'), ('.cts', 'typescript', 'esm-relative', 'js'), ('.tsx', 'tsx', 'esm-relative', 'js'), ('.py', 'python', 'python', 'python'), ('.pyi', 'python', 'python', 'python'),
('.go', 'go', 'none', 'go'), ('.cs', 'csharp', 'none', 'csharp'), ('.java', 'java', 'none', 'java'), ('.rs', 'rust', 'none', 'rust')) AS t(ext, language, import_style, family)""")
def _languages(spark, sf_dir):
    return languages_table(spark)


_ASKED = "Which SMALL ring suits the gadget?"
_SEEDED = " OR ".join(f"(kind = 'symbol' AND (contains(lower(name), '{w}') OR contains('{w}', lower(name))))" for w in ("which", "small", "ring", "suits", "gadget"))


@register("retrieval", f"""{pagerank_sql(_SEEDED, ITERATIONS)}, best AS (SELECT id, name, path, start_line, end_line, k{ITERATIONS}.score FROM k{ITERATIONS} JOIN nodes USING (id) WHERE kind = 'symbol' ORDER BY k{ITERATIONS}.score DESC, id LIMIT 6)
SELECT id, name, path || ':' || start_line || '-' || end_line AS "where", array_to_string(list_transform(range(start_line, end_line + 1), lambda i: 'line ' || i || ' of ' || path), chr(10)) AS snippet FROM best""")
def _retrieval(spark, sf_dir):
    g = graph(spark, sf_dir)
    lines = F.transform(F.sequence(F.lit(1), F.lit(1010)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), F.col("path")))
    contents = g.symbols().select("path").distinct().select("path", F.array_join(lines, "\n").alias("content"))
    return context_rows(g, contents, _ASKED).select("id", "name", "where", "snippet")
