"""From facts of files to the property graph.

What concerns one file only (innermost enclosing symbol and class, the class of a method, the type of a variable) is
settled file by file on its arrays, without a shuffle. What crosses files is equi-joins with tables aggregated by name:
the first definition in a file, the only one of a name, the methods of a class.
"""

from __future__ import annotations

import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.languages import languages_table
from lodestone.operators.graph import CodeGraph, aggregate_calls
from lodestone.schema import EXACT, HIGH, MEDIUM
from lodestone.staging import staged

#: ord = phase, number of the file, place in it.
_PHASE, _FILE = 1 << 58, 1 << 24
#: Fixed value: extensions that an import of a script may leave out, in order.
_SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")

#: Files whose rows a task gives at once.
_FILES_AT_ONCE = 64
_LOCAL = pa.schema(
    [("file_no", pa.int64()), *((c, pa.string()) for c in ("path", "language")), ("nth", pa.int32()), ("is_def", pa.bool_()), *((c, pa.string()) for c in ("id", "name", "kind")), ("start_line", pa.int32()), ("end_line", pa.int32()), ("owner", pa.string()),
     ("line", pa.int32()), ("receiver", pa.string()), ("is_new", pa.bool_()), *((c, pa.string()) for c in ("src", "own_class", "receiver_type"))]
)
_LOCAL_TYPES = "file_no long, path string, language string, nth int, is_def boolean, id string, name string, kind string, start_line int, end_line int, owner string, line int, receiver string, is_new boolean, src string, own_class string, receiver_type string"


def file_id(path: str) -> str:
    return f"file:{path}"


def symbol_id(path: str, name: str, line: int) -> str:
    return f"sym:{path}#{name}@{line}"


class _Scopes:
    """Ranges of definitions, for the innermost one that holds a place."""

    def __init__(self, defs: list[tuple[int, int, str]]):
        # by start, the first of equal starts last, so that a scan from the right meets the winner first
        self.rows = sorted(((s, -k, e, i) for k, (s, e, i) in enumerate(defs)))
        self.starts = [r[0] for r in self.rows]
        self.up = []  # for each row the next one to the left that ends later
        stack: list[int] = []
        for k, r in enumerate(self.rows):
            while stack and self.rows[stack[-1]][2] <= r[2]:
                stack.pop()
            self.up.append(stack[-1] if stack else -1)
            stack.append(k)

    def at(self, place: int) -> str | None:
        from bisect import bisect_right

        k = bisect_right(self.starts, place) - 1
        while k >= 0 and self.rows[k][2] < place:
            k = self.up[k]
        return self.rows[k][3] if k >= 0 else None


def _local(facts: dict, path: str) -> tuple[list[tuple], list[tuple]]:
    """Definition and reference rows of one file."""
    found = facts["definitions"] or []
    ids = [symbol_id(path, d["name"], d["startLine"]) for d in found]
    spans = [(d["startIndex"], d["endIndex"], i) for d, i in zip(found, ids)]
    classes = [s for s, d in zip(spans, found) if d["kind"] in ("class", "interface")]
    symbol_scopes, class_scopes = _Scopes(spans), _Scopes(classes)
    types: dict[str, set[str]] = {}
    for b in facts["typeBindings"] or []:
        types.setdefault(b["name"], set()).add(b["type"])
    defs = []
    for k, (d, i) in enumerate(zip(found, ids)):
        owner = None
        if d["kind"] in ("method", "field"):
            owner = next((c for s, e, c in classes if s <= d["startIndex"] and d["endIndex"] <= e), None)
        defs.append((k, i, d["name"], d["kind"], d["startLine"], d["endLine"], owner))
    refs = []
    for k, r in enumerate(facts["references"] or []):
        known = types.get(r["receiver"] or "", ())
        kind = next(iter(known)) if len(known) == 1 else None
        refs.append((k, r["name"], r["line"], r["receiver"], bool(r["isNew"]), symbol_scopes.at(r["startIndex"]) or file_id(path), class_scopes.at(r["startIndex"]), kind))
    return defs, refs


def _local_batches(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, _FILES_AT_ONCE):
            rows = []
            for number, path, language, facts in zip(*(c.to_pylist() for c in batch.slice(k, _FILES_AT_ONCE).columns)):
                defs, refs = _local(facts, path)
                rows += [(number, path, language, nth, True, *d, None, None, None, None, None, None) for nth, *d in defs]
                rows += [(number, path, language, nth, False, None, name, None, None, None, None, *r) for nth, name, *r in refs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LOCAL)], _LOCAL.names)


def local_rows(files: DataFrame) -> DataFrame:
    """Definition and reference rows of all files, told apart by is_def: one pass over the facts."""
    return files.select("file_no", "path", "language", "facts").mapInArrow(_local_batches, _LOCAL_TYPES)


def import_candidates(style: str, path: str, raw: str) -> list[str]:
    """Paths that an import may mean, the likeliest first."""
    join, here = posixpath.join, posixpath.dirname(path)
    clean = lambda p: posixpath.normpath(p) + ("/" if p.endswith("/") and posixpath.normpath(p) != "/" else "")
    if style == "esm-relative":
        if not raw.startswith("."):
            return []
        base = clean(join(here or ".", raw))
        return [base, *(base + e for e in _SCRIPT_EXTENSIONS), *(posixpath.normpath(join(base, "index" + e)) for e in _SCRIPT_EXTENSIONS)]
    if style == "python":
        dots = len(re.match(r"\.*", raw)[0])
        module = raw[dots:].replace(".", "/")
        if dots:
            for _ in range(dots - 1):
                here = posixpath.dirname(here)
            module = posixpath.normpath(join(here or ".", module)) if module else here or "."
        return [module + ".py", posixpath.normpath(join(module, "__init__.py"))]
    return []


def _segments(path: Column) -> Column:
    """The segments of a relative path without empty ones and dots; ``..`` takes away the one before it."""
    real = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda kept, x: (x == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
    return F.aggregate(real, F.array().cast("array<string>"), lambda kept, x: F.when(up(kept, x), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(x))))


def _joined(segments: Column) -> Column:
    return F.when(F.size(segments) == 0, F.lit(".")).otherwise(F.array_join(segments, "/"))


def candidates_column(style: Column, path: Column, raw: Column) -> Column:
    """``import_candidates`` in expressions."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    script = _segments(F.array_join(F.concat(folder, F.array(raw)), "/"))
    base = F.concat(_joined(script), F.when(F.endswith(raw, F.lit("/")), F.lit("/")).otherwise(F.lit("")))
    inside = _joined(script)
    esm = F.array(base, *(F.concat(base, F.lit(e)) for e in _SCRIPT_EXTENSIONS), *(F.when(inside == ".", F.lit(f"index{e}")).otherwise(F.concat(inside, F.lit(f"/index{e}"))) for e in _SCRIPT_EXTENSIONS))
    dots = F.length(F.regexp_extract(raw, r"^\.*", 0))
    named = F.replace(F.substr(raw, dots + 1), F.lit("."), F.lit("/"))
    above = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0)))
    module = F.when(dots == 0, named).when(named != "", _joined(_segments(F.array_join(F.concat(above, F.array(named)), "/")))).otherwise(_joined(above))
    package = _joined(_segments(F.concat(module, F.lit("/__init__.py"))))
    python = F.array(F.concat(module, F.lit(".py")), package)
    return F.when((style == "esm-relative") & F.startswith(raw, F.lit(".")), esm).when(style == "python", python)


def resolve_imports(files: DataFrame) -> DataFrame:
    """Rows (file_no, path, nth, target): the first candidate of each import that is a scanned file."""
    styles = languages_table(files.sparkSession).select("language", "import_style").distinct()
    rows = files.select("file_no", "path", "language", F.posexplode("facts.imports.raw").alias("nth", "raw")).join(F.broadcast(styles), "language").where("import_style <> 'none'")
    ways = rows.select("file_no", "path", "nth", F.posexplode(candidates_column(F.col("import_style"), F.col("path"), F.col("raw"))).alias("choice", "target"))
    return ways.join(files.select(F.col("path").alias("target")), "target").groupBy("file_no", "path", "nth").agg(F.min_by("target", "choice").alias("target"))


def _first_here(defs: DataFrame, name: str) -> DataFrame:
    return defs.groupBy("path", F.col("name").alias(name)).agg(F.min_by("id", "nth").alias("here"))


def _only(defs: DataFrame, name: str) -> DataFrame:
    """The id of a name that one row only has in its family."""
    return defs.groupBy("family", F.col("name").alias(name)).agg(F.count("*").alias("n"), F.first("id").alias("only")).where("n = 1").drop("n")


def _pick(refs: DataFrame, classes: DataFrame, name: str, into: str) -> DataFrame:
    """The class that ``name`` means: the first of the file, else the only one of the family."""
    joined = refs.join(_first_here(classes, name), ["path", name], "left").join(_only(classes, name), ["family", name], "left")
    return joined.withColumn(into, F.coalesce("here", "only")).drop("here", "only")


_SITE = ["src", "target", "confidence", "is_new", "line", "site_type", "file_no", "nth"]


def _site(df: DataFrame, target, confidence, site_type=None) -> DataFrame:
    found = df.withColumn("target", target).withColumn("confidence", confidence if not isinstance(confidence, float) else F.lit(confidence))
    return found.withColumn("site_type", site_type if site_type is not None else F.lit(None).cast("string")).where("target is not null").select(*_SITE)


def resolve_calls(defs: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """Call sites (src, dst, confidence, is_new, line, receiver_type, ord) that a rule resolves.

    Every reference falls under one of four kinds by its own fields, and each kind has its joins: ``new X``, ``this.m``,
    ``x.m``, and bare calls. Nothing falls through from one kind to another.
    """
    classes = defs.where("kind in ('class', 'interface')")
    methods = defs.where("kind in ('method', 'field')")
    by_class = methods.where("owner is not null").groupBy(F.col("owner").alias("class_id"), F.col("name").alias("method")).agg(F.min_by("id", F.struct("file_no", "nth")).alias("method_id"))

    def of_class(df: DataFrame, cls: str, into: str) -> DataFrame:
        own = by_class.select(F.col("class_id").alias(cls), F.col("method").alias("name"), F.col("method_id").alias(into))
        return df.join(own, [cls, "name"], "left")

    made = refs.where("is_new")
    sites = _site(_pick(made, classes, "name", "cls"), F.col("cls"), HIGH)

    own = refs.where("not is_new and receiver in ('this', 'self')")
    sites = sites.unionByName(_site(of_class(own, "own_class", "m"), F.col("m"), EXACT))

    members = refs.where("not is_new and receiver is not null and receiver not in ('this', 'self')")
    members = _pick(members, classes, "receiver_type", "typed_class")
    members = _pick(members, classes, "receiver", "static_class")
    members = of_class(of_class(members, "typed_class", "typed"), "static_class", "static")
    members = members.join(_only(methods, "name"), ["family", "name"], "left")
    how = F.when(F.col("typed").isNotNull(), F.col("receiver_type")).when(F.col("static").isNotNull(), F.col("receiver"))
    sites = sites.unionByName(_site(members, F.coalesce("typed", "static", "only"), F.when(how.isNotNull(), HIGH).otherwise(MEDIUM), how))

    bare = refs.where("not is_new and receiver is null").join(_first_here(defs, "name"), ["path", "name"], "left").join(_only(defs, "name"), ["family", "name"], "left")
    wanted = refs.where("not is_new and receiver is null").select("path", "name", "family").distinct()
    reach = wanted.join(imports.select("path", "target").distinct(), "path")
    there = reach.join(defs.select(F.col("path").alias("target"), "name", "family", "id"), ["target", "name", "family"])
    imported = there.groupBy("path", "name", "family").agg(F.count("*").alias("n"), F.first("id").alias("imported")).where("n = 1").drop("n")
    bare = bare.join(imported, ["path", "name", "family"], "left")
    sites = sites.unionByName(_site(bare, F.coalesce("here", "imported", "only"), F.when(F.col("here").isNotNull(), EXACT).otherwise(HIGH)))
    return sites.select("src", F.col("target").alias("dst"), "confidence", "is_new", "line", F.col("site_type").alias("receiver_type"), (F.lit(2 * _PHASE) + F.col("file_no") * _FILE + F.col("nth")).alias("ord"))


def graph_of(files: DataFrame) -> CodeGraph:
    """The graph of ``files(file_no, path, language, facts)``.

    Contains edges are one a definition; the others are distinct by (kind, src, dst) without self-loops, each at the
    place of its first cause. Definitions, references and imports are written; nodes and edges are plans over them
    (``CodeGraph.staged`` writes those too).
    """
    spark = files.sparkSession
    family = languages_table(spark).select("language", "family").distinct()
    files = files.where("facts is not null")
    local = staged(local_rows(files).join(F.broadcast(family), "language"), "local", "is_def")
    defs = local.where("is_def").select("file_no", "path", "language", "family", "nth", "id", "name", "kind", "start_line", "end_line", "owner")
    refs = local.where("not is_def").select("file_no", "path", "language", "family", "nth", "name", "line", "receiver", "is_new", "src", "own_class", "receiver_type")
    imports = staged(resolve_imports(files), "imports")
    none = lambda kind: F.lit(None).cast(kind)
    place = F.col("file_no") * _FILE
    file_nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), none("string").alias("name"), none("string").alias("symbol_kind"), "path", "language", none("int").alias("start_line"), none("int").alias("end_line"), place.alias("ord"))
    symbols = defs.select("id", F.lit("symbol").alias("kind"), "name", F.col("kind").alias("symbol_kind"), "path", none("string").alias("language"), "start_line", "end_line", (place + 1 + F.col("nth")).alias("ord"))

    def plain(df: DataFrame, kind: str) -> DataFrame:
        return df.select("src", "dst", F.lit(kind).alias("kind"), none("double").alias("confidence"), none("string").alias("call_kind"), none("string").alias("receiver_type"), none("long").alias("call_count"), none("int").alias("line"), "ord")

    def once(df: DataFrame) -> DataFrame:
        return df.where("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord"))

    here = F.concat(F.lit("file:"), F.col("path"))
    contains = defs.select(here.alias("src"), F.col("id").alias("dst"), (place + F.col("nth")).alias("ord"))
    imported = imports.select(here.alias("src"), F.concat(F.lit("file:"), "target").alias("dst"), (F.lit(_PHASE) + place + F.col("nth")).alias("ord"))
    first = _first_here(defs, "name")
    only = defs.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("only")).where("n = 1").drop("n")
    named = refs.join(first, ["path", "name"], "left").join(only, "name", "left").withColumn("dst", F.coalesce("here", "only")).where("dst is not null")
    referred = named.select("src", "dst", (F.lit(_PHASE) + place + F.lit(_FILE // 2) + F.col("nth")).alias("ord"))
    calls = aggregate_calls(resolve_calls(defs, refs, imports)).withColumn("kind", F.lit("calls"))
    edges = plain(contains, "contains").unionByName(plain(once(imported), "imports")).unionByName(plain(once(referred), "references")).unionByName(calls)
    return CodeGraph(file_nodes.unionByName(symbols), edges)
