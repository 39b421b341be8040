"""A source tree that grows with the relational tables: eight languages, imports, calls of every kind.

Each nation, supplier and part is one source file or two, made from a template by its key. What parsing and resolving
must find in it is stated beside the template, for the SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.build import graph_of
from lodestone.operators.graph import CodeGraph
from lodestone.parsing import parse_files
from lodestone.plans.fkgraph import table
from lodestone.staging import staged


@dataclass(frozen=True)
class Source:
    """Files of one kind: ``{k}`` stands for the row's key, ``{n}`` for its nation.

    symbols: (name, kind, first line, last line). calls: (from, to, confidence, kind, line, receiver's type, times); an
    end is a number in symbols, or the id of another source's symbol. imports: paths.
    """

    rows: str
    key: str
    where: str
    nation: str
    path: str
    language: str
    text: str
    symbols: tuple = ()
    calls: tuple = ()
    imports: tuple = ()


def _sym(path: str, name: str, line: int) -> str:
    return f"sym:{path}#{name}@{line}"


_NATION, _AUDIT = "geo/n{n}.ts", "lib/audit{n}.js"
_PARTS = 6

SOURCES = (
    Source(
        "nation", "n_nationkey", "TRUE", "n_nationkey", "geo/n{k}.ts", "typescript",
        "export class Nation{k} {\n  visit{k}(): number { return this.size{k}() }\n  size{k}(): number { return 2 }\n}\nexport function shared(): number { return 3 }\n",
        (("Nation{k}", "class", 1, 4), ("visit{k}", "method", 2, 2), ("size{k}", "method", 3, 3), ("shared", "function", 5, 5)), ((1, 2, 1.0, "call", 2, None, 1),),
    ),
    Source("nation", "n_nationkey", "TRUE", "n_nationkey", "lib/audit{k}.js", "javascript", "function audit{k}() {\n  return 0\n}\n", (("audit{k}", "function", 1, 3),)),
    Source(
        "supplier", "s_suppkey", "TRUE", "s_nationkey", "sup/s{k}.ts", "typescript",
        "import { Nation{n} } from '../geo/n{n}'\nexport function supply{k}(): void {\n  const x = new Nation{n}()\n  x.visit{n}()\n  audit{n}()\n  audit{n}()\n  shared()\n}\n",
        (("supply{k}", "function", 2, 8),),
        ((0, _sym(_NATION, "Nation{n}", 1), 0.8, "new", 3, None, 1), (0, _sym(_NATION, "visit{n}", 2), 0.8, "call", 4, "Nation{n}", 1), (0, _sym(_AUDIT, "audit{n}", 1), 0.8, "call", 5, None, 2), (0, _sym(_NATION, "shared", 5), 0.8, "call", 7, None, 1)),
        (_NATION,),
    ),
    Source(
        "part", "p_partkey", f"p_partkey % {_PARTS} = 0", "0", "part/Part{k}.java", "java",
        "public class Part{k} {\n    int run{k}() {\n        return help{k}(1);\n    }\n    int help{k}(int x) {\n        return x;\n    }\n}\n",
        (("Part{k}", "class", 1, 8), ("run{k}", "method", 2, 4), ("help{k}", "method", 5, 7)), ((1, 2, 1.0, "call", 3, None, 1),),
    ),
    Source(
        "part", "p_partkey", f"p_partkey % {_PARTS} = 1", "0", "part/Part{k}.cs", "csharp",
        "public class Part{k}\n{\n    public int run{k}()\n    {\n        return help{k}(1);\n    }\n    private int help{k}(int x)\n    {\n        return x;\n    }\n}\n",
        (("Part{k}", "class", 1, 11), ("run{k}", "method", 3, 6), ("help{k}", "method", 7, 10)), ((1, 2, 1.0, "call", 5, None, 1),),
    ),
    Source(
        "part", "p_partkey", f"p_partkey % {_PARTS} = 2", "0", "part/part{k}.rs", "rust",
        "fn help{k}(x: i32) -> i32 {\n    x\n}\npub fn run{k}() -> i32 {\n    help{k}(1)\n}\nstruct Part{k};\n",
        (("help{k}", "function", 1, 3), ("run{k}", "function", 4, 6), ("Part{k}", "class", 7, 7)), ((1, 0, 1.0, "call", 5, None, 1),),
    ),
    Source(
        "part", "p_partkey", f"p_partkey % {_PARTS} = 3", "0", "part/part{k}.go", "go",
        "package part\ntype Part{k} struct{}\nfunc (t *Part{k}) run{k}() { t.help{k}() }\nfunc (t *Part{k}) help{k}() {}\n",
        (("Part{k}", "type", 2, 2), ("run{k}", "method", 3, 3), ("help{k}", "method", 4, 4)), ((1, 2, 0.5, "call", 3, None, 1),),
    ),
    Source(
        "part", "p_partkey", f"p_partkey % {_PARTS} = 4", "0", "part/part{k}.py", "python",
        "class Part{k}:\n    def run{k}(self):\n        return help{k}(1)\n\ndef help{k}(x):\n    return x\n",
        (("Part{k}", "class", 1, 3), ("run{k}", "function", 2, 3), ("help{k}", "function", 5, 6)), ((1, 2, 1.0, "call", 3, None, 1),),
    ),
    Source(
        "part", "p_partkey", f"p_partkey % {_PARTS} = 5", "0", "part/part{k}.tsx", "tsx",
        "export const help{k} = (x: number) => x\nexport function run{k}() {\n  return help{k}(1)\n}\n",
        (("help{k}", "function", 1, 1), ("run{k}", "function", 2, 4)), ((1, 0, 1.0, "call", 3, None, 1),),
    ),
)


def _filled(template: str, key: Column, nation: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), key.cast("string")), F.lit("{n}"), nation.cast("string"))


def files(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("nation", "supplier", "part")) -> DataFrame:
    """Rows (file_no, path, language, content) of the sources made from the rows of some tables."""
    out = None
    for k, s in enumerate(SOURCES):
        if s.rows not in kinds:
            continue
        key, nation = F.col(s.key), F.expr(s.nation)
        rows = table(spark, sf_dir, s.rows).where(s.where)
        made = rows.select((F.lit(k * 10**9) + key).cast("long").alias("file_no"), _filled(s.path, key, nation).alias("path"), F.lit(s.language).alias("language"), F.encode(_filled(s.text, key, nation), "UTF-8").alias("content"))
        out = made if out is None else out.unionByName(made)
    return out


def code_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return graph_of(staged(parse_files(files(spark, sf_dir)), "facts"))


def _text(template: str) -> str:
    """A template as a SQL expression over columns k and n."""
    quoted = template.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"replace(replace('{quoted}', '{{k}}', k::VARCHAR), '{{n}}', n::VARCHAR)"


def _rows(s: Source) -> str:
    return f"(SELECT {s.key} AS k, {s.nation} AS n FROM {s.rows} WHERE {s.where})"


def _end(s: Source, end) -> str:
    return _text(_sym(s.path, s.symbols[end][0], s.symbols[end][2]) if isinstance(end, int) else end)


def _null(value) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else _text(value)


FILES_SQL = "\nUNION ALL ".join(f"SELECT {_text(s.path)} AS path, '{s.language}' AS language, {_text(s.text)} AS content FROM {_rows(s)}" for s in SOURCES)
SYMBOLS_SQL = "\nUNION ALL ".join(f"SELECT {_text(s.path)} AS path, {_text(name)} AS name, '{kind}' AS symbol_kind, {first} AS start_line, {last} AS end_line FROM {_rows(s)}" for s in SOURCES for name, kind, first, last in s.symbols)
CONTAINS_SQL = "\nUNION ALL ".join(f"SELECT 'file:' || {_text(s.path)} AS src, {_end(s, k)} AS dst FROM {_rows(s)}" for s in SOURCES for k in range(len(s.symbols)))
IMPORTS_SQL = "\nUNION ALL ".join(f"SELECT 'file:' || {_text(s.path)} AS src, 'file:' || {_text(to)} AS dst FROM {_rows(s)}" for s in SOURCES for to in s.imports)
CALLS_SQL = "\nUNION ALL ".join(
    f"SELECT {_end(s, a)} AS src, {_end(s, b)} AS dst, {confidence}::DOUBLE AS confidence, '{kind}' AS call_kind, {_null(receiver)} AS receiver_type, CAST({count} AS BIGINT) AS call_count, {line} AS line FROM {_rows(s)}"
    for s in SOURCES
    for a, b, confidence, kind, line, receiver, count in s.calls
)
#: A call is a reference too where its name is defined once; ``shared``, which each nation defines, is found by imports only.
REFERENCES_SQL = "\nUNION ALL ".join(f"SELECT {_end(s, a)} AS src, {_end(s, b)} AS dst FROM {_rows(s)}" for s in SOURCES for a, b, *_ in s.calls if "#shared@" not in str(b))
