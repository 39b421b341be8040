"""Queries that parse and resolve a small tree of sources; their results are stated row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.languages import languages_table
from lodestone.operators.build import graph_of
from lodestone.parsing import parse_files
from lodestone.plans import register

SOURCES = {
    "app/cart.ts": """import { Price, round } from './price'
export class Cart {
  private items = new Map()
  add(p: Price): number {
    p.check()
    return this.total()
  }
  total(): number { return round(sum()) }
}
function sum(): number { return 0 }
""",
    "app/price.ts": """export class Price {
  check(): void { audit(this) }
  static of(n: number): Price { return new Price() }
}
export const round = (n: number) => Math.floor(n)
""",
    "app/main.tsx": """import { Cart } from './cart'
import { Price } from './price'
export function main() {
  const cart = new Cart()
  cart.add(Price.of(3))
  cart.add(Price.of(4))
  thing.check()
}
""",
    "jobs/run.py": """from .tools import load
import jobs.tools

class Job:
    def start(self):
        rows = load()
        self.finish(rows)

    def finish(self, rows):
        audit(rows)

Job()
""",
    "jobs/tools.py": """def load():
    return audit([])


def audit(x):
    return x
""",
    "svc/server.go": """package svc
import "net/http"
type Server struct{}
func (s *Server) Listen() { s.accept(); log() }
func (s *Server) accept() {}
func log() {}
""",
    "notes.md": "# not a source\n",
}


def _files(spark):
    rows = [(k, p, s.encode()) for k, (p, s) in enumerate(sorted(SOURCES.items()))]
    files = spark.createDataFrame(rows, "file_no long, path string, content binary")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return parse_files(files.join(F.broadcast(languages_table(spark).select("ext", "language")), ext == F.col("ext")).select("file_no", "path", "language", "content"))


def _values(rows: str, columns: str) -> str:
    lines = [line.split() for line in rows.strip().splitlines()]
    quoted = ", ".join("(" + ", ".join(v if v.replace(".", "").isdigit() else "NULL" if v == "-" else f"'{v}'" for v in line) + ")" for line in lines)
    return f"SELECT * FROM (VALUES {quoted}) AS t({columns})"


_SYMBOLS = """
app/cart.ts Cart class 2 9
app/cart.ts items field 3 3
app/cart.ts add method 4 7
app/cart.ts total method 8 8
app/cart.ts sum function 10 10
app/price.ts Price class 1 4
app/price.ts check method 2 2
app/price.ts of method 3 3
app/price.ts round function 5 5
app/main.tsx main function 3 8
jobs/run.py Job class 4 10
jobs/run.py start function 5 7
jobs/run.py finish function 9 10
jobs/tools.py load function 1 2
jobs/tools.py audit function 5 6
svc/server.go Server type 3 3
svc/server.go Listen method 4 4
svc/server.go accept method 5 5
svc/server.go log function 6 6
"""


@register("build_symbols", _values(_SYMBOLS, "path, name, symbol_kind, start_line, end_line"))
def _build_symbols(spark, sf_dir):
    return graph_of(_files(spark)).symbols().select("path", "name", "symbol_kind", "start_line", "end_line")


#: One line a call edge: who, whom, confidence, kind, count, first line, receiver's type.
_CALLS = """
sym:app/cart.ts#add@4 sym:app/price.ts#check@2 0.8 call 1 5 Price
sym:app/cart.ts#add@4 sym:app/cart.ts#total@8 1.0 call 1 6 -
sym:app/cart.ts#total@8 sym:app/price.ts#round@5 0.8 call 1 8 -
sym:app/cart.ts#total@8 sym:app/cart.ts#sum@10 1.0 call 1 8 -
sym:app/price.ts#of@3 sym:app/price.ts#Price@1 0.8 new 1 3 -
sym:app/main.tsx#main@3 sym:app/cart.ts#Cart@2 0.8 new 1 4 -
sym:app/main.tsx#main@3 sym:app/cart.ts#add@4 0.8 call 2 5 Cart
sym:app/main.tsx#main@3 sym:app/price.ts#of@3 0.8 call 2 5 Price
sym:app/main.tsx#main@3 sym:app/price.ts#check@2 0.5 call 1 7 -
sym:jobs/run.py#start@5 sym:jobs/tools.py#load@1 0.8 call 1 6 -
sym:jobs/run.py#finish@9 sym:jobs/tools.py#audit@5 0.8 call 1 10 -
file:jobs/run.py sym:jobs/run.py#Job@4 1.0 call 1 12 -
sym:jobs/tools.py#load@1 sym:jobs/tools.py#audit@5 1.0 call 1 2 -
sym:svc/server.go#Listen@4 sym:svc/server.go#accept@5 0.5 call 1 4 -
sym:svc/server.go#Listen@4 sym:svc/server.go#log@6 1.0 call 1 4 -
"""


@register("build_calls", f"SELECT src, dst, CAST(confidence AS DOUBLE) AS confidence, call_kind, CAST(call_count AS BIGINT) AS call_count, line, receiver_type FROM ({_values(_CALLS, 'src, dst, confidence, call_kind, call_count, line, receiver_type')})")
def _build_calls(spark, sf_dir):
    return graph_of(_files(spark)).edges().where("kind = 'calls'").select("src", "dst", "confidence", "call_kind", "call_count", "line", "receiver_type")


_IMPORTS = """
file:app/cart.ts file:app/price.ts
file:app/main.tsx file:app/cart.ts
file:app/main.tsx file:app/price.ts
file:jobs/run.py file:jobs/tools.py
"""


@register("build_imports", _values(_IMPORTS, "src, dst"))
def _build_imports(spark, sf_dir):
    return graph_of(_files(spark)).edges().where("kind = 'imports'").select("src", "dst")


#: References go by name across languages, a name that one definition only has or that the file itself defines.
_REFERENCES = """
sym:app/cart.ts#add@4 sym:app/price.ts#check@2
sym:app/cart.ts#add@4 sym:app/cart.ts#total@8
sym:app/cart.ts#total@8 sym:app/price.ts#round@5
sym:app/cart.ts#total@8 sym:app/cart.ts#sum@10
sym:app/price.ts#check@2 sym:jobs/tools.py#audit@5
sym:app/price.ts#of@3 sym:app/price.ts#Price@1
sym:app/main.tsx#main@3 sym:app/cart.ts#Cart@2
sym:app/main.tsx#main@3 sym:app/cart.ts#add@4
sym:app/main.tsx#main@3 sym:app/price.ts#of@3
sym:app/main.tsx#main@3 sym:app/price.ts#check@2
sym:jobs/run.py#start@5 sym:jobs/tools.py#load@1
sym:jobs/run.py#start@5 sym:jobs/run.py#finish@9
sym:jobs/run.py#finish@9 sym:jobs/tools.py#audit@5
file:jobs/run.py sym:jobs/run.py#Job@4
sym:jobs/tools.py#load@1 sym:jobs/tools.py#audit@5
sym:svc/server.go#Listen@4 sym:svc/server.go#accept@5
sym:svc/server.go#Listen@4 sym:svc/server.go#log@6
"""


@register("build_references", _values(_REFERENCES, "src, dst"))
def _build_references(spark, sf_dir):
    return graph_of(_files(spark)).edges().where("kind = 'references'").select("src", "dst")
