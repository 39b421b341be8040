"""Command line: build a graph, keep an index of it, and ask it.

    python -m lodestone build DIR [--json OUT] [--json-lines OUT]
    python -m lodestone index DIR INDEX
    python -m lodestone sync DIR INDEX            (index, then what it did as JSON)
    python -m lodestone list HOME                  (the indexes in a folder)
    python -m lodestone status INDEX
    python -m lodestone ask INDEX TOOL [KEY=VALUE ...]
    python -m lodestone watch DIR INDEX
    python -m lodestone serve INDEX                (tools over standard input and output)
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from lodestone.errors import ToolkitError
from lodestone.operators.store import ParquetStore, build_code_graph, list_indexes
from lodestone.operators.tools import graph_capability
from lodestone.runtime import Runtime, collect_tools
from lodestone.serving import Server
from lodestone.streaming.watch import Served, Watcher


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _build(spark, args) -> None:
    began = time.time()
    graph = build_code_graph(spark, args.dir, store=ParquetStore(spark, args.index) if args.command == "index" else None, on_stats=lambda s: print(f"files {s.files}, parsed {s.parsed}, reused {s.reused}, deleted {s.deleted}"))
    if getattr(args, "json", None):
        with open(args.json, "w", encoding="utf-8") as out:
            out.write(graph.to_json())
    if getattr(args, "json_lines", None):
        graph.write_json(args.json_lines)
    for row in graph.language_histogram().orderBy("language").collect():
        print(f"{row.language:12} {row.n}")
    print(f"{graph.nodes().count()} nodes, {graph.edges().count()} edges in {time.time() - began:.1f} s")


def _sync(spark, args) -> None:
    """Brings an index up to date; says nothing but what it did."""
    store, seen = ParquetStore(spark, args.index), []
    before = store.version()
    build_code_graph(spark, args.dir, store=store, on_stats=seen.append)
    print(json.dumps({"files": seen[0].files, "parsed": seen[0].parsed, "reused": seen[0].reused, "deleted": seen[0].deleted, "from": before, "to": store.version(), "removed": store.vacuum()}))


def _loaded(spark, index: str):
    graph = ParquetStore(spark, index).load_graph()
    if graph is None:
        raise ToolkitError("CODEGRAPH_INDEX_UNREADABLE", f"no graph in {index}")
    return graph


def _serve(spark, args) -> None:
    runtime = Runtime(collect_tools([graph_capability(_loaded(spark, args.index))]), spark=spark)
    Server(runtime).serve(sys.stdin, sys.stdout)


def _ask(spark, args) -> None:
    graph = _loaded(spark, args.index)
    given = {}
    for pair in args.given:
        key, _, text = pair.partition("=")
        try:
            given[key] = json.loads(text)
        except ValueError:
            given[key] = text
    for row in Runtime(collect_tools([graph_capability(graph)]), spark=spark).execute_tool(f"codegraph_{args.tool}", given).toJSON().collect():
        print(row)


def _watch(spark, args) -> None:
    store = ParquetStore(spark, args.index)
    served = Served(store.load_graph() or build_code_graph(spark, args.dir, store=store))

    def rebuild():
        served.swap(build_code_graph(spark, args.dir, store=store, persist_graph=False))
        print(f"{served().nodes().count()} nodes", flush=True)

    watcher = Watcher(args.dir, rebuild, on_error=lambda e: print(e, file=sys.stderr))
    try:
        while watcher.started:
            time.sleep(1)
    except KeyboardInterrupt:
        watcher.close()
        build_code_graph(spark, args.dir, store=store)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("dir")
    one.add_argument("--json", help="one document")
    one.add_argument("--json-lines", help="two folders, for a graph of any size")
    for name in ("index", "sync", "watch"):
        one = commands.add_parser(name)
        one.add_argument("dir")
        one.add_argument("index")
    commands.add_parser("list").add_argument("home")
    for name in ("status", "serve"):
        commands.add_parser(name).add_argument("index")
    one = commands.add_parser("ask")
    one.add_argument("index")
    one.add_argument("tool")
    one.add_argument("given", nargs="*")
    args = parser.parse_args(argv)
    try:
        spark = _session()
        if args.command in ("build", "index"):
            _build(spark, args)
        elif args.command == "status":
            print(json.dumps(ParquetStore(spark, args.index).status().first().asDict(), indent=2))
        elif args.command == "list":
            for row in list_indexes(spark, args.home).toJSON().collect():
                print(row)
        elif args.command == "ask":
            _ask(spark, args)
        elif args.command == "sync":
            _sync(spark, args)
        elif args.command == "serve":
            _serve(spark, args)
        else:
            _watch(spark, args)
    except ToolkitError as error:
        print(f"{error.code}: {error.message}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
