"""python -m quarry QUERY [PATH...]: ranked or exact search of text files; python -m quarry index|status|evict|clear PATH.

Exit codes: 0 with hits, 1 without, 2 on an error.
"""

from __future__ import annotations

import argparse
import sys

from quarry.functions.text import parse_lines, parse_top
from quarry.operators.chunking import ChunkParams


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("query", nargs="?", default="", help="a query; phrases are split by |")
    p.add_argument("paths", nargs="*", default=[], help="folders or files; - reads them from standard input")
    p.add_argument("-e", dest="pattern", help="exact search for a regular expression")
    p.add_argument("-i", dest="ignore_case", action="store_true")
    p.add_argument("-F", dest="literal", action="store_true")
    p.add_argument("-w", dest="word", action="store_true")
    p.add_argument("-c", dest="count", action="store_true", help="hits by file")
    p.add_argument("-l", dest="files", action="store_true", help="files in rank order")
    p.add_argument("-k", dest="k", type=parse_top, default=5)
    p.add_argument("-g", dest="globs", action="append", default=[])
    p.add_argument("-C", dest="around", type=int, default=0, help="lines of context of an exact hit")
    p.add_argument("--lines", type=parse_lines)
    p.add_argument("--all", action="store_true", help="print every exact hit")
    p.add_argument("--json", action="store_true")
    p.add_argument("--mode", choices=["keyword", "bm25", "semantic", "hybrid"])
    p.add_argument("--index", help="the folder of a persisted index; for evict and clear, the folder that holds indexes")
    p.add_argument("--max-bytes", type=int, default=2 << 30, help="what evict leaves")
    p.add_argument("--file-window", type=int, default=0, help="lines of a window where the scope is one file")
    p.add_argument("--no-ignore", action="store_true", help="read what ignore files name too")
    p.add_argument("--write-through", action="store_true")
    p.add_argument("--window", type=int, default=32)
    p.add_argument("--overlap", type=int, default=8)
    p.add_argument("--chunk-budget", type=int)
    p.add_argument("--chunk-cap", type=int)
    p.add_argument("--bridge", type=int, default=0)
    p.add_argument("--prf", type=int, default=0)
    p.add_argument("--bm25-pin", type=int, default=5)
    p.add_argument("--min-score", type=float, default=0.0)
    p.add_argument("--no-diversify", action="store_true")
    p.add_argument("--no-fine", action="store_true")
    p.add_argument("--no-maxsim", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quarry.operators import display, exact
    from quarry.operators.finalize import Finalize
    from quarry.plans import index
    from quarry.plans.search import SearchOptions, resolve_mode, search
    from quarry.sources.corpus import from_folder, is_file

    asked = args.pattern if args.pattern is not None else args.query
    paths = [args.query, *args.paths] if args.pattern is not None and args.query else args.paths
    paths = [q for p in paths for q in (sys.stdin.read().splitlines() if p == "-" else [p])] or ["."]
    if not asked.strip():
        print("the query is empty", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    mode, _ = resolve_mode(args.pattern is not None, args.mode)
    chunk = ChunkParams(args.window, args.overlap, budget=args.chunk_budget, function_cap=args.chunk_cap)
    tail = Finalize(min_score=args.min_score, diversify=not args.no_diversify, fine=not args.no_fine)
    options = SearchOptions(mode=mode, k=args.k, globs=tuple(args.globs), chunk=chunk, bridge=args.bridge, prf=args.prf, bm25_pin=args.bm25_pin, maxsim=mode == "semantic" and not args.no_maxsim, tail=tail, lines=args.lines, file_window=args.file_window, ignore_case=args.ignore_case, literal=args.literal, word=args.word)
    try:
        files = from_folder(spark, paths[0], None if mode == "keyword" else chunk.max_file_bytes, ignored=not args.no_ignore)
        for p in paths[1:]:
            files = files.unionByName(from_folder(spark, p, None if mode == "keyword" else chunk.max_file_bytes, ignored=not args.no_ignore))
        if len(paths) == 1 and is_file(spark, paths[0]):
            options = options.for_file()
        if args.query in ("index", "status", "evict", "clear") and args.index:
            if args.query == "index":
                index.build(files, options, args.index, paths[0] if len(paths) == 1 else None)
            elif args.query == "evict":
                print("\n".join(index.enforce_budget(spark, args.index, args.max_bytes)))
            elif args.query == "clear":
                print("\n".join(index.clear(spark, args.index)))
            else:
                outcome = index.repaired(spark, args.index, files, options, 1.0)[1]
                print(outcome)
                return int(outcome != "no drift")
            return 0
        queries = spark.createDataFrame([(0, asked)], "query_id long, raw string")
        if args.index and mode != "keyword":
            found, _ = index.search_index(spark, args.index, files, queries, options, args.write_through, index.TTL, paths[0] if len(paths) == 1 else None)
        else:
            found = search(files, queries, options)
        order = ["path", "line"] if mode == "keyword" else ["rank"]
        if args.count:
            shown = exact.per_file(found).orderBy("path").select(F.concat_ws(":", "path", "n").alias("value"))
        elif args.files:
            shown = found.groupBy("path").agg(F.min(order[-1]).alias("_o")).orderBy(*(["path"] if mode == "keyword" else ["_o"])).select(F.col("path").alias("value"))
        elif args.around and mode == "keyword":
            rows = exact.context(files, found.select("path", F.col("line").alias("line_no")), args.around, args.around)
            sign = F.when(F.col("is_hit"), ":").otherwise("-")
            shown = rows.orderBy("path", "line_no").select(F.concat("path", sign, "line_no", sign, "line").alias("value"))
        else:
            rows = found.orderBy(*order)
            shown = display.json_lines(rows) if args.json else rows.select(display.record(F.col("path"), F.col("line"), F.col("text")).alias("value"))
        out = shown.collect() if args.all else shown.take(250)  # what a terminal shows
    except Exception as e:  # noqa: BLE001  a command reports and ends
        print(str(e).splitlines()[0] if str(e) else type(e).__name__, file=sys.stderr)
        return 2
    for r in out:
        print(r.value)
    return 0 if out else 1


if __name__ == "__main__":
    sys.exit(main())
