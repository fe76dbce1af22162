"""python -m tabulon.cli query|ask|describe TABLES... : requests and questions over Parquet or CSV files.

query, ask, tables and process with --pages, --grid (Parquet) and --document: the same over the finished tables of a
document of a known report; profiles lists the reports.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import RequestError
from .operators.generic import infer_numbers
from .plans.catalogs import questions
from .plans.engine import Engine, Table
from .plans.language import QuestionEngine, generic_catalog
from .plans.reports import REPORTS, finished, process
from .plans.request import parse_request, read_request
from .sinks import export_csv, records


def tables(spark: SparkSession, paths: list[str]) -> dict:
    out = {}
    for path in paths:
        reader = spark.read.option("header", True)
        out[Path(path).stem] = infer_numbers(reader.csv(path))[0] if path.endswith(".csv") else spark.read.parquet(path)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabulon")
    parser.add_argument("command", choices=("query", "ask", "describe", "profiles", "process", "tables"))
    parser.add_argument("tables", nargs="*")
    parser.add_argument("--pages")
    parser.add_argument("--grid")
    parser.add_argument("--document")
    parser.add_argument("--out", help="folder for the CSV files of process")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--request", help="JSON text or a file of it")
    parser.add_argument("--question")
    parser.add_argument("--evidence", type=int, default=0)
    args = parser.parse_args(argv)
    if args.command == "profiles":
        for report in REPORTS:
            print("\n".join([report.name, f"  Marks: {', '.join(report.marks)}", *(f"  Table: {t.name}" for t in report.tables)]))
        return 0
    spark = SparkSession.builder.appName("tabulon").getOrCreate()
    try:
        asked = (args.pages, args.grid, args.document)
        if any(asked) and (args.tables or not all(asked)) or not (any(asked) or args.tables) or args.command == "process" and not all(asked):
            raise RequestError("give tables, or --pages, --grid and --document")
        document = (spark.read.parquet(args.pages), spark.read.parquet(args.grid), args.document) if all(asked) else None
        if args.command == "process":
            for name, rows in process(*document).items():
                print(f"{name}: {rows.count()} rows, {len(rows.columns) - 1} columns")
                if args.out:
                    print(f"  CSV: {export_csv(rows.orderBy('row_pos').drop('row_pos'), str(Path(args.out) / (name.replace('.', '_') + '.csv')), args.overwrite)}")
            return 0
        known = {n: Table(rows, ("row_pos",)) for n, rows in finished(process(*document)).items()} if document else tables(spark, args.tables)
        if args.command in ("describe", "tables"):
            print(json.dumps(Engine(known).describe(), indent=2))
            return 0
        if args.command == "query":
            text = args.request or ""
            result = Engine(known).compile(read_request(text) if Path(text).is_file() else parse_request(text))
        elif document:
            _, result = questions(*document).ask(args.question or "")
        else:
            name, rows = next(iter(known.items()))
            _, result = QuestionEngine(generic_catalog(rows, name), {name: rows}).ask(args.question or "")
        out = {"request": result.request.to_dict(), **result.counts(), "answer": records(result.answer)}
        if args.evidence:
            out["evidence"] = records(result.evidence(args.evidence))
        print(json.dumps(out, indent=2, default=str))
        return 0
    except (ValueError, TypeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
