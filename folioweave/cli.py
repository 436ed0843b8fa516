"""Command line: every answer is one JSON envelope on standard output.

Exit codes: 0 done, 1 unexpected fault, 2 wrong input, 3 books of the run failed.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave import config as C
from folioweave.sources.pages import InputError, page_list, page_range

ENVELOPE_VERSION = 1
DONE, FAULT, INPUT, FAILED = 0, 1, 2, 3


def envelope(command: str, data: Any = None, error: tuple[str, str] | None = None) -> dict[str, Any]:
    """What a command answers with: its data, or the kind and message of its error."""
    return {"schema_version": ENVELOPE_VERSION, "command": command, "ok": error is None, "data": data, "error": {"kind": error[0], "message": error[1]} if error else None}


def plain(value: Any) -> Any:
    """A value as JSON knows it; rows, dataclasses, sets and paths are written out, anything unknown is an error."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return plain(dataclasses.asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(plain(v) for v in value)
    if hasattr(value, "__fspath__"):
        return value.__fspath__()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("folioweave").getOrCreate()


def _table(folder: str, name: str, columns: list[str]) -> DataFrame:
    from folioweave.runtime import load

    try:
        return load(_spark(), folder, name, columns)
    except Exception as e:
        raise InputError(f"table {name} can't be read in {folder}: {type(e).__name__}") from None


def _settings(args: argparse.Namespace):
    text = None
    if args.config:
        try:
            with open(args.config, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            raise InputError(f"{args.config}: {e.strerror}") from None
    return C.resolve(text, overrides=tuple(args.set or ()))


def _inputs(folder: str):
    from folioweave.operators import lines as L
    from folioweave.plans import queries as Q

    spark = _spark()
    _table(folder, "style_lines", L.LINE)
    return L.line_rows(_table(folder, "style_lines", L.LINE)), Q._plan(spark, folder), Q._totals(spark, folder), Q._page_texts(spark, folder)


def _process(args: argparse.Namespace) -> tuple[dict[str, Any], int]:
    from folioweave.plans import jobs
    from folioweave.sources import sinks

    done = jobs.process(*_inputs(args.tables), _settings(args))
    if args.output:
        written = sinks.write_markdown(done.files, args.output)
        bad = written.where("status = 'failed'").count()
        sinks.write_jsonl(done.report, f"{args.output}/report")
    else:
        bad = 0
    n = jobs.counts(done.report)
    return n | {"write_failures": bad}, FAILED if n["failed"] or bad else DONE


def _infer(args: argparse.Namespace) -> tuple[dict[str, Any], int]:
    from folioweave.operators import lines as L
    from folioweave.plans import pipeline as P
    from folioweave.sources import sinks

    got = P.infer(L.line_rows(_table(args.tables, "style_lines", L.LINE)), _settings(args).typography)
    stages = {f.name: getattr(got, f.name) for f in dataclasses.fields(got)}
    if args.output:
        sinks.write_stages(stages, args.output)
    return {"books": got.totals.count(), "items": got.plan.count(), "warnings": got.warnings.count()}, DONE


def _classify(args: argparse.Namespace) -> tuple[dict[str, Any], int]:
    from folioweave.operators import artifacts as A
    from folioweave.plans.queries import QUERIES

    v = QUERIES["scan_verdicts"](_spark(), args.tables).select("book_id", "is_scanned", F.col("is_scanned").alias("target"), F.lit(None).cast("string").alias("error"))
    return plain(A.classification_totals(v).first()), DONE


def _inspect(args: argparse.Namespace) -> tuple[dict[str, Any], int]:
    from folioweave.plans import queries as Q
    from folioweave.sources import pages as S

    spark = _spark()
    totals, texts, outline = Q._totals(spark, args.tables), Q._page_texts(spark, args.tables), Q._plan(spark, args.tables)
    if args.what == "books":
        return {"books": [plain(r) for r in S.book_summary(totals, texts, outline).orderBy("book_id").limit(args.limit).collect()]}, DONE
    if args.what == "text":
        found, faults = S.selected_pages(texts, totals, page_list(args.pages) or [])
        if args.book:
            found, faults = found.where(F.col("book_id") == args.book), faults.where(F.col("book_id") == args.book)
        fault = faults.first()
        if fault is not None:
            raise InputError(f"book {fault.book_id} has {fault.total_pages} pages, page {fault.pdf_page} is beyond")
        return {"pages": [plain(r) for r in found.orderBy("book_id", "pdf_page").limit(args.limit).collect()]}, DONE
    if args.what == "bookmarks":
        rows = outline.where(F.col("book_id") == args.book) if args.book else outline
        between = page_range(args.pages)
        rows = rows.where(F.col("pdf_page").between(*between)) if between else rows
        return {"bookmarks": [plain(r) for r in rows.orderBy("book_id", "ord").limit(args.limit).collect()]}, DONE
    name = {"sweep": "knob_sweep", "plan": "review_summary", "markdown": "graph_findings", "compare": "node_set_differences"}[args.what]
    return {args.what: [plain(r) for r in Q.QUERIES[name](spark, args.tables).limit(args.limit).collect()]}, DONE


def _config(args: argparse.Namespace) -> tuple[Any, int]:
    if args.what == "defaults":
        return C.to_data(C.ProcessingConfig()), DONE
    if args.what == "schema":
        return C.schema(), DONE
    if args.what == "init":
        return {"toml": C.to_toml(C.ProcessingConfig())}, DONE
    if args.what == "explain":
        return C.explain(args.name or ""), DONE
    if not args.config:
        raise InputError("--config names the file to validate")
    with open(args.config, encoding="utf-8") as f:
        faults = C.validate(f.read())
    return {"faults": faults}, INPUT if faults else DONE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, tables: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if tables:
            c.add_argument("tables", help="folder of the tables")
        c.add_argument("--config", help="TOML file of settings")
        c.add_argument("--set", action="append", help="section.key=value")
        return c

    for name, run in (("process", _process), ("infer", _infer), ("classify-scan", _classify)):
        add(name, run).add_argument("--output", help="shared folder for the results")
    c = add("inspect", _inspect)
    c.add_argument("what", choices=["books", "text", "bookmarks", "sweep", "plan", "markdown", "compare"])
    c.add_argument("--pages")
    c.add_argument("--book")
    c.add_argument("--limit", type=int, default=100, help="rows shown")
    c = add("config", _config, tables=False)
    c.add_argument("what", choices=["defaults", "schema", "init", "explain", "validate"])
    c.add_argument("name", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        data, code = args.run(args)
        out = envelope(args.command, plain(data))
        out["ok"] = code == DONE
    except (InputError, C.ConfigError, OSError) as e:
        out, code = envelope(args.command, error=("input", str(e))), INPUT
    except Exception as e:  # whatever else went wrong is told in the same form
        out, code = envelope(args.command, error=("runtime", f"{type(e).__name__}: {str(e)[:500]}")), FAULT
    print(json.dumps(out, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
