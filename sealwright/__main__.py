"""Command line: python -m sealwright verify | show | head | export | version. Exit codes: 0 fine, 1 violated, 2 input or output, 3 arguments, 64 usage."""

from __future__ import annotations

import argparse
import json
import sys

from . import constants
from .errors import AuditError, KeyLoadError, LogFormatError
from .functions.records import parsed
from .keys import LocalKey
from .operators import query
from .operators.export import digests, export_lines
from .operators.verify import VerifyOptions, report_json, verify_files, violations
from .sources.segments import read_log

FINE, VIOLATED, INPUT, ARGUMENT, USAGE = 0, 1, 2, 3, 64


class Parser(argparse.ArgumentParser):
    def error(self, message):
        print(f"usage: {message}", file=sys.stderr)
        sys.exit(USAGE)


def parser() -> Parser:
    p = Parser(prog="sealwright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("verify", "show", "head", "export"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--format", choices=("text", "json"), default="text")
        if name in ("verify", "export"):
            c.add_argument("--key-env")
            c.add_argument("--key-file")
        if name == "verify":
            c.add_argument("--forensic", action="store_true")
            c.add_argument("--summary", action="store_true")
            c.add_argument("--segment", type=int)
        if name == "show":
            c.add_argument("--from", dest="start", type=int)
            c.add_argument("--to", dest="end", type=int)
            c.add_argument("--actor")
            c.add_argument("--event-glob")
        if name == "export":
            c.add_argument("--out", required=True)
            c.add_argument("--full", action="store_true")
    sub.add_parser("version")
    return p


def key_of(args) -> LocalKey:
    if args.key_file:
        return LocalKey.from_file(args.key_file)
    if args.key_env:
        return LocalKey.from_env(args.key_env)
    raise KeyLoadError("name a key: --key-file or --key-env")


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sealwright").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args, spark) -> int:
    frames, segments = read_log(spark, args.folder)
    if args.command == "verify":
        key, options = key_of(args), VerifyOptions(forensic=args.forensic or args.segment is not None, cascade=args.segment is None)
        report = verify_files(spark, args.folder, key, options).cache()
        if args.segment is not None:
            found = violations(report).filter(f"segment_index = {args.segment}").orderBy("log_id")
            bad = 0
            for row in found.toLocalIterator():
                bad += 1
                print(f"{row['log_id']}: {row['kind']} at segment {row['segment_index']} record {'-' if row['record_id'] is None else row['record_id']}")
            return VIOLATED if bad else FINE
        lines = report_json(report, key.key_id).select("log_id", "json") if args.format == "json" else report.select("log_id", "summary" if args.summary else "compact")
        for row in lines.orderBy("log_id").toLocalIterator():
            print(row[1] if args.format == "json" or args.summary else f"{row[0]}: {row[1]}")
        return VIOLATED if report.filter("verdict <> 'Verified'").limit(1).count() else FINE
    if args.command == "export":
        lines = export_lines(frames, segments, key_of(args), args.full)
        lines.orderBy("log_id", "part", "line_no").write.mode("errorifexists").json(args.out)
        for row in digests(lines).orderBy("log_id").toLocalIterator():
            print(f"{row['sha256']}  {row['log_id']}", file=sys.stderr)
        return FINE
    records = parsed(frames.filter("not torn"))
    if args.command == "head":
        for row in query.head(records, ["log_id"]).orderBy("log_id").toLocalIterator():
            d = row.asDict()
            print(json.dumps(d) if args.format == "json" else f"{d['log_id']}: records={d['record_count']} segments={d['segments']} head={d['head_hmac_hex']} last_segment={d['last_segment_index']} last_record_id={d['last_record_id']} last_actor={d['last_actor']} last_event={d['last_event']}")
        return FINE
    shown = query.show(records, args.start, args.end, args.actor, args.event_glob)
    line = query.as_json() if args.format == "json" else query.as_text()
    n = 0
    for row in shown.select("log_id", "segment_index", "file_offset", line.alias("line")).orderBy("log_id", "segment_index", "file_offset").toLocalIterator():
        n += 1
        print(row["line"])
    if args.format == "text":
        print(f"({n} record{'' if n == 1 else 's'} shown)", file=sys.stderr)
    return FINE


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"format {constants.FORMAT_VERSION}")
        return FINE
    if getattr(args, "segment", None) is not None and not 0 <= args.segment <= 65_535:
        print("--segment is at most 65535", file=sys.stderr)
        return ARGUMENT
    try:
        return run(args, spark or session())
    except KeyLoadError as e:
        print(e, file=sys.stderr)
        return ARGUMENT
    except (LogFormatError, OSError) as e:
        print(e, file=sys.stderr)
        return INPUT
    except AuditError as e:
        print(e, file=sys.stderr)
        return VIOLATED


if __name__ == "__main__":
    sys.exit(main())
