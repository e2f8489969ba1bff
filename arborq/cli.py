"""Command line: an expression over one document, or over a Parquet table.

    python -m arborq.cli '.a.b' file.yaml --to json
    python -m arborq.cli 'group_by(.k) | map({k: .[0].k, n: length})' table.parquet --order id
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from arborq.operators import evaluate
from arborq.operators import values as V
from arborq.sources import codecs


def folded(found: list):
    """No match is an empty list, one is itself, several are a list."""
    return found[0] if len(found) == 1 else found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arborq", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("expression", nargs="?", default=".")
    p.add_argument("file", nargs="?", help="a document, or a .parquet table; standard input if absent")
    p.add_argument("--from", dest="source", help="format of the input")
    p.add_argument("--to", dest="target", help="format of the output; the input's if absent")
    p.add_argument("-I", "--indent", type=int, default=2)
    p.add_argument("-n", "--null-input", action="store_true")
    p.add_argument("-i", "--in-place", action="store_true")
    p.add_argument("-e", "--exit-status", action="store_true", help="1 if there is no result, or only null and false")
    p.add_argument("-r", "--unwrap", action="store_true", help="texts without quotes")
    p.add_argument("-0", "--nul-output", action="store_true")
    p.add_argument("--order", action="append", default=[], help="columns that order a table")
    a = p.parse_args(argv)
    if a.file and a.file.endswith(".parquet"):
        return table(a)
    try:
        if a.null_input:
            docs, name = [None], codecs.format_of(a.source)
        else:
            text = Path(a.file).read_text() if a.file else sys.stdin.read()
            name = codecs.format_of(a.source, a.file, text)
            docs = codecs.decode_all(text, name) or [None]
        target = codecs.format_named(a.target) if a.target else name
        results = [r for d in docs for r in evaluate(a.expression, d)]
        out = [r if a.unwrap and isinstance(r, str) else codecs.encode(r, target, indent=a.indent) for r in results]
    except (ValueError, OSError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 2
    end = "\0" if a.nul_output else "\n"
    joint = f"{end}---{end}" if target == "yaml" and not a.nul_output else end
    printed = joint.join(out) + end if out else ""
    if a.in_place and a.file:
        Path(a.file).write_text(printed)
    else:
        sys.stdout.write(printed)
    return int(a.exit_status and not any(map(V.truthy, results)))


def table(a) -> int:
    from pyspark.sql import SparkSession

    from arborq.plans import query

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for row in query(spark.read.parquet(a.file), a.expression, a.order, ordered=True).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
