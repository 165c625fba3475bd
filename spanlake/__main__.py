"""python -m spanlake --file a.sql b.sql, or statements from standard input: typed at a prompt, or piped."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from spanlake.plans.session import IntervalSession, statements

SHOWN = 100


def prompt(session: IntervalSession, rows: int) -> None:
    """Statements as they are typed, each to its semicolon; an error is shown, and the next statement is read. quit or Ctrl-D ends."""
    held = ""
    while True:
        try:
            line = input("spanlake> " if not held else "       -> ")
        except EOFError:
            return
        if not held and line.strip().lower() in ("quit", "exit", "quit;", "exit;"):
            return
        held += line + "\n"
        if not line.rstrip().endswith(";"):
            held = held if held.strip() else ""
            continue
        for s in statements(held):
            try:
                session.sql(s).show(rows, truncate=False)
            except Exception as e:  # whatever a statement fails with is the user's to read
                print(str(e).split("\n")[0])
        held = ""


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanlake", description="Run SQL over interval tables.")
    parser.add_argument("-f", "--file", nargs="*", default=[], help="scripts to run; without any, statements are read from standard input")
    parser.add_argument("--rows", type=int, default=SHOWN, help="rows shown of each result")
    got = parser.parse_args(args)
    session = IntervalSession(SparkSession.builder.appName("spanlake").getOrCreate())
    if not got.file and sys.stdin.isatty():
        prompt(session, got.rows)
        return 0
    for text in (open(f).read() for f in got.file) if got.file else [sys.stdin.read()]:
        for s in statements(text):
            session.sql(s).show(got.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
