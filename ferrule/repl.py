"""A line-by-line front end: statements of the dialect up to their semicolon, and commands that begin with a dot.

    python -m ferrule [folder of Parquet files]

Tables of the folder are views. Results are printed up to ROWS rows; a query's whole result is what Database.query gives.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from ferrule.database import Database
from ferrule.sql.lexer import lex

ROWS = 1000
HELP = """\
.help           this text
.tables         names of tables and views
.schema [name]  CREATE statements
.exit, .quit    leave"""


def complete(text: str) -> bool:
    """Whether a text ends a statement: with a semicolon, which in a trigger's body follows END."""
    try:
        tokens = lex(text)[:-1]
    except SyntaxError:
        return text.rstrip().endswith(";") and text.count("'") % 2 == 0
    if not tokens or tokens[-1].kind != "op" or tokens[-1].text != ";":
        return False
    words = [t.word for t in tokens]
    return "TRIGGER" not in words[:3] or words[0] != "CREATE" or words[-2] == "END"


def _text(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def command(db: Database, line: str) -> str:
    word, _, name = line.partition(" ")
    if word == ".help":
        return HELP
    if word == ".tables":
        return "\n".join(sorted((*db.state.tables, *db.state.views)))
    if word == ".schema":
        rows = [r for r in db.master().collect() if r.sql and name.strip().lower() in ("", r.tbl_name.lower(), r.name.lower())]
        return "\n".join(f"{r.sql};" for r in rows)
    return f"unknown command: {word}"


def statement(db: Database, text: str) -> str:
    from ferrule.sql.statements import run

    out = run(db, text)
    if out is None:
        return "ok"
    rows = out.limit(ROWS + 1).collect()
    lines = [" | ".join(out.columns), *(" | ".join(map(_text, r)) for r in rows[:ROWS])]
    return "\n".join(lines + [f"... ({ROWS} rows shown)"] * (len(rows) > ROWS))


def loop(db: Database, lines: Iterable[str], out: TextIO) -> None:
    """Read, run and print until the lines end or .exit."""
    pending = ""
    for line in lines:
        if not pending.strip() and line.strip().startswith("."):
            if line.strip() in (".exit", ".quit"):
                return
            print(command(db, line.strip()), file=out)
            continue
        pending += line if line.endswith("\n") else f"{line}\n"
        if complete(pending):
            try:
                print(statement(db, pending), file=out)
            except Exception as e:  # noqa: BLE001 - a mistake ends the statement, not the session
                print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=out)
            pending = ""
    if pending.strip():
        print("error: incomplete statement", file=out)


def main(arguments: list[str]) -> None:
    from ferrule.session import get_spark, ship

    spark = get_spark("repl")
    spark.sparkContext.setLogLevel("OFF")
    ship(spark)
    db = Database(spark)
    if arguments:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(arguments[0])
        for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
            name = f.getPath().getName()
            if name.endswith(".parquet"):
                db.create_view(name.removesuffix(".parquet"), spark.read.parquet(f.getPath().toString()))
    loop(db, sys.stdin, sys.stdout)
