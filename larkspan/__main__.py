"""``python -m larkspan [FOLDER]``: one statement per line, ``\\q`` or ``exit`` to leave. Without a folder the database goes when the prompt ends."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from larkspan.results import to_text
from larkspan.session import Database
from larkspan.sources.fs import files_of, new_folder


def repl(db: Database, lines: TextIO, out: TextIO) -> None:
    session = db.session()
    for line in lines:
        sql = line.strip()
        if sql in ("\\q", "exit", "quit"):
            break
        if not sql:
            continue
        try:
            r = session.execute(sql)
            print(to_text(r) if r.columns else f"ok, {r.rows_affected} rows", file=out)
        except Exception as e:
            print(f"error: {e}", file=out)
    session.close()


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("larkspan").getOrCreate()
    folder = args[0] if args else new_folder(spark)
    db = (Database.open if files_of(spark, folder).exists("_meta.json") else Database.create)(spark, folder)
    repl(db, sys.stdin, sys.stdout)


if __name__ == "__main__":
    main(sys.argv[1:])
