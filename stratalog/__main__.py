"""python -m stratalog [program.dl ...]: run programs, from standard input where none is named, and print the last result of each."""

from __future__ import annotations

import sys


def main(paths: list[str]) -> int:
    from pyspark.sql import SparkSession

    from stratalog.engine import Engine
    from stratalog.functions.values import DatalogError
    from stratalog.sources.text import failure, lines

    engine, code = Engine(SparkSession.builder.getOrCreate()), 0
    for path in paths or ["-"]:
        if path == "-":
            source = sys.stdin.read()
        else:
            with open(path, encoding="utf-8") as f:
                source = f.read()
        try:
            print(*lines(engine.execute(source)), sep="\n")
        except DatalogError as error:
            print(*failure(error, source), sep="\n", file=sys.stderr)
            code = 1
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
