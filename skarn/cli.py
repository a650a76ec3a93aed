"""A small shell: `python -m skarn.cli DIRECTORY`. Statements end with `;`; lines with a dot are commands."""

from __future__ import annotations

import sys
import time

HELP = """.help            this text
.tables          tables of the session
.schema TABLE    columns of a table
.read FILE       run a script
.timer on|off    print seconds
.quit            leave"""


class Shell:
    def __init__(self, session, out=sys.stdout):
        self.session, self.out, self.timer, self.buffer = session, out, False, ""

    def line(self, text: str) -> bool:
        """False when the shell is to end."""
        if not self.buffer and text.strip().startswith("."):
            return self.command(*text.strip()[1:].split(maxsplit=1))
        self.buffer += text + "\n"
        if text.rstrip().endswith(";"):
            script, self.buffer = self.buffer, ""
            self.script(script)
        return True

    def command(self, name: str, argument: str = "") -> bool:
        if name in ("quit", "exit"):
            return False
        if name == "tables":
            self.show(self.session.execute("SHOW TABLES"))
        elif name == "schema":
            self.show(self.session.execute(f"DESCRIBE {argument}"))
        elif name == "read":
            with open(argument) as f:
                self.script(f.read())
        elif name == "timer":
            self.timer = argument == "on"
        else:
            print(HELP, file=self.out)
        return True

    def script(self, text: str) -> None:
        from skarn.session import EngineError

        began = time.time()
        try:
            for result in self.session.run(text):
                self.show(result)
        except EngineError as e:
            print(f"error: {e}", file=self.out)
        if self.timer:
            print(f"{time.time() - began:.3f} s", file=self.out)

    def show(self, result) -> None:
        if result is None:
            print("ok", file=self.out)
        elif hasattr(result, "count") and not callable(result.count):
            print(f"{result.count} rows affected", file=self.out)
        else:
            print("\t".join(result.columns), file=self.out)
            for row in result.toLocalIterator():
                print("\t".join("NULL" if v is None else str(v) for v in row), file=self.out)


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    import skarn

    spark = SparkSession.builder.appName("skarn").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shell = Shell(skarn.open(spark, args[0] if args else None))
    for text in sys.stdin:
        if not shell.line(text.rstrip("\n")):
            break


if __name__ == "__main__":
    main(sys.argv[1:])
