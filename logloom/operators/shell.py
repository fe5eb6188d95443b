"""Text commands as data: a script of lines to the transcript of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The answers.
HELP = """Commands:
  PUT <key> <value...>   store value (rest of the line) under key
  GET <key>              print the value for key, or (nil)
  DELETE <key>           remove key
  HELP                   show this list
  EXIT | QUIT            end the session"""
BYE = "Bye."
PUT_USAGE = "PUT requires a key and a value."
GET_USAGE, GET_SPACES = "GET requires a key.", "GET takes exactly one key (no spaces)."
DELETE_USAGE, DELETE_SPACES = "DELETE requires a key.", "DELETE takes exactly one key (no spaces)."


def parse(line: Column) -> dict[str, Column]:
    """command, key and value of a line; key is null where the command can't run."""
    stripped = F.regexp_replace(line, r"^\s+|\s+$", "")
    has = F.instr(stripped, " ") > 0
    command = F.upper(F.when(has, F.substring_index(stripped, " ", 1)).otherwise(stripped))
    rest = F.when(has, F.regexp_replace(F.regexp_replace(stripped, r"^[^ ]* ", ""), r"^\s+", "")).otherwise("")
    two = F.instr(rest, " ") > 0
    key = F.when((command == "PUT") & two, F.substring_index(rest, " ", 1)).when(command.isin("GET", "DELETE") & (rest != "") & ~two, rest)
    value = F.when((command == "PUT") & two, F.regexp_replace(rest, r"^[^ ]* ", ""))
    usage = (
        F.when((command == "PUT") & ~two, PUT_USAGE)
        .when((command == "GET") & (rest == ""), GET_USAGE)
        .when((command == "GET") & two, GET_SPACES)
        .when((command == "DELETE") & (rest == ""), DELETE_USAGE)
        .when((command == "DELETE") & two, DELETE_SPACES)
        .when(command == "HELP", HELP)
        .when(command.isin("EXIT", "QUIT"), BYE)
        .when(command == "", "")
        .when(~command.isin("PUT", "GET", "DELETE"), F.concat(F.lit("Unknown command: "), command, F.lit(". Type HELP for a list of commands.")))
    )
    return {"command": command, "key": key, "value": value, "usage": usage}


def transcript(script: DataFrame, by: list[str], order: str = "line_no") -> DataFrame:
    """script(by..., line_no, line) -> (by..., line_no, answer), sessions apart, up to each one's EXIT.

    A command sees the last write of its key before it: a running last value
    within (session, key).
    """
    p = script.withColumns(parse(F.col("line")))
    w = Window.partitionBy(*by, "key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("command").isin("PUT", "DELETE") & F.col("key").isNotNull(), F.struct("command", "value"))
    p = p.withColumn("_last", F.last(write, ignorenulls=True).over(w))
    live = F.coalesce(F.col("_last.command") == "PUT", F.lit(False))
    answer = (
        F.when(F.col("usage").isNotNull(), F.col("usage"))
        .when(F.col("command") == "PUT", F.when(live, "OK (previous value replaced)").otherwise("OK"))
        .when(F.col("command") == "GET", F.when(live, F.col("_last.value")).otherwise("(nil)"))
        .otherwise(F.when(live, "OK (removed)").otherwise("OK (not found)"))
    )
    ends = script.withColumns(parse(F.col("line"))).where(F.col("command").isin("EXIT", "QUIT")).groupBy(*by).agg(F.min(order).alias("_end"))
    out = p.withColumn("answer", answer).join(ends, by, "left") if by else p.withColumn("answer", answer).crossJoin(F.broadcast(ends))
    return out.where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).select(*by, order, "answer")
