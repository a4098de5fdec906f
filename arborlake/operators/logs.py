"""Log tables: threshold, search, navigation and shown rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions.times import clock_time
from arborlake.operators import ordering
from arborlake.options import LOG_BUFFER_ROWS

# fixed values: level numbers, names and colours
LEVELS = {10: "DEBUG", 20: "INFO", 30: "WARNING", 40: "ERROR", 50: "CRITICAL"}
LEVEL_COLOURS = {10: "#808080", 20: "#4CAF50", 30: "#FFA500", 40: "#FF0000", 50: "#800080"}
OTHER_COLOUR = "#000000"
IMMEDIATE_LEVEL = 40


def level_name(level: Column) -> Column:
    named = F.when(F.lit(False), F.lit(""))
    for number, name in LEVELS.items():
        named = named.when(level == number, F.lit(name))
    return named.otherwise(F.concat(F.lit("Level "), level.cast("string")))


def level_colour(level: Column) -> Column:
    picked = F.when(F.lit(False), F.lit(""))
    for number, colour in LEVEL_COLOURS.items():
        picked = picked.when(level == number, F.lit(colour))
    return picked.otherwise(F.lit(OTHER_COLOUR))


def formatted(ts: Column, level: Column, message: Column) -> Column:
    """``date time [LEVEL] message``"""
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.concat(stamp, F.lit(" ["), level_name(level), F.lit("] "), message)


def at_least(logs: DataFrame, level: int | None) -> DataFrame:
    return logs if level is None else logs.filter(F.col("level") >= level)


def search(logs: DataFrame, text: str) -> DataFrame:
    return logs.filter(F.contains(F.lower("formatted"), F.lit(text.lower())))


def shown(logs: DataFrame) -> DataFrame:
    """Rows as the panel shows them: clock time, level and message (or the formatted text)."""
    text = F.coalesce(F.nullif("message", F.lit("")), "formatted", F.lit(""))
    return logs.select(
        "seq", clock_time(F.col("ts")).alias("time"), "level_name", text.alias("message"),
        level_colour(F.col("level")).alias("color"),
    )


def buffered(logs: DataFrame, n: int = LOG_BUFFER_ROWS) -> DataFrame:
    """Last ``n`` rows of each logger."""
    return ordering.last_n(logs, "logger_name", [F.col("ts").desc(), F.col("seq").desc()], n)


def match_navigation(logs: DataFrame, text: str) -> DataFrame:
    return ordering.navigation(search(logs, text), "seq", ["ts", "seq"])
