"""Nested exports read line by line: brackets are matched across splits, no document is one row.

A document is the lines of its part files in name order. Each split (a block of one file) is read
alone and summed up as "pops k, then pushes these names". Summaries compose: the depth before a
split is a running sum over them, and the name at some level is the one pushed last on that level by
an earlier split. That gives every split the stack it starts with, so every line knows its directory.

There is one summary a split, with at most the nesting depth of names; lines are never shuffled by
the matching itself, only joined with the stack of their split.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arborlake.schema import INFO_FIELDS
from arborlake.session import materialise

SPLIT = ("file", "block")
SUMMARY = "file STRING, block LONG, pops INT, pushes ARRAY<STRING>"

# a key and what may stand before it; keys are names, so the group repeats a few times at most
_KEY = r'"((?:[^"\\]++|\\.)*+)"[ \t]*:[ \t]*'
_LEAD = r"^[ \t]*,?[ \t]*"


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, value``: the lines of a folder; ``place`` grows within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")


def stacks_before(summaries: DataFrame) -> DataFrame:
    """``file, block, base``: the names that are open where each split starts, outermost first."""
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    placed = summaries.select(
        *SPLIT, "pops", "pushes", F.row_number().over(Window.orderBy(*SPLIT)).alias("number"),
        F.coalesce(F.sum(F.size("pushes") - F.col("pops")).over(before), F.lit(0)).cast("int").alias("depth"))
    pushed = placed.select(
        "number", F.lit(1).alias("turn"), *SPLIT,
        F.posexplode("pushes").alias("i", "name"), (F.col("depth") - F.col("pops")).alias("from")
    ).select("number", "turn", *SPLIT, (F.col("from") + F.col("i") + 1).alias("level"), "name")
    asked = placed.filter("depth > 0").select(
        "number", F.lit(0).alias("turn"), *SPLIT, F.explode(F.sequence(F.lit(1), "depth")).alias("level"),
        F.lit(None).cast("string").alias("name"))
    latest = Window.partitionBy("level").orderBy("number", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = pushed.unionByName(asked).withColumn(
        "name", F.last("name", ignorenulls=True).over(latest)).filter("turn = 0")
    bases = found.groupBy(*SPLIT).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("level", "name"))), lambda s: s["name"]).alias("base"))
    return summaries.select(*SPLIT).join(bases, list(SPLIT), "left").withColumn(
        "base", F.coalesce("base", F.array().cast("array<string>")))


def split_summaries(rows: DataFrame) -> DataFrame:
    """One row a split of ``file, block, kind, name``: how far it pops what was open, what it leaves open.

    ``kind`` is 1 for an opening and ``-n`` for n closings; other rows only make their split known.
    """
    def run(batches):
        split, pops, stack = None, 0, []

        def out():
            return pa.RecordBatch.from_pydict(
                {"file": [split[0]], "block": [split[1]], "pops": pa.array([pops], pa.int32()),
                 "pushes": pa.array([stack], pa.list_(pa.string()))})

        for batch in batches:
            for here, at in _splits_of(batch):
                if here != split:
                    if split is not None:
                        yield out()
                    split, pops, stack = here, 0, []
                kinds = at.column("kind").to_numpy(zero_copy_only=False)
                events = np.flatnonzero(kinds)
                for kind, name in zip(kinds[events].tolist(), at.column("name").take(pa.array(events)).to_pylist()):
                    if kind > 0:
                        stack.append(name)
                    else:
                        pops += max(0, -kind - len(stack))
                        del stack[max(0, len(stack) + kind):]
        if split is not None:
            yield out()

    return rows.select(*SPLIT, "kind", "name").mapInArrow(run, SUMMARY)


def _splits_of(batch: pa.RecordBatch):
    """The batch cut where the split changes."""
    blocks = batch.column("block").to_numpy(zero_copy_only=False)
    files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
        if b > a:
            yield (batch.column("file")[int(a)].as_py(), int(blocks[a])), batch.slice(a, b - a)


def _unescaped(text: str | None) -> str:
    return json.loads(f'"{text}"') if text else ""


def json_members(lines: DataFrame) -> DataFrame:
    """``at, name, value``: the members that stand whole on a line, with the names of what holds them.

    ``at`` starts with "" for the document; objects and lists that go over several lines are levels
    of it. For documents with one member a line, as ``sinks`` writes them, indented or not.
    """
    value = F.col("value")
    opening = value.rlike(f"{_LEAD}(?:{_KEY})?[{{\\[][ \t\r]*$")
    closing = F.regexp_extract(value, r"^[ \t]*([}\]]++)[ \t]*,?[ \t\r]*$", 1)
    prefix = F.regexp_extract(value, f"{_LEAD}{_KEY}", 0)
    bare = F.regexp_extract(value, _LEAD, 0)
    rest = F.substr(value, F.length(F.when(prefix != "", prefix).otherwise(bare)) + 1)
    parsed = lines.select(
        *SPLIT,
        F.when(opening, 1).otherwise(-F.length(closing)).cast("int").alias("kind"),
        F.regexp_extract(value, f"{_LEAD}{_KEY}", 1).alias("name"),
        F.regexp_replace(F.rtrim(rest), r",$", "").alias("value"))
    stacks = materialise(stacks_before(materialise(split_summaries(parsed), "split-summaries")), "stacks")

    def run(batches):
        split, popped, stack = None, 0, []
        for batch in batches:
            for here, at in _splits_of(batch):
                if here != split:
                    split, popped, stack = here, 0, []
                kinds = at.column("kind").to_numpy(zero_copy_only=False)
                events = np.flatnonzero(kinds)
                states = [(popped, list(stack))]  # before the first event, then after each
                for kind, name in zip(kinds[events].tolist(), at.column("name").take(pa.array(events)).to_pylist()):
                    if kind > 0:
                        stack.append(_unescaped(name))
                    else:
                        popped += max(0, -kind - len(stack))
                        del stack[max(0, len(stack) + kind):]
                    states.append((popped, list(stack)))
                members = np.flatnonzero((kinds == 0) & (
                    pa.compute.binary_length(at.column("value")).to_numpy(zero_copy_only=False) > 0))
                if not len(members):
                    continue
                state = pa.array(np.searchsorted(events, members))
                own = at.take(pa.array(members))
                yield pa.RecordBatch.from_arrays([
                    own.column("file"), own.column("block"),
                    pa.array([p for p, _ in states], pa.int32()).take(state),
                    pa.array([s for _, s in states], pa.list_(pa.string())).take(state),
                    own.column("name"), own.column("value"),
                ], ["file", "block", "popped", "inner", "name", "value"])

    found = parsed.mapInArrow(
        run, "file STRING, block LONG, popped INT, inner ARRAY<STRING>, name STRING, value STRING")
    names = F.transform("base", _json_text)
    outer = F.slice(names, 1, F.greatest(F.size("base") - F.col("popped"), F.lit(0)))
    return found.join(stacks, list(SPLIT)).select(
        F.concat(outer, "inner").alias("at"), _json_text(F.col("name")).alias("name"), "value")


def _json_text(escaped: Column) -> Column:
    """The text that stands escaped between quotes."""
    plain = ~F.contains(escaped, F.lit("\\"))
    return F.when(plain, escaped).otherwise(F.try_variant_get(F.try_parse_json(
        F.concat(F.lit('"'), escaped, F.lit('"'))), "$", "string"))


class NestedExport(NamedTuple):
    """What a nested JSON export holds; see ``read_nested_export``."""

    entries: DataFrame
    summary: DataFrame
    failures: DataFrame


def read_nested_export(spark: SparkSession, path: str) -> NestedExport:
    """An export of ``sinks.write("json", ...)``, any number and size of part files, as rows again.

    ``entries``: ``path, parent, filename`` and the fields of an entry; ``summary``: ``name, value``
    (JSON text) of each field; ``failures``: ``file, error``.
    """
    members = json_members(export_lines(spark, path))
    section = F.try_element_at("at", F.lit(2))
    info = ", ".join(f"{name} {_TYPES.get(name, 'STRING')}" for name in INFO_FIELDS)
    parent = F.array_join(F.slice("at", 3, F.greatest(F.size("at") - 2, F.lit(0))), "/")
    found = members.filter(section == "structure").select(
        parent.alias("parent"), F.col("name").alias("filename"), F.from_json("value", info).alias("info"))
    entries = found.select(
        F.concat_ws("/", F.nullif("parent", F.lit("")), "filename").alias("path"), "parent", "filename", "info.*")
    below = members.filter(section == "summary")
    failure = F.from_json("value", "file STRING, error STRING")
    return NestedExport(
        entries,
        below.filter(F.size("at") == 2).select("name", "value"),
        below.filter(F.size("at") == 3).select(failure.alias("f")).select("f.*"))


_TYPES = {"truncated": "BOOLEAN", "preview_bytes": "BIGINT", "size": "BIGINT"}
