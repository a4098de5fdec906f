"""Directory hierarchy as tables of nodes, edges and ordered document lines.

A tree is never built as one nested value. Every line of a nested document gets a sort key
made of path components; one parallel sort puts all lines in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import display
from arborlake.functions.paths import ancestors, base_name, parent_path, path_parts
from arborlake.session import materialise

LAST = chr(0x10FFFF)  # sorts after every name


def directories(entries: DataFrame) -> DataFrame:
    """Distinct directories above the entries: ``path, parent, name, depth``.

    Parents are made distinct before their ancestors are listed, so a directory with very many
    files contributes one row per map task.
    """
    parents = entries.select("parent").filter(F.col("parent") != "").distinct()
    chain = F.array_append(ancestors(F.col("parent")), F.col("parent"))
    paths = parents.select(F.explode(chain).alias("path")).distinct()
    return paths.select(
        "path",
        parent_path(F.col("path")).alias("parent"),
        base_name(F.col("path")).alias("name"),
        F.size(path_parts(F.col("path"))).cast("long").alias("depth"),
    )


def nodes(entries: DataFrame) -> DataFrame:
    """Directory and file nodes: ``path, parent, name, depth, kind`` (kind: type of the file)."""
    files = entries.select(
        "path",
        "parent",
        F.col("filename").alias("name"),
        F.size(path_parts(F.col("path"))).cast("long").alias("depth"),
        F.col("type").alias("kind"),
    )
    return directories(entries).withColumn("kind", F.lit("directory")).unionByName(files)


def edges(entries: DataFrame) -> DataFrame:
    """``src, dst`` from each directory to its directories and files; the root has no node."""
    below = directories(entries).select(F.col("parent").alias("src"), F.col("path").alias("dst"))
    files = entries.select(F.col("parent").alias("src"), F.col("path").alias("dst"))
    return below.unionByName(files).filter(F.col("src") != "")


def children(entries: DataFrame) -> DataFrame:
    """Children per directory in name order: ``parent, name, kind``. Rows, not a list in a
    cell, so a directory may hold any number of them."""
    return nodes(entries).select("parent", "name", "kind").orderBy("parent", "name")


def graph_nodes(entries: DataFrame) -> DataFrame:
    """Nodes with label, colours, shape and tooltip for a graph view; the id is the path."""
    none = F.lit(None).cast("string")
    dirs = directories(entries).select(
        F.col("path").alias("id"), F.col("name").alias("label"), none.alias("tooltip"),
        F.lit("directory").alias("kind"),
    )
    tip = display.node_tooltip(
        F.col("encoding"), F.col("created"), F.col("modified"), F.col("permissions")
    )
    files = entries.select(
        F.col("path").alias("id"),
        display.node_label(F.col("filename"), F.col("size")).alias("label"),
        F.nullif(tip, F.lit("")).alias("tooltip"),
        F.col("type").alias("kind"),
    )
    rows = dirs.unionByName(files)
    return rows.select(
        "id", "label", "kind",
        F.coalesce("tooltip", "label").alias("title"),
        display.node_style(F.col("kind"), "fillcolor").alias("fillcolor"),
        display.node_style(F.col("kind"), "color").alias("color"),
        display.node_style(F.col("kind"), "shape").alias("shape"),
        display.node_style(F.col("kind"), "style").alias("style"),
        display.node_style(F.col("kind"), "penwidth").alias("penwidth"),
        F.col("tooltip").alias("tip"),
    )


@dataclass(frozen=True)
class LineStyle:
    """How one format writes the parts of a tree. Callables get columns, return a line column.

    ``depth`` is the number of components of the node's path.
    """

    header: tuple[str, ...]
    between: tuple[str, ...]
    footer: tuple[str, ...]
    open_dir: Callable[[Column, Column], Column]
    close_dir: Callable[[Column], Column] | None
    leaf: Callable[[Column, Column], Column]
    separator: str | None = None


def _line(key: Column, rank: int, line: Column) -> list[Column]:
    return [
        key.cast("array<string>").alias("key"), F.lit(rank).alias("rank"), line.alias("line")
    ]


def fixed_lines(spark, *blocks: tuple[list[str], tuple[str, ...]]) -> DataFrame:
    """Lines that stand in every document, as (key, lines); no Python is needed for them."""
    rows = [
        F.struct(F.array(*map(F.lit, key)).cast("array<string>").alias("key"), F.lit(rank).alias("rank"),
                 F.lit(line).alias("line"))
        for key, lines in blocks for rank, line in enumerate(lines)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _named_nodes(entries: DataFrame) -> DataFrame:
    """``path, parent, name, is_dir`` of all nodes, from names alone and written once."""
    files = entries.select("path", "parent", F.col("filename").alias("name"), F.lit(False).alias("is_dir"))
    dirs = directories(entries).select("path", "parent", "name", F.lit(True).alias("is_dir"))
    return materialise(dirs.unionByName(files), "tree-nodes")


def _separators(named: DataFrame, style: LineStyle) -> DataFrame:
    """A separator line before every child but the first of its directory.

    The first child is a minimum per directory (combined on the map side) and is then found by
    its full path, which is unique: no directory is gathered and no content is shuffled.
    """
    first = named.groupBy("parent").agg(F.min("name").alias("name"))
    later = named.join(first, ["parent", "name"], "left_anti")
    return later.select(*_line(path_parts(F.col("path")), 0, F.lit(style.separator)))


def tree_lines(
    entries: DataFrame, style: LineStyle, summary_lines: DataFrame | None = None
) -> DataFrame:
    """Unordered lines ``key, rank, line`` of a nested document; see ``in_order``.

    Keys: the components of a node; those plus LAST to close a directory; [LAST] for the end
    of the structure; ``summary_lines`` bring keys that start with [LAST, ...].
    """
    named = _named_nodes(entries)
    key = path_parts(F.col("path"))
    depth = F.size(key)
    ends = [F.struct(*_line(key, 1, style.open_dir(F.col("name"), depth)))]
    if style.close_dir is not None:
        ends.append(F.struct(*_line(F.array_append(key, F.lit(LAST)), 2, style.close_dir(depth))))
    parts = [
        fixed_lines(entries.sparkSession, ([], style.header), ([LAST], style.between), ([LAST, LAST], style.footer)),
        named.filter("is_dir").select(F.inline(F.array(*ends))),
        entries.select(*_line(key, 1, style.leaf(F.col("filename"), depth))),
    ]
    if style.separator is not None:
        parts.append(_separators(named, style))
    if summary_lines is not None:
        parts.append(summary_lines)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def in_order(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines of a document in order: one range-partitioned sort, any number of part files."""
    order = ("key", "rank")
    ordered = lines.orderBy(*order) if parts is None else lines.repartitionByRange(
        parts, *order).sortWithinPartitions(*order)
    return ordered.select("line")
