"""Writers: nested JSON, JSON array, JSON Lines, CSV, YAML, XML, DOT, S-expressions, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import escape
from arborlake.functions.paths import path_parts
from arborlake.operators import tree
from arborlake.operators.tree import LineStyle
from arborlake.schema import INFO_FIELDS
from arborlake.sinks import summary_rows as sr

# fixed values: default colours, preamble and summary block of the plain DOT export, preamble of the styled one
DIR_COLOUR, FILE_COLOUR, SUMMARY_COLOUR = "#FFA500", "#90EE90", "#D3D3D3"
DOT_CONTENT_CHARACTERS, DOT_DETAILED_CHARACTERS = 1024, 900_000
DOT_DETAILS = (
    ("Size: ", "size", " bytes"), ("Created: ", "created", ""), ("Modified: ", "modified", ""),
    ("Permissions: ", "permissions", ""), ("Hash: ", "hash", ""),
)
NOT_AVAILABLE = "N/A"
DOT_PREAMBLE = ("digraph RepositoryStructure {", '    node [shape=box, style=filled, color="#ADD8E6"];')
DOT_CLUSTER = ("    subgraph cluster_summary {", '        label="Summary";', "        color=lightgrey;")
DOT_STYLED_PREAMBLE = (
    "digraph Repository {",
    '  graph [rankdir="LR", splines="ortho", ranksep="1.5", nodesep="0.8", pad="0.5", '
    'bgcolor="white"];',
    '  node [fontname="Helvetica", fontsize="10", shape="box", style="filled", margin="0.2"];',
    '  edge [color="#666666", penwidth="1.2", arrowsize="0.8"];',
)
CSV_HEADER = ("Path", "Type", "Size", "Created", "Modified", "Permissions", "Timezone")
_BOOLEANS = ("truncated",)
_NUMBERS = ("preview_bytes", "size")


def _info_struct() -> Column:
    return F.struct(*[F.col(name) for name in INFO_FIELDS])


def _kind(name: str) -> str:
    return "boolean" if name in _BOOLEANS else "bigint" if name in _NUMBERS else "string"


def _indent(depth: Column, step: int, extra: int = 0) -> Column:
    return F.repeat(F.lit(" "), ((depth + extra) * step).cast("int"))


# ---- nested JSON ---------------------------------------------------------------------------

def json_tree(entries: DataFrame, summary: DataFrame | None = None,
              failures: DataFrame | None = None, *, pretty: bool = True) -> DataFrame:
    """Lines of ``{"structure": {dir: {file: info}}, "summary": {...}}``.

    One line per directory start, file and directory end; indented when ``pretty``.
    """
    step = 4 if pretty else 0
    style = LineStyle(
        header=("{", '"structure": {'),
        between=("}",),
        footer=("}",),
        open_dir=lambda name, depth: F.concat(
            _indent(depth, step, 1), escape.json_string(name), F.lit(": {")),
        close_dir=lambda depth: F.concat(_indent(depth, step, 1), F.lit("}")),
        leaf=lambda name, depth: F.concat(
            _indent(depth, step, 1), escape.json_string(name), F.lit(": "),
            F.to_json(_info_struct())),
        separator=",",
    )
    return tree.tree_lines(entries, style, _json_summary(summary, failures))


def _json_summary(summary: DataFrame | None, failures: DataFrame | None) -> DataFrame | None:
    if summary is None:
        return None
    value = sr.json_value(F.col("kind"), F.col("value"), escape.json_string(F.col("value")))
    head = summary.select(*sr.line(sr.key("1"), 0, F.lit(',"summary": {')))
    body = sr.field_rows(summary).select(*sr.line(
        sr.key("2"), F.col("position"),
        F.concat(F.lit('"'), F.col("name"), F.lit('": '), value, F.lit(","))))
    opened = summary.select(*sr.line(sr.key("3"), 0, F.lit('"failed_files": [')))
    closed = summary.select(*sr.line(sr.key("5"), 0, F.lit("]}")))
    parts = head.unionByName(body).unionByName(opened).unionByName(closed)
    if failures is not None:
        first = failures.agg(F.min("file").alias("file"))
        comma = failures.select("file").distinct().join(first, "file", "left_anti")
        rows = failures.select(*sr.line(
            sr.key(F.lit("4"), F.col("file")), 1, F.to_json(F.struct("file", "error"))))
        parts = parts.unionByName(rows).unionByName(
            comma.select(*sr.line(sr.key(F.lit("4"), F.col("file")), 0, F.lit(","))))
    return parts


def json_array(entries: DataFrame, summary: DataFrame | None = None,
               failures: DataFrame | None = None) -> DataFrame:
    """Lines of ``{"structure": [entry, ...], "summary": {...}}``, one entry per line."""
    key = path_parts(F.col("path"))
    first = entries.agg(F.min("path").alias("path"))
    commas = entries.select("path").join(first, "path", "left_anti")
    spark = entries.sparkSession
    parts = [
        tree.fixed_lines(spark, ([], ('{"structure": [',)), ([tree.LAST], ("]",)),
                         ([tree.LAST, tree.LAST], ("}",))),
        entries.select(*sr.line(key, 1, F.to_json(F.struct(
            "parent", "filename", "path", _info_struct().alias("info"))))),
        commas.select(*sr.line(key, 0, F.lit(","))),
    ]
    rest = _json_summary(summary, failures)
    if rest is not None:
        parts.append(rest)
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


# ---- flat formats --------------------------------------------------------------------------

def jsonl_rows(entries: DataFrame, *, remove_empty_fields: bool = False) -> DataFrame:
    """``path, type, size, created, modified, permissions, hash, content``."""
    text = ("type", "created", "modified", "permissions", "hash", "content")

    def cell(name: str) -> Column:
        column = F.col(name)
        if name not in text:
            return column
        return F.nullif(column, F.lit("")) if remove_empty_fields else F.coalesce(column, F.lit(""))

    names = ("type", "size", "created", "modified", "permissions", "hash", "content")
    return entries.select("path", *[cell(n).alias(n) for n in names])


def csv_rows(entries: DataFrame) -> DataFrame:
    names = ("path", "type", "size", "created", "modified", "permissions", "timezone")
    rows = entries.withColumn("timezone", F.coalesce("timezone", F.lit("UTC")))
    return rows.select(*[F.col(n).alias(h) for n, h in zip(names, CSV_HEADER)])


# ---- YAML ----------------------------------------------------------------------------------

def yaml_tree(entries: DataFrame, summary: DataFrame | None = None,
              failures: DataFrame | None = None, *, indent: int = 2) -> DataFrame:
    """Lines of the nested mapping; every key and text is a quoted scalar."""
    def pair(name: str, pad: Column) -> Column:
        raw = F.col(name)
        value = raw.cast("string") if _kind(name) != "string" else escape.yaml_string(raw)
        return F.when(raw.isNotNull(), F.concat(pad, F.lit(f"{name}: "), value))

    def leaf(name: Column, depth: Column) -> Column:
        pad = _indent(depth, indent, 1)
        head = F.concat(_indent(depth, indent), escape.yaml_string(name), F.lit(":"))
        return F.concat_ws("\n", head, *[pair(n, pad) for n in INFO_FIELDS])

    style = LineStyle(
        header=("structure:",), between=(), footer=(),
        open_dir=lambda name, depth: F.concat(
            _indent(depth, indent), escape.yaml_string(name), F.lit(":")),
        close_dir=None,
        leaf=leaf,
    )
    extra = None
    if summary is not None:
        pad = " " * indent
        value = sr.json_value(F.col("kind"), F.col("value"), escape.yaml_string(F.col("value")))
        extra = summary.select(*sr.line(sr.key("1"), 0, F.lit("summary:"))).unionByName(
            sr.field_rows(summary).select(*sr.line(
                sr.key("2"), F.col("position"),
                F.concat(F.lit(pad), F.col("name"), F.lit(": "), value))))
        if failures is not None and not failures.isEmpty():
            extra = extra.unionByName(
                summary.select(*sr.line(sr.key("3"), 0, F.lit(f"{pad}failed_files:")))
            ).unionByName(failures.select(*sr.line(
                sr.key(F.lit("4"), F.col("file")), 0,
                F.concat(F.lit(f"{pad}- file: "), escape.yaml_string(F.col("file")),
                         F.lit(f"\n{pad}  error: "), escape.yaml_string(F.col("error"))))))
    return tree.tree_lines(entries, style, extra)


# ---- XML -----------------------------------------------------------------------------------

def xml_tree(entries: DataFrame, summary: DataFrame | None = None,
             failures: DataFrame | None = None, *, pretty: bool = True) -> DataFrame:
    """Lines of ``<repository>`` with nested ``<directory>`` and ``<file>`` elements."""
    step = 2 if pretty else 0

    def element(name: str, pad: Column) -> Column:
        value = F.col(name).cast("string")
        body = escape.xml_document_text(value) if _kind(name) == "string" else value
        return F.when(value.isNotNull(), F.concat(
            pad, F.lit(f"<{name}>"), body, F.lit(f"</{name}>")))

    def leaf(name: Column, depth: Column) -> Column:
        pad = _indent(depth, step)
        head = F.concat(pad, F.lit('<file name="'), escape.xml_attribute(name), F.lit('">'))
        inner = _indent(depth, step, 1)
        return F.concat_ws("\n", head, *[element(n, inner) for n in INFO_FIELDS],
                           F.concat(pad, F.lit("</file>")))

    style = LineStyle(
        header=("<repository>",), between=(), footer=("</repository>",),
        open_dir=lambda name, depth: F.concat(
            _indent(depth, step), F.lit('<directory name="'), escape.xml_attribute(name),
            F.lit('">')),
        close_dir=lambda depth: F.concat(_indent(depth, step), F.lit("</directory>")),
        leaf=leaf,
    )
    extra = None
    if summary is not None:
        tag = escape.xml_tag(F.col("name"))
        body = sr.field_rows(summary).select(*sr.line(
            sr.key("2"), F.col("position"),
            F.concat(F.lit("<"), tag, F.lit(">"), escape.xml_document_text(F.col("value")),
                     F.lit("</"), tag, F.lit(">"))))
        extra = sr.one_line(summary, sr.key("1"), 0, "<summary>").unionByName(body).unionByName(
            sr.one_line(summary, sr.key("5"), 0, "</summary>"))
        if failures is not None:
            extra = extra.unionByName(failures.select(*sr.line(
                sr.key(F.lit("4"), F.col("file")), 0,
                F.concat(F.lit('<failed_file name="'), escape.xml_attribute(F.col("file")),
                         F.lit('">'), escape.xml_document_text(F.col("error")),
                         F.lit("</failed_file>")))))
    return tree.tree_lines(entries, style, extra)


# ---- DOT -----------------------------------------------------------------------------------

def _numbered_block(lines: DataFrame, block: str, sort: Column, rank: int = 0) -> DataFrame:
    return lines.select(*sr.line(F.array(F.lit(block), sort), rank, F.col("line")))


def dot_graph(entries: DataFrame, summary: DataFrame | None = None,
              failures: DataFrame | None = None, *, dir_color: str = DIR_COLOUR,
              file_color: str = FILE_COLOUR, summary_color: str = SUMMARY_COLOUR,
              rankdir: str = "LR", include_content: bool = False,
              detailed: bool = False) -> DataFrame:
    """Lines of a digraph with folder and note nodes; ids are whole paths.

    ``detailed`` adds size, times, permissions and hash to the labels of files.
    """
    spark = entries.sparkSession
    path = F.col("path")
    label = escape.dot_label(F.col("filename"))
    if detailed:
        label = F.concat(label, *[
            part for title, name, unit in DOT_DETAILS for part in (
                F.lit("\\n" + title),
                F.coalesce(F.col(name).cast("string"), F.lit(NOT_AVAILABLE)), F.lit(unit))
        ])
    if include_content:
        characters = DOT_DETAILED_CHARACTERS if detailed else DOT_CONTENT_CHARACTERS
        clipped = escape.dot_label(escape.clip(F.col("content"), characters))
        label = F.concat_ws("\\nContent: ", label, clipped)
    node = F.concat(F.lit("    "), escape.dot_quoted(path))
    dirs = tree.directories(entries).select(
        path.alias("sort"),
        F.concat(node, F.lit(' [label="'), escape.dot_label(F.col("name")),
                 F.lit(f'", shape=folder, color="{dir_color}"];')).alias("line"))
    files = entries.select(
        path.alias("sort"),
        F.concat(node, F.lit(' [label="'), label,
                 F.lit(f'", shape=note, color="{file_color}"];')).alias("line"))
    edges = tree.edges(entries).select(
        F.col("dst").alias("sort"),
        F.concat(F.lit("    "), escape.dot_quoted(F.col("src")), F.lit(" -> "),
                 escape.dot_quoted(F.col("dst")), F.lit(";")).alias("line"))
    blocks = [(["1"], (*DOT_PREAMBLE, f"    rankdir={rankdir};")), (["7"], ("}",))]
    if summary is not None:
        blocks += [(["4"], DOT_CLUSTER), (["6"], ("    }",))]
    lines = tree.fixed_lines(spark, *blocks)
    for block, part in (("2", dirs.unionByName(files)), ("3", edges)):
        lines = lines.unionByName(_numbered_block(part, block, F.col("sort")))
    if summary is not None:
        text = F.concat_ws(": ", "name", "value")
        rows = sr.field_rows(summary).select(
            F.array(F.lit("5"), F.col("name")).alias("key"), F.lit(0).alias("rank"),
            F.concat(F.lit('        "summary_'), escape.dot_id(F.col("name")), F.lit('" [label="'),
                     escape.dot_label(text),
                     F.lit(f'", shape=note, color="{summary_color}"];')).alias("line"))
        lines = lines.unionByName(rows)
    return lines


def styled_dot(entries: DataFrame) -> DataFrame:
    """Lines of a digraph coloured by type, with size labels and tooltips, in path order."""
    spark = entries.sparkSession
    attributes = [
        F.when(F.col(column).isNotNull(), F.concat(
            F.lit(f'{name}="'), escape.dot_label(F.col(column)), F.lit('"')))
        for name, column in (
            ("label", "label"), ("fillcolor", "fillcolor"), ("color", "color"),
            ("shape", "shape"), ("style", "style"), ("penwidth", "penwidth"), ("tooltip", "tip"))
    ]
    nodes = tree.graph_nodes(entries).select(
        F.col("id").alias("sort"),
        F.concat(F.lit("  "), escape.dot_quoted(F.col("id")), F.lit(" ["),
                 F.concat_ws(", ", *attributes), F.lit("];")).alias("line"))
    edges = tree.edges(entries).select(
        F.col("dst").alias("sort"),
        F.concat(F.lit("  "), escape.dot_quoted(F.col("src")), F.lit(" -> "),
                 escape.dot_quoted(F.col("dst")), F.lit(";")).alias("line"))
    return (
        tree.fixed_lines(spark, (["1"], DOT_STYLED_PREAMBLE), (["3"], ("}",)))
        .unionByName(_numbered_block(nodes, "2", F.col("sort"), 0))
        .unionByName(_numbered_block(edges, "2", F.col("sort"), 1))
    )


# ---- S-expressions -------------------------------------------------------------------------

def sexp_tree(entries: DataFrame, summary: DataFrame | None = None,
              failures: DataFrame | None = None, *, include_content: bool = True) -> DataFrame:
    """Lines of ``(repository (directory name (file name :type ...)))``."""
    names = [n for n in INFO_FIELDS if include_content or n != "content"]

    def leaf(name: Column, depth: Column) -> Column:
        pad = _indent(depth, 2)
        columns = {n: (F.col(n), _kind(n)) for n in names}
        body = escape.sexp_properties(columns, _indent(depth, 2, 1))
        return F.concat_ws(
            "\n",
            F.concat(pad, F.lit("(file "), escape.sexp_text(name, "name")),
            F.nullif(body, F.lit("")),
            F.concat(pad, F.lit(")")),
        )

    style = LineStyle(
        header=("(repository",), between=(), footer=(")",),
        open_dir=lambda name, depth: F.concat(
            _indent(depth, 2), F.lit("(directory "), escape.sexp_text(name, "name")),
        close_dir=lambda depth: F.concat(_indent(depth, 2), F.lit(")")),
        leaf=leaf,
    )
    extra = None
    if summary is not None:
        value = (
            F.when(F.col("kind") == sr.BOOLEAN, escape.sexp_bool(F.col("value") == "true"))
            .when(F.col("kind") == sr.NUMBER, escape.sexp_number(F.col("value").try_cast("double")))
            .otherwise(escape.sexp_text(F.col("value")))
        )
        body = sr.field_rows(summary).select(*sr.line(
            sr.key("2"), F.col("position"),
            F.concat(F.lit("    :"), F.replace("name", F.lit("_"), F.lit("-")), F.lit(" "), value)))
        extra = sr.one_line(summary, sr.key("1"), 0, "  (summary").unionByName(body).unionByName(
            sr.one_line(summary, sr.key("5"), 0, "  )"))
        if failures is not None and not failures.isEmpty():
            extra = extra.unionByName(
                sr.one_line(summary, sr.key("3"), 0, "    (failed-files")
            ).unionByName(failures.select(*sr.line(
                sr.key(F.lit("4"), F.col("file")), 0,
                F.concat(F.lit("      (failure\n        :error "),
                         escape.sexp_text(F.col("error"), "error"),
                         F.lit("\n        :path "), escape.sexp_text(F.col("file")),
                         F.lit("\n      )"))))
            ).unionByName(sr.one_line(summary, sr.key("4", tree.LAST), 0, "    )"))
    return tree.tree_lines(entries, style, extra)


# ---- writing -------------------------------------------------------------------------------

def write_lines(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Part files (about ``parts``, if given) that read in name order as one document."""
    tree.in_order(lines, parts).write.text(path)


def write_parquet(entries: DataFrame, path: str) -> None:
    entries.write.option("compression", "zstd").parquet(path)


def write_graph_tables(entries: DataFrame, path: str) -> None:
    tree.graph_nodes(entries).write.parquet(f"{path}/nodes")
    tree.edges(entries).write.parquet(f"{path}/edges")


def _text_sink(build):
    def sink(entries, summary, failures, path, *, parts=None, **options):
        write_lines(build(entries, summary, failures, **options), path, parts)
    return sink


def _jsonl_sink(entries, summary, failures, path, *, remove_empty_fields=False):
    jsonl_rows(entries, remove_empty_fields=remove_empty_fields).write.option(
        "ignoreNullFields", str(remove_empty_fields).lower()).json(path)
    if summary is not None:
        summary.select(F.struct(*summary.columns).alias("summary")).write.json(f"{path}.summary")


def _csv_sink(entries, summary, failures, path):
    csv_rows(entries).write.option("header", True).option("escape", '"').csv(path)


def _xml_flat_sink(entries, summary, failures, path):
    entries.select("path", *INFO_FIELDS).write.format("xml").option("rowTag", "file").option(
        "rootTag", "repository").save(path)


SINKS = {
    "json": _text_sink(json_tree),
    "json_array": _text_sink(json_array),
    "jsonl": _jsonl_sink,
    "csv": _csv_sink,
    "yaml": _text_sink(yaml_tree),
    "xml": _text_sink(xml_tree),
    "xml_flat": _xml_flat_sink,
    "dot": _text_sink(dot_graph),
    "dot_styled": lambda entries, summary, failures, path: write_lines(styled_dot(entries), path),
    "sexp": _text_sink(sexp_tree),
    "parquet": lambda entries, summary, failures, path: write_parquet(entries, path),
    "graph": lambda entries, summary, failures, path: write_graph_tables(entries, path),
}


def write(fmt: str, entries: DataFrame, path: str, *, summary: DataFrame | None = None,
          failures: DataFrame | None = None, **options) -> None:
    """Write ``entries`` as ``fmt``. A summary and its failed files are left out when None.

    The sorted text formats evaluate ``entries`` twice (once to sample the sort ranges): give
    them a written table rather than a plan that reads files.
    """
    if fmt not in SINKS:
        raise ValueError(f"unknown format {fmt!r}, choose one of {sorted(SINKS)}")
    SINKS[fmt](entries, summary, failures, path, **options)
