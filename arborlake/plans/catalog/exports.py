"""Queries on the exports: the rows and ordered lines each sink writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import tree
from arborlake.plans import views
from arborlake.plans.analysis import analyse
from arborlake.functions.paths import path_parts
from arborlake.plans.catalog.registry import ORACLE, SMALL, WHOLE, query
from arborlake.schema import ENTRY_COLUMNS
from arborlake.session import materialise, new_work_path
from arborlake.sinks import documents, runs as run_sinks
from arborlake.sources import exports, nested, wellformed

LAST = tree.LAST


def _run(spark, sf_dir):
    return analyse(views.files(spark, sf_dir), WHOLE)


def _keyed(lines):
    """Lines with their sort key as text, so that order is part of the check."""
    return lines.select(
        F.replace(F.array_join("key", "/"), F.lit(LAST), F.lit("~")).alias("sort_key"),
        F.col("rank").cast("long").alias("rank"), "line")


_JSON_INFO = """concat('{', concat_ws(',', '"type":' || to_json(type),
  '"reason":' || to_json(reason), '"encoding":' || to_json(encoding),
  '"content":' || to_json(content), '"preview_bytes":' || preview_bytes, '"size":' || size,
  '"modified":' || to_json(modified), '"permissions":' || to_json(permissions),
  '"timezone":' || to_json(timezone)), '}')"""

_NODES = """(SELECT path, parent, name FROM dirs_v UNION ALL
  SELECT path, parent, filename FROM entries_v)"""

_SEPARATORS = f"""SELECT path AS sort_key, 0 AS rank, ',' AS line FROM {_NODES}
  QUALIFY row_number() OVER (PARTITION BY parent ORDER BY name) > 1"""

_SUMMARY_VALUES = [
    ("total_files", "total_files"), ("excluded_files", "excluded_files"),
    ("included_files", "included_files"), ("excluded_percentage", "excluded_percentage"),
    ("stopped_early", "stopped_early"), ("processed_files", "processed_files"),
    ("hash_algorithm", "hash_algorithm"),
]


@query("json_tree", f"""SELECT unnest(['', '', '~', '~/~']) AS sort_key,
    CAST(unnest([0, 1, 0, 0]) AS BIGINT) AS rank,
    unnest(['{{', '"structure": {{', '}}', '}}']) AS line
  UNION ALL SELECT path, 1, concat(repeat(' ', CAST(4 * (depth + 1) AS INTEGER)), to_json(name),
    ': {{') FROM dirs_v
  UNION ALL SELECT concat(path, '/~'), 2, concat(repeat(' ', CAST(4 * (depth + 1) AS INTEGER)), '}}')
    FROM dirs_v
  UNION ALL SELECT path, 1, concat(repeat(' ', CAST(4 * (len(string_split(path, '/')) + 1)
    AS INTEGER)), to_json(filename), ': ', {_JSON_INFO}) FROM entries_v
  UNION ALL {_SEPARATORS}""")
def json_tree(spark, sf_dir):
    return _keyed(documents.json_tree(_run(spark, sf_dir).entries))


@query("json_array", f"""SELECT unnest(['', '~', '~/~']) AS sort_key,
    CAST(unnest([0, 0, 0]) AS BIGINT) AS rank, unnest(['{{"structure": [', ']', '}}']) AS line
  UNION ALL SELECT path, 1, concat('{{"parent":', to_json(parent), ',"filename":',
    to_json(filename), ',"path":', to_json(path), ',"info":', {_JSON_INFO}, '}}') FROM entries_v
  UNION ALL SELECT path, 0, ',' FROM entries_v WHERE path > (SELECT min(path) FROM entries_v)""")
def json_array(spark, sf_dir):
    return _keyed(documents.json_array(_run(spark, sf_dir).entries))


@query("jsonl_rows", """SELECT path, type, size, coalesce(created, '') AS created,
    coalesce(modified, '') AS modified, coalesce(permissions, '') AS permissions,
    coalesce(hash, '') AS hash, coalesce(content, '') AS content FROM entries_v""")
def jsonl_rows(spark, sf_dir):
    return documents.jsonl_rows(_run(spark, sf_dir).entries)


@query("csv_rows", """SELECT path AS "Path", type AS "Type", size AS "Size", created AS "Created",
    modified AS "Modified", permissions AS "Permissions", coalesce(timezone, 'UTC') AS "Timezone"
  FROM entries_v""")
def csv_rows(spark, sf_dir):
    return documents.csv_rows(_run(spark, sf_dir).entries)


@query("yaml_tree", """SELECT '' AS sort_key, CAST(0 AS BIGINT) AS rank, 'structure:' AS line
  UNION ALL SELECT path, 1, concat(repeat(' ', CAST(2 * depth AS INTEGER)), to_json(name), ':')
    FROM dirs_v
  UNION ALL SELECT path, 1, concat_ws(chr(10),
      concat(repeat(' ', CAST(pad - 2 AS INTEGER)), to_json(filename), ':'),
      p || 'type: ' || to_json(type), p || 'reason: ' || to_json(reason),
      p || 'encoding: ' || to_json(encoding), p || 'content: ' || to_json(content),
      p || 'preview_bytes: ' || preview_bytes, p || 'size: ' || size,
      p || 'modified: ' || to_json(modified), p || 'permissions: ' || to_json(permissions),
      p || 'timezone: ' || to_json(timezone))
    FROM (SELECT *, 2 * len(string_split(path, '/')) + 2 AS pad,
      repeat(' ', CAST(2 * len(string_split(path, '/')) + 2 AS INTEGER)) AS p FROM entries_v)""")
def yaml_tree(spark, sf_dir):
    return _keyed(documents.yaml_tree(_run(spark, sf_dir).entries))


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("xml_tree", f"""SELECT unnest(['', '~/~']) AS sort_key, CAST(unnest([0, 0]) AS BIGINT) AS rank,
    unnest(['<repository>', '</repository>']) AS line
  UNION ALL SELECT path, 1, concat(repeat(' ', CAST(2 * depth AS INTEGER)), '<directory name="',
    name, '">') FROM dirs_v
  UNION ALL SELECT concat(path, '/~'), 2, concat(repeat(' ', CAST(2 * depth AS INTEGER)),
    '</directory>') FROM dirs_v
  UNION ALL SELECT path, 1, concat_ws(chr(10), concat(q, '<file name="', filename, '">'),
      p || '<type>' || type || '</type>', p || '<reason>' || reason || '</reason>',
      p || '<encoding>' || encoding || '</encoding>',
      p || '<content>' || {_XML.format('content')} || '</content>',
      p || '<preview_bytes>' || preview_bytes || '</preview_bytes>', p || '<size>' || size ||
      '</size>', p || '<modified>' || modified || '</modified>',
      p || '<permissions>' || permissions || '</permissions>',
      p || '<timezone>' || timezone || '</timezone>', concat(q, '</file>'))
    FROM (SELECT *, repeat(' ', CAST(2 * len(string_split(path, '/')) AS INTEGER)) AS q,
      repeat(' ', CAST(2 * len(string_split(path, '/')) + 2 AS INTEGER)) AS p FROM entries_v)""")
def xml_tree(spark, sf_dir):
    return _keyed(documents.xml_tree(_run(spark, sf_dir).entries))


@query("dot_graph", f"""SELECT unnest(['1', '1', '1', '4', '4', '4', '6', '7']) AS sort_key,
    CAST(unnest([0, 1, 2, 0, 1, 2, 0, 0]) AS BIGINT) AS rank,
    unnest(['digraph RepositoryStructure {{',
      '    node [shape=box, style=filled, color="#ADD8E6"];', '    rankdir=LR;',
      '    subgraph cluster_summary {{', '        label="Summary";', '        color=lightgrey;',
      '    }}', '}}']) AS line
  UNION ALL SELECT concat('2/', path), 0,
    concat('    "', path, '" [label="', name, '", shape=folder, color="#FFA500"];') FROM dirs_v
  UNION ALL SELECT concat('2/', path), 0,
    concat('    "', path, '" [label="', filename, '", shape=note, color="#90EE90"];') FROM entries_v
  UNION ALL SELECT concat('3/', path), 0, concat('    "', parent, '" -> "', path, '";')
    FROM (SELECT path, parent FROM dirs_v UNION ALL SELECT path, parent FROM entries_v)
    WHERE parent <> ''
  UNION ALL SELECT concat('5/', name), 0, concat('        "summary_', name, '" [label="', name,
    ': ', value, '", shape=note, color="#D3D3D3"];')
    FROM (SELECT unnest([{', '.join("'" + n + "'" for n, _ in _SUMMARY_VALUES)}]) AS name,
      unnest([{', '.join(f'CAST({c} AS VARCHAR)' for _, c in _SUMMARY_VALUES)}]) AS value
      FROM all_summary_v)""")
def dot_graph(spark, sf_dir):
    run = _run(spark, sf_dir)
    return _keyed(documents.dot_graph(run.entries, run.summary()))


@query("dot_detailed_nodes", """SELECT concat('2/', path) AS sort_key, CAST(0 AS BIGINT) AS rank,
    concat('    "', path, '" [label="', filename, '\\nSize: ', coalesce(CAST(size AS VARCHAR), 'N/A'),
      ' bytes\\nCreated: ', coalesce(created, 'N/A'), '\\nModified: ', coalesce(modified, 'N/A'),
      '\\nPermissions: ', coalesce(permissions, 'N/A'), '\\nHash: ', coalesce(hash, 'N/A'),
      CASE WHEN content IS NULL THEN '' ELSE concat('\\nContent: ', replace(replace(
        substr(content, 1, 900000), '"', '\\"'), chr(10), '\\n')) END,
      '", shape=note, color="#90EE90"];') AS line FROM entries_v""")
def dot_detailed_nodes(spark, sf_dir):
    lines = documents.dot_graph(
        _run(spark, sf_dir).entries, detailed=True, include_content=True)
    return _keyed(lines.filter(F.contains("line", F.lit("shape=note, color"))))


_STYLE = """CASE kind WHEN 'directory' THEN
    'fillcolor="#FFF3E0", color="#E65100", shape="folder", style="filled"'
  WHEN 'excluded' THEN
    'fillcolor="#F5F5F5", color="#9E9E9E", shape="box", style="filled,dashed", penwidth="1.0"'
  ELSE 'fillcolor="#E8F5E9", color="#2E7D32", shape="note", style="filled"' END"""


@query("styled_dot", f"""SELECT concat('2/', path) AS sort_key, CAST(0 AS BIGINT) AS rank,
    concat('  "', path, '" [', concat_ws(', ', concat('label="', label, '"'), {_STYLE},
      'tooltip="' || tooltip || '"'), '];') AS line
    FROM (SELECT path, name AS label, 'directory' AS kind, NULL AS tooltip FROM dirs_v
      UNION ALL SELECT path, concat(filename, CASE WHEN size IS NULL THEN ''
          WHEN size < 1024 THEN concat('\\n', size, ' B')
          ELSE printf('%s%.1f KB', '\\n', size / 1024.0) END), type,
        CASE WHEN type = 'text' THEN concat('encoding: ', encoding, '\\nmodified: ', modified,
          '\\npermissions: ', permissions) END FROM entries_v)
  UNION ALL SELECT concat('2/', path), 1, concat('  "', parent, '" -> "', path, '";')
    FROM (SELECT path, parent FROM dirs_v UNION ALL SELECT path, parent FROM entries_v)
    WHERE parent <> ''
  UNION ALL SELECT '3', 0, '}}'
  UNION ALL SELECT '1', unnest([0, 1, 2, 3]), unnest(['digraph Repository {{',
    '  graph [rankdir="LR", splines="ortho", ranksep="1.5", nodesep="0.8", pad="0.5", bgcolor="white"];',
    '  node [fontname="Helvetica", fontsize="10", shape="box", style="filled", margin="0.2"];',
    '  edge [color="#666666", penwidth="1.2", arrowsize="0.8"];'])""")
def styled_dot(spark, sf_dir):
    return _keyed(documents.styled_dot(_run(spark, sf_dir).entries))


_SEXP = (r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'),"""
         r""" chr(13), '\r'), chr(9), '\t')""")


@query("sexp_tree", f"""SELECT unnest(['', '~/~']) AS sort_key,
    CAST(unnest([0, 0]) AS BIGINT) AS rank, unnest(['(repository', ')']) AS line
  UNION ALL SELECT path, 1, concat(repeat(' ', CAST(2 * depth AS INTEGER)), '(directory ', name)
    FROM dirs_v
  UNION ALL SELECT concat(path, '/~'), 2, concat(repeat(' ', CAST(2 * depth AS INTEGER)), ')')
    FROM dirs_v
  UNION ALL SELECT path, 1, concat_ws(chr(10), concat(q, '(file ', filename),
      p || ':type "' || type || '"', p || ':size ' || size, p || ':encoding "' || encoding || '"',
      p || ':permissions ' || permissions, p || ':modified "' || modified || '"',
      p || ':content "' || {_SEXP.format('content')} || '"', p || ':preview-bytes ' || preview_bytes,
      p || ':reason ' || reason, p || ':timezone ' || timezone, concat(q, ')'))
    FROM (SELECT *, repeat(' ', CAST(2 * len(string_split(path, '/')) AS INTEGER)) AS q,
      repeat(' ', CAST(2 * len(string_split(path, '/')) + 2 AS INTEGER)) AS p FROM entries_v)""")
def sexp_tree(spark, sf_dir):
    return _keyed(documents.sexp_tree(_run(spark, sf_dir).entries))


@query("run_export", """SELECT identifier, concat('{"display_name":', to_json(display_name),
    ',"duration_seconds":', duration_seconds, ',"identifier":', identifier, ',"output_format":',
    to_json(output_format), ',"preset":', to_json(preset), ',"processed_files":', processed_files,
    ',"repository":', to_json(repository), ',"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
    '","total_files":', total_files, '}') AS document FROM runs_v""")
def run_export(spark, sf_dir):
    return run_sinks.run_json(views.runs(spark, sf_dir))


@query("log_text", "SELECT formatted FROM logs_v")
def log_text(spark, sf_dir):
    """Written as text and read back."""
    path = new_work_path(spark, "log-text")
    run_sinks.write_log_text(views.logs(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "formatted")


@query("graph_nodes", """SELECT path AS id, name AS label, 'directory' AS kind, name AS title,
    '#FFF3E0' AS fillcolor, '#E65100' AS color, 'folder' AS shape FROM dirs_v
  UNION ALL SELECT path, label, type, coalesce(tooltip, label),
    CASE type WHEN 'excluded' THEN '#F5F5F5' ELSE '#E8F5E9' END,
    CASE type WHEN 'excluded' THEN '#9E9E9E' ELSE '#2E7D32' END,
    CASE type WHEN 'excluded' THEN 'box' ELSE 'note' END
  FROM (SELECT path, type, concat(filename, CASE WHEN size IS NULL THEN ''
        WHEN size < 1024 THEN concat(chr(10), size, ' B')
        ELSE printf('%s%.1f KB', chr(10), size / 1024.0) END) AS label,
      CASE WHEN type = 'text' THEN concat('encoding: ', encoding, '\\nmodified: ', modified,
        '\\npermissions: ', permissions) END AS tooltip FROM entries_v)""")
def graph_nodes(spark, sf_dir):
    nodes = tree.graph_nodes(_run(spark, sf_dir).entries)
    return nodes.select("id", "label", "kind", "title", "fillcolor", "color", "shape")


@query("parquet_export", "SELECT * FROM entries_v")
def parquet_export(spark, sf_dir):
    """Written with zstd and read back."""
    path = new_work_path(spark, "entries")
    documents.write("parquet", _run(spark, sf_dir).entries, path)
    return spark.read.parquet(path)


@query("export_validation", """SELECT true AS is_valid, count(*) AS records,
  CAST(NULL AS VARCHAR) AS reason FROM entries_v""")
def export_validation(spark, sf_dir):
    path = new_work_path(spark, "jsonl")
    documents.write("jsonl", _run(spark, sf_dir).entries, path)
    return exports.validate_export(spark, path)


@query("flatten_structure", """SELECT path, size FROM files_v""")
def flatten_structure(spark, sf_dir):
    """Every document as a nested tree of its own, flattened to paths again."""
    leaf = F.to_json(F.struct(F.lit("text").alias("type"), "size"))
    text = F.concat(F.lit('{"'), F.array_join(F.split("path", "/"), '":{"'), F.lit('":'), leaf,
                    F.repeat(F.lit("}"), F.size(F.split("path", "/"))))
    nested = views.files(spark, sf_dir).select(F.parse_json(text).alias("structure"))
    flat = exports.flatten_structure(nested)
    return flat.select("path", F.variant_get("info", "$.size", "bigint").alias("size"))


PARTS = 8  # part files of the documents that are read back
_READ_BACK = [c for c in ENTRY_COLUMNS if c != "hash"]  # the nested document holds no hash


@query("nested_round_trip", f"SELECT {', '.join(_READ_BACK)} FROM entries_v")
def nested_round_trip(spark, sf_dir):
    """The nested JSON document of all entries, written in several parts and read back as rows."""
    path = new_work_path(spark, "nested")
    run = _run(spark, sf_dir)
    documents.write("json", materialise(run.entries, "entries"), path, summary=run.summary(), parts=PARTS)
    return nested.read_nested_export(spark, path).entries.select(_READ_BACK)


@query("nested_summary", """SELECT 'failed' AS part, path AS name,
    'Failed to get file stats: not allowed' AS value FROM faulty_v WHERE failed
  UNION ALL SELECT 'summary', unnest(['total_files', 'excluded_files', 'included_files',
      'excluded_percentage', 'stopped_early', 'processed_files', 'hash_algorithm']),
    unnest([CAST(count(*) AS VARCHAR), '0', CAST(count(*) AS VARCHAR), '0.0', 'false',
      CAST(count(*) AS VARCHAR), '"md5"']) FROM faulty_v""")
def nested_summary(spark, sf_dir):
    """Summary and failed files of a nested JSON document, read back."""
    path = new_work_path(spark, "nested-summary")
    run = analyse(views.faulty_files(spark, sf_dir), SMALL)
    documents.write("json", materialise(run.entries, "entries"), path, summary=run.summary(),
                    failures=run.failures(), parts=PARTS)
    found = nested.read_nested_export(spark, path)
    return found.failures.select(
        F.lit("failed").alias("part"), F.col("file").alias("name"), F.col("error").alias("value")
    ).unionByName(found.summary.select(F.lit("summary").alias("part"), "name", "value"))


_DOCUMENTS = {"json": documents.json_tree, "xml": documents.xml_tree, "yaml": documents.yaml_tree}
# a line of each document, counted over the physical lines of all its parts
_NUMBERED = ", ".join(f"""{fmt}_lines AS (
  SELECT '{fmt}' AS format, sort_key, rank, length(line) - length(replace(line, chr(10), '')) + 1 AS own,
    sum(length(line) - length(replace(line, chr(10), '')) + 1)
      OVER (ORDER BY string_split(sort_key, '/'), rank) AS upto
  FROM ({ORACLE[f'{fmt}_tree']}))""" for fmt in _DOCUMENTS)
_ALL_LINES = " UNION ALL ".join(f"SELECT * FROM {fmt}_lines" for fmt in _DOCUMENTS)


def _validated(spark, sf_dir, plant):
    entries = materialise(_run(spark, sf_dir).entries, "entries")
    last = entries.agg(F.max("path")).first()[0]
    found = None
    for fmt, build in _DOCUMENTS.items():
        path = new_work_path(spark, f"document-{fmt}")
        lines = build(entries)
        own = (F.array_join("key", "/") == F.lit(last)) & (F.col("rank") == 1)
        documents.write_lines(lines.withColumn("line", F.when(own, plant[fmt](F.col("line"))).otherwise(
            F.col("line"))) if plant else lines, path, PARTS)
        one = wellformed.validate_nested(spark, path, fmt).withColumn("format", F.lit(fmt))
        found = one if found is None else found.unionByName(one)
    return found


@query("export_wellformed", f"""WITH {_NUMBERED} SELECT format, true AS is_valid,
    CAST(max(upto) AS BIGINT) AS lines, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS reason
  FROM ({_ALL_LINES}) GROUP BY format""")
def export_wellformed(spark, sf_dir):
    """JSON, XML and YAML documents of all entries, in several parts, found well-formed."""
    return _validated(spark, sf_dir, None)


@query("export_faults", f"""WITH {_NUMBERED} SELECT format, false AS is_valid,
    CAST(max(upto) AS BIGINT) AS lines,
    CAST(max(CASE WHEN sort_key = (SELECT max(path) FROM entries_v) AND rank = 1
      THEN CASE format WHEN 'xml' THEN upto - 1 ELSE upto - own END END) AS BIGINT) AS line,
    CASE format WHEN 'json' THEN '] closes {{' WHEN 'xml' THEN '</fil> closes <file>'
      ELSE 'unreadable text' END AS reason
  FROM ({_ALL_LINES}) GROUP BY format""")
def export_faults(spark, sf_dir):
    """The same documents with a fault in the last file's lines: it is found, and in its line."""
    return _validated(spark, sf_dir, {
        "json": lambda line: F.concat(line, F.lit("]")),
        "xml": lambda line: F.regexp_replace(line, "</file>$", "</fil>"),
        "yaml": lambda line: F.replace(line, F.lit('":\n'), F.lit(":\n")),
    })


_SUMMED = "(SELECT count(*) AS n, count(*) FILTER (failed) AS failed FROM faulty_v)"
_FAILED = "(SELECT path, row_number() OVER (ORDER BY path) AS i FROM faulty_v WHERE failed)"
_ERROR = "Failed to get file stats: not allowed"


def _summary_sql(fmt: str, fixed: list[tuple[str, int, str]], fields: str, failed: str) -> str:
    """SQL for the lines behind the structure; ``fields`` holds {n} for a name and {v} for a value."""
    names = ("total_files", "excluded_files", "included_files", "excluded_percentage", "stopped_early",
             "processed_files", "hash_algorithm")
    values = {"json_array": ("0.0", "false", '"md5"'), "yaml": ("0.0", "false", '"md5"'),
              "xml": ("0.0", "false", "md5"), "sexp": ("0", "nil", "md5")}[fmt]
    shown = ("n", "'0'", "n", f"'{values[0]}'", f"'{values[1]}'", "n", f"'{values[2]}'")
    own = [n.replace("_", "-") if fmt == "sexp" else n for n in names]
    lines = ", ".join("concat(" + ", ".join(
        v if part == "{v}" else f"'{part.replace('{n}', n)}'"
        for part in fields.split("|")) + ")" for n, v in zip(own, shown))
    blocks = "".join(f" UNION ALL SELECT '{fmt}', '{k}', {r}, '{line}'" for k, r, line in fixed)
    return (f"SELECT '{fmt}' AS format, '~/2' AS sort_key, unnest([0, 1, 2, 3, 4, 5, 6])::BIGINT AS rank,"
            f" unnest([{lines}]) AS line FROM {_SUMMED}{blocks} UNION ALL {failed}")


_SUMMARY_LINES = " UNION ALL ".join((
    _summary_sql("json_array", [("~", 0, "]"), ("~/~", 0, "}"), ("~/1", 0, ',"summary": {'),
                                ("~/3", 0, '"failed_files": ['), ("~/5", 0, "]}")], '"{n}": |{v}|,', f"""
      SELECT 'json_array', concat('~/4/', path), 1, concat('{{"file":', to_json(path), ',"error":"{_ERROR}"}}')
      FROM {_FAILED} UNION ALL SELECT 'json_array', concat('~/4/', path), 0, ',' FROM {_FAILED} WHERE i > 1"""),
    _summary_sql("yaml", [("~/1", 0, "summary:"), ("~/3", 0, "  failed_files:")], "  {n}: |{v}", f"""
      SELECT 'yaml', concat('~/4/', path), 0, concat('  - file: ', to_json(path), chr(10), '    error: "{_ERROR}"')
      FROM {_FAILED}"""),
    _summary_sql("xml", [("~/1", 0, "<summary>"), ("~/5", 0, "</summary>"), ("~/~", 0, "</repository>")],
                 "<{n}>|{v}|</{n}>", f"""
      SELECT 'xml', concat('~/4/', path), 0, concat('<failed_file name="', path, '">{_ERROR}</failed_file>')
      FROM {_FAILED}"""),
    _summary_sql("sexp", [("~/1", 0, "  (summary"), ("~/3", 0, "    (failed-files"), ("~/4/~", 0, "    )"),
                          ("~/5", 0, "  )"), ("~/~", 0, ")")], "    :{n} |{v}", f"""
      SELECT 'sexp', concat('~/4/', path), 0, concat('      (failure', chr(10), '        :error "{_ERROR}"', chr(10),
        '        :path ', path, chr(10), '      )') FROM {_FAILED}""")))


@query("export_summary_lines", _SUMMARY_LINES)
def export_summary_lines(spark, sf_dir):
    """What stands behind the structure in the line formats: summary and failed files."""
    run = analyse(views.faulty_files(spark, sf_dir), SMALL)
    entries, totals, failed = (materialise(df, "faulty") for df in (run.entries, run.summary(), run.failures()))
    found = None
    for fmt, build in (("json_array", documents.json_array), ("yaml", documents.yaml_tree),
                       ("xml", documents.xml_tree), ("sexp", documents.sexp_tree)):
        lines = build(entries, totals, failed).filter(F.try_element_at("key", F.lit(1)) == LAST)
        one = _keyed(lines).withColumn("format", F.lit(fmt))
        found = one if found is None else found.unionByName(one)
    return found
