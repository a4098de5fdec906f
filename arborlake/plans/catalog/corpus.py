"""Queries on files: rules, paths, classes, content, times, display and escaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.functions import classify, content, display, escape, lists, paths, patterns, times
from arborlake.operators import analysis, filters, repos, summary, tree
from arborlake.options import ScanOptions
from arborlake.plans import views
from arborlake.plans.analysis import analyse
from arborlake.plans.catalog.registry import OPTIONS, SMALL, WHOLE, query, sql_array, sql_iso, sql_list
from arborlake.sources import records

# ---- the run as a whole --------------------------------------------------------------------


@query("analyse_files", "SELECT * FROM entries_v")
def analyse_files(spark, sf_dir):
    return analyse(views.files(spark, sf_dir), WHOLE).entries


@query("analyse_files_limited", "SELECT * FROM limited_entries_v")
def analyse_files_limited(spark, sf_dir):
    return analyse(views.files(spark, sf_dir), OPTIONS).entries


@query("faulty_entries", f"""SELECT path, type, CASE WHEN type = 'excluded' THEN 'file_size' END AS reason,
    CASE WHEN type = 'text' THEN CASE WHEN octet_length(encode(left(text, 1000))) =
        length(left(text, 1000)) THEN 'ascii' ELSE 'utf_8' END
      WHEN type = 'binary' THEN 'base64' END AS encoding,
    CASE type WHEN 'text' THEN decode(unhex(substr(h, 1, 2 * CASE
        WHEN substr(h, 2001, 1) NOT IN ('8', '9', 'A', 'B') THEN 1000
        WHEN substr(h, 1999, 1) NOT IN ('8', '9', 'A', 'B') THEN 999
        WHEN substr(h, 1997, 1) NOT IN ('8', '9', 'A', 'B') THEN 998 ELSE 997 END)))
        || CASE WHEN substr(h, 2001, 1) IN ('8', '9', 'A', 'B') THEN chr(65533) ELSE '' END WHEN 'binary' THEN to_base64((encode(text))[1:500])
      WHEN 'error' THEN 'Failed to get file stats: not allowed' END AS content,
    CASE type WHEN 'text' THEN least(size, 1000) WHEN 'binary' THEN least(size, 500) END AS preview_bytes,
    CASE WHEN (type = 'text' AND size > 1000) OR (type = 'binary' AND size > 500) THEN true END AS truncated,
    CASE WHEN type <> 'error' THEN size END AS size,
    CASE WHEN type IN ('text', 'binary') THEN {sql_iso(f'(mtime_us - {views.HOUR_US})')} END AS created,
    CASE WHEN type IN ('text', 'binary') THEN md5(text) END AS hash,
    CASE WHEN type = 'error' THEN 'PermissionError' END AS exception_type,
    CASE WHEN type = 'error' THEN 'not allowed' END AS exception_message
  FROM (SELECT *, hex(encode(text)) AS h FROM faulty_v)""")
def faulty_entries(spark, sf_dir):
    """Error, binary, cut and excluded entries with their whole previews."""
    found = analyse(views.faulty_files(spark, sf_dir), SMALL).entries
    return found.select(
        "path", "type", "reason", "encoding", "content", "preview_bytes", "truncated", "size", "created",
        "hash", "exception_type", "exception_message")


@query("failed_files", """SELECT path AS file, 'Failed to get file stats: not allowed' AS error
  FROM faulty_v WHERE failed""")
def failed_files(spark, sf_dir):
    return analyse(views.faulty_files(spark, sf_dir), SMALL).failures()


@query("failed_summary", """SELECT count(*) AS total_files, CAST(0 AS BIGINT) AS excluded_files,
    count(*) AS included_files, 0.0::DOUBLE AS excluded_percentage, count(*) FILTER (failed) AS failed_files,
    false AS stopped_early, count(*) AS processed_files,
    'md5' AS hash_algorithm FROM faulty_v""")
def failed_summary(spark, sf_dir):
    return analyse(views.faulty_files(spark, sf_dir), SMALL).summary()


@query("faulty_tree", """SELECT path, parent, filename AS name,
    CAST(len(string_split(path, '/')) AS BIGINT) AS depth, type AS kind FROM faulty_v
  UNION ALL SELECT path, parent, name, depth, 'directory' FROM dirs_v""")
def faulty_tree(spark, sf_dir):
    """The hierarchy with failed, binary and excluded files."""
    return tree.nodes(analyse(views.faulty_files(spark, sf_dir), SMALL).entries)


@query("entry_types", """SELECT type, reason, count(*) AS files FROM tagged_v
  WHERE NOT name_excluded GROUP BY type, reason""")
def entry_types(spark, sf_dir):
    return summary.type_counts(analyse(views.files(spark, sf_dir), OPTIONS).rows)


@query("entry_scan_ordered", "SELECT path, filename, size FROM files_v ORDER BY path")
def entry_scan_ordered(spark, sf_dir):
    return views.files(spark, sf_dir).select("path", "filename", "size").orderBy("path")


@query("bounded_content_read", """SELECT path, least(size, 5242880) AS bytes_read,
  md5(text) AS digest FROM files_v""")
def bounded_content_read(spark, sf_dir):
    raw = content.preview(F.col("content"), ScanOptions().text_limit)
    return views.files(spark, sf_dir).select(
        "path", F.octet_length(raw).cast("long").alias("bytes_read"), F.md5(raw).alias("digest"))


# ---- exclusion rules -----------------------------------------------------------------------


@query("exclude_folder_name", f"""SELECT path FROM files_v WHERE NOT
  list_has_any(string_split(parent, '/'), {sql_array(OPTIONS.excluded_folders)})""")
def exclude_folder_name(spark, sf_dir):
    files = views.files(spark, sf_dir).select("path", "parent")
    return files.filter(
        ~filters.in_excluded_folder(F.col("parent"), OPTIONS.excluded_folders)).select("path")


@query("exclude_folder_pattern", """SELECT path FROM files_v WHERE NOT list_bool_or(
  list_transform(string_split(parent, '/'), lambda x: x LIKE 'node%'
    OR regexp_matches(x, '^(?:b.i)') OR regexp_matches(x, '^src[0-4]$')))""")
def exclude_folder_pattern(spark, sf_dir):
    rules = ("node*", "regex:b.i", "src[0-4]")
    files = views.files(spark, sf_dir).select("path", "parent")
    return files.filter(~filters.in_matching_folder(F.col("parent"), rules)).select("path")


@query("exclude_file_name",
       f"SELECT path FROM files_v WHERE filename NOT IN {sql_list(OPTIONS.excluded_files)}")
def exclude_file_name(spark, sf_dir):
    files = views.files(spark, sf_dir).select("path", "filename")
    return files.filter(
        ~filters.has_excluded_name(F.col("filename"), OPTIONS.excluded_files)).select("path")


@query("exclude_glob", r"""SELECT path FROM files_v WHERE NOT (filename LIKE '%.tmp'
  OR regexp_matches(filename, '^f[0-4].*\.md$') OR regexp_matches(filename, '^f.\.txt$')
  OR regexp_matches(filename, '^f[^1-8].*\.py$'))""")
def exclude_glob(spark, sf_dir):
    globs = ("*.tmp", "f[0-4]*.md", "f?.txt", "f[!1-8]*.py")
    files = views.files(spark, sf_dir).select("path", "filename")
    return files.filter(~patterns.matches_any(F.col("filename"), globs)).select("path")


_MANY = (
    *(f"f{7 * i}.txt" for i in range(1500)), *(f"*{11 * i}.md" for i in range(1500)),
    *(f"f{13 * i}.p*" for i in range(1500)), *(rf"regex:f{17 * i}\.(json|dat)$" for i in range(500)))


@query("exclude_many_rules", r"""SELECT path FROM files_v WHERE NOT (
  filename IN (SELECT concat('f', 7 * i, '.txt') FROM range(1500) t(i))
  OR list_bool_or(list_transform(range(1500), lambda i: ends_with(filename, concat(11 * i, '.md'))))
  OR list_bool_or(list_transform(range(1500), lambda i: starts_with(filename, concat('f', 13 * i, '.p'))))
  OR filename IN (SELECT concat('f', 17 * i, s) FROM range(500) t(i), (VALUES ('.json'), ('.dat')) v(s)))""")
def exclude_many_rules(spark, sf_dir):
    """5,000 rules of all kinds in one test."""
    files = views.files(spark, sf_dir).select("path", "filename")
    return files.filter(~patterns.matches_any(F.col("filename"), _MANY)).select("path")


@query("exclude_regex", r"""SELECT path FROM files_v
  WHERE NOT regexp_matches(filename, '^(?:f\d*7\.(json|dat))')""")
def exclude_regex(spark, sf_dir):
    rules = (r"regex:f\d*7\.(json|dat)", "regex:([")
    files = views.files(spark, sf_dir).select("path", "filename")
    return files.filter(~patterns.matches_any(F.col("filename"), rules)).select("path")


@query("matches_any_pattern", r"""SELECT path, filename LIKE '%.png' OR filename LIKE 'f1%'
  OR regexp_matches(filename, '^(?:.*\.dat)') AS matched FROM files_v""")
def matches_any_pattern(spark, sf_dir):
    rules = ("*.png", "f1*", r"regex:.*\.dat")
    return views.files(spark, sf_dir).select(
        "path", patterns.matches_any(F.col("filename"), rules).alias("matched"))


@query("size_limit_tag", f"""SELECT path, size, CASE WHEN size > {OPTIONS.max_file_size}
  THEN 'file_size' END AS reason FROM files_v""")
def size_limit_tag(spark, sf_dir):
    too_large = analysis.size_excluded(F.col("size"), OPTIONS)
    return views.files(spark, sf_dir).select(
        "path", "size", F.when(too_large, F.lit("file_size")).alias("reason"))


@query("binary_image_tag", f"""SELECT path, type, reason FROM tagged_v""")
def binary_image_tag(spark, sf_dir):
    return analyse(views.files(spark, sf_dir), OPTIONS).rows.select("path", "type", "reason")


_PREVIEW = ScanOptions(
    excluded_folders=("Docs", "blog.ththan.example.net"),
    excluded_files=("F1.PY",),
    exclude_patterns=("*.tmp", "regex:/lib/f[0-9]*3", "*/fr/*"),
    image_extensions=(".PNG", ".html"),
)


@query("filter_preview", """SELECT path, reason,
    reason <> 'No exclusion matched. This path will be analysed.' AS excluded
  FROM (SELECT path, CASE
      WHEN list_contains(string_split(lower(path), '/'), 'docs')
        THEN 'Matches excluded folder ''docs''.'
      WHEN list_contains(string_split(lower(path), '/'), 'blog.ththan.example.net')
        THEN 'Matches excluded folder ''blog.ththan.example.net''.'
      WHEN name = 'f1.py' THEN 'Matches excluded filename ''f1.py''.'
      WHEN path LIKE '%.tmp' THEN 'Matches glob pattern ''*.tmp''.'
      WHEN regexp_matches(path, '/lib/f[0-9]*3')
        THEN 'Matches regex pattern ''/lib/f[0-9]*3''.'
      WHEN path LIKE '%/fr/%' THEN 'Matches glob pattern ''*/fr/*''.'
      WHEN name LIKE '_%.png' THEN 'Tagged as image asset via extension ''.png''.'
      WHEN name LIKE '_%.html' THEN 'Tagged as image asset via extension ''.html''.'
      ELSE 'No exclusion matched. This path will be analysed.' END AS reason
    FROM (SELECT path, lower(list_extract(string_split(rtrim(path, '/'), '/'), -1)) AS name
      FROM (SELECT path FROM files_v UNION ALL SELECT path FROM pages_v)))""")
def filter_preview(spark, sf_dir):
    both = views.files(spark, sf_dir).select("path").unionByName(
        views.pages(spark, sf_dir).select("path"))
    return filters.filter_preview(both, _PREVIEW)


@query("estimate_files", f"""SELECT count(*) AS files FROM files_v
  WHERE NOT list_has_any(string_split(parent, '/'), {sql_array(OPTIONS.excluded_folders)})
    AND filename NOT IN {sql_list(OPTIONS.excluded_files)} AND path NOT LIKE '%.tmp'""")
def estimate_files(spark, sf_dir):
    files = views.files(spark, sf_dir).select("path", "parent", "filename")
    return filters.estimate_filter(files, OPTIONS).agg(F.count(F.lit(1)).alias("files"))


@query("drop_empty_fields", r"""SELECT path, concat('{', array_to_string(list_filter([
    concat('"lang":"', lang, '"'),
    CASE WHEN ext <> '' THEN concat('"ext":"', ext, '"') END,
    CASE WHEN quality IS NOT NULL THEN concat('"quality":"', quality, '"') END],
    lambda x: x IS NOT NULL), ','), '}') AS record
  FROM (SELECT f.path, f.lang, lower(regexp_extract(filename, '(?s)^.+(\.[^.]+)$', 1)) AS ext,
      l.quality FROM files_v f LEFT JOIN labels l USING (doc_id))""")
def drop_empty_fields(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = views.files(spark, sf_dir).select("doc_id", "path", "lang", "filename").join(
        labels, "doc_id", "left")
    record = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("ext"), paths.suffix(F.col("filename")),
        F.lit("quality"), F.col("quality").cast("string"))
    return joined.select("path", filters.drop_empty_fields(record).alias("record"))


@query("paths_outside_git", "SELECT path FROM repo_files_v WHERE NOT contains(path, '.git')")
def paths_outside_git(spark, sf_dir):
    return views.repo_files(spark, sf_dir).select("path").filter(
        filters.outside_git(F.col("path")))


@query("open_issues", """SELECT conv_id * 1000 + turn AS number,
    concat('#', conv_id * 1000 + turn, ' - ', role) AS caption, text AS body
  FROM conversations WHERE role <> 'assistant'""")
def open_issues(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    document = F.to_json(F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("number"),
        F.col("role").alias("title"), F.col("text").alias("body"),
        F.when(F.col("role") == "assistant", F.struct("conv_id")).alias("pull_request")))
    issues = records.parse_issues(turns.select(document.alias("value")))
    return repos.open_issues(issues).select("number", "caption", "body")


@query("well_formed_records", """SELECT id, json_extract_string(r, '$.filename') AS filename
  FROM (SELECT id, r FROM (SELECT doc_id AS id,
      concat('{"parent":"', source, '","filename":"f', doc_id, '","info":{"type":"text","note":"',
        text, '"}}') AS r FROM documents) WHERE json_valid(r))""")
def well_formed_records(spark, sf_dir):
    return _record_lines(spark, sf_dir, "good").select("id", "filename")


@query("malformed_records", """SELECT id, r AS value FROM (SELECT doc_id AS id,
      concat('{"parent":"', source, '","filename":"f', doc_id, '","info":{"type":"text","note":"',
        text, '"}}') AS r FROM documents) WHERE NOT json_valid(r)""")
def malformed_records(spark, sf_dir):
    return _record_lines(spark, sf_dir, "bad").select("id", "value")


def _record_lines(spark, sf_dir, which):
    docs = views.table(spark, sf_dir, "documents")
    line = F.concat(
        F.lit('{"parent":"'), "source", F.lit('","filename":"f'), F.col("doc_id").cast("string"),
        F.lit('","info":{"type":"text","note":"'), "text", F.lit('"}}'))
    good, bad = records.split_records(docs.select(F.col("doc_id").alias("id"), line.alias("value")))
    return good if which == "good" else bad


# ---- paths ---------------------------------------------------------------------------------


@query("relative_parent", """SELECT path, CASE WHEN parent = 'src0' THEN ''
  WHEN parent LIKE 'src0/%' THEN substr(parent, 6) ELSE parent END AS relative FROM files_v""")
def relative_parent(spark, sf_dir):
    return views.files(spark, sf_dir).select(
        "path", paths.relative_parent(F.col("path"), F.lit("src0")).alias("relative"))


@query("compose_path", """SELECT doc_id, CASE lang WHEN 'de' THEN name WHEN 'fr' THEN name
  WHEN 'es' THEN source ELSE concat(source, '/', name) END AS path
  FROM (SELECT doc_id, lang, source, concat('f', doc_id) AS name FROM documents)""")
def compose_path(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    parent = F.when(F.col("lang") == "de", F.lit("")).when(
        F.col("lang") == "fr", F.lit(".")).otherwise(F.concat(F.lit(" "), "source"))
    name = F.when(F.col("lang") == "es", F.lit(" ")).otherwise(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", paths.compose_path(parent, name).alias("path"))


@query("split_path", """SELECT path, CAST(len(string_split(path, '/')) AS BIGINT) AS parts,
  parent, list_extract(string_split(path, '/'), -1) AS name FROM files_v""")
def split_path(spark, sf_dir):
    path = F.col("path")
    return views.files(spark, sf_dir).select(
        "path", F.size(paths.path_parts(path)).cast("long").alias("parts"),
        paths.parent_path(path).alias("parent"), paths.base_name(path).alias("name"))


@query("path_suffix", r"""SELECT path,
    lower(regexp_extract(list_extract(string_split(path, '/'), -1), '(?s)^.+(\.[^.]+)$', 1)) AS ext
  FROM (SELECT path FROM files_v UNION ALL SELECT path FROM pages_v)""")
def path_suffix(spark, sf_dir):
    both = views.files(spark, sf_dir).select("path").unionByName(
        views.pages(spark, sf_dir).select("path"))
    return both.select("path", paths.suffix(paths.base_name(F.col("path"))).alias("ext"))


@query("path_ancestors", """SELECT path, unnest(list_transform(range(1, len(parts)),
    lambda i: array_to_string(parts[1:i], '/'))) AS ancestor
  FROM (SELECT path, string_split(path, '/') AS parts FROM files_v)""")
def path_ancestors(spark, sf_dir):
    return views.files(spark, sf_dir).select(
        "path", F.explode(paths.ancestors(F.col("path"))).alias("ancestor"))


@query("repo_url_check", r"""SELECT id,
    regexp_matches(url, '^git@github\.com:[\w.-]+/[\w.-]+$')
      OR regexp_matches(url, '^https?://github\.com/[\w.-]+/[\w.-]+$') AS is_valid
  FROM urls_v""")
def repo_url_check(spark, sf_dir):
    return views.urls(spark, sf_dir).select(
        "id", paths.is_repo_url(F.col("url")).alias("is_valid"))


@query("repo_url_parse", r"""SELECT id, CASE WHEN ok THEN parts[1] END AS owner,
    CASE WHEN ok THEN regexp_replace(parts[2], '\.git$', '') END AS repo
  FROM (SELECT id, regexp_matches(url, '^(git@github\.com:|https?://github\.com/)[\w.-]+/[\w.-]+$')
      AS ok, string_split(regexp_replace(url, '^(git@github\.com:|https?://github\.com/)', ''), '/')
      AS parts FROM urls_v)""")
def repo_url_parse(spark, sf_dir):
    return repos.parsed_urls(views.urls(spark, sf_dir)).select("id", "owner", "repo")


# ---- classification ------------------------------------------------------------------------


@query("classify_by_suffix", "SELECT path, by_suffix AS is_binary FROM decisions_v")
def classify_by_suffix(spark, sf_dir):
    return views.files(spark, sf_dir).select(
        "path", classify.by_suffix(F.col("filename")).alias("is_binary"))


@query("content_sample", "SELECT path, total AS sample_bytes, h AS sample_hex FROM samples_v")
def content_sample(spark, sf_dir):
    sampled = classify.sample(F.col("content"))
    return views.files(spark, sf_dir).select(
        "path", F.octet_length(sampled).cast("long").alias("sample_bytes"),
        F.hex(sampled).alias("sample_hex"))


@query("sample_statistics", """SELECT path, printable_ratio, control_ratio, nul_ratio
  FROM samples_v""")
def sample_statistics(spark, sf_dir):
    stats = classify.sample_statistics(classify.sample(F.col("content")))
    return views.files(spark, sf_dir).select("path", stats.alias("s")).select(
        "path", F.col("s.printable").alias("printable_ratio"),
        F.col("s.control").alias("control_ratio"), F.col("s.nul").alias("nul_ratio"))


@query("sample_decision", "SELECT path, by_statistics AS is_binary FROM decisions_v")
def sample_decision(spark, sf_dir):
    stats = classify.sample_statistics(classify.sample(F.col("content")))
    return views.files(spark, sf_dir).select(
        "path", classify.by_statistics(stats).alias("is_binary"))


@query("mime_decision", """SELECT path, mime, CASE WHEN mime LIKE 'text/%'
    OR mime LIKE 'application/json%' THEN false WHEN mime <> 'application/octet-stream' THEN true
    END AS is_binary
  FROM (SELECT path, CASE WHEN filename LIKE '%.json' THEN 'application/json'
      WHEN filename LIKE '%.md' THEN 'text/markdown' WHEN filename LIKE '%.png' THEN 'image/png'
      ELSE mime END AS mime FROM decisions_v)""")
def mime_decision(spark, sf_dir):
    name = F.col("filename")
    mime = (
        F.when(F.endswith(name, F.lit(".json")), F.lit("application/json"))
        .when(F.endswith(name, F.lit(".md")), F.lit("text/markdown"))
        .when(F.endswith(name, F.lit(".png")), F.lit("image/png"))
        .otherwise(classify.mime_of(classify.sample(F.col("content"))))
    )
    return views.files(spark, sf_dir).select("path", mime.alias("mime")).withColumn(
        "is_binary", classify.by_mime(F.col("mime")))


@query("is_binary_cascade", "SELECT path, is_binary FROM decisions_v")
def is_binary_cascade(spark, sf_dir):
    return classify.with_is_binary(views.files(spark, sf_dir), charset=False).select(
        "path", "is_binary")


@query("text_default", """SELECT path, coalesce(by_suffix, by_statistics, false) AS is_binary
  FROM decisions_v""")
def text_default(spark, sf_dir):
    decision = classify.first_decision(
        classify.by_suffix(F.col("filename")),
        classify.by_statistics(classify.sample_statistics(classify.sample(F.col("content")))))
    return views.files(spark, sf_dir).select("path", decision.alias("is_binary"))


@query("classify_with_charset")
def classify_with_charset(spark, sf_dir):
    return classify.with_is_binary(views.files(spark, sf_dir)).select("path", "is_binary")


# ---- content -------------------------------------------------------------------------------


@query("detect_encoding", """SELECT path, CASE WHEN size = length(text) THEN 'ascii'
  ELSE 'utf_8' END AS encoding FROM files_v""")
def detect_encoding(spark, sf_dir):
    return content.with_decoded(views.files(spark, sf_dir), "content").select(
        "path", F.col("_encoding").alias("encoding"))


_WIDE = ("utf_16", "utf_16", "utf_16_le", "utf_16_be", "utf_32", "utf_32", "utf_32_le", "utf_32_be")


@query("detect_wide_encodings", f"""SELECT path, {sql_array(_WIDE)}[CAST(doc_id % 8 AS INTEGER) + 1] AS encoding,
  md5(text) AS digest FROM files_v""")
def detect_wide_encodings(spark, sf_dir):
    """Every text as UTF-16 or UTF-32, in both byte orders, with and without a mark, found and decoded."""
    def swapped(backwards):
        """UTF-32 in the other byte order, from the text backwards: all of its bytes from the last to the first."""
        return F.encode(F.reverse(F.decode(F.encode(backwards, "UTF-32"), "ISO-8859-1")), "ISO-8859-1")

    text, kind = F.col("text"), F.col("doc_id") % 8
    marks = {0: "FFFE", 1: "FEFF", 4: "FFFE0000", 5: "0000FEFF"}
    raw = F.lit(None).cast("binary")
    for number, name in enumerate(("UTF-16LE", "UTF-16BE", "UTF-16LE", "UTF-16BE", "LE", "BE", "LE", "BE")):
        body = F.encode(text, name) if "UTF" in name else F.encode(text, "UTF-32")
        body = swapped(F.reverse(text)) if name == "LE" else body
        raw = F.when(kind == number, F.concat(F.lit(bytes.fromhex(marks.get(number, ""))), body)).otherwise(raw)
    files = views.files(spark, sf_dir).select("path", raw.alias("raw"))
    return content.with_decoded(files, "raw", fallback="utf-8", wide=True).select(
        "path", F.col("_encoding").alias("encoding"), F.md5(F.encode("_decoded", "UTF-8")).alias("digest"))


@query("decode_text", "SELECT path, text AS content FROM files_v")
def decode_text(spark, sf_dir):
    return views.files(spark, sf_dir).select(
        "path", content.decode_utf8(F.col("content")).alias("content"))


@query("decode_by_codec", "SELECT path, text AS content FROM files_v")
def decode_by_codec(spark, sf_dir):
    """Texts stored as UTF-16 and read back through the codec path."""
    raw = F.encode("text", "UTF-16LE")
    files = views.files(spark, sf_dir).select("path", raw.alias("raw"))
    return content.with_decoded(files, "raw", hint="utf-16-le").select(
        "path", F.col("_decoded").alias("content"))


@query("base64_preview", "SELECT path, base64(encode(text)) AS content FROM files_v")
def base64_preview(spark, sf_dir):
    raw = content.preview(F.col("content"), ScanOptions().binary_limit)
    return views.files(spark, sf_dir).select("path", content.base64_text(raw).alias("content"))


@query("truncation", """SELECT path, least(size, 10000) AS preview_bytes, size > 10000 AS truncated
  FROM files_v""")
def truncation(spark, sf_dir):
    size = F.col("size")
    return views.files(spark, sf_dir).select(
        "path", content.preview_bytes(size, 10_000).alias("preview_bytes"),
        content.truncated(size, 10_000).alias("truncated"))


@query("content_hash", "SELECT path, md5(text) AS md5, sha256(text) AS sha256 FROM files_v")
def content_hash(spark, sf_dir):
    raw = F.col("content")
    return views.files(spark, sf_dir).select(
        "path", content.content_hash(raw, "md5").alias("md5"),
        content.content_hash(raw, "sha256").alias("sha256"))


@query("content_hash_xxh64")
def content_hash_xxh64(spark, sf_dir):
    return views.files(spark, sf_dir).select(
        "path", content.content_hash(F.col("content")).alias("hash"))


# ---- times ---------------------------------------------------------------------------------


@query("iso_timestamp", f"""SELECT path, {sql_iso('mtime_us')} AS utc,
  {sql_iso('mtime_us', 540)} AS tokyo FROM files_v""")
def iso_timestamp(spark, sf_dir):
    stamp = F.col("mtime_us")
    return views.files(spark, sf_dir).select(
        "path", times.iso_micros(stamp).alias("utc"),
        times.iso_micros(stamp, "Asia/Tokyo").alias("tokyo"))


@query("iso_event_time", """SELECT event_id, concat(CASE WHEN epoch_us(ts) % 1000000 = 0
    THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END, '+00:00')
    AS iso FROM events""")
def iso_event_time(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", times.iso_micros(times.micros_of(F.col("ts"))).alias("iso"))


@query("format_timestamp", """SELECT event_id, CASE event_type WHEN 'error' THEN ''
    WHEN 'purchase' THEN '' ELSE concat(strftime(make_timestamp(event_id * 60000000),
      '%Y-%m-%dT%H:%M:%S'), '+00:00') END AS formatted FROM events""")
def format_timestamp(spark, sf_dir):
    seconds = (
        F.when(F.col("event_type") == "error", F.lit("not a time"))
        .when(F.col("event_type") == "purchase", F.lit("1e300"))
        .otherwise((F.col("event_id") * 60).cast("string"))
    )
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", times.format_epoch(seconds).alias("formatted"))


@query("zone_selection", f"""SELECT path, CASE lang WHEN 'en' THEN {sql_iso('mtime_us')}
    WHEN 'de' THEN {sql_iso('mtime_us', 330)} WHEN 'fr' THEN {sql_iso('mtime_us', -420)}
    ELSE {sql_iso('mtime_us', 540)} END AS modified FROM files_v""")
def zone_selection(spark, sf_dir):
    zone = (
        F.when(F.col("lang") == "en", F.lit("UTC")).when(F.col("lang") == "de", F.lit("Asia/Kolkata"))
        .when(F.col("lang") == "fr", F.lit("America/Phoenix")).otherwise(F.lit("Asia/Tokyo"))
    )
    return views.files(spark, sf_dir).select(
        "path", times.iso_micros(F.col("mtime_us"), zone).alias("modified"))


@query("permissions", """SELECT path, printf('0o%o', mode - 420 + doc_id % 512) AS permissions
  FROM files_v""")
def permissions(spark, sf_dir):
    mode = F.col("mode") - 420 + F.col("doc_id") % 512
    return views.files(spark, sf_dir).select("path", times.permissions(mode).alias("permissions"))


@query("display_times", """SELECT event_id, strftime(ts, '%H:%M:%S') AS clock,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS full_time FROM events""")
def display_times(spark, sf_dir):
    ts = F.col("ts")
    return views.table(spark, sf_dir, "events").select(
        "event_id", times.clock_time(ts).alias("clock"), times.run_time(ts).alias("full_time"))


# ---- display -------------------------------------------------------------------------------


@query("human_size", """SELECT path, CASE WHEN s < 1024 THEN concat(s, ' B')
    WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0)
    ELSE printf('%.1f MB', s / 1048576.0) END AS label
  FROM (SELECT path, size * (doc_id % 97) AS s FROM files_v)""")
def human_size(spark, sf_dir):
    return views.files(spark, sf_dir).select(
        "path", display.human_size(F.col("size") * (F.col("doc_id") % 97)).alias("label"))


@query("human_duration", """SELECT identifier, CASE WHEN d < 60 THEN concat(s, 's')
    WHEN d < 3600 THEN concat(s // 60, 'm ', s % 60, 's')
    ELSE concat(s // 3600, 'h ', (s % 3600) // 60, 'm') END AS label
  FROM (SELECT identifier, duration_seconds * 12 AS d,
    CAST(floor(duration_seconds * 12) AS BIGINT) AS s FROM runs_v)""")
def human_duration(spark, sf_dir):
    return views.runs(spark, sf_dir).select(
        "identifier", display.human_duration(F.col("duration_seconds") * 12).alias("label"))


@query("thousands_percent", """SELECT identifier,
    CASE WHEN output_format = 'xml' THEN '—' ELSE format('{:,}', identifier * 37) END AS number,
    printf('%.1f%%', duration_seconds) AS share FROM runs_v""")
def thousands_percent(spark, sf_dir):
    number = F.when(F.col("output_format") == "xml", F.lit("n/a")).otherwise(
        (F.col("identifier") * 37).cast("string"))
    return views.runs(spark, sf_dir).select(
        "identifier", display.thousands(number).alias("number"),
        display.percent(F.col("duration_seconds")).alias("share"))


@query("node_label_tooltip", """SELECT path, concat(filename,
    CASE WHEN size IS NULL THEN '' WHEN size < 1024 THEN concat(chr(10), size, ' B')
      ELSE printf('%s%.1f KB', chr(10), size / 1024.0) END) AS label,
    CASE WHEN type = 'text' THEN concat('encoding: ', encoding, '\\nmodified: ', modified,
      '\\npermissions: ', permissions) ELSE '' END AS tooltip FROM entries_v""".replace("\\\\", "\\"))
def node_label_tooltip(spark, sf_dir):
    entries = analyse(views.files(spark, sf_dir), WHOLE).entries
    return entries.select(
        "path", display.node_label(F.col("filename"), F.col("size")).alias("label"),
        display.node_tooltip(F.col("encoding"), F.col("created"), F.col("modified"),
                             F.col("permissions")).alias("tooltip"))


@query("node_style", """SELECT path,
    CASE kind WHEN 'directory' THEN '#FFF3E0' WHEN 'excluded' THEN '#F5F5F5' ELSE '#E8F5E9' END
      AS fillcolor,
    CASE kind WHEN 'directory' THEN '#E65100' WHEN 'excluded' THEN '#9E9E9E' ELSE '#2E7D32' END
      AS color,
    CASE kind WHEN 'directory' THEN 'folder' WHEN 'excluded' THEN 'box' ELSE 'note' END AS shape,
    CASE kind WHEN 'excluded' THEN 'filled,dashed' ELSE 'filled' END AS style
  FROM (SELECT path, 'directory' AS kind FROM dirs_v UNION ALL SELECT path, type FROM entries_v)""")
def node_style(spark, sf_dir):
    rows = tree.nodes(analyse(views.files(spark, sf_dir), WHOLE).entries)
    kind = F.col("kind")
    return rows.select("path", *[
        display.node_style(kind, a).alias(a) for a in ("fillcolor", "color", "shape", "style")])


# ---- escaping ------------------------------------------------------------------------------


@query("xml_tag", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^\p{Nd}') THEN concat('item_', t)
    ELSE t END AS tag
  FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\t-\r\x1c-\x20\x{85}\p{Z}]+', '_', 'g'),
    '[^\p{L}\p{N}_.\-]', '', 'g') AS t FROM documents)""")
def xml_tag(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", escape.xml_tag(F.col("text")).alias("tag"))


@query("xml_escape", """SELECT page_id,
  replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def xml_escape(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(
        "page_id", escape.xml_text(F.col("html")).alias("escaped"))


@query("dot_escape", r"""SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g') AS id,
  replace(replace(html, '"', '\"'), chr(10), '\n') AS label FROM pages""")
def dot_escape(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(
        "page_id", escape.dot_id(F.col("url")).alias("id"),
        escape.dot_label(F.col("html")).alias("label"))


_SQL_SEXP = (r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'),"""
             r""" chr(13), '\r'), chr(9), '\t')""")


@query("sexp_escape", f"SELECT page_id, {_SQL_SEXP.format('html')} AS escaped FROM pages")
def sexp_escape(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(
        "page_id", escape.sexp_escape(F.col("html")).alias("escaped"))


@query("sexp_atom", rf"""SELECT doc_id, CASE WHEN text = '' THEN '""'
    WHEN regexp_matches(text, '[ ()"\\'';{{}}\[\]|\n\t]') OR lower(text) IN ('nil', 't')
      OR regexp_matches(text, '^[0-9+-.]')
    THEN concat('"', {_SQL_SEXP.format('text')}, '"') ELSE text END AS text_atom,
    source AS source_atom, CAST(n_chars AS VARCHAR) AS number_atom,
    CASE WHEN lang = 'en' THEN 't' ELSE 'nil' END AS flag_atom,
    CASE WHEN quality IS NULL THEN 'nil' ELSE CAST(quality AS VARCHAR) END AS quality_atom,
    '0o100644' AS mode_atom
  FROM documents LEFT JOIN labels USING (doc_id)""")
def sexp_atom(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = views.table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return rows.select(
        "doc_id",
        escape.sexp_atom(F.col("text"), "string").alias("text_atom"),
        escape.sexp_atom(F.col("source"), "string").alias("source_atom"),
        escape.sexp_atom(F.col("n_chars").cast("double"), "double").alias("number_atom"),
        escape.sexp_atom(F.col("lang") == "en", "boolean").alias("flag_atom"),
        escape.sexp_atom(F.col("quality"), "int").alias("quality_atom"),
        escape.sexp_atom(F.lit("0o100644"), "string", "permissions").alias("mode_atom"),
    )


@query("sexp_properties", """SELECT path, concat_ws(chr(10), concat('  :type "', type, '"'),
    '  :size ' || size, '  :encoding "' || encoding || '"', '  :permissions ' || permissions,
    '  :modified "' || modified || '"', '  :preview-bytes ' || preview_bytes,
    '  :reason ' || reason) AS properties
  FROM entries_v""")
def sexp_properties(spark, sf_dir):
    entries = analyse(views.files(spark, sf_dir), WHOLE).entries
    names = ("reason", "preview_bytes", "modified", "permissions", "encoding", "size", "type")
    columns = {n: (F.col(n), "bigint" if n in ("size", "preview_bytes") else "string")
               for n in names}
    return entries.select(
        "path", escape.sexp_properties(columns, F.lit("  ")).alias("properties"))


@query("content_clip", """SELECT page_id, substr(html, 1, 1024) AS short,
  substr(html, 1, 900000) AS long FROM pages""")
def content_clip(spark, sf_dir):
    html = F.col("html")
    return views.table(spark, sf_dir, "pages").select(
        "page_id", escape.clip(html, 1024).alias("short"),
        escape.clip(html, 900_000).alias("long"))


@query("rule_union", """SELECT doc_id, array_to_string(list_sort(list_distinct(
    list_concat(['*.tmp', lang, source], string_split(text, ' ')))), ' ') AS rules FROM documents""")
def rule_union(spark, sf_dir):
    own = F.array(F.lit("*.tmp"), F.col("lang"), F.col("source"))
    merged = lists.ordered_union(own, F.split("text", " "))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.sort_array(merged), " ").alias("rules"))


@query("rule_difference", """SELECT doc_id, array_to_string(list_filter(string_split(text, ' '),
    lambda x: NOT list_contains(['on', 'the', 'in', lang], x)), ' ') AS rules FROM documents""")
def rule_difference(spark, sf_dir):
    removed = F.array(F.lit("on"), F.lit("the"), F.lit("in"), F.col("lang"))
    kept = lists.without(F.split("text", " "), removed)
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(kept, " ").alias("rules"))
