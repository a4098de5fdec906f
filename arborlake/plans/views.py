"""The supplied tables seen as files, cache, runs, logs and repositories.

Each view exists twice, as DataFrame and as SQL for the cross-check; both derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.operators.logs import formatted, level_name

# fixed values of the derivation
EXTENSIONS = (".txt", ".py", ".md", ".json", ".png", ".dat", ".tmp", "")
FOLDERS = ("src", "build", "docs", "node_modules", "lib")
FIRST_MTIME_US = 1_704_067_200_000_000  # 2024-01-01 UTC
MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
MODE = 33188


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files. Columns are pruned: size and content need the text, names do not."""
    return as_files(table(spark, sf_dir, "documents"))


def as_files(docs: DataFrame, *keep: Column) -> DataFrame:
    """File columns of a documents table or stream; ``keep`` adds own columns."""
    ext = _pick(EXTENSIONS, F.col("doc_id") % len(EXTENSIONS))
    folder = _pick(FOLDERS, F.col("doc_id") % len(FOLDERS))
    raw = F.encode("text", "UTF-8")
    return docs.select(
        "doc_id",
        "source",
        "lang",
        F.concat_ws("/", "source", "lang", folder).alias("parent"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(FIRST_MTIME_US) + F.col("doc_id") * MINUTE_US).alias("mtime_us"),
        F.lit(None).cast("long").alias("created_us"),
        F.lit(MODE).cast("long").alias("mode"),
        F.lit(None).cast("string").alias("stat_error"),
        "text",
        raw.alias("content"),
        *keep,
    ).withColumn("path", F.concat_ws("/", "parent", "filename"))


def faulty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with times of creation, and without stat values for the toxic documents."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    found = files(spark, sf_dir).withColumn("created_us", F.col("mtime_us") - HOUR_US).join(
        toxic.withColumn("_failed", F.lit(True)), "doc_id", "left")
    lost = F.col("_failed").isNotNull()
    return found.withColumns({
        **{n: F.when(~lost, F.col(n)) for n in ("size", "mtime_us", "created_us", "mode", "content")},
        "stat_error": F.when(lost, F.lit("PermissionError: not allowed")),
    }).drop("_failed")


FILES_SQL = f"""files_v AS (
  SELECT *, concat_ws('/', parent, filename) AS path FROM (
    SELECT doc_id, source, lang, text,
      concat_ws('/', source, lang,
        ['{"','".join(FOLDERS)}'][CAST(doc_id % {len(FOLDERS)} AS INTEGER) + 1]) AS parent,
      concat('f', doc_id,
        ['{"','".join(EXTENSIONS)}'][CAST(doc_id % {len(EXTENSIONS)} AS INTEGER) + 1]) AS filename,
      CAST(octet_length(encode(text)) AS BIGINT) AS size,
      CAST({FIRST_MTIME_US} + doc_id * {MINUTE_US} AS BIGINT) AS mtime_us,
      CAST({MODE} AS BIGINT) AS mode
    FROM documents))"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of an earlier run that saw the labelled documents and all conversation turns.

    Documents of quality 0 have changed since (older mtime in the state); the turns are no
    longer there; toxic documents have a damaged payload.
    """
    labels = table(spark, sf_dir, "labels")
    seen = files(spark, sf_dir).join(labels, "doc_id")
    info = F.to_json(F.struct(F.lit("text").alias("type"), F.col("size"), F.col("filename")))
    known = seen.select(
        "path",
        F.md5("content").alias("file_hash"),
        F.when(F.col("toxic") == 1, F.substr(info, F.lit(2))).otherwise(info).alias("file_info"),
        "size",
        F.when(F.col("quality") == 0, F.col("mtime_us") - HOUR_US)
        .otherwise(F.col("mtime_us")).alias("mtime_us"),
    )
    turns = table(spark, sf_dir, "conversations")
    gone = turns.select(
        F.concat(F.lit("gone/"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string"), F.lit(".txt")).alias("path"),
        F.md5(F.encode("text", "UTF-8")).alias("file_hash"),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("role"))).alias("file_info"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(FIRST_MTIME_US) + F.col("conv_id") * MINUTE_US).alias("mtime_us"),
    )
    return known.unionByName(gone)


CACHE_SQL = f"""cache_v AS (
  SELECT path, md5(text) AS file_hash,
    CASE WHEN toxic = 1 THEN substr(info, 2) ELSE info END AS file_info, size,
    CASE WHEN quality = 0 THEN mtime_us - {HOUR_US} ELSE mtime_us END AS mtime_us
  FROM (SELECT f.*, l.quality, l.toxic,
          concat('{{"type":"text","size":', size, ',"filename":"', filename, '"}}') AS info
        FROM files_v f JOIN labels l USING (doc_id))
  UNION ALL
  SELECT concat('gone/', conv_id, '/', turn, '.txt'), md5(text),
    concat('{{"type":"text","role":"', role, '"}}'),
    CAST(octet_length(encode(text)) AS BIGINT),
    CAST({FIRST_MTIME_US} + conv_id * {MINUTE_US} AS BIGINT)
  FROM conversations)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run-history rows."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("identifier"),
        F.concat(F.lit("Analysis "), key.cast("string")).alias("display_name"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("repo"), (F.col("o_custkey") % 20).cast("string")).alias("repository"),
        F.col("o_orderpriority").alias("preset"),
        F.when(F.col("o_orderstatus") == "O", F.lit("json"))
        .when(F.col("o_orderstatus") == "F", F.lit("csv"))
        .otherwise(F.lit("xml")).alias("output_format"),
        (F.col("o_totalprice") / 1000).alias("duration_seconds"),
        (key % 1000).alias("processed_files"),
        (key % 1000 + F.col("o_custkey") % 20).alias("total_files"),
    )


RUNS_SQL = """runs_v AS (
  SELECT o_orderkey AS identifier, concat('Analysis ', o_orderkey) AS display_name,
    o_orderdate AS ts, concat('repo', o_custkey % 20) AS repository, o_orderpriority AS preset,
    CASE o_orderstatus WHEN 'O' THEN 'json' WHEN 'F' THEN 'csv' ELSE 'xml' END AS output_format,
    o_totalprice / 1000 AS duration_seconds, o_orderkey % 1000 AS processed_files,
    o_orderkey % 1000 + o_custkey % 20 AS total_files
  FROM orders)"""


def log_columns(events: DataFrame) -> DataFrame:
    """Log rows of an events table; also for the event stream."""
    level = (
        F.when(F.col("event_type") == "error", F.lit(40))
        .when(F.col("event_type") == "purchase", F.lit(30))
        .when(F.col("event_type") == "view", F.lit(10))
        .otherwise(F.lit(20))
    )
    message = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        level.alias("level"),
        level_name(level).alias("level_name"),
        F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("logger_name"),
        message.alias("message"),
        formatted(F.col("ts"), level, message).alias("formatted"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(table(spark, sf_dir, "events"))


LOGS_SQL = """logs_v AS (
  SELECT seq, ts, level, level_name, logger_name, message,
    concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' [', level_name, '] ', message) AS formatted
  FROM (
    SELECT event_id AS seq, ts,
      CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'view' THEN 10
        ELSE 20 END AS level,
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
        WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level_name,
      concat('user', user_id % 10) AS logger_name,
      concat(event_type, ' ', user_id) AS message
    FROM events))"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as paths: host and URL path, query and fragment dropped."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", bare.alias("path"))


PAGES_SQL = """pages_v AS (
  SELECT page_id, url, html,
    regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path
  FROM pages)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository URLs in their forms, one per document, and the page URLs, which are none."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "lang", "source")
    form = F.col("doc_id") % 4
    url = (
        F.when(form == 0, F.concat(F.lit("https://github.com/"), name))
        .when(form == 1, F.concat(F.lit("https://github.com/"), name, F.lit(".git")))
        .when(form == 2, F.concat(F.lit("git@github.com:"), name, F.lit(".git")))
        .otherwise(F.concat(F.lit("http://github.com/"), name, F.lit("/")))
    )
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
                       url.alias("url")).unionByName(
        table(spark, sf_dir, "pages").select(
            F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url"))


URLS_SQL = """urls_v AS (
  SELECT concat('d', doc_id) AS id,
    CASE doc_id % 4 WHEN 0 THEN concat('https://github.com/', lang, '/', source)
      WHEN 1 THEN concat('https://github.com/', lang, '/', source, '.git')
      WHEN 2 THEN concat('git@github.com:', lang, '/', source, '.git')
      ELSE concat('http://github.com/', lang, '/', source, '/') END AS url
  FROM documents
  UNION ALL SELECT concat('p', page_id), url FROM pages)"""


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one repository per source; the German ones lie in its ``.git`` folder."""
    rows = files(spark, sf_dir)
    top = F.when(F.col("lang") == "de", F.lit(".git")).otherwise(F.col("lang"))
    return rows.select(
        F.col("source").alias("repo"), F.concat_ws("/", "source", top, "filename").alias("path"),
        "size", "mtime_us",
    )


REPO_FILES_SQL = """repo_files_v AS (
  SELECT source AS repo,
    concat_ws('/', source, CASE WHEN lang = 'de' THEN '.git' ELSE lang END, filename) AS path,
    size, mtime_us
  FROM files_v)"""
