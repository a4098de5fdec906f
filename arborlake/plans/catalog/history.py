"""Queries on summaries, trees, run history, logs, ordering and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import analysis, cache, logs, ordering, repos, runs, sets, summary, tree
from arborlake.plans import views
from arborlake.plans.analysis import analyse
from arborlake.plans.catalog.registry import OPTIONS, SMALL, WHOLE, query

# ---- summaries -----------------------------------------------------------------------------


@query("traversal_counters", """SELECT count(*) FILTER (NOT name_excluded) AS included,
  count(*) FILTER (name_excluded) AS excluded FROM reached_v""")
def traversal_counters(spark, sf_dir):
    names = views.files(spark, sf_dir).select("parent", "filename")
    return summary.counters(analysis.traversed(names, OPTIONS))


@query("run_summary", "SELECT * FROM summary_v")
def run_summary(spark, sf_dir):
    return analyse(views.files(spark, sf_dir), OPTIONS).summary()


@query("summary_with_defaults", """SELECT d.source AS run,
    coalesce(s.included_files, d.included_files) AS included_files,
    coalesce(s.processed_files, d.included_files) AS processed_files,
    coalesce(s.failed_files, d.failed_files) AS failed_files,
    coalesce(s.excluded_files, 0) AS excluded_files,
    coalesce(s.total_files, s.included_files, d.included_files) AS total_files,
    greatest(30, coalesce(s.total_files, s.included_files, d.included_files))
      AS estimated_total_files
  FROM (SELECT source, count(*) FILTER (lang <> 'de') AS included_files,
      count(*) FILTER (lang = 'de') AS failed_files FROM documents GROUP BY source) d
    LEFT JOIN (SELECT source, count(*) AS included_files,
      CASE WHEN min(quality) = 1 THEN count(*) END AS processed_files,
      CASE WHEN max(toxic) = 1 THEN CAST(sum(toxic) AS BIGINT) END AS failed_files,
      CASE WHEN max(toxic) = 1 THEN CAST(sum(1 - quality) AS BIGINT) END AS excluded_files,
      CASE WHEN min(quality) = 0 THEN count(*) * 2 END AS total_files
      FROM labels JOIN documents USING (doc_id) GROUP BY source) s USING (source)""")
def summary_with_defaults(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("run"), "lang")
    labels = views.table(spark, sf_dir, "labels")
    derived = docs.groupBy("run").agg(
        F.count_if(F.col("lang") != "de").alias("included_files"),
        F.count_if(F.col("lang") == "de").alias("failed_files"))
    rows, worst, best_toxic = F.count(F.lit(1)), F.min("quality"), F.max("toxic")
    supplied = labels.join(docs, "doc_id").groupBy("run").agg(
        rows.alias("included_files"),
        F.when(worst == 1, rows).alias("processed_files"),
        F.when(best_toxic == 1, F.sum("toxic")).alias("failed_files"),
        F.when(best_toxic == 1, F.sum(1 - F.col("quality"))).alias("excluded_files"),
        F.when(worst == 0, rows * 2).alias("total_files"))
    return summary.with_streaming_defaults(derived, supplied, F.lit(30).cast("long"))


@query("stop_summary", """SELECT count(*) AS total_files,
    count(*) FILTER (name_excluded) AS excluded_files,
    count(*) FILTER (NOT name_excluded) AS included_files,
    CAST(count(*) FILTER (name_excluded) AS DOUBLE) / count(*) * 100 AS excluded_percentage,
    CAST(0 AS BIGINT) AS failed_files, true AS stopped_early,
    count(*) FILTER (NOT name_excluded) AS processed_files, 'md5' AS hash_algorithm
  FROM reached_v SEMI JOIN labels USING (doc_id)""")
def stop_summary(spark, sf_dir):
    """A run stopped after the labelled documents: the summary over what was committed."""
    labels = views.table(spark, sf_dir, "labels").select("doc_id")
    committed = views.files(spark, sf_dir).join(labels, "doc_id", "left_semi")
    return analyse(committed, OPTIONS).summary(stopped_early=True)


@query("repo_rollup", """SELECT repo, CAST(sum(size) AS BIGINT) AS total_size,
  max(mtime_us) AS latest_mtime_us FROM repo_files_v WHERE NOT contains(path, '.git')
  GROUP BY repo""")
def repo_rollup(spark, sf_dir):
    return repos.rollup(views.repo_files(spark, sf_dir))


@query("throughput_eta", """SELECT identifier, processed_files / duration_seconds AS files_per_second,
    greatest(total_files - processed_files, 0) AS remaining_files,
    CASE WHEN processed_files > 0 THEN greatest(total_files - processed_files, 0)
      / (processed_files / duration_seconds) END AS estimated_remaining FROM runs_v""")
def throughput_eta(spark, sf_dir):
    rate = summary.throughput(
        F.col("processed_files"), F.col("total_files"), F.col("duration_seconds"))
    return views.runs(spark, sf_dir).select(
        "identifier", *[column.alias(name) for name, column in rate.items()])


@query("progress_status", """SELECT identifier, CASE
    WHEN total > 0 THEN concat('Stopped. Processed ', processed_files, ' of ', total, ' files (',
      CAST(floor(least(processed_files / total, 1.0) * 100) AS BIGINT), '% complete)')
    WHEN processed_files > 0 THEN concat('Stopped. Processed ', processed_files,
      ' files before stopping')
    ELSE 'Stopped. No files were processed' END AS status
  FROM (SELECT identifier, processed_files,
    CASE output_format WHEN 'json' THEN total_files ELSE 0 END AS total FROM runs_v)""")
def progress_status(spark, sf_dir):
    total = F.when(F.col("output_format") == "json", F.col("total_files")).otherwise(F.lit(0))
    return views.runs(spark, sf_dir).select(
        "identifier",
        summary.progress_message("Stopped.", F.col("processed_files"), total).alias("status"))


@query("growing_estimate", """SELECT repository, max(total_files) AS estimated_total_files
  FROM runs_v GROUP BY repository""")
def growing_estimate(spark, sf_dir):
    return summary.growing_estimate(views.runs(spark, sf_dir), "repository", "total_files")


@query("summary_overview", """SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8])::BIGINT AS position,
    unnest(['Repository', 'Total files', 'Processed files', 'Excluded files', 'Excluded',
      'Failed files', 'Hash algorithm', 'Status']) AS label,
    unnest(['documents', format('{:,}', total_files), format('{:,}', processed_files),
      format('{:,}', excluded_files), printf('%.1f%%', excluded_percentage),
      CAST(failed_files AS VARCHAR), hash_algorithm, 'Completed']) AS text FROM summary_v""")
def summary_overview(spark, sf_dir):
    run = analyse(views.files(spark, sf_dir), OPTIONS)
    return summary.overview(run.summary(), "documents")


@query("summary_failures", """WITH t AS (SELECT count(*) AS n, count(*) FILTER (failed) AS failed FROM faulty_v)
  SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8])::BIGINT AS position,
    unnest(['Repository', 'Total files', 'Processed files', 'Excluded files', 'Excluded',
      'Failed files', 'Hash algorithm', 'Status']) AS label,
    unnest(['documents', format('{:,}', n), format('{:,}', n), '0', '0.0%', CAST(failed AS VARCHAR), 'md5',
      'Completed']) AS text FROM t
  UNION ALL SELECT 9, 'Failed file', concat(path, chr(10), '  Failed to get file stats: not allowed')
  FROM faulty_v WHERE failed""")
def summary_failures(spark, sf_dir):
    """The overview of a run with failed files, each of them a row below it."""
    run = analyse(views.faulty_files(spark, sf_dir), SMALL)
    return summary.overview(run.summary(), "documents", run.failures())


# ---- tree ----------------------------------------------------------------------------------


@query("tree_nodes", """SELECT path, parent, name, depth, 'directory' AS kind FROM dirs_v
  UNION ALL SELECT path, parent, filename, CAST(len(string_split(path, '/')) AS BIGINT), type
  FROM entries_v""")
def tree_nodes(spark, sf_dir):
    return tree.nodes(analyse(views.files(spark, sf_dir), WHOLE).entries)


@query("tree_edges", """SELECT parent AS src, path AS dst FROM dirs_v WHERE parent <> ''
  UNION ALL SELECT parent, path FROM entries_v WHERE parent <> ''""")
def tree_edges(spark, sf_dir):
    return tree.edges(analyse(views.files(spark, sf_dir), WHOLE).entries)


@query("sorted_children", """SELECT parent, name, 'directory' AS kind FROM dirs_v
  UNION ALL SELECT parent, filename, type FROM entries_v""")
def sorted_children(spark, sf_dir):
    return tree.children(analyse(views.files(spark, sf_dir), WHOLE).entries)


# ---- run history ---------------------------------------------------------------------------


@query("run_search", """SELECT identifier FROM runs_v WHERE contains(lower(concat_ws(' ',
  display_name, repository, coalesce(nullif(preset, ''), 'default'), output_format)),
  'repo7 2-high')""")
def run_search(spark, sf_dir):
    return runs.search(views.runs(spark, sf_dir), " Repo7 2-HIGH ").select("identifier")


@query("run_repository_filter", """SELECT identifier FROM runs_v
  WHERE contains(lower(repository), 'repo1')""")
def run_repository_filter(spark, sf_dir):
    return runs.of_repository(views.runs(spark, sf_dir), "REPO1").select("identifier")


@query("run_preset_filter", """SELECT identifier FROM runs_v
  WHERE contains(lower(coalesce(preset, '')), 'urgent')""")
def run_preset_filter(spark, sf_dir):
    return runs.of_preset(views.runs(spark, sf_dir), "urgent").select("identifier")


@query("run_table", """SELECT identifier, display_name AS name,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, repository,
    coalesce(nullif(preset, ''), 'default') AS preset, output_format,
    printf('%.2fs', duration_seconds) AS duration, CAST(processed_files AS VARCHAR) AS files
  FROM runs_v""")
def run_table(spark, sf_dir):
    return runs.display_rows(views.runs(spark, sf_dir))


@query("run_compare_metrics", """SELECT left_id, right_id, metric,
    coalesce(max(value) FILTER (identifier = left_id), '') AS left,
    coalesce(max(value) FILTER (identifier = right_id), '') AS right
  FROM (SELECT a.identifier AS left_id, b.identifier AS right_id FROM runs_v a
      JOIN runs_v b ON b.identifier = a.identifier + 1)
    JOIN (SELECT identifier, unnest(['Display Name', 'Repository', 'Preset', 'Output Format',
        'Timestamp', 'Duration (s)', 'Files', 'Summary: total_files']) AS metric,
      unnest([display_name, repository, coalesce(nullif(preset, ''), 'default'), output_format,
        strftime(ts, '%Y-%m-%d %H:%M:%S'), printf('%.2f', duration_seconds),
        CAST(processed_files AS VARCHAR), CAST(total_files AS VARCHAR)]) AS value FROM runs_v)
    ON identifier IN (left_id, right_id)
  GROUP BY ALL""")
def run_compare_metrics(spark, sf_dir):
    """Every run against the next one."""
    rows = views.runs(spark, sf_dir)
    left = rows.select(F.col("identifier").alias("left_id"))
    right = rows.select(F.col("identifier").alias("right_id"))
    pairs = left.join(right, F.col("right_id") == F.col("left_id") + 1)
    return runs.compare_metrics(rows, pairs, ("total_files",))


@query("run_result_diff", """SELECT path, status, "column", old_value, new_value FROM (
    SELECT coalesce(o.path, n.path) AS path,
      CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
        WHEN o.size = n.size AND o.mtime_us = n.mtime_us AND o.digest = n.digest THEN 'same'
        ELSE 'changed' END AS status,
      unnest(CASE WHEN o.path IS NULL OR n.path IS NULL
          OR (o.size = n.size AND o.mtime_us = n.mtime_us AND o.digest = n.digest)
        THEN [{'column': NULL, 'old_value': NULL, 'new_value': NULL}]
        ELSE list_filter([
          {'column': 'size', 'old_value': o.size::VARCHAR, 'new_value': n.size::VARCHAR},
          {'column': 'mtime_us', 'old_value': o.mtime_us::VARCHAR, 'new_value': n.mtime_us::VARCHAR},
          {'column': 'digest', 'old_value': o.digest, 'new_value': n.digest}],
          lambda c: c.old_value IS DISTINCT FROM c.new_value) END, recursive := true)
    FROM (SELECT path, size, mtime_us, file_hash AS digest FROM cache_v) o
      FULL JOIN (SELECT path, size, mtime_us, md5(text) AS digest FROM files_v) n
      ON o.path = n.path)""")
def run_result_diff(spark, sf_dir):
    """The stored state of the earlier run against the files of now."""
    old = views.cache(spark, sf_dir).withColumnRenamed("file_hash", "digest")
    new = views.files(spark, sf_dir).withColumn("digest", F.md5("content"))
    return runs.diff_results(old, new, ("size", "mtime_us", "digest"))


@query("run_filter_values", "SELECT DISTINCT repository FROM runs_v ORDER BY repository")
def run_filter_values(spark, sf_dir):
    return runs.filter_values(views.runs(spark, sf_dir), "repository")


@query("runs_sorted", """SELECT identifier, display_name, repository FROM runs_v
  ORDER BY lower(repository), identifier""")
def runs_sorted(spark, sf_dir):
    return runs.sorted_by(views.runs(spark, sf_dir), "repository").select(
        "identifier", "display_name", "repository")


@query("run_report", """SELECT identifier, concat_ws(chr(10), concat('Display Name: ', display_name),
    concat('Repository: ', repository), concat('Preset: ', coalesce(nullif(preset, ''), 'default')),
    concat('Output Format: ', output_format),
    concat('Timestamp: ', strftime(ts, '%Y-%m-%d %H:%M:%S')),
    printf('Duration (s): %.2f', duration_seconds), concat('Files: ', processed_files), '',
    'Summary metrics:', concat('- total_files: ', total_files)) AS report FROM runs_v""")
def run_report(spark, sf_dir):
    return runs.report_text(views.runs(spark, sf_dir), ("total_files",))


@query("run_history_upsert", """SELECT user_id, position, last_seq, event_type, value FROM (
    SELECT user_id, min(event_id) AS position, max(event_id) AS last_seq FROM events
    GROUP BY user_id) JOIN (SELECT event_id AS last_seq, event_type, value FROM events)
    USING (last_seq)""")
def run_history_upsert(spark, sf_dir):
    """Every event replaces the record of its user, which keeps its first position."""
    events = views.table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("last_seq"), "event_type", "value")
    return cache.upsert_keeping_position(events, "user_id", "event_id")


# ---- logs ----------------------------------------------------------------------------------


@query("log_threshold", "SELECT seq, level_name, message FROM logs_v WHERE level >= 30")
def log_threshold(spark, sf_dir):
    return logs.at_least(views.logs(spark, sf_dir), 30).select("seq", "level_name", "message")


@query("log_search", "SELECT seq, formatted FROM logs_v WHERE contains(lower(formatted), 'error')")
def log_search(spark, sf_dir):
    return logs.search(views.logs(spark, sf_dir), "Error").select("seq", "formatted")


@query("log_table", """SELECT seq, strftime(ts, '%H:%M:%S') AS time, level_name, message,
  CASE level WHEN 10 THEN '#808080' WHEN 20 THEN '#4CAF50' WHEN 30 THEN '#FFA500'
    ELSE '#FF0000' END AS color FROM logs_v""")
def log_table(spark, sf_dir):
    return logs.shown(views.logs(spark, sf_dir))


@query("log_counter", """SELECT least(count(*), 1000) AS shown, CAST(1000 AS BIGINT) AS capacity,
  least(count(*), 1000) >= 900 AS nearly_full FROM logs_v""")
def log_counter(spark, sf_dir):
    return summary.buffer_counter(views.logs(spark, sf_dir), 1000)


@query("keep_last_n", """SELECT seq, logger_name FROM logs_v
  QUALIFY row_number() OVER (PARTITION BY logger_name ORDER BY ts DESC, seq DESC) <= 1000""")
def keep_last_n(spark, sf_dir):
    rows = views.logs(spark, sf_dir).select("seq", "ts", "logger_name")
    return logs.buffered(rows).select("seq", "logger_name")


@query("match_navigation", """SELECT row_number() OVER w AS position, seq,
    coalesce(lag(seq) OVER w, last_value(seq) OVER (ORDER BY ts, seq ROWS BETWEEN UNBOUNDED
      PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_seq,
    coalesce(lead(seq) OVER w, first_value(seq) OVER w) AS next_seq
  FROM logs_v WHERE contains(lower(formatted), 'purchase') WINDOW w AS (ORDER BY ts, seq)""")
def match_navigation(spark, sf_dir):
    return logs.match_navigation(views.logs(spark, sf_dir), "Purchase")


# ---- ordering ------------------------------------------------------------------------------


@query("running_count", """SELECT seq, logger_name,
  row_number() OVER (PARTITION BY logger_name ORDER BY ts, seq) AS processed FROM logs_v""")
def running_count(spark, sf_dir):
    rows = views.logs(spark, sf_dir).select("seq", "ts", "logger_name")
    return ordering.numbered(rows, ["ts", "seq"], ["logger_name"], "processed").select(
        "seq", "logger_name", "processed")


@query("chunk_index", """SELECT path, (row_number() OVER (ORDER BY path) - 1) // 256 AS chunk
  FROM files_v""")
def chunk_index(spark, sf_dir):
    return ordering.chunk_index(views.files(spark, sf_dir).select("path"), ["path"])


@query("run_numbering", """SELECT identifier, concat('Analysis ',
  row_number() OVER (PARTITION BY repository ORDER BY ts, identifier)) AS name FROM runs_v""")
def run_numbering(spark, sf_dir):
    rows = views.runs(spark, sf_dir).select("identifier", "ts", "repository")
    ranked = ordering.numbered(rows, ["ts", "identifier"], ["repository"], "n")
    return ranked.select(
        "identifier", F.concat(F.lit("Analysis "), F.col("n").cast("string")).alias("name"))


# ---- sets ----------------------------------------------------------------------------------


@query("key_difference", """SELECT path FROM cache_v EXCEPT SELECT path FROM files_v""")
def key_difference(spark, sf_dir):
    return sets.key_difference(
        views.cache(spark, sf_dir).select("path"), views.files(spark, sf_dir).select("path"))


@query("key_union", """SELECT path FROM cache_v UNION SELECT path FROM files_v""")
def key_union(spark, sf_dir):
    return sets.key_union(
        views.cache(spark, sf_dir).select("path"), views.files(spark, sf_dir).select("path"))


@query("metric_names", """SELECT unnest(['Display Name', 'Repository', 'Preset', 'Output Format',
  'Timestamp', 'Duration (s)', 'Files', 'total_files']) AS metric""")
def metric_names(spark, sf_dir):
    return runs.metric_names(views.runs(spark, sf_dir), ("total_files",))
