"""Queries on the incremental state: probes, upserts and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import analysis, cache, filters, ordering
from arborlake.plans import views
from arborlake.plans.analysis import analyse
from arborlake.plans.catalog.registry import WHOLE, query
from arborlake.session import new_work_path
from arborlake.sources.cache_table import CacheTable


def _metadata(spark, sf_dir):
    return views.files(spark, sf_dir).select("path", "size", "mtime_us")


@query("cache_scan", "SELECT path, file_hash, file_info, size, mtime_us FROM cache_v")
def cache_scan(spark, sf_dir):
    return views.cache(spark, sf_dir)


@query("cache_hits", """SELECT path, file_hash, file_info FROM cache_v
  JOIN files_v USING (path, size, mtime_us) WHERE json_valid(file_info)""")
def cache_hits(spark, sf_dir):
    return cache.hits(_metadata(spark, sf_dir), views.cache(spark, sf_dir)).select(
        "path", "file_hash", "file_info")


@query("cache_misses", """SELECT path, size, mtime_us FROM files_v ANTI JOIN
  (SELECT * FROM cache_v WHERE json_valid(file_info)) USING (path, size, mtime_us)""")
def cache_misses(spark, sf_dir):
    return cache.misses(_metadata(spark, sf_dir), views.cache(spark, sf_dir))


@query("cache_hits_by_hash", """SELECT c.path, c.file_info FROM cache_v c JOIN files_v f
  ON c.path = f.path AND c.size = f.size AND c.mtime_us = f.mtime_us AND c.file_hash = md5(f.text)
  WHERE json_valid(c.file_info)""")
def cache_hits_by_hash(spark, sf_dir):
    now = views.files(spark, sf_dir).select(
        "path", "size", "mtime_us", F.md5("content").alias("file_hash"))
    return cache.hits(now, views.cache(spark, sf_dir), "hash").select("path", "file_info")


@query("cache_orphans", """SELECT path, size FROM cache_v
  WHERE path NOT IN (SELECT path FROM files_v)""")
def cache_orphans(spark, sf_dir):
    return cache.orphans(views.cache(spark, sf_dir), _metadata(spark, sf_dir)).select("path", "size")


@query("remove_orphans", """SELECT path, file_hash, size FROM cache_v
  WHERE path IN (SELECT path FROM files_v)""")
def remove_orphans(spark, sf_dir):
    kept = cache.without_orphans(views.cache(spark, sf_dir), _metadata(spark, sf_dir))
    return kept.select("path", "file_hash", "size")


@query("exclusion_list_anti_join", """SELECT path FROM files_v WHERE filename NOT IN
  (SELECT filename FROM files_v JOIN labels USING (doc_id) WHERE toxic = 1)""")
def exclusion_list_anti_join(spark, sf_dir):
    """Files whose name is not on the list made from the toxic documents."""
    files = views.files(spark, sf_dir).select("doc_id", "path", "filename")
    toxic = views.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    listed = files.join(toxic, "doc_id", "left_semi").select("filename")
    return filters.without_listed_names(files.select("path", "filename"), listed).select("path")


@query("last_wins_upsert", """SELECT path, file_hash, file_info, size, mtime_us FROM cache_v
    WHERE path NOT IN (SELECT path FROM entries_v WHERE type = 'text')
  UNION ALL SELECT path, hash, concat('{"type":"text","size":', size, '}'), size, mtime_us
  FROM entries_v JOIN (SELECT path, mtime_us FROM files_v) USING (path) WHERE type = 'text'""")
def last_wins_upsert(spark, sf_dir):
    """The results of a new run replace the stored rows of the same path."""
    included = analysis.traversed(views.files(spark, sf_dir), WHOLE).filter(~F.col("name_excluded"))
    fresh = cache.persistable(analysis.entries(included, WHOLE, keep=["mtime_us"])).select(
        "path", F.col("hash").alias("file_hash"),
        F.to_json(F.struct("type", "size")).alias("file_info"), "size", "mtime_us")
    return cache.upsert(views.cache(spark, sf_dir), fresh)


@query("last_wins_by_version", """SELECT user_id, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def last_wins_by_version(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return cache.last_wins(events, "user_id", F.col("ts").desc(), F.col("event_id").desc()).select(
        "user_id", "event_id", "event_type")


@query("persistable_results", """SELECT path, hash FROM entries_v WHERE type = 'text'""")
def persistable_results(spark, sf_dir):
    entries = analyse(views.files(spark, sf_dir), WHOLE).entries
    return cache.persistable(entries).select("path", "hash")


@query("cache_accounting", """SELECT count(*) AS row_count,
  CAST(sum(octet_length(encode(file_info))) AS BIGINT) AS bytes FROM cache_v""")
def cache_accounting(spark, sf_dir):
    return cache.accounting(views.cache(spark, sf_dir))


@query("evict_to_limit", """SELECT path, mtime_us FROM cache_v
  QUALIFY row_number() OVER (ORDER BY mtime_us DESC, path DESC) <=
    (SELECT CASE WHEN b <= 20000 THEN n ELSE CAST(floor(n * (20000 * 0.75) / b) AS BIGINT) END
     FROM (SELECT count(*) AS n, sum(octet_length(encode(file_info))) AS b FROM cache_v))""")
def evict_to_limit(spark, sf_dir):
    return cache.evict(views.cache(spark, sf_dir), limit_bytes=20_000).select("path", "mtime_us")


@query("oldest_k", """SELECT path, mtime_us FROM cache_v ORDER BY mtime_us, path LIMIT 50""")
def oldest_k(spark, sf_dir):
    return ordering.oldest_rows(views.cache(spark, sf_dir).select("path", "mtime_us"), 50)


@query("corrupt_payloads", "SELECT path, file_info FROM cache_v WHERE NOT json_valid(file_info)")
def corrupt_payloads(spark, sf_dir):
    """Stored rows that count as misses."""
    return cache.unreadable(views.cache(spark, sf_dir)).select("path", "file_info")


_AGAIN = '{"again":1}'
_STATE = f"""(SELECT '/a' AS root, path, file_hash, size, mtime_us,
    CASE WHEN size % 2 = 0 THEN '{_AGAIN}' ELSE file_info END AS file_info FROM cache_v
  UNION ALL SELECT '/b', path, file_hash, size, mtime_us + {views.HOUR_US}, file_info FROM cache_v)"""


def _state(spark, sf_dir):
    """Two trees with equal relative paths in one table; part of the first is written twice."""
    state = CacheTable(spark, new_work_path(spark, "state"), buckets=8)
    rows = views.cache(spark, sf_dir)
    state.below("/a").upsert(rows, "a")
    state.below("/b").upsert(rows.withColumn("mtime_us", F.col("mtime_us") + views.HOUR_US), "b")
    state.below("/a").upsert(
        rows.filter("size % 2 = 0").withColumn("file_info", F.lit(_AGAIN)), "a again")
    return state


def _of_both_roots(probe):
    first, second = (probe(root).withColumn("root", F.lit(root)) for root in ("/a", "/b"))
    return first.unionByName(second)


@query("state_hits", f"""SELECT root, path, file_hash, file_info FROM {_STATE}
  JOIN files_v USING (path, size, mtime_us) WHERE json_valid(file_info)""")
def state_hits(spark, sf_dir):
    state, files = _state(spark, sf_dir), _metadata(spark, sf_dir)
    return _of_both_roots(lambda root: state.below(root).hits(files)).select(
        "root", "path", "file_hash", "file_info")


@query("state_misses", f"""SELECT root, path, size, mtime_us
  FROM (SELECT * FROM files_v, (VALUES ('/a'), ('/b')) r(root)) ANTI JOIN (SELECT * FROM {_STATE} WHERE json_valid(file_info)) USING (root, path, size, mtime_us)""")
def state_misses(spark, sf_dir):
    state, files = _state(spark, sf_dir), _metadata(spark, sf_dir)
    return _of_both_roots(lambda root: state.below(root).misses(files))


@query("state_hits_by_hash", f"""SELECT root, s.path, s.file_info FROM {_STATE} s JOIN files_v f
  ON s.path = f.path AND s.size = f.size AND s.mtime_us = f.mtime_us AND s.file_hash = md5(f.text)
  WHERE json_valid(s.file_info)""")
def state_hits_by_hash(spark, sf_dir):
    now = views.files(spark, sf_dir).select(
        "path", "size", "mtime_us", F.md5("content").alias("file_hash"))
    state = _state(spark, sf_dir)
    return _of_both_roots(lambda root: state.below(root).hits(now, "hash")).select("root", "path", "file_info")


@query("state_rows", f"""SELECT concat(root, '/', path) AS path, file_hash, file_info, size, mtime_us
  FROM {_STATE}""")
def state_rows(spark, sf_dir):
    """The newest row of every path over three writes."""
    return _state(spark, sf_dir).read()


@query("state_upkeep", f"""WITH s AS (
    SELECT concat(root, '/', path) AS path, mtime_us, octet_length(encode(file_info)) AS bytes FROM {_STATE}
    WHERE root = '/b' OR path IN (SELECT path FROM files_v)),
  t AS (SELECT count(*) AS n, sum(bytes) AS b FROM s)
  SELECT path, mtime_us FROM s QUALIFY row_number() OVER (ORDER BY mtime_us DESC, path DESC) <=
    (SELECT CASE WHEN b <= 20000 THEN n ELSE CAST(floor(n * (20000 * 0.75) / b) AS BIGINT) END FROM t)""")
def state_upkeep(spark, sf_dir):
    """What stays after the orphans of one tree are dropped and the state is cut to its limit."""
    state = _state(spark, sf_dir)
    state.upkeep(_metadata(spark, sf_dir), "/a", "upkeep", limit_bytes=20_000, writes=1)
    return state.read().select("path", "mtime_us")
