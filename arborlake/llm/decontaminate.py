"""Benchmark decontamination: containment MinHash, sizes first, then exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity to it, so document sketches
would miss it. Containment MinHash sketches the item alone: its shingles with the smallest
hashes, and asks how many of them the document holds. The expected share is the containment
itself, whatever the document's length. Documents are partitioned by size (powers of two of
their shingle counts); an item meets only size partitions that can hold the wanted share of it.
Candidates with enough sketch hits are verified on their full shingle sets.

The sketch is tested in SQL only. It is joined with the documents' shingles as a broadcast table
when it has at most ``BROADCAST_ROWS`` rows, which is counted, and by a shuffle otherwise.

Defined results: null texts and texts without words hold nothing; a text or item of fewer than
five words is one shingle, its whole sequence; repeated identifiers count as one document or item;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.llm.tables import lower_ascii
from arborlake.session import materialise

WIDTH = 5
SHARE = 0.75
SKETCH = 24
MISS = 1e-7  # chance that the sketch of a contained item has too few hits
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_rows(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key, shingle, n_words``: one row for each place; rows are made one by one, not as arrays."""
    # the words come through an explode of their starts, so that the text is split once a row
    split = df.select(key, *keep, words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    at = split.select(key, *keep, "_w", F.explode(F.sequence(
        F.lit(0), F.greatest(F.size("_w") - WIDTH, F.lit(0)))).alias("_i"))
    return at.select(key, *keep, F.size("_w").alias("n_words"), F.concat_ws(
        " ", *[F.get("_w", F.col("_i") + k) for k in range(WIDTH)]).alias("shingle"))


def least_hits(sketch: int, share: float = SHARE, miss: float = MISS) -> int:
    """Fewest hits to ask for, so that an item held to ``share`` has fewer with chance ``miss``."""
    below, hits = 0.0, 0
    while True:
        below += math.comb(sketch, hits) * share ** hits * (1 - share) ** (sketch - hits)
        if below > miss:
            return max(1, hits)
        hits += 1


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE,
                  sketch: int = SKETCH) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every item held by a document."""
    held = docs.select("doc_id", "text")
    item_shingles = materialise(
        shingle_rows(items.select("item_id", "text"), "item_id", "text")
        .select("item_id", "shingle").distinct(), "item-shingles")
    sizes = item_shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    smallest = Window.partitionBy("item_id").orderBy(F.xxhash64("shingle", F.lit(7)), "shingle")
    sketches = (
        item_shingles.withColumn("_rank", F.row_number().over(smallest)).filter(F.col("_rank") <= sketch)
        .join(sizes, "item_id")
        .select("item_id", "n_shingles", F.xxhash64("shingle").alias("_h"),
                # an item's share must fit into the size partition; words bound the shingles
                F.floor(F.log2(F.ceil(F.col("n_shingles") * share))).cast("int").alias("_least")))
    sketches = materialise(sketches, "item-sketches")
    small = sketches.count() <= BROADCAST_ROWS
    places = shingle_rows(held, "doc_id", "text").select(
        "doc_id", F.xxhash64("shingle").alias("_h"),
        F.floor(F.log2(F.greatest(F.col("n_words") - WIDTH + 1, F.lit(1)).cast("double"))).cast("int").alias("_size"))
    met = places.join(F.broadcast(sketches) if small else sketches, "_h").filter("_size >= _least")
    hits = met.groupBy("doc_id", "item_id", "n_shingles").agg(F.count_distinct("_h").alias("_hits"))
    # an item with fewer shingles than the sketch has places is in the sketch whole
    wanted = F.element_at(F.array(*[F.lit(least_hits(k, share)) for k in range(1, sketch + 1)]),
                          F.least(F.col("n_shingles"), F.lit(sketch)).cast("int"))
    pairs = materialise(hits.filter(F.col("_hits") >= wanted).select("doc_id", "item_id", "n_shingles"),
                        "item-candidates")
    suspects = pairs.select("doc_id").distinct()
    texts = held.join(suspects, "doc_id", "left_semi")
    shared = (
        shingle_rows(texts, "doc_id", "text").select("doc_id", "shingle").distinct()
        .join(item_shingles, "shingle").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared")))
    return (
        pairs.join(shared, ["doc_id", "item_id"])
        .filter(F.col("n_shared") >= F.col("n_shingles") * share)
        .select("doc_id", "item_id", "n_shingles", "n_shared",
                (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


ORACLE = f"""
WITH w(doc_id, item_id, a) AS (
  SELECT doc_id, NULL, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM documents
  UNION ALL
  SELECT NULL, item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT doc_id, item_id, unnest(list_transform(range(0, greatest(len(a) - {WIDTH}, 0) + 1),
    lambda i: array_to_string(a[i + 1:i + {WIDTH}], ' '))) AS shingle FROM w WHERE len(a) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM s WHERE item_id IS NOT NULL GROUP BY item_id)
SELECT d.doc_id, i.item_id, n.n_shingles, count(*) AS n_shared,
  count(*) / CAST(n.n_shingles AS DOUBLE) AS containment
FROM (SELECT * FROM s WHERE doc_id IS NOT NULL) d
JOIN (SELECT * FROM s WHERE item_id IS NOT NULL) i USING (shingle) JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.n_shingles HAVING count(*) >= n.n_shingles * {SHARE}
"""
