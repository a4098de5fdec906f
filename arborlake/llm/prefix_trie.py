"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Its key is a chained hash: SHA-256 of the parent's
key and of the last turn, cut to 128 bits and held as two longs. Only keys, lengths and identifiers
are shuffled, never texts.

Peeling descends from the maximum depth. A level holds the surviving nodes of the level below,
stripped of their last turn, and the conversations that newly end there; one grouping by key merges
them, which discovers the level's nodes and aggregates all their facts at once. Every fact is a sum
or a minimum, so equal keys merge before the shuffle and a prefix that a third of all conversations
share costs no task more than another. Two kinds of merge need no level of their own:

* equal conversations end at one key; they are merged first, for all depths at once;
* nodes that only one distinct conversation passes through (its tail) have nothing to merge with;
  the tail is stripped in one step, and peeling starts where some other conversation can be met.

So there are as many rounds as the longest prefix that different conversations share, however long
single conversations are. Each level is written before the next one reads it.

Defined results: rows without ``conv_id`` take no part; null role or text is empty; a null turn
comes first; rows of one turn number are ordered by the hash of role and text, and repeated rows are
turns of their own; extra columns are ignored; an empty table has no node, not even the root. The
turns of one conversation are chained as a stream, so a long one needs time, not memory.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from arborlake.operators.ordering import numbered
from arborlake.session import materialise, new_work_path

CHAIN = "conv_id LONG, depth INT, k1 LONG, k2 LONG, p1 LONG, p2 LONG, chars LONG, last BOOLEAN"
NODE = "k1 LONG, k2 LONG, p1 LONG, p2 LONG, conv_id LONG, n_convs LONG, n_children LONG, n_leaves LONG, saved_tokens LONG"
HEAD_TURNS = 5  # most turns that a conversation takes from its group's first one
GROUP = 100


class Trie(NamedTuple):
    """``nodes``: one row a node; ``ends``: ``k1, k2, conv_id`` of each conversation's last node."""

    nodes: DataFrame
    ends: DataFrame


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, chars``: turns numbered from 1, texts replaced by their hash."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))
    return numbered(turns, ["turn", "digest"], ["conv_id"], "pos").select("conv_id", "pos", "digest", "chars")


def whole(turns: DataFrame) -> DataFrame:
    """The conversations as they are, as input of ``prefix_trie``."""
    return turns.unionByName(_headers(turns))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversation c starts with h turns of conversation ``c - c % 100``, then follow its own after h.

    h is the CRC-32 of the decimal identifier, modulo 6.
    """
    own_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)
    headers = _headers(turns)
    first = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= HEAD_TURNS)).withColumnRenamed(
        "conv_id", "source")
    taken = (
        headers.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"))
        .join(first, "source").filter(F.col("pos") <= own_head).drop("source")
    )
    return turns.filter(F.col("pos") > own_head).unionByName(taken).unionByName(headers)


def _headers(turns: DataFrame) -> DataFrame:
    """A row at place 0 for each conversation, so that turnless ones are kept."""
    return turns.filter("pos = 1").select(
        "conv_id", F.lit(0).cast(turns.schema["pos"].dataType).alias("pos"),
        F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("chars"))


def _chains(batches):
    """Chained keys of sorted rows; a row is given out once the next one shows whether it was the last."""
    held, conv, depth, key = None, None, 0, bytes(16)
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), *[(c, pa.int64()) for c in (
        "k1", "k2", "p1", "p2", "chars")], ("last", pa.bool_())])
    for batch in batches:
        rows = []
        for conv_id, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars"))):
            if held is not None:
                rows.append((*held, conv_id != conv))
            if conv_id != conv:
                conv, depth, key, parent = conv_id, 0, bytes(16), (None, None)
            else:
                parent = struct.unpack("<qq", key)
                key = hashlib.sha256(key + bytes.fromhex(digest)).digest()[:16]
                depth += 1
            held = (conv, depth, *struct.unpack("<qq", key), *parent, chars)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], f.type) for c, f in zip((*held, True), schema)], schema=schema)


def _stripped(turns: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """All chains, those of distinct conversations with their tails stripped, and the latter's folder.

    ``level`` is the depth of rows that are still to be peeled and -1 in a tail.
    """
    spark = turns.sparkSession
    chains = materialise(
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
        .select("conv_id", "digest", "chars").mapInArrow(_chains, CHAIN), "chains")
    merged = chains.filter("last").groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("depth").alias("length"))
    distinct = materialise(
        chains.drop("last").join(merged.drop("k1", "k2"), "conv_id"), "distinct-chains")
    met = distinct.filter("depth > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    split = distinct.filter("depth > 0").join(met, ["k1", "k2"], "left_semi").groupBy("conv_id").agg(
        F.max("depth").alias("split"))
    downwards = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    tail = F.col("depth") > F.col("split")
    rows = (
        distinct.join(split, "conv_id", "left").withColumn("split", F.coalesce("split", F.lit(0)))
        .withColumn("saved", F.sum(F.when(tail, (F.col("n") - 1) * F.col("chars")).otherwise(0)).over(downwards))
        .withColumn("level", F.when(tail, -1).otherwise(F.col("depth")))
    )
    path = new_work_path(spark, "levels")
    rows.write.partitionBy("level").parquet(path)
    return chains, spark.read.schema(rows.schema).parquet(path), path


def _level(rows: DataFrame, below: DataFrame | None) -> DataFrame:
    """Nodes of one level: what ends or enters here and the nodes below without their last turn."""
    enters = F.col("depth") == F.col("split")
    more = (enters & (F.col("length") > F.col("split"))).cast("long")
    here = rows.select(
        "k1", "k2", "p1", "p2", F.when(enters, F.col("conv_id")).alias("conv_id"),
        F.when(enters, F.col("n")).otherwise(0).alias("n_convs"), more.alias("n_children"),
        more.alias("n_leaves"), F.when(enters, F.col("saved")).otherwise(0).alias("saved_tokens"), "chars")
    if below is not None:
        nothing = F.lit(None).cast("long")
        here = here.unionByName(below.select(
            F.col("p1").alias("k1"), F.col("p2").alias("k2"), nothing.alias("p1"), nothing.alias("p2"),
            "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
            nothing.alias("chars")))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return here.groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), *sums,
        F.max("chars").alias("chars"),
    ).select(
        "k1", "k2", "p1", "p2", "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))


def prefix_trie(turns: DataFrame) -> Trie:
    """Trie of ``whole(turns)`` or ``rebuilt(turns)``.

    Nodes: ``k1, k2, depth, conv_id`` (smallest member), ``parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens`` (code points that a shared prefix spares in the whole subtree).
    """
    spark = turns.sparkSession
    chains, rows, path = _stripped(turns)
    peeled = new_work_path(spark, "peeled")
    deepest = rows.agg(F.max("level")).first()[0]
    below, levels = None, []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        at = spark.read.schema(rows.drop("level").schema).parquet(f"{path}/level={depth}")
        _level(at, below).write.parquet(f"{peeled}/depth={depth}")
        below = spark.read.schema(NODE).parquet(f"{peeled}/depth={depth}")
        levels.append(depth)
    tails = rows.filter("level = -1").select(
        "k1", "k2", "p1", "p2", "conv_id", F.col("n").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("depth").cast("long").alias("depth"),
        (F.col("depth") > F.col("split") + 1).alias("own"))
    columns = ["k1", "k2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
               "saved_tokens"]
    nodes = tails.filter("own").withColumn("parent_conv_id", F.col("conv_id")).select(columns)
    if levels:
        found = spark.read.schema(f"{NODE}, depth LONG").parquet(peeled)
        parents = found.select(
            F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        nodes = nodes.unionByName(
            tails.filter("NOT own").drop("own").unionByName(found)
            .join(parents, ["p1", "p2"], "left").select(columns))
    return Trie(nodes, chains.filter("last").select("k1", "k2", "conv_id"))


def _joined_hashes(batches):
    """SHA-256 of the comma-joined identifiers of each key; rows come sorted, one digest is held."""
    key, running = None, None
    done: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))],
            ["k1", "k2", "ends_sha256"])

    for batch in batches:
        for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
            if (k1, k2) == key:
                running.update(b",%d" % conv)
                continue
            if key is not None:
                done.append((*key, running.hexdigest()))
            key, running = (k1, k2), hashlib.sha256(b"%d" % conv)
        if done:
            yield out()
            done.clear()
    if key is not None:
        done.append((*key, running.hexdigest()))
        yield out()


def with_ends_hash(trie: Trie) -> DataFrame:
    """Nodes with ``ends_sha256`` over the identifiers of the conversations that end there.

    A hash of one ordered list is sequential: the identifiers of one node pass through one task,
    sorted by Spark and hashed as a stream.
    """
    hashes = (
        trie.ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
        .mapInArrow(_joined_hashes, "k1 LONG, k2 LONG, ends_sha256 STRING")
    )
    return trie.nodes.join(hashes, ["k1", "k2"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("k1", "k2")


#: The same for DuckDB. A node lies below another if its smallest member is a member of the other.
ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)),
      lambda i: ascii((conv_id::VARCHAR)[i + 1])::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS h FROM c),
s AS (SELECT h.conv_id,
    list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(h.own, h + 1, len(h.own))) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(turns) AS length, d AS depth, list_slice(turns, 1, d) AS prefix
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(length(any_value(prefix)[depth].text), 0) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '') AS ends
  FROM m GROUP BY depth, prefix),
k AS (SELECT m.conv_id AS member, m.depth, n.conv_id AS node FROM m JOIN n USING (depth, prefix)),
p AS (SELECT n.*, k.node AS parent FROM n LEFT JOIN k ON k.member = n.conv_id AND k.depth = n.depth - 1),
f AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM p GROUP BY ALL),
g AS (SELECT p.*, coalesce(n_children, 0) AS n_children
  FROM p LEFT JOIN f ON f.parent = p.conv_id AND f.depth = p.depth),
u AS (SELECT k.node, k.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum((n_convs - 1) * chars) AS saved
  FROM g JOIN k ON k.member = g.conv_id AND k.depth <= g.depth GROUP BY ALL)
SELECT g.conv_id, g.depth, g.parent AS parent_conv_id, g.n_convs, g.n_children, u.n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN u ON u.node = g.conv_id AND u.depth = g.depth
"""
