"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve through the vector space and
written as a Parquet table with one row a block: at most ``BLOCK`` rows of one label, packed, beside
the least and greatest value of each dimension (the zone map). Consecutive blocks form an extent.

The inner product of an anchor with any row of a block lies in the interval that the zone map gives:
in each dimension the product with the least or the greatest value bounds it. A search has, for each
anchor, windows of scores and a number of rows wanted from the top of each window:

1. all zone maps, without payloads, meet all chunks of anchors; the blocks with the greatest upper
   bounds are read first, and the last wanted score found there raises the window's lower end;
2. the zone maps are met again: only blocks whose interval meets a window that is still open are
   read, extents no anchor asks for are not, and the best rows of all blocks are ranked.

It runs twice: for the positives (same label, one open window), and for the negatives (other labels,
one window for each positive). Results are exact whatever the bounds leave out; on vectors without
structure they leave out little, and the search becomes blocked matrix products. Anchors meet blocks
as (extent, group of chunks), both of bounded size, so no task holds all of either.

Defined results: rows without ``vec_id``, label or vector, or with a null or non-finite component, take
no part, nor do rows with a component beyond 2**24 (their products need not fit into a long); rows
are compared with rows of their own length only; rows that share the anchor's ``vec_id`` are never its
positives; repeated rows count each, repeated anchors are answered each; ties go to the smaller
``vec_id``; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.session import materialise

BLOCK = 256  # rows of a block
EXTENT = 64  # blocks that travel together
CHUNK = 256  # anchors that are compared together
GROUP = 64  # chunks that meet an extent in one task
SHELF = 1024  # zone maps that meet a group of chunks in one task
SEEDS = 4  # blocks an anchor reads first
BITS = 3  # bits of the curve in each dimension
LIMIT = 1 << 24

BLOCKS = ("extent LONG, slot INT, dims INT, label INT, n INT, least BINARY, greatest BINARY, "
          "ids BINARY, vectors BINARY")
CHUNKS = "chunk LONG, dims INT, ids BINARY, labels BINARY, vectors BINARY, low BINARY, high BINARY"
SEEN = "extent LONG, bundle INT, chunk LONG, code INT, bound DOUBLE"
WANTED = "extent LONG, bundle INT, chunk LONG, codes ARRAY<INT>"
FOUND = "chunk LONG, place INT, window INT, anchor_id LONG, score LONG, vec_id LONG"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of cell numbers on a Hilbert curve (Skilling's transpose form), as bytes."""
    x = cells.astype(np.uint32)
    dims = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1 and dims:
        below = np.uint32(bit - 1)
        for i in range(dims):
            high = (x[:, i] & bit) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & below).astype(np.uint32)
            x[:, 0] ^= np.where(high, below, swap).astype(np.uint32)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1 and dims:
        turn ^= np.where((x[:, -1] & bit) != 0, bit - 1, 0).astype(np.uint32)
        bit >>= 1
    x ^= turn[:, None]
    planes = [(x >> (bits - 1 - j)) & 1 for j in range(bits)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def quantised(embeddings: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: components become ``floor(scale * x)``; rows that take no part are gone."""
    components = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double") * scale) < LIMIT))
    return embeddings.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & usable
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
             F.transform(components, lambda x: x.cast("int")).alias("vector"))


def _keyed(largest: int):
    """Adds the length and the curve's key of each vector."""
    def run(batches):
        for batch in batches:
            dims = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            keys = np.empty(len(dims), object)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                values = _matrix(batch.column("vector").take(pa.array(rows)), len(rows))
                cells = ((values.astype(np.int64) + largest) << BITS) // (2 * largest + 1)
                keys[rows] = hilbert_keys(cells, BITS)
            yield (batch.append_column("dims", pa.array(dims, pa.int32()))
                   .append_column("key", pa.array(keys, pa.binary())))
    return run


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(rows, -1)


def _runs(batches, size: int, by: tuple[str, ...]):
    """Consecutive sorted rows that agree in ``by``, as Arrow tables of at most ``size`` rows."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
        at = 0
        while at < len(keys):
            if rows and (rows == size or keys[at] != last):
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
            last, to = keys[at], at
            while to < len(keys) and to - at < size - rows and keys[to] == last:
                to += 1
            held.append(batch.slice(at, to - at))
            rows, at = rows + to - at, to
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _row(schema: str, **values) -> pa.RecordBatch:
    types = {"LONG": pa.int64(), "INT": pa.int32(), "BINARY": pa.binary(), "DOUBLE": pa.float64(),
             "ARRAY<INT>": pa.list_(pa.int32())}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(values[name], types[kind]) for name, kind in fields], [name for name, _ in fields])


def _blocks(batches):
    for number, run in enumerate(_runs(batches, BLOCK, ("dims", "label"))):
        run = run.sort_by("vec_id")
        vectors = _matrix(run.column("vector").combine_chunks(), len(run))
        extent = (TaskContext.get().partitionId() << 33) + number // EXTENT
        yield _row(
            BLOCKS, extent=[extent], slot=[number % EXTENT], dims=[vectors.shape[1]],
            label=[run.column("label")[0].as_py()], n=[len(run)], least=[vectors.min(0).tobytes()],
            greatest=[vectors.max(0).tobytes()], ids=[run.column("vec_id").to_numpy().tobytes()],
            vectors=[vectors.tobytes()])


def _chunks(batches):
    """Chunks of anchors with one open window each."""
    for number, run in enumerate(_runs(batches, CHUNK, ("dims",))):
        vectors = _matrix(run.column("vector").combine_chunks(), len(run))
        ends = np.iinfo(np.int64)
        yield _row(
            CHUNKS, chunk=[(TaskContext.get().partitionId() << 33) + number], dims=[vectors.shape[1]],
            ids=[run.column("vec_id").to_numpy().tobytes()],
            labels=[run.column("label").to_numpy().astype(np.int32).tobytes()],
            vectors=[vectors.tobytes()], low=[np.full(len(run), ends.min).tobytes()],
            high=[np.full(len(run), ends.max).tobytes()])


class _Chunk:
    """A chunk of anchors; ``low`` and ``high`` have a column for each window."""

    def __init__(self, row: dict):
        self.number, self.dims = row["chunk"], row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int32)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, self.dims)
        self.low = np.frombuffer(row["low"], np.int64).reshape(n, -1)
        self.high = np.frombuffer(row["high"], np.int64).reshape(n, -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; floating point where it is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if most < 2.0**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class _Zones:
    """Zone maps of a shelf, by length of vectors."""

    def __init__(self, table: pa.Table):
        rows = table.select(["extent", "slot", "dims", "label", "least", "greatest"]).to_pylist()
        self.by_dims = {}
        for d in {r["dims"] for r in rows}:
            own = [r for r in rows if r["dims"] == d]
            self.by_dims[d] = (
                np.array([r["extent"] for r in own]), np.array([r["slot"] for r in own]),
                np.array([r["label"] for r in own]),
                *(np.frombuffer(b"".join(r[c] for r in own), np.int32).reshape(len(own), d).astype(float)
                  for c in ("least", "greatest")))

    def open(self, chunk: _Chunk, same: bool):
        """Extents, slots, upper bounds and which zones may hold a row of some window of each anchor."""
        if chunk.dims not in self.by_dims:
            return None
        extents, slots, labels, least, greatest = self.by_dims[chunk.dims]
        plus, minus = np.maximum(chunk.vectors, 0).astype(float), np.minimum(chunk.vectors, 0).astype(float)
        upper = plus @ greatest.T + minus @ least.T
        lower = plus @ least.T + minus @ greatest.T
        upper += np.abs(upper) * 1e-9  # for sums beyond the exact range of floating point
        lower -= np.abs(lower) * 1e-9
        meets = np.zeros(upper.shape, bool)
        for low, high in zip(chunk.low.T, chunk.high.T):
            meets |= (upper >= low[:, None]) & (lower <= high[:, None]) & (low <= high)[:, None]
        return extents, slots, upper, meets & ((chunk.labels[:, None] == labels) == same)


def _first_blocks(same: bool):
    def run(zones: pa.Table, chunks: pa.Table) -> pa.Table:
        shelf, out = _Zones(zones), []
        for row in chunks.to_pylist():
            found = shelf.open(_Chunk(row), same)
            if found is None:
                continue
            extents, slots, upper, meets = found
            ranked = np.where(meets, upper, -np.inf)
            best = np.argsort(-ranked, axis=1, kind="stable")[:, :SEEDS]
            place, _ = np.indices(best.shape)
            keep = np.isfinite(np.take_along_axis(ranked, best, 1))
            place, best = place[keep], best[keep]
            out.append(_row(
                SEEN, extent=extents[best], bundle=np.full(len(best), row["bundle"]),
                chunk=np.full(len(best), row["chunk"]), code=place * EXTENT + slots[best],
                bound=ranked[place, best]))
        return pa.Table.from_batches(out or [_row(SEEN, extent=[], bundle=[], chunk=[], code=[], bound=[])])
    return run


def _needed_blocks(same: bool):
    def run(zones: pa.Table, chunks: pa.Table) -> pa.Table:
        shelf, out = _Zones(zones), []
        for row in chunks.to_pylist():
            found = shelf.open(_Chunk(row), same)
            if found is None:
                continue
            extents, slots, _, meets = found
            for extent in np.unique(extents[meets.any(0)]):
                place, zone = np.nonzero(meets & (extents == extent))
                out.append(_row(WANTED, extent=[extent], bundle=[row["bundle"]], chunk=[row["chunk"]],
                                codes=[place * EXTENT + slots[zone]]))
        return pa.Table.from_batches(out or [_row(WANTED, extent=[], bundle=[], chunk=[], codes=[])])
    return run


def _best_rows(same: bool, k: int):
    """The ``k`` best rows of each window among the wanted blocks of one extent."""
    def run(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        stored = {r["slot"]: r for r in blocks.to_pylist()}
        out = []
        for row in wanted.to_pylist():
            chunk = _Chunk(row)
            codes = np.array(row["codes"])
            slots = np.unique(codes % EXTENT)
            ends = np.cumsum([0] + [stored[s]["n"] for s in slots])
            scores = np.zeros((len(chunk.ids), ends[-1]), np.int64)
            read = np.zeros(scores.shape, bool)
            ids = np.concatenate([np.frombuffer(stored[s]["ids"], np.int64) for s in slots])
            for slot, a, b in zip(slots, ends, ends[1:]):
                block = np.frombuffer(stored[slot]["vectors"], np.int32).reshape(b - a, chunk.dims)
                place = codes[codes % EXTENT == slot] // EXTENT
                scores[place, a:b] = _products(chunk.vectors[place], block)
                read[place, a:b] = True
            if same:
                read &= chunk.ids[:, None] != ids
            for place in np.unique(codes // EXTENT):
                for window, (low, high) in enumerate(zip(chunk.low[place], chunk.high[place])):
                    own = scores[place]
                    at = np.flatnonzero(read[place] & (own >= low) & (own <= high))
                    if len(at) > k:
                        at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((ids[at], -own[at]))[:k]]
                    out.append((chunk.number, place, window, chunk.ids[place], own[at], ids[at]))
        n = [len(o[4]) for o in out]
        fixed = {name: np.repeat([o[i] for o in out], n) if out else [] for i, name in enumerate(
            ("chunk", "place", "window", "anchor_id"))}
        return pa.Table.from_batches([_row(
            FOUND, **fixed, score=np.concatenate([o[4] for o in out]) if out else [],
            vec_id=np.concatenate([o[5] for o in out]) if out else [])])
    return run


class Index(NamedTuple):
    """Written blocks of the candidates and their number."""

    blocks: DataFrame
    n_blocks: int


def _packed(keyed: DataFrame, order: list[str], function, schema: str, label: str) -> DataFrame:
    order = [*order, "vec_id"]
    return materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        function, schema), label)


def _with_keys(rows: DataFrame) -> DataFrame:
    largest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1
    return rows.mapInArrow(
        _keyed(int(largest)), "vec_id LONG, label INT, vector ARRAY<INT>, dims INT, key BINARY")


def _bucket(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _meet(index: Index, chunks: DataFrame, bundles: int, function, schema: str) -> DataFrame:
    """``function(zone maps, chunks)`` for every shelf of zone maps and bundle of chunks."""
    shelves = math.ceil(index.n_blocks / SHELF)
    zones = index.blocks.drop("ids", "vectors").withColumn("shelf", _bucket("extent", shelves)).withColumn(
        "bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    every = chunks.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    return zones.groupBy("shelf", "bundle").cogroup(every.groupBy("shelf", "bundle")).applyInArrow(
        function, schema)


def _read(index: Index, chunks: DataFrame, wanted: DataFrame, same: bool, k: int) -> DataFrame:
    """``FOUND`` and ``rank``: the ``k`` best rows of each anchor and window in the wanted blocks."""
    asked = wanted.select(*[F.col(c).alias(c) for c in ("extent", "bundle")]).distinct()  # new columns
    requests = wanted.join(chunks.drop("bundle"), "chunk")
    found = index.blocks.join(asked, "extent").groupBy("extent", "bundle").cogroup(
        requests.groupBy("extent", "bundle")).applyInArrow(_best_rows(same, k), FOUND)
    order = Window.partitionBy("chunk", "place", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _windows(change):
    """Chunks whose windows ``change(low, high, rows)`` has set from rows found for the chunk."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                low, high = change(chunk.low.copy(), chunk.high.copy(), row.pop("rows") or [])
                row |= {"low": low.tobytes(), "high": high.tobytes()}
                yield pa.RecordBatch.from_pylist([row], batch.schema.remove(
                    batch.schema.get_field_index("rows")))
    return run


def _set_windows(chunks: DataFrame, found: DataFrame, change) -> DataFrame:
    rows = found.groupBy("chunk").agg(  # at most a chunk's anchors, windows and ranks
        F.collect_list(F.struct("place", "window", "rank", "score")).alias("rows"))
    return chunks.join(rows, "chunk", "left").mapInArrow(_windows(change), chunks.schema)


def _raised(low, high, rows):
    for r in rows:
        low[r["place"], r["window"]] = max(low[r["place"], r["window"]], r["score"])
    return low, high


def _search(index: Index, chunks: DataFrame, bundles: int, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each anchor's windows over all blocks."""
    seen = _meet(index, chunks, bundles, _first_blocks(same), SEEN)
    best = Window.partitionBy("chunk", F.floor(F.col("code") / EXTENT)).orderBy(
        F.desc("bound"), "extent", "code")
    first = seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= SEEDS)
    first = first.groupBy("extent", "bundle", "chunk").agg(F.collect_list("code").alias("codes"))
    last = _read(index, chunks, materialise(first, "first-blocks"), same, k).filter(F.col("rank") == k)
    closer = materialise(_set_windows(chunks, last, _raised), "chunks")
    wanted = materialise(_meet(index, closer, bundles, _needed_blocks(same), WANTED), "wanted-blocks")
    return _read(index, closer, wanted, same, k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10,
    low_percent: int = 30, high_percent: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``quantised`` rows.

    For each row that meets ``anchors`` and each of its best rows of the same label: the best rows of
    other labels whose score lies within the two percentages of the positive's.
    """
    keyed = _with_keys(rows)
    blocks = _packed(keyed, ["dims", "label", "key"], _blocks, BLOCKS, "blocks")
    chunks = _packed(keyed.filter(anchors), ["dims", "key"], _chunks, CHUNKS, "chunks")
    n_blocks, n_chunks = blocks.count(), chunks.count()
    index, bundles = Index(blocks, max(1, n_blocks)), max(1, math.ceil(n_chunks / GROUP))
    chunks = chunks.withColumn("bundle", _bucket("chunk", bundles))
    best = materialise(_search(index, chunks, bundles, True, positives), "positives")

    def around(low, high, found):
        low = np.ones((len(low), positives), np.int64)
        high = np.zeros((len(high), positives), np.int64)  # no window without a positive
        for r in found:
            low[r["place"], r["rank"] - 1] = -(-low_percent * r["score"] // 100)
            high[r["place"], r["rank"] - 1] = high_percent * r["score"] // 100
        return low, high

    chunks = materialise(_set_windows(chunks, best, around), "chunks")
    found = _search(index, chunks, bundles, False, negatives)
    pairs = best.select(
        "chunk", "place", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    return found.join(pairs, ["chunk", "place", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


#: The same by brute force, for DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.vector::DOUBLE[], b.vector::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
