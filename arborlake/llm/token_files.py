"""Token ids as Parquet lists, laid out so that ids and metadata can be read apart and in part.

Documents are range-partitioned by ``doc_id`` before they are encoded, so a task holds one stretch
of the order, encodes it as a stream and writes one file: ``part, doc_id, at, n_tokens, tokens``
with ``at`` counted from the start of that file. ``parts`` next to it holds, for each file, its
identifiers' range, its rows and the ids before it; ``start`` of a document is the sum of both, so
nothing is written twice and no task sees more than its own stretch.

Format of the files (Spark's own Parquet writer and reader):

* ``tokens`` is a list column, dictionary-encoded as long as the dictionary page suffices and
  delta-packed beyond it; the sorted columns are delta-packed, not dictionary-encoded;
* row groups are cut at ``row_group_bytes`` and pages at ``page_rows`` documents; the writer adds
  column and offset indexes, so a filter on ``doc_id`` skips files, row groups and pages;
* each column lies apart: ``token_index`` reads no id at all.

Defined results: a null text counts as empty and has the end id only; rows without ``doc_id`` come
first; rows that share a ``doc_id`` follow the CRC-32, then the xxhash64 of their texts, and repeated
rows stay; extra columns are left out; an empty table gives files without rows; texts of any length
are encoded whole. An existing ``path`` is an error.
"""

from __future__ import annotations

import contextlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arborlake.llm.bpe import _tokenizer, byte_letters, forced_cuts, fragments, spread, token_bytes
from arborlake.llm.text import Texts, parts, slices

ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256
MEMO = 50_000  # distinct fragments, of those that are not joined, that a worker remembers
BATCH_ROWS = 1000  # documents that travel to a worker at once
# fixed value: the split that the byte-level pre-tokenizer makes
BYTE_LEVEL_SPLIT = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# one space, then printable ASCII and Latin letters up to U+017F, which are letters to every library
_LATIN = "À-ÖØ-öø-ſ"
JOINABLE = f"^ [!-~{_LATIN}]([ -~{_LATIN}]*[!-~{_LATIN}])?$"
SORTED = ("part", "doc_id", "at", "n_tokens")
FILES = "part INT, doc_id LONG, at LONG, n_tokens LONG, tokens ARRAY<INT>"


def plain_merges(definition: dict, tokenizer) -> list[str] | None:
    """Texts of the merges in order, if merging whatever adjacent parts form a token gives the same ids.

    A byte-pair encoder that knows tokens only merges any two parts whose text is a token; the one of
    the file merges listed pairs. Both agree where each token has one merge and the listed merges alone
    lead from the token's bytes to the token: parts x, y that form a token t in another way than t's
    own merge can then never stand side by side, as some pair across their border would have been
    merged before both were complete. None if that does not hold, or the file has other steps.
    """
    model, split = definition["model"], definition.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or definition.get("normalizer") or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True)
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                          "end_of_word_suffix", "byte_fallback", "ignore_merges"))):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    letters = set(byte_letters())
    rest = {t for t in model["vocab"] if t not in letters} - {t["content"] for t in definition["added_tokens"]}
    if len(set(merged)) != len(merged) or not rest <= set(merged) or not letters <= set(model["vocab"]):
        return None
    return merged if all(len(tokenizer.model.tokenize(t)) == 1 for t in merged) else None


class _Encoder:
    """Ids of the texts of a batch; distinct fragments between forced cuts are encoded once.

    With ``merged`` (see ``plain_merges``) fragments of Latin letters and printable ASCII that start
    with one space and end with no blank are encoded by ``tiktoken`` as one text: the pre-tokenizer
    splits them from each other anyway. All others go through the file's own library.
    """

    def __init__(self, definition: str, merged: list[str] | None):
        parsed = json.loads(definition)
        self.tokenizer = _tokenizer(definition)
        self.cut = forced_cuts(parsed)
        self.added = [t["content"] for t in parsed["added_tokens"]]
        self.memo: dict[str, bytes] = {}
        self.fast = None
        if merged is not None:
            import tiktoken
            letters, vocab = byte_letters(), parsed["model"]["vocab"]
            names = [*letters, *merged]
            self.fast = tiktoken.Encoding("merges", pat_str=BYTE_LEVEL_SPLIT, special_tokens={}, mergeable_ranks={
                bytes(letters[c] for c in name): rank for rank, name in enumerate(names)})
            self.ids = np.array([vocab[name] for name in names], "<u4")
            own = token_bytes(parsed)
            self.width = np.array([len(own[i]) for i in self.ids], np.int64)

    def _joinable(self, distinct: pa.Array) -> np.ndarray:
        if self.fast is None:
            return np.zeros(len(distinct), bool)
        found = pc.match_substring_regex(distinct, JOINABLE)
        for content in self.added:
            found = pc.and_not(found, pc.match_substring(distinct, content))
        return found.to_numpy(zero_copy_only=False)

    def _alone(self, rest: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [f for f in rest if f not in self.memo]
        for f, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.memo[f] = np.array(e.ids, "<u4").tobytes()
        return [self.memo[f] for f in rest]

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all fragments, and where those of each begin and how many they are."""
        joined = self._joinable(distinct)
        alone = self._alone(distinct.filter(pa.array(~joined)).to_pylist())
        ids = np.frombuffer(b"".join(alone), "<u4")
        length = np.zeros(len(distinct), np.int64)
        length[~joined] = [len(a) // 4 for a in alone]
        begin = np.zeros(len(distinct), np.int64)
        begin[~joined] = np.cumsum(length[~joined]) - length[~joined]
        if joined.any():
            texts = Texts(distinct.filter(pa.array(joined)))
            ranks = np.array(self.fast.encode_ordinary(texts.data.tobytes().decode()))
            ends = np.searchsorted(np.cumsum(self.width[ranks]), texts.offsets[1:]) + 1
            length[joined] = np.diff(ends, prepend=0)
            begin[joined] = len(ids) + ends - length[joined]
            ids = np.concatenate([ids, self.ids[ranks]])
        return ids, begin, length

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and, for each text, where its ids end."""
        texts = Texts(column)
        starts, ends = fragments(texts, self.cut)
        coded = slices(texts.data, starts, ends).dictionary_encode()
        pieces, begin, length = self._pieces(coded.dictionary)
        order = coded.indices.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(length[order])])
        return spread(pieces, begin, length, order), before[np.searchsorted(starts, texts.offsets[1:])]


_encoders: dict[int, _Encoder] = {}  # of a worker process, for all its tasks


def _encoder(definition: str, merged: list[str] | None) -> _Encoder:
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(definition, merged)
    return _encoders[key]


def _encoded(shared, end_id: int):
    def run(batches):
        encode, at, own = _encoder(*shared.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in parts(batch, "text", 1 << 21):
                ids, ends = encode(part.column("text"))
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                ends = ends + np.arange(1, len(ends) + 1)
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), own, np.int32)), part.column("doc_id"),
                    pa.array(at + begins), pa.array(ends - begins),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)),
                ], ["part", "doc_id", "at", "n_tokens", "tokens"])
                at += int(ends[-1])
    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, end_id: int,
    row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode ``doc_id, text`` with the tokenizer file, end each document with ``end_id``, write ``path``."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:  # a few MB, whatever the data
        definition = file.read()
    merged = plain_merges(json.loads(definition), _tokenizer(definition))
    shared = spark.sparkContext.broadcast((definition, merged))
    text = F.coalesce("text", F.lit(""))
    order = ["doc_id", "_crc", "_hash"]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("_crc", F.crc32(F.encode("text", "UTF-8"))).withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    writer = (
        ordered.mapInArrow(_encoded(shared, end_id), FILES).write
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary#tokens.list.element", "true")
    )
    for column in SORTED:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    with _small_batches(spark):
        writer.parquet(f"{path}/tokens")
    files = _files(spark, path).groupBy("part").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("n_tokens"))
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Few documents a batch while a job runs; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{path}/tokens")


def token_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: ``part, first_id, last_id, rows, n_tokens, before``."""
    return spark.read.schema(
        "part INT, first_id LONG, last_id LONG, rows LONG, n_tokens LONG, before LONG").parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens``; only the columns that are used are read from the files."""
    # one row for each file
    before = F.broadcast(token_parts(spark, path).select("part", "before"))
    return _files(spark, path).join(before, "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "tokens")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` without reading ids."""
    return read_token_files(spark, path).drop("tokens")


def _checksums(batches):
    import zlib

    for batch in batches:
        tokens = batch.column("tokens")
        ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
        ids = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in ("doc_id", "start", "n_tokens")],
            pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
        ], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: CRC-32 of each document's ids (little-endian, 32 bits)."""
    return read_token_files(spark, path).mapInArrow(
        _checksums, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")
