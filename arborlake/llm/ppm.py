"""LM scoring by prediction by partial matching, pretrained over bytes.

The context trie has depth ``ORDER``. Its nodes are tables: counts of each (context, symbol) for
orders 0 to ``ORDER``, and per context the number of symbols seen, of distinct symbols, and the
mass that these symbols have one order lower. A symbol is coded in the longest context that has
seen it. Escapes follow method C, and symbols of a longer context are excluded from all shorter
ones: sets of symbols grow as contexts get shorter, so the exclusion at order k is just the set
of order k + 1, and each (context, symbol) has one code length, found by joins over the tables.
Below order 0 all symbols not yet seen are equally likely. A text is its bytes, A-Z lower-cased,
then an end symbol; contexts at its start are padded.

Each block of documents asks for the code lengths of its own distinct (context, symbol) strings,
so no task needs the whole trie, and the trie may grow with the corpus without bound.

The base score is that of single words with counts of the same training rows.

Defined results: a null text counts as empty, one end symbol and one end token; a row without an
identifier is not held out; without training rows all symbols and tokens are equally likely;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from arborlake.llm.blocks import in_blocks, with_facts
from arborlake.llm.quality import held_out
from arborlake.llm.tables import arrow_map
from arborlake.llm.text import Texts, parts
from arborlake.session import materialise

ORDER = 4
FOLDS = 5
SYMBOLS = 257
_PAD, _END = 255, 254  # bytes that UTF-8 never uses
_MERGE = 3_000_000  # entries a task gathers before it merges them

_FACTS = "gram LONG, word STRING"


def grams(texts: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed context and symbol of every symbol of all texts, and the texts' bounds in them."""
    n = len(texts)
    lead = order + 1  # padding in front and the end symbol behind
    size = np.diff(texts.offsets)
    padded = np.full(len(texts.data) + n * lead, _PAD, np.uint8)
    owner = np.repeat(np.arange(n), size)
    padded[np.arange(len(texts.data)) + owner * lead + order] = texts.data
    padded[texts.offsets[1:] + np.arange(1, n + 1) * lead - 1] = _END
    packed = np.zeros(max(0, len(padded) - order), np.uint64)
    for k in range(order + 1):
        packed = packed << np.uint64(8) | padded[k:len(padded) - order + k]
    # symbol j of text i ends at place offsets[i] + i * lead + order + j of the padded bytes
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(bounds[-1]) + np.repeat(np.arange(n) * order, size + 1)
    return packed[at], bounds


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def _count(order: int):
    schema = pa.schema([("gram", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def rows(gram, word, n):
        return pa.record_batch([
            pa.array(gram, pa.int64()) if gram is not None else pa.nulls(len(n), pa.int64()),
            word.cast(pa.string()) if word is not None else pa.nulls(len(n), pa.string()),
            pa.array(n, pa.int64())], schema=schema)

    def run(batches):
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in parts(batch):
                texts = Texts(part.column("text"), lower=True)
                train = part.column("train").to_numpy(zero_copy_only=False)
                gram, bounds = grams(texts, order)
                learnt = np.repeat(train, np.diff(bounds))
                for chosen, weight in ((learnt, 1), (~learnt, 0)):
                    key, n = np.unique(gram[chosen], return_counts=True)
                    keys.append(key)
                    counts.append(n * weight)
                    held += len(key)
                if held > _MERGE:
                    key, n = _totals(keys, counts)
                    keys, counts, held = [key], [n], 0
                    if len(key) > _MERGE:
                        yield rows(key.view(np.int64), None, n)
                        keys, counts = [], []
                words = texts.words()
                coded = words.strings().dictionary_encode()
                order_of = coded.indices.to_numpy(zero_copy_only=False)
                n = np.bincount(order_of[train[words.owner()]], minlength=len(coded.dictionary))
                seen = np.flatnonzero(n)
                yield rows(None, coded.dictionary.take(pa.array(seen)), n[seen])
        if keys:
            key, n = _totals(keys, counts)
            yield rows(key.view(np.int64), None, n)
    return run


def code_lengths(counted: DataFrame, order: int) -> DataFrame:
    """``gram, value``: log10 probability of the symbol in its context. ``counted``: ``gram, n``."""
    def shortened(gram, k: int):
        return gram.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))

    seen = counted.filter("n > 0")
    counts = {order: seen.select(F.col("gram").alias(f"g{order}"), F.col("n").alias(f"c{order}"))}
    for k in reversed(range(order)):
        counts[k] = seen.groupBy(shortened(F.col("gram"), k).alias(f"g{k}")).agg(F.sum("n").alias(f"c{k}"))

    def bounded(df: DataFrame, k: int) -> DataFrame:
        # proven size: at most 257 ** 2 rows at orders 0 and 1; longer contexts are shuffled
        return F.broadcast(df) if k <= 1 else df

    contexts = {}
    for k in range(order + 1):
        rows = counts[k]
        if k:
            rows = rows.withColumn(f"g{k - 1}", shortened(F.col(f"g{k}"), k - 1)).join(
                bounded(counts[k - 1], k - 1), f"g{k - 1}")
        contexts[k] = rows.groupBy(F.shiftrightunsigned(f"g{k}", 8).alias(f"x{k}")).agg(
            F.sum(f"c{k}").alias(f"n{k}"), F.count(F.lit(1)).alias(f"d{k}"),
            (F.sum(f"c{k - 1}") if k else F.lit(0).cast("long")).alias(f"low{k}"))
    rows = counted.select("gram", F.col("n").alias(f"c{order}"), F.lit(0.0).alias("value"),
                          F.lit(False).alias("done"), F.lit(0).cast("long").alias("mass"),
                          F.lit(0).cast("long").alias("set"))
    for k in reversed(range(order + 1)):
        if k < order:
            rows = rows.withColumn(f"g{k}", shortened(F.col("gram"), k)).join(
                bounded(counts[k], k), f"g{k}", "left")
        rows = rows.withColumn(f"x{k}", F.shiftrightunsigned(shortened(F.col("gram"), k), 8)).join(
            bounded(contexts[k], k), f"x{k}", "left")
        found = F.coalesce(F.col(f"c{k}") > 0, F.lit(False))
        left, kinds = F.col(f"n{k}") - F.col("mass"), F.col(f"d{k}") - F.col("set")
        here = F.when(F.col(f"n{k}").isNull() | (left + kinds <= 0), 0.0).when(
            found, F.log10(F.col(f"c{k}") / (left + kinds))).otherwise(F.log10(kinds / (left + kinds)))
        rows = rows.select(
            "gram", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") + here).alias("value"),
            (F.col("done") | found).alias("done"),
            F.when(F.col(f"n{k}").isNull(), F.col("mass")).otherwise(F.col(f"low{k}")).alias("mass"),
            F.when(F.col(f"n{k}").isNull(), F.col("set")).otherwise(F.col(f"d{k}")).alias("set"))
    unseen = F.log10(F.greatest(F.lit(SYMBOLS) - F.col("set"), F.lit(1)))
    return rows.select("gram", F.when(F.col("done"), F.col("value")).otherwise(
        F.col("value") - unseen).alias("value"))


def _ask(order: int):
    schema = pa.schema([("block", pa.int32()), ("gram", pa.int64()), ("word", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        keys, words = [np.zeros(0, np.uint64)], []
        for batch in table.to_batches():
            for part in parts(batch):
                texts = Texts(part.column("text"), lower=True)
                keys.append(np.unique(grams(texts, order)[0]))
                words.append(texts.words().strings().unique())
        gram = np.unique(np.concatenate(keys)).view(np.int64)
        word = pa.chunked_array(words, pa.large_string()).unique().cast(pa.string())
        n = len(gram) + len(word)
        block = table.column("block")[0].as_py()
        return pa.Table.from_arrays([
            pa.array(np.full(n, block, np.int32)),
            pa.concat_arrays([pa.array(gram), pa.nulls(len(word), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(gram), pa.string()), word])], schema=schema)
    return run


class _Lookup:
    """Values of 64-bit keys: a direct table first, a search for keys that share a place in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 21):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - bits)
        self.table_keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.table_values = np.zeros(1 << bits)
        place = self._place(self.keys)
        self.table_keys[place], self.table_values[place] = self.keys, self.values
        # of keys with one place the last one written owns it; both arrays are written alike
        self.table_values[place] = self.values[np.searchsorted(self.keys, self.table_keys[place])]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        out = self.table_values[place]
        other = np.flatnonzero(self.table_keys[place] != keys)
        out[other] = self.values[np.searchsorted(self.keys, keys[other])]
        return out


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                     ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(order: int, tokens: int, kinds: int, ends: int):
    def run(table: pa.Table, facts: pa.Table) -> pa.Table:
        is_gram = pc.is_valid(facts.column("gram"))
        lookup = _Lookup(
            facts.column("gram").filter(is_gram).to_numpy().view(np.uint64),
            facts.column("value").filter(is_gram).to_numpy())
        is_word = pc.is_valid(facts.column("word"))
        known = facts.column("word").filter(is_word).combine_chunks().cast(pa.large_string())
        times = np.append(facts.column("value").filter(is_word).to_numpy(), 0.0)
        scale = np.log10(tokens + 0.5 * (kinds + 1))
        out = []
        for batch in table.to_batches():
            for part in parts(batch, size=1 << 22):
                texts = Texts(part.column("text"), lower=True)
                gram, bounds = grams(texts, order)
                score = np.add.reduceat(lookup(gram), bounds[:-1])
                words = texts.words()
                coded = words.strings().dictionary_encode()
                where = pc.index_in(coded.dictionary, known).fill_null(len(known)).to_numpy(zero_copy_only=False)
                c = times[where][coded.indices.to_numpy(zero_copy_only=False)]
                owner, n = words.owner(), words.counts()
                base = np.bincount(owner, np.log10(c + 0.5) - scale, len(texts))
                out.append(pa.record_batch([
                    part.column("doc_id"), part.column("held_out"), pa.array(n + 1),
                    pa.array((np.bincount(owner, c > 0, len(texts)) + (ends > 0)).astype(np.int64)),
                    pa.array(base + np.log10(ends + 0.5) - scale), pa.array(score)], schema=_SCORES))
        return pa.Table.from_batches(out, _SCORES)
    return run


def lm_scores(docs: DataFrame, order: int = ORDER, **blocks_of) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    blocks, _ = in_blocks(docs, **blocks_of)
    blocks = blocks.withColumn("held_out", held_out(F.col("doc_id"), FOLDS))
    counted = materialise(
        arrow_map(blocks.select("text", (~F.col("held_out")).alias("train")), _count(order), f"{_FACTS}, n LONG")
        .groupBy("gram", "word").agg(F.sum("n").alias("n")), "counts")
    ends = blocks.filter(~F.col("held_out")).count()
    words = counted.filter(F.col("word").isNotNull())
    kinds, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds, tokens = kinds + (ends > 0), tokens + ends
    lengths = code_lengths(counted.filter(F.col("gram").isNotNull()).select("gram", "n"), order)
    model = materialise(
        lengths.select(F.col("gram").alias("_gram"), F.lit(None).cast("string").alias("_word"), "value")
        .union(words.select(F.lit(None).cast("long"), "word", F.col("n").cast("double"))), "model")
    asked = blocks.groupBy("block").applyInArrow(_ask(order), f"block INT, {_FACTS}")
    facts = asked.join(model, asked["gram"].eqNullSafe(model["_gram"])
                       & asked["word"].eqNullSafe(model["_word"])).select("block", "gram", "word", "value")
    scored = with_facts(blocks, facts, _score(order, tokens, kinds, ends), (
        "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
