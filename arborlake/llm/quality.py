"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Each document has its words hashed into ``2**WORD_BITS`` places (damped counts, unit length) and
one place for each binned structure statistic (shares of letter classes, repetition, word ends)
and for the binned length, given and measured. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

the pairwise interactions in time linear in the number of words.

The model is fitted in one task on at most about ``SAMPLE`` labelled documents, drawn by a hash of
their identifiers from the rows that are not held out; its size does not depend on the data.
Labels, language, source and identifier are never inputs of a score.

Defined results: a null text counts as empty and is scored from its structure alone; a document
without an identifier is neither labelled nor held out; without any labelled row every score is
0.5; conflicting labels of one identifier count as their largest; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arborlake.llm.tables import arrow_map
from arborlake.llm.text import Texts, parts

WORD_BITS = 16
FACTORS = 8
SAMPLE = 12_000
FOLDS = 3
EPOCHS = 6
SEED = 11

_DRAWS = 10**15  # grain of the share of labelled rows that is drawn
_STATS = 12  # structure statistics, each binned twice
_BINS = 32
_PLACES = (1 << WORD_BITS) + (2 * _STATS + 2) * _BINS

_UPPER, _DIGIT, _MARK, _HIGH, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_LINE[[10, 13]] = True
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def features(texts: Texts, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, places and values of the texts' features; ``given`` are their stated lengths."""
    n = len(texts)
    size = np.diff(texts.offsets)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]) / np.maximum(size, 1)

    words = texts.words()
    h, owner, n_words = words.hashes(), words.owner(), words.counts()
    many = np.maximum(n_words, 1)

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, mask, n) / many

    key, count = np.unique(owner.astype(np.uint64) << np.uint64(WORD_BITS)
                           | h & np.uint64((1 << WORD_BITS) - 1), return_counts=True)
    doc = (key >> np.uint64(WORD_BITS)).astype(np.int64)
    place = (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    value = value / np.maximum(norm, 1e-9)[doc]
    top = np.zeros(n)
    np.maximum.at(top, doc, count)
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    last = texts.data[words.ends - 1] if len(h) else np.zeros(0, np.uint8)
    first = texts.data[words.starts] if len(h) else np.zeros(0, np.uint8)
    stats = np.stack([
        share(_UPPER[texts.data]), share(_DIGIT[texts.data]), share(_MARK[texts.data]),
        share(_HIGH[texts.data]), share(_LINE[texts.data]), n_words / np.maximum(size, 1),
        np.bincount(doc, minlength=n) / many, of_words(repeat), top / many, of_words(_MARK[last]),
        of_words(_UPPER[first]), of_words(_UPPER[last])])
    fine = np.minimum((stats * 30).astype(np.int64), 30)
    rough = np.log2(stats * 4096 + 1).astype(np.int64)
    lengths = np.log2(np.stack([size, np.maximum(given, 0)]) + 1).astype(np.int64)
    bins = np.minimum(np.concatenate([fine, rough, lengths]), _BINS - 1)
    more = bins + (1 << WORD_BITS) + np.arange(len(bins))[:, None] * _BINS
    doc = np.concatenate([doc, np.repeat(np.arange(n), len(bins))])
    place = np.concatenate([place, more.T.ravel()])
    value = np.concatenate([value, np.full(more.size, 1 / np.sqrt(len(bins)))])
    order = np.argsort(doc, kind="stable")
    return np.searchsorted(doc[order], np.arange(n + 1)), place[order], value[order].astype(np.float32)


def margins(model: np.ndarray, bias: float, bounds, place, value) -> tuple[np.ndarray, np.ndarray]:
    """Score before the logistic, and the factor sums. ``model`` is ``places x (1 + factors)``."""
    terms = model[place] * value[:, None]
    sums = np.add.reduceat(terms, bounds[:-1]) if len(bounds) > 1 else terms[:0]
    squares = np.add.reduceat((terms[:, 1:] ** 2).sum(1), bounds[:-1]) if len(bounds) > 1 else terms[:0, 0]
    return bias + sums[:, 0] + ((sums[:, 1:] ** 2).sum(1) - squares) / 2, sums[:, 1:]


def fit(bounds, place, value, label, epochs: int = EPOCHS, rate: float = 0.15,
        decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Adaptive gradient descent on the logistic loss, in batches."""
    random = np.random.default_rng(SEED)
    model = np.zeros((_PLACES, 1 + FACTORS), np.float32)
    model[:, 1:] = random.normal(0, 0.02, (_PLACES, FACTORS))
    seen = np.full_like(model, 1e-4)
    bias, seen_bias = 0.0, 1e-4
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(label)), max(1, len(label) // 128)):
            length = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(length)
            at = np.repeat(bounds[rows] - (ends - length), length) + np.arange(ends[-1])
            p, x = place[at], value[at]
            margin, sums = margins(model, bias, np.concatenate([[0], ends]), p, x)
            error = (1 / (1 + np.exp(-margin)) - label[rows]) / len(rows)
            e = np.repeat(error, length)[:, None] * x[:, None]
            step = np.empty((len(p), 1 + FACTORS), np.float32)
            step[:, :1] = e
            step[:, 1:] = e * (np.repeat(sums, length, axis=0) - model[p, 1:] * x[:, None])
            used, where = np.unique(p, return_inverse=True)
            order = np.argsort(where, kind="stable")
            grad = np.add.reduceat(step[order], np.searchsorted(where[order], np.arange(len(used))))
            grad += decay * model[used]
            seen[used] += grad ** 2
            model[used] -= rate * grad / np.sqrt(seen[used])
            seen_bias += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(seen_bias)
    return model, float(bias)


def _given(part: pa.RecordBatch) -> np.ndarray:
    return part.column("n_chars").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _featurise(batches):
    for batch in batches:
        for part in parts(batch):
            bounds, place, value = features(Texts(part.column("text")), _given(part))
            yield pa.record_batch({
                "label": part.column("label").cast(pa.int32()),
                "places": [place[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])],
                "vals": [value[a:b].astype("<f4").tobytes() for a, b in zip(bounds, bounds[1:])]})


def _train(batches):
    rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("places", "vals", "label")))]
    rows.sort()  # the same model whatever the order of arrival
    if rows:
        place = [np.frombuffer(r[0], "<u4").astype(np.int64) for r in rows]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in place])])
        value = np.frombuffer(b"".join(r[1] for r in rows), "<f4")
        model, bias = fit(bounds, np.concatenate(place), value, np.array([r[2] for r in rows], np.float64))
        yield pa.record_batch({"model": [model.tobytes()], "bias": [bias]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """``(model bytes, bias)``, or None where no labelled document is found."""
    labelled = (
        labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))
    total = labelled.count()
    share = min(1.0, sample / max(total, 1))
    # proven bound: about ``sample`` rows, whatever the number of labels
    drawn = F.broadcast(labelled.filter(
        F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(_DRAWS)) < int(share * _DRAWS)))
    rows = _inputs(docs).join(drawn, "doc_id").select("text", "n_chars", "label")
    made = arrow_map(rows, _featurise, "label INT, places BINARY, vals BINARY")
    found = arrow_map(made.repartition(1), _train, "model BINARY, bias DOUBLE").collect()
    return (bytes(found[0]["model"]), found[0]["bias"]) if found else None


def _inputs(docs: DataFrame) -> DataFrame:
    given = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(given, F.char_length(text)).alias("n_chars"))


def _scorer(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        raw, bias = shared.value or (None, 0.0)
        model = np.frombuffer(raw, np.float32).reshape(-1, 1 + FACTORS) if raw else \
            np.zeros((_PLACES, 1 + FACTORS), np.float32)
        for batch in batches:
            for part in parts(batch, size=1 << 22):
                margin, _ = margins(model, bias, *features(Texts(part.column("text")), _given(part)))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(
                    1 / (1 + np.exp(-np.clip(margin, -500, 500).astype(np.float64))))], schema=schema)
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    scored = arrow_map(_inputs(docs), _scorer(shared), "doc_id LONG, score DOUBLE")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
