"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side in no vocabulary token can never be merged, so a text may be
cut between them; the fragments are encoded independently and their ids are concatenated. The
tokenizer also splits texts by a pattern first, so only cuts that this pattern cannot see are
used: the left byte is ASCII and not white space (nothing the pattern looks ahead for), the right
byte starts a character and is no apostrophe (which could open a contraction).

Fragments repeat a lot: each batch encodes its distinct fragments once, with a bounded memo.

``encode`` and ``decode`` are a Python pass each; ``recode`` does both in one, so that a task needs one
Python worker and not two at once.

Defined results: a null text counts as empty and has no ids; extra columns are kept.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm.tables import arrow_map
from arborlake.llm.text import Texts, parts, slices

MEMO = 100_000  # distinct fragments that a task remembers
PART = 1 << 20  # bytes of text encoded at a time: the library holds objects for all their tokens meanwhile


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file for each byte: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(definition: dict) -> list[bytes]:
    """Bytes of each id; added tokens stand for their own text."""
    letters = byte_letters()
    found = {i: bytes(letters[c] for c in token) for token, i in definition["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in definition["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def forced_cuts(definition: dict) -> np.ndarray:
    """``cut[256 * a + b]``: a text may be cut between the bytes ``a`` and ``b``."""
    inside = np.zeros(65536, bool)
    for token in token_bytes(definition):
        pair = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[pair[:-1] * 256 + pair[1:]] = True
    left = np.array([a < 128 and a not in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32) for a in range(256)])
    right = np.array([(b < 128 or b >= 192) and b != ord("'") for b in range(256)])
    return ~inside & np.repeat(left, 256) & np.tile(right, 256)


def fragments(texts: Texts, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the fragments of all texts."""
    n = len(texts.data)
    opens = np.zeros(n, bool)
    if n > 1:
        pair = texts.data[:-1].astype(np.int32) * 256 + texts.data[1:]
        opens[1:] = cut[pair]
    starts = texts.offsets[:-1]
    opens[starts[starts < n]] = True
    at = np.flatnonzero(opens)
    return at, np.append(at[1:], n) if len(at) else at


def spread(values: np.ndarray, begin: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[begin[k]:begin[k] + length[k]]`` for the ``k`` in ``order``."""
    n = length[order]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(begin[order] - (ends - n), n) + np.arange(ends[-1])]


def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _encoder(shared, text_column: str):
    def run(batches):
        tokenizer = _tokenizer(shared.value)
        cut = forced_cuts(json.loads(shared.value))
        memo: dict[str, bytes] = {}
        for batch in batches:
            for part in parts(batch, text_column, PART):
                texts = Texts(part.column(text_column))
                starts, ends = fragments(texts, cut)
                coded = slices(texts.data, starts, ends).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(memo) > MEMO:
                    memo.clear()
                new = [f for f in distinct if f not in memo]
                for f, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                    memo[f] = np.array(e.ids, "<u4").tobytes()
                pieces = [memo[f] for f in distinct]
                length = np.array([len(p) // 4 for p in pieces], np.int64)
                order = coded.indices.to_numpy(zero_copy_only=False)
                ids = spread(np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(length) - length,
                             length, order)
                before = np.concatenate([[0], np.cumsum(length[order])])
                ends_of = before[np.searchsorted(starts, texts.offsets)]
                column = pa.Array.from_buffers(
                    pa.large_binary(), len(texts),
                    [None, pa.py_buffer(ends_of * 4), pa.py_buffer(np.ascontiguousarray(ids))])
                yield (part.append_column("n_tokens", pa.array(np.diff(ends_of), pa.int64()))
                       .append_column("ids", column.cast(pa.binary())))
    return run


def _decoder(shared, text_column: str):
    def run(batches):
        tokens = token_bytes(json.loads(shared.value))
        length = np.array([len(t) for t in tokens], np.int64)
        letters, begin = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length
        for batch in batches:
            for part in parts(batch, "ids", 1 << 20):
                coded = Texts(part.column("ids"))
                ids = coded.data.view("<u4") if len(coded.data) else np.zeros(0, np.uint32)
                raw = spread(letters, begin, length, ids).tobytes()
                ends = np.concatenate([[0], np.cumsum(length[ids])])[coded.offsets // 4].tolist()
                found = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
                yield part.append_column(text_column, pa.array(found, pa.string()))
    return run


def _definition(spark, path: str):
    """The vocabulary file (a few MB, whatever the data) for the tasks."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _schema(df: DataFrame, extra: str) -> str:
    from pyspark.sql.types import StructType
    return StructType(df.schema.fields + StructType.fromDDL(extra).fields)


def encode(df: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) to the rows."""
    df = df.drop("n_tokens", "ids")
    return arrow_map(df, _encoder(_definition(df.sparkSession, path), text_column),
                     _schema(df, "n_tokens LONG, ids BINARY"))


def decode(df: DataFrame, path: str, text_column: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; bytes that are no UTF-8 become replacement characters."""
    df = df.drop(text_column)
    return arrow_map(df, _decoder(_definition(df.sparkSession, path), text_column),
                     _schema(df, f"{text_column} STRING"))


def recode(df: DataFrame, path: str, text_column: str = "text", decoded_column: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass over the rows."""
    df = df.drop("n_tokens", "ids", decoded_column)
    shared = _definition(df.sparkSession, path)
    encoder, decoder = _encoder(shared, text_column), _decoder(shared, decoded_column)
    return arrow_map(df, lambda batches: decoder(encoder(batches)),
                     _schema(df, f"n_tokens LONG, ids BINARY, {decoded_column} STRING"))
