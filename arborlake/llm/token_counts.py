"""Token counts by overlap resynchronisation.

Every text is encoded in overlapping chunks with offsets; a short one is a single chunk. Neighbouring
chunks are spliced at a boundary that both encodings have and that is proven stable: a token start
behind white space. ``check_stable`` reads from the tokenizer's file that nothing on one side of white
space can change tokens on the other, and refuses the file otherwise. Where an overlap holds no such
place, it is widened, at worst to the rest of the text.

What stands between white space is encoded once a task and kept, as texts repeat most of it; a chunk's
encoding is put together from these stretches.

Defined results: a null text counts as empty, with no tokens; a null identifier stays null, and rows
that repeat an identifier or a whole row are counted each; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborlake.llm.bpe import _definition, _tokenizer, byte_letters
from arborlake.llm.tables import arrow_map
from arborlake.llm.text import Texts, parts

CHUNK = 1 << 14  # characters
OVERLAP = 256
_BLANK = " \t\n\r\v\f"
_STRETCH = re.compile(f"[^{_BLANK}]+")
KEPT, LONGEST = 1 << 18, 64  # stretches of a generation that a task keeps, and characters of one that it keeps


def check_stable(definition: dict) -> None:
    """Raise where the tokenizer's file does not show that white space keeps its sides apart.

    No token may hold white space beside anything else, so that no merge goes across it; normalisers
    and patterns must not look across it either; added tokens must not hold or swallow it.
    """
    def fail(what: str):
        raise ValueError(f"chunks cannot be spliced behind white space: {what}")

    def steps(part: dict | None, of: str):
        if part is not None:
            yield from [s for p in part[of] for s in steps(p, of)] if part["type"] == "Sequence" else [part]

    for step in steps(definition.get("normalizer"), "normalizers"):
        blanks_to_one = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        if step["type"] not in ("NFC", "NFD", "Lowercase") and not blanks_to_one:
            fail(f"normaliser {step['type']}")
    for step in steps(definition.get("pre_tokenizer"), "pretokenizers"):
        if step["type"] == "Split":
            pattern = step["pattern"].get("Regex", "(?")
            if "(?" in pattern.replace("(?:", "") or r"\b" in pattern or "^" in pattern.replace("[^", ""):
                fail(f"pattern {pattern}")
        elif step["type"] != "ByteLevel" or step.get("add_prefix_space") or step.get("use_regex", True):
            fail(f"pre-tokeniser {step['type']}")
    model = definition["model"]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
        fail(f"model {model['type']}")
    blanks = {letter for letter, byte in byte_letters().items() if chr(byte) in _BLANK}
    suffix = model.get("end_of_word_suffix") or ""
    for token in model["vocab"]:
        own = token.removesuffix(suffix)
        if len(own) > 1 and blanks & set(own):
            fail(f"token {token!r}")
    for token in definition["added_tokens"]:
        if set(token["content"]) & set(_BLANK) or token["lstrip"] or token["rstrip"] or token["single_word"]:
            fail(f"added token {token['content']!r}")


class Stretches(dict):
    """Token starts of stretches without white space, by stretch.

    Two generations are kept: a full one becomes the old one, from which what is met again comes back.
    White space itself has to be without tokens, else ``starts`` and ``count`` take texts as they are.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.apart = not tokenizer.encode(_BLANK, add_special_tokens=False).ids
        self.old: dict[str, bytes] = {}
        self.shapes: dict[bytes, bytes] = {}  # few: one object for each series of starts

    def __missing__(self, stretch: str) -> Sequence[int]:
        found = self.old.get(stretch)
        if found is None:
            starts = [a for a, _ in self.tokenizer.encode(stretch, add_special_tokens=False).offsets]
            if len(stretch) > LONGEST:
                return starts
            found = bytes(starts)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
            self.shapes.clear()
        self[stretch] = found = self.shapes.setdefault(found, found)
        return found

    def starts(self, text: str) -> list[int]:
        if not self.apart:
            return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        return [m.start() + a for m in _STRETCH.finditer(text) for a in self[m[0]]]

    def count(self, text: str) -> int:
        if not self.apart:
            return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])
        return sum([len(self[s]) for s in _STRETCH.findall(text)])


def starts_of(stretches: Stretches, text: str, at: int, to: int) -> list[int]:
    """Offsets in ``text`` at which the tokens of ``text[at:to]`` start."""
    return [at + a for a in stretches.starts(text[at:to])]


def splice(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """Last place in ``(low, high)`` where both encodings start a token behind white space."""
    own = set(right[bisect_left(right, low + 1):bisect_left(right, high)])
    for place in reversed(left[bisect_left(left, low + 1):bisect_left(left, high)]):
        if place in own and text[place - 1] in _BLANK:
            return place
    return None


def count_huge(stretches: Stretches, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, encoded in chunks of about ``chunk`` characters."""
    if len(text) <= chunk:  # one chunk has nothing to be spliced with, so its offsets are not asked for
        return stretches.count(text)
    at, end = 0, chunk
    starts = starts_of(stretches, text, at, end)
    total, settled = 0, 0  # tokens before ``settled`` are counted
    while end < len(text):
        wide = overlap
        while True:
            begin = max(settled, end - wide)
            to = min(len(text), begin + max(chunk, 2 * wide))
            following = starts_of(stretches, text, begin, to)
            place = splice(text, starts, following, begin, end)
            if place is not None:
                total += bisect_left(starts, place) - bisect_left(starts, settled)
                settled, starts, end = place, following, to
                break
            if begin == settled:  # no stable place since the last one: grow the chunk itself
                starts, end = starts_of(stretches, text, settled, to), to
                if to < len(text):
                    chunk *= 2
                break
            wide *= 2
    return total + len(starts) - bisect_left(starts, settled)


def _counter(shared, chunk: int, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        stretches = Stretches(_tokenizer(shared.value))
        for batch in batches:
            for part in parts(batch, "text", 1 << 22):
                size = np.diff(Texts(part.column("text")).offsets)
                counts = [count_huge(stretches, text or "", chunk, overlap) for text in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()),
                                       pa.array(counts, pa.int64())], schema=schema)
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = _definition(docs.sparkSession, path)
    check_stable(json.loads(shared.value))
    counted = arrow_map(rows, _counter(shared, chunk, overlap),
                        "doc_id LONG, n_bytes LONG, n_tokens LONG")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
