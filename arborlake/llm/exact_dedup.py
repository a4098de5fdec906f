"""Exact dedup: owners of equal texts, found in Patricia tries.

Each map task inserts its texts into compressed radix tries, one per first hash digit, so copies
inside a task leave it as one row. The distinct texts are shuffled by length and content hash, sorted,
and inserted again; a terminal node holds count, smallest and largest identifier of its text.

Memory stays bounded. A map task over its bound spills subtrees, the largest first, until half of the
bound is free: each spill is paid for by as many bytes inserted, whatever the number of subtrees. On the
reduce side the sort order says when everything in a trie is complete, and it is spilled then.

Defined results: a null text counts as empty; null identifiers are ignored for owners (a group of
null identifiers has a null owner, and its rows are kept); rows that repeat an identifier are the
same document and share its decision; extra columns are ignored; an empty table gives no rows.
Should two different texts of one length ever share a SHA-256, the task fails and names the digest
rather than merging them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborlake.llm.tables import arrow_map, lower_ascii

HELD = 48 << 20  # bytes of texts that a task keeps in tries
_OWNERS = "sha STRING, n_bytes LONG, text BINARY, smallest LONG, largest LONG, n LONG"
_FIELDS = pa.schema([("sha", pa.string()), ("n_bytes", pa.int64()), ("text", pa.binary()),
                     ("smallest", pa.int64()), ("largest", pa.int64()), ("n", pa.int64())])


class Trie:
    """Compressed radix trie over byte strings. A node is ``[label, children, terminal]``."""

    def __init__(self):
        self.root = [b"", {}, None]

    def find(self, key: bytes):
        """Terminal of ``key``, a list that the caller fills; made empty when it is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                node = child
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            node, at = upper, at + same
        if node[2] is None:
            node[2] = []
        return node[2]

    def items(self):
        """``(text, terminal)`` of all terminals, subtree by subtree."""
        return self._below([(self.root, b"")])

    def detach(self, first: int | None):
        """Take the texts that start with the byte ``first`` (None: the empty text) out of the trie."""
        if first is None:
            terminal, self.root[2] = self.root[2], None
            return iter([(b"", terminal)])
        return self._below([(self.root[1].pop(first), b"")])

    @staticmethod
    def _below(stack: list):
        while stack:
            node, above = stack.pop()
            text = above + node[0]
            if node[2] is not None:
                yield text, node[2]
            stack.extend((child, text) for child in node[1].values())


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _add(terminal: list, smallest, largest, n: int, sha: str) -> bool:
    """Count a text in; true when the terminal is new."""
    if not terminal:
        terminal += [smallest, largest, n, sha]
        return True
    for place, value, choose in ((0, smallest, min), (1, largest, max)):
        if value is not None:
            terminal[place] = value if terminal[place] is None else choose(terminal[place], value)
    terminal[2] += n
    return False


def _rows(items):
    columns: list[list] = [[], [], [], [], [], []]
    held, seen = 0, {}
    for text, (smallest, largest, n, sha) in items:
        if seen.setdefault((sha, len(text)), text) != text:
            raise ValueError(f"two different texts share the SHA-256 {sha}")
        for column, value in zip(columns, (sha, len(text), text, smallest, largest, n)):
            column.append(value)
        held += len(text)
        if held > 1 << 22:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)
            columns, held = [[], [], [], [], [], []], 0
    if columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _combine(held_bytes: int):
    def run(batches):
        tries: dict[str, Trie] = {}  # by the first hash digit
        sizes: dict[tuple, int] = {}  # bytes of the subtree of each trie and first byte
        held = 0
        for batch in batches:
            for sha, text, doc in zip(*(batch.column(k).to_pylist() for k in ("sha", "text", "doc"))):
                trie = tries.setdefault(sha[:1], Trie())
                if _add(trie.find(text), doc, doc, 1, sha):
                    place = (sha[:1], text[0] if text else None)
                    sizes[place] = sizes.get(place, 0) + len(text) + 200
                    held += len(text) + 200
                if held > held_bytes:
                    for digit, first in sorted(sizes, key=sizes.get, reverse=True):
                        held -= sizes.pop((digit, first))
                        yield from _rows(tries[digit].detach(first))
                        if held <= held_bytes // 2:
                            break
        for trie in tries.values():
            yield from _rows(trie.items())
    return run


def _merge(held_bytes: int):
    """Rows come sorted by (length, hash), so everything before the current hash is complete."""
    def run(batches):
        trie, held, current = Trie(), 0, None
        for batch in batches:
            for row in zip(*(batch.column(f.name).to_pylist() for f in _FIELDS)):
                sha, n_bytes, text, smallest, largest, n = row
                if current != (n_bytes, sha) and (current is None or current[0] != n_bytes
                                                  or held > held_bytes):
                    yield from _rows(trie.items())
                    trie, held = Trie(), 0
                current = (n_bytes, sha)
                if _add(trie.find(text), smallest, largest, n, sha):
                    held += len(text) + 200
        yield from _rows(trie.items())

    def slim(batches):
        for batch in run(batches):
            yield batch.drop_columns(["text"])
    return slim


def owners(docs: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """``sha, n_bytes, smallest, largest, n`` of each distinct normalised text."""
    text = lower_ascii(F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("t")).select(
        "doc", F.sha2("t", 256).alias("sha"), F.encode("t", "UTF-8").alias("text"))
    local = arrow_map(keyed, _combine(held_bytes), _OWNERS)
    dealt = local.repartition("n_bytes", "sha").sortWithinPartitions("n_bytes", "sha")
    return arrow_map(dealt, _merge(held_bytes),
                     "sha STRING, n_bytes LONG, smallest LONG, largest LONG, n LONG")


def exact_dedup(docs: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """One row per document: who owns its text, how many rows hold it, and whether it stays.

    The join is on the digest alone; a digest that very many rows share is a skewed partition of
    a plain sort-merge join, which adaptive execution splits.
    """
    shared = owners(docs, held_bytes).filter("n > 1").select(
        F.col("sha").alias("_sha"), "smallest", "largest", "n")
    rows = docs.select("doc_id", F.sha2(lower_ascii(F.col("text")), 256).alias("text_sha256"))
    found = rows.join(shared, rows.text_sha256 == shared["_sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    first = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", first.alias("smallest_id"))
