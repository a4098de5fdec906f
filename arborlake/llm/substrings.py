"""Substring dedup by repeated-phrase automata.

1. Of every window of ``WINDOW`` words the phrase of ``PHRASE`` words with the smallest hash is its
   anchor. Equal windows have equal anchors, so only windows whose anchor occurs at two places can
   recur. Anchors are counted over the whole corpus, combined in each task before the shuffle.
2. Each block of documents looks up which of its anchors recur, and cuts out the passages around
   them. Equal passages of a block travel once, with the number of their places; the places stay
   with the block. A passage goes to the shard of its anchor; passages
   of an anchor with more than ``HOT`` places are dealt by whole windows instead, so that no shard
   gathers a phrase that very many documents share.
3. A shard confirms recurring windows word by word, compiles the confirmed stretches into
   Aho-Corasick automata of bounded size, and streams its passages through them.
4. The spans of a passage go to the blocks that hold it, which place them in their documents and
   remove the covered words. So no task sees more of a passage's places than those of one block.

Hashes only choose what to compare; the comparison is on words. Between shard and block a passage
is named by a 16-byte digest of its words.

Defined results: a null text has no words; texts shorter than a window lose nothing; rows that
repeat identifier and text are separate places, as any other copies; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborlake.llm.blocks import block_of, in_blocks, with_facts
from arborlake.llm.tables import arrow_map
from arborlake.llm.text import Texts, Words, parts, windows, within
from arborlake.session import materialise

WINDOW = 35
PHRASE = 12
HOT = 20_000
SHARD_WORDS = 300_000  # of the passages that one automaton serves

_PASSAGES = pa.schema([
    ("block", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("passage", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])
_CONFIRMED = pa.schema([("key", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_SPANS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` of each ``width`` consecutive values, in passes of doubling length."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = choose(out[:len(out) - step], out[step:])
        have += step
    return out


def anchors(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash of each window of all words, and which windows lie inside one text."""
    h = words.hashes()
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low = _sliding(windows(h, phrase), window - phrase + 1, np.minimum)
    return low, within(words.first, window, len(h))


def anchor_places(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of each phrase that is the anchor of some window."""
    low, inside = anchors(words, window, phrase)
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = windows(words.hashes(), phrase)
    reach = window - phrase + 1
    best = np.zeros(len(h) + reach - 1, np.uint64)  # windows in front of the text come first
    best[reach - 1:reach - 1 + len(low)] = np.where(inside, low, 0)
    at = np.flatnonzero(_sliding(best, reach, np.maximum)[:len(h)] == h)
    return h[at], at


def _count(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                found, _ = anchor_places(Texts(part.column("text")).words(), window, phrase)
                anchor, n = np.unique(found, return_counts=True)
                yield pa.record_batch({"anchor": anchor.view(np.int64), "n": n.astype(np.int64)})
    return run


def _ask(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                words = Texts(part.column("text")).words()
                found, at = anchor_places(words, window, phrase)
                block = part.column("block").to_numpy(zero_copy_only=False)[words.owner()[at]]
                order = np.lexsort((found, block))
                found, block = found[order], block[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (block[1:] != block[:-1])
                yield pa.record_batch({"anchor": found[new].view(np.int64),
                                       "block": pa.array(block[new], pa.int32())})
    return run


def _key(passage: bytes) -> bytes:
    return hashlib.blake2b(passage, digest_size=16).digest()


def _cut_out(window: int, phrase: int):
    def run(texts: pa.Table, facts: pa.Table) -> pa.Table:
        known = facts.column("anchor").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, hot = known[order], facts.column("hot").to_numpy()[order]
        found: dict[tuple, tuple[list, list, list]] = {}
        for batch in texts.to_batches() if len(known) else ():
            for part in parts(batch):
                t = Texts(part.column("text"))
                words = t.words()
                low, inside = anchors(words, window, phrase)
                if not len(low):
                    continue
                place = np.minimum(np.searchsorted(known, low), len(known) - 1)
                at = np.flatnonzero(inside & (known[place] == low))
                if not len(at):
                    continue
                is_hot = hot[place[at]]
                whole = windows(words.hashes(), window)
                opens = np.ones(len(at), bool)
                opens[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]]) | is_hot[1:]
                head = np.flatnonzero(opens)
                tail = np.append(head[1:], len(at)) - 1
                shard = np.where(is_hot[head], whole[at[head]], low[at[head]]).view(np.int64).tolist()
                owner = words.owner()[at[head]]
                doc_ids, rows = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
                raw = t.data.tobytes()
                begins = words.starts[at[head]].tolist()
                ends = words.ends[at[tail] + window - 1].tolist()
                starts = (at[head] - words.first[owner]).tolist()
                for k, b, e, o, s in zip(shard, begins, ends, owner.tolist(), starts):
                    lists = found.setdefault((k, b" ".join(raw[b:e].split())), ([], [], []))
                    for held, value in zip(lists, (doc_ids[o], rows[o], s)):
                        held.append(value)
        block = texts.column("block")[0].as_py() if found else None
        columns = [[block] * len(found), [k for k, _ in found], [_key(p) for _, p in found],
                   [p for _, p in found], *([lists[i] for lists in found.values()] for i in range(3))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PASSAGES)], schema=_PASSAGES)
    return run


def recurring_spans(passages: list[list[int]], times: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Word spans of each passage that recurring windows cover; ``times``: its places."""
    import ahocorasick

    counts: dict[bytes, int] = defaultdict(int)
    raws = [np.array(p, np.uint32).tobytes() for p in passages]
    for raw, n in zip(raws, times):
        for at in range(0, len(raw) - 4 * window + 1, 4):
            counts[raw[at:at + 4 * window]] += n
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    any_phrase = False
    for raw, passage in zip(raws, passages):
        begin = None
        last = len(passage) - window
        for at in range(last + 2):
            if at <= last and counts[raw[4 * at:4 * (at + window)]] > 1:
                begin = at if begin is None else begin
            elif begin is not None:
                phrase = tuple(passage[begin:at - 1 + window])
                automaton.add_word(phrase, len(phrase))
                any_phrase, begin = True, None
    if not any_phrase:
        return [[] for _ in passages]
    automaton.make_automaton()
    out = []
    for passage in passages:
        spans: list[tuple[int, int]] = []
        hits = [(end + 1 - length, end + 1) for end, length in automaton.iter(tuple(passage))]
        for begin, end in sorted(hits):
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((begin, end))
        out.append(spans)
    return out


def _locate(window: int, shard_words: int):
    """Confirmed spans of each distinct passage; rows of a passage only add to its number of places."""
    def spans_of(group: dict[bytes, int]):
        numbers: dict[bytes, int] = {}
        passages = [[numbers.setdefault(w, len(numbers)) for w in p.split(b" ")] for p in group]
        found = [(_key(p), spans) for p, spans in zip(
            group, recurring_spans(passages, list(group.values()), window)) if spans]
        columns = [[k for k, _ in found], *([[s[i] for s in spans] for _, spans in found] for i in range(2))]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _CONFIRMED)], schema=_CONFIRMED)

    def run(batches):
        group: dict[bytes, int] = {}
        held, last = 0, None
        for batch in batches:
            for shard, passage, n in zip(*(batch.column(k).to_pylist() for k in ("shard", "passage", "n"))):
                if shard != last and held > shard_words:
                    yield spans_of(group)
                    group, held = {}, 0
                last = shard
                if passage not in group:
                    group[passage] = 0
                    held += passage.count(b" ") + 1
                group[passage] += n
        if group:
            yield spans_of(group)
    return run


def _place(passages: pa.Table, facts: pa.Table) -> pa.Table:
    """Spans of a block's documents: each place of a passage with each of the passage's spans."""
    known = {k: i for i, k in enumerate(facts.column("key").to_pylist())}
    fact = np.array([known.get(k, -1) for k in passages.column("key").to_pylist()], np.int64)
    passages, fact = passages.filter(pa.array(fact >= 0, pa.bool_())), fact[fact >= 0]
    if not len(fact):
        return _SPANS.empty_table()
    doc_ids, rows, starts = (pa.concat_arrays(passages.column(k).chunks) for k in ("doc_ids", "rows", "starts"))
    begins, ends = (pa.concat_arrays(facts.column(k).chunks) for k in ("begins", "ends"))
    fact = np.repeat(fact, starts.value_lengths().to_numpy())  # of each place
    times = begins.value_lengths().to_numpy()
    first = (np.cumsum(times) - times)[fact]
    times = times[fact]
    place = np.repeat(np.arange(len(fact)), times)
    span = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + first[place]
    start = starts.flatten().to_numpy()[place]
    return pa.Table.from_arrays(
        [doc_ids.flatten().take(pa.array(place)), rows.flatten().take(pa.array(place)),
         *(pa.array(start + x.flatten().to_numpy()[span], pa.int32()) for x in (begins, ends))], schema=_SPANS)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("kept_text", pa.string())])


def _remove(texts: pa.Table, facts: pa.Table) -> pa.Table:
    spans: dict[tuple, list] = defaultdict(list)
    for doc, row, begin, end in zip(*(facts.column(f.name).to_pylist() for f in _SPANS)):
        spans[doc, row].append((begin, end))
    columns: list[list] = [[], [], [], []]
    for doc, row, text in zip(*(texts.column(k).to_pylist() for k in ("doc_id", "row", "text"))):
        words = text.encode().split()
        kept, at = [], 0
        for begin, end in sorted(spans.get((doc, row), ())):
            kept.extend(words[at:begin])
            at = max(at, end)
        kept.extend(words[at:])
        for column, value in zip(columns, (doc, len(words), len(words) - len(kept), b" ".join(kept).decode())):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT)], schema=_KEPT)


def spans(blocks: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT,
          shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, row, begin, end``: word spans that recurring windows cover."""
    counted = arrow_map(blocks.select("text"), _count(window, phrase), "anchor LONG, n LONG")
    recurring = materialise(counted.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    asked = arrow_map(blocks.select("text", "block"), _ask(window, phrase), "anchor LONG, block INT")
    facts = asked.join(recurring.select("anchor", (F.col("n") > hot).alias("hot")), "anchor").select(
        "block", "anchor", "hot").distinct()
    passages = materialise(with_facts(blocks, facts, _cut_out(window, phrase), (
        "block INT, shard LONG, key BINARY, passage BINARY, doc_ids ARRAY<LONG>, rows ARRAY<LONG>, "
        "starts ARRAY<INT>")), "passages")
    dealt = passages.select("shard", "passage", F.size("starts").cast("long").alias("n")).repartition(
        "shard").sortWithinPartitions("shard")
    confirmed = arrow_map(dealt, _locate(window, shard_words), "key BINARY, begins ARRAY<INT>, ends ARRAY<INT>")
    wanted = passages.select(*[F.col(c).alias(c) for c in ("block", "key")]).join(confirmed, "key")
    return with_facts(passages.drop("shard", "passage"), wanted, _place,
                      "doc_id LONG, row LONG, begin INT, end INT")


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT,
                    shard_words: int = SHARD_WORDS, **blocks_of) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document."""
    blocks, many = in_blocks(docs, **blocks_of)
    found = materialise(spans(blocks, window, phrase, hot, shard_words), "repeated-spans")
    placed = found.withColumn("block", block_of(many))
    return with_facts(blocks, placed, _remove, "doc_id LONG, n_words LONG, n_removed LONG, kept_text STRING")
