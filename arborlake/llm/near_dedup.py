"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes the set of its distinct five-word shingles, reduced to ``BANDS`` band keys and a
   signature of ``CHECKS`` independent one-byte minima. Shingles are counted as words; hashes of words
   only choose minima.
2. Texts of equal word sequences, by a digest of the sequence, form one class, so thousands of copies
   are one node from here on.
3. Classes that share a band key are candidates. A bucket is not expanded into all its pairs: its
   members are compared with the one that meets most others, verified links are contracted to components,
   and members of buckets that still span several components are compared across components, in
   blocks, under longer signatures and the bound on sizes; only likely pairs leave such a task.
4. Signatures are compared in batches. After each batch the posterior of the similarity, from a
   uniform prior, bounds the chance that the pair is a link; below ``MISS`` it is pruned.
5. Survivors are verified on their full sets of shingles, compared as words.

With four rows a band, a pair of similarity 0.75 shares none of the bands with chance
(1 - 0.75**4) ** 36, about 1e-6.

Defined results: a null text, or one without words, has no shingles and no links; a text of fewer
than five words is one shingle; a row without an identifier is linked with nothing, has no
component and is kept; rows that repeat an identifier are one document, linked through any of its
texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborlake.llm.components import components
from arborlake.llm.tables import arrow_map
from arborlake.llm.text import Texts, Words, paired, parts, windows
from arborlake.session import materialise

WIDTH = 5
SHARE = 0.75
ROWS = 4  # of a band
BANDS = 36
CHECKS = 128  # one-byte minima for verification
WIDER = 768  # further ones, for members of buckets that span components
BLOCK = 1024  # members of a bucket that one task compares with as many others
BATCH = 32
PART = 1 << 20  # bytes of text that a task looks at together
MISS = 1e-7

_random = np.random.default_rng(5)
_FLIP = _random.integers(0, 2**32, BANDS * ROWS + CHECKS + WIDER, dtype=np.uint32)
_SPIN = _random.integers(0, 2**31, BANDS * ROWS + CHECKS + WIDER, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _random.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _numbers(words: Words) -> dict[int, np.ndarray]:
    """By width, a number for each run of so many words; equal for equal runs of words only."""
    one = words.numbers()
    two = paired(one[:-1], one[1:])
    four = paired(two[:-2], two[2:])
    return {1: one, 2: two, 3: paired(two[:-1], one[2:]) if (words.counts() == 3).any() else two[:0],
            4: four, 5: paired(four[:-1], one[4:])}


def shingle_sets(texts: Texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: numbers of its distinct shingles, sorted, and a hash of each.

    Numbers stand for words and are compared within one call only; the whole sequence of a text of
    fewer than ``WIDTH`` words is negative, so that it differs from all shingles. Hashes may collide.
    """
    words = texts.words()
    exact, h = _numbers(words), words.hashes()
    hashed = {w: windows(h, w) for w in range(1, WIDTH + 1)}
    sets, hashes = [], []
    for at, n in zip(words.first.tolist(), words.counts().tolist()):
        if n == 0:
            sets.append(exact[1][:0])
            hashes.append(h[:0])
        elif n < WIDTH:
            sets.append(-1 - (exact[n][at:at + 1] * WIDTH + n))
            hashes.append(hashed[n][at:at + 1])
        else:
            own, places = np.unique(exact[WIDTH][at:at + n - WIDTH + 1], return_index=True)
            sets.append(own)
            hashes.append(hashed[WIDTH][at + places])
    return sets, hashes


def sequence_digests(texts: Texts) -> list[bytes]:
    """A digest of the word sequence of each text: equal for texts that differ in blanks only."""
    words = texts.words()
    found = words.strings().to_pylist()
    first = words.first.tolist()
    return [hashlib.blake2b(" ".join(found[a:b]).encode(), digest_size=24).digest()
            for a, b in zip(first, first[1:])]


def minima(shingles: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Minima of the hash functions ``begin`` to ``end``."""
    x = shingles.astype(np.uint32)
    flip, spin = _FLIP[begin:end], _SPIN[begin:end]
    low = np.full(end - begin, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, ((x[at:at + 512, None] ^ flip) * spin).min(axis=0), out=low)
    return low


def one_byte(low: np.ndarray) -> bytes:
    return (low >> np.uint32(8)).astype(np.uint8).tobytes()


def _sketch(batches):
    for batch in batches:
        for part in parts(batch, size=PART):
            found: dict[str, list] = {k: [] for k in ("n", "digest", "bands", "signature")}
            texts = Texts(part.column("text"), lower=True)
            found["digest"] = sequence_digests(texts)
            for s in shingle_sets(texts)[1]:
                m = minima(s, 0, BANDS * ROWS + CHECKS)
                rows = m[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                keys = (rows * _FOLD).sum(axis=1) ^ (rows[:, 0] << np.uint64(32))
                found["n"].append(len(s))
                found["bands"].append(keys.view(np.int64).tolist())
                found["signature"].append(one_byte(m[BANDS * ROWS:]))
            yield pa.record_batch({
                "doc_id": part.column("doc_id").cast(pa.int64()), "n": pa.array(found["n"], pa.int64()),
                "digest": pa.array(found["digest"], pa.binary()),
                "bands": pa.array(found["bands"], pa.list_(pa.int64())),
                "signature": pa.array(found["signature"], pa.binary())})


def fewest_matches(n: int, share: float, miss: float) -> int:
    """Fewest matches among ``n`` with which a similarity of ``share`` is not yet ruled out.

    From a uniform prior, P(similarity >= t | m of n match) is the binomial sum over j <= m of
    C(n + 1, j) t**j (1 - t)**(n + 1 - j). A one-byte minimum also matches by chance.
    """
    t = share + (1 - share) / 256
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _prune(limits: list[tuple[int, int]]):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CHECKS)
                    for k in ("sig_a", "sig_b"))
            alive = np.arange(len(a))
            matches = np.zeros(len(a), np.int64)
            at = 0
            for to, fewest in limits:
                matches[alive] += (a[alive, at:to] == b[alive, at:to]).sum(axis=1)
                alive = alive[matches[alive] >= fewest]
                at = to
            yield batch.select(["a", "b"]).take(pa.array(alive))
    return run


def _widen(batches):
    begin = BANDS * ROWS + CHECKS
    for batch in batches:
        for part in parts(batch, size=PART):
            texts = Texts(part.column("text"), lower=True)
            yield pa.record_batch({
                "digest": pa.array(sequence_digests(texts), pa.binary()),
                "wider": pa.array([one_byte(minima(s, begin, begin + WIDER)) for s in shingle_sets(texts)[1]],
                                  pa.binary())})


def _across(share: float):
    """Likely pairs of different components in a bucket, or in two blocks of a large one.

    A pair comes out of the first band that it shares only.
    """
    stops = [*range(BATCH, CHECKS + 1, BATCH), CHECKS + WIDER // 4, CHECKS + WIDER]
    limits = [(n, fewest_matches(n, share, MISS)) for n in stops]
    names = ("bucket", "one", "two", "block", "band", "node", "component", "n", "bands", "signature")

    def compared(group: list[tuple]):
        block, node, component, n = (np.array([g[k] for g in group]) for k in (3, 5, 6, 7))
        bands = np.array([g[8] for g in group])
        signature = np.frombuffer(b"".join(g[9] for g in group), np.uint8).reshape(len(group), -1)
        one, two, band = group[0][1], group[0][2], group[0][4]
        right = np.flatnonzero(block == two)
        for i in np.flatnonzero(block == one).tolist():
            other = right[right > i] if one == two else right
            other = other[(component[other] != component[i]) & (n[other] >= n[i] * share)
                          & (n[other] * share <= n[i])]
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band]
            at, matches = 0, np.zeros(len(other), np.int64)
            for to, fewest in limits:
                matches += (signature[other, at:to] == signature[i, at:to]).sum(axis=1)
                alive = matches >= fewest
                other, matches, at = other[alive], matches[alive], to
                if not len(other):
                    break
            for j in other.tolist():
                yield min(node[i], node[j]), max(node[i], node[j])

    def run(batches):
        group: list[tuple] = []
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in names)):
                if group and row[:3] != group[0][:3]:
                    found += compared(group)
                    group = []
                group.append(row)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if group:
            found += compared(group)
        yield _pairs(found)
    return run


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([int(x) for x, _ in found], pa.int64()),
                            "b": pa.array([int(y) for _, y in found], pa.int64())})


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text_a", PART):
                keep, n = [], len(part)
                both = pa.concat_arrays([part.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")])
                sets = shingle_sets(Texts(both, lower=True))[0]
                for x, y in zip(sets[:n], sets[n:]):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _pruned(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("signature").alias(f"sig_{name}"))

    limits = [(n, fewest_matches(n, share, MISS)) for n in range(BATCH, CHECKS + 1, BATCH)]
    return arrow_map(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b"),
                     _prune(limits), "a LONG, b LONG")


def _links(likely: DataFrame, texts: DataFrame, share: float, label: str) -> DataFrame:
    """The pairs that are links by their full sets."""
    def text(name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    likely = materialise(likely, f"{label}-likely")
    full = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return materialise(arrow_map(full, _verify(round(share * 100)), "a LONG, b LONG"), f"{label}-links")


def _further(crowded: DataFrame, joined: DataFrame, nodes: DataFrame, texts: DataFrame,
             share: float, block_size: int = BLOCK) -> DataFrame:
    """Likely pairs across the components that a bucket still spans.

    Its members are dealt in blocks; a task compares two blocks, so a bucket of any size is split.
    An identifier with several texts is compared under the signature of each.
    """
    placed = crowded.select("bucket", "band", "node").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_size")
    ).filter("_low <> _high").select("bucket", F.ceil(F.col("_size") / block_size).cast("int").alias("_blocks"))
    rest = materialise(placed.join(mixed, "bucket"), "mixed-buckets")
    members = rest.select("node").distinct()
    wider = arrow_map(texts.select(F.col("doc_id").alias("node"), "text").join(members, "node", "left_semi"),
                      _widen, "digest BINARY, wider BINARY").groupBy("digest").agg(F.any_value("wider").alias("wider"))
    known = nodes.join(wider, "digest").select(
        "node", "n", "bands", F.concat("signature", "wider").alias("signature"))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = rest.join(known, "node").withColumn("block", block).withColumn(
        "_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "bucket", F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("two"),
        "block", "band", "node", "component", "n", "bands", "signature")
    keys = ("bucket", "one", "two")
    return arrow_map(dealt.repartition(*keys).sortWithinPartitions(*keys), _across(share), "a LONG, b LONG")


def near_dedup(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = materialise(arrow_map(
        rows, _sketch, "doc_id LONG, n LONG, digest BINARY, bands ARRAY<LONG>, signature BINARY"),
        "sketches")
    # one node for each sequence of words: rows of one that everybody shares are combined before the shuffle
    nodes = materialise(
        sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("node"),
            *[F.any_value(c).alias(c) for c in ("n", "bands", "signature")]), "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("_band", "_key")).select(
        "node", F.col("_band").alias("band"), F.xxhash64("_band", "_key").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialise(members.join(buckets, "bucket"), "buckets")
    # the member that meets most others is likely the text that the others derive from
    crowd = met.groupBy("node").agg(F.sum("size").alias("crowd"))
    ranked = met.select("bucket", "node").join(crowd, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("crowd", -F.col("node")))["col2"].alias("_pivot"))
    crowded = materialise(
        met.join(pivots, "bucket").select("bucket", "band", "node", (-F.col("_pivot")).alias("pivot")),
        "crowded-buckets")
    star = materialise(
        crowded.filter("node <> pivot").select(
            F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(),
        "star-pairs")
    # the texts that any pair may need, shuffled once; a merge join at every size
    suspects = materialise(rows.join(crowded.select(F.col("node").alias("doc_id")).distinct().hint("merge"),
                                     "doc_id", "left_semi"), "suspects")
    links = _links(_pruned(star, nodes, share), suspects, share, "star")
    joined = components(links)
    more = _links(_further(crowded, joined, nodes, suspects, share), suspects, share, "further")
    final = components(links.union(more))
    classes = nodes.select("digest", "node").join(final, "node", "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "node").alias("_component"))
    own = sketched.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    found = own.join(classes, (own["digest"] == classes["_digest"]) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))
