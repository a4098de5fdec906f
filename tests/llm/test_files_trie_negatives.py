"""Token files, the conversation trie and hard negatives against plain versions and odd inputs."""

from __future__ import annotations

import glob
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("arborlake.llm")

from pyspark.sql import functions as F  # noqa: E402

from arborlake.llm import hard_negatives as hn, prefix_trie as pt, token_files as tf  # noqa: E402
from arborlake.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id LONG, text STRING, part INT, tokens STRING, at LONG"
TURNS = "conv_id LONG, turn LONG, role STRING, text STRING, depth INT, pos INT, k1 STRING"
VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, key INT, extent STRING, bundle INT"


def _ids(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _write(spark, rows, path, **options):
    docs = spark.createDataFrame([(i, t, 7, "clash", 1) for i, t in rows], DOCS).repartition(3)
    tf.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), path, 2, **options)


def test_token_files(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "néed", "it's", "x1", "\n", "<|endoftext|>", "中文"])
                      for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, "twice"), (9, "twice"), (None, "none"), (12, None)]
    rows.append((1200, "long " * 200_000))
    path = str(tmp_path / "files")
    _write(spark, rows, path, row_group_bytes=4096, page_rows=16)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    ids = _ids([t or "" for _, t in order])
    starts = np.cumsum([0] + [len(x) for x in ids])
    got = sorted(tf.token_checksums(spark, path).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == [
        (d, starts[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        for i, ((d, _), x) in enumerate(zip(order, ids))]
    stored = {(r.doc_id, r.start): r.tokens for r in tf.read_token_files(spark, path).collect()}
    assert stored == {(d, starts[i]): x for i, ((d, _), x) in enumerate(zip(order, ids))}


def test_fragments_are_encoded_as_the_library_does():
    """Any mixture of blanks, contractions, special strings and letters, cut and joined in batches."""
    import pyarrow as pa
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    merged = tf.plain_merges(tf.json.loads(definition), tf._tokenizer(definition))
    assert len(merged) == 50_000
    rnd = random.Random(11)
    pieces = ["a", "e", "Z", "q", "'", "'s", "'ll", "re", " ", "  ", "\n", "\t", "1", "23", ".", "!", "<|endoftext|>",
              "<|", "é", "中", "_", "-", "Σ", "\x1c", "\x00", " the", " ing", "tion", "er"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 80))) for _ in range(6000)]
    want = [x[:-1] for x in _ids(texts)]
    for known in (merged, None):
        encode = tf._Encoder(definition, known)
        got, begin = [], 0
        for at in range(0, len(texts), 500):
            ids, ends = encode(pa.array(texts[at:at + 500]))
            got += [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
        assert got == want


def test_other_encoders_are_left_to_their_library():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = tf.json.loads(file.read())
    short = {**definition, "model": {**definition["model"], "merges": definition["model"]["merges"][:-1]}}
    for other in ({**definition, "normalizer": {"type": "NFC"}}, short):
        assert tf.plain_merges(other, tf._tokenizer(tf.json.dumps(definition))) is None


def test_token_file_layout(spark, tmp_path):
    path = str(tmp_path / "files")
    _write(spark, [(i, f"text number {i} " * (i % 50)) for i in range(6000)], path,
           row_group_bytes=40_000, page_rows=64)
    groups = 0
    for file in glob.glob(f"{path}/tokens/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c)
                       for c in range(meta.num_columns)}
            assert all(c.has_offset_index for c in columns.values())
            assert columns["doc_id"].has_column_index
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(columns["tokens.list.element"].encodings)
            groups += 1
    files = tf.token_parts(spark, path).collect()
    assert groups > len(files)
    assert sorted((f.first_id, f.last_id) for f in files) == [(f.first_id, f.last_id) for f in sorted(
        files, key=lambda f: f.part)]
    plan = tf.token_index(spark, path).filter("doc_id BETWEEN 100 AND 120")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(doc_id,100)" in text
    assert "ReadSchema: struct<part:int,doc_id:bigint,at:bigint,n_tokens:bigint>" in text
    assert plan.count() == 21


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "files")
    _write(spark, [], path)
    assert tf.token_checksums(spark, path).count() == 0


def _trie(rows, rebuild=True):
    """Plain version: (depth, conv) -> facts."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        group = int(math.fmod(c, 100))
        made[c] = (own.get(c - group, [])[:h] if h else []) + t[h:]
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _got(spark, rows, make=None):
    frame = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], TURNS).repartition(4)
    turns = pt.ordered_turns(frame)
    nodes = pt.with_ends_hash(pt.prefix_trie((make or pt.rebuilt)(turns)))
    return sorted(tuple(r) for r in nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256").collect())


def test_prefix_trie(spark):
    rnd = random.Random(5)
    rows = []
    for c in [*range(-3, 40), *range(100, 130), 205, 300, 301, 10**12]:
        for turn in range(rnd.randint(1, 7)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "éé", "", "long text"])))
    rows += [(3, None, None, None), (3, None, "user", "x"), (3, 0, "user", "x"), (None, 0, "user", "y"),
             (7, 0, "user", "same"), (7, 0, "user", "same"), (8, 99, None, "z")]
    assert _got(spark, rows) == _trie(rows)


def test_prefix_trie_of_copies(spark):
    """Long copies merge at their end, prefixes that end inside others and a long shared one."""
    shared = [(t, "user", f"turn {t}") for t in range(40)]
    rows = [(c, *t) for c in range(5) for t in shared]
    rows += [(c, *t) for c in (10, 11) for t in shared[:12]] + [(12, 0, "user", "other")]
    rows += [(c, t, "user", f"own {c} {t}") for c in (20, 21) for t in range(30)]
    rows += [(30, *t) for t in [*shared[:20], (20, "user", "branch")]]
    assert _got(spark, rows, pt.whole) == _trie(rows, rebuild=False)


def test_single_and_no_conversation(spark):
    rows = [(5, t, "user", "x") for t in range(3)]
    assert _got(spark, rows, pt.whole) == _trie(rows, rebuild=False)
    assert _got(spark, []) == []
    assert _got(spark, [(None, 1, "user", "x")]) == []


def _negatives(rows):
    usable = []
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(
                x is None or not math.isfinite(x) or abs(x * 256) >= hn.LIMIT for x in vector):
            continue
        usable.append((i, label, [math.floor(float(np.float32(x)) * 256) for x in vector]))
    out = []
    for i, label, v in usable:
        if i % 10:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in usable if len(w) == len(v)),
                        key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:5]:
            close = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, j, rank + 1, k, p, s) for rank, (s, k, _) in enumerate(close[:10])]
    return sorted(out)


def _mined(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], VECTORS).repartition(3)
    found = hn.hard_negatives(hn.quantised(frame), F.col("vec_id") % 10 == 0)
    return sorted(tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(5, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rnd.normal(size=6) * 0.3], int(i % 3))
            for i in range(3000)]
    rows += [(4000 + i, rows[i % 7][1], int(i % 2)) for i in range(30)]  # ties
    rows += [(10, rows[10][1], 1), (None, rows[1][1], 1), (5001, None, 1), (5010, rows[2][1], None),
             (5020, [1.0, None] * 3, 1), (5030, [float("nan")] * 6, 1), (5040, [float("inf")] * 6, 1),
             (5050, [1e30] * 6, 1), (5060, [0.5, 0.25], 1), (5061, [0.5, 0.25], 1), (5062, [0.25, 0.25], 2),
             (5070, [], 1), (5071, [], 1), (5072, [], 2), (5080, [0.0] * 6, 0), (5090, [-9.0] * 6, 2)]
    assert _mined(spark, rows) == _negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert _mined(spark, [(10, [1.0], 1)]) == []


def test_hilbert_curve_is_continuous():
    """Neighbours on the curve differ by one step in one dimension."""
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hn.hilbert_keys(cells, 3)
    assert len(set(keys)) == 512
    path = cells[sorted(range(512), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_skip_blocks(spark):
    """Clustered vectors: most blocks are never asked for."""
    rnd = np.random.default_rng(2)
    centres = np.eye(40) * 3
    rows = [(i, [float(x) for x in centres[i // 200] + rnd.normal(size=40) * 0.05], i // 200 % 2)
            for i in range(8000)]
    frame = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], VECTORS)
    keyed = hn._with_keys(hn.quantised(frame))
    blocks = hn._packed(keyed, ["dims", "label", "key"], hn._blocks, hn.BLOCKS, "blocks")
    chunks = hn._packed(keyed.filter("vec_id = 100"), ["dims", "key"], hn._chunks, hn.CHUNKS, "chunks")
    index = hn.Index(blocks, blocks.count())
    chunks = chunks.withColumn("bundle", F.lit(0))
    seen = hn._meet(index, chunks, 1, hn._first_blocks(True), hn.SEEN)
    assert seen.count() == hn.SEEDS
    first = seen.groupBy("extent", "bundle", "chunk").agg(F.collect_list("code").alias("codes"))
    last = hn._read(index, chunks, first, True, 5).filter("rank = 5")
    closer = hn._set_windows(chunks, last, hn._raised)
    wanted = hn._meet(index, closer, 1, hn._needed_blocks(True), hn.WANTED)
    assert wanted.select(F.explode("codes")).count() < index.n_blocks / 3
