"""The pipeline's decisions against plain versions, stage by stage, on the smallest tables."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from arborlake.llm import quality  # noqa: E402
from arborlake.session import folders, work_dir  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SF)
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    def rows(frame):
        return [tuple(r) for r in frame.select("doc_id", "text").collect()]

    def ids(frame):
        return sorted(r.doc_id for r in frame.select("doc_id").collect())

    def good(before):
        """Ids that a double loop over pairs of features does not reject, under the model of this stage."""
        model, bias = quality.train(docs_of["quality classifier"], spark.read.parquet(f"{SF}/labels.parquet"))
        lengths = {r.doc_id: r.n_chars for r in docs_of["quality classifier"].select("doc_id", "n_chars").collect()}
        return sorted(d for d, t in before if brute.margin(model, bias, t, lengths[d]) >= 0)

    docs_of = {}
    plain = {
        "quality classifier": good,
        "exact dedup": lambda before: sorted(r[0] for r in brute.exact(before) if r[3]),
        "MinHash near-dedup": lambda before: sorted(r[0] for r in brute.near(before) if r[3]),
        "benchmark decontamination": lambda before: sorted(
            {d for d, _ in before} - {r[0] for r in brute.contained(before, items)}),
        "BPE encoding and decoding": lambda before: sorted(d for d, _ in before),
    }
    for name, stage in corpus_pipeline.STAGES:
        docs_of[name] = docs
        after = stage(spark, docs, SF).cache()
        assert ids(after) == plain[name](rows(docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        docs = after
    assert docs.filter("round_trip").count() == docs.count()
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)
    kept = f"{work_dir(spark)}/arborlake/{spark.sparkContext.applicationId}"
    assert not [f for f in folders(spark, kept) if f.startswith(("scratch", "exact", "quality", "MinHash"))]


def _table(spark, rows):
    """Rows of documents with columns that clash with names used inside."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    return docs.withColumns({c: F.lit("clash") for c in (
        "n", "kept", "score", "row", "block", "node", "digest", "shard", "predicted")}).repartition(3)


def _kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def _words(start, n=60):
    return " ".join(f"w{start}x{i}" for i in range(n))


def test_rows_are_judged_by_their_own_text(spark):
    """Null, repeated and two-text identifiers: no clean row is lost and no copy stays."""
    a, b, c = _words(1), _words(2), _words(3)
    rows = [(0, a), (1, a), (1, b), (5, c), (5, c), (None, b.upper()), (None, _words(4)), (None, _words(4)), (7, None)]
    exact = _kept(corpus_pipeline.exact(spark, _table(spark, rows), SF))
    assert sorted((t or "").lower() for _, t in exact) == sorted(t.lower() for t in (a, b, c, _words(4), ""))
    assert (5, c) in exact and (None, _words(4)) in exact and (7, None) in exact

    close = a.replace("w1x59", "other")
    rows = [(0, a), (1, close), (1, b), (5, c), (5, c), (None, b + " end"), (None, None), (8, "two words")]
    near = _kept(corpus_pipeline.near(spark, _table(spark, rows), SF))
    assert (0, a) in near and (1, close) not in near and (5, c) in near and (8, "two words") in near
    assert len(near) == len(set(near)) == 5 and sum(t is not None and t.startswith("w2x") for _, t in near) == 1


def test_contaminated_rows_go_whatever_their_identifier(spark, tmp_path):
    item = _words(9, 30)
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id LONG, text STRING").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    held = f"{_words(1)} {item} {_words(2)}"
    rows = [(None, held), (None, _words(1)), (3, held), (3, _words(3)), (4, held), (5, _words(5)), (6, None)]
    found = _kept(corpus_pipeline.benchmark(spark, _table(spark, rows), str(tmp_path)))
    assert found == [(3, _words(3)), (5, _words(5)), (6, None), (None, _words(1))]


def test_odd_and_empty_tables_go_through_all_stages(spark):
    rows = [(None, None), (None, "a b"), (1, None), (2, _words(2)), (2, _words(2)), (4, "x"), (4, "y z")]
    for table in (_table(spark, rows), _table(spark, [])):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = after.cache()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.count() == docs.count() == out.filter("round_trip").count()
