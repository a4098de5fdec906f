"""Nested exports read back and checked across part files and splits."""

import glob
import json
import random
import xml.etree.ElementTree as ElementTree

import pytest
from pyspark.sql import functions as F

from arborlake import sinks
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse
from arborlake.schema import INFO_FIELDS
from arborlake.session import new_work_path
from arborlake.sources import nested, wellformed

CONTENTS = {
    "a/x.txt": b"one\ntwo\t\"q\" \\ <&> {[}],", "b/y.txt": "é  \x85 ü  ".encode(), "a/type": b"named type",
    "a/size": b"named size", "a/b/c/deep.md": b"deep", "a/b/c/d/e/f/g.py": b"}", "top.py": b"print()",
    'odd "name" & co/f\' <1>.txt': b"odd", "z/yes": b"yes: no", "z/{": b"{", "ctl.txt": b"bell \x07 end",
    "back\\slash/tab\tand é": b"x", **{f"m{i % 7}/n{i % 3}/f{i}.txt": b"t" * i for i in range(60)},
}
OPTIONS = ScanOptions(excluded_folders=(), exclude_patterns=(), excluded_files=(), detect_charset=False,
                      hash_algorithm="md5", fallback_encoding="utf-8")
FAILURES = [("p/1", 'bad "1"'), ("p/2", "bad\n2")]


@pytest.fixture
def run(files):
    return analyse(files(CONTENTS), OPTIONS)


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes: most documents go over many of them."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    yield
    spark.conf.set(name, before)


def _write(spark, run, fmt, parts, **options):
    path = new_work_path(spark, f"test-{fmt}")
    sinks.write(fmt, run.entries, path, summary=run.summary(), parts=parts,
                failures=spark.createDataFrame(FAILURES, "file STRING, error STRING"), **options)
    return path


@pytest.mark.parametrize("pretty, parts", [(True, 9), (False, 9), (True, 1)])
def test_round_trip(spark, run, small_splits, pretty, parts):
    path = _write(spark, run, "json", parts, pretty=pretty)
    assert len(glob.glob(f"{path}/part-*")) >= parts
    found = nested.read_nested_export(spark, path)
    columns = ["path", "parent", "filename", *INFO_FIELDS]
    want = {r["path"]: r for r in run.entries.select(columns).collect()}
    got = {r["path"]: r for r in found.entries.select(columns).collect()}
    assert got == want and len(got) == len(CONTENTS)
    assert sorted(tuple(r) for r in found.failures.collect()) == FAILURES
    summary = {r["name"]: json.loads(r["value"]) for r in found.summary.collect()}
    assert summary["total_files"] == len(CONTENTS) and summary["hash_algorithm"] == "md5"


def test_document_without_files(spark, files):
    run = analyse(files({"a.txt": b"x"}).filter("false"), OPTIONS)
    path = new_work_path(spark, "test-empty")
    sinks.write("json", run.entries, path)
    assert nested.read_nested_export(spark, path).entries.count() == 0
    assert wellformed.validate_nested(spark, path, "json").first()["is_valid"]


def test_stacks_compose(spark):
    """Summaries of splits in random order against one stack over all events."""
    rnd = random.Random(4)
    rows, stack, want = [], [], {}
    for number in range(60):
        split = (f"part-{number // 7:03d}", number % 7 * 100)
        want[split] = list(stack)
        for place in range(rnd.randrange(12)):
            if stack and rnd.random() < 0.5:
                n = rnd.randint(1, min(3, len(stack)))
                del stack[-n:]
                rows.append((*split, -n, None, len(rows)))
            else:
                stack.append(f"n{len(rows)}")
                rows.append((*split, 1, stack[-1], len(rows)))
        rows.append((*split, 0, None, len(rows)))
    frame = spark.createDataFrame(rows, "file STRING, block LONG, kind INT, name STRING, place INT")
    ordered = frame.repartition(3, "file").sortWithinPartitions("file", "block", "place")
    got = nested.stacks_before(nested.split_summaries(ordered)).collect()
    assert {(r["file"], r["block"]): r["base"] for r in got} == want


@pytest.mark.parametrize("fmt", ["json", "xml", "yaml"])
def test_own_exports_are_well_formed(spark, run, small_splits, fmt):
    path = _write(spark, run, fmt, 5)
    found = wellformed.validate_nested(spark, path, fmt).first()
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))
    assert tuple(found) == (True, text.count("\n"), None, None)


def _document(spark, lines, parts=4):
    path = new_work_path(spark, "test-lines")
    rows = spark.createDataFrame(list(enumerate(lines)), "i INT, value STRING")
    rows.repartitionByRange(parts, "i").sortWithinPartitions("i").select("value").write.text(path)
    return path


@pytest.mark.parametrize("fmt, lines, line, reason", [
    ("json", ["{", '"a": [', "1,", "2", "]", "}"], None, None),
    ("json", ["{", '"a": [', "1,", "2", "}", "}"], 4, "} closes ["),
    ("json", ["{", '"a": [', "1,", "]", "}"], 3, "] instead of value"),
    ("json", ["{", '"a"', ":", "1", ",", "2", "}"], 5, "v instead of key"),
    ("json", ["{", '"a": 1', '"b": 2', "}"], 2, "s instead of , or end"),
    ("json", ["{", '"a": {', '"b": 2', "}"], 4, "1 left open"),
    ("json", ["{", '"a": 1', "}", "", "}"], 4, "} closes nothing"),
    ("json", ["[", "1", "]", "2"], 3, "v after the end"),
    ("json", ["[", "01", "]"], 1, "unreadable text"), ("json", ["", " "], 2, "no document"),
    ("xml", ["<r>", "<a>", "t", "</a>", "</r>"], None, None),
    ("xml", ["<r>", "<a>", "</b>", "</r>"], 2, "</b> closes <a>"),
    ("xml", ["<r>", "</r>", "<r>", "</r>"], 2, "a second root"),
    ("xml", ["<r>", "a & b", "</r>"], 1, "unreadable text"), ("xml", ["<r>", "<a>"], 2, "2 left open"),
    ("yaml", ["a:", '  "b": 1', '  "c":', "    d: true", "e: null"], None, None),
    ("yaml", ["a:", "    b: 1"], 1, "indent 4 after 0"), ("yaml", ["a: 1", "  b: 1"], 1, "indent 2 after 0"),
    ("yaml", ["a:", '  "b: 1'], 1, "unreadable text"),
])
def test_first_fault(spark, fmt, lines, line, reason):
    found = wellformed.validate_nested(spark, _document(spark, lines), fmt).first()
    assert (found["line"], found["reason"]) == (line, reason)
    assert found["is_valid"] == (reason is None) and found["lines"] == len(lines)


def _parses_json(text):
    try:
        json.loads(text, parse_constant=lambda name: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    return True


def _parses_xml(text):
    try:
        ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return False
    return True


@pytest.mark.parametrize("fmt, parses", [("json", _parses_json), ("xml", _parses_xml)])
def test_same_verdict_as_a_parser(spark, run, fmt, parses):
    """Documents with one changed, lost or doubled character: as valid as a whole parser finds them."""
    path = _write(spark, run, fmt, 1)
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in glob.glob(f"{path}/part-*"))
    rnd = random.Random(9)
    variants = [text]
    for _ in range(400):
        at = rnd.randrange(len(text))
        if text[at] not in "\n\r":
            new = rnd.choice(["", text[at] * 2, rnd.choice('{}[],:"<>&x1/ ')])
            variants.append(text[:at] + new + text[at + 1:])
    rows = [(v, i, line) for v, text in enumerate(variants) for i, line in enumerate(text.split("\n")[:-1])]
    tokens_of, checker = wellformed._FORMATS[fmt]
    frame = spark.createDataFrame(rows, "variant INT, i INT, value STRING").select(
        "variant", "i", tokens_of(F.col("value")).alias("tokens"))
    checks = {}
    for row in sorted(frame.collect()):
        check, fault = checks.setdefault(row["variant"], [checker([], None, None), None])
        if fault is None:
            checks[row["variant"]][1] = check.line(row["tokens"])
    for number, variant in enumerate(variants):
        check, fault = checks[number]
        assert (fault is None and not check.stack) == parses(variant), (fault, _near(text, variant))


def _near(text, variant):
    at = next((i for i, (a, b) in enumerate(zip(text, variant)) if a != b), len(variant))
    return variant[max(0, at - 40):at + 40]


def test_a_line_is_searched_once_for_its_tokens(spark):
    """The steps that every line goes through stand once in the plan of each format."""
    lines = spark.createDataFrame([('{"a": 1}',)], "value STRING")
    for fmt, mark in (("json", "[ \\t\\r]++"), ("xml", "split("), ("yaml", "rtrim(")):
        tokens, _ = wellformed._FORMATS[fmt]
        plan = lines.select(tokens(F.col("value")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(mark) == 1, fmt
