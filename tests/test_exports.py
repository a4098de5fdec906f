"""Every sink is written, read back with an independent parser and compared with the tree."""

import csv
import glob
import json
import xml.etree.ElementTree as ElementTree

import pytest
from pyspark.sql import functions as F

from arborlake import sinks
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse
from arborlake.sinks import runs as run_sinks
from arborlake.sources import exports, records

CONTENTS = {
    "a/x.txt": b"one\ntwo\t\"q\" \\ <&>", "b/y.txt": "é  \x85 ü".encode(),
    "a/type": b"named type", "a/size": b"named size", "a/b/c/deep.md": b"deep",
    "top.py": b"print()", "a/pic.png": b"\x89PNG", 'odd "name" & co/f\' <1>.txt': b"odd",
    "z/yes": b"yes: no", "z/nil": b"nil", "ctl.txt": b"bell \x07 end",
}
OPTIONS = ScanOptions(excluded_folders=(), exclude_patterns=(), excluded_files=(),
                      detect_charset=False, hash_algorithm="md5")


@pytest.fixture
def run(files):
    return analyse(files(CONTENTS), OPTIONS)


def nested(rows):
    tree = {}
    for row in rows:
        here = tree
        for part in row["path"].split("/")[:-1]:
            here = here.setdefault(part, {})
        keep = ("type", "reason", "encoding", "content", "preview_bytes", "truncated", "size",
                "created", "modified", "permissions", "timezone", "exception_type",
                "exception_message")
        here[row["filename"]] = {k: row[k] for k in keep if row[k] is not None}
    return tree


def text_of(path):
    return "".join(open(p, encoding="utf-8", newline="").read()
                   for p in sorted(glob.glob(f"{path}/part-*")))


def failures(spark, rows=(("p/1", 'bad "1"'), ("p/2", "bad\n2"))):
    return spark.createDataFrame(list(rows), "file STRING, error STRING")


@pytest.mark.parametrize("pretty", [True, False])
def test_json_tree(spark, run, tmp_path, pretty):
    path = str(tmp_path / "out")
    sinks.write("json", run.entries, path, summary=run.summary(), failures=failures(spark),
                pretty=pretty)
    document = json.loads(text_of(path))
    assert document["structure"] == nested(run.entries.collect())
    assert document["summary"]["total_files"] == len(CONTENTS)
    assert document["summary"]["stopped_early"] is False
    assert document["summary"]["failed_files"] == [
        {"file": "p/1", "error": 'bad "1"'}, {"file": "p/2", "error": "bad\n2"}]


def test_json_tree_without_summary(spark, run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("json", run.entries, path)
    assert list(json.loads(text_of(path))) == ["structure"]


def test_json_array(spark, run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("json_array", run.entries, path, summary=run.summary())
    document = json.loads(text_of(path))
    assert [e["path"] for e in document["structure"]] == sorted(CONTENTS, key=lambda p: p.split("/"))
    assert document["summary"]["failed_files"] == []


@pytest.mark.parametrize("remove", [True, False])
def test_jsonl(run, tmp_path, remove):
    path = str(tmp_path / "out")
    sinks.write("jsonl", run.entries, path, summary=run.summary(), remove_empty_fields=remove)
    rows = {r["path"]: r for r in map(json.loads, text_of(path).strip("\n").split("\n"))}
    assert set(rows) == set(CONTENTS)
    assert rows["top.py"]["content"] == "print()" and len(rows["top.py"]["hash"]) == 32
    assert ("created" in rows["top.py"]) is not remove
    assert json.loads(text_of(path + ".summary"))["summary"]["included_files"] == len(CONTENTS)


def test_csv(run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("csv", run.entries.coalesce(1), path)
    (part,) = glob.glob(f"{path}/part-*")
    with open(part, encoding="utf-8", newline="") as handle:
        rows = list(csv.DictReader(handle))
    assert {r["Path"] for r in rows} == set(CONTENTS)
    assert list(rows[0]) == ["Path", "Type", "Size", "Created", "Modified", "Permissions", "Timezone"]
    assert {r["Timezone"] for r in rows} == {"UTC"}


@pytest.mark.parametrize("indent", [2, 4])
def test_yaml(spark, run, tmp_path, indent):
    yaml = pytest.importorskip("yaml")
    path = str(tmp_path / "out")
    sinks.write("yaml", run.entries, path, summary=run.summary(), failures=failures(spark),
                indent=indent)
    document = yaml.safe_load(text_of(path))
    assert document["structure"] == nested(run.entries.collect())
    assert document["summary"]["total_files"] == len(CONTENTS)
    assert [f["file"] for f in document["summary"]["failed_files"]] == ["p/1", "p/2"]


@pytest.mark.parametrize("pretty", [True, False])
def test_xml(spark, run, tmp_path, pretty):
    path = str(tmp_path / "out")
    sinks.write("xml", run.entries, path, summary=run.summary(), failures=failures(spark),
                pretty=pretty)
    root = ElementTree.fromstring(text_of(path).encode())

    def walk(node, at):
        for child in node:
            name = f"{at}{child.get('name')}"
            if child.tag == "directory":
                yield from walk(child, name + "/")
            elif child.tag == "file":
                yield name, {c.tag: c.text for c in child}

    found = dict(walk(root, ""))
    assert set(found) == set(CONTENTS)
    assert found["a/x.txt"]["content"] == CONTENTS["a/x.txt"].decode()
    assert found["ctl.txt"]["content"] == "bell � end"
    assert root.find("summary/total_files").text == str(len(CONTENTS))
    assert len(root.findall("summary/failed_file")) == 2


def test_flat_xml(spark, run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("xml_flat", run.entries.filter("filename <> 'ctl.txt'"), path)
    back = spark.read.format("xml").schema("path STRING, type STRING").option(
        "rowTag", "file").load(path)
    assert {r["path"] for r in back.collect()} == set(CONTENTS) - {"ctl.txt"}


def sexp(text):
    """Minimal reader: lists, quoted and bare atoms."""
    import re
    stack = [[]]
    for quoted, bare, bracket in re.findall(r'"((?:[^"\\]|\\.)*)"|([^\s()"]+)|([()])', text):
        if bracket == "(":
            stack.append([])
        elif bracket == ")":
            done = stack.pop()
            stack[-1].append(done)
        else:
            unescaped = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(
                m[1], m[1]), quoted)
            stack[-1].append(bare or unescaped)
    assert len(stack) == 1
    return stack[0]


def test_sexp(spark, run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("sexp", run.entries, path, summary=run.summary(), failures=failures(spark))
    (root,) = sexp(text_of(path))
    found = {}

    def walk(node, at):
        for child in node:
            if isinstance(child, list) and child[0] == "directory":
                walk(child[2:], f"{at}{child[1]}/")
            elif isinstance(child, list) and child[0] == "file":
                found[f"{at}{child[1]}"] = dict(zip(child[2::2], child[3::2]))

    walk(root[1:], "")
    assert set(found) == set(CONTENTS)
    assert found["a/x.txt"][":content"] == CONTENTS["a/x.txt"].decode()
    summary = next(c for c in root if c[0] == "summary")
    assert summary[summary.index(":total-files") + 1] == str(len(CONTENTS))
    assert len(next(c for c in summary if c[0] == "failed-files")) == 3
    plain = str(tmp_path / "plain")
    sinks.write("sexp", run.entries, plain, include_content=False)
    assert ":content" not in text_of(plain)


def test_dot(run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("dot", run.entries, path, summary=run.summary(), include_content=True,
                rankdir="TB", dir_color="red")
    text = text_of(path)
    assert text.startswith("digraph RepositoryStructure {") and text.rstrip().endswith("}")
    assert '"a" -> "a/b";' in text and '"a/b/c" -> "a/b/c/deep.md";' in text
    assert text.count('"a" -> "a/b";') == 1 and "rankdir=TB" in text and 'color="red"' in text
    assert "\\nContent: deep" in text and "total_files: 11" in text


def test_detailed_dot(run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("dot", run.entries, path, detailed=True)
    text = text_of(path)
    assert 'label="top.py\\nSize: 7 bytes\\nCreated: N/A\\nModified: 2024-01-01T00:00:00+00:00' in text
    assert 'label="pic.png\\nSize: N/A bytes' in text and "Content:" not in text


def test_styled_dot(run, tmp_path):
    path = str(tmp_path / "out")
    sinks.write("dot_styled", run.entries, path)
    text = text_of(path)
    assert text.startswith("digraph Repository {")
    assert '"a" [label="a", fillcolor="#FFF3E0"' in text and 'label="top.py\\n7 B"' in text


def test_parquet_and_graph(spark, run, tmp_path):
    sinks.write("parquet", run.entries, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == len(CONTENTS)
    sinks.write("graph", run.entries, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 5 - 3 + 9
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write("docx", run.entries, str(tmp_path / "n"))


def test_flatten_a_written_tree(spark, run, tmp_path):
    """Round trip of the nested export; directories holding ``type`` and ``size`` stay ones."""
    path = str(tmp_path / "out")
    sinks.write("json", run.entries.coalesce(1), path)
    document = spark.createDataFrame([(text_of(path),)], "value STRING").select(
        F.variant_get(F.parse_json("value"), "$.structure", "variant").alias("structure"))
    flat = exports.flatten_structure(document)
    got = {r["path"]: r["size"] for r in flat.select(
        "path", F.variant_get("info", "$.size", "bigint").alias("size")).collect()}
    assert got == {r["path"]: r["size"] for r in run.entries.collect()}


@pytest.mark.parametrize("lines, reason, count", [
    (['{"a": 1}', '[{"b": 2}]'], None, 2),
    (['{"a": 1}', "{}", "[]"], "record 1: no content", 3),
    (['[{"a":1}, 3]'], "record 0: a bare value in a list", 1),
    (['[{"a":1}, []]'], "record 0: no content in a list", 1),
    (['3'], "record 0: a bare value", 1),
    (["invalid export data"], "record 0: no JSON", 1),
    ([], "no records", 0),
])
def test_validation(spark, tmp_path, lines, reason, count):
    (tmp_path / "export").mkdir()
    (tmp_path / "export" / "part-0.json").write_text("".join(line + "\n" for line in lines))
    row = exports.validate_export(spark, str(tmp_path / "export")).first()
    assert tuple(row) == (reason is None, count, reason)


def test_validation_of_a_large_export(spark, tmp_path):
    size = 0
    (tmp_path / "export").mkdir()
    for part in range(4):
        lines = [json.dumps({"path": f"file_{part}_{i}.txt", "size": 1024 * i, "pad": "x" * 60})
                 for i in range(250)]
        if part == 2:
            lines[17] = "{}"
        body = "\n".join(lines) + "\n"
        size += len(body)
        (tmp_path / "export" / f"part-{part}.json").write_text(body)
    assert size > 100_000
    row = exports.validate_export(spark, str(tmp_path / "export")).first()
    assert tuple(row) == (False, 1000, "record 517: no content")


def test_record_rejection(spark):
    lines = ['{"parent":"a","filename":"f","info":{"type":"text"}}', "[1]", "{bad", "7",
             '{"filename":"g","info":3}', '{"summary":{"n":1}}', '{"summary":[1]}', '{"filename":"h"}']
    good, bad = records.split_records(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    assert {r["value"] for r in good.select("value").collect()} == {lines[0], lines[5], lines[7]}
    assert bad.count() == 5


def test_issues(spark, tmp_path):
    from arborlake.operators.repos import open_issues
    (tmp_path / "issues.json").write_text(json.dumps([
        {"number": 1, "title": "bug", "body": "b"},
        {"number": 2, "title": "pr", "body": "c", "pull_request": {"url": "u"}}]))
    rows = open_issues(records.read_issue_arrays(spark, str(tmp_path / "issues.json"))).collect()
    assert [r["caption"] for r in rows] == ["#1 - bug"]
    (tmp_path / "issues.jsonl").write_text("".join(
        json.dumps({"number": n, "title": "t", "body": "b"}) + "\n" for n in range(3)))
    assert records.read_issues(spark, str(tmp_path / "issues.jsonl")).count() == 3


def test_run_and_log_exports(spark, tmp_path):
    from arborlake.plans import views
    sf = "/root/testdata/sf0.001"
    runs = views.runs(spark, sf)
    run_sinks.write_runs(runs, str(tmp_path / "runs"))
    rows = [json.loads(x) for x in text_of(str(tmp_path / "runs")).splitlines()]
    assert len(rows) == runs.count() and list(rows[0]) == sorted(rows[0])
    run_sinks.write_reports(runs, str(tmp_path / "reports"), ("total_files",))
    assert text_of(str(tmp_path / "reports")).startswith("Display Name: Analysis 0\nRepository: ")
    logs = views.logs(spark, sf)
    run_sinks.write_log_text(logs, str(tmp_path / "logs"))
    assert len(text_of(str(tmp_path / "logs")).splitlines()) == logs.count()
