"""Column functions against literal cases and Python's own rules."""

import datetime
import fnmatch
import pathlib
import random
import re
import warnings

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arborlake.functions import (
    classify, content, display, escape, jsontext, lists, paths, patterns, times,
)
from arborlake.operators import cache, filters, summary
from arborlake.options import ScanOptions


def column_of(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


NAMES = ["a.txt", ".env", "a.tar.gz", "a.", "prod.env", "..foo", "x", "", "A.PNG", "a b.C", "é.Ü"]


def test_suffix_follows_pathlib(spark):
    got = column_of(spark, NAMES, paths.suffix)
    assert got == [pathlib.PurePosixPath(n).suffix.lower() if n != "a." else "" for n in NAMES]


@pytest.mark.parametrize("glob", ["*.pyc", "test_*", "[!a]?.t*", "a[0-9]*", "[]]x", "[!]]", "a[",
                                  "*", "", "a?c", "%_x", "a\\b", "[a-]", "[z-a]x", "[!z-a]", "x[&&y]"])
def test_glob_equals_fnmatch(spark, glob):
    names = ["a.pyc", "test_x", "bx.txt", "a7", "]x", "a[", "", "abc", "%_x", "a\\b", "-", "zx", "q",
             "x&", "xy", "a\nb", "x[", "]", "ax.t"]
    got = column_of(spark, names, lambda c: patterns.matches_glob(c, glob))
    assert got == [fnmatch.fnmatchcase(n, glob) for n in names]


@settings(max_examples=25, deadline=None)
@given(st.text("ab.*?[]!-]", max_size=8))
def test_glob_regex_equals_fnmatch(glob):
    translated = patterns.glob_to_regex(glob).replace(r"\z", r"\Z").replace("(?s)", "")
    for name in ("a", "ab", "a.b", "-", "]", "b-a", "[", "", "!", "a]b"):
        assert bool(re.match("(?s)" + translated, name)) == fnmatch.fnmatchcase(name, glob)


REGEXES = [
    r"\d\.txt", r"\w+\.py", r"(?P<q>a+)-(?P=q)", r"x[[]y", r"a[&&]b", r"[]x]+y", r"[^\W\d]+-",
    r"\ba", r".*a\b", r"x{,2}y", r"a{z}", r"(?i)\u00c9", r".\.txt", r"a$", r"[\b]", r"(a)(-)\1", r"\101",
    r"\S+\Z", r"(?#note)a", r"(?:a|x)[\w&]y", r"(?a)\w+\.py", r"(?i:A)-", r"[a^]b", r"(?=x)x",
]
RULE_NAMES = ["3.txt", "\u0663.txt", "\u00e9.py", "e.py", "a-a", "aa-a", "x[y", "a&b", "]xy", "ab-", "a1-",
         "a.x", "aa", "ba a", "xxy", "y", "xxxy", "a{z}", "\r.txt", "\n.txt", "a\n", "a\r", "\x08", "A-",
         "x y", "xwy", "x\u00a0", "^b", "x&y", "\u00e9"]


@pytest.mark.parametrize("pattern", REGEXES)
def test_regex_rules_match_as_python_does(spark, pattern):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rule = re.compile(pattern)
    got = column_of(spark, RULE_NAMES, lambda c: patterns.matches_regex(c, pattern))
    assert got == [rule.match(name) is not None for name in RULE_NAMES]


@pytest.mark.parametrize("pattern", ["(a)?(?(1)b|c)", "(?x) a b", "(["])
def test_rules_without_an_equal_are_logged_and_match_nothing(spark, pattern, caplog):
    patterns.translated.cache_clear()
    patterns.java_regex.cache_clear()
    assert column_of(spark, ["ab", "c"], lambda c: patterns.matches_regex(c, pattern)) == [False, False]
    assert "ignoring regular expression" in caplog.text


def test_encoding_is_judged_on_the_whole_text(spark):
    texts = [b"a" * 600_000 + "\u00e9".encode("latin-1"), b"a" * 600_000 + "\u00e9".encode(), b"a" * 600_000]
    df = spark.createDataFrame([(t,) for t in texts], "raw binary")
    got = [r[0] for r in df.select(content.encoding_on_jvm(F.col("raw"), F.lit(False))).collect()]
    assert got == [None, "utf_8", "ascii"]


def test_regex_rules_are_anchored_at_the_start_and_bad_ones_ignored(spark):
    names = ["abc", "xabc", "ab"]
    assert column_of(spark, names, lambda c: patterns.matches_any(c, ["regex:ab|zz"])) == [
        True, False, True]
    assert column_of(spark, names, lambda c: patterns.matches_any(c, ["regex:([", "x*"])) == [
        False, True, False]
    assert column_of(spark, names, lambda c: patterns.matches_any(c, [])) == [False] * 3


def test_many_rules_equal_each_rule(spark):
    """5,000 rules: the result of fnmatch and re, and as many expressions as for 50."""
    rnd = random.Random(8)
    letters = "abAB1.*?[]-\n é"

    def text(n):
        return "".join(rnd.choice(letters) for _ in range(n))

    rules = ["*", ""] + [rnd.choice(["", "*"]) + text(rnd.randint(1, 4)) + rnd.choice(["", "*"]) for _ in range(4000)]
    rules += [f"regex:{e}" for e in (r"(a)b\1", r"(?P<x>b)(?P=x)", "([", "(?i)ab|zz", r"\d+$", "a|b.")]
    rules += [f"regex:{re.escape(text(3))}{rnd.choice(['', '$', '.*'])}" for _ in range(1000)]
    names = [text(rnd.randint(0, 6)) for _ in range(300)] + ["abab", "aba", "bb", "ABx", ""]

    def matches(name, rule):
        if not rule.startswith("regex:"):
            return fnmatch.fnmatchcase(name, rule)
        try:
            return re.match(rule[6:], name) is not None
        except re.error:
            return False

    for chosen in (rules[2:], rules, rules[2:30], rules[1:2] + rules[-900:]):
        got = column_of(spark, names, lambda c: patterns.matches_any(c, chosen))
        assert got == [any(matches(n, r) for r in chosen) for n in names]

    def expressions(chosen):
        plan = spark.range(1).select(F.lit("x").alias("n")).filter(
            patterns.matches_any(F.col("n"), chosen))._jdf.queryExecution().analyzed().toString()
        return len(re.findall(r" IN \(|RLIKE|INSET", plan))

    def made(n):
        return [f"name{i:05d}" for i in range(n)] + [f"*.x{i:05d}" for i in range(n)] + [f"y{i:05d}*" for i in range(n)]

    assert expressions(made(20)) == expressions(made(1700)) == 3


def test_paths(spark):
    assert column_of(spark, ["a/b/c", "c", "a/b"], paths.ancestors) == [["a", "a/b"], [], ["a"]]
    assert column_of(spark, ["/r/x", "/r/a\\b/x", "/s/x", "/r2/x"],
                     lambda c: paths.relative_parent(c, F.lit("/r"))) == ["", "a/b", "/s", "/r2"]
    assert column_of(spark, ["", ".", " p/ ", None],
                     lambda c: paths.compose_path(c, F.lit("f"))) == ["f", "f", "p/f", "f"]


def test_repository_urls(spark):
    urls = ["https://github.com/o/digit.git", "git@github.com:o/r", "http://github.com/o/r.x",
            "https://github.com/o", "ftp://github.com/o/r", ""]
    assert column_of(spark, urls, paths.is_repo_url) == [True, True, True, False, False, False]
    assert column_of(spark, urls, paths.repo_name) == ["digit", "r", "r.x", None, None, None]


def cascade(spark, files, contents, **options):
    rows = classify.with_is_binary(files(contents), **options).collect()
    return {r["path"]: r["is_binary"] for r in rows}


def test_classification_cases(spark, files):
    got = cascade(spark, files, {
        "example.py": b"\x00\x00", "image.png": bytes.fromhex("89504E470D0A1A0A"),
        "minified": b"!function(){for(var a=0;a<1000;a++)console.log('value',a)}();",
        "ambiguous.bin": b"\x00\x00\x01compressed-like-data", "empty": b"",
        "one_nul": b"a" * 5000 + b"\x00", "controls": b"\x01\x02" * 20 + b"a" * 100,
        "high": bytes(range(128, 256)) * 10, "doc": b"%PDF-1.4 " + b"\xc3\xa9" * 3,
    })
    assert got == {
        "example.py": False, "image.png": True, "minified": False, "ambiguous.bin": True,
        "empty": False, "one_nul": False, "controls": True, "high": True, "doc": True,
    }


def test_statistics_of_every_byte(spark):
    values = [bytes(range(256)), b"", b"a\x00"]
    got = column_of(spark, values, classify.sample_statistics, "binary")
    assert got[0][:3] == (99 / 256, 28 / 256, 1 / 256)
    assert got[1][:3] == (1.0, 0.0, 0.0)
    assert got[2][:3] == (0.5, 0.5, 0.5)


def test_charset_decides_open_cases(spark, files):
    text = ("Größe und Übermut tun überall äußerst gut, schöne Grüße aus München. " * 20)
    got = cascade(spark, files, {"letter": text.encode("latin-1")})
    assert got == {"letter": False}


def test_whole_cascade_equals_brute_force(spark):
    """All documents, each judged alone in plain Python."""
    normalizer = pytest.importorskip("charset_normalizer")
    from arborlake.plans import views
    rows = classify.with_is_binary(views.files(spark, "/root/testdata/sf0.001")).select(
        "filename", "content", "is_binary").collect()

    def judge(name, data):
        ext = pathlib.PurePosixPath(name).suffix.lower()
        if ext in classify.TEXT_SUFFIXES or ext in classify.BINARY_SUFFIXES:
            return ext in classify.BINARY_SUFFIXES
        head = bytes(data[:8192])
        good = sum(b in (9, 10, 12, 13) or 32 <= b < 127 for b in head) / len(head)
        if good >= 0.95:
            return False
        if good <= 0.60:
            return True
        best = normalizer.from_bytes(head).best()
        if best is not None and best.percent_coherence >= 60:
            return False
        return best is not None and best.percent_chaos > 40

    assert len(rows) == 200
    assert [r["is_binary"] for r in rows] == [judge(r["filename"], r["content"]) for r in rows]


def test_mime(spark):
    kinds = ["text/x-c", "application/json; charset=x", "inode/x-empty", "image/png",
             "application/octet-stream", "", None]
    assert column_of(spark, kinds, classify.by_mime) == [
        False, False, False, True, None, None, None]


def decoded(spark, raw, **options):
    df = spark.createDataFrame([(bytearray(raw),)], "raw BINARY")
    row = content.with_decoded(df, "raw", **options).first()
    return row["_encoding"], row["_decoded"]


@pytest.mark.parametrize("raw", ["636166E920FF0A", "E282", "EDA080", "C3A9", "41"])
def test_malformed_utf8_is_replaced_as_python_does(spark, raw):
    data = bytes.fromhex(raw)
    assert decoded(spark, data, hint="utf-8")[1] == data.decode("utf-8", errors="replace")


def test_encodings(spark):
    assert decoded(spark, b"plain") == ("ascii", "plain")
    assert decoded(spark, "é".encode()) == ("utf_8", "é")
    assert decoded(spark, "ab é".encode()[:-1], cut=F.lit(True)) == ("utf_8", "ab �")
    assert decoded(spark, "é".encode("latin-1"), hint="latin-1") == ("latin-1", "é")
    name, text = decoded(spark, ("Schöne Grüße an alle Bürger. " * 30).encode("cp1252"))
    assert text == "Schöne Grüße an alle Bürger. " * 30 and name != "utf_8"


def test_encoding_hints():
    assert content.encoding_hint(" Auto ") is None
    assert content.encoding_hint("latin1") == "iso8859-1"
    assert content.encoding_hint("no-such-codec") is None


def test_hash_has_sixteen_hex_digits(spark, monkeypatch, caplog):
    got = column_of(spark, [b"corpus", None, b""], content.content_hash, "binary")
    assert re.fullmatch("[0-9a-f]{16}", got[0]) and got[1] is None
    xxhash = pytest.importorskip("xxhash")
    assert got == [xxhash.xxh64(b"corpus").hexdigest(), None, xxhash.xxh64(b"").hexdigest()]
    monkeypatch.setattr(content, "xxhash", None)
    monkeypatch.setattr(content, "_fallback_told", False)
    assert re.fullmatch("[0-9a-f]{16}", content.digest64(b"corpus"))
    content.digest64(b"again")
    assert len([r for r in caplog.records if "blake2b" in r.message]) == 1
    assert content.algorithm_used("xxh64") == "blake2b"


def test_unknown_zones_fall_back(spark):
    got = column_of(spark, [0], lambda c: times.iso_micros(c, "Mars/Olympus"), "bigint")
    assert got == ["1970-01-01T00:00:00+00:00"]
    got = column_of(spark, [0], lambda c: times.iso_micros(c, F.when(c == 0, "Mars/Olympus")), "bigint")
    assert got == ["1970-01-01T00:00:00+00:00"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "Europe/Berlin", "America/Phoenix"])
def test_iso_times(spark, zone):
    from zoneinfo import ZoneInfo
    micros = [1_704_067_200_000_000, 1_720_000_000_123_456, -1, 1_711_846_800_000_001]
    got = column_of(spark, micros, lambda c: times.iso_micros(c, zone), "bigint")
    epoch = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    want = [(epoch + datetime.timedelta(microseconds=m)).astimezone(ZoneInfo(zone)).isoformat()
            for m in micros]
    assert got == want


def test_epoch_values(spark):
    got = column_of(spark, ["0", "1.5", "x", None, "1e20", "NaN"], times.format_epoch)
    assert got == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00", "", "", "", ""]


def test_display(spark):
    sizes = [0, 1023, 1024, 1280, 1536, 1048575, 1048576, 5 * 1024**3]
    def label(n):
        if n < 1024:
            return f"{n} B"
        return f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"
    assert column_of(spark, sizes, display.human_size, "bigint") == [label(n) for n in sizes]
    assert column_of(spark, [0.9, 59.9, 60.0, 3599.0, 3600.0, 7384.5], display.human_duration,
                     "double") == ["0s", "59s", "1m 0s", "59m 59s", "1h 0m", "2h 3m"]
    assert column_of(spark, ["1234567", "x", None, "-1234.9"], display.thousands) == [
        "1,234,567", "—", "—", "-1,234"]
    assert column_of(spark, [6.25, 2.45, None], display.percent, "double") == ["6.2%", "2.5%", "—"]


def test_styles_exist_for_every_type(spark):
    kinds = list(display.NODE_STYLES)
    for attribute in ("fillcolor", "color", "shape", "style"):
        got = column_of(spark, kinds, lambda c: display.node_style(c, attribute))
        assert got == [display.NODE_STYLES[k][attribute] for k in kinds]


def test_escaping(spark):
    assert column_of(spark, ["a b<c", "1x", "ü-._"], escape.xml_tag) == ["a_bc", "item_1x", "ü-._"]
    assert column_of(spark, ["a/b", "a_b"], escape.dot_id) == ["a_b", "a_b"]
    assert column_of(spark, ['a"b\\c\n', "x"], escape.dot_quoted) == ['"a\\"b\\\\c\\n"', '"x"']
    atoms = ["abc", "", "nil", "T", "a b", "-1", "x'y", None, "a\\b"]
    assert column_of(spark, atoms, escape.sexp_text) == [
        "abc", '""', '"nil"', '"T"', '"a b"', '"-1"', '"x\'y"', "nil", '"a\\\\b"']
    assert column_of(spark, [25.0, 0.5, None], escape.sexp_number, "double") == ["25", "0.5", "nil"]
    assert column_of(spark, ["0o100644"], lambda c: escape.sexp_text(c, "permissions")) == [
        "0o100644"]


def test_lists(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["a", "c"])], "a array<string>, b array<string>")
    row = df.select(lists.ordered_union(F.col("a"), F.col("b")),
                    lists.without(F.col("a"), F.col("b"))).first()
    assert row[0] == ["b", "a", "c"] and row[1] == ["b", "b"]


def test_strict_json(spark):
    texts = ['{"a": 1}', '{"a": 1} x', "{bad", "", "1,2", '"s"', "null", "[1]", None]
    got = column_of(spark, texts, lambda c: jsontext.strict_json(c).isNotNull())
    assert got == [True, False, False, False, False, True, True, True, False]


def test_progress(spark):
    df = spark.createDataFrame([(3, 4), (9, 4), (3, 0), (0, 0)], "c BIGINT, t BIGINT")
    got = [r[0] for r in df.select(summary.progress_message("Done.", F.col("c"), F.col("t"))).collect()]
    assert got == [
        "Done. Processed 3 of 4 files (75% complete)", "Done. Processed 9 of 4 files (100% complete)",
        "Done. Processed 3 files before stopping", "Done. No files were processed"]


def test_filter_preview_order_and_case(spark):
    options = ScanOptions(excluded_folders=("Build",), excluded_files=("README.md",),
                          exclude_patterns=("*.tmp", "regex:([", "regex:/x/"),
                          image_extensions=(".PNG",))
    got = column_of(spark, ["a/BUILD/f", "a/readme.MD", "b/f.tmp", "a/x/f", "a/f.Png", "a/f"],
                    lambda c: filters.preview_reason(c, options))
    assert got == [
        "Matches excluded folder 'build'.", "Matches excluded filename 'readme.md'.",
        "Matches glob pattern '*.tmp'.", "Matches regex pattern '/x/'.",
        "Tagged as image asset via extension '.png'.", filters.KEPT_REASON]


def test_rows_to_keep():
    assert cache.rows_to_keep(100, 900, 1000) == 100
    assert cache.rows_to_keep(100, 2000, 1000) == 37


def test_fallback_encoding_stays_on_the_jvm(spark):
    df = spark.createDataFrame([(1, b"caf\xe9"), (2, "é".encode()), (3, b"a"), (4, None)], "id INT, raw BINARY")
    for fallback, text in (("latin_1", "café"), ("utf-8", "caf�")):
        found = content.with_decoded(df, "raw", fallback=fallback)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        rows = [(r["_encoding"], r["_decoded"]) for r in found.orderBy("id").collect()]
        assert rows == [(fallback, text), ("utf_8", "é"), ("ascii", "a"), (None, None)]
    with pytest.raises(ValueError):
        content.with_decoded(df, "raw", fallback="koi8")


WIDE_TEXTS = ["plain text", "é ü ñ", "x", "two\nlines \U0001f600 end", "中文 with latin", "a" * 3000]


def _decoded(spark, raws, cut):
    df = spark.createDataFrame([(i, r, cut) for i, r in enumerate(raws)], "i INT, raw BINARY, cut BOOLEAN")
    out = content.with_decoded(df, "raw", cut=F.col("cut"), fallback="utf-8", wide=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    return [(r["_encoding"], r["_decoded"]) for r in out.orderBy("i").collect()]


def test_wide_encodings_are_found_on_the_jvm(spark):
    raws, want = [], []
    for order, mark in (("utf_16_le", b"\xff\xfe"), ("utf_16_be", b"\xfe\xff"), ("utf_32_le", b"\xff\xfe\0\0"),
                        ("utf_32_be", b"\0\0\xfe\xff")):
        for text in WIDE_TEXTS:
            raws.append(mark + text.encode(order))
            want.append((order[:6], text))
            if text[0] not in "中":
                raws.append(text.encode(order))
                want.append((order, text))
    assert _decoded(spark, raws, False) == want


def test_cut_wide_texts(spark):
    """A preview may end inside a unit or a pair; the rest is one replacement character."""
    text = "ab \U0001f600"
    for order, mark in (("utf_16_le", b"\xff\xfe"), ("utf_16_be", b"\xfe\xff"), ("utf_32_le", b"\xff\xfe\0\0")):
        raw = mark + text.encode(order)
        for lost in (1, 2, 3):
            (name, found), = _decoded(spark, [raw[:-lost]], True)
            assert (name, found) == (order[:6], "ab \ufffd")
            (name, found), = _decoded(spark, [raw[:-lost]], False)
            assert name == "utf-8"


def test_other_bytes_are_no_wide_texts(spark):
    raws = [b"", b"\0", b"a\0", b"plain", "é".encode(), b"\xff\xfea\0\x00\xd8b\0", b"\xff\xfe\0\xdc",
            b"\0\0\xfe\xff\0\x11\0\0", b"\xff\xfe\0\0\0\xd8\0\0", b"a\0\0\0b", b"bin\0\x01\x02ary\0 data", b"\xff\xfea"]
    names = [n for n, _ in _decoded(spark, raws, False)]
    assert names == ["ascii", "ascii", "utf_16_le", "ascii", "utf_8", "utf-8", "utf-8", "utf-8", "utf-8", "ascii",
                     "ascii", "utf-8"]


def test_wide_texts_are_judged_by_runs_not_unit_by_unit(spark):
    """No expression makes a list of units or hexadecimal digits of a text, and long texts are judged whole."""
    long = "plain \U0001f600 \u4e2d\u6587 \n\r\u0085" * 4_000
    df = spark.createDataFrame(
        [(i, text.encode(order)) for i, (text, order) in enumerate(
            (t, o) for o in ("utf_16_le", "utf_16_be", "utf_32_le", "utf_32_be") for t in (long, "a" * 100_000))],
        "i INT, raw BINARY")
    out = content.with_decoded(df, "raw", fallback="utf-8", wide=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "regexp_replace(hex(" not in plan
    rows = out.orderBy("i").collect()
    assert [r["_encoding"] for r in rows[::2]] == ["utf_16_le", "utf_16_be", "utf_32_le", "utf_32_be"]
    assert all(r["_decoded"] == long for r in rows[::2]) and all(r["_decoded"] == "a" * 100_000 for r in rows[1::2])
    broken = [long.encode("utf_16_le") + b"\x00\xd8", long.encode("utf_32_be") + b"\0\x11\0\0"]
    assert [name for name, _ in _decoded(spark, broken, False)] == ["utf-8", "utf-8"]


def test_bytes_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        rows = spark.range(3000).select(F.encode(F.col("id").cast("string"), "UTF-16LE").alias("raw"))
        found = content.with_decoded(rows, "raw", hint="utf-16-le")
        assert int(spark.conf.get(name)) <= 1000
        assert sorted(int(r["_decoded"]) for r in found.collect()) == list(range(3000))
    finally:
        spark.conf.set(name, before)
