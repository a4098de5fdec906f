"""Is a nested export well-formed, and which line is the first that is not?

Works on JSON, XML and YAML documents whose strings, tags and keys end on the line they start on, as
in all exports of ``sinks``; a document may go over any number of part files and lines.

Expressions turn each line into a few tokens, without its payload. Two passes over the tokens follow.
The first sums up each split: how far it closes what earlier splits opened, what it leaves open, how it
ends. The sums compose to the stack and the last token before each split (``nested.stacks_before``).
The second pass checks each split from there. The fault of the first split that has one is exact, as
everything before it is sound; its line is counted over all splits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arborlake.functions.let import let
from arborlake.session import materialise
from arborlake.sources.nested import SPLIT, _splits_of, export_lines, stacks_before

_OPENS, _CLOSES = ("{", "[", "+"), ("}", "]", "-")
_PAIRS = {"}": "{", "]": "["}
_ESCAPE, _STRING, _VALUE = "\x01", "\x02", "\x03"
UNREADABLE = "!"


def json_tokens(line: Column) -> Column:
    """Brackets, commas, colons, ``s`` for a string and ``v`` for another scalar."""
    text = F.regexp_replace(line, r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})', _ESCAPE)
    text = F.regexp_replace(text, r'"[^"\\\t\r]*+"', _STRING)
    number = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
    apart = r"[\p{L}\p{N}_.+\-\x02]"
    text = F.regexp_replace(text, f"(?<!{apart})(?:{number}|true|false|null)(?!{apart})", _VALUE)
    text = F.regexp_replace(text, r"[ \t\r]++", "")

    def of(text: Column) -> Column:
        faulty = line.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | text.rlike(r"[^{}\[\],:\x02\x03]")
        tokens = F.split(F.translate(text, _STRING + _VALUE, "sv"), "")
        return F.when(faulty, F.array(F.lit(UNREADABLE))).when(
            text == "", F.array().cast("array<string>")).otherwise(F.filter(tokens, lambda t: t != ""))

    return let(text, of)


def xml_tokens(line: Column) -> Column:
    """``+name`` and ``-name`` for start and end tags, ``t`` for text between tags."""
    name = r"[\p{L}_:][\p{L}\p{N}_:.\-]*+"
    start = rf'^<({name})(?:[ \t]++{name}="[^"<]*+")*+[ \t]*+>$'
    whole = rf'^<({name})(?:[ \t]++{name}="[^"<]*+")*+[ \t]*+/>$'
    tags = F.regexp_extract_all(line, F.lit("(<[^<>]*+>)"), F.lit(1))
    texts = F.split(line, "<[^<>]*+>")

    def token(tag: Column) -> Column:
        return (
            F.when(tag.rlike(whole), F.lit("t"))
            .when(tag.rlike(start), F.concat(F.lit("+"), F.regexp_extract(tag, start, 1)))
            .when(tag.rlike(rf"^</{name}[ \t]*+>$"), F.concat(F.lit("-"), F.regexp_extract(tag, f"({name})", 1)))
            .otherwise(UNREADABLE))

    def text(part: Column) -> Column:
        return F.when(part.rlike(r"[^ \t\r]"), F.lit("t"))

    def of(texts: Column) -> Column:
        paired = F.zip_with(
            texts, tags, lambda part, tag: F.array(text(part), F.when(tag.isNotNull(), token(tag))))
        # an & that opens no reference
        faulty = line.rlike(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]++|#x[0-9a-fA-F]++);)") | F.exists(
            texts, lambda t: F.contains(t, F.lit("<"))) | line.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
        return F.when(faulty, F.array(F.lit(UNREADABLE))).otherwise(F.array_compact(F.flatten(paired)))

    return let(texts, of)


def yaml_tokens(line: Column) -> Column:
    """Kind of line and its indent: ``k`` a key alone, ``p`` a key and a scalar, ``i`` a list's item."""
    text = F.regexp_replace(line, r'\\(?:[0abtnvfreNLP_ "/\\]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})',
                            _ESCAPE)
    key = r'(?:"[^"\\]*+"|[\p{L}_][\p{L}\p{N}_\-]*+)'
    scalar = r'(?:"[^"\\]*+"|-?[0-9][0-9.eE+\-]*+|true|false|null|[\p{L}][\p{L}\p{N}_\-]*+)'
    indent = F.length(line) - F.length(F.ltrim(line))
    kind = let(F.rtrim(F.ltrim(text)), lambda body: (
        F.when(body.rlike(rf"^{key}:$"), "k").when(body.rlike(rf"^{key}: {scalar}$"), "p")
        .when(body.rlike(rf"^- {key}: {scalar}$"), "i")))
    return F.when(F.trim(line) == "", F.array().cast("array<string>")).otherwise(let(
        kind, lambda k: F.when(k.isNull(), F.array(F.lit(UNREADABLE))).otherwise(F.array(k, indent.cast("string")))))


def _json_after(token: str, before: str | None, top: str | None) -> str:
    """What may follow ``token`` that stands behind ``before`` inside the bracket ``top``."""
    if token == "{":
        return "key or }"
    if token == "[":
        return "value or ]"
    if token == ":":
        return "value"
    if token == ",":
        return "key" if top == "{" else "value"
    if token == "s" and (before == "{" or before == "," and top == "{"):
        return ":"
    return ", or end"


class _Json:
    def __init__(self, base, last, before):
        self.stack = list(base)
        self.before, self.last = before, last
        self.wants = _json_after(last, before, self.top()) if last else "value"

    def top(self):
        return self.stack[-1] if self.stack else None

    def line(self, tokens):
        for token in tokens:
            if token == UNREADABLE:
                return "unreadable text"
            if token in _PAIRS:
                if self.top() != _PAIRS[token]:
                    return f"{token} closes nothing" if not self.stack else f"{token} closes {self.top()}"
                if self.wants not in (", or end", f"key or {token}", f"value or {token}"):
                    return f"{token} instead of {self.wants}"
                self.stack.pop()
            elif not {
                "{": self.wants.startswith("value"), "[": self.wants.startswith("value"),
                "v": self.wants.startswith("value"), "s": self.wants.startswith(("value", "key")),
                ":": self.wants == ":", ",": self.wants == ", or end" and bool(self.stack),
            }[token]:
                return f"{token} instead of {self.wants}" if self.stack or not self.last else f"{token} after the end"
            if token in _OPENS:
                self.stack.append(token)
            self.wants = ", or end" if token in _PAIRS else _json_after(token, self.last, self.top())
            self.before, self.last = self.last, token
        return None


class _Xml:
    def __init__(self, base, last, before):
        self.stack, self.begun = list(base), last is not None

    def line(self, tokens):
        for token in tokens:
            if token == UNREADABLE:
                return "unreadable text"
            if token[0] == "-":
                if not self.stack or self.stack[-1] != token[1:]:
                    return f"</{token[1:]}> closes {'<' + self.stack[-1] + '>' if self.stack else 'nothing'}"
                self.stack.pop()
                continue
            if not self.stack and (self.begun or token == "t"):
                return "text outside the root" if token == "t" else "a second root"
            self.begun = True
            if token[0] == "+":
                self.stack.append(token[1:])
        return None


class _Yaml:
    """Lines one step deeper follow a key alone, others any level that is a multiple of the step."""

    def __init__(self, base, last, before, step: int = 2):
        self.kind, self.indent, self.step = (before, int(last), step) if last else (None, 0, step)

    def line(self, tokens):
        if not tokens:
            return None
        if tokens[0] == UNREADABLE:
            return "unreadable text"
        kind, indent = tokens[0], int(tokens[1])
        back = indent <= self.indent and indent % self.step == 0
        deeper = self.kind == "k" and indent == self.indent + self.step
        # an item's own keys stand two columns behind its dash
        item = kind == "p" and (self.kind == "i" and indent == self.indent + 2)
        again = self.kind == "p" and indent == self.indent and kind == "p"
        if not (back or deeper or item or again) or self.kind is None and indent:
            return f"indent {indent} after {self.indent}"
        self.kind, self.indent = kind, indent
        return None


_FORMATS = {"json": (json_tokens, _Json), "xml": (xml_tokens, _Xml), "yaml": (yaml_tokens, _Yaml)}
_SUMS = "file STRING, block LONG, pops INT, pushes ARRAY<STRING>, last STRING, before STRING"


def _label(token: str) -> str:
    return token[1:] if token[0] == "+" else token


def _sums(batches):
    """Of each split: pops, pushes and its last two tokens, faults left aside."""
    split, pops, stack, ends = None, 0, [], [None, None]

    def out():
        return pa.RecordBatch.from_pydict({
            "file": [split[0]], "block": [split[1]], "pops": pa.array([pops], pa.int32()),
            "pushes": pa.array([stack], pa.list_(pa.string())), "last": pa.array([ends[1]], pa.string()),
            "before": pa.array([ends[0]], pa.string())})

    for batch in batches:
        for here, at in _splits_of(batch):
            if here != split:
                if split is not None:
                    yield out()
                split, pops, stack, ends = here, 0, [], [None, None]
            for tokens in at.column("tokens").to_pylist():
                for token in tokens:
                    if token[0] in _OPENS:
                        stack.append(_label(token))
                    elif token[0] in _CLOSES:
                        if stack:
                            stack.pop()
                        else:
                            pops += 1
                    ends = [ends[1], token]
    if split is not None:
        yield out()


def _checked(checker):
    """Of each split: its lines, the number and text of its first fault."""
    def run(batches):
        split, check, lines, fault = None, None, 0, None

        def out():
            return pa.RecordBatch.from_pydict({
                "file": [split[0]], "block": [split[1]], "lines": [lines],
                "at": pa.array([fault and fault[0]], pa.int64()),
                "reason": pa.array([fault and fault[1]], pa.string())})

        for batch in batches:
            for here, at in _splits_of(batch):
                if here != split:
                    if split is not None:
                        yield out()
                    first = at.slice(0, 1).to_pylist()[0]
                    split, lines, fault = here, 0, None
                    check = checker(first["base"], first["last"], first["before"])
                for tokens in at.column("tokens").to_pylist():
                    if fault is None:
                        reason = check.line(tokens)
                        fault = reason and (lines, reason)
                    lines += 1
        if split is not None:
            yield out()
    return run


def _starts(sums: DataFrame) -> DataFrame:
    """The stack and the last two tokens before each split."""
    stacks = stacks_before(sums.select(*SPLIT, "pops", "pushes"))
    # one row a split; a split with one token only is completed by the one before it
    order = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    filled = sums.select(*SPLIT, "last", F.coalesce("before", F.when(
        F.col("last").isNotNull(), F.last("last", ignorenulls=True).over(order))).alias("before"))
    ends = F.last(F.when(F.col("last").isNotNull(), F.struct("last", "before")), ignorenulls=True).over(order)
    return stacks.join(filled.select(*SPLIT, ends.alias("ends")).select(*SPLIT, "ends.*"), list(SPLIT))


def validate_nested(spark: SparkSession, path: str, fmt: str, *, indent: int = 2) -> DataFrame:
    """One row: ``is_valid, lines, line, reason``; ``line`` counts from 0 over all part files.

    ``fmt`` is json, xml or yaml (whose nested levels are ``indent`` columns apart). A document that
    ends too early has its fault behind the last line.
    """
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}, choose one of {sorted(_FORMATS)}")
    tokens_of, checker = _FORMATS[fmt]
    if fmt == "yaml":
        def checker(base, last, before):
            return _Yaml(base, last, before, indent)
    tokens = materialise(
        export_lines(spark, path).select(*SPLIT, "place", tokens_of(F.col("value")).alias("tokens")), "tokens")
    ordered = tokens.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "place")
    sums = materialise(ordered.select(*SPLIT, "tokens").mapInArrow(_sums, _SUMS), "split-sums")
    starts = materialise(_starts(sums), "split-starts")
    checked = materialise(
        tokens.join(starts, list(SPLIT)).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "place")
        .select(*SPLIT, "tokens", "base", "last", "before")
        .mapInArrow(_checked(checker), "file STRING, block LONG, lines LONG, at LONG, reason STRING"), "checked")
    order = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    placed = checked.withColumn("line", F.col("at") + F.coalesce(F.sum("lines").over(order), F.lit(0)))
    lines, fault = placed.agg(
        F.sum("lines"), F.min(F.when(F.col("reason").isNotNull(), F.struct("line", "reason")))).first()
    left, last = sums.agg(F.sum(F.size("pushes") - F.col("pops")), F.max("last")).first()
    lines = lines or 0
    if fault is None and last is None:
        fault = (lines, "no document")
    elif fault is None and left:
        fault = (lines, f"{left} left open")
    line, reason = fault or (None, None)
    return spark.createDataFrame(
        [(fault is None, lines, line, reason)], "is_valid BOOLEAN, lines BIGINT, line BIGINT, reason STRING")
