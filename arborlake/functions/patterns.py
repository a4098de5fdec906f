"""Name rules: exact names, globs and anchored regular expressions as column predicates."""

from __future__ import annotations

import functools
import logging
import re
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession, functions as F

log = logging.getLogger(__name__)

REGEX_PREFIX = "regex:"


def _set_regex(body: str, negated: bool) -> str:
    """Java character class for the inside of a glob ``[...]``."""
    members = []
    pos = 0
    while pos < len(body):
        if pos + 2 < len(body) and body[pos + 1] == "-":
            low, high = body[pos], body[pos + 2]
            if low <= high:
                members.append(f"{_in_class(low)}-{_in_class(high)}")
            pos += 3
        else:
            members.append(_in_class(body[pos]))
            pos += 1
    if not members:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(members)}]"


def _in_class(char: str) -> str:
    return "\\" + char if char in "\\[]^-&~|" else char


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex equal to ``fnmatch`` on a case-sensitive system."""
    out = []
    pos = 0
    while pos < len(glob):
        char = glob[pos]
        pos += 1
        if char == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            first = pos + (1 if glob[pos:pos + 1] == "!" else 0)
            end = glob.find("]", first + 1)
            if end < 0:
                out.append(r"\[")
            else:
                out.append(_set_regex(glob[first:end], negated=first > pos))
                pos = end + 1
        else:
            out.append(re.escape(char))
    return "(?s)^" + "".join(out) + r"\z"


def matches_glob(name: Column, glob: str) -> Column:
    """A glob without ``[`` becomes LIKE, so ``*.pyc`` ends as an EndsWith pushed to the scan."""
    if "[" in glob:
        return name.rlike(glob_to_regex(glob))
    escaped = re.sub(r"([\\%_])", r"\\\1", glob)
    return name.like(escaped.replace("*", "%").replace("?", "_"))


class Untranslatable(ValueError):
    """A valid Python expression that the JVM's engine has no equal for."""


# what the Python classes hold, as members of a Java class
_DIGIT, _WORD = r"\p{Nd}", r"\p{L}\p{N}_"
_MEMBERS = {"d": _DIGIT, "w": _WORD, "s": r"\t-\r\x1c-\x20\x85\p{Z}"}
_ASCII_MEMBERS = {"d": "0-9", "w": "a-zA-Z0-9_", "s": r"\t-\r\x20"}
_REPEAT = re.compile(r"\{(?!\})(\d*)(?:(,)(\d*))?\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?([:)])")


class _Translation:
    """One pass over a Python expression, written out for ``java.util.regex``."""

    def __init__(self, pattern: str):
        compiled = _compiled(pattern)
        self.pattern, self.pos = pattern, 0
        self.numbers = compiled.groupindex
        self.groups = compiled.groups
        self.members = _ASCII_MEMBERS if compiled.flags & re.ASCII else _MEMBERS
        if compiled.flags & re.VERBOSE:
            raise Untranslatable("verbose expressions")

    def text(self) -> str:
        out = []
        while self.pos < len(self.pattern):
            out.append(self._next())
        # (?d): only a line feed ends a line, for "." and "$" alike
        return "(?d)" + "".join(out)

    def _taken(self, count: int) -> str:
        found = self.pattern[self.pos:self.pos + count]
        self.pos += count
        return found

    def _next(self) -> str:
        rest = self.pattern[self.pos:]
        if rest[0] == "\\":
            return self._escape(inside=False)
        if rest[0] == "[":
            return self._set()
        if rest.startswith("(?"):
            return self._group(rest)
        if rest[0] == "{":
            repeat = _REPEAT.match(rest)
            if repeat is None:
                self.pos += 1
                return r"\{"
            self.pos += repeat.end()
            least, comma, most = repeat.groups()
            return "{" + (least or "0") + (comma or "") + (most or "") + "}"
        return self._taken(1)

    def _group(self, rest: str) -> str:
        if rest.startswith("(?P<"):
            self.pos += rest.index(">") + 1
            return "("
        if rest.startswith("(?P="):
            end = rest.index(")")
            self.pos += end + 1
            return rf"(?:\{self.numbers[rest[4:end]]})"
        if rest.startswith("(?#"):
            self.pos += rest.index(")") + 1
            return ""
        if rest.startswith("(?("):
            raise Untranslatable("conditional groups")
        flags = _FLAGS.match(rest)
        if flags is None:
            return self._taken(3)  # a look-around or an atomic group
        self.pos += flags.end()
        on, off, close = flags.groups()
        if "x" in on or ("a" in on or "u" in on) and close == ":":
            raise Untranslatable(f"flags {on}")
        on = "".join({"i": "iu", "m": "m", "s": "s"}.get(f, "") for f in on)
        return "(?" + on + (f"-{off}" if off else "") + close if on or off or close == ":" else ""

    def _set(self) -> str:
        self.pos += 1
        out = "["
        if self.pattern[self.pos] == "^":
            out += self._taken(1)
        first = True
        while first or self.pattern[self.pos] != "]":
            first = False
            char = self.pattern[self.pos]
            if char == "\\":
                out += self._escape(inside=True)
            else:
                out += "\\" + self._taken(1) if char in "[]&^" else self._taken(1)
        return out + self._taken(1)

    def _escape(self, inside: bool) -> str:
        letter = self.pattern[self.pos + 1]
        self.pos += 2
        if letter.lower() in self.members:
            members = self.members[letter.lower()]
            if letter.isupper():
                return f"[^{members}]"
            return members if inside else f"[{members}]"
        if letter == "b" and inside:
            return r"\x08"
        if letter in "bB":
            word = f"[{self.members['w']}]"
            here, there = ("!", "=") if letter == "b" else ("=", "!")
            return f"(?:(?<={word})(?{here}{word})|(?<!{word})(?{there}{word}))"
        if letter == "Z":
            return r"\z"
        if letter == "v":
            return r"\x0b"
        if letter == "U":
            return rf"\x{{{self._taken(8)}}}"
        if letter.isdigit():
            return self._number(letter, inside)
        return "\\" + letter

    def _number(self, digit: str, inside: bool) -> str:
        rest = self.pattern[self.pos:]
        octal = re.match("[0-7]{0,2}" if digit == "0" or inside else "[0-7]{2}", rest)
        if octal and digit in "01234567" and (digit == "0" or inside or octal.end() == 2):
            self.pos += octal.end()
            return rf"\x{{{int(digit + octal[0], 8):x}}}"
        if rest[:1].isdigit():
            digit += self._taken(1)
        return rf"(?:\{digit})"


def _compiled(pattern: str) -> re.Pattern:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        return re.compile(pattern)


@functools.lru_cache(maxsize=1024)
def translated(pattern: str) -> str | None:
    """The Python expression for the JVM, or None (logged) where it is invalid or has no equal."""
    try:
        return _Translation(pattern).text()
    except (re.error, Untranslatable) as problem:
        log.error("ignoring regular expression %r: %s", pattern, problem)
        return None


@functools.lru_cache(maxsize=1024)
def java_regex(pattern: str) -> str | None:
    """``translated``, tried on the JVM's engine so that no job fails on it later."""
    found = translated(pattern)
    spark = SparkSession.getActiveSession()
    if found is not None and spark is not None:
        try:
            engine = getattr(spark, "_jvm", None)
            if engine is not None:  # no query is needed where the JVM is at hand
                engine.java.util.regex.Pattern.compile(found)
            else:
                spark.sql("SELECT '' RLIKE :pattern", args={"pattern": found}).collect()
        except Exception as problem:  # the engine's own error class is not exposed
            log.error("ignoring regular expression %r: %s", pattern, str(problem).split("\n")[0])
            return None
    return found


def matches_regex(name: Column, pattern: str, *, anchored: bool = True) -> Column:
    """True where the expression matches, at the start of the text when ``anchored``."""
    found = java_regex(pattern)
    if found is None:
        return F.lit(False)
    return name.rlike(f"^(?:{found})" if anchored else found)


FEW = 16  # rules that are tested one by one, so that simple ones reach the scan as filters


def _simple(glob: str) -> tuple[str, str] | None:
    """How a glob compares with a fixed text, if it does: whole, at the end or at the start."""
    fixed = glob.strip("*")
    if any(c in fixed for c in "*?["):
        return None
    if glob == fixed:
        return "whole", fixed
    if not glob.endswith("*"):
        return "end", fixed
    return ("start", fixed) if not glob.startswith("*") else None


def _one_test(name: Column, patterns: list[str]) -> Column:
    """All rules at once: a set look-up for each length of fixed texts, one alternation for the rest.

    The number of expressions depends on the lengths that occur, not on the number of rules.
    Expressions that refer to their own groups stand alone, as an alternation would renumber them.
    """
    whole: set[str] = set()
    ends: dict[tuple[str, int], set[str]] = {}
    rest, alone = [], []
    for rule in patterns:
        if rule.startswith(REGEX_PREFIX):
            body = rule[len(REGEX_PREFIX):]
            found = java_regex(body)
            if found is None:
                continue
            if re.search(r"\\[1-9]|\(\?P", body):
                alone.append(f"^(?:{found})")
            else:
                rest.append(found)
            continue
        simple = _simple(rule)
        if simple is None:
            rest.append(glob_to_regex(rule))
        elif simple[0] == "whole":
            whole.add(simple[1])
        else:
            ends.setdefault((simple[0], len(simple[1])), set()).add(simple[1])
    tests = [name.isin(*sorted(whole))] if whole else []
    for (side, length), texts in sorted(ends.items()):
        part = F.right(name, F.lit(length)) if side == "end" else F.left(name, F.lit(length))
        tests.append(part.isin(*sorted(texts)))
    if rest:
        tests.append(name.rlike("^(?:" + "|".join(f"(?:{r})" for r in rest) + ")"))
    tests += [name.rlike(r) for r in alone]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def matches_any(name: Column, patterns: Iterable[str]) -> Column:
    """True when at least one glob or ``regex:`` rule matches the name."""
    patterns = list(patterns)
    if len(patterns) > FEW:
        return _one_test(name, patterns)
    tests = [
        matches_regex(name, p[len(REGEX_PREFIX):]) if p.startswith(REGEX_PREFIX)
        else matches_glob(name, p)
        for p in patterns
    ]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))
