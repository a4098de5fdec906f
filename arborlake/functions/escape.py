"""Escaping for the text exports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

# fixed values: order of the named S-expression properties, and the always quoted ones
SEXP_PROPERTY_ORDER = (
    "type", "size", "encoding", "permissions", "created", "modified", "file_hash", "content",
)
SEXP_QUOTED = ("type", "encoding", "content", "error")

_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
_NOT_TAG = r"[^\p{L}\p{N}_.\-]"


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return functools.reduce(
        lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])), pairs, text
    )


def xml_tag(name: Column) -> Column:
    """Usable element name: blanks to ``_``, other characters dropped, digit start prefixed."""
    cleaned = F.regexp_replace(F.regexp_replace(name, _SPACE, "_"), _NOT_TAG, "")
    return F.when(cleaned.rlike(r"^\p{Nd}"), F.concat(F.lit("item_"), cleaned)).otherwise(cleaned)


def xml_text(text: Column) -> Column:
    return _replace_all(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def xml_document_text(text: Column) -> Column:
    """``xml_text`` for a document: what XML cannot hold becomes U+FFFD, CR a reference."""
    legal = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "\ufffd")
    return F.replace(xml_text(legal), F.lit("\r"), F.lit("&#13;"))


def xml_attribute(text: Column) -> Column:
    quoted = F.replace(xml_document_text(text), F.lit('"'), F.lit("&quot;"))
    return _replace_all(quoted, [("\n", "&#10;"), ("\t", "&#9;")])


def dot_id(identifier: Column) -> Column:
    """Everything but letters and digits to ``_`` (not unique: ``a/b`` and ``a_b`` meet)."""
    return F.regexp_replace(identifier, r"[^\p{L}\p{N}]", "_")


def dot_label(text: Column) -> Column:
    return _replace_all(text, [('"', '\\"'), ("\n", "\\n")])


def dot_quoted(text: Column) -> Column:
    """A quoted DOT string that keeps distinct texts distinct."""
    body = _replace_all(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")])
    return F.concat(F.lit('"'), body, F.lit('"'))


def sexp_escape(text: Column) -> Column:
    return _replace_all(
        text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    )


def sexp_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), sexp_escape(text), F.lit('"'))


def sexp_text(text: Column, name: str | None = None) -> Column:
    """Text atom: bare where it cannot be mistaken, quoted otherwise; null is ``nil``."""
    quoted = sexp_quoted(text)
    needs = (
        text.rlike(r"""[ ()"\\';{}\[\]|\n\t]""")
        | F.lower(text).isin("nil", "t")
        | text.rlike(r"^[0-9+-.]")
    )
    if name in SEXP_QUOTED:
        needs = F.lit(True)
    atom = F.when(text.isNull(), F.lit("nil")).when(text == "", F.lit('""'))
    if name == "permissions":
        atom = atom.when(F.startswith(text, F.lit("0o")), text)
    return atom.when(needs, quoted).otherwise(text)


def sexp_number(value: Column) -> Column:
    """Number atom; a whole double is written without its fraction."""
    as_double = value.cast("double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < F.lit(1e15))
    return (
        F.when(value.isNull(), F.lit("nil"))
        .when(whole, F.floor(as_double).cast("string"))
        .otherwise(value.cast("string"))
    )


def sexp_bool(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(False)), F.lit("t")).otherwise(F.lit("nil"))


def sexp_atom(value: Column, kind: str, name: str | None = None) -> Column:
    """Atom for a column whose type is known when the plan is made."""
    if kind == "boolean":
        return sexp_bool(value)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return sexp_number(value)
    return sexp_text(value.cast("string"), name)


def sexp_properties(columns: dict[str, tuple[Column, str]], indent: Column) -> Column:
    """``:name atom`` lines: the named order first, the rest by name; nulls are left out."""
    def place(name: str) -> tuple[int, str]:
        known = name in SEXP_PROPERTY_ORDER
        return (SEXP_PROPERTY_ORDER.index(name) if known else len(SEXP_PROPERTY_ORDER), name)

    lines = [
        F.when(
            value.isNotNull(),
            F.concat(indent, F.lit(f":{name.replace('_', '-')} "), sexp_atom(value, kind, name)),
        )
        for name, (value, kind) in sorted(columns.items(), key=lambda item: place(item[0]))
    ]
    return F.concat_ws("\n", *lines)


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


# fixed values: characters a YAML reader refuses or folds inside a quoted scalar
_YAML_UNSAFE = [*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF]


def yaml_string(text: Column) -> Column:
    """The text as a double-quoted YAML scalar: JSON quoting plus YAML's own unsafe characters."""
    quoted = json_string(text)
    escaped = _replace_all(quoted, [(chr(code), f"\\u{code:04x}") for code in _YAML_UNSAFE])
    return F.when(
        quoted.rlike(r"[\x7f-\x{9f}\x{2028}\x{2029}\x{feff}\x{fffe}\x{ffff}]"), escaped
    ).otherwise(quoted)


def canonical_json(columns: dict[str, Column], *, pretty: bool = False) -> Column:
    """JSON text with its keys in sorted order. VARIANT values keep theirs sorted by nature, so
    nested documents come out in order too."""
    return F.to_json(
        F.struct(*[columns[name].alias(name) for name in sorted(columns)]),
        {"ignoreNullFields": "false", "pretty": str(pretty).lower()},
    )


def clip(text: Column, characters: int) -> Column:
    """First characters for a label."""
    return F.substring(text, 1, characters)
