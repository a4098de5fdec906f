"""Bounded previews, encodings and content hashes."""

from __future__ import annotations

import codecs
import hashlib
import logging

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from arborlake.functions.let import let
from arborlake.options import ENCODING_SAMPLE_BYTES
from arborlake.session import small_arrow_batches

try:
    import xxhash
except ImportError:  # pragma: no cover - depends on the image
    xxhash = None

log = logging.getLogger(__name__)
# fixed values: hints that ask for detection
_UTF8_NAMES = ("utf-8", "utf_8", "ascii")
_FALLBACKS = {"utf-8": "UTF-8", "latin_1": "ISO-8859-1"}
_AUTO_HINTS = ("", "auto", "automatic", "auto-detect", "autodetect", "detect")


def preview(content: Column, limit: int) -> Column:
    return F.substring(content, 1, limit)


def preview_bytes(size: Column, limit: int) -> Column:
    return F.least(size, F.lit(limit).cast("long"))


def truncated(size: Column, limit: int) -> Column:
    return size > limit


def base64_text(raw: Column) -> Column:
    """Base64 on one line (the built-in breaks lines every 76 characters)."""
    return F.replace(F.base64(raw), F.lit("\r\n"))


def encoding_hint(hint: str | None) -> str | None:
    """Usable codec name, or None when the encoding is to be detected."""
    if hint is None or hint.strip().lower() in _AUTO_HINTS:
        return None
    try:
        return codecs.lookup(hint.strip()).name
    except LookupError:
        log.warning("unknown encoding %r, detecting instead", hint)
        return None


def _is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def _utf8_but_for_its_end(raw: Column) -> Column:
    """A preview may end inside a character: judge it without up to three last bytes."""
    size = F.octet_length(raw)
    verdict = F.lit(False)
    for drop in (1, 2, 3):
        verdict = verdict | ((size > drop) & _is_utf8(F.substring(raw, F.lit(1), size - drop)))
    return verdict


_GUESS = T.StructType([
    T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType()),
])


@F.pandas_udf(_GUESS)
def _guess_and_decode(raw: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """Codec (the given one, or the best guess over a sample) and decoded text.

    Rows decided on the JVM arrive as null and come back as null.
    """
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        from_bytes = None

    def guess(data):
        best = from_bytes(data[:ENCODING_SAMPLE_BYTES]).best() if from_bytes else None
        return best.encoding if best is not None and best.encoding else "utf-8"

    rows = []
    for data, name in zip(raw, codec):
        if data is None:
            rows.append((None, None))
        else:
            name = name or guess(bytes(data))
            rows.append((name, bytes(data).decode(name, errors="replace")))
    return pd.DataFrame(rows, columns=["encoding", "text"], dtype="object")


def encoding_on_jvm(raw: Column, cut: Column) -> Column:
    """``ascii`` or ``utf_8`` where all of ``raw`` is one of them, else null.

    Where ``cut``, the last character may be incomplete.
    """
    def decide(data: Column) -> Column:
        one_byte_each = F.length(data.cast("string")) == F.octet_length(data)
        return (
            F.when(_is_utf8(data) & one_byte_each, F.lit("ascii"))
            .when(_is_utf8(data), F.lit("utf_8"))
            .when(cut & _utf8_but_for_its_end(data), F.lit("utf_8"))
        )

    return let(raw, decide)


_SAMPLE = 1024  # bytes that tell whether a text without a mark has wide units
# fixed values: byte-order marks
_MARKS = (("FFFE0000", "utf_32", "utf_32_le"), ("0000FEFF", "utf_32", "utf_32_be"),
          ("FFFE", "utf_16", "utf_16_le"), ("FEFF", "utf_16", "utf_16_be"))
_UNIT = {"utf_16_le": 2, "utf_16_be": 2, "utf_32_le": 4, "utf_32_be": 4}
# runs of units, one character a byte: all but halves of surrogate pairs, and such pairs
_VALID_UNITS = {
    "utf_16_be": r"(?s)(?:[^\xD8-\xDF].)++|(?:[\xD8-\xDB].[\xDC-\xDF].)++",
    "utf_16_le": r"(?s)(?:.[^\xD8-\xDF])++|(?:.[\xD8-\xDB].[\xDC-\xDF])++",
    "utf_32_be": r"(?s)(?:\x00\x00[^\xD8-\xDF].)++|(?:\x00[\x01-\x10]..)++",
    "utf_32_le": r"(?s)(?:.[^\xD8-\xDF]\x00\x00)++|(?:..[\x01-\x10]\x00)++",
}
_HIGH_SURROGATE = {"utf_16_be": "^D[89AB]", "utf_16_le": "^..D[89AB]"}
# units of a text without a mark, one character a byte; those in a group speak for the order
_ONE_SIDE = {
    "utf_32_le": r"(?s)((?:..\x00\x00)++)|.{4}", "utf_32_be": r"(?s)((?:\x00\x00..)++)|.{4}",
    "utf_16_le": r"(?s)((?:[^\x00]\x00)++)|..?", "utf_16_be": r"(?s)((?:\x00[^\x00])++)|..?",
}
_ALL_UNITS = {"utf_32_le": r"(?s)^(?:(?!\x00{4})..[\x00-\x10]\x00)*+$(?!.)",
              "utf_32_be": r"(?s)^(?:(?!\x00{4})\x00[\x00-\x10]..)*+$(?!.)"}


def _one_character_a_byte(raw: Column) -> Column:
    """Bytes as a text of as many characters, for expressions that look at single bytes."""
    return F.decode(raw, "ISO-8859-1")


def _order_without_mark(raw: Column) -> Column:
    """Width and byte order of a text without a mark, as far as its zero bytes show it.

    Of UTF-16 at least half of the units have a zero byte on one side only, as in Latin scripts and in
    texts with many blanks; of UTF-32 all have one at the upper end, and at least half have two.
    """
    def of(sample: Column) -> Column:
        size = F.length(sample)

        def half(encoding: str) -> Column:
            own = F.length(F.regexp_replace(sample, _ONE_SIDE[encoding], "$1"))
            return own / _UNIT[encoding] / F.floor(size / _UNIT[encoding]) >= 0.5

        wide = (size >= 4) & (size % 4 == 0)
        return F.coalesce(
            *[F.when(wide & sample.rlike(_ALL_UNITS[e]) & half(e), e) for e in ("utf_32_le", "utf_32_be")],
            *[F.when((size >= 2) & half(e), e) for e in ("utf_16_le", "utf_16_be")])

    sample = F.substring(raw, 1, _SAMPLE)
    return F.when(F.contains(sample, F.lit(b"\x00")), let(_one_character_a_byte(sample), of))


def wide_encoding(raw: Column, cut: Column) -> Column:
    """``name, encoding, text`` where ``raw`` is UTF-16 or UTF-32, else null; all on the JVM.

    ``name`` is ``utf_16`` or ``utf_32`` behind a byte-order mark, which the text does not keep, and has
    the order at its end where zero bytes tell it. Every unit is judged. Only where ``cut`` may the
    last character be incomplete; U+FFFD stands for it then.
    """
    head = F.hex(F.substring(raw, 1, 4))
    marked = F.lit(None).cast("struct<name:string,encoding:string,skip:int>")
    for digits, name, order in reversed(_MARKS):
        found = F.struct(F.lit(name).alias("name"), F.lit(order).alias("encoding"),
                         F.lit(len(digits) // 2).alias("skip"))
        marked = F.when(F.startswith(head, F.lit(digits)), found).otherwise(marked)

    def judged(kind: Column) -> Column:
        body = F.substring(raw, kind["skip"] + 1, F.octet_length(raw))
        return let(body, lambda data: _judged(kind, data, cut))

    guess = _order_without_mark(raw)
    unmarked = F.when(F.lit(True), let(guess, lambda order: F.when(order.isNotNull(), F.struct(
        order.alias("name"), order.alias("encoding"), F.lit(0).alias("skip")))))
    return let(F.coalesce(marked, unmarked), lambda kind: F.when(kind.isNotNull(), judged(kind)))


def _judged(kind: Column, data: Column, cut: Column) -> Column:
    out = F.lit(None).cast("struct<name:string,encoding:string,text:string>")
    for encoding, width in _UNIT.items():
        size = F.octet_length(data)
        whole = size - size % width
        if encoding in _HIGH_SURROGATE:
            last = F.hex(F.substring(data, whole - 1, F.lit(2)))
            whole = whole - F.when(cut & (whole >= 2) & last.rlike(_HIGH_SURROGATE[encoding]), 2).otherwise(0)
        kept = F.substring(data, F.lit(1), whole)
        valid = (F.regexp_replace(_one_character_a_byte(kept), _VALID_UNITS[encoding], "") == "") & (cut | (whole == size))
        charset = encoding.upper().replace("_", "-").replace("-LE", "LE").replace("-BE", "BE")
        if width == 4:  # one charset, which reads the order from the mark
            text = F.decode(F.concat(F.lit(bytes.fromhex("FFFE0000" if encoding.endswith("le") else "0000FEFF")),
                                     kept), "UTF-32")
        else:
            text = F.decode(kept, charset)
        text = F.concat(text, F.when(whole < size, "\ufffd").otherwise(""))
        out = F.when(kind["encoding"] == encoding, F.when(valid, F.struct(
            kind["name"].alias("name"), kind["encoding"].alias("encoding"), text.alias("text")))).otherwise(out)
    return out


def with_decoded(
    df: DataFrame, raw: str, *, hint: str | None = None, cut: Column | None = None,
    fallback: str | None = None, wide: bool = False,
) -> DataFrame:
    """Add ``_encoding`` and ``_decoded`` (U+FFFD for what cannot be decoded).

    UTF-8 and ASCII stay on the JVM, and with ``wide``, which needs a ``fallback``, UTF-16 and UTF-32
    are found and decoded there too. Only other bytes go to Python, in one Arrow pass that both
    guesses and decodes. There is no such pass in the plan with a UTF-8 hint, or with a
    ``fallback`` (``"utf-8"`` or ``"latin_1"``) that other bytes are read as instead of guessing.
    """
    if fallback is not None and fallback not in _FALLBACKS:
        raise ValueError(f"fallback must be one of {sorted(_FALLBACKS)}, not {fallback!r}")
    if wide and (fallback is None or hint is not None):
        raise ValueError("wide encodings are found together with a fallback and without a hint")
    source = F.col(raw)
    if wide:
        cut = F.lit(False) if cut is None else cut
        # a frame of its own, so that the long expression is not copied into others
        found = df.withColumn("_wide", wide_encoding(source, cut))
        rest = F.when(F.col("_wide").isNull(), source)
        plain = with_decoded(found.withColumn("_rest", rest), "_rest", cut=cut, fallback=fallback)
        return plain.withColumns({
            "_encoding": F.coalesce("_wide.name", "_encoding"),
            "_decoded": F.coalesce("_wide.text", "_decoded")}).drop("_wide", "_rest")
    if hint in _UTF8_NAMES:
        return df.withColumns({
            "_encoding": F.when(source.isNotNull(), F.lit(hint)), "_decoded": decode_utf8(source)})
    if hint is None:
        cut = F.lit(False) if cut is None else cut
        df = df.withColumn("_easy", encoding_on_jvm(source, cut))
        if fallback is not None:
            other = decode_utf8(source) if fallback == "utf-8" else F.decode(source, _FALLBACKS[fallback])
            return df.withColumns({
                "_encoding": F.when(source.isNotNull(), F.coalesce("_easy", F.lit(fallback))),
                "_decoded": F.when(F.col("_easy").isNotNull(), decode_utf8(source)).otherwise(other),
            }).drop("_easy")
    else:
        df = df.withColumn("_easy", F.lit(None).cast("string"))
    other = F.when(F.col("_easy").isNull(), source)
    small_arrow_batches(df.sparkSession)
    df = df.withColumn("_guess", _guess_and_decode(other, F.lit(hint).cast("string")))
    return df.withColumns({
        "_encoding": F.coalesce("_easy", "_guess.encoding"),
        "_decoded": F.when(F.col("_easy").isNotNull(), decode_utf8(source))
        .otherwise(F.col("_guess.text")),
    }).drop("_easy", "_guess")


def decode_utf8(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def change_key(content: Column) -> Column:
    """64-bit key for telling contents apart inside Spark (its own seed, not an xxh64 digest)."""
    return F.xxhash64(content)


_fallback_told = False


def digest64(raw: bytes) -> str:
    """16 hex digits: xxh64, or blake2b where xxhash is not installed (told once)."""
    global _fallback_told
    if xxhash is not None:
        return xxhash.xxh64(raw).hexdigest()
    if not _fallback_told:
        log.warning("xxhash is not installed, hashing with blake2b")
        _fallback_told = True
    return hashlib.blake2b(raw, digest_size=8).hexdigest()


@F.pandas_udf(T.StringType())
def _digest(raw: pd.Series) -> pd.Series:
    return raw.map(lambda data: None if data is None else digest64(bytes(data)), na_action=None)


def algorithm_used(wanted: str | None) -> str | None:
    """Name to report: the algorithm that really runs."""
    if wanted == "xxh64":
        return "xxhash" if xxhash is not None else "blake2b"
    return wanted


def content_hash(content: Column, algorithm: str = "xxh64") -> Column:
    """Content digest: ``xxh64`` through Arrow batches; ``md5`` and ``sha256`` on the JVM."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha256":
        return F.sha2(content, 256)
    if algorithm == "xxh64":
        return _digest(content)
    raise ValueError(f"unknown hash algorithm {algorithm!r}")
