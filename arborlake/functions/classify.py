"""Text-or-binary decision: extension, then byte statistics of a sample, then leading bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from arborlake.functions.let import let
from arborlake.functions.paths import suffix
from arborlake.options import BINARY_SAMPLE_BYTES

# --- fixed values: suffixes and thresholds that decide the class ----------------------------
TEXT_SUFFIXES = (
    ".c", ".cc", ".cfg", ".cmake", ".conf", ".cpp", ".cs", ".css", ".csv", ".dart", ".env",
    ".go", ".gradle", ".h", ".hpp", ".html", ".ini", ".java", ".js", ".json", ".jsx", ".kt",
    ".less", ".lock", ".lua", ".m", ".md", ".php", ".pl", ".properties", ".ps1", ".py", ".pyi",
    ".r", ".rb", ".rs", ".rst", ".sass", ".scala", ".scss", ".sh", ".sql", ".swift", ".toml",
    ".ts", ".tsx", ".txt", ".vue", ".yaml", ".yml",
)
BINARY_SUFFIXES = (
    ".7z", ".apng", ".avi", ".bmp", ".class", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico",
    ".iso", ".jar", ".jpeg", ".jpg", ".lz", ".mkv", ".mov", ".mp3", ".mp4", ".ogg", ".otf",
    ".pdf", ".png", ".psd", ".pyd", ".rar", ".so", ".svgz", ".tar", ".tgz", ".ttf", ".wav",
    ".webm", ".webp", ".woff", ".woff2", ".xz", ".zip",
)
TEXT_MIME_PREFIXES = (
    "text/", "application/json", "application/xml", "application/javascript",
    "application/x-javascript", "application/x-sh",
)
TEXT_MIME_TYPES = ("application/x-empty", "inode/x-empty")
UNKNOWN_MIME = "application/octet-stream"
NUL_BINARY = 0.001
CONTROL_BINARY, PRINTABLE_WITH_CONTROL = 0.10, 0.9
PRINTABLE_TEXT, CONTROL_TEXT = 0.95, 0.02
PRINTABLE_BINARY = 0.60
COHERENCE_TEXT, CHAOS_BINARY = 60, 40
# well-known leading bytes (hex) and the type they announce
SIGNATURES = (
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("25504446", "application/pdf"),
    ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"),
    ("7F454C46", "application/x-executable"),
    ("CAFEBABE", "application/x-java-applet"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("FD377A585A00", "application/x-xz"),
    ("425A68", "application/x-bzip2"),
    ("4F676753", "audio/ogg"),
    ("52494646", "application/x-riff"),
    ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
)
# --------------------------------------------------------------------------------------------


def by_suffix(name: Column) -> Column:
    """False for a text suffix, true for a binary one, null for any other."""
    def decide(ext: Column) -> Column:
        text = F.find_in_set(ext, F.lit(",".join(TEXT_SUFFIXES))) > 0
        binary = F.find_in_set(ext, F.lit(",".join(BINARY_SUFFIXES))) > 0
        return F.when(text, F.lit(False)).when(binary, F.lit(True))

    return let(suffix(name), decide)


def sample(content: Column) -> Column:
    return F.substring(content, 1, BINARY_SAMPLE_BYTES)


def sample_statistics(sampled: Column) -> Column:
    """Struct of the printable, control and NUL shares, and whether two NULs stand together;
    shares (1, 0, 0) for no bytes.

    ISO-8859-1 gives one character per byte, so runs of other bytes are dropped by one regular
    expression and the rest is measured.
    """
    def count(chars: Column) -> Column:
        total = F.length(chars)
        clean = F.struct(
            total.alias("total"), total.alias("printable"), total.alias("safe"),
            total.alias("not_nul"), F.lit(False).alias("two_nuls"))
        measured = F.struct(
            total.alias("total"),
            F.length(F.regexp_replace(chars, r"[^\x20-\x7E\t\n\f\r]+", "")).alias("printable"),
            F.length(F.regexp_replace(chars, r"[\x00-\x08\x0B\x0E-\x1F]+", "")).alias("safe"),
            F.length(F.replace(chars, F.lit("\x00"))).alias("not_nul"),
            F.contains(chars, F.lit("\x00\x00")).alias("two_nuls"),
        )
        return F.when(chars.rlike(r"[^\x20-\x7E\t\n\f\r]"), measured).otherwise(clean)

    def share(n: Column) -> Column:
        size = F.greatest(n["total"], F.lit(1)).cast("double")
        return F.when(n["total"].isNotNull(), F.struct(
            F.when(n["total"] == 0, F.lit(1.0)).otherwise(n["printable"] / size)
            .alias("printable"),
            ((n["total"] - n["safe"]) / size).alias("control"),
            ((n["total"] - n["not_nul"]) / size).alias("nul"),
            n["two_nuls"].alias("two_nuls"),
        ))

    return let(F.decode(sampled, "ISO-8859-1"), lambda chars: let(count(chars), share))


def by_statistics(stats: Column) -> Column:
    """Class by the byte shares alone; null where they leave it open."""
    def decide(s: Column) -> Column:
        printable, control, nul = s["printable"], s["control"], s["nul"]
        return (
            F.when((nul > 0) & ((nul >= NUL_BINARY) | s["two_nuls"]), F.lit(True))
            .when((control > CONTROL_BINARY) & (printable < PRINTABLE_WITH_CONTROL), F.lit(True))
            .when((printable >= PRINTABLE_TEXT) & (control <= CONTROL_TEXT), F.lit(False))
            .when(printable <= PRINTABLE_BINARY, F.lit(True))
        )

    return let(stats, decide)


@F.pandas_udf(T.BooleanType())
def _by_charset(samples: pd.Series) -> pd.Series:
    """Class by charset analysis; rows that need none arrive as null and cost nothing."""
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return pd.Series([None] * len(samples), dtype="object")

    def decide(raw):
        if raw is None:
            return None
        best = from_bytes(raw).best()
        if best is None or not best.encoding:
            return None
        if best.percent_coherence >= COHERENCE_TEXT:
            return False
        return True if best.percent_chaos > CHAOS_BINARY else None

    return samples.map(decide, na_action=None).astype("object")


def by_charset(sampled: Column, needed: Column) -> Column:
    return _by_charset(F.when(needed, sampled))


def mime_of(sampled: Column) -> Column:
    """Type announced by the leading bytes, empty content included; else the unknown type."""
    longest = max(len(signature) for signature, _ in SIGNATURES)

    def look_up(head: Column) -> Column:
        found = F.when(head == "", F.lit(TEXT_MIME_TYPES[0]))
        for signature, mime in SIGNATURES:
            found = found.when(F.startswith(head, F.lit(signature)), F.lit(mime))
        return found.otherwise(F.lit(UNKNOWN_MIME))

    return let(F.hex(F.substring(sampled, 1, longest // 2)), look_up)


def by_mime(mime: Column) -> Column:
    """False for a textual type, null for the unknown one, true for any other."""
    def decide(kind: Column) -> Column:
        textual = kind.isin(*TEXT_MIME_TYPES)
        for prefix in TEXT_MIME_PREFIXES:
            textual = textual | F.startswith(kind, F.lit(prefix))
        return (
            F.when(kind.isNull() | (kind == ""), F.lit(None).cast("boolean"))
            .when(textual, F.lit(False))
            .when(kind != UNKNOWN_MIME, F.lit(True))
        )

    return let(mime, decide)


def first_decision(*decisions: Column) -> Column:
    """The first class that is known; a file nobody can decide on is text."""
    return F.coalesce(*decisions, F.lit(False))


def with_is_binary(
    df: DataFrame, *, charset: bool = True, unless: Column | None = None
) -> DataFrame:
    """Add ``is_binary`` by the whole cascade from ``filename`` and ``content``.

    Content is only looked at where the suffix decides nothing (and ``unless`` does not hold).
    """
    df = df.withColumn("_known", by_suffix(F.col("filename")))
    wanted = F.col("_known").isNull()
    if unless is not None:
        wanted = wanted & ~unless
    df = df.withColumn("_sample", F.when(wanted, sample(F.col("content"))))
    sampled = F.col("_sample")

    def numeric(raw: Column) -> Column:
        return by_statistics(sample_statistics(raw))

    if not charset:
        decision = let(
            sampled, lambda raw: first_decision(numeric(raw), by_mime(mime_of(raw))))
    else:
        df = df.withColumn("_numeric", numeric(sampled))
        open_case = F.col("_numeric").isNull() & sampled.isNotNull()
        df = df.withColumn("_charset", by_charset(sampled, open_case))
        decision = first_decision(
            F.col("_numeric"), F.col("_charset"), by_mime(mime_of(sampled)))
    return df.withColumn("is_binary", F.coalesce("_known", decision)).drop(
        "_known", "_sample", "_numeric", "_charset")
