"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

All of it is column expressions. A candidate is a run of 20 or more letters, digits, ``+/_=-``.
Its encoding (hexadecimal, base32, base64) gives the alphabet. Three tests ask whether it could
be random: chi-squared uniformity over the alphabet, number of runs about the middle of the
alphabet, and lag-one serial correlation. The smallest of the three p-values, times three, is its
p-value. Short tokens reject less easily than long ones, so the Benjamini-Hochberg step is taken
by class of encoding and length: it rejects randomness at a stated false-discovery rate among the
candidates of a class, and what it leaves, mixed in letters and digits, is reported. The step
needs counts by binned p-value only, so no task ranks a class.

Defined results: a null text counts as empty and has no spans; a run with fewer than two symbols of
its alphabet, such as a ruler of ``=``, is not tested, counted or reported; rows are independent of
each other but for the counts by class; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions.let import let
from arborlake.session import materialise

# fixed values: the patterns of the base scan
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "random")
BINS = 200  # of -ln(p), tenths
_BLOCK = 256  # matches whose places are summed in one fold
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches as ``array<struct<start, end, value>>`` in code points; ``value`` is the group.

    The gaps between matches give their places. They are summed in blocks of ``_BLOCK`` matches and
    then over the blocks: a fold copies its array at each match, so it must not hold all of them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hits: Column) -> Column:
        values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"),
                            values.alias("value"))
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")

        def step(s: Column, row: Column) -> Column:
            start = s["at"] + F.char_length(row["gap"])
            end = start + F.char_length(row["hit"])
            return F.when(row["hit"].isNull(), s).otherwise(F.struct(
                end.alias("at"), F.array_append(s["spans"], F.struct(
                    start.alias("start"), end.alias("end"), row["value"].alias("value"))).alias("spans")))

        def in_blocks(rows: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int"))
            return F.transform(numbers, lambda i: F.aggregate(
                F.slice(rows, i * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

        def joined(blocks: Column) -> Column:
            before = F.aggregate(
                blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before")),
                lambda s, b: F.struct((s["at"] + b["at"]).alias("at"),
                                      F.array_append(s["before"], s["at"]).alias("before")), lambda s: s["before"])
            return F.flatten(F.zip_with(blocks, before, lambda block, at: F.transform(
                block["spans"], lambda s: F.struct(
                    (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))))

        return F.when(F.size(hits) == 0, none).otherwise(let(rows, lambda r: let(in_blocks(r), joined)))

    return let(hits, placed)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution by a logistic approximation (error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(z * 1.5976 + F.pow(z, 3) * 0.07056, F.lit(700.0))))


def _encoding(value: Column) -> Column:
    return (F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(value.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64"))


def _p_value(symbols: Column, size: int) -> Column:
    """Bonferroni-combined p-value of the three tests; ``symbols`` are alphabet places.

    Null for fewer than two symbols, which no test can judge.
    """
    n = F.size(symbols).cast("double")

    def battery(symbols: Column) -> Column:
        counts = F.transform(F.array_distinct(symbols), lambda c: F.size(
            F.filter(symbols, lambda x: x == c)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * size / n - n
        freedom = size - 1
        cube = 2 / (9 * freedom)
        uniform = _upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / freedom, 1 / 3) - (1 - cube))
                              / math.sqrt(cube))
        pairs = F.arrays_zip(F.slice(symbols, F.lit(1), F.size(symbols) - 1).alias("a"),
                             F.slice(symbols, F.lit(2), F.size(symbols) - 1).alias("b"))
        middle = size / 2
        changes = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(
            (p["a"] < middle) != (p["b"] < middle), 1.0).otherwise(0.0))
        runs = 2 * _upper_tail(F.abs(changes - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
        mean = (size - 1) / 2
        variance = (size * size - 1) / 12
        product = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
        serial = 2 * _upper_tail(F.abs(product) / (variance * F.sqrt(n - 1)))
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    return F.when(F.size(symbols) > 1, battery(symbols))


def _places(text: Column, alphabet: str) -> Column:
    # an empty text splits into one empty string, which instr would find in front
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.filter(F.transform(letters, lambda c: F.instr(F.lit(alphabet), c) - 1), lambda x: x >= 0)


def _candidates(text: Column) -> Column:
    def tested(token: Column) -> Column:
        value = token["value"]
        encoding = _encoding(value)
        plain = F.regexp_replace(F.translate(value, "-_", "+/"), "=+$", "")
        p = (F.when(encoding == "hex", let(_places(F.lower(plain), _ALPHABETS["hex"]), lambda s: _p_value(s, 16)))
             .when(encoding == "base32", let(_places(plain, _ALPHABETS["base32"]), lambda s: _p_value(s, 32)))
             .otherwise(let(_places(plain, _ALPHABETS["base64"]), lambda s: _p_value(s, 64))))
        # a word or a number may look random by chance; a coded secret mixes letters and digits
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        length = F.floor(F.log2(F.char_length(value).cast("double")) * 2).cast("int")
        return F.struct(
            token["start"].alias("start"), token["end"].alias("end"),
            F.concat_ws(":", encoding, length.cast("string")).alias("class"),
            F.when(p.isNotNull(), F.least(F.lit(BINS), F.floor(-F.log(F.greatest(p, F.lit(1e-12))) * 10)))
            .cast("int").alias("bin"),
            mixed.alias("mixed"))

    return F.transform(found(text, CANDIDATE), tested)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, tested``: the spans of the fixed patterns and the tested candidates."""
    text = F.coalesce("text", F.lit(""))

    def spans(kind: int, matches: Column) -> Column:
        return F.transform(matches, lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    assign = F.filter(found(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 6)
    base = F.array_sort(F.concat(
        spans(0, assign), spans(1, found(text, ACCESS)), spans(2, found(text, HEX))))
    return docs.select("doc_id", base.alias("base"), _candidates(text).alias("tested"))


def limits(scanned: DataFrame, rate: float) -> dict[str, int]:
    """Smallest bin of -ln(p) that the step rejects, by class; bins and classes are few."""
    counts = (scanned.select(F.explode("tested").alias("t")).filter("t.bin IS NOT NULL")
              .groupBy(F.col("t.class").alias("class"), F.col("t.bin").alias("bin")).count())
    by_class: dict[str, list] = {}
    for row in counts.collect():  # at most BINS + 1 rows for each of some dozens of classes
        by_class.setdefault(row["class"], []).append((row["bin"], row["count"]))
    found_limits = {}
    for name, bins in by_class.items():
        total, below = sum(n for _, n in bins), 0
        limit = BINS + 1
        for place, n in sorted(bins, reverse=True):  # from the smallest p on
            below += n
            if math.exp(-place / 10) <= rate * below / total:
                limit = place
        found_limits[name] = limit
    return found_limits


def secret_scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``doc_id, spans``: ``array<struct<start, kind, end>>`` by start and kind (see ``KINDS``)."""
    scanned = materialise(scan(docs), "secrets")
    rejected = limits(scanned, rate)
    limit = F.create_map(*[F.lit(x) for pair in rejected.items() for x in pair]) if rejected else \
        F.create_map().cast("map<string,int>")
    random = F.transform(
        F.filter("tested", lambda t: t["mixed"] & (t["bin"] < F.element_at(limit, t["class"]))),
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
