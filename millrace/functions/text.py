"""Column functions on tags, text, numbers, dates and digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not tell two connectors apart.
STOP = ("to", "from", "the", "of", "and", "for", "see", "dwg", "drawing", "sheet")
#: Text that stands for a blank field.
PLACEHOLDER = r"(?i)^\s*(n/?a|none|null|tbd|tba|unknown|-+|\?+|x+)?\s*$"
#: First letter of an instrument tag: the measured variable (fixed values of the ISA letter table).
VARIABLES = {"A": "analysis", "F": "flow", "L": "level", "P": "pressure", "T": "temperature", "S": "speed", "W": "weight", "V": "vibration", "X": "unclassified", "H": "hand", "Z": "position"}


# ---- P01: tag spellings


def nfkc(tag: Column) -> Column:
    """Compatibility form; only texts beyond ASCII leave the JVM."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for s in batches:
            yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    return F.when(tag.rlike(r"[^\x00-\x7F]"), form(F.when(tag.rlike(r"[^\x00-\x7F]"), tag))).otherwise(tag)


def tag_strict(tag: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(tag, r"\s+", ""))


def tag_lenient(tag: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(tag), r"[^A-Z0-9]", "")


def tag_map(tag: Column) -> Column:
    """Without white space, underscores, dashes, dots and slashes."""
    return F.upper(F.regexp_replace(tag, r"[\s_\-./]", ""))


def tag_compact(tag: Column) -> Column:
    return F.upper(F.regexp_replace(tag, r"[\s\-_]", ""))


def tag_screen(tag: Column) -> Column:
    """Runs of spaces, dashes and underscores become one dash."""
    return F.upper(F.regexp_replace(F.trim(tag), r"[\s\-_]+", "-"))


# ---- P02, P03: tag parts


def isa_letters(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(tag), r"^([A-Z]{1,6})[\s-]*[0-9]", 1), F.lit(""))


def isa_loop(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(tag), r"^[A-Z]{1,6}[\s-]*([0-9][0-9A-Z]*)", 1), F.lit(""))


def isa_variable(letters: Column) -> Column:
    out = F.lit(None).cast("string")
    for letter, name in VARIABLES.items():
        out = F.when(F.substring(letters, 1, 1) == letter, name).otherwise(out)
    return out


def plant_coded(letters: Column, codes: Column) -> Column:
    """Whether the letters begin with one of the plant's system codes."""
    return F.exists(codes, lambda c: F.startswith(letters, c))


def offpage(text: Column) -> Column:
    """struct(ref, code, words) of an off-page reference."""
    ref = F.nullif(F.regexp_extract(text, r"([A-Z]{1,4}-?[0-9]{2,6})", 1), F.lit(""))
    code = F.nullif(F.regexp_extract(ref, r"^([A-Z]+)", 1), F.lit(""))
    words = F.array_except(tokens(text), F.array(*map(F.lit, STOP)))
    return F.struct(ref.alias("ref"), code.alias("code"), words.alias("words"))


# ---- F04: tokens


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def field_state(value: Column) -> Column:
    """Present, blank (placeholders count as blank) or absent."""
    return F.when(value.isNull(), "absent").when(value.rlike(PLACEHOLDER), "blank").otherwise("present")


# ---- F02: dates


def us_minute(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm"))


def excel_serial(days: Column) -> Column:
    """A spreadsheet's day number as a timestamp."""
    return F.timestamp_micros(F.round((days - 25569) * 86400).cast("long") * 1_000_000)


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


# ---- F03: digests


def canonical(*cols: str) -> Column:
    """JSON with the fields in name order; nulls are written."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def digest(*cols: str, length: int = 64) -> Column:
    return F.substring(F.sha2(canonical(*cols).cast("binary"), 256), 1, length)


# ---- F05: numbers


def significant(x: Column, n: int = 3) -> Column:
    """Rounded to n significant figures; 0 stays 0."""
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def percent(x: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, places), F.lit("%"))


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would run gets an apostrophe."""
    return F.when(cell.rlike(r"^\s*[=+@'-]|[\x00-\x1f]"), F.concat(F.lit("'"), cell)).otherwise(cell)
