"""Text functions as column expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python has it: Unicode's, and U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def fold(x: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(F.lower(x), rf"(?U){SPACE}+", " "))


def normalize_name(x: Column) -> Column:
    return F.replace(F.lower(strip(x)), F.lit("_"), F.lit("-"))


def or_else(*values: Column) -> Column:
    """The first that is neither null nor empty (strings), or null."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _clean(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def text_list(x: Column) -> Column:
    """'a; b,c' as an array; null as an empty one."""
    return F.coalesce(_clean(F.split(F.replace(x, F.lit(";"), F.lit(",")), ",")), F.array().cast("array<string>"))


def array_list(x: Column) -> Column:
    """Elements without the empty ones; they are not split."""
    return F.coalesce(_clean(F.filter(x, lambda v: v.isNotNull())), F.array().cast("array<string>"))


def license_text(items: Column) -> Column:
    return F.nullif(F.array_join(items, ", "), F.lit(""))


def project_url(name: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("https://pypi.org/project/"), name, F.lit("/")))


def iso_time(ts: Column) -> Column:
    """ISO text of a UTC timestamp; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def parse_time(text: Column) -> Column:
    """ISO date-times and dates; other text is null, bare years and compact forms too."""
    return F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")), F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))))


def time_or_text(text: Column) -> Column:
    """struct<time, raw>: what parse_time reads, and the text itself where it reads nothing and is not empty."""
    time = parse_time(text)
    return F.struct(time.alias("time"), F.when(time.isNull() & (text != ""), text).alias("raw"))


def point_id(name: Column) -> Column:
    """Name-based UUID (version 5) of `pypi:` + name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), F.encode(F.concat(F.lit("pypi:"), name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def in_text(snippet: Column, description: Column) -> Column:
    """Whether a quote stands in a description, but for case and white space; an empty quote does not."""
    return F.when(F.coalesce(snippet, F.lit("")) == "", F.lit(False)).otherwise(F.contains(fold(F.coalesce(description, F.lit(""))), fold(snippet)))


def strip_fences(raw: Column) -> Column:
    """JSON text without a code fence around it."""
    text = strip(raw)
    return F.when(text.startswith("```"), strip(F.regexp_replace(text, r"(?i)^```(json)?\s*|\s*```$", ""))).otherwise(text)


def shortened(text: Column, most: int = 100) -> Column:
    one_line = F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(F.length(one_line) > most, F.concat(F.substring(one_line, 1, most - 3), F.lit("..."))).otherwise(one_line)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.format_string("%.2f s", ms / 1000))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def round_ms(ms: Column) -> Column:
    return F.bround(ms, 1)


def watermark_text(value: str | date | datetime) -> str:
    """A watermark as text: of a date-time only the date, text as it is but for white space around it."""
    if isinstance(value, datetime):
        value = value.date()
    return value.isoformat() if isinstance(value, date) else value.strip()
