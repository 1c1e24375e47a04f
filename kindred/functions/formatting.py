"""Literals and renderings: sizes, durations, times, shell words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of size literals.
UNITS = {
    "": 1, "B": 1,
    "K": 10**3, "KB": 10**3, "KIB": 2**10,
    "M": 10**6, "MB": 10**6, "MIB": 2**20,
    "G": 10**9, "GB": 10**9, "GIB": 2**30,
    "T": 10**12, "TB": 10**12, "TIB": 2**40,
}


def parse_size(text: Column) -> Column:
    """Bytes of a literal such as ``1.5KiB``; fractions are cut off; null if it is none."""
    clean = F.upper(F.trim(text))
    number, unit = (F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*([A-Z]*)$", i) for i in (1, 2))
    factor = F.lit(None).cast("double")
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(float(value))).otherwise(factor)
    return F.when(number != "", F.floor(number.cast("double") * factor).cast("long"))


def parse_date(text: Column) -> Column:
    """Midnight UTC of ``YYYY-MM-DD``, whatever the session's zone."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-ddX")))


def moment(text: str) -> Column:
    """The timestamp of a date or a date and time; UTC where it names no zone."""
    day, _, time = text.strip().replace("T", " ").partition(" ")
    zoned = time.endswith("Z") or "+" in time or "-" in time
    return F.lit(f"{day} {time or '00:00:00'}{'' if zoned else 'Z'}").cast("timestamp")


def _scaled(size: Column, units: list[tuple[int, str]], plain: str) -> Column:
    out = F.concat(size.cast("string"), F.lit(plain))
    for power, name in units:
        out = F.when(size >= 2**power, F.format_string(f"%.2f {name}", F.bround(size / F.lit(float(2**power)), 2))).otherwise(out)  # halves to even
    return out


def format_size(size: Column) -> Column:
    return _scaled(size, [(10, "KB"), (20, "MB"), (30, "GB"), (40, "TB")], " B")


def format_preview_size(size: Column) -> Column:
    return _scaled(size, [(10, "KB"), (20, "MB"), (30, "GB")], " bytes")


def format_duration(ms: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s``, ``3.456s`` or ``456ms``."""
    seconds = F.floor(ms / 1000)
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .when(seconds > 0, F.format_string("%d.%03ds", s, ms % 1000))
        .otherwise(F.format_string("%dms", ms))
    )


def rfc3339(moment: Column) -> Column:
    """In UTC, whatever the session's zone."""
    wall = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(moment))
    return F.concat(F.replace(F.substring(wall.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("+00:00"))


def local_time(moment: Column) -> Column:
    """In the session's zone."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def posix_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def powershell_quoted(text: Column) -> Column:
    """Typographic single quotes end a string there, too."""
    return F.concat(F.lit("'"), F.regexp_replace(text, "(['\u2018\u2019\u201a\u201b])", "$1$1"), F.lit("'"))


def on_one_line(text: Column) -> Column:
    """A text that no shell reads past the end of a comment: line ends are written as \\n and \\r,
    other control characters and separators as a question mark."""
    shown = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.regexp_replace(shown, r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]", "?")


def html_escaped(text: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def json_string(text: Column) -> Column:
    """A string as JSON writes it, in quotes."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def truncated_path(path: Column, most: int) -> Column:
    """The end of a path that is too long, after an ellipsis."""
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(max(0, most - 3)))))


def percentage(part: Column, total: Column) -> Column:
    """0 of nothing, 100 at most."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), part * F.lit(100.0) / total))


def cache_key(path: Column, size: Column, mtime_ns: Column, inode: Column) -> Column:
    return F.concat_ws(":", path, size.cast("string"), mtime_ns.cast("string"), F.coalesce(inode, F.lit(0)).cast("string"))
