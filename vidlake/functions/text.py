"""Strings and times as messages write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Parts of a time template and how they are written (fixed values).
TIME_PARTS = {"<year>": "yyyy", "<mon>": "MM", "<day>": "dd", "<hour>": "HH", "<min>": "mm", "<sec>": "ss", "<mili>": "SSS"}
#: Byte lengths of a plate's text that are taken for whole (fixed values).
PLATE_BYTES = (7, 9, 10)


def split_tokens(s: Column, delimiter: str) -> Column:
    """Parts between delimiters: inner empty parts stay, one empty part at the end does not."""
    parts = F.split(s, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def round_any(x: Column, places: int) -> Column:
    """x rounded half up to some places, written without trailing zeros."""
    text = F.format_string("%.6f", F.floor(x * 10**places + 0.5) / F.lit(float(10**places)))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def pad_left(s: Column, n: int, fill: str = "0") -> Column:
    """Padded to n characters, never cut."""
    return F.when(F.length(s) < n, F.lpad(s, n, fill)).otherwise(s)


def pad_right(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) < n, F.rpad(s, n, fill)).otherwise(s)


def time_format(ts: Column, template: str, zone: str = "UTC") -> Column:
    """ts in a zone, written as a template of TIME_PARTS and other text."""
    local, parts, rest = F.from_utc_timestamp(ts, zone), [], template
    while rest:
        hit = min(((rest.find(k), k) for k in TIME_PARTS if k in rest), default=(len(rest), None))
        if hit[0]:
            parts.append(F.lit(rest[: hit[0]]))
        if hit[1] is None:
            break
        parts.append(F.date_format(local, TIME_PARTS[hit[1]]))
        rest = rest[hit[0] + len(hit[1]) :]
    return F.concat(*parts)


def parse_plate(label: Column) -> Column:
    """(color, text) of a label color_text, or null where it has other than two parts or the text is no plate's length."""
    parts = F.split(label, "_", -1)
    good = (F.size(parts) == 2) & F.octet_length(F.get(parts, 1)).isin(*PLATE_BYTES)
    return F.when(good, F.struct(F.get(parts, 0).alias("color"), F.get(parts, 1).alias("text")))


def display_label(track_id: Column, label: Column, secondary: Column) -> Column:
    """#id, where tracked, then the labels with a pipe between."""
    head = F.when(track_id >= 0, F.concat(F.lit("#"), track_id.cast("string"), F.lit(" "))).otherwise("")
    return F.concat(head, F.array_join(F.concat(F.array(F.coalesce(label, F.lit(""))), F.coalesce(secondary, F.array().cast("array<string>"))), "|"))
