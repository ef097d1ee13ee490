"""Scalar text functions as Column -> Column; a null argument gives null unless stated otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import js

# Characters and their plain spelling
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "­​‌‍⁠﻿"
HARD_SPACES = "   "
BULLETS = "•‣◦▪●∙"
NOT_A_DIVIDER = [".", ",", ";", ":", "!", "?", "…", "'", '"', "‘", "’", "“", "”", "«", "»", "(", ")", "[", "]", "{", "}", "<", ">", "/", "\\", "|"]
NEEDS_REPETITION = ["-", "–", "—", "~", "_", "=", "+", "*"]
MAX_FILENAME = 120

# Lower-case Latin letters with accents, and their base letters
_DECOMPOSED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xE0, 0x250) if chr(c).islower() and unicodedata.normalize("NFD", chr(c)) != chr(c)]
_ACCENTS = ("".join(a for a, _ in _DECOMPOSED), "".join(b for _, b in _DECOMPOSED))


def normalize_characters(c: Column) -> Column:
    """Ligatures are spelt out, invisible characters go, hard spaces become spaces; nothing else changes."""
    plain = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)
    return F.translate(plain, HARD_SPACES + INVISIBLE, " " * len(HARD_SPACES))


def sanitize_xml(c: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")


def escape_html(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], c)


def escape_xml(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), [('"', "&quot;"), ("'", "&#39;")], escape_html(c))


def header_key(c: Column) -> Column:
    """What running heads have in common: digits as #, white space squeezed, lower case."""
    return F.lower(js.squeeze(F.regexp_replace(c, "[0-9]+", "#")))


def is_page_number(c: Column) -> Column:
    return c.rlike(rf"^{js.WS}*[0-9]+{js.WS}*\z") | c.rlike(rf"(?i)^{js.WS}*(page{js.WS}+)?[0-9]+{js.WS}*(of|/){js.WS}*[0-9]+{js.WS}*\z")


def is_scene_break(c: Column) -> Column:
    """1 to 10 copies of one symbol, white space aside; some symbols never, some not alone. Whether a text is so short is asked
    first, as the rest makes several copies of it."""
    short = c.rlike(rf"\A{js.WS}*+(?:[^{js.WS_CHARS}]{js.WS}*+){{1,10}}\z")
    compact = F.regexp_replace(c, f"{js.WS}+", "")
    first = F.left(compact, F.lit(1))
    size = js.utf16_length(compact)
    plain = ~first.rlike(r"[\p{L}\p{N}_]") & ~first.isin(NOT_A_DIVIDER) & (js.utf16_length(first) == 1)
    return F.coalesce(short & size.between(1, 10) & plain & (F.replace(compact, first, F.lit("")) == "") & ~((size == 1) & first.isin(NEEDS_REPETITION)), F.lit(False))


def strip_bullet(c: Column) -> Column:
    return js.trim(F.regexp_replace(c, f"^[{BULLETS}]{js.WS}+", ""))


def is_bullet(c: Column) -> Column:
    return c.rlike(f"^[{BULLETS}]{js.WS}+")


def sanitize_filename(c: Column) -> Column:
    """Safe as a file's name on usual systems, 120 characters at most; `untitled` if nothing is left, or for null."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{C}", " ")
    x = js.squeeze(F.regexp_replace(x, r'[\\/:*?"<>|]', " "))
    x = F.regexp_replace(F.regexp_replace(x, rf"^[.{js.WS_CHARS}]+", ""), rf"[.{js.WS_CHARS}]+\z", "")
    x = F.regexp_replace(F.left(x, F.lit(MAX_FILENAME)), rf"[.{js.WS_CHARS}]+\z", "")
    return F.when(x == "", "untitled").otherwise(x)


def format_bytes(c: Column) -> Column:
    kb = 1024.0
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("long")))
        .when(c < kb**2, F.format_string("%.0f KB", c / kb))
        .when(c < kb**3, F.format_string("%.1f MB", c / kb**2))
        .otherwise(F.format_string("%.2f GB", c / kb**3))
    )


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+\z", "")


def series_title(series: Column, index: Column, title: Column) -> Column:
    n = F.greatest(F.lit(1), F.floor(index)).cast("string")
    return F.concat(js.trim(series), F.lit(" "), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n), F.lit(" — "), js.trim(title))


def natural_key(c: Column) -> Column:
    """A sort key, array<struct<text, places, digits>>: what stands before each run of digits in the order of Unicode's root
    collation, where case and accents of any script count for nothing, and the run by its value: by its number of places
    without zeros before it, then by the digits."""
    text = F.coalesce(c, F.lit(""))
    between = F.transform(F.split(text, "[0-9]+", -1), lambda t: F.collate(t, "UNICODE_CI_AI"))
    digits = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda m: F.regexp_replace(m, "^0+(?=[0-9])", ""))
    return F.zip_with(between, digits, lambda t, d: F.struct(t.alias("text"), F.coalesce(F.length(d), F.lit(-1)).alias("places"), F.coalesce(d, F.lit("")).alias("digits")))


def utc_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def retry_after_ms(header: Column, now: Column) -> Column:
    """Seconds or a date, held to 0..300 seconds; null if neither."""
    seconds = header.try_cast("double") * 1000
    bare = F.regexp_replace(header, "^[A-Za-z]+, ", "")  # a weekday says nothing, and can't be read
    date = F.unix_millis(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss zzz"))) - F.unix_millis(now)
    wait = F.coalesce(seconds, date.cast("double"))
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0.0)), F.lit(300000.0)))  # least and greatest skip nulls


def url_shape(url: Column, home: str = "") -> Column:
    """Host (but for home), path and the keys of a URL's query, each once in their order, never its values."""
    host = F.try_parse_url(url, F.lit("HOST"))
    pairs = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    named = F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))
    keys = F.array_join(F.array_distinct(named), "&")
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    shown = F.concat(F.when(host == home, "").otherwise(host), path, F.when(keys != "", F.concat(F.lit("?"), keys)).otherwise(""))
    return F.when(url.isNotNull(), F.when(host.isNull(), "(bad url)").otherwise(shown))


def brief_list(items: Column, shown: int = 5) -> Column:
    """a, b, c and 2 more."""
    more = F.size(items) - shown
    return F.when(more > 0, F.concat(F.array_join(F.slice(items, 1, shown), ", "), F.format_string(" and %d more", more))).otherwise(F.array_join(items, ", "))


def remember(list_: Column, value: Column, most: int = 12) -> Column:
    """Most recently used first, each once."""
    return F.slice(F.array_prepend(F.filter(list_, lambda x: x != value), value), 1, most)
