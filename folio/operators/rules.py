"""Rule-driven annotation: tagged words, percentages on a colour ramp, and colour checks."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import js
from folio.functions.text import escape_html
from folio.operators.automaton import replace_phrases

# The fallback colour, contrast limits, and the shapes of percentages, pairs, tags and spans
FALLBACK = "#808080"
MIN_CONTRAST = 2.5
MIN_GREY_GAP = 0.1
PERCENT = r"[0-9]+(?:\.[0-9]+)?%"
PAIR_GAP = rf"(?i)^[{js.WS_CHARS}\]\[:/()]*(?:of)?[{js.WS_CHARS}\]\[:/()]*\z"
RARITY_TAG = r"\[[A-Za-z][A-Za-z '+-]{0,30}?\]"
SPAN = r"<span\b[^>]*>.*?</span>"
#: Phrases beyond which keywords are found by an automaton.
MOST_ALTERNATIVES = 200


@dataclass
class Rules:
    """rarities and keywords: (key, words) in the order of their definition; later words win."""

    rarities: list[tuple[str, list[str]]] = field(default_factory=list)
    keywords: list[tuple[str, list[str]]] = field(default_factory=list)
    percent: bool = True
    low: str = "#d11f1f"
    mid: str = "#c2a200"
    high: str = "#1f9e3d"
    pair_max: bool = True
    bold: bool = True

    def rarity_classes(self) -> dict[str, str]:
        return {w.lower(): f"rarity-{safe_key(k)}" for k, ws in self.rarities for w in ws}

    def keyword_classes(self) -> dict[str, str]:
        """Phrases with hyphens as spaces; each tier also gives its key and its words with -grade."""
        pairs = [(w, f"kw-{safe_key(k)}") for k, ws in self.keywords for w in ws]
        pairs += [(w, f"rarity-{safe_key(k)}") for k, ws in self.rarities for w in (k, *(f"{x}-grade" for x in ws))]
        return {re.sub("[ -]+", " ", w): c for w, c in pairs}

    def keyword_pattern(self) -> str | None:
        phrases = sorted(self.keyword_classes(), key=lambda w: (-len(w), w))
        if not phrases:
            return None
        # A phrase matches with single spaces or hyphens between its words
        return "(?i)(?<![A-Za-z])(?:" + "|".join("[ -]".join(map(re.escape, p.split(" "))) for p in phrases) + ")(?![A-Za-z])"


def safe_key(key: str) -> str:
    k = re.sub("[^A-Za-z0-9_-]", "", key)
    return k if re.match("[A-Za-z]", k) else f"k{k}"


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]) if entries else F.create_map(F.lit(""), F.lit("")).cast("map<string,string>")


def outside_spans(html: Column, fn) -> Column:
    """fn applied to the stretches of text between finished spans. html, which may be dear, is evaluated once."""

    def whole(html: Column) -> Column:
        between = F.transform(F.when(html.contains("<span"), F.split(html, SPAN, -1)).otherwise(F.array(html)), fn)
        spans = F.when(html.contains("<span"), F.regexp_extract_all(html, F.lit(SPAN), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.zip_with(between, spans, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return js.let(html, whole)


def _wrapped(match: Column, cls: Column) -> Column:
    return F.when(cls.isNotNull(), F.concat(F.lit('<span class="'), cls, F.lit('">'), match, F.lit("</span>"))).otherwise(match)


def tag_rarities(html: Column, rules: Rules) -> Column:
    if not rules.rarity_classes():
        return html
    known = _map(rules.rarity_classes())
    look = lambda m: F.try_element_at(known, F.lower(js.trim(F.substring(m, F.lit(2), F.length(m) - 2))))
    tagged = lambda t: js.rebuild(t, RARITY_TAG, lambda m: _wrapped(m, look(m)))
    return js.let(html, lambda h: F.when(h.contains("["), outside_spans(h, tagged)).otherwise(h))


def tag_keywords(html: Column, rules: Rules) -> Column:
    classes = rules.keyword_classes()
    if len(classes) > MOST_ALTERNATIVES:  # an alternation's time grows with the dictionary, an automaton's doesn't
        return replace_phrases(html, classes, lambda m, cls: f'<span class="{cls}">{m}</span>', SPAN)
    pattern, known = rules.keyword_pattern(), _map(classes)
    if pattern is None:
        return html
    look = lambda m: F.try_element_at(known, F.regexp_replace(F.lower(m), "[ -]+", " "))
    return outside_spans(html, lambda t: js.rebuild(t, pattern, lambda m: _wrapped(m, look(m))))


def normalize_hex(c: Column) -> Column:
    """#rrggbb in lower case, or null."""
    v = F.lower(js.trim(c))
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(v, i, 1), F.lit(2)) for i in (2, 3, 4)])
    return F.when(v.rlike(r"^#[0-9a-f]{6}\z"), v).when(v.rlike(r"^#[0-9a-f]{3}\z"), short)


def channels(c: Column) -> list[Column]:
    """Red, green and blue of a colour, of the fallback if it isn't one."""
    v = F.coalesce(normalize_hex(c), F.lit(FALLBACK))
    return [F.conv(F.substring(v, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def _ramp(t: float, rules: Rules) -> str:
    """percent_color of 0..1, by the same steps."""
    low, mid, high = ([int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in (_hex(x) for x in (rules.low, rules.mid, rules.high)))
    ends, local = ((low, mid), t * 2) if t < 0.5 else ((mid, high), (t - 0.5) * 2)
    return "rgb(" + ",".join(str(max(0, min(255, math.floor(a + (b - a) * local + 0.5)))) for a, b in zip(*ends, strict=True)) + ")"


def _hex(color: str) -> str:
    """#rrggbb of a colour, of the fallback if it isn't one."""
    v = color.strip().lower()
    if re.fullmatch("#[0-9a-f]{3}", v):
        return "#" + "".join(c * 2 for c in v[1:])
    return v if re.fullmatch("#[0-9a-f]{6}", v) else FALLBACK


def percent_color(ratio: Column, rules: Rules) -> Column:
    """rgb(...) between low, mid and high for 0..1; no number counts as 0. Whole percentages are looked up, others computed."""
    t = F.when(ratio.isNull() | F.isnan(ratio) | (F.abs(ratio) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    known = F.array(*[F.lit(_ramp(i / 100, rules)) for i in range(101)])
    low, mid, high = (channels(F.lit(x)) for x in (rules.low, rules.mid, rules.high))

    def computed(t: Column) -> Column:
        below, local = t < 0.5, F.when(t < 0.5, t * 2).otherwise((t - 0.5) * 2)
        parts = []
        for a, b, c in zip(low, mid, high, strict=True):
            start, end = F.when(below, a).otherwise(b), F.when(below, b).otherwise(c)
            parts.append(F.greatest(F.lit(0), F.least(F.lit(255), js.rounded(start + (end - start) * local))).cast("string"))
        return F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))

    def one(t: Column) -> Column:
        whole = F.floor(t * 100 + 0.5)
        return F.when(whole / 100 == t, F.get(known, whole.cast("int"))).otherwise(computed(t))

    return js.let(t, one)


def _ratios(found: Column, between: Column, rules: Rules) -> Column:
    """array<double>: of percentages found and the texts between them."""
    numbers = F.transform(found, lambda m: F.rtrim(m, F.lit("%")).cast("double"))
    if not rules.pair_max:
        return F.transform(numbers, lambda v: F.least(F.lit(1.0), v / 100))

    def joined(s: Column) -> Column:
        """Of each number: does it pair with the next, if the last one didn't pair with it?"""
        values, gaps = s["values"], s["gaps"]
        pairs = F.zip_with(values, gaps, lambda v, g: F.coalesce(js.utf16_length(g) <= 6, F.lit(False)) & F.coalesce(g.rlike(PAIR_GAP), F.lit(False)))
        able = F.zip_with(pairs, F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda p, following: F.coalesce(p & (following > 0), F.lit(False)))
        first = F.aggregate(able, F.array().cast("array<boolean>"), lambda a, j: F.concat(a, F.array(j & ~F.coalesce(F.get(a, F.size(a) - 1), F.lit(False)))))
        return F.struct(values.alias("values"), first.alias("first"))

    def ratios(s: Column) -> Column:
        values, first = s["values"], s["first"]
        return F.transform(values, lambda v, i: F.when(F.get(first, i), F.least(F.lit(1.0), v / F.get(values, i + 1))).when((i > 0) & F.coalesce(F.get(first, i - 1), F.lit(False)), F.lit(1.0)).otherwise(F.least(F.lit(1.0), v / 100)))

    given = F.struct(numbers.alias("values"), F.slice(between, 2, 1 << 30).alias("gaps"))
    return js.let(js.let(given, joined), ratios)


def percent_ratios(text: Column, rules: Rules) -> Column:
    """array<double>: the ratio of each percentage; `a% of b%` counts as a / b and 1, pairs taken from the left."""
    return _ratios(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0)), F.split(text, PERCENT, -1), rules)


def tag_percents(html: Column, rules: Rules) -> Column:
    if not rules.percent:
        return html
    weight = "font-weight:700;" if rules.bold else ""

    def coloured(s: Column) -> Column:
        found, between = s["found"], s["between"]
        spans = F.zip_with(found, _ratios(found, between, rules), lambda m, r: F.concat(F.lit(f'<span class="pct" style="{weight}color:'), percent_color(r, rules), F.lit('">'), m, F.lit("</span>")))
        return F.array_join(F.zip_with(between, spans, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def stretch(t: Column) -> Column:
        # Each percentage is found once, and texts without one are left alone
        once = F.struct(F.regexp_extract_all(t, F.lit(PERCENT), F.lit(0)).alias("found"), F.split(t, PERCENT, -1).alias("between"))
        return F.when(t.contains("%"), js.let(once, coloured)).otherwise(t)

    return js.let(html, lambda h: F.when(h.contains("%"), outside_spans(h, stretch)).otherwise(h))


def style_stat(text: Column, rules: Rules) -> Column:
    return tag_percents(tag_keywords(tag_rarities(escape_html(text), rules), rules), rules)


def luminance(c: Column) -> Column:
    linear = lambda x: F.when(x / 255 <= 0.03928, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = map(linear, channels(c))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def perceived(c: Column) -> Column:
    r, g, b = channels(c)
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def check_color(c: Column, least: float = MIN_CONTRAST) -> Column:
    """struct(on_white, on_black, ok, fails)."""
    white, black = contrast(c, F.lit("#ffffff")), contrast(c, F.lit("#000000"))
    light, dark = white < least, black < least
    fails = F.when(light & dark, "both").when(light, "light").when(dark, "dark")
    return F.struct(white.alias("on_white"), black.alias("on_black"), (~light & ~dark).alias("ok"), fails.alias("fails"))


def tag_matches(texts: DataFrame, words: DataFrame, id_: str, text: str) -> DataFrame:
    """id, word, class, n: how often each known word stands in brackets; words(word, ord, class), the last of equal words
    counts. A dictionary join on the exploded tags; Spark broadcasts the words if they are small."""
    rules = words.groupBy(F.lower("word").alias("word")).agg(F.max_by("class", "ord").alias("class"))
    tags = texts.select(id_, F.explode(F.regexp_extract_all(text, F.lit(RARITY_TAG), F.lit(0))).alias("_m"))
    keyed = tags.select(id_, F.lower(js.trim(F.substring("_m", F.lit(2), F.length("_m") - 2))).alias("word"))
    return keyed.join(rules, "word").groupBy(id_, "word", "class").agg(F.count("*").alias("n"))
