"""Dictionaries of many phrases: an automaton over all of them reads a text once, however many there are.

An alternation in a regular expression tries its phrases one by one at each place, so its time grows with the dictionary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.folds import ordered_fold
from folio.runtime import slices

#: Bytes of phrases that one automaton takes; more are several automata over the same texts.
MOST_BYTES = 32 << 20
_FOLD = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, "-": " "})


def folded(phrase: str) -> str:
    """A-Z as a-z, and each hyphen as a space: the form in which phrases and texts are compared, of the same length."""
    return phrase.translate(_FOLD)


class Phrases:
    """An automaton over phrases; of phrases with one folded form the last one counts."""

    def __init__(self, phrases: Iterable[tuple[str, object]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, value in phrases:
            form = folded(phrase)
            if form:
                self.automaton.add_word(form, (len(form), value))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, object]]:
        """(start, end, value) of all phrases that stand between no two letters a-z, in the order of their ends."""
        if self.empty:
            return
        low, n = folded(text), len(text)
        letter = lambda i: 0 <= i < n and "a" <= low[i] <= "z"
        for last, (size, value) in self.automaton.iter(low):
            start = last + 1 - size
            if not letter(start - 1) and not letter(last + 1):
                yield start, last + 1, value

    def chosen(self, text: str) -> list[tuple[int, int, object]]:
        """Matches from the left, the longest at each place, that don't overlap."""
        out, free = [], 0
        for start, end, value in sorted(self.matches(text), key=lambda m: (m[0], -m[1])):
            if start >= free:
                out.append((start, end, value))
                free = end
        return out


def replaced(phrases: dict[str, str], wrap: Callable[[str, str], str]) -> Callable[[str], str]:
    """text -> text with its chosen matches m as wrap(m, the phrase's value)."""
    made = Phrases(phrases.items())

    def run(text: str) -> str:
        out, at = [], 0
        for start, end, value in made.chosen(text):
            out += [text[at:start], wrap(text[start:end], value)]
            at = end
        return "".join([*out, text[at:]]) if out else text

    return run


def phrase_matches(texts: DataFrame, id_: str, text: str, phrases: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id_, start (from 0), size, phrase (folded), class of the matches in texts(id_, text), from the left and the longest
    first; phrases(phrase, ord, class), the last by ord of equal ones counts. Null texts and empty phrases match nothing.

    The dictionary's bytes are counted first. What fits most_bytes is one automaton; a larger one is dealt into as many as
    it takes by the phrases' hash, each reads all texts, and their matches are chosen from together."""
    form = F.translate("phrase", "ABCDEFGHIJKLMNOPQRSTUVWXYZ-", "abcdefghijklmnopqrstuvwxyz ")
    known = phrases.select(form.alias("phrase"), "ord", "class").where("phrase <> ''").groupBy("phrase").agg(F.max_by("class", "ord").alias("class"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("class")), F.lit(0))).first()[0]
    n = max(1, -(-size // most_bytes))
    kind = texts.schema[id_].dataType.simpleString()
    found = None
    for part in range(n):
        some = known if n == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == part)
        rows = [(r["phrase"], r["class"]) for r in some.toLocalIterator()]
        held = texts.sparkSession.sparkContext.broadcast(rows)
        one = texts.select(id_, text).mapInArrow(_matcher(held, id_, text, n == 1), f"{id_} {kind}, start int, size int, phrase string, class string")
        found = one if found is None else found.unionByName(one)
    if n == 1:
        return found

    def step(free: int, start: int, size: int) -> tuple[int, tuple[bool]]:
        return (start + size, (True,)) if start >= free else (free, (False,))

    chosen = ordered_fold(found.withColumn("_least", -F.col("size")), [id_], ["start", "_least"], ["start", "size"], lambda: 0, step, "_chosen boolean")
    return chosen.where("_chosen").drop("_least", "_chosen")


def _matcher(held, id_: str, text: str, choose: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = Phrases((p, (p, c)) for p, c in held.value)
        for batch in (part for b in batches for part in slices(b, text)):
            rows, at = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                for start, end, (phrase, cls) in (made.chosen if choose else made.matches)(t or ""):
                    rows.append((start, end - start, phrase, cls))
                    at.append(i)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(id_).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], names=[id_, "start", "size", "phrase", "class"])

    return run


def replace_phrases(c: Column, phrases: dict[str, str], wrap: Callable[[str, str], str], outside: str) -> Column:
    """c with its chosen matches wrapped, but for what lies in matches of the pattern `outside`."""
    made: list = []

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(replaced(phrases, wrap))
        one, kept = made[0], re.compile(f"({outside})")
        apply = lambda t: None if t is None else "".join(x if i % 2 else one(x) for i, x in enumerate(kept.split(t)))
        return pd.Series([apply(t) for t in texts], dtype=object)

    return run(c)
