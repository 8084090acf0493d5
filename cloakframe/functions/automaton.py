"""Search for many strings at once: an Aho-Corasick automaton in Arrow batches, where an alternation would try value by value."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: As tokens.TOKEN, which blanks what may hold parts of values.
_TOKEN = re.compile(r"<<[A-Z_]+_[0-9]{2,}>>")


def is_word(c: str) -> bool:
    """[\\p{L}\\p{N}_], as functions.text has it."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


class Matcher:
    """Occurrences of some values. `guarded`: none that starts or ends inside a word, where the value's own end is a word's."""

    def __init__(self, values: Iterable[str], guarded: bool = True) -> None:
        self.automaton = ahocorasick.Automaton()
        for value in values:
            if value:
                self.automaton.add_word(value, (value, guarded and is_word(value[0]), guarded and is_word(value[-1])))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def __bool__(self) -> bool:
        return self.any

    def matches(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, value), without overlaps: the leftmost, and of those that start there the longest."""
        if not self.any:
            return
        best: dict[int, str] = {}
        n = len(text)
        for last, (value, left, right) in self.automaton.iter(text):
            start = last + 1 - len(value)
            if (left and start and is_word(text[start - 1])) or (right and last + 1 < n and is_word(text[last + 1])):
                continue
            if len(value) > len(best.get(start, "")):
                best[start] = value
        at = 0
        for start in sorted(best):
            if start >= at:
                yield start, best[start]
                at = start + len(best[start])

    def present(self, text: str) -> set[str]:
        """The values that stand in a text, inside words too."""
        return {v[0] for _, v in self.automaton.iter(text)} if self.any else set()

    def replaced(self, text: str, by: dict[str, str | None]) -> tuple[str | None, int]:
        """(text with every match replaced, number of matches); the text is None if a value has nothing to stand for it."""
        out, at, n = [], 0, 0
        for start, value in self.matches(text):
            if by.get(value) is None:
                return None, n
            out += (text[at:start], by[value])
            at, n = start + len(value), n + 1
        return "".join([*out, text[at:]]), n


def _substituted(text: str, values: list[str], by: dict[str, str | None], spans: list | None) -> tuple[str | None, int, list[str]]:
    search = Matcher(values)
    if spans is None:
        out, n = search.replaced(text, by)
    else:
        parts, at, n = [], 0, 0
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            if start >= at:
                inside, more = search.replaced(text[start:end], by)
                if inside is None:
                    return None, n, []
                parts += (text[at:start], inside)
                at, n = end, n + more
        out = "".join([*parts, text[at:]])
    if out is None:
        return None, n, []
    present = Matcher(values, guarded=False).present(_TOKEN.sub(lambda m: " " * len(m[0]), out))
    return out, n, [v for v in values if v in present]


def _rows(text: pd.Series, values: pd.Series, keys: pd.Series, tokens: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for t, v, k, to, s in zip(text, values, keys, tokens, spans, strict=True):
        rows.append((None, None, None) if v is None else _substituted(t, list(v), dict(zip(k, to, strict=True)), None if s is None else list(s)))
    return pd.DataFrame(rows, columns=["text", "n", "leaks"])


def substituted(text: Column, values: Column, mapping: Column, spans: Column) -> Column:
    """struct<text, n, leaks> of rows with values (null: a null struct), a map of their tokens, and spans or null."""
    made = F.pandas_udf(_rows, "struct<text:string,n:int,leaks:array<string>>")
    return made(text, values, F.map_keys(mapping), F.map_values(mapping), spans)
