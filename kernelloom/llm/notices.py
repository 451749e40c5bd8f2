"""Licence scan by fuzzy search for short notices.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a text is searched as its
words joined by single blanks.

1.  Base phrases must occur as they are: their words stand consecutively.
2.  A notice may differ by up to k edits (inserted, deleted or replaced characters).  Split into k + 1
    parts, it keeps at least one part unchanged (pigeonhole), so the parts are exact seeds.  A window
    around each seed, as long as the notice and its edits, goes to the regex library's bounded-error
    matching, which verifies the edits and gives the best span.  Of spans of one notice that overlap, those
    of fewer edits stay, then the earlier ones; a window is never merged with another, so no match hides
    behind a better one beside it.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import small_batches
from kernelloom.llm.words import utf8

#: Phrases whose exact occurrences count, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    """A short notice in normal form (lower case, single blanks) and the edits it may have."""

    label: str
    text: str
    edits: int


#: Wording that licences and their short notices themselves use.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "licensed under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("mpl", "mozilla public license version 2 0", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 1),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 1),
    Notice("cc", "creative commons attribution", 3),
    Notice("proprietary", "all rights reserved", 2),
)

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normal_form(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return utf8(text).translate(_TO_WORDS).split()


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits + 1`` parts of about equal length, with their places in the notice."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled seeds and patterns; one a task."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}") for n in notices]
        self.letters = [tuple(Counter(n.text).items()) for n in notices]
        self.seeds = ahocorasick.Automaton()
        parts: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for part, at in seeds(notice.text, notice.edits):
                parts.setdefault(part, []).append((k, at))
        for part, owners in parts.items():
            self.seeds.add_word(part, (len(part), owners))
        self.seeds.make_automaton()
        # notices recur, and so do their windows
        self.best = functools.lru_cache(1 << 14)(self._best)

    def _best(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best match of notice k in a window.  Letters that the window lacks must be
        edited, so a window that lacks too many needs no search."""
        if sum(n - min(n, window.count(c)) for c, n in self.letters[k]) > self.notices[k].edits:
            return None
        m = self.patterns[k].search(window)
        return m and (sum(m.fuzzy_counts), m.start(), m.end())

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of notices in a normal form, without overlaps within one notice."""
        windows: set[tuple[int, int]] = set()
        for last, (length, owners) in self.seeds.iter(text):
            for k, at in owners:
                windows.add((k, last + 1 - length - at - self.notices[k].edits))
        spans: dict[int, set[tuple[int, int, int]]] = {}
        for k, a in windows:
            notice, at = self.notices[k], max(0, a)
            m = self.best(k, text[at : a + len(notice.text) + 2 * notice.edits])
            if m:
                spans.setdefault(k, set()).add((m[0], at + m[1], at + m[2]))
        found = set()
        for k, mine in spans.items():
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(mine):
                # the taken spans don't overlap, so only the neighbours can
                i = bisect.bisect(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    found.add((self.notices[k].label, a, b, edits))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def places(words: list[bytes], phrase: tuple[bytes, ...], joined: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively; ``joined`` has blanks all round."""
    out, at, count, seen = [], -1, 0, 0
    needle = b" " + b" ".join(phrase) + b" "
    while (at := joined.find(needle, at + 1)) >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        out.append(count)
    return out


def _blanks(text: str) -> np.ndarray:
    """Places of the blanks in a text, in order."""
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)


def scan_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """One row a document: doc_id, n_words, base (array of label, word) and fuzzy (array of label,
    first_word, last_word, edits, start, end, score).

    start and end are places in the words joined by single blanks.  A score is 1 - edits / (allowed
    edits + 1).  Null and empty texts have no words and no matches; very long texts are searched whole;
    repeated rows repeat; a null id stays null; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    phrases = [(tuple(p.encode() for p in phrase.split()), label) for phrase, label in base]
    allowed = {}
    for n in notices:
        allowed[n.label] = max(allowed.get(n.label, 0), n.edits)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                words = normal_form(text)
                joined = b" " + b" ".join(words) + b" "
                hits = [{"label": label, "word": p} for phrase, label in phrases for p in places(words, phrase, joined)]
                plain = joined[1:-1].decode("utf-8", "surrogatepass")
                found = scanner.fuzzy(plain)
                # a place's word number is the number of blanks before it
                first, last = (np.searchsorted(_blanks(plain), at).tolist() if at else [] for at in ([a for _, a, _, _ in found], [max(a, b - 1) for _, a, b, _ in found]))
                near = [
                    {"label": label, "first_word": u, "last_word": v, "edits": e, "start": a, "end": b, "score": 1 - e / (allowed[label] + 1)}
                    for (label, a, b, e), u, v in zip(found, first, last)
                ]
                rows.append((doc_id, len(words), hits, near))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "base", "fuzzy"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, base array<struct<label string, word long>>, fuzzy array<struct<label string, first_word long, last_word long, edits int, start long, end long, score double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(scan, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, fuzzy."""
    names = lambda c: F.transform(c, lambda m: m["label"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    at = F.transform("base", lambda m: m["word"])
    n = F.size("base").cast("long")
    near = F.coalesce(F.array_max(F.transform("fuzzy", lambda m: m["score"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        join(names("base")).alias("base_labels"), join(F.concat(names("base"), names("fuzzy"))).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(near).alias("score"), "fuzzy",
    )
