"""License scans: short notices found with a bounded number of edits.

A text becomes its words in lower case joined by single spaces, so line breaks, punctuation and comment marks between words count for
nothing. A notice that may have k edits is split into 2k pieces; whatever lies within k edits of it holds k of the pieces unchanged
(pigeonhole), none shifted by more than k. One automaton over all pieces of all notices passes over the text once; where so many
seeds agree, the regex library matches the notice with at most k errors, best match first, and its counts give the edits. Notices
without edits are their own piece, bounded by words. Notices are a list that the caller gives (they travel with the task, so it is
one of thousands, not of rows).

A document is one row and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: A notice may differ by one character in so many.
PER_EDIT = 10
SPAN = "struct<label:string,exact:boolean,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:bigint,likeness:double>"
FOUND = f"n_words bigint, spans array<{SPAN}>"

#: Short notices by label; numbers of versions are words of their own.
NOTICES = [
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# bytes of words: digits, letters and everything beyond ASCII; A-Z become a-z, the rest separates
_TO_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_ANY_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int

    @staticmethod
    def fuzzy(label: str, text: str, per_edit: int = PER_EDIT) -> Notice:
        """A notice that may differ by one character in `per_edit`."""
        return Notice(label, joined_words(text)[1].strip(), max(1, len(text) // per_edit))

    @staticmethod
    def exact(label: str, text: str) -> Notice:
        return Notice(label, joined_words(text)[1].strip(), 0)


def joined_words(text: str) -> tuple[int, str]:
    """Number of words, and the words in lower case with a space before, between and after them."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    return len(words), f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else " "


class Scanner:
    """Finds the given notices in texts; made once for each task."""

    def __init__(self, notices: list[Notice]) -> None:
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for k, n in enumerate(notices):
            if not n.edits:
                pieces.setdefault(f" {n.text} ", []).append((k, 0, -1))
                continue
            cuts = [len(n.text) * i // (2 * n.edits) for i in range(2 * n.edits + 1)]
            if not all(b > a for a, b in zip(cuts, cuts[1:])):
                raise ValueError(f"a notice of {len(n.text)} characters can't have {n.edits} edits")
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                pieces.setdefault(n.text[a:b], []).append((k, i, a))
        self.machine = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.machine.add_word(piece, (len(piece), of))
        if pieces:
            self.machine.make_automaton()

    def _hits(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """By notice, where it would begin according to its pieces, and which piece says so."""
        hits: dict[int, list[tuple[int, int]]] = {}
        if self.notices:
            for end, (size, of) in self.machine.iter(text):
                for k, piece, offset in of:
                    hits.setdefault(k, []).append((end + 1 - size - offset, piece))
        return hits

    def _windows(self, k: int, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """(low, high) of places that may hold the notice: so many of its pieces stand there, none shifted by more than its edits."""
        size, most = len(self.notices[k].text), self.notices[k].edits
        hits, last, count, pieces = sorted(hits), 0, 0, {}
        for i, (begin, piece) in enumerate(hits):
            while last < len(hits) and hits[last][0] <= begin + 2 * most:
                pieces[hits[last][1]] = pieces.get(hits[last][1], 0) + 1
                count += pieces[hits[last][1]] == 1
                last += 1
            if count >= most and (i == 0 or begin != hits[i - 1][0]):
                yield begin - most, begin + size + 2 * most
            pieces[piece] -= 1
            count -= not pieces[piece]

    def _verified(self, k: int, hits: list[tuple[int, int]], text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the notice's matches in its windows, outside the places taken; no two overlap."""
        size, most, done = len(self.notices[k].text), self.notices[k].edits, 0
        free = list(zip([0, *(b for _, b in taken)], [*(a for a, _ in taken), len(text)]))
        for low, high in self._windows(k, hits):
            for first, last in free:
                a, b = max(low, first, done), min(high, last)
                if b - a >= size - most and (match := self.patterns[k].search(text, a, b)):
                    # the window of other seeds may have cut the match off
                    match = self.patterns[k].search(text, max(match.start() - most, first, done), min(match.start() + size + 2 * most, last)) or match
                    done = match.end()
                    yield match.start(), match.end(), sum(match.fuzzy_counts)

    def scan(self, source: str) -> tuple[int, list[dict]]:
        """Number of words and the spans found.

        Exact notices are reported wherever they stand, overlaps too. Of the others the unchanged ones are taken first, the longest before
        shorter ones that overlap it; then, in what is left, the one with the fewest edits of those that overlap, then the
        longest, then the first by place and label.
        """
        n_words, text = joined_words(source)
        hits = self._hits(text)
        fuzzy = [k for k in hits if self.notices[k].edits]
        found = [(begin, begin + len(self.notices[k].text), 0, k) for k in hits if not self.notices[k].edits for begin, _ in hits[k]]
        taken: list[tuple[int, int]] = []

        def take(spans: list[tuple[int, int, int, int]]) -> None:
            for low, high, edits, k in sorted(spans, key=lambda s: (s[2], s[0] - s[1], s[0], self.notices[s[3]].label, s[3])):
                if all(high <= a or b <= low for a, b in taken):
                    taken.append((low, high))
                    found.append((low, high, edits, k))

        whole = {(begin, k) for k in fuzzy for begin, _ in hits[k] if begin >= 0 and text.startswith(self.notices[k].text, begin)}
        take([(begin, begin + len(self.notices[k].text), 0, k) for begin, k in whole])
        left = sorted(taken)
        take([(low, high, edits, k) for k in fuzzy for low, high, edits in self._verified(k, hits[k], text, left)])
        if not found:
            return n_words, []
        places = [m.span() for m in _ANY_WORD.finditer(source)]
        spans, at, words = [], 0, 0
        for low, high, edits, k in sorted(found):
            words, at = words + text.count(" ", at, low + 1), low + 1
            first = words - 1  # a match may begin or end on the space beside a word
            last = first + text[low:high].strip(" ").count(" ")
            notice = self.notices[k]
            span = {"label": notice.label, "exact": not notice.edits, "first_word": first, "last_word": last, "start": places[first][0], "end": places[last][1]}
            spans.append(span | {"edits": edits, "likeness": 1 - edits / len(notice.text)})
        return n_words, spans


def scan_licenses(documents: DataFrame, notices: list[Notice] | None = None, text_col: str = "text") -> DataFrame:
    """`documents` with `n_words` and `spans` (label, exact, first and last word, start and end in code points of the text, edits,
    likeness; in order of place) in place of columns of these names.

    Null and empty texts have no words and no spans. A text is searched whole, however long. Every row stays, repeated rows and
    ids too, each judged alone; an empty table gives no rows.
    """
    notices = [Notice.fuzzy(*n) for n in NOTICES] if notices is None else notices

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for texts in batches:
            found = [scanner.scan(t) for t in texts]
            yield pd.DataFrame({"n_words": [n for n, _ in found], "spans": [s for _, s in found]})

    rest = [c for c in documents.columns if c not in ("n_words", "spans")]
    found = documents.select(*rest, scan(text_of(text_col)).alias("_found"))
    return found.select(*rest, "_found.n_words", "_found.spans")
