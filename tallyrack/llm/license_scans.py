"""Licence mentions: exact phrases, and short notices with a few errors.

A notice of n letters may have n // 12 errors (insertions, deletions, substitutions).  Cut into
one piece more than that, at least one piece stands unharmed in the text; an Aho-Corasick pass
finds the pieces, and only around them the regex library's bounded-error matching looks for the
whole notice and reports how many errors and which words it spans.

All of this runs on the words of a text (A-Z lower-cased) joined by single spaces.  Null and
empty texts have no words, empty labels and score 0.  Every row is scanned by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_rows

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings of well-known notices, as words, and labels of this method.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "redistribution and use in source and binary forms with or without modification": "bsd-notice",
    "subject to the terms of the mozilla public license": "mpl-notice",
}

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LETTERS_AN_ERROR = 12


class LicenceScanner:
    def __init__(self):
        import ahocorasick
        import regex

        self.phrases = [(p.split(" "), label) for p, label in PHRASES.items()]
        self.seeds = ahocorasick.Automaton()
        self.notices = []
        where: dict[str, list] = {}
        for k, (notice, label) in enumerate(NOTICES.items()):
            errors = len(notice) // LETTERS_AN_ERROR
            pattern = regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}", regex.BESTMATCH)
            self.notices.append((notice, label, errors, pattern))
            cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(notice[a:b], []).append((k, a))
        for seed, places in where.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def notices_in(self, joined: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, errors, likeness) of notices in text of single-spaced words."""
        tried: dict[int, list[int]] = {}
        for last, (size, places) in self.seeds.iter(joined):
            for k, offset in places:
                tried.setdefault(k, []).append(last - size + 1 - offset)
        found = []
        for k, starts in tried.items():
            notice, label, errors, pattern = self.notices[k]
            reach = -1
            for start in sorted(starts):
                if start + errors < reach:
                    continue
                low = max(0, start - errors)
                m = pattern.search(joined, max(low, reach), start + len(notice) + errors)
                if m:
                    n = sum(m.fuzzy_counts)
                    found.append((label, m.start(), m.end(), n, 1 - n / len(notice)))
                    reach = m.end()
        return sorted(found, key=lambda x: (x[1], x[0], x[2]))

    def scan(self, text: str) -> dict:
        words = WORD.findall(text.encode().lower().decode())
        places, base = [], set()
        if "license" in words:
            for i, w in enumerate(words):
                if w == "license":
                    for phrase, label in self.phrases:
                        at = i - len(phrase) + 1
                        if at >= 0 and words[at : i + 1] == phrase:
                            places.append(at)
                            base.add(label)
        joined = " ".join(words)
        notices = self.notices_in(joined)
        spans = []
        if notices:
            starts, at = [], 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
            for label, a, b, n, _ in notices:
                spans.append(f"{label}:{bisect_right(starts, a) - 1}:{bisect_right(starts, b - 1)}:{n}")
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {x[0] for x in notices})),
            "score": 1.0 if places else max((x[4] for x in notices), default=0.0),
            "notices": ",".join(spans),
        }


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: number of words, places and labels of phrases, labels and spans
    (label:first word:word after the last:errors) of notices, and a score."""

    def make():
        scanner = LicenceScanner()

        def work(columns):
            rows = [scanner.scan(t or "") for t in columns[1]]
            return {"doc_id": columns[0]} | {c: [r[c] for r in rows] for c in rows[0]}

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(
        df,
        make,
        [id_col, text_col],
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices string",
    )
