"""License scans: exact seeds from a pigeonhole split find places, bounded-error matching verifies them.

A notice that may hold up to ``k`` edits is cut into ``k + 1`` pieces. At least one piece of every
accepted match is unedited, so looking for the pieces finds every candidate place; the ``regex``
library then matches the whole notice with at most ``k`` edits around that place and gives its span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame

from footstats.llm.common import map_rows

#: The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Short notices in normal form (lower-case words, single spaces), their label, the edits allowed, and the words that tell the
#: license from its neighbours: these stand as they are, edits lie around them only.
NOTICES = [
    ("mit", "released under the mit license", 3, "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7, ""),
    ("apache", "licensed under the apache license version 2 0", 4, "apache"),
    ("gpl", "licensed under the gnu general public license", 4, "gnu general public"),
    ("lgpl", "licensed under the gnu lesser general public license", 4, "lesser general public"),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2, "cc by nc"),
    ("cc-by", "licensed under a creative commons attribution", 4, "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 7, ""),
    ("mpl", "subject to the terms of the mozilla public license", 4, "mozilla"),
]

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label:string,start:long,end:long,errors:int>>"
)

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: bytes
    edits: int
    fixed: bytes
    seeds: tuple[tuple[int, bytes], ...]


def split_seeds(phrase: bytes, edits: int) -> tuple[tuple[int, bytes], ...]:
    """``edits + 1`` adjoining pieces of ``phrase`` with their offsets."""
    cuts = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return tuple((a, phrase[a:b]) for a, b in zip(cuts, cuts[1:]))


def prepared(notices: list[tuple]) -> list[Notice]:
    """Notices of (label, phrase, edits) or (label, phrase, edits, words that must stand as they are)."""
    return [Notice(label, p.encode(), k, (fixed or [""])[0].encode(), split_seeds(p.encode(), k)) for label, p, k, *fixed in notices]


def edited_pattern(notice: Notice):
    """Pattern of the phrase with bounded edits; its fixed words, and the blanks beside them, are taken literally."""
    if not notice.fixed:
        return regex.compile(b"(?:" + regex.escape(notice.phrase) + b"){e<=%d}" % notice.edits, regex.ENHANCEMATCH)
    at = notice.phrase.index(notice.fixed)
    before, after = notice.phrase[:at], notice.phrase[at + len(notice.fixed) :]
    around = [b"(?:" + regex.escape(x.strip(b" ")) + b"){e<=%d}" % notice.edits if x else b"" for x in (before, after)]
    fixed = (b" " if before else b"(?<![^ ])") + regex.escape(notice.fixed) + (b" " if after else b"(?![^ ])")
    return regex.compile(around[0] + fixed + around[1], regex.ENHANCEMATCH)


def normal_form(text: str | None) -> bytes:
    """Words of a text (ASCII letters lower-cased), one space before, between and after them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def windows(line: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged stretches of ``line`` that can hold a match, around each place of a seed."""
    size, k, found = len(notice.phrase), notice.edits, []
    for offset, seed in notice.seeds:
        at = line.find(seed)
        while at >= 0:
            found.append((max(0, at - offset - k - 1), min(len(line), at - offset + size + k + 1)))
            at = line.find(seed, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def fuzzy_matches(line: bytes, notice: Notice, pattern) -> list[tuple[int, int, int]]:
    """(start word, end word, edits) of the notice's matches, best first at each place, without overlap."""
    out = []
    for a, b in windows(line, notice):
        for m in pattern.finditer(line, a, b):
            if sum(m.fuzzy_counts) > notice.edits:
                continue  # the parts around fixed words share the bound
            start = line.count(b" ", 0, m.start() + 1) - 1
            end = line.count(b" ", 0, m.end()) - line.endswith(b" ", m.start(), m.end())
            out.append((start, max(end, start + 1), sum(m.fuzzy_counts)))
    return out


def scan_licenses(
    docs: DataFrame, notices: list[tuple] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: base places of license phrases, labels with fuzzy notices, and the spans found.

    Edits are counted in UTF-8 bytes of the normal form. ``matches`` holds fuzzy notices as word spans
    (end exclusive). ``score`` is 1 where a base phrase stands, else one minus the edits per byte of the
    best fuzzy match, else 0. Null or empty text: no words, no labels (empty strings), null places, score 0.
    Repeated ids give a row each; other columns of ``docs`` are not read. A map over rows: no shuffle, and
    whatever one source holds makes no difference.
    """
    wanted = prepared(NOTICES if notices is None else notices)
    base = [(f" {p} ".encode(), label) for p, label in BASE_PHRASES.items()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(n, edited_pattern(n)) for n in wanted]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                line = normal_form(text)
                places, base_labels = [], set()
                for phrase, label in base:
                    if phrase in line:
                        base_labels.add(label)
                        places += [line.count(b" ", 0, m.start()) for m in re.finditer(b"(?=" + re.escape(phrase) + b")", line)]
                matches, best = [], 1.0 if places else 0.0
                for notice, pattern in patterns:
                    for start, end, errors in fuzzy_matches(line, notice, pattern):
                        matches.append({"label": notice.label, "start": start, "end": end, "errors": errors})
                        best = max(best, 1.0 - errors / len(notice.phrase))
                labels = base_labels | {m["label"] for m in matches}
                matches.sort(key=lambda m: (m["start"], m["end"], m["label"]))
                rows.append((
                    doc_id, line.count(b" ") - 1, len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(labels)), best, matches,
                ))
            out = pd.DataFrame(rows, columns=[
                "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches",
            ])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            yield out

    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_rows(narrow, scan, SCHEMA).withColumnRenamed("doc_id", id_col)
