"""License scans: fuzzy search for short notices."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import map_batches, rows_of, table, type_of, words

# Phrases whose exact places count, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices, in words, the most edits allowed, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", 6, "mit-notice"),
    ("licensed under the mit license", 2, "mit-notice"),
    ("licensed under the apache license version 2 0", 4, "apache-notice"),
    ("under the terms of the gnu general public license", 4, "gpl-notice"),
    ("redistribution and use in source and binary forms", 4, "bsd-notice"),
    ("subject to the terms of the mozilla public license", 4, "mpl-notice"),
    ("licensed under a creative commons attribution", 4, "cc-notice"),
    ("all rights reserved", 1, "all-rights-reserved"),
)
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"
SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of the notice with their offsets: at most `edits` edits leave one of them whole."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def machine(notices: tuple[tuple[str, int, str], ...]):
    """An automaton for all seeds, and for each notice its pattern with bounded errors."""
    import ahocorasick
    import regex

    found: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, edits, _) in enumerate(notices):
        for offset, seed in seeds(notice, edits):
            found.setdefault(seed, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for seed, uses in found.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={edits}}}") for notice, edits, _ in notices]


def fuzzy(text: str, notices: tuple[tuple[str, int, str], ...]) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the notices' occurrences in text, those of one notice disjoint."""
    automaton, patterns = machine(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (length, uses) in automaton.iter(text):
        for i, offset in uses:
            start = end + 1 - length - offset
            lo, hi = max(0, start - notices[i][1]), min(len(text), start + len(notices[i][0]) + notices[i][1])
            own = windows.setdefault(i, [])
            if own and lo <= own[-1][1]:
                own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
            else:
                own.append([lo, hi])
    out = []
    for i, own in sorted(windows.items()):
        for lo, hi in own:
            out += [(i, m.start(), m.end(), sum(m.fuzzy_counts)) for m in patterns[i].finditer(text, lo, hi)]
    return out


def scan(text: str | None, notices: tuple[tuple[str, int, str], ...] = NOTICES) -> tuple:
    """A row of SCHEMA without its key."""
    tokens = words((text or "").encode())
    joined = (b" " + b" ".join(tokens) + b" ").decode("latin-1")  # a byte each, so offsets agree and search is quick
    base, labels, starts = set(), set(), []
    for phrase, label in BASE.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            base.add(label)
            starts.append(at)
            at = joined.find(f" {phrase} ", at + 1)
    hits = fuzzy(joined, notices)
    if not starts and not hits:
        return len(tokens), 0, None, None, [], [], 0.0, []
    # a character's place in `joined` to the number of its word, in one pass over the places asked for
    asked, number, seen, last = sorted({*starts, *(h[1] for h in hits), *(max(h[1], h[2] - 2) for h in hits)}), {}, -1, 0
    for at in asked:
        seen += joined.count(" ", last, at + 1)
        last, number[at] = at + 1, max(0, seen)
    at_word = [number[s] for s in starts]
    spans = []
    if hits:
        places = word_places(text)
        for i, start, end, edits in hits:
            first, final = min(number[start], len(tokens) - 1), min(number[max(start, end - 2)], len(tokens) - 1)
            labels.add(notices[i][2])
            spans.append({"label": notices[i][2], "start": places[first][0], "end": places[final][1], "edits": edits})
    score = 1.0 if starts else max(1 - h[3] / len(notices[h[0]][0]) for h in hits)
    return len(tokens), len(starts), min(at_word, default=None), max(at_word, default=None), sorted(base), sorted(base | labels), score, spans


def word_places(text: str) -> list[tuple[int, int]]:
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple[tuple[str, int, str], ...] = NOTICES) -> DataFrame:
    """Licence phrases and fuzzy notices of every whole text, with the spans of notices in characters of the text.

    Texts are searched as their lower-cased words joined by spaces. A notice may differ by its bound of edits: split
    into one more piece than that, one piece stands exactly; an automaton finds all pieces in one pass, and the bounded-error
    pattern is tried only around them. score: 1 with a base phrase, else 1 minus the edits' share of the best notice,
    0 without any. Of several ways to match a place the one with the fewest edits counts, of equal ones the leftmost. Rows are independent: nothing is shuffled, a row gives a row, repeated or with a null key, of any type. Null and empty texts have no words and score 0;
    an empty table gives none; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, notices) for t in rows_of(batch, "t")]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), SPAN]
            yield pa.record_batch([batch.column(0), *(pa.array([x[i] for x in found], k) for i, k in enumerate(kinds))], ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return map_batches(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {type_of(df, key)}, {SCHEMA}").withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents; labels comma-joined, spans counted."""
    out = license_scan(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base_labels"), join("labels"), "score", F.size("spans").cast("long").alias("n_spans"))
