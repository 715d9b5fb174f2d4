"""Decomposition of run-together strings by dictionary words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.text import shortest_word
from colweave.operators.search import contained_words
from colweave.storage import map_batches

#: Scores that are equal to so many digits are ties.
DIGITS = 9


def places(text: str, words: list[str]) -> list[tuple[int, int]]:
    """All [from, to) of the text where one of the words stands."""
    found = set()
    for w in words:
        at = text.find(w)
        while at >= 0:
            found.add((at, at + len(w)))
            at = text.find(w, at + 1)
    return sorted(found)


def best_segmentations(text: str, words: list[str], best: int = 3) -> list[tuple[str, str, float]]:
    """(segments, words among them, score) of the best segmentations with a score above 0, segments and words joined by spaces.

    A segmentation cuts a text into words and gaps; it is maximal, as no gap holds a word. Its score is the share of letters that words cover, times 1 less the segments for each
    letter; spaces within a segment part it as well. A dynamic programme goes over the places of the text: for each place, kind of the last segment, and number of segments it keeps the `best`
    with the most letters covered, of equal ones the first by name: what is put behind two of them keeps their order. So the work grows with places, words and segments, not with
    the number of segmentations.
    """
    n = len(text)
    ends: dict[int, list[int]] = {}
    until = [n] * (n + 1)  # a gap that starts at a place ends here at the latest, before it would hold a word
    for a, b in places(text, words):
        ends.setdefault(a, []).append(b)
        until[a] = min(until[a], b - 1)
    for i in range(n - 1, -1, -1):
        until[i] = min(until[i], until[i + 1])
    starts = sorted({*ends, n})
    # (kind of the last segment: 0 a gap, 1 a word) -> segments -> [(-covered, segments joined, words joined)]
    states: list[tuple[dict, dict]] = [({}, {}) for _ in range(n + 1)]
    states[0][1][0] = [(0, "", "")]

    def put(at: int, kind: int, more: int, came: list[tuple], part: str, covered: int) -> None:
        own = states[at][kind].setdefault(more, [])
        for c, full, known in came:
            new = (c - covered, f"{full} {part}" if full and part else full or part, (f"{known} {part}" if known else part) if covered else known)
            same = next((o for o in own if o[1] == new[1]), None)  # words with spaces may cover more of the same segments
            if same is None or new < same:
                own.append(new)
                if same:
                    own.remove(same)
        own.sort()
        del own[best:]

    for i in range(n):
        for kind in (0, 1):
            for m, came in states[i][kind].items():
                for b in ends.get(i, ()):
                    w = text[i:b]
                    put(b, 1, m + 1 + w.count(" "), came, w, len(w) - w.count(" "))
                if kind:  # a gap follows words only, up to the next word's start or the end
                    for j in starts:
                        if j > until[i]:
                            break
                        if j > i:
                            gap = text[i:j].strip(" ")
                            put(j, 0, m + (1 + gap.count(" ") if gap else 0), came, gap, 0)
    found: dict[str, tuple[str, float]] = {}
    for kind in (0, 1):
        for m, own in states[n][kind].items():
            for c, full, known in own:
                score = -c / n * (1 - m / n)
                if score > 0 and (full not in found or found[full][1] < score):
                    found[full] = (known, score)
    ranked = sorted(found.items(), key=lambda x: (-round(x[1][1], DIGITS), x[0]))[:best]
    return [(full, known, score) for full, (known, score) in ranked]


def decompose(strings: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", word: str = "word", best: int = 3) -> DataFrame:
    """(key, segments, score, rank): the best segmentations of each string, in lower case, by words of a dictionary that are long enough for it; of equal scores the first by name. Equal strings are cut once."""
    lower = strings.select(F.col(key).alias("k"), F.lower(text).alias("t"))
    found = contained_words(lower.select("t").distinct(), dictionary.select(F.col(word).alias("w")), "t", "t", "w")
    grouped = found.where(F.length("w") >= shortest_word("t")).groupBy("t").agg(F.array_sort(F.collect_set("w")).alias("ws"))  # words of one string

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, *s, i + 1) for t, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, s in enumerate(best_segmentations(t, ws, best))]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32()))], ["t", "segments", "words", "score", "rank"])

    parts = map_batches(grouped, cut, "t string, segments string, words string, score double, rank int")
    return lower.join(parts, "t").select(F.col("k").alias(key), "segments", "score", "rank").distinct()
