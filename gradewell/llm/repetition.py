"""Quality rules on repetition inside a text, by suffix arrays over its words.

All texts of a batch are one array of word numbers.  Prefix doubling sorts the suffixes within each
text (only groups that are still tied are sorted again) and keeps the class of each place for every
power of two, from which the longest common prefix (LCP) of neighbours in the suffix array follows
by binary descent.  For each place the longer LCP of its two neighbours is the depth of the
innermost LCP interval around its suffix: the longest repeated substring that starts there.  Every
occurrence of a maximal repeat is such a span or part of one, so the union of these spans is the
union of all maximal repeats.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
GROUP_WORDS = 1 << 19  # words whose suffixes are sorted together


def suffix_repeats(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest repeated substring that starts at each place, within its own text.

    ``words`` are the word numbers of consecutive texts of ``sizes`` words.
    """
    n = len(words)
    depth = np.zeros(n, dtype=np.int64)
    if n < 2:
        return depth
    ends = np.repeat(np.cumsum(sizes), sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")

    def ranks(sorted_keys, places):
        """Rank of sorted entries: the place of the first equal one."""
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        return places[np.flatnonzero(new)][np.cumsum(new) - 1]

    rank = np.empty(n, dtype=np.int64)
    rank[order] = ranks(key[order], np.arange(n))
    levels, h = [rank.copy()], 1
    while True:
        size = np.bincount(rank, minlength=n)
        places = np.flatnonzero(size[rank[order]] > 1)  # still tied, in suffix order
        if not len(places):
            break
        at = order[places]
        nxt = at + h
        follow = np.where(nxt < ends[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + follow
        by = np.argsort(pair, kind="stable")
        order[places] = at[by]
        rank[at[by]] = ranks(pair[by], places)
        levels.append(rank.copy())
        h *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < ends[order[:-1][live]]) & (b < ends[order[1:][live]])
        same = np.flatnonzero(inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]))
        if k and len(same):  # equal classes of suffixes that both end early are shorter than 2 ** k
            step = 1 << k
            same = same[(a[same] + step <= ends[order[:-1][live[same]]]) & (b[same] + step <= ends[order[1:][live[same]]])]
        got[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[live] = got
    depth[order[:-1]] = lcp
    depth[order[1:]] = np.maximum(depth[order[1:]], lcp)
    return depth


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _measure(texts: list[str], min_words: int):
    """Per text: n_words, n_repeat_words, covered words and longest repeat of at least min_words."""
    out = np.zeros((len(texts), 4), dtype=np.int64)

    def settle(rows, lists):
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        n = int(sizes.sum())
        out[rows, 0] = sizes
        if not n:
            return
        number: dict[bytes, int] = {}
        words = np.fromiter(map(number.setdefault, (w for x in lists for w in x), count()), dtype=np.int64, count=n)
        depth = suffix_repeats(words, sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        three = np.flatnonzero(depth >= 3)
        out[rows, 1] = np.bincount(text[_covered(three, np.full(len(three), 3), n)], minlength=len(sizes))
        long = np.flatnonzero(depth >= min_words)
        out[rows, 2] = np.bincount(text[_covered(long, depth[long], n)], minlength=len(sizes))
        best = np.zeros(len(sizes), dtype=np.int64)
        np.maximum.at(best, text[long], depth[long])
        out[rows, 3] = best

    lists, rows, total = [], [], 0
    for i, text in enumerate(texts):
        words = text.encode().split()  # ASCII white space alone separates words
        lists.append(words)
        rows.append(i)
        total += len(words)
        if total >= GROUP_WORDS:
            settle(np.array(rows), lists)
            lists, rows, total = [], [], 0
    if rows:
        settle(np.array(rows), lists)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """Counts of each row's whole text: the base counts, ``repeat_covered`` and ``longest_repeat``.

    Words are runs outside ASCII white space.  ``repeat_covered`` is the number of words in the union
    of maximal repeated substrings of at least ``min_words`` words, ``longest_repeat`` the length of
    the longest of them (0 if none).  Null and empty texts have zero everywhere; rows keep their
    count, whatever repeats among ids or texts.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            four = _measure(texts, min_words)
            blank = [sum(t.count(c) for c in " \t\n\x0b\x0c\r") for t in texts]
            symbols = [sum(t.count(c) for c in SYMBOLS) for t in texts]
            dup = []
            for t in texts:
                lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
                dup.append(len(lines) - len(set(lines)))
            cols = [four[:, 0], np.array([len(t) - b for t, b in zip(texts, blank)], dtype=np.int64), np.array(symbols, dtype=np.int64), np.array(dup, dtype=np.int64), *four[:, 1:].T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=[id_col, *NAMES])

    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in NAMES))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_covered: float = 0.2, max_longest: int = 50) -> DataFrame:
    """``repetition`` with ``base_failed`` and ``kept``.

    Base: under 50 words, or over half of the words in three-word windows found twice or more.  A row
    that passes is kept if repeats cover at most ``max_covered`` of its words and the longest has at
    most ``max_longest`` words.  A covered word is also one of a repeated three-word window, so only a
    ``max_covered`` below the base's half decides anything.  A fifth: a tenth of the text in passages
    of ``min_words`` said before (the usual limit on ten-word windows), and as much where they are
    said first.  50 words: from there on, deduplication by suffix arrays takes a passage for a copy.
    """
    out = repetition(docs, id_col, text_col, min_words)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = (F.col("repeat_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)
