"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type model joins neighbouring pieces, always the best-scored candidate of the agenda first,
the leftmost of equals.  Here a candidate is skipped if a keyed hash of the seed, the text, its word,
the word's place in the text and its own in the word says so, which gives a varied but repeatable
segmentation: each occurrence of a word has its own.  A skip depends on nothing else, so a skipped
candidate is one that is never on the agenda, and any order of work gives the same pieces.

``merge_words`` settles the agendas of many words together in numpy: in each round every word makes
its best merge.  A long word is first cut where no piece of the vocabulary holds the two characters
side by side: no merge can cross such a place, so its parts have agendas of their own.  Only a part
that is long itself is done by ``merge_agenda``, with a heap.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SPACE = "▁"
LONG = 96  # characters from which a word is cut into parts, and a part has a heap of its own
_ALL = (1 << 64) - 1
GROUP_CHARS = 3 << 19
DEEP = 5  # merges that a case does without, at most; beyond, each occurrence merges by itself
SHARED = 2  # occurrences from which the merges of a case are made once for all
BLOCK = 1 << 14
MERGED_CHARS = 1 << 16
SLOT_BITS = 20
_MODELS: dict[str, Pieces] = {}


class Pieces:
    """Vocabulary of a merge-type model: pieces, byte pieces and the table of merges."""

    def __init__(self, name: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(n)]
        text = {m.id_to_piece(i): i for i in range(n) if not special[i]}
        score = [m.get_score(i) for i in range(n)]
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i in range(n):
            if m.is_byte(i):
                value = int(m.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not special[i]:
                self.bytes_of[i] = m.id_to_piece(i).replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("the vocabulary joins words: texts can't be split at spaces")
        # a unit: spaces and what follows up to the next space; line ends and tabs that no longer piece holds stand alone
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in text if len(p) > 1))
        self.units = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +")
        order = {p: r for r, p in enumerate(sorted((p for p in text if len(p) > 1), key=lambda p: (-score[text[p]], text[p])))}
        ids = dict(text)
        for p in order:  # a character that only occurs inside pieces gets a number beyond the vocabulary
            for c in p:
                ids.setdefault(c, n + len(ids))
        self.size = n + len(ids) + 1
        left, right, made, rank = [], [], [], []
        for p, r in order.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    left.append(ids[p[:k]])
                    right.append(ids[p[k:]])
                    made.append(text[p])
                    rank.append(r)
        keys = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        by = np.argsort(keys)
        self.keys, self.made, self.rank = keys[by], np.array(made, dtype=np.int64)[by], np.array(rank, dtype=np.int64)[by]
        self.merges = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        # where a pair's merge is, by a hash: -1 for none, -2 where several share the slot
        self.slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        slot = self._slot(self.keys)
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.flatnonzero(np.bincount(slot, minlength=1) > 1)] = -2
        self.char_id = np.full(0x110001, -1, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(" ")] = self.char_id[ord(SPACE)]
        self.char_id[ord(SPACE)] = -1  # a space mark in the text itself is spelt in bytes: decoding gives it back
        self.vocabulary = n
        side = {ids[a] * self.size + ids[b] for p in order for a, b in zip(p, p[1:])}
        self.side = np.array(sorted(side), dtype=np.int64)  # characters that stand side by side in some piece

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * _MUL >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def merge_of(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, at): the pairs that merge, and their merges' places in the table."""
        at = self.slots[self._slot(pair)]
        many = np.flatnonzero(at == -2)
        at[many] = np.minimum(np.searchsorted(self.keys, pair[many]), len(self.keys) - 1)
        which = np.flatnonzero(at >= 0)
        at = at[which]
        ok = self.keys[at] == pair[which]
        return which[ok], at[ok]

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where no piece holds the two characters side by side."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.side, pair), max(len(self.side) - 1, 0))
        return (left < 0) | (right < 0) | ((self.side[at] != pair) if len(self.side) else True)


def pieces(name: str) -> Pieces:
    if name not in _MODELS:
        _MODELS[name] = Pieces(name)
    return _MODELS[name]


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash skips the candidates [start, middle) + [middle, end)."""
    if dropout <= 0:
        return np.zeros(len(key), dtype=bool)
    return _below(key ^ _place(start, middle, end), dropout)


def _place(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A candidate's place in its word as one number."""
    return (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)


def _below(h: np.ndarray, dropout: float) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MUL
    return (h ^ (h >> np.uint64(31))) < np.uint64(_limit(dropout))


def _limit(dropout: float) -> int:
    return min(int(dropout * 2.0**64), _ALL)


def _skips(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    """``_skipped`` of one candidate."""
    h = (key ^ (start << 42) ^ (middle << 21) ^ end) & _ALL
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x9E3779B97F4A7C15 & _ALL
    return h ^ (h >> 31) < limit


def merge_agenda(model: Pieces, symbols: list[int], key: int, dropout: float, base: int = 0) -> list[tuple[int, int]]:
    """(id, start) of the pieces of one word, by a heap of candidates; ``base`` is its place in the word whose key it has."""
    n = len(symbols)
    sym, end, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []
    limit, known, width = _limit(dropout) if dropout > 0 else 0, model.merges.get, model.size

    def add(i):
        j = nxt[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0:
            hit = known(sym[i] * width + sym[j])
            if hit and not (limit and _skips(key, base + i, base + j, base + end[j], limit)):
                heapq.heappush(heap, (hit[0], i, j, end[j], hit[1]))

    for i in range(n - 1):
        add(i)
    alive = [True] * n
    while heap:
        _, i, j, stop, made = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j and end[j] == stop and end[i] == j):
            continue
        if known(sym[i] * width + sym[j], (0, -1))[1] != made:
            continue
        sym[i], end[i], alive[j], nxt[i] = made, stop, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        add(i)
        if prv[i] >= 0:
            add(prv[i])
    return [(sym[i], i) for i in range(n) if alive[i]]


def merge_words(model: Pieces, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, dropout: float, base: np.ndarray | None = None, without: list[np.ndarray] | None = None, made_at: list | None = None):
    """Pieces of many words: (id, start in its word, word), in order of words and places.

    ``symbols`` are the character ids (-1: none) of consecutive words of ``sizes``; ``base`` are the
    places of parts in the words whose keys they have.  ``without``: instead of skips by keys, places of
    candidates that each word does without; the merges made are then added to ``made_at``, (word, place)
    a round.
    """
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(MERGED_CHARS, int(sizes.sum()) + MERGED_CHARS, MERGED_CHARS)).clip(max=len(sizes) - 1) + 1) if len(sizes) else []
    parts, low = [], 0
    for high in cuts:  # words whose tables fit a core's own memory
        at = slice(int(ends[low] - sizes[low]), int(ends[high - 1]))
        log = None if made_at is None else []
        sym, start, word = _merge_some(model, symbols[at], sizes[low:high], keys[low:high], dropout, None if base is None else base[low:high], None if without is None else [x[low:high] for x in without], log)
        parts.append((sym, start, word + low))
        if log:
            made_at.extend((w + low, spot) for w, spot in log)
        low = high
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3


def _merge_some(model: Pieces, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, dropout: float, base, without, made_at):
    """``merge_words`` of words that are few enough."""
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    start = (np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    end, sym = start + np.int32(1), symbols.astype(np.int32)
    done = []
    # candidates are kept from round to round: only places beside a merge are looked up anew
    none = np.iinfo(np.int64).max
    rank = np.full(len(sym), none)
    made = np.zeros(len(sym), dtype=np.int32)
    new_made = model.made.astype(np.int32)
    fresh = np.arange(len(sym))
    while len(sym):
        f = fresh[fresh + 1 < len(sym)]
        rank[fresh] = none
        left, right = sym[f], sym[f + 1]
        some = (word[f] == word[f + 1]) & (left >= 0) & (right >= 0)
        f = f[some]
        pair = left[some].astype(np.int64) * model.size + right[some]
        ok, at = model.merge_of(pair)
        f = f[ok]
        shift = 0 if base is None else base[word[f]]
        if without is None:
            keep = ~_skipped(keys[word[f]], start[f] + shift, start[f + 1] + shift, end[f + 1] + shift, dropout)
            f, at = f[keep], at[keep]
        elif without:
            spot, keep = _place(start[f], start[f + 1], end[f + 1]), np.ones(len(f), dtype=bool)
            for gone in without:
                keep &= gone[word[f]] != spot
            f, at = f[keep], at[keep]
        rank[f] = model.rank[at] << 24 | start[f]  # best score first, then leftmost
        made[f] = new_made[at]
        head = np.flatnonzero(np.diff(word, prepend=np.int32(-1)))
        best = np.minimum.reduceat(rank, head)
        span = np.diff(head, append=len(sym))
        win = np.flatnonzero((rank == np.repeat(best, span)) & (rank != none))
        if made_at is not None:
            made_at.append((word[win], _place(start[win], start[win + 1], end[win + 1])))
        sym[win], end[win] = made[win], end[win + 1]
        stay = np.ones(len(sym), dtype=bool)
        stay[win + 1] = False
        over = best == none
        if over.any():
            gone = np.repeat(over, span)
            done.append((sym[gone], start[gone], word[gone]))
            stay &= ~gone
        number = np.cumsum(stay, dtype=np.int32)
        new = number[win].astype(np.int64) - 1
        sym, start, end, word, rank, made = (x[stay] for x in (sym, start, end, word, rank, made))
        before = new[new > 0] - 1
        fresh = np.concatenate([new, before[word[before] == word[before + 1]]]) if len(sym) else new
    if not done:
        return (np.zeros(0, dtype=np.int64),) * 3
    sym, start, word = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word.astype(np.int64) << 24 | start, kind="stable")
    return sym[order].astype(np.int64), start[order].astype(np.int64), word[order].astype(np.int64)


def _spell(model: Pieces, sym: np.ndarray, codes: np.ndarray, owner: np.ndarray, words: int):
    """Ids with characters outside the vocabulary in bytes, and the number of ids of each word."""
    whole = (sym >= 0) & (sym < model.vocabulary)
    width = np.where(whole, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    out = np.repeat(np.where(whole, sym, 0), width)
    which = np.repeat(np.arange(len(sym)), width)
    k = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
    odd = ~whole[which]
    if odd.any():
        c, w, k = codes[which[odd]], width[which[odd]], k[odd]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
        value = np.where(k == 0, np.where(w == 1, c, lead | (c >> (6 * (w - 1)))), 0x80 | ((c >> (6 * np.maximum(w - 1 - k, 0))) & 0x3F))
        out[odd] = model.byte_id[value]
    return out, np.bincount(owner, weights=width, minlength=words).astype(np.int64)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``first``, one range after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _merged(model: Pieces, sym: np.ndarray, lengths: np.ndarray, keys: np.ndarray, dropout: float):
    """Pieces of words of any length: (id, place among all characters, word), in order of places."""
    first = np.cumsum(lengths) - lengths
    long = lengths > LONG
    if not long.any():
        got, start, word = merge_words(model, sym, lengths, keys, dropout)
        return got, first[word] + start, word
    # words and parts of long words, in order
    at = np.flatnonzero(np.repeat(long, lengths))
    inner = np.ones(len(at), dtype=bool)
    inner[np.searchsorted(at, first[long])] = False  # beginnings of words
    new = at[~inner | model.apart(sym[at - 1], sym[at])]
    part = np.sort(np.concatenate([first[~long], new]))
    of = np.searchsorted(first, part, side="right") - 1
    size, base = np.diff(part, append=len(sym)), part - first[of]
    big = size > LONG
    small = np.repeat(~big, size)
    got, start, which = merge_words(model, sym[small], size[~big], keys[of[~big]], dropout, base[~big])
    del small
    places, ids = [part[~big][which] + start], [got]
    for w in np.flatnonzero(big).tolist():
        alone = merge_agenda(model, sym[part[w] : part[w] + size[w]].tolist(), int(keys[of[w]]), dropout, int(base[w]))
        ids.append(np.array([a for a, _ in alone], dtype=np.int64))
        places.append(part[w] + np.array([b for _, b in alone], dtype=np.int64))
    got, place = np.concatenate(ids), np.concatenate(places)
    if big.any():
        order = np.argsort(place)
        got, place = got[order], place[order]
    return got, place, np.searchsorted(first, place, side="right") - 1


def encode_texts(model: Pieces, texts: list[str], salts: np.ndarray, dropout: float, seed: int = 0) -> list[np.ndarray]:
    """Ids of each text.  ``salts``: a number for each text; the key of a word is by its characters, that, its place and the seed.

    An occurrence of a word that skips none of the merges made without dropout has the pieces made
    without, whatever else it skips.  One that skips some does without the first of these; all that skip
    the same one first share the merges made without it, and so on.  So the merges of a word are made
    once for each such case, and an occurrence only looks which case it is; the only one of its case, and
    one that skips many, merges by itself.
    """
    units = [model.units.findall(" " + t) if t else [] for t in texts]
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    number: dict[str, int] = {}
    inverse = np.fromiter(map(number.setdefault, chain.from_iterable(units), count()), dtype=np.int64, count=n)
    del units
    inverse = (np.cumsum(inverse == np.arange(n)) - 1)[inverse]
    words = list(number)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    del words, number
    first = np.cumsum(lengths) - lengths
    sym = model.char_id[codes]
    begin, size, flat, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [], 0

    def settle(got, place, word, which, rows, case):
        """Gives the rows the pieces of their cases; ``place`` is among the characters of the words."""
        nonlocal total
        ids, wide = _spell(model, got, codes[place], word, which)
        begin[rows], size[rows] = (total + np.cumsum(wide) - wide)[case], wide[case]
        flat.append(ids)
        total += len(ids)

    if dropout <= 0:  # the pieces of a word are the same everywhere
        settle(*_merged(model, sym, lengths, np.zeros(len(lengths), dtype=np.uint64), 0.0), len(lengths), slice(None), inverse)
    else:
        keys = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _power(np.arange(len(codes)) - np.repeat(first, lengths)), first)
        keys ^= np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        spot = np.repeat(salts.astype(np.uint64), sizes) + (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1).astype(np.uint64) * _MUL
        keys = (keys[inverse] ^ (spot ^ (spot >> np.uint64(31))) * _MIX) * _MUL
        del spot
        long = lengths > LONG
        alone = [np.flatnonzero(long[inverse])]
        rows = np.flatnonzero(~long[inverse])
        of, without, case = np.arange(len(lengths)), [], inverse[rows]  # the word of each case, what it does without, and the case of each row
        while True:
            often = np.bincount(case, minlength=len(of)) >= SHARED
            shared = often[case]
            alone.append(rows[~shared])
            rows, case = rows[shared], (np.cumsum(often) - 1)[case[shared]]
            of, without = of[often], [x[often] for x in without]
            if not len(rows) or len(without) == DEEP:
                alone.append(rows)
                break
            at, made_at = _ranges(first[of], lengths[of]), []
            got, start, word = merge_words(model, sym[at], lengths[of], keys[:0], 0.0, without=without, made_at=made_at)
            owner, spot = (np.concatenate(x) for x in zip(*made_at))
            order = np.argsort(owner, kind="stable")
            owner, spot = owner[order], spot[order]
            merges = np.bincount(owner, minlength=len(of))
            start_of = np.cumsum(merges) - merges
            row, path = [], []
            for k in range(0, len(rows), BLOCK):
                c = case[k : k + BLOCK]
                m = merges[c]
                step = _ranges(start_of[c], m)
                hit = np.flatnonzero(_below(np.repeat(keys[rows[k : k + BLOCK]], m) ^ spot[step], dropout))
                who = np.searchsorted(np.cumsum(m), hit, side="right")
                one = np.flatnonzero(np.diff(who, prepend=-1))  # the first merge that it skips
                row.append(k + who[one])
                path.append(step[hit[one]])
            row, path = np.concatenate(row), np.concatenate(path)
            done = np.ones(len(rows), dtype=bool)
            done[row] = False
            settle(got, first[of[word]] + start, word, len(of), rows[done], case[done])
            rows = rows[row]
            kinds = np.zeros(len(spot), dtype=bool)
            kinds[path] = True
            case = (np.cumsum(kinds) - 1)[path]
            kinds = np.flatnonzero(kinds)
            without = [*(x[owner[kinds]] for x in without), spot[kinds]]
            of = of[owner[kinds]]
        rows = np.concatenate(alone)
        if len(rows):
            its = inverse[rows]
            at = _ranges(first[its], lengths[its])
            got, place, word = _merged(model, sym[at], lengths[its], keys[rows], dropout)
            settle(got, at[place], word, len(rows), rows, slice(None))
    ids = np.concatenate(flat)[_ranges(begin, size)]
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=size, minlength=len(texts)).astype(np.int64))
    return np.split(ids, ends[:-1])


def _power(k: np.ndarray) -> np.ndarray:
    table = np.cumprod(np.full(int(k.max()) + 2 if len(k) else 2, _MUL, dtype=np.uint64))
    return table[k]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *keep, ids)``: each row's whole text as an array of piece ids.

    Without dropout these are the ids of the library (a space mark in the text itself is spelt in
    bytes, though, so that it is not lost).  With it, each candidate merge of a word is skipped with
    that probability by a hash keyed by ``seed``, the word, its text's hash and its place there: each
    occurrence has skips of its own.  Null and empty texts have no ids.  Rows keep their count.
    """

    def run(batches):
        import xxhash

        vocabulary = pieces(model)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            first, size = 0, 0
            for i, n in enumerate(sizes.tolist()):
                size += n
                if size <= GROUP_CHARS and i < len(sizes) - 1:
                    continue
                part = batch.slice(first, i + 1 - first)
                first, size = i + 1, 0
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                salts = np.array([xxhash.xxh64_intdigest(t, seed=seed & (1 << 64) - 1) for t in texts], dtype=np.uint64)
                out = encode_texts(vocabulary, texts, salts, dropout, seed)
                ends = np.cumsum([0, *map(len, out)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(out).astype(np.int32)))
                del out
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[id_col, *keep, "ids"])

    slim = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The columns of ``encoded`` but ``ids_col``, and ``text_col``: the text that its ids spell.

    Control pieces spell nothing; null or empty ids give an empty text; bytes that are no UTF-8 become
    U+FFFD.
    """

    def run(batches):
        spelt = pieces(model).bytes_of
        for batch in batches:
            texts = [b"".join(map(spelt.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in batch.column(batch.num_columns - 1)]
            texts = [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, text_col])

    others = [c for c in encoded.columns if c != ids_col]
    slim = encoded.select(*others, ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, `{text_col}` string")
