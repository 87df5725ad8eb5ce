"""Token counts with overlap resynchronisation for huge documents.

Short texts are encoded whole.  A text over ``chunk`` characters is encoded in overlapping chunks
with offsets, and neighbours are spliced at a boundary that both encodings have and that is proven
stable: a place p with white space at p and none just before it.  No word pattern of these
tokenizers matches across such a place (white space only begins or forms a match), special strings
hold no white space, and patterns look ahead only; so what is left of p does not depend on what
follows, and what is right of p does not depend on what precedes.  Where the pattern's words are of
one class of characters each (letters, digits, others), so is a change of class, but for what follows
an apostrophe and what lies in a special string.  Where the overlap holds no such boundary, it is
doubled, down to the last splice, from where the text is encoded on as one; each such failure in
turn makes the chunk four times as long, so the sum of what is encoded stays in proportion to the
text.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

GROUP_CHARS = 1 << 20  # characters encoded by one call
_CACHE: dict[str, Codec] = {}
_CLASSES: list[np.ndarray] = []
# The word pattern of byte-level vocabularies without its white space, of one class a word.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes() -> np.ndarray:
    """Per code point 1 for letters, 2 for digits, 3 for others; 0 for white space and where versions of Unicode may differ."""
    if not _CLASSES:
        old, kinds = unicodedata.ucd_3_2_0, {"L": 1, "N": 2, "M": 3, "P": 3, "S": 3}
        both = ((old.category(c)[0], unicodedata.category(c)[0]) for c in map(chr, range(0x10000)))
        _CLASSES.append(np.array([kinds.get(a, 0) if a == b else 0 for a, b in both], dtype=np.int8))
    return _CLASSES[0]


class Codec:
    """A tokenizer file behind one interface: ids of texts, and ids with the end offsets of chunks."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        self.blanks, self.classes, self.special = " ", 0, []  # classes: code points below this change class at a boundary
        if path.endswith(".model"):
            import sentencepiece

            self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size()))
            self.spliceable = not any("▁" in p.lstrip("▁") for p in pieces)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._sp, self._tok = None, Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                rules = json.load(f)
            pre = json.dumps(rules["pre_tokenizer"] or {})
            self.added, self.model = {t["content"]: t["id"] for t in rules["added_tokens"]}, self._tok.model
            self.special = list(self.added)
            self.spliceable = ('"ByteLevel"' in pre or '"Split"' in pre) and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"])
            if '"use_regex": true' in pre and not rules["normalizer"]:
                self.blanks, self.classes = " \n\t\r", 0x10000
            elif json.dumps(WORDS) in pre:
                self.classes = 0x80  # a normaliser may join what is not ASCII

    def counts(self, texts: list[str]) -> list[int]:
        if self._sp:
            return [len(x) for x in self._sp.encode(texts, num_threads=1)]
        return [len(x) for x in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self._sp:
            return [np.array(x, dtype=np.uint32) for x in self._sp.encode(texts, num_threads=1)]
        return [np.array(x.ids, dtype=np.uint32) for x in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def with_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the character offset at which each ends."""
        if self._sp:
            pieces = self._sp.encode(text, return_type="proto").pieces
            ends = np.array([p.end for p in pieces], dtype=np.int64)
            if len(ends) and ends[-1] > len(text):  # the library counts bytes: turn them into characters
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                ends = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][ends]
            return np.array([p.id for p in pieces], dtype=np.uint32), ends
        e = self._tok.encode(text, add_special_tokens=False)
        return np.array(e.ids, dtype=np.uint32), np.array([x[1] for x in e.offsets], dtype=np.int64)

    def stable(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Places p of [lo, hi), lo > 0, where a word always ends, by what stands before and at p."""
        codes = np.frombuffer(text[lo - 1 : hi].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        left, right = codes[:-1], codes[1:]
        blank = np.isin(right, [ord(c) for c in self.blanks])
        if blank.any():
            blank[blank] = [not chr(c).isspace() for c in left[blank].tolist()]
        if self.classes:
            kind = np.where(codes < self.classes, _classes()[np.minimum(codes, 0xFFFF)], 0)
            blank |= (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0) & (left != ord("'"))
        places = lo + np.flatnonzero(blank)
        found, room = [], max(map(len, self.special), default=0)
        for word in self.special:
            first = text.find(word, max(0, lo - room), hi + room)
            while first >= 0:
                found.append((first, first + len(word)))
                first = text.find(word, first + 1, hi + room)
        if found:  # no place inside a special string, but the end of each that is whole right of lo - 1
            starts, ends = np.array(found).T
            places = np.union1d(places, ends[(starts >= lo - 1) & (ends >= lo) & (ends < hi)])
            inside = np.zeros(hi - lo + 1, dtype=np.int64)
            np.add.at(inside, np.clip(starts + 1, lo, hi) - lo, 1)
            np.add.at(inside, np.clip(ends, lo, hi) - lo, -1)
            places = places[np.cumsum(inside)[places - lo] == 0]
        return places


def codec(name: str) -> Codec:
    """The tokenizer of a file, loaded once in a process."""
    if name not in _CACHE:
        _CACHE[name] = Codec(name)
    return _CACHE[name]


def spliced_ids(tok: Codec, text: str, chunk: int = 32_768, overlap: int = 512):
    """Arrays of ids that together are the ids of the whole text."""
    n = len(text)
    if n <= chunk or not tok.spliceable:
        yield tok.ids([text])[0]
        return
    at, b, step = 0, chunk, chunk  # all ids before ``at`` are out; the chunk in hand covers at least [at, b)
    ids, ends = tok.with_ends(text[:b])
    while b < n:
        width = overlap
        while True:
            a = max(b - width, at - 1, 0)
            whole = a <= max(at - 1, 0)
            places = tok.stable(text, max(a, at) + 1, b)
            if not whole and not len(places):  # nothing to align: look on before anything is encoded
                width *= 2
                continue
            b2 = min(n, b + step)
            ids2, ends2 = tok.with_ends(text[a:b2])
            ends2 = ends2 + a
            shared = places[np.isin(places, ends) & np.isin(places, ends2)] if not whole else places[:0]
            if len(shared):
                p = int(shared[-1])
                yield ids[(ends > at) & (ends <= p)] if at else ids[ends <= p]
                at, step = p, chunk
                break
            if whole:  # encoded on from the last splice
                step *= 4
                break
            width *= 2
        ids, ends, b = ids2, ends2, b2
    yield ids[ends > at] if at else ids


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of each row's whole text.

    No begin, end or added tokens, no truncation or padding; special strings inside a text are
    handled as the library does by default.  Null and empty texts have 0 bytes and 0 tokens.  Rows
    keep their count: repeated rows and null ids each give a row.
    """

    def run(batches):
        tok = codec(tokenizer)
        for batch in batches:
            texts, out, group, size = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.int64), [], 0
            for i, text in enumerate([*texts, None]):
                if i == len(texts) or size > GROUP_CHARS:
                    out[group] = tok.counts([texts[k] for k in group])
                    group, size = [], 0
                if text and len(text) > chunk:
                    out[i] = sum(len(x) for x in spliced_ids(tok, text, chunk, overlap))
                elif text:
                    group.append(i)
                    size += len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=[id_col, "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
