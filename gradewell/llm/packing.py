"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each task tokenises its documents and packs their pieces best-fit into sequences.  Nearly full ones
are final.  The others go on as items: groups of tasks are merged, their underfull sequences are
packed best-fit again, and so on up a tree, until a round no longer merges anything or one node
holds all that is left.  Only lengths and digests move, never token ids, and a node holds at most
``node_rows`` items, so neither memory nor the last task grows with the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tokenizer_path
from .tokens import codec, spliced_ids

FLUSH = 200_000  # pieces that a task packs at once
HUGE = 1 << 20  # characters from which a text is encoded in spliced chunks
_FAST: dict[str, FastIds] = {}


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself if it prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def same_ids(name: str, ranks: dict[bytes, int], pattern: str) -> bool:
    """Whether the JSON file's tokenizer and the rank table are proven to give the same ids.

    They are if both split words by the same pattern, list the same vocabulary, merge in the order of
    the ids, and if the JSON file's library gives every entry of the vocabulary as itself.  Then a
    step of the rank library (join the neighbours whose join has the lowest rank) is always one that
    the JSON file lists: within the span of an entry both do the same steps up to that join.
    """
    import json

    with open(tokenizer_path(name), encoding="utf-8") as f:
        rules = json.load(f)
    pre, model = rules["pre_tokenizer"] or {}, rules["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not rules["normalizer"]
    if not plain or pattern != WORD_PATTERN or model["type"] != "BPE" or model.get("dropout"):
        return False
    letter, added = _byte_letters(), {t["content"] for t in rules["added_tokens"]}
    vocab = {w: i for w, i in model["vocab"].items() if w not in added}
    if {bytes(map(letter.__getitem__, w)): i for w, i in vocab.items()} != ranks:
        return False
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    tokenize = codec(name).model.tokenize
    return made == sorted(made) and all(len(t) == 1 and t[0].id == i for w, i in vocab.items() for t in [tokenize(w)])


# Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class FastIds:
    """Ids of a byte-level vocabulary, by its rank file where that is proven to give the same.

    ``<name>.tiktoken`` lists the same vocabulary as ranks; the rank library takes about a quarter of
    the time.  ``same_ids`` proves the parity of the two files when they are loaded.  Without such a
    file or proof the JSON file's library gives all ids; it gives those of huge texts anyway, in
    spliced chunks, and of texts that the rank library's pattern engine refuses.
    """

    def __init__(self, name: str):
        import os

        self.name, self.enc = name, None
        ranks = tokenizer_path(name).removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks) and os.path.exists(tokenizer_path(name)):
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if same_ids(name, table, WORD_PATTERN):
                self.enc = tiktoken.Encoding(name, pat_str=WORD_PATTERN, mergeable_ranks=table, special_tokens=codec(name).added)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= HUGE:
            return np.concatenate(list(spliced_ids(codec(self.name), text)))
        if self.enc is not None:
            try:
                return self.enc.encode_to_numpy(text, allowed_special="all")
            except (ValueError, RuntimeError):  # the pattern engine's limit of steps
                pass
        return codec(self.name).ids([text])[0]


def best_fit(lengths: np.ndarray, room: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item (each of 1 to ``room``), in any numbering.

    Open bins lie in lists by free room; a bit set finds the smallest room that fits.
    """
    owner = np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    some, bins = 0, 0
    size = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = size[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            r, b = room, bins
            bins += 1
        owner[i] = b
        r -= n
        if r:
            free[r].append(b)
            some |= 1 << r
    return owner


def _member_type(id_type: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("place", pa.int64())]))


def _merge(bins: np.ndarray, fill: np.ndarray, members: pa.ListArray, room: int):
    """Pack the rows (bins of ``fill`` tokens) best-fit; each new bin is named after its first row."""
    owner = best_fit(fill, room)
    order = np.lexsort((bins, owner))  # rows of a new bin side by side
    own = owner[order]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    group = np.cumsum(np.r_[False, own[1:] != own[:-1]])
    before = np.cumsum(fill[order]) - fill[order]
    shift = before - before[head][group]
    offsets = members.offsets.to_numpy().astype(np.int64)
    flat, base = members.flatten(), offsets[0]
    count = np.diff(offsets)[order]
    start = offsets[:-1][order] - base
    take = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    flat = flat.take(pa.array(take))
    fields = {f.name: flat.field(f.name) for f in flat.type}
    fields["place"] = pa.array(fields["place"].to_numpy(zero_copy_only=False) + np.repeat(shift, count))
    flat = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)][np.r_[head, len(own)]].astype(np.int32)), flat)
    return bins[order][head], np.add.reduceat(fill[order], head), lists


def _emit(bins, fill, lists, rows=20_000):
    for at in range(0, len(bins), rows):
        yield pa.RecordBatch.from_arrays([pa.array(bins[at : at + rows]), pa.array(fill[at : at + rows]), lists.slice(at, rows)], names=["bin", "fill", "members"])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", room: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", full: float = 0.996, node_rows: int = 65_536, fan_in: int = 8) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece.

    A document is the ids of its whole text, then ``end_id``; null and empty texts are ``end_id``
    alone.  A document of at most ``room`` ids is one piece; a longer one is cut into pieces of
    exactly ``room`` ids but for the first, which holds the rest.  Sequences hold at most ``room``
    ids without gaps from 0.  Repeated rows and null ids are packed like any other row.  An empty
    table gives no pieces.  A sequence filled to ``full`` of the room is final in its round.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema[0].dataType.simpleString()
    schema = f"bin long, fill long, members array<struct<id:{kind},piece:int,start:bigint,length:bigint,crc:bigint,place:bigint>>"

    def local(batches):
        if tokenizer not in _FAST:
            _FAST[tokenizer] = FastIds(tokenizer)
        encode, ids, cols, made = _FAST[tokenizer], [], ([], [], [], []), 0
        base = TaskContext.get().partitionId() << 33

        def flush():
            nonlocal made
            if not cols[0]:
                return
            piece, start, length, crc = (np.array(c, dtype=np.int64) for c in cols)
            rows = pa.concat_arrays(ids)
            flat = pa.StructArray.from_arrays([rows, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.zeros(len(piece), np.int64))], names=["id", "piece", "start", "length", "crc", "place"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(piece) + 1, dtype=np.int32)), flat)
            names = base + made + np.arange(len(piece))
            made += len(piece)
            yield from _emit(*_merge(names, length, lists, room))
            ids.clear()
            for c in cols:
                c.clear()

        for batch in batches:
            owner = []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                one = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                first = (len(one) - 1) % room + 1
                for piece, a in enumerate([0, *range(first, len(one), room)]):
                    b = first if not piece else a + room
                    for c, v in zip(cols, (piece, a, b - a, zlib.crc32(one[a:b].tobytes()))):
                        c.append(v)
                    owner.append(k)
            ids.append(batch.column(0).take(pa.array(owner, pa.int64())))
            if len(cols[0]) >= FLUSH:
                yield from flush()
        yield from flush()

    def node(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        bins, fill = (t.column(c).to_numpy() for c in ("bin", "fill"))
        order = np.lexsort((bins, -fill))  # whatever order the shuffle brought
        members = t.column("members").combine_chunks().take(pa.array(order))
        yield from _emit(*_merge(bins[order], fill[order], members, room))

    bins = cut(slim.mapInArrow(local, schema))
    limit = int(room * full)
    done, left = [bins.where(F.col("fill") >= limit)], bins.where(F.col("fill") < limit)
    n, nodes, turn = left.count(), max(1, bins.rdd.getNumPartitions()), 0
    while n > 1:
        nodes, last, turn = max(-(-n // node_rows), -(-nodes // fan_in)), nodes, turn + 1
        # keyed by the round too: at an equal number of nodes, others meet than in the round before
        merged = cut(left.repartition(nodes, F.xxhash64("bin", F.lit(turn))).mapInArrow(node, schema))
        now = merged.count()
        done.append(merged.where(F.col("fill") >= limit))
        left = merged.where(F.col("fill") < limit)
        gain, n = n - now, left.count()
        if nodes == 1 or (nodes == last and gain < 0.001 * now):
            break
    done.append(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    m = out.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
    return m.select(F.col("m.id").alias(id_col), "m.piece", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), "sequence_id", F.col("m.place").alias("offset"))
