"""Best-fit packing of documents into sequences, improved by swap-based local search.

A document is its token ids and the end id. Longer ones are cut into full pieces, the first piece
being what is left over; full pieces are sequences by themselves. The rest is packed by length:
the driver gets one row a length (at most ``capacity`` rows, whatever the input), packs best-fit
from the longest down with bins of equal content held as one class and a count, and then improves
the underfull bins: documents move, or are exchanged one for one or two for one, whenever that
raises the sum of squared fills, until bins empty or no exchange helps. Each length's places are
runs of consecutive sequences; a document takes the place of its rank among equal lengths, which
comes from counts by partition, so no length, however frequent, meets in one task.

Null text is an empty document: only the end id. Repeated rows are packed each for itself; which of
several rows of equal length gets which place follows their order in the input. Texts are never
shortened; the pieces of a document hold all its ids. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices

PIECES = "piece int, start long, length int, crc long, pid int, nth long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: the pre-token pattern of byte-level files, in a form that never backtracks.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def merge_ranks(path: str) -> dict[bytes, int]:
    """The file's tokens as bytes with their ids, if its merges are numbered in the order in which they apply."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], byte_letters()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(b <= a for a, b in zip(made, made[1:])) or (made and max(vocab[x] for x in letters) >= made[0]):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    held = {*made, *(vocab[x] for x in letters)}
    return {bytes(map(letters.__getitem__, word)): k for word, k in vocab.items() if k in held}


class Encoder:
    """Token ids of a byte-level BPE tokenizer file as little-endian unsigned 32-bit integers.

    The file's merges are applied by tiktoken, which takes them as ranks and needs no memory that
    grows with the texts or their words; ids equal those of the tokenizers library (tests). Texts
    that hold one of the file's special tokens are left to that library.
    """

    def __init__(self, path: str):
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.core = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=merge_ranks(path), special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.core.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The Python worker's own encoder, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, crc, pid, nth): nth counts pieces of equal length in a partition."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from zlib import crc32

        encode, pid = worker_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            owner, out = [], []
            for at, texts in text_slices(batch, 1):
                for k, text in enumerate(texts):
                    ids = encode(text or "") + tail
                    n = len(ids) // 4
                    begin, piece = 0, 0
                    while begin < n:
                        end = min(n, begin + ((n - begin) % capacity or capacity))
                        owner.append(at + k)
                        out.append((piece, begin, end - begin, crc32(ids[4 * begin : 4 * end]), seen[end - begin]))
                        seen[end - begin] += 1
                        begin, piece = end, piece + 1
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch(
                [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array([pid] * len(out), pa.int32()), pa.array(cols[4], pa.int64())],
                names=["id", "piece", "start", "length", "crc", "pid", "nth"],
            )

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, {PIECES}")


def best_fit(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Bins by content (lengths, longest first) with their number, packed best-fit from the longest length down."""
    done: dict[tuple[int, ...], int] = {}
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(content: tuple[int, ...], n: int) -> None:
        room = capacity - sum(content)
        if not room:
            done[content] = done.get(content, 0) + n
            return
        if room not in open_:
            open_[room] = {}
            bisect.insort(rooms, room)
        open_[room][content] = open_[room].get(content, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(left, capacity // length)
                put((length,) * each, left // each)
                left %= each
                continue
            room = rooms[at]
            content, n = next(iter(open_[room].items()))
            each = min(room // length, left)
            used = min(n, left // each)
            if used == n:
                del open_[room][content]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                open_[room][content] = n - used
            put(content + (length,) * each, used)
            left -= used * each
    for at_room in open_.values():
        for content, n in at_room.items():
            done[content] = done.get(content, 0) + n
    return done


def _exchange(giver: tuple[int, ...], taker: tuple[int, ...], room: int) -> tuple[int, tuple, tuple] | None:
    """The move, one-for-one or two-for-one exchange that adds most, at most ``room``, to the taker: (gain, given, returned)."""
    best: tuple[int, tuple, tuple] | None = None
    given = [(x,) for x in dict.fromkeys(giver)] + list(dict.fromkeys((giver[i], giver[j]) for i in range(len(giver)) for j in range(i + 1, len(giver))))
    back = [()] + [(x,) for x in dict.fromkeys(taker)]
    for g in given:
        for b in back:
            if len(g) == 2 and not b:
                continue
            gain = sum(g) - sum(b)
            if 0 < gain <= room and (best is None or gain > best[0]):
                best = (gain, g, b)
    return best


def local_search(bins: dict[tuple[int, ...], int], capacity: int) -> dict[tuple[int, ...], int]:
    """Exchanges between underfull bins that raise the sum of squared fills, until none helps or the least number of bins is reached.

    After the first round, only pairs with a content made in the last or this round are looked at: the others have failed.
    """
    bins = dict(bins)
    total = sum(sum(c) * n for c, n in bins.items())
    least = -(-total // capacity)

    def add(content: tuple[int, ...], n: int) -> None:
        if content:
            content = tuple(sorted(content, reverse=True))
            bins[content] = bins.get(content, 0) + n
            made[content] = turn

    def take(content: tuple[int, ...], n: int) -> None:
        bins[content] -= n
        if not bins[content]:
            del bins[content]

    def without(content: tuple[int, ...], items: tuple) -> tuple[int, ...]:
        rest = list(content)
        for x in items:
            rest.remove(x)
        return tuple(rest)

    made: dict[tuple[int, ...], int] = {}
    moved, turn = True, 0
    while moved and sum(bins.values()) > least:
        moved, turn = False, turn + 1
        under = sorted((c for c in bins if sum(c) < capacity), key=lambda c: (sum(c), c))
        fresh = under if turn == 1 else [c for c in under if made.get(c, 0) == turn - 1]
        new = set(fresh)
        for giver in under:
            for taker in reversed(under if giver in new else fresh):
                if giver not in bins:
                    break
                if taker not in bins or sum(taker) < sum(giver) or (taker == giver and bins[giver] < 2):
                    continue
                found = _exchange(giver, taker, capacity - sum(taker))
                if found:
                    n = bins[giver] // 2 if giver == taker else min(bins[giver], bins[taker])
                    take(giver, n)
                    take(taker, n)
                    add(without(giver, found[1]) + found[2], n)
                    add(without(taker, found[2]) + found[1], n)
                    moved = True
    return bins


def places(bins: dict[tuple[int, ...], int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places, in order of rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for content in sorted(bins, reverse=True):
        n, offset = bins[content], 0
        for length in content:
            runs.setdefault(length, []).append((ranks.get(length, 0), base, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) for every piece of every row."""
    made = materialise(pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    sums = materialise(made.where(F.col("length") < capacity).groupBy("length", "pid").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length at most
    runs = places(local_search(best_fit(counts, capacity), capacity), capacity)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["length", "pid"], "left")
    picked = ranked.select("id", "piece", "start", F.col("length").cast("long").alias("length"), "crc", "pid", (F.col("first") + F.col("nth")).alias("rank"), "nth")

    def place(batches):
        for batch in batches:
            length, pid, nth = (np.asarray(batch.column(i), np.int64) for i in (3, 5, 7))
            rank = np.asarray(batch.column(6).fill_null(0), np.int64)
            seq, offset = -(pid * (1 << 36) + nth + 1), np.zeros(len(length), np.int64)
            for one in np.unique(length[length < capacity]):
                at = np.flatnonzero(length == one)
                start, base, off = runs[int(one)]
                k = np.searchsorted(start, rank[at], "right") - 1
                seq[at], offset[at] = base[k] + rank[at] - start[k], off[k]
            yield pa.record_batch([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(place, f"id {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")
