"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Method: a run-length index finds the long matches. Strings of 200 bytes are first dealt to where
they can meet: each is owned by its anchor, the 32-byte substring of least hash in it, so equal
strings have equal anchors at equal offsets. Strings of one anchor that start in a row are a
context, at most 368 bytes. Contexts are counted by (anchor, content) over all documents:

* an anchor met once owns unique strings only;
* contexts that occur twice or more are repeats in full;
* what is left are contexts that share an anchor and differ, the borders of repeated passages. All
  of them are fetched, one of each content, dealt by anchor, and indexed in blocks: the suffixes
  are sorted, the Burrows-Wheeler transform is cut into runs of equal letters, and the text
  position at each run's head and the end of the run before are sampled. Between samples the
  preceding suffix in order and the length of the match with it follow by counting down, so
  matching statistics stream off the samples; every position whose match reaches ``length`` bytes
  is marked together with its partner.

An anchor whose differing contexts exceed ``crowd`` could overfill a block; its strings are counted
one by one by two 64-bit hashes instead, which is exact as well and needs no group in one place.

Texts are UTF-8 bytes; null is empty. Texts under ``length`` bytes have no repeats. Matches never
cross documents. Repeated rows are repeats of each other. Strings are judged on the input only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, measured, text_slices

LENGTH = 200
ANCHOR = 32
#: Fixed odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once: positions must fit the low bits of an ordering key.
STRETCH = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of substrings of a stretch of at most STRETCH bytes."""

    def __init__(self, size: int = STRETCH):
        self.up, self.down = _powers(BASE, size + 1), _powers(INVERSE, size + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def contexts(data: np.ndarray, ends: np.ndarray, rolling: Rolling, length: int = LENGTH, anchor: int = ANCHOR):
    """Contexts of texts laid end to end: (text index, first string, number of strings, anchor hash, content hash).

    ``ends`` are the texts' ends in ``data``, at most STRETCH bytes; strings don't cross them.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data)
    if n < length:
        return none
    sums = rolling.sums(data)
    m = n - anchor + 1
    gram = _mix((sums[anchor:] - sums[:m]) * rolling.down[:m])
    order = gram & np.uint64(~(STRETCH - 1) & (1 << 64) - 1) | np.arange(m, dtype=np.uint64)
    w = length - anchor + 1
    # Least key of each run of w: the lesser of a suffix minimum and a prefix minimum over blocks of w.
    padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = order
    grid = padded.reshape(-1, w)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    owner = (np.minimum(back[:count], front[w - 1 : w - 1 + count]) & np.uint64(STRETCH - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[:count]
    inside = np.flatnonzero(np.arange(count) + length <= ends[text])
    if not len(inside):
        return none
    own, of = owner[inside], text[inside]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
    start, strings = inside[first], np.diff(np.r_[first, len(inside)])
    content = _mix(rolling.of(sums, start, start + strings + length - 1) ^ (strings.astype(np.uint64) << np.uint64(40)))
    return of[first], start, strings, gram[own[first]].view(np.int64), content.view(np.int64)


def stretches(texts: list[str | None], length: int = LENGTH):
    """Texts as bytes, laid into stretches: (data, ends, text numbers, offsets in their texts). Long texts are cut with an overlap."""
    blobs: list[bytes] = []
    who: list[int] = []
    where: list[int] = []
    size = 0

    def done():
        return np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([len(b) for b in blobs]), np.array(who), np.array(where)

    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - length + 1), STRETCH - length + 1):
            piece = data[at : at + STRETCH]
            if len(piece) < length:
                continue
            if size + len(piece) > STRETCH:
                yield done()
                blobs, who, where, size = [], [], [], 0
            blobs.append(piece)
            who.append(k)
            where.append(at)
            size += len(piece)
    if blobs:
        yield done()


def suffix_order(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes, each ending at its context's end (``end``), which sorts first, earlier contexts before later ones."""
    n = len(symbols)
    at = np.arange(n)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = symbols.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    room = end - at
    for k in range(7):
        key = key << 9 | np.where(k < room, wide[k : k + n], 0)
    order = np.argsort(key)
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # the place of the group's first
    step = 7
    while True:
        group = np.flatnonzero(fresh)
        size = np.diff(np.r_[group, n])
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            return order
        rows = order[slots]
        ahead = rows + step
        over = ahead >= end[rows]
        second = np.where(over, end[rows] - n - 1, rank[np.minimum(ahead, n - 1)])
        both = rank[rows] << 32 | second + n + 1
        now = np.argsort(both)
        rows, both = rows[now], both[now]
        order[slots] = rows
        split = np.r_[True, both[1:] != both[:-1]]
        fresh[slots] = split
        rank[rows] = slots[np.flatnonzero(split)[np.cumsum(split) - 1]]
        step *= 2


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Whether the string of ``length`` bytes at each position of the parts, laid end to end, occurs twice or more in them."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    end = np.repeat(np.cumsum(lens), lens)
    order = suffix_order(data, end)
    start = end - np.repeat(lens, lens)
    # The letter before each suffix; the first of a part has one of its own.
    before = np.where(order > start[order], data[order - 1].astype(np.int64), 256 + order)
    heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
    # Samples: each run's head and the end of the run before, in text order.
    head, prior = order[heads], np.where(heads > 0, order[heads - 1], -1)
    by_text = np.argsort(head)
    head, prior = head[by_text], prior[by_text]
    match = _match(data, head, prior, end)
    # Matching statistics: counted down from the last sample at or before each position.
    at = np.arange(n)
    last = np.searchsorted(head, at, "right") - 1
    gap = at - head[last]
    hit = np.flatnonzero((prior[last] >= 0) & (match[last] - gap >= length))
    out = np.zeros(n, bool)
    out[hit] = True
    out[prior[last[hit]] + gap[hit]] = True
    return out


def _match(data: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (0 where b is negative)."""
    out = np.zeros(len(a), np.int64)
    safe = np.maximum(b, 0)
    most = np.where(b >= 0, np.minimum(end[a] - a, end[safe] - safe), 0)
    live = np.flatnonzero(most > 0)
    span = np.arange(64)
    last = len(data) - 1
    while len(live):
        going = []
        for part in np.array_split(live, -(-len(live) // 16384)):
            done = out[part][:, None] + span
            same = data[np.minimum(a[part][:, None] + done, last)] == data[np.minimum(safe[part][:, None] + done, last)]
            same &= done < most[part][:, None]
            whole = same.all(1)
            out[part] += np.where(whole, 64, same.argmin(1))
            going.append(part[whole])
        live = np.concatenate(going)
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def repeat_spans(keyed: DataFrame, length: int = LENGTH, crowd: int = 4_096, block: int = 1 << 19, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(key, start, end): spans of repeated bytes, overlapping ones not merged, for rows (key long, text).

    ``crowd``: contexts of one anchor that an index takes; beyond it strings are counted one by one.
    ``broadcast_rows``: repeated anchors that are broadcast; more are joined by a shuffle.
    """
    anchor = min(ANCHOR, max(1, length // 4))

    def find(batches):
        rolling = Rolling()
        for batch in batches:
            keys = np.asarray(batch.column(0), np.int64)
            for at, texts in text_slices(batch, 1):
                for data, ends, who, where in stretches(texts, length):
                    of, start, n, h, c = contexts(data, ends, rolling, length, anchor)
                    begin = np.r_[0, ends[:-1]]
                    place = (start - begin[of] + where[of]) << 24 | n
                    yield pa.record_batch([pa.array(keys[at + who[of]]), pa.array(place), pa.array(h), pa.array(c)], names=["key", "place", "h", "c"])

    found = materialise(keyed.select("key", "text").mapInArrow(find, "key long, place long, h long, c long"), "contexts")
    often = materialise(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    small = often.count() <= broadcast_rows
    met = materialise(found.join(F.broadcast(often) if small else often.hint("merge"), "h"), "repeated")
    discard(found)
    sorts = met.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("key", "place")).alias("rep"))
    sorts = materialise(sorts, "sorts")
    wide = sorts.groupBy("h").agg(F.count("*").alias("nd")).where("nd > 1")
    borders = materialise(sorts.join(wide.hint("merge"), "h").select("h", "c", "m", "nd", "rep.key", "rep.place"), "borders")
    start, n = F.shiftright("place", 24), F.col("place").bitwiseAND(F.lit((1 << 24) - 1))
    whole = met.join(measured(sorts.where("m > 1").select("h", "c")), ["h", "c"]).select("key", start.alias("start"), (start + n + (length - 1)).alias("end"))

    # The borders' bytes, one of each content, from the texts.
    wanted = borders.groupBy("key").agg(F.collect_list(F.struct("h", "m", "nd", "place")).alias("parts"))
    joined = keyed.join(wanted.hint("merge"), "key").select("key", "text", "parts")

    def cut(batches):
        rolling = Rolling(1 << 12)
        for batch in batches:
            keys, lists = batch.column(0).to_pylist(), batch.column(2)
            for at, slice_ in text_slices(batch, 1, 64):
                out: list[list] = [[], [], [], [], [], []]
                for k, text in enumerate(slice_):
                    data = text.encode("utf-8", "surrogatepass")
                    for part in lists[at + k].as_py():
                        begin, strings = part["place"] >> 24, part["place"] & (1 << 24) - 1
                        piece = data[begin : begin + strings + length - 1]
                        if part["nd"] <= crowd:
                            row = [(part["h"], 0, keys[at + k], begin, part["m"], piece)]
                        else:
                            row = []
                            for low in range(0, strings, 2048):  # every string by itself: its two hashes stand for it
                                some = np.frombuffer(piece[low : low + 2048 + length - 1], np.uint8)
                                sums, first = rolling.sums(some), np.arange(len(some) - length + 1)
                                one = rolling.of(sums, first, first + length)
                                other = _windows(some, length)
                                row += [(x, y, keys[at + k], begin + low + j, part["m"], None) for j, (x, y) in enumerate(zip(_mix(one).view(np.int64).tolist(), other.tolist()))]
                        for x in row:
                            for o, v in zip(out, x):
                                o.append(v)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())], names=["h", "h2", "key", "start", "m", "data"])

    pieces = joined.mapInArrow(cut, "h long, h2 long, key long, start long, m long, data binary")
    pieces = materialise(pieces, "pieces")

    def index(batches):
        parts: list[bytes] = []
        meta: list[tuple] = []
        size, now, past = 0, None, None

        def close():
            out = [[], [], []]
            hit = repeated_starts(parts, length)
            at = 0
            for part, (key, begin, m) in zip(parts, meta):
                if m == 1:
                    for s, e in _runs(hit[at : at + len(part)]):
                        out[0].append(key)
                        out[1].append(begin + s)
                        out[2].append(begin + e + length - 1)
                at += len(part)
            return pa.record_batch([pa.array(o, pa.int64()) for o in out], names=["key", "start", "end"])

        for batch in batches:
            for h, key, begin, m, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, key, begin) == past:  # a repeated row's
                    continue
                past = (h, key, begin)
                if h != now and size >= block:
                    yield close()
                    parts, meta, size = [], [], 0
                now = h
                parts.append(data)
                meta.append((key, begin, m))
                size += len(data)
        if parts:
            yield close()

    dealt = pieces.where("data is not null").select("h", "key", "start", "m", "data").repartition("h").sortWithinPartitions("h", "key", "start")
    partial = dealt.mapInArrow(index, "key long, start long, end long")
    single = pieces.where("data is null").select("h", "h2", "key", "start", "m").distinct()
    twice = single.groupBy("h", "h2").agg(F.sum("m").alias("n")).where("n > 1").select("h", "h2")
    alone = single.where("m = 1").join(twice, ["h", "h2"]).select("key", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(partial).unionByName(alone)


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    """A second hash of every string of ``length`` bytes."""
    import xxhash

    raw = data.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(len(raw) - length + 1)], np.uint64).view(np.int64)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False, **options) -> DataFrame:
    """(id, n_bytes, spans, kept): each row's bytes, its maximal repeated spans and the bytes that remain, in order.

    ``as_text``: kept is a string; characters that a span cuts through go whole, all others stay as they are.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    spans = repeat_spans(keyed.select("key", "text"), length, **options)
    listed = materialise(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    joined = keyed.join(listed.hint("merge"), "key", "left").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for at, texts in text_slices(batch, 1):
                sizes, merged, kept = [], [], []
                for k, text in enumerate(texts):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    out: list[list[int]] = []
                    for one in sorted((x["start"], x["end"]) for x in lists[at + k].as_py() or ()):
                        if out and one[0] <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], one[1])
                        else:
                            out.append(list(one))
                    edges = [0, *(x for span in out for x in span), len(data)]
                    sizes.append(len(data))
                    merged.append([{"start": s, "end": e} for s, e in out])
                    rest = [data[s:e] for s, e in zip(edges[::2], edges[1::2])]
                    kept.append("".join(x.decode("utf-8", "ignore") for x in rest) if as_text else b"".join(rest))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.string() if as_text else pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"id {_kind(keyed, 'id')}, n_bytes long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}")
