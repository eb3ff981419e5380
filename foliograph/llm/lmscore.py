"""Cross-entropy difference: documents scored by matched target and background bigram models.

Both models share one vocabulary, order and smoothing. Words are runs of bytes outside ASCII white
space, A-Z lower-cased. The vocabulary is every word of the corpus, and the counts of words and of
word pairs are exact over all documents (background) and over the target rows, so what is gathered
grows with the input. The counts are never in one place: documents are read in blocks of bounded
size, a block asks for the words and pairs that it holds, once each with its own counts, and the
buckets that keys are dealt to add up what all blocks hold and answer. A bucket's size is bounded by
``bucket_bytes`` of text, whatever the corpus, but for one pair's rows: one for each block. Words and
pairs are told apart by 63-bit hashes.

The loss of a word is -log2 of the bigram estimate interpolated with the smoothed unigram one. A
document is scored by what the other documents hold: its own counts are left out of the background
and, where it is a target row, of the target model, so being labelled changes no score by itself. A
document's score is the difference of its losses a token, target less background: lower is nearer
to the target. Null or wordless texts have no tokens and null losses. Repeated rows count each and
are others to each other. Ties play no part. Without target rows the target model is flat. An empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_slices

#: Marks where a text starts; no word is empty.
START = b""


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def flagged(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, broadcast_rows: int = 5_000_000) -> DataFrame:
    """(id, text, aim): aim is 1 for rows whose id is in ``target`` (one id column), which is broadcast if it has few rows."""
    ids = target.select(F.col(target.columns[0]).alias("tid")).where("tid is not null").distinct()
    few = ids.count() <= broadcast_rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("tid"), "left").select("id", "text", F.col("tid").isNotNull().cast("int").alias("aim"))


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Odd keys of pairs of word keys."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, lowest bytes first, then compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _wide(data, n: int) -> np.ndarray:
    """The ``n`` numbers that ``_narrow`` packed."""
    data = memoryview(data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(data[1:], data[0] * n, "zstd", asbytes=True)
        out[:, : data[0]] = np.frombuffer(planes, np.uint8).reshape(data[0], n).T
    return out.view("<u8").ravel()


def _own(x: np.ndarray) -> np.ndarray:
    """How often each element's value stands in the array."""
    _, where, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[where]


class Block:
    """Some documents as word numbers, and the sorted keys of their words and pairs."""

    def __init__(self, seq: np.ndarray, lengths: np.ndarray, aims: np.ndarray, word_keys: np.ndarray):
        """``seq``: all texts in a row, each from its start mark on; ``lengths`` with the mark, 0 for wordless texts."""
        self.seq, self.lengths, self.aims, self.word_keys = seq, lengths, aims, word_keys
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        follows = np.ones(len(seq), bool)
        follows[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        self.at = np.flatnonzero(follows)
        pair_keys, self.pair = np.unique(_pair_keys(word_keys[seq[self.at - 1]], word_keys[seq[self.at]]), return_inverse=True)
        self.n_pairs = len(pair_keys)
        keys = np.concatenate([word_keys, pair_keys])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    @classmethod
    def read(cls, texts: list[str | None], aims: list[int]) -> Block:
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        parts, lengths = [], []
        for text in texts:
            w = words(text)
            lengths.append(len(w) + 1 if w else 0)
            if w:
                parts.append(np.fromiter(map(index.__getitem__, [START, *w]), np.uint32, len(w) + 1))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)) & ~np.uint64(1)
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(lengths, np.int64), np.array(aims, np.int64), keys)

    def cuts(self, bits: int) -> np.ndarray:
        """Where the keys of each of the ``2**bits`` buckets begin, and the end of the last."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """By key, how often it stands in the block and in its target rows."""
        out = []
        for held in (np.ones(len(self.aims), bool), self.aims > 0):
            some = held[self.doc]
            pairs = np.bincount(self.pair[some[self.at]], minlength=self.n_pairs)
            out.append(np.concatenate([np.bincount(self.seq[some], minlength=len(self.word_keys)), pairs])[self.order])
        return out[0], out[1]

    def losses(self, every: np.ndarray, aimed: np.ndarray, totals: tuple[int, int, int], mix: float, smooth: float) -> tuple[np.ndarray, np.ndarray]:
        """Bits a token of each document under the target and the background model, without its own counts.

        ``every`` and ``aimed`` are the corpus's counts by key; ``totals`` are distinct words, and words in all and in target rows.
        """
        n, at, doc = len(self.word_keys), self.at, self.doc[self.at]
        own_two, own_one = _own(doc * max(self.n_pairs, 1) + self.pair), _own(self.doc * max(n, 1) + self.seq)
        size, tokens = totals[0], np.maximum(self.lengths - 1, 1)
        out = []
        for sums, total, held in ((aimed, totals[2], self.aims), (every, totals[1], np.ones_like(self.aims))):
            found = np.empty(len(sums), np.int64)
            found[self.order] = sums
            one, two, held_at = found[:n], found[n:], held[doc]
            # Word counts stand for how often a word is followed, but for text ends.
            history = np.maximum(one[self.seq[at - 1]] - held_at * own_one[at - 1], 1)
            pair = (two[self.pair] - held_at * own_two) / history
            single = (one[self.seq[at]] - held_at * own_one[at] + smooth) / (total - (held * self.lengths)[doc] + smooth * size)
            out.append(np.bincount(doc, -np.log2(mix * pair + (1 - mix) * single), len(self.lengths)) / tokens)
        return out[0], out[1]


def blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows (id, text, aim) as blocks: their ids, word keys, word numbers, and lengths with target marks in the lowest bit."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            aims = batch.column(2).to_pylist()
            for at, texts in text_slices(batch, 1, 1 << 20, block_bytes):
                b = Block.read(texts, aims[at : at + len(texts)])
                ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0).slice(at, len(texts)))
                packed = [pa.array([x], pa.binary()) for x in (b.word_keys.tobytes(), _narrow(b.seq), _narrow(b.lengths * 2 + b.aims))]
                yield pa.record_batch([pa.array([block], pa.int64()), ids, *packed], names=["block", "ids", "words", "seq", "lengths"])
                block += 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "aim").mapInArrow(run, f"block long, ids array<{kind}>, words binary, seq binary, lengths binary")


def _unpack(n_docs: int, word_keys, seq, lengths) -> Block:
    packed = _wide(lengths.as_buffer(), n_docs).astype(np.int64)
    long = packed >> 1
    return Block(_wide(seq.as_buffer(), int(long.sum())).astype(np.int64), long, packed & 1, np.frombuffer(word_keys.as_buffer(), np.uint64))


def ask(held: DataFrame, bits: int) -> DataFrame:
    """What blocks ask of each bucket: steps between sorted keys, and the block's own counts in all and in target rows."""

    def run(batches):
        for batch in batches:
            for k, block in enumerate(batch.column("block").to_pylist()):
                b = _unpack(len(batch.column("ids")[k]), *(batch.column(c)[k] for c in ("words", "seq", "lengths")))
                every, aimed = b.counts()
                cuts = b.cuts(bits)
                some = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[c], cuts[c + 1]) for c in some]
                packed = [[_narrow(np.diff(b.keys[x], prepend=np.uint64(0))) for x in spans], [_narrow(every[x]) for x in spans], [_narrow(aimed[x]) for x in spans]]
                numbers = [pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([x.stop - x.start for x in spans], pa.int32())]
                yield pa.record_batch([*numbers, *(pa.array(x, pa.binary()) for x in packed)], names=["block", "bucket", "size", "keys", "n", "aimed"])

    return held.mapInArrow(run, "block long, bucket int, size int, keys binary, n binary, aimed binary")


def answer(asked: DataFrame) -> DataFrame:
    """For each block and bucket the corpus's counts of the keys asked for; block -1 holds a bucket's distinct words and words in all and in target rows."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sizes = group["size"].to_pylist()
        keys = [np.cumsum(_wide(x.as_buffer(), n)) for x, n in zip(group["keys"], sizes)]
        ends = np.cumsum(sizes)
        seen, where = np.unique(np.concatenate(keys), return_inverse=True)
        packed, sums = [], []
        for name in ("n", "aimed"):
            own = np.concatenate([_wide(x.as_buffer(), n) for x, n in zip(group[name], sizes)])
            sums.append(np.zeros(len(seen), np.int64))
            np.add.at(sums[-1], where, own.astype(np.int64))
            packed.append([_narrow(x) for x in np.split(sums[-1][where], ends[:-1])])
        word = (seen & np.uint64(1)) == 0
        rest = [None] * len(keys)
        return pa.table(
            {
                "block": pa.array([*group["block"].to_pylist(), -1], pa.int64()),
                "bucket": pa.array([*group["bucket"].to_pylist(), group["bucket"][0].as_py()], pa.int32()),
                "n": pa.array([*packed[0], None], pa.binary()),
                "aimed": pa.array([*packed[1], None], pa.binary()),
                "size": pa.array([*rest, int(word.sum())], pa.int64()),
                "total": pa.array([*rest, int(sums[0][word].sum())], pa.int64()),
                "aim_total": pa.array([*rest, int(sums[1][word].sum())], pa.int64()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, n binary, aimed binary, size long, total long, aim_total long")


def score_documents(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", mix: float = 0.7, smooth: float = 0.5, block_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20
) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, difference) of every row of ``docs``; ``target`` holds the ids of the target documents in its first column."""
    rows = flagged(docs, target, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = max(0, (size // bucket_bytes).bit_length())
    held = materialise(blocks(rows, block_bytes), "blocks")
    answered = materialise(answer(ask(held, bits)), "answered")
    totals = tuple(x or 0 for x in answered.where("block < 0").agg(F.sum("size"), F.sum("total"), F.sum("aim_total")).first())

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bucket = group["bucket"].to_pylist()
        k = bucket.index(None)  # the block's own row
        ids = group["ids"].chunk(0).slice(k, 1).flatten()
        b = _unpack(len(ids), *(group[c][k] for c in ("words", "seq", "lengths")))
        cuts = b.cuts(bits)
        sums = np.zeros((2, len(b.keys)), np.int64)
        for j, c in enumerate(bucket):
            if c is not None:
                for row, name in zip(sums, ("n", "aimed")):
                    row[cuts[c] : cuts[c + 1]] = _wide(group[name][j].as_buffer(), int(cuts[c + 1] - cuts[c]))
        t, g = b.losses(sums[0], sums[1], totals, mix, smooth)
        none = b.lengths == 0
        return pa.table(
            {
                "id": ids,
                "n_tokens": pa.array(np.maximum(b.lengths - 1, 0), pa.int64()),
                "target_loss": pa.array(t, pa.float64(), mask=none),
                "background_loss": pa.array(g, pa.float64(), mask=none),
                "difference": pa.array(t - g, pa.float64(), mask=none),
            }
        )

    kind = rows.schema["id"].dataType.simpleString()
    found = answered.where("block >= 0").select("block", "bucket", "n", "aimed")
    return held.unionByName(found, allowMissingColumns=True).groupBy("block").applyInArrow(run, f"id {kind}, n_tokens long, target_loss double, background_loss double, difference double")
