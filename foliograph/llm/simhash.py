"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Method: a 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a
word of the perfect binary (23, 12) Golay code. Up to three differing bits leave two segments
with at most one error each (pigeonhole). Two words one bit apart either decode to one codeword
or both lie three bits from their own codeword and four from the other's; so a word's own
codeword index, against the indices of all codewords within four bits of the other word, meets
every such pair. One side of the join carries one key for each pair of segments, the other up to
36; candidates are verified on the whole fingerprint, and components are built on links.

Equal fingerprints are one vertex, so groups of copies cost one row. Null or wordless texts have
fingerprint zero and are linked like any other. Rows that repeat keep one result each. A null id
takes part but can't be the smallest id of a component unless it has no other. Bits set in exactly
half of the shingles are 0. An empty table gives no rows.

``near_dedup`` uses the same codes on wide fingerprints to find near copies of a given similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, measured, numbered, text_slices

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and by syndrome six error patterns of up to four bits (-1: none)."""
    unit = np.array([_remainder(1 << b) for b in range(23)], np.int64)

    def spread(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, s in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ s
        return out

    errors = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    from itertools import combinations

    for weight in (0, 1, 2, 3):
        for at in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(unit[list(at)])) if at else 0
            errors[s, 0] = sum(1 << b for b in at)
            filled[s] = weight
    used = np.ones(2048, np.int64)
    for at in combinations(range(23), 4):
        s = int(np.bitwise_xor.reduce(unit[list(at)]))
        if filled[s] == 3:
            errors[s, used[s]] = sum(1 << b for b in at)
            used[s] += 1
    return spread(unit[:12]), spread(unit[12:]), errors


def near_codewords(words: np.ndarray, tables: tuple) -> np.ndarray:
    """(..., 6) indices of the codewords near each 23-bit word, the nearest first, -1 where there are fewer."""
    low, high, errors = tables
    found = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(found >= 0, (words[..., None] ^ found) >> 11, -1)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), 42)
    h = np.fromiter([digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])], np.uint64, len(words) - 2)
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every whole text, as a signed long."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fps: list[int] = []
            for _, texts in text_slices(batch, 1):
                fps += [fingerprint(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long")


def _keys(fps: DataFrame, wide: bool) -> DataFrame:
    """(key, fp): a key for each pair of segments; wide: for all near codewords of both, otherwise for the nearest ones."""

    def run(batches):
        tables = golay_tables()
        for batch in batches:
            fp = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for start in range(0, len(fp), 4096):
                part = fp[start : start + 4096]
                u = part.view(np.uint64)
                near = [near_codewords((u >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1), tables) for at, width in SEGMENTS]
                keys, owners = [], []
                for k, (i, j) in enumerate(PAIRS):
                    a, b = (near[i], near[j]) if wide else (near[i][:, :1], near[j][:, :1])
                    both = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
                    key = (k << 24) | (a[:, :, None] << 12) | b[:, None, :]
                    keys.append(key[both])
                    owners.append(np.broadcast_to(part[:, None, None], both.shape)[both])
                yield pa.record_batch([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(owners))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, fp long")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v) pairs, u < v, of the distinct fingerprints in ``fps`` (column fp) at max_bits or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("three segments cover up to three differing bits")
    one = _keys(fps, False).select("key", F.col("fp").alias("u"))
    many = _keys(fps, True).select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    return one.join(many.hint("merge"), "key").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links."""
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    parts = connected_components(links(classes, max_bits), "simhash-cc").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = classes.join(parts, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


#: Segments of a wide fingerprint, and the distances of the two further segments that make a key with each one.
WIDE = 32
APART = ((1, 11), (5, 16), (7, 20))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of n words, A-Z lower-cased; of the whole sequence if it is shorter."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    known: dict[bytes, int] = {}
    ids = np.fromiter([known[w] if w in known else known.setdefault(w, digest(w)) for w in words], np.uint64, len(words))
    m = len(words) - n + 1
    h = ids[:m]
    for k in range(1, n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m])
    return np.unique(h)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray, bits: int = 23 * WIDE) -> np.ndarray:
    """Signs of ``bits`` random projections of a non-empty shingle set, as 0 and 1.

    Weights follow a stable law of index near 0, so the heaviest shingle of a projection decides its sign, and
    two sets differ in a bit with probability (1 - Jaccard) / 2: 0.1 at 0.8, where signs of normal weights
    differ with 0.15. A bit's heaviest shingle is the first one in the bit's range of hashes or after it.
    """
    slot = ((shingles >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    heaviest = shingles[first][np.searchsorted(slot[first], np.arange(bits)) % len(first)]
    return (_mix(heaviest ^ _mix(np.arange(1, bits + 1, dtype=np.uint64))) >> np.uint64(63)).astype(np.uint8)


def sketches(rows: DataFrame) -> DataFrame:
    """(row long, same binary, size long, words binary) of rows (row, text): a hash of the set of five-word shingles, its
    size, and the segments of the wide fingerprint of three-word shingles as 32-bit integers (none without words)."""

    def run(batches):
        import xxhash

        weights = 1 << np.arange(23)
        for batch in batches:
            same, size, segments = [], [], []
            for _, texts in text_slices(batch, 1):
                for text in texts:
                    h, few = shingle_set(text), shingle_set(text, 3)
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                    size.append(len(h))
                    segments.append((wide_fingerprint(few).reshape(WIDE, 23) * weights).sum(1).astype("<i4").tobytes() if len(few) else None)
            yield pa.record_batch([batch.column(0), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(segments, pa.binary())], names=["row", "same", "size", "words"])

    return rows.select("row", "text").mapInArrow(run, "row long, same binary, size long, words binary")


def _wide_keys(classes: DataFrame) -> DataFrame:
    """(key, row, size, part): a key for each three segments of ``APART``, from the indices of the codewords nearest to
    them; ``part`` is 64 bits spread over the fingerprint, turned by the key's number."""
    segments = np.array([(i, (i + d) % WIDE, (i + e) % WIDE) for d, e in APART for i in range(WIDE)])

    def run(batches):
        tables, each = golay_tables(), len(segments)
        turns = np.arange(each, dtype=np.uint64) * np.uint64(11) % np.uint64(63) + np.uint64(1)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                some = batch.slice(start, 2048)
                words = np.frombuffer(b"".join(some.column(2).to_pylist()), "<i4").reshape(-1, WIDE).astype(np.int64)
                code = near_codewords(words, tables)[..., 0]
                key = np.arange(each) << 36 | code[:, segments[:, 0]] << 24 | code[:, segments[:, 1]] << 12 | code[:, segments[:, 2]]
                spread = (words >> 3 & 1) << np.arange(WIDE) | (words >> 14 & 1) << np.arange(WIDE, 2 * WIDE)
                part = np.bitwise_or.reduce(spread, axis=1).view(np.uint64)[:, None]
                part = (part << turns | part >> (np.uint64(64) - turns)).view(np.int64)
                row, size = (np.repeat(np.asarray(some.column(k), np.int64), each) for k in (0, 1))
                yield pa.record_batch([pa.array(key.ravel()), pa.array(row), pa.array(size), pa.array(part.ravel())], names=["key", "row", "size", "part"])

    return classes.where("words is not null").select("row", "size", "words").mapInArrow(run, "key long, row long, size long, part long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, set): the shingle sets of the ``rows`` (row, text) in ``wanted`` (row), made anew and written."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["row", "set"])

    return materialise(rows.join(wanted, "row", "left_semi").select("row", "text").mapInArrow(run, "row long, set array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of rows whose ``sets`` (row, set) are alike."""
    both = pairs.join(sets.select(F.col("row").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("row").alias("v"), F.col("set").alias("b")), "v")
    common, (above, below) = F.size(F.array_intersect("a", "b")), similarity
    return materialise(both.where((above + below) * common >= above * (F.size("a") + F.size("b"))).select("u", "v"), "links")


def near_links(rows: DataFrame, classes: DataFrame, similarity: tuple[int, int] = (4, 5), flips: int = 20, after: int = 4, nearest: int = 8) -> DataFrame:
    """(u, v): links that hang together as do all pairs of ``classes`` (row, size, words) that have a key in common and
    whose sets of five-word shingles share ``similarity`` (a fraction) of their union, or more; ``rows`` (row, text)
    has their texts.

    Texts with one key lie in a bucket, in order of the 64 bits of ``part``. First each is held against the ``after``
    next and the bucket's first, if ``flips`` or fewer of these bits differ; the ``nearest`` of those, and the two with
    the smallest numbers, are verified on whole texts. This joins most groups at a cost in proportion to the buckets.
    Then the rows of buckets that these links leave in two groups or more are joined exactly, by their shingles
    (``_between_groups``): no pair of them that is alike is left in two groups, however large a bucket is.
    """
    above, below = similarity
    by_key = Window.partitionBy("key").orderBy("part", "row")
    beside = F.lead("row").over(by_key).isNotNull() | F.lag("row").over(by_key).isNotNull()
    buckets = materialise(_wide_keys(classes).withColumn("beside", beside).where("beside").drop("beside"), "buckets")
    here = F.struct("row", "size", "part")
    met = buckets.withColumn("met", F.array(*(F.lead(here, k).over(by_key) for k in range(1, after + 1)), F.first(here).over(by_key)))

    def near(other):
        alike = F.bit_count(F.col("part").bitwiseXOR(other["part"])) <= flips
        return other.isNotNull() & (other["row"] != F.col("row")) & alike & (below * F.least(F.col("size"), other["size"]) >= above * F.greatest(F.col("size"), other["size"]))

    found = met.select("row", "part", F.filter("met", near).alias("met")).where(F.size("met") > 0).select("row", "part", F.explode("met").alias("other"))
    found = found.select("row", F.col("other.row").alias("other"), F.bit_count(F.col("part").bitwiseXOR(F.col("other.part"))).alias("far")).distinct()
    by_far, by_row = Window.partitionBy("row").orderBy("far", "other"), Window.partitionBy("row").orderBy("other")
    found = found.withColumn("a", F.row_number().over(by_far)).withColumn("b", F.row_number().over(by_row)).where((F.col("a") <= nearest) | (F.col("b") <= 2))
    pairs = materialise(found.select(F.least("row", "other").alias("u"), F.greatest("row", "other").alias("v")).distinct(), "pairs")
    sets = _sets(rows, pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct())
    groups = connected_components(_verified(pairs, sets, similarity), "near-first")
    discard(sets)
    named = buckets.join(groups.select(F.col("u").alias("row"), F.col("v").alias("root")), "row", "left").select("key", "row", "size", F.coalesce("root", "row").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = materialise(named.join(mixed, "key", "left_semi").select("row", "size", "root").distinct(), "apart")
    discard(buckets)
    sets = _sets(rows, apart)
    rest = materialise(_between_groups(apart.join(sets, "row"), similarity), "rest")
    links = _verified(rest, sets, similarity)
    discard(sets)
    return groups.unionByName(links)


def _between_groups(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(u, v), u < v: candidates among ``rows`` (row, size, root, set), with every pair that is alike and of two groups (root).

    Shingles are ordered by how many rows have them, those of a single group first. The first one that an alike pair has
    in common stands early in both: with c or more in common, no later than the c-th from the end (``left`` counts
    from there). So only the early shingles of each row meet, and a row with too many of its own meets none. A
    shingle's rows outside of its largest group are held against all of its rows.
    """
    above, below = similarity
    each = rows.select("row", "size", "root", F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle", "n")
    by_often = Window.partitionBy("row").orderBy("n", "shingle")
    placed = each.join(often, "shingle").withColumn("left", F.count("*").over(Window.partitionBy("row")) - F.row_number().over(by_often) + 1)
    early = materialise(placed.where(below * F.col("left") >= above * F.col("size")).select("shingle", "row", "size", "root", "left"), "early")
    groups = early.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("shingle").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).getField("root").alias("main")).where("roots > 1").select("shingle", "main")
    member = early.join(mixed, "shingle")
    minor = member.where("root <> main").select("shingle", F.col("row").alias("u"), F.col("size").alias("u_size"), F.col("root").alias("u_root"), F.col("left").alias("u_left"))
    both = minor.join(member, "shingle").where("u_root <> root and (root = main or u < row)")
    both = both.where((above + below) * F.least("u_left", "left") >= above * (F.col("u_size") + F.col("size")))
    return both.select(F.least("u", "row").alias("u"), F.greatest("u", "row").alias("v")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id, any one of them where that id repeats.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and all that
    such links reach. They are found by wide fingerprints of three-word shingles: 32 Golay segments, of which 96
    threes make keys. Tests hold the share of pairs that are found; texts of equal sets always are. Rows are told
    apart by a key, so rows of one id or without an id stay if their texts lie in different groups. A row whose id
    is null stays only where its whole group has no id. Wordless and null texts are copies of each other. An empty
    table stays empty.
    """
    rows, key = numbered(docs, id_col, "keyed")
    texts = rows.select(F.col(key).cast("long").alias("row"), F.col(text_col).alias("text"))
    made = materialise(sketches(texts), "sketches")
    ids = rows.select(F.col(key).cast("long").alias("row"), F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col(key).cast("long").alias("row")).alias("own"))
    if key == id_col:
        owned = made.withColumn("own", F.struct(F.lit(False).alias("absent"), F.col("row").alias("id"), "row"))
    else:
        owned = made.join(ids, "row")
    classes = materialise(owned.groupBy("same").agg(F.min("own").alias("low"), F.min(F.struct("row", "size", "words")).alias("one")).select("low", "one.*"), "classes")
    discard(made)
    parts = connected_components(near_links(texts, classes, **options), "near-cc").select(F.col("u").alias("row"), F.col("v").alias("root"))
    rooted = classes.join(parts, "row", "left").select(F.coalesce("root", "row").alias("root"), "low")
    keep = materialise(rooted.groupBy("root").agg(F.min("low").getField("row").alias("__kept")).select("__kept"), "kept")
    discard(classes)
    return rows.join(measured(keep), F.col(key) == F.col("__kept"), "left_semi").select(*docs.columns)
