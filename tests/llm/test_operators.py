"""Operators against brute force on a small table with odd rows, and on an empty one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import ann, htmltext, langid, licenses, lmscore, mixing, packing, quality, simhash, suffixes

from .data import documents, nothing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def test_quality_statistics(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r)[:7] for r in quality.quality_scores(docs, labels).drop("score", "kept").collect())
    want = Counter()
    for r in rows:
        text = r["text"] or ""
        w = WORD.findall(text)
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert got == want


def test_quality_without_labels_or_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_scores(docs, labels).collect())
    assert quality.quality_scores(nothing(spark), labels).count() == 0
    assert quality.keep_quality(nothing(spark), labels).columns == docs.columns


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.4) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.Trees().fit(x, y, [-1, 0, 0])
    p = quality.tree_scores(x, trees.base, trees.depth, trees.flat)
    assert ((p > 0.5) == y).mean() > 0.93
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.7)])
    assert (np.diff(quality.tree_scores(grid, trees.base, trees.depth, trees.flat)) <= 1e-12).all()


def test_golay_words_within_one_bit_share_a_key():
    tables = simhash.golay_tables()
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 23, 20_000)
    b = a ^ (1 << rng.integers(0, 23, len(a)))
    near_a, near_b = simhash.near_codewords(a, tables), simhash.near_codewords(b, tables)
    assert (near_b == near_a[:, :1]).any(1).all() and (near_a == near_b[:, :1]).any(1).all()


def components(fps: list[int], ids: list) -> dict[int, int]:
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i in range(len(fps)):
        if ids[i] is not None:
            low[find(i)].append(ids[i])
    return {i: min(low[find(i)], default=None) for i in range(len(fps))}


def test_fingerprint_by_hand():
    import xxhash

    def by_hand(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(w)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    for text in (None, "", " ", "One", "É É", "a b c a b c a b c", "x y z w v u t s " * 20):
        assert simhash.fingerprint(text) == by_hand(text)


def test_links_of_planted_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    flips = base.copy()
    for k in range(len(flips)):
        for b in rng.choice(63, k % 5, replace=False):
            flips[k] ^= np.int64(1) << np.int64(b)
    fps = sorted({*base.tolist(), *flips.tolist()})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want and len(want) >= 180


def test_components(spark, docs, rows):
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    low = components(fps, [r["doc_id"] for r in rows])
    got = Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.simhash_components(docs).collect())
    assert got == Counter((r["doc_id"], fps[i], low[i]) for i, r in enumerate(rows))
    assert simhash.simhash_components(nothing(spark)).count() == 0


def shingle_classes(texts: list, similarity: float = 0.8) -> list[int]:
    """By all pairs: each text's group, by the place of its first member."""
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_near_copies(spark, docs, rows):
    import random

    rng = random.Random(8)
    texts = [(r["doc_id"], r["text"]) for r in rows]
    for k in range(60):  # copies with words changed here and there, and with the end cut off
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        texts.append((1000 + 10 * k, " ".join(w)))
        for j in range(1, 4):
            new = [x if rng.random() > 0.02 * j else "new" for x in w] if k % 2 else w[: int(len(w) * (1 - 0.07 * j))]
            texts.append((1000 + 10 * k + j, " ".join(new)))
    group = shingle_classes([t for _, t in texts])
    low = defaultdict(list)
    for (i, _), g in zip(texts, group):
        if i is not None:
            low[g].append(i)
    want = {min(x) for x in low.values()}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    kept = simhash.near_dedup(df)
    got = [r["doc_id"] for r in kept.where("doc_id is not null").collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 4  # hardly a link is missed
    assert simhash.near_dedup(docs).columns == docs.columns and simhash.near_dedup(nothing(spark)).count() == 0


def test_large_groups_of_near_copies(spark):
    """A group in which most pairs are just under the similarity and few above: nine of ten documents that must go do."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.choice([2, 5, 6])):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = list(base[:200])
    for i in range(0, 200, 8):  # each step near the one before
        chain[i] = f"y{i}"
        texts.append(" ".join(chain) + " z")
    group = shingle_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in simhash.near_dedup(df).collect()}
    assert set(group) <= got and len(texts) - len(got) >= 0.9 * (len(texts) - len(set(group)))


def test_no_link_of_a_bucket_is_dropped(spark):
    """A bucket of 250 rows, most pairs of them just under the similarity: all that must go do, by all pairs."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.choice([2, 5, 6])):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.near_dedup(df).collect()} == set(shingle_classes(texts))


def test_candidates_between_groups(spark):
    """Every alike pair of two groups is a candidate, by brute force; pairs of one group are none."""
    rng = np.random.default_rng(5)
    sets = []
    for k in range(40):
        base = rng.choice(10**6, rng.integers(1, 60), replace=False)
        for _ in range(6):
            a = base[rng.random(len(base)) < rng.choice([0.8, 0.95, 1.0])]
            sets.append(sorted({*a.tolist(), *rng.choice(50, rng.integers(1, 4)).tolist()}))
    rows = [(i, len(x), int(rng.integers(0, 3)) if i % 2 else 1000 + i, x) for i, x in enumerate(sets)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and 5 * len({*a[3]} & {*b[3]}) >= 4 * len({*a[3]} | {*b[3]})}
    df = spark.createDataFrame(rows, "row long, size long, root long, set array<long>").repartition(3)
    got = [tuple(r) for r in simhash._between_groups(df, (4, 5)).collect()]
    root = {r[0]: r[2] for r in rows}
    assert len(got) == len(set(got)) and want and want <= set(got) and all(u < v and root[u] != root[v] for u, v in got)


def test_wide_keys_find_near_copies():
    """The share of pairs that meet by a key: words changed here and there, and the end cut off."""
    rng = np.random.default_rng(6)
    tables, weights = simhash.golay_tables(), 1 << np.arange(23)

    def codes(words):
        fp = simhash.wide_fingerprint(simhash.shingle_set(" ".join(map(str, words)), 3))
        return simhash.near_codewords((fp.reshape(simhash.WIDE, 23) * weights).sum(1), tables)[:, 0]

    def alike(a, b):
        x, y = (set(simhash.shingle_set(" ".join(map(str, w))).tolist()) for w in (a, b))
        return len(x & y) / len(x | y)

    met, seen = Counter(), Counter()
    for n in (60, 200, 800):
        for k in range(400):
            a = rng.integers(0, 4000, n)
            b = a.copy()
            if k % 2:
                at = rng.choice(n, max(1, int(n * rng.uniform(0.005, 0.025))), replace=False)
                b[at] = 9000 + at
            else:
                b = b[: int(n * rng.uniform(0.8, 0.99))]
            j = alike(a, b)
            if j < 0.8:
                continue
            kind = "words" if k % 2 else "end above 0.9" if j >= 0.9 else "end"
            x, y = codes(a), codes(b)
            seen[kind] += 1
            met[kind] += any(all(x[(i + d) % simhash.WIDE] == y[(i + d) % simhash.WIDE] for d in (0, *ds)) for ds in simhash.APART for i in range(simhash.WIDE))
    share = {k: met[k] / seen[k] for k in seen}
    assert share["words"] >= 0.97 and share["end above 0.9"] >= 0.97 and share["end"] >= 0.8, share


def test_rows_without_own_id_are_judged_by_row(spark):
    def prose(k, n=80):
        return " ".join(f"w{k}x{i}" for i in range(n))

    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (9, prose(4)), (5, prose(5)), (None, prose(5)), (None, "short"), (5, "short too")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter([(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (5, prose(5)), (None, "short"), (5, "short too")])
    assert Counter(map(tuple, simhash.near_dedup(df).collect())) == want
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Counter(map(tuple, quality.keep_quality(df, labels).collect())) == Counter(r for r in rows if "short" not in r[1])


def test_long_chain_is_one_component(spark):
    from foliograph.llm.common import connected_components

    chain = spark.range(200).selectExpr("id as u", "id + 1 as v").unionByName(spark.range(5).selectExpr("1000 as u", "1001 + id as v"))
    got = {r["u"]: r["v"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1006)}


def removed(texts: list[str], length: int) -> list[np.ndarray]:
    blobs = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats(docs, rows, crowd):
    want = Counter()
    for r, mask in zip(rows, removed([r["text"] for r in rows], 200)):
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        want[(r["doc_id"], len(data), tuple(suffixes._runs(mask)), data[~mask].tobytes())] += 1
    got = Counter((r["id"], r["n_bytes"], tuple(tuple(s) for s in r["spans"]), bytes(r["kept"])) for r in suffixes.cut_repeats(docs, crowd=crowd).collect())
    assert got == want


def test_repeated_starts_by_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([2, 3, 5, 9])
        parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))]
        count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [len(p) - i >= length and count[p[i : i + length]] > 1 for p in parts for i in range(len(p))]
        assert suffixes.repeated_starts(parts, length).tolist() == want


def test_contexts_own_every_string_once_across_stretches(monkeypatch):
    import random

    rng = random.Random(5)
    text = "".join(rng.choice("ab cd") for _ in range(5000))
    monkeypatch.setattr(suffixes, "STRETCH", 1 << 10)
    seen = Counter()
    rolling = suffixes.Rolling(1 << 10)
    for data, ends, who, where in suffixes.stretches([text, "short", None, text[:700]]):
        begin = np.r_[0, ends[:-1]]
        of, start, n, _, _ = suffixes.contexts(data, ends, rolling)
        for o, s, k in zip(of, start, n):
            seen.update((int(who[o]), int(s - begin[o] + where[o] + j)) for j in range(k))
    assert seen == Counter({(0, i): 1 for i in range(4801)} | {(3, i): 1 for i in range(501)})


def test_no_repeats_in_nothing(spark):
    assert suffixes.cut_repeats(nothing(spark)).count() == 0


def test_mix(spark, docs, rows):
    got = mixing.mix_copies(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, total = {}, set(order), float(sum(size.values()))
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= over
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        taken[r["source"]] += r["copies"] * r["size"]
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_copies(docs.repartition(5)).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(1 if r["size"] == 0 else r["copies"] for r in got)
    assert mixing.mix_copies(nothing(spark)).count() == 0 and mixing.mixed(nothing(spark)).count() == 0


def test_newton_reaches_the_target(spark):
    t = spark.createDataFrame([("a", 100, 300.0), ("b", 100, 0.001), (None, 7, 7.0), ("d", 0, 0.0), ("e", 10**9, 1.0), ("f", 50, 120.0)], "source string, source_size long, target double")
    classes = spark.createDataFrame([(r["source"], r["source_size"] // 4 * k, 1) for r in t.collect() for k in (1, 3)] + [(None, 1, 3)], "source string, size long, n long")
    classes = classes.where("size > 0")
    sums = {r["source"]: r["s"] for r in classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).collect()}
    for r in mixing.newton_rates(classes, t.where("source <> 'a' or source is null")).collect():
        assert r["rate"] <= 3 and math.isclose(r["rate"] * sums.get(r["source"], 0), r["target"], rel_tol=1e-9)
    (r,) = mixing.newton_rates(classes, t.where("source = 'a'")).collect()
    assert math.isclose(r["rate"], 3)  # at its bound


def test_mix_meets_targets_by_exchanges(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 7, 50, 332, 596, 900])), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_copies(df).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(1.0, 0.001 * r["target"]) and r["most"] <= 3 for r in got)


def test_pack(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at, piece = 0, 0
        while at < len(ids):
            end = at + ((len(ids) - at) % 2048 or 2048)
            want[(r["doc_id"], piece, at, end - at, zlib.crc32(ids[at:end].tobytes()))] += 1
            at, piece = end, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(nothing(spark)).count() == 0


def test_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    enc, library = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello  world\n\n it's  fine", " lead", "trail ", "a b  c", "日本語 テキスト emoji 🙂🙂", "x" * 300, "  ", "", "tabs\t and 123abc 4_5 don't", "<|endoftext|> in text", "ﬁ ß É\x85 \x1c y", "aaaa aaaa aaaaaaaa", "\r\n \r\n x"]
    texts += ["abcdefghijklmnop" * 62_500, " " * 200_000, "\n " * 50_000]  # a word of a million letters, long white space
    rng = random.Random(4)
    letters = [*map(chr, range(32, 127)), *"\n\t\r\u2003\u00a0éßÀ日本\u200b½\x00\x85😀ſ'", "'s", " 'll", "<|endoftext|>", " the", "ing"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_ranks_refuse_files_whose_ids_do_not_follow_the_merges(tmp_path):
    import json

    model = json.load(open(packing.default_tokenizer(), encoding="utf-8"))["model"]
    model["merges"] = model["merges"][:1][::-1] + model["merges"][2:3] + model["merges"][1:2]
    (tmp_path / "odd.json").write_text(json.dumps({"model": model}))
    with pytest.raises(ValueError):
        packing.merge_ranks(str(tmp_path / "odd.json"))


def test_local_search_empties_bins():
    start = {(6, 3): 1, (5, 2): 1, (4,): 1}  # 20 in three bins of 10
    out = packing.local_search(start, 10)
    assert sum(out.values()) == 2 and sorted(x for c, n in out.items() for x in c * n) == [2, 3, 4, 5, 6]
    assert packing.local_search({(6,): 3}, 10) == {(6,): 3}


def vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist()) for i in range(50)]  # one vector many times
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (2150, [None] * 8), (2200, []), (2250, [1.0]), (None, x[5].tolist()), rows[9], rows[9], (3000, (2 * x[9]).tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


def test_search_is_exact_when_it_visits_all(spark):
    df, rows = vectors(spark)
    have = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    got = defaultdict(list)
    for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    asks = {i for i in have if i % 50 == 0}
    assert set(got) == asks
    for q in asks:
        s = {i: float(have[q] @ v / np.linalg.norm(have[q]) / np.linalg.norm(v)) for i, v in have.items() if i != q}
        want = sorted(s, key=lambda i: (-round(s[i], 12), i))[:5]
        assert [i for i, _ in got[q]] == want and all(math.isclose(x, s[i], abs_tol=1e-12) for i, x in got[q])


def test_search_in_groups_of_queries_and_clashing_columns(spark):
    df, _ = vectors(spark)
    asks = F.col("vec_id") % 50 == 0
    want = sorted(map(tuple, ann.search(df, "vec_id", "embedding", asks).collect()))
    more = df.withColumns({"id": F.lit("x"), "key": F.lit(None).cast("int"), "cell": F.lit(1), "vec": F.lit(2.0)})
    assert sorted(map(tuple, ann.search(more, "vec_id", "embedding", asks, block=64, queries_at_once=3).collect())) == want


def test_recall_on_many_vectors(spark):
    """25,000 vectors without clusters: a fifth of the index is visited by cells, against an exact search."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(25_000, 16)).astype(np.float32)
    x[::3] += 2 * x[rng.integers(0, 50, len(x[::3]))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hits = 0
    got = defaultdict(set)
    for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, share=0.2).collect():
        got[r["query_id"]].add(r["id"])
    for q in range(0, len(x), 50):
        s = y @ y[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 500


def test_search_recall_and_few_rows(spark):
    df, rows = vectors(spark)
    exact = {(r["query_id"], r["id"]) for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, share=1.0).collect()}
    some = {(r["query_id"], r["id"]) for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, entries=10, centroids=8).collect()}
    assert len(exact & some) >= 0.9 * len(exact)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 0.0)]
    assert ann.search(few.where("vec_id > 5"), "vec_id", "embedding", F.lit(True)).count() == 0


def test_visits_go_by_distance():
    rng = np.random.default_rng(0)
    left, right = rng.random(6), rng.random(7)
    cells = ann.visit(left, right, np.ones(42, np.int64), 42)
    sums = [left[c // 7] + right[c % 7] for c in cells]
    assert len(set(cells)) == 42 and sums == sorted(sums)


def test_language(spark, docs, rows):
    text = {"en": "the cat and the dog walk with them", "fr": "le chat et la vache où été déjà", "de": "der hund und die katze über straße"}
    train = spark.createDataFrame([(t * 3, k) for k, t in text.items()] + [(None, "en"), ("x", None), ("", "fr")], "text string, lang string")
    langs, profiles = langid.prototypes(train)
    assert langs == ["de", "en", "fr"]
    ask = spark.createDataFrame([(1, "the dog"), (2, "la vache été"), (3, "die straße über"), (4, None), (5, "123 !?"), (None, "the cat")], "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(ask, langs, profiles).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "fr", 3: "de", 4: "und", 5: "und", None: "en"}
    assert got[4][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert langid.prototypes(nothing(spark))[0] == []
    assert {r["lang_pred"] for r in langid.predict(docs, [], np.zeros((0, langid.DIM))).collect()} == {"und"}


def test_language_bundle_is_the_sum_of_bound_vectors():
    space = langid.Space(dim=64)
    keys, counts = space.trigrams("abab")
    vec = space.bundle(keys, counts)
    letters = [space.letters[ord(c)] if c != " " else space.letters[0] for c in " abab "]
    want = sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(letters, letters[1:], letters[2:]))
    assert (vec == want).all()


def test_scores(spark, docs, rows):
    aim = spark.createDataFrame([(i,) for i in range(0, 30)] + [(None,)], "doc_id long")
    got = lmscore.score_documents(docs, aim).collect()
    assert Counter((r["id"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows)
    assert all((r["difference"] is None) == (r["n_tokens"] == 0) for r in got)
    assert all(math.isclose(r["difference"], r["target_loss"] - r["background_loss"]) for r in got if r["n_tokens"])
    assert lmscore.score_documents(nothing(spark), aim).count() == 0
    clash = docs.withColumn("block", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("aim", F.lit("x")).withColumn("tid", F.lit(0))
    assert lmscore.score_documents(clash, aim).count() == len(rows)
    flat = lmscore.score_documents(docs, aim.limit(0)).collect()
    assert len(flat) == len(rows) and all((r["target_loss"] is None) == (r["n_tokens"] == 0) for r in flat)


def test_counts_of_a_block():
    """Each word and pair of a block stands once among its keys, with its exact counts."""
    texts, aims = ["a b a B", "b a zz", None, " \n"], [1, 0, 1, 0]
    b = lmscore.Block.read(texts, aims)
    key = {w: lmscore.xxhash.xxh64_intdigest(w) & ~1 for w in (b"", b"a", b"b", b"zz")}
    pair = lambda x, y: int(lmscore._pair_keys(np.array([key[x]], np.uint64), np.array([key[y]], np.uint64))[0])
    want = {key[b""]: (2, 1), key[b"a"]: (3, 2), key[b"b"]: (3, 2), key[b"zz"]: (1, 0)}
    want |= {pair(b"", b"a"): (1, 1), pair(b"a", b"b"): (2, 2), pair(b"b", b"a"): (2, 1), pair(b"", b"b"): (1, 0), pair(b"a", b"zz"): (1, 0)}
    assert dict(zip(b.keys.tolist(), zip(*(x.tolist() for x in b.counts())))) == want
    for bits in (0, 1, 5):
        cuts = b.cuts(bits)
        assert len(cuts) == 2**bits + 1
        assert all(int(k) >> (64 - bits) == c for c in range(2**bits) for k in b.keys[cuts[c] : cuts[c + 1]])
    for top in (0, 255, 256, 1 << 16, 1 << 32, 1 << 40):
        assert lmscore._wide(lmscore._narrow(np.array([1, top, 0])), 3).tolist() == [1, top, 0]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2_000, "bucket_bytes": 1_000}])
def test_losses_by_brute_force(spark, docs, rows, options):
    """Every document against a model counted anew from all others, by words; in one block and in many blocks and buckets."""
    aimed = set(range(0, 30))
    aim = spark.createDataFrame([(i,) for i in aimed], "doc_id long")
    got = Counter((r["id"], r["n_tokens"], r["target_loss"] and round(r["target_loss"], 6), r["background_loss"] and round(r["background_loss"], 6)) for r in lmscore.score_documents(docs, aim, **options).collect())
    ids = [["<s>", *x] if x else [] for x in (lmscore.words(r["text"]) for r in rows)]
    size = len({w for x in ids for w in x})
    want = Counter()
    for i, x in enumerate(ids):
        losses = []
        for target in (True, False):
            others = [y for j, y in enumerate(ids) if j != i and (not target or rows[j]["doc_id"] in aimed)]
            one, two = Counter(w for y in others for w in y), Counter(p for y in others for p in zip(y, y[1:]))
            total = sum(one.values())
            bits = [-math.log2(0.7 * two[a, b] / max(one[a], 1) + 0.3 * (one[b] + 0.5) / (total + 0.5 * size)) for a, b in zip(x, x[1:])]
            losses.append(round(sum(bits) / len(bits), 6) if bits else None)
        want[(rows[i]["doc_id"], max(0, len(x) - 1), *losses)] += 1
    assert got == want


def test_a_second_copy_lowers_the_background_loss(spark):
    """Rare words count: of two texts of words that nothing else holds, the one that occurs twice is better known."""
    texts = [f"the house of number {i} stands here" for i in range(300)] + ["qux quux corge grault garply waldo", "plugh xyzzy thud fred wibble wobble", "plugh xyzzy thud fred wibble wobble"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in lmscore.score_documents(docs, docs.where("doc_id < 100").select("doc_id")).collect()}
    assert got[301]["background_loss"] + 3 < got[300]["background_loss"] and got[301]["difference"] > got[300]["difference"] + 3


def test_being_labelled_changes_no_score(spark):
    docs = spark.createDataFrame([(i, f"the {'cat' if i % 2 else 'dog'} number {i * 7919} sat by {i * 31} and w{i}") for i in range(200)], "doc_id long, text string")
    aim = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    by = defaultdict(list)
    for r in lmscore.score_documents(docs, aim).collect():
        by["labelled" if r["id"] % 2 and r["id"] < 100 else "held out" if r["id"] % 2 else "other"].append(r["difference"])
    labelled, held, other = (float(np.mean(by[k])) for k in ("labelled", "held out", "other"))
    assert abs(labelled - held) < 0.1 and other > held + 0.1


def test_licences(spark, docs):
    model = licenses.Classifier()
    assert model.accuracy > 0.93
    text = "Some prose here.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\n\nthe license of the work is general"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "This work is licensed under the GNU General Public License, version 2."), (5, "The apache license of version and public rights")], "doc_id long, text string")
    got = {r["id"]: (r["n_paragraphs"], [(h["paragraph"], h["family"]) for h in r["hits"]]) for r in licenses.license_hits(df, model=model).collect()}
    assert got == {1: (4, [(1, "mit"), (2, "cc-by-nc")]), 2: (0, []), 3: (0, []), 4: (1, [(0, "gpl")]), 5: (1, [])}
    assert licenses.license_hits(docs, model=model).count() == docs.count()


def test_wrapped_and_shared_lines_of_licences(spark):
    texts = {
        1: ("Copyright\nyou can redistribute it and modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version", [(2, "gpl")]),
        2: ("/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal", [(0, "mit")]),
        3: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:", [(0, "bsd")]),
        4: ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided", [(0, "isc")]),
        5: ("Released under the MIT License. Licensed under the Mozilla Public License, Version 2.0.", [(0, "mit"), (0, "mpl")]),
        6: ("it under the terms of the GNU General Public License as published by\n\nthe Free Software Foundation", []),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r["id"]: sorted((h["paragraph"], h["family"]) for h in r["hits"]) for r in licenses.license_hits(df).collect()}
    assert got == {k: want for k, (_, want) in texts.items()}


def test_own_templates_are_found():
    model = licenses.Classifier()
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            words = licenses.tokens("Note: " + t)
            assert model.predict(words)[0] == family and model.confirm(family, words) >= 0.8


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><div id='cookie-notice'>We use cookies</div><nav><ul><li><a href='/'>Home {0}</a></ul></nav><main><h1>Title {0}</h1><p>First &amp; <b>bold</b>\n text&nbsp;{0}<br>more<p>Second {0}<script>if (a < b) x('</p>')</script></p><div class='ad'>Buy {0}</div><ul><li>one<li>two {0}</ul></main><section class='comments'><p>Nice {0}</section><footer>(c) {0}</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"https://Example.org/{i}", PAGE.format(i)) for i in range(12)] + [(100, None, None), (101, "x", ""), (102, "https://a.b/", "plain text\n here"), (103, "https://a.b/", "<p>un<closed <b>x"), (None, "https://example.org/9", PAGE.format(9)), (0, "https://Example.org/0", PAGE.format(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options in ({}, {"broadcast_bytes": 0, "salts": 3}):
        out = htmltext.extract(df, **options).collect()
        assert len(out) == len(rows)
        got = {r["id"]: r["text"] for r in out}
        assert got[3] == "Title 3\nFirst & bold text 3 more\nSecond 3\none\ntwo 3"
        assert got[100] == "" and got[101] == "" and got[102] == "plain text here"
    assert htmltext.extract(df.where("page_id > 999")).count() == 0


def test_fixed_text_of_hosts_without_article(spark):
    page = "<body><div>Always here</div><p>Own {0} text</p></body>"
    rows = [(i, "http://a.org/", page.format(i)) for i in range(9)] + [(50 + i, "http://b.org/", page.format(7)) for i in range(9)]
    got = {r["id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Own 4 text" and got[53] == "Always here\nOwn 7 text"


def test_template_classes(spark):
    """Classes by whole occurrence vectors, written out, give the same slots and texts."""
    pages = [PAGE.format(i) + ("<p>Now and then</p>" if i % 3 else "") for i in range(10)]
    df = spark.createDataFrame([(i, "https://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    (t,) = htmltext.templates(df).collect()
    vectors, chars, links = defaultdict(lambda: [0] * 10), Counter(), Counter()
    read = htmltext.Reader()
    for i, page in enumerate(pages):
        blocks, paths = read.blocks(page)
        for path, n in paths.items():
            vectors[path, 0][i] = n
        for path, text, _, _, n, _ in blocks:
            vectors[path, text][i] += 1
            chars[path, 0] += len(text)
            chars[path, text] += len(text)
            links[path] += n
    size = Counter(map(tuple, vectors.values()))
    valid = {k for k, v in vectors.items() if sum(map(bool, v)) >= 5 and size[tuple(v)] > 1}
    own = Counter()
    for path, text in valid:
        if text:
            own[path] += chars[path, text]
    slots = {p for p, x in valid if not x and chars[p, 0]}
    signed, hashed = htmltext._signed, lambda x: htmltext._signed(htmltext._hash(x))
    assert set(t["slots"]) == set(map(signed, slots)) and set(t["fixed"]) == {hashed(x) for _, x in valid if x}
    assert set(t["other"]) == {signed(p) for p in slots if 2 * links[p] > chars[p, 0] or 2 * own[p] > chars[p, 0]}
    assert {hashed("We use cookies"), hashed("one")} <= set(t["fixed"]) and len(t["other"]) >= 2


def test_templates_decide(spark):
    """With its template a page loses what the host repeats; without it, it doesn't: with and without a marked article."""
    call = "<p class='call'>Read on with our weekly letter</p>"
    marked = "<body><article><h1>Title {0}</h1><p>Story {0} in a few words.</p><p>A line of every story</p>" + call + "<ul class='seen'><li><a href=x>Story one {0}</a><li><a href=y>Story two</a></ul></article></body>"
    bare = "<body><div>Top of all pages</div><p>Text {0} of its own</p><div class='x'><a href=z>Link</a> {0}</div></body>"
    rows = [(i, "http://m.org/", marked.format(i)) for i in range(12)] + [(20 + i, "http://n.org/", bare.format(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert got[3] == "Title 3\nStory 3 in a few words.\nA line of every story" and got[23] == "Text 3 of its own"
    read = htmltext.Reader()
    alone = htmltext.main_text(read, marked.format(3))
    assert alone.startswith(got[3]) and "Read on" in alone and "Story two" in alone
    assert htmltext.main_text(read, bare.format(3)) == "Top of all pages\nText 3 of its own"


def test_names_of_several_words_lose_no_text():
    read = htmltext.Reader()
    page = "<body><nav>Menu</nav><article><h1>News</h1><section class='share-prices'><p>prices rose</p></section><section id='related-work'><p>others did</p></section><div class='comments'>Nice!</div></article></body>"
    assert htmltext.main_text(read, page) == "News\nprices rose\nothers did"
    page = "<body><h1>Title</h1><div class='search-results-discussion'><p>The whole text of the article stands here.</p></div><div class='comment-list'>Short</div><div class='comments'>A reader's longer remark, which is no part of it</div></body>"
    assert htmltext.main_text(read, page).startswith("Title\nThe whole text")
    assert "remark" not in htmltext.main_text(read, page)
    deep = "<div>" * 2000 + "<aside>" + "<div>" * 1000 + "Menu" + "</div>" * 1000 + "</aside>" + "<p>Text</p>" + "</div>" * 2000
    assert htmltext.main_text(read, f"<body><article>{deep}</article></body>") == "Text"
    assert htmltext.main_text(read, "<b>" * 50_000 + "x" + "<p>y") == "x\ny"


def test_pages_with_clashing_columns_and_long_texts(spark):
    long = "<body><article>" + "<p>word &amp; more</p>" * 60_000 + "</article></body>"
    df = spark.createDataFrame([(1, "http://a.org/", long, "x", 2, "y", [1]), (None, None, None, None, None, None, None)], "page_id long, url string, html string, id string, host int, text string, slots array<int>")
    got = {r["id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert got == {1: "\n".join(["word & more"] * 60_000), None: ""}


def test_odd_pages_do_not_decide_for_a_host(spark):
    page = "<body><h1>Title {0}</h1><div id=content>Block {0}</div>{1}</body>"
    rows = [(i, "http://a.org/", page.format(i, "" if i == 5 else "<p>Sign up here</p>")) for i in range(12)]
    rows += [(20, "http://a.org/", "<body><main><p>Marked</p></main></body>"), (21, "http://a.org/", None), (22, "http://a.org/", "")]
    got = {r["id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nBlock {i}" for i in range(12)} | {20: "Marked", 21: "", 22: ""}


def test_names_do_not_override_an_inner_article():
    read = htmltext.Reader()
    for name in ("content with-sidebar", "has-comments", "header-fixed", "search-results"):
        page = f"<body><nav>Home</nav><div class='{name}'><article><h1>Title</h1><p>A text of some words.</p><div class='comments'>Nice</div></article><div class='widget'>Side</div></div></body>"
        assert htmltext.main_text(read, page) == "Title\nA text of some words."
    cards = "<div class='related-posts'><article>Another story</article></div>"
    assert htmltext.main_text(read, f"<body><p>The story itself, at some length.</p>{cards}</body>") == "The story itself, at some length."
    assert htmltext.main_text(read, f"<body><article>Story</article>{cards}</body>") == "Story"


def test_local_search_ends_when_no_exchange_helps():
    import random

    rng = random.Random(1)
    bins = Counter(tuple(sorted((rng.randint(400, 1000), rng.randint(400, 1000)), reverse=True)) for _ in range(300))
    out = packing.local_search(dict(bins), 2048)
    assert sum(sum(k) * n for k, n in out.items()) == sum(sum(k) * n for k, n in bins.items()) and all(sum(k) <= 2048 for k in out)
    assert sum(out.values()) <= 215  # 271 after 20,000 pairs
    under = [c for c in out if sum(c) < 2048]
    assert all(packing._exchange(g, t, 2048 - sum(t)) is None for g in under for t in under if sum(t) >= sum(g) and (t != g or out[g] > 1))
