"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are gathered in one pass and written once; trees are fitted on the
driver on at most ``max_labelled`` labelled rows (the ones of least hash, a documented bound) and
flattened into numpy node arrays, which score all rows batch by batch. Some features are held
monotonic: more symbols, repeated words or repeated lines never raise a score.

Null text counts as empty: no words, base_failed, not kept. Repeated rows get equal results each.
Without labels of both kinds no trees are fitted, and only the base rules decide. A label that
is missing or null is not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise, measured, text_slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "bang_rate", "mark_rate", "line_words")
#: +1: a larger value never lowers the score, -1: never raises it, 0: free.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "bang_rate": -1}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(of[0x80:0xC0].sum()) - sum(int(of[c]) for c in SPACES)
    symbols = sum(int(of[c]) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeat = 0
    if n > 3:
        m = len(seen)
        pair = ids[:-1] * m + ids[1:]
        if m >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * m + ids[2:]
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            at = np.flatnonzero(np.isin(key, again))
            hit = np.zeros(n, bool)
            hit[at] = hit[at + 1] = hit[at + 2] = True
            repeat = int(hit.sum())
    marks = sum(int(of[c]) for c in b".,;:")
    upper, digits = int(of[65:91].sum()), int(of[48:58].sum())
    return [n, chars, symbols, dup, repeat], [float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n, len(seen) / n, upper / chars, digits / chars, int(of[33]) / n, marks / n, float(np.log1p(n / len(lines)))]


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, COUNTS, f array<double>) of every row."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            counts, feats = [], []
            for _, texts in text_slices(batch, 1):
                for c, f in map(statistics, texts):
                    counts.append(c)
                    feats.append(f)
            cols = np.array(counts, np.int64).reshape(-1, 5)
            yield pa.record_batch([batch.column(0), *(pa.array(cols[:, k]) for k in range(5)), pa.array(feats, pa.list_(pa.float64()))], names=["id", *COUNTS, "f"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, f array<double>")


class Trees:
    """Boosted regression trees on the logistic loss, flattened: node k tests feature[k] <= threshold[k]; leaves point to themselves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 2.0, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.smooth, self.least = rounds, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Trees:
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.child: list[list[int]] = []
        self.value: list[float] = []
        self.roots: list[int] = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            step = np.zeros(len(y))
            self.roots.append(self._grow(binned, cuts, g, h, np.arange(len(y)), self.depth, -np.inf, np.inf, monotone, step))
            score += step
        self.flat = tuple(np.array(a) for a in (self.feature, self.threshold, self.child, self.value, self.roots))
        return self

    def _leaf(self, g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + self.smooth), low, high))

    def _grow(self, binned, cuts, g, h, rows, depth, low, high, monotone, step) -> int:
        me = len(self.feature)
        self.feature.append(0)
        self.threshold.append(0.0)
        self.child.append([me, me])
        whole = self._leaf(g[rows].sum(), h[rows].sum(), low, high)
        self.value.append(self.rate * whole)
        best = None
        if depth and len(rows) >= 2 * self.least:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(cut) + 1))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, len(rows) - nl
                vl, vr = np.clip(gl / (hl + self.smooth), low, high), np.clip(gr / (hr + self.smooth), low, high)
                gain = gl * vl - (hl + self.smooth) * vl**2 / 2 + gr * vr - (hr + self.smooth) * vr**2 / 2
                ok = (nl >= self.least) & (nr >= self.least) & (monotone[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
            now = g[rows].sum() * whole - (h[rows].sum() + self.smooth) * whole**2 / 2
            if best and best[0] <= now + 1e-6:
                best = None
        if not best:
            step[rows] = self.rate * whole
            return me
        _, j, k, vl, vr = best
        left = rows[binned[rows, j] <= k]
        right = rows[binned[rows, j] > k]
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
        self.feature[me], self.threshold[me] = j, float(cuts[j][k])
        self.child[me] = [self._grow(binned, cuts, g, h, part, depth - 1, *b, monotone, step) for part, b in zip((left, right), bounds)]
        return me


def tree_scores(x: np.ndarray, base: float, depth: int, flat: tuple) -> np.ndarray:
    """Probabilities of rows of features, all trees at once."""
    feature, threshold, child, value, roots = flat
    node = np.broadcast_to(roots, (len(x), len(roots))).copy()
    rows = np.arange(len(x))[:, None]
    for _ in range(depth):
        node = child[node, (x[rows, feature[node]] > threshold[node]).astype(np.int64)]
    return 1 / (1 + np.exp(-(base + value[node].sum(axis=1))))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, keep_good: float = 0.995, labelled: str = "id") -> DataFrame:
    """(id, COUNTS, base_failed, score, kept) for every row.

    ``keep_good``: the share of good labelled rows that the threshold keeps at least; it is never above a score of 0.5.
    ``labelled``: the part of the id that labels name, where ``id_col`` is a struct.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    sample = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and lid is not null")
    sample = sample.groupBy("lid").agg(F.max("y").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    fit = stats.join(F.broadcast(sample), F.col(labelled) == F.col("lid")).select("lid", "f", "y").dropDuplicates(["lid"]).orderBy("lid").limit(max_labelled).toPandas()
    model, threshold = None, 0.0
    if len(fit) and fit.y.nunique() == 2:
        x, y = np.stack(fit.f.to_numpy()), fit.y.to_numpy(float)
        trees = Trees().fit(x, y, [MONOTONE.get(f, 0) for f in FEATURES])
        model = (trees.base, trees.depth, trees.flat)
        threshold = min(0.5, float(np.quantile(tree_scores(x, *model)[y == 1], 1 - keep_good)))

    def run(batches):
        for batch in batches:
            n = np.asarray(batch.column(1), np.int64)
            repeat = np.asarray(batch.column(5), np.int64)
            x = np.asarray(batch.column(6).flatten(), float).reshape(-1, len(FEATURES))
            failed = (n < 50) | (100 * repeat > 50 * n)
            score = np.concatenate([tree_scores(x[k : k + 2048], *model) for k in range(0, len(x), 2048)] or [np.zeros(0)]) if model else np.ones(len(x))
            yield pa.record_batch([*batch.columns[:6], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=["id", *COUNTS, "base_failed", "score", "kept"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the rules reject; each row is judged by its own text, also where ids repeat."""
    rows, key = keyed(docs, id_col, "keyed")
    row = F.struct(F.col(id_col).alias(id_col), F.col(key).alias("key"))
    scores = quality_scores(rows.select(row.alias("row"), F.col(text_col).alias("text")), labels.withColumnRenamed(id_col, "row"), "row", "text", labelled=f"id.`{id_col}`", **options)
    kept = measured(materialise(scores.where("kept").select(F.col("id.key").alias("__kept")), "kept"))
    return rows.join(kept, F.col(key).eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)
