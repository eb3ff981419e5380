"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram binds its letters' vectors, permuted (rolled)
by position, by multiplication; a text bundles its trigrams by addition, and a language bundles
its texts. The prediction is the language whose prototype has the largest cosine with the text.
Texts are lower-cased; runs of other characters count as one blank. Letters below U+0250 have
vectors of their own, the others share 430 by their number.

Prototypes are summed over all learning rows: each task sends one vector a language, and the sums
come to the driver, one vector a language. Null texts, and texts without a letter, are ``und``
with score 0. Ties go to the language first in order. Without learning rows all are ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

DIM = 1024
OWN = 0x250
CODES = 1024


def letter_codes() -> np.ndarray:
    """The code, 0 (blank) to 1023, of every code point."""
    code = np.zeros(0x110000, np.int16)
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    at = np.arange(0x110000)
    return np.where(alpha, np.where(at < OWN, at, OWN + 1 + at % (CODES - OWN - 1)), code).astype(np.int32)


class Space:
    """Vectors of trigrams, made as they are met; the memory is emptied when it holds ``most``."""

    def __init__(self, dim: int = DIM, seed: int = 7, most: int = 60_000):
        self.letters = np.random.default_rng(seed).integers(0, 2, (CODES, dim), dtype=np.int8) * 2 - 1
        self.codes = letter_codes()
        self.dim, self.most = dim, most
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dim), np.int8)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of a text and their counts; None without a letter."""
        code = self.codes[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = np.concatenate([[0], code, [0]]).astype(np.int32)
        code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
        if len(code) < 3:
            return None
        key = np.sort(code[:-2] << 20 | code[1:-1] << 10 | code[2:])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.diff(np.r_[first, len(key)])

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors."""
        out = np.zeros(self.dim)
        for k in range(0, len(keys), 4096):
            out += counts[k : k + 4096].astype(np.float32) @ self.of(keys[k : k + 4096]).astype(np.float32)
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        got = [self.row.get(k, -1) for k in keys.tolist()]
        if -1 in got:
            if len(self.row) + len(keys) > self.most:
                self.forget()
                got = [-1] * len(keys)
            new = keys[np.array(got) < 0]
            first, letters = len(self.row), self.letters
            made = np.roll(letters[new >> 20], 2, axis=1) * np.roll(letters[new >> 10 & 1023], 1, axis=1) * letters[new & 1023]
            while first + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[first : first + len(new)] = made
            self.row.update(zip(new.tolist(), range(first, first + len(new))))
            got = [self.row[k] for k in keys.tolist()]
        return self.vectors[got]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundled vectors, learned from all rows with a language."""
    picked = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        space, sums = Space(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in text_slices(batch, 1):
                held: dict[str, list] = {}
                for k, text in enumerate(texts):
                    if (got := space.trigrams(text)) is not None:
                        held.setdefault(langs[at + k], []).append(got)
                for lang, parts in held.items():
                    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([p[1] for p in parts]))
                    sums[lang] = sums.get(lang, 0) + space.bundle(keys, counts)
        for lang, total in sums.items():
            yield pa.record_batch([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(total).astype(np.int64))], names=["lang", "at", "v"])

    rows = picked.mapInArrow(run, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()  # DIM rows a language
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), DIM))
    for r in rows:
        out[langs.index(r["lang"]), r["at"]] = r["v"]
    return langs, out


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the score is the cosine, 0 where it is negative."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    norms = np.linalg.norm(profiles, axis=1)
    unit = profiles / np.where(norms, norms, 1)[:, None]

    def run(batches):
        space = Space()
        for batch in batches:
            names, scores = [], []
            for _, texts in text_slices(batch, 1):
                for text in texts:
                    got = space.trigrams(text) if langs else None
                    if got is None:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    v = space.bundle(*got)
                    cos = unit @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(np.argmax(cos))
                    names.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, lang_pred string, score double")
