"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Word 1- and 2-grams, and 1- to 3-grams of word shapes (case, digits and punctuation of a word, letters
folded to one sign), are hashed into `1 << bits` slots. A document is the unit vector of log(1 + count).
The weights are learnt with FTRL-proximal updates from a bounded sample of labelled rows; documents are
scored in Arrow batches as sparse dot products with the weights, whose size is fixed by `bits`.

Null and empty texts have no n-gram: their score is that of the bias. Without labelled rows every score
is 0.5. Repeated rows are scored one by one, a repeated id is learnt from once; a row without an id is scored, never
learnt from and not held out. Columns besides doc_id and text are not looked at; in the library form columns named score or
predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import encode, fold, kept_in_worker, labelled_sample, sigmoid

#: Letters of a word's shape: capitals X, other letters x, digits 0, all else as it is.
_SHAPE = bytes(
    88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    train_rows: int = 6000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


class Hasher:
    """Slots and values of a text; hashes of words already seen are kept, up to a bound.

    The two hashes of a word are kept as 16 bytes, about 150 bytes a word in all, and one join puts those of a text together.
    """

    def __init__(self, bits: int, keep: int = 500_000) -> None:
        self.mask, self.keep = np.uint64((1 << bits) - 1), keep
        self.seen: dict[bytes, bytes] = {}

    def _codes(self, word: bytes) -> bytes:
        shape = word.translate(_SHAPE)
        while b"xx" in shape or b"XX" in shape:
            shape = shape.replace(b"xx", b"x").replace(b"XX", b"X")
        if len(self.seen) >= self.keep:
            self.seen.clear()
        codes = self.seen[word] = xxhash.xxh64_digest(word) + xxhash.xxh64_digest(shape, 7)
        return codes

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = encode(text).split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        seen, codes = self.seen, self._codes
        both = np.frombuffer(b"".join([seen.get(w) or codes(w) for w in words]), ">u8").astype(np.uint64)
        word, shape = both[::2], both[1::2]
        p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        grams = [word, shape, word[:-1] * p + word[1:], shape[:-1] * p + shape[1:],
                 (shape[:-2] * p + shape[1:-1]) * q + shape[2:]]
        mixed = np.concatenate(grams) * p
        slots, counts = np.unique((mixed ^ (mixed >> np.uint64(32))) & self.mask, return_counts=True)
        values = np.log1p(counts)
        return slots.astype(np.int64), values / np.sqrt((values * values).sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, rows in the given order, `epochs` times."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= s.l1, 0.0, -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for slots, values, label in rows:
            at, x = np.append(slots, 1 << s.bits), np.append(values, 1.0)
            w = weights(at)
            g = (sigmoid(w @ x) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Learns from at most `train_rows` labelled rows; only their sparse vectors come to the driver."""
    bits = settings.bits

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = kept_in_worker(Hasher, bits)
        for batch in batches:
            made = [hasher(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "slots": [a.astype("<u4").tobytes() for a, _ in made],
                "vals": [b.astype("<f4").tobytes() for _, b in made],
            })

    sample = labelled_sample(docs, labels, "quality", 5, 0, settings.train_rows)
    rows = sample.mapInPandas(vectors, "doc_id long, label int, slots binary, vals binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["slots"]))
    return train(
        [(np.frombuffer(r["slots"], "<u4").astype(np.int64), np.frombuffer(r["vals"], "<f4").astype(float), r["label"]) for r in rows],
        settings,
    )


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """All rows of `docs` with score and predicted beside their own columns."""
    weights, bias = fit(docs, labels, settings)
    bits = settings.bits

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = kept_in_worker(Hasher, bits)
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                slots, values = hasher(text)
                out[i] = sigmoid(weights[slots] @ values + bias)
            yield pd.Series(out)

    scored = F.pandas_udf(score, "double")
    return docs.withColumn("score", scored("text")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs.select("doc_id", "text"), labels).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
