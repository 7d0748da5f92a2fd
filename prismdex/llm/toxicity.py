"""Toxicity by weak supervision.

Voters: lexicons of words, lexicons of word beginnings and writing patterns, each for or silent; the lexicons are
mined from labelled rows outside the held-out fold. A generative label model takes the votes as noisy signs of one hidden label. It reads how often each set of votes occurs among all documents
outside the held-out fold, labelled or not; the labelled rows say which of its classes is the toxic one and where it
starts. Expectation-maximisation estimates each voter's accuracy, and the correlation of each pair of voters
given the label; a voter that repeats others counts for less. The posterior labels then train a linear classifier over
the voters and lexicon entries, with which every whole text is scored in Arrow batches.

The classifier sees at most `train_rows` labelled rows. The sets of votes come to the driver as one count each, at most two to the number
of voters (`2 * lexicons` and the patterns). Null and empty texts have no votes and score as such.
Without labelled rows, or with one class only, every score is 0. A null id is in no fold and its row is not learnt from. Repeated
rows are scored one by one; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import encode, fold, labelled_sample, plain_words, sigmoid

PATTERNS = (
    re.compile(rb"(?i)\byou(?:'re| are)\b"),
    re.compile(rb"[!?]{3,}"),
    re.compile(rb"[A-Za-z]\*+[A-Za-z]"),
    re.compile(rb"\b[A-Z]{4,}(?: [A-Z]{4,}){2,}"),
    re.compile(rb"(?i)\b(?:shut up|hate|kill)\b"),
)


@dataclass(frozen=True)
class Settings:
    train_rows: int = 6000
    beginnings: tuple[int, ...] = (5, 7)
    min_support: int = 4
    min_precision: float = 0.75
    lexicons: int = 6
    em_rounds: int = 25
    steps: int = 400
    rate: float = 0.5
    l2: float = 1e-3


def marks(text: str | None, beginnings: tuple[int, ...]) -> set[str]:
    """The text's words and word beginnings; a beginning carries its length in front."""
    out: set[str] = set()
    for word in {w.decode("utf-8", "replace") for w in set(plain_words(text))}:
        out.add(word)
        for k in beginnings:
            if len(word) >= k:
                out.add(f"{k}:{word[:k]}")
    return out


class Model:
    """Lexicon entries with their voter and weight, the voters' weights, and the bias."""

    def __init__(self, settings: Settings) -> None:
        self.s, self.entries, self.voter_of = settings, {}, np.empty(0, int)
        self.n_voters, self.weights, self.bias = len(PATTERNS), None, 0.0

    def mine(self, rows: list[tuple[set[str], int]]) -> None:
        toxic, clean = Counter(), Counter()
        for found, label in rows:
            (toxic if label else clean).update(found)
        sure = {}
        for m, n in toxic.items():
            precision = (n + 0.5) / (n + clean[m] + 1.5)
            if n >= self.s.min_support and precision >= self.s.min_precision:
                sure[m] = n
        ranked = sorted(sure, key=lambda m: (-sure[m], m))
        words, starts = [m for m in ranked if ":" not in m], [m for m in ranked if ":" in m]
        self.entries = {m: i for i, m in enumerate(words + starts)}
        # Frequent entries are dealt out in turn, so that each lexicon has common and rare ones.
        k = self.s.lexicons
        self.voter_of = np.array([i % k for i in range(len(words))] + [k + i % k for i in range(len(starts))], int)
        self.n_voters = 2 * k + len(PATTERNS)

    def features(self, found: set[str], text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Votes (0 or 1) of the voters, and the indicators the classifier reads."""
        at = np.array(sorted(self.entries[m] for m in found if m in self.entries), int)
        votes = np.zeros(self.n_voters)
        votes[self.voter_of[at]] = 1
        raw = encode(text)
        votes[-len(PATTERNS):] = [bool(p.search(raw)) for p in PATTERNS]
        x = np.zeros(self.n_voters + len(self.entries))
        x[:self.n_voters] = votes
        x[self.n_voters + at] = 1
        return votes, x

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        _, x = self.features(marks(text, self.s.beginnings), text)
        return float(sigmoid(x @ self.weights + self.bias))


def label_model(votes: np.ndarray, times: np.ndarray, known: np.ndarray, labels: np.ndarray,
                rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label for the `known` votes, rates (2, voters) of a vote given each class, correlations.

    `votes` are the sets of votes of all documents and `times` how often each occurs. The labels of the known rows give the
    rates to start from, and stay beside the other rows in each round, so that the classes keep their meaning.
    """
    rows = np.concatenate([votes, known])
    weight = np.r_[times, np.ones(len(known))].astype(float)
    n, m = weight.sum(), rows.shape[1]
    sure = np.stack([1 - labels, labels])

    def rates_of(both: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (both @ of + 0.1) / (both.sum(1, keepdims=True) + 1.0)

    def posterior(of: np.ndarray) -> np.ndarray:
        seen = np.log(rates[1] / rates[0]) * share
        silent = np.log((1 - rates[1]) / (1 - rates[0])) * share
        return sigmoid(np.log(prior / (1 - prior)) + of @ seen + (1 - of) @ silent)

    rates, share, correlation = rates_of(sure, known), np.ones(m), np.zeros((m, m))
    prior = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    for _ in range(rounds):
        post = np.r_[posterior(votes), labels]
        both = np.stack([1 - post, post]) * weight
        rates = rates_of(both, rows)
        prior = np.clip(both[1].sum() / n, 1e-3, 1 - 1e-3)
        correlation = np.zeros((m, m))
        for c in (0, 1):
            centred = (rows - rates[c]) * np.sqrt(both[c])[:, None]
            cov = centred.T @ centred / both[c].sum()
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation += cov / np.outer(scale, scale) * (both[c].sum() / n)
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + np.clip(correlation, 0, 1).sum(1))
    return posterior(known), rates, correlation


def vote_counts(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sets of votes among the documents outside the held-out fold, and how many documents have each."""

    def cast(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bit = 1 << np.arange(model.n_voters)
        for texts in batches:
            yield pd.Series([int(model.features(marks(t, model.s.beginnings), t)[0] @ bit) for t in texts], dtype="int64")

    seen = docs.where(fold("doc_id", 4) != 2).select(F.pandas_udf(cast, "long")("text").alias("votes"))
    counts = seen.groupBy("votes").count().orderBy("votes").collect()
    sets = np.array([r["votes"] for r in counts], np.int64)
    return (sets[:, None] >> np.arange(model.n_voters) & 1).astype(float), np.array([r["count"] for r in counts], float)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    sample = labelled_sample(docs, labels, "toxic", 4, 2, settings.train_rows)
    beginnings = settings.beginnings

    def distinct_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [encode(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "label": b["label"],
                "marks": [sorted(marks(t, beginnings)) for t in b["text"]],
                "pats": [sum(bool(p.search(r)) << i for i, p in enumerate(PATTERNS)) for r in raw],
            })

    # Entries are chosen by Spark from the sample's counts; the driver sees the entries and the votes alone.
    rows = sample.mapInPandas(distinct_marks, "doc_id long, label int, marks array<string>, pats int")
    counted = (
        rows.select("label", F.explode("marks").alias("mark")).groupBy("mark")
        .agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
        .where((F.col("toxic") >= settings.min_support)
               & ((F.col("toxic") + 0.5) / (F.col("n") + 1.5) >= settings.min_precision))
    )
    sure = [r["mark"] for r in counted.select("mark").collect()]
    model = Model(settings)
    kept = F.array_intersect("marks", F.array(*map(F.lit, sure))) if sure else F.array().cast("array<string>")
    seen = sorted(((r["doc_id"], r["label"], r["pats"], set(r["kept"])) for r in
                   rows.select("doc_id", "label", "pats", kept.alias("kept")).collect()), key=lambda r: (r[0], sorted(r[3])))
    label = np.array([r[1] for r in seen], float)
    if len(seen) == 0 or label.min() == label.max():
        return model
    model.mine([(r[3], r[1]) for r in seen])
    both = [model.features(r[3], None) for r in seen]
    votes, x = np.array([v for v, _ in both]), np.array([f for _, f in both])
    pattern_votes = np.array([[r[2] >> i & 1 for i in range(len(PATTERNS))] for r in seen], float)
    first = model.n_voters - len(PATTERNS)
    votes[:, first:] = x[:, first:model.n_voters] = pattern_votes
    posterior, _, _ = label_model(*vote_counts(docs, model), votes, label, settings.em_rounds)
    w, b = np.zeros(x.shape[1]), 0.0
    gw, gb = np.full(x.shape[1], 1e-6), 1e-6
    for _ in range(settings.steps):
        miss = sigmoid(x @ w + b) - posterior
        dw, db = x.T @ miss / len(x) + settings.l2 * w / len(x), miss.mean()
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w - settings.rate * dw / np.sqrt(gw), b - settings.rate * db / np.sqrt(gb)
    model.weights, model.bias = w, float(b)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """All rows of `docs` with score and predicted beside their own columns."""
    model = fit(docs, labels, settings)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", F.pandas_udf(score, "double")("text")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs.select("doc_id", "text"), labels).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
