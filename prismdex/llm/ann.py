"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by three rounds of random signs and the fast Hadamard transform, and
takes the signed axis it then lies nearest to. A query probes, in each of `tables` tables, the axes nearest to it:
`probes` of every 128, and `probes` at least. Rows of these axes are its candidates; they alone are multiplied with
it, bucket by bucket, and ranked by their exact inner product. Where lengths
differ, one more coordinate completes every row to the greatest length, so that the angle orders rows as the
inner product does.

Rows are hashed where they lie and never moved: queries go out in blocks of about `block` vectors, every task
keeps the best `k` of its rows for each query, and one ranking joins the tasks' answers. A hot vector or axis
therefore fills no bucket on one machine, and within a task a bucket is multiplied in pieces.

Vectors that are null, zero, or hold null or non-finite components take no part. A query is compared with the rows of
its own dimension; vectors of any dimension are searched. Of several query vectors of one id the smallest
counts, of several rows of one id the best score; ties go to the smaller vec_id, columns besides vec_id and
embedding are not looked at. Empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.llm.common import settle


@dataclass(frozen=True)
class Settings:
    tables: int = 16
    probes: int = 12
    seed: int = 17
    block: int = 4096
    rows: int = 8192
    pairs: int = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row, lengths kept."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Shape:
    """The vectors of one dimension: the greatest length, and whether all are about that long."""

    dim: int
    longest: float
    even: bool


class Hash:
    def __init__(self, shape: Shape, s: Settings) -> None:
        self.shape = shape
        self.width = 1 << max(0, (shape.dim if shape.even else shape.dim + 1) - 1).bit_length()
        self.axes = 2 * self.width
        self.probes = min(self.axes, max(s.probes, -(-s.probes * self.axes // 128)))
        self.signs = np.random.default_rng(s.seed).choice([-1.0, 1.0], (s.tables, 3, self.width))

    def turned(self, x: np.ndarray, is_query: bool) -> Iterator[np.ndarray]:
        """Per table, the turned vectors."""
        dim, wide = self.shape.dim, np.zeros((len(x), self.width))
        if self.shape.even or is_query:
            wide[:, :dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            wide[:, :dim] = x / self.shape.longest
            wide[:, dim] = np.sqrt(np.maximum(0, 1 - (wide[:, :dim] ** 2).sum(1)))
        for signs in self.signs:
            y = wide
            for row in signs:
                y = hadamard(y * row)
            yield y

    def members(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per table, the rows by their nearest signed axis: 2 * axis, plus one where it is negative."""
        for y in self.turned(x, False):
            at = np.abs(y).argmax(1)
            yield _by_axis(2 * at + (y[np.arange(len(y)), at] < 0), np.arange(len(y)), self.axes)

    def asking(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per table, the queries by the signed axes that they probe."""
        out = []
        for y in self.turned(x, True):
            near = np.stack([y, -y], 2).reshape(len(y), -1)
            probed = np.argpartition(-near, self.probes - 1, axis=1)[:, :self.probes]
            out.append(_by_axis(probed.ravel(), np.repeat(np.arange(len(y)), self.probes), self.axes))
        return out


def _by_axis(axis: np.ndarray, member: np.ndarray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """(members in order of their axis, where each axis begins; one more for the end)."""
    order = np.argsort(axis, kind="stable")
    return member[order].astype(np.int32), np.searchsorted(axis[order], np.arange(axes + 1))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


class Best:
    """The k best rows that a task has met for each query of one dimension."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, shape: Shape, k: int, s: Settings) -> None:
        self.ids, self.queries, self.k, self.s = ids, queries, k, s
        self.hash = Hash(shape, s)
        self.asking = self.hash.asking(queries)
        # Sums in another order differ by less; what lies that close below the k-th best is summed exactly.
        self.slack = 1e-9 * np.linalg.norm(queries, axis=1) * shape.longest
        self.floor = np.full(len(queries), -np.inf)
        self.q, self.v, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def candidates(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of the pairs that share a bucket and may be among the k best; pairs recur."""
        for (queries, q_at), (members, r_at) in zip(self.asking, self.hash.members(rows)):
            for axis in np.flatnonzero((np.diff(q_at) > 0) & (np.diff(r_at) > 0)):
                asked, bucket = queries[q_at[axis]:q_at[axis + 1]], members[r_at[axis]:r_at[axis + 1]]
                vectors, least = self.queries[asked], (self.floor - self.slack)[asked]
                step = max(1, self.s.pairs // len(asked))
                for lo in range(0, len(bucket), step):
                    part = bucket[lo:lo + step]
                    i, j = np.nonzero(vectors @ rows[part].T >= least[:, None])
                    yield asked[i], part[j]

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        found, size = [], 0
        for pair in self.candidates(rows):
            found.append(pair)
            size += len(pair[0])
            if size > self.s.pairs:
                self.keep(found, ids, rows)
                found, size = [], 0
        self.keep(found, ids, rows)

    def keep(self, found: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, rows: np.ndarray) -> None:
        if not found:
            return
        pairs = np.unique(np.concatenate([q.astype(np.int64) * len(rows) + r for q, r in found]))
        q, r = pairs // len(rows), pairs % len(rows)
        other = self.ids[q] != ids[r]
        q, r = q[other], r[other]
        step = max(1, (8 << 20) // rows.shape[1])
        exact = [(self.queries[q[a:a + step]] * rows[r[a:a + step]]).sum(1) for a in range(0, len(q), step)]
        q, v, score = np.r_[self.q, q], np.r_[self.v, ids[r]], np.concatenate([self.score, *exact])
        order = np.lexsort((-score, v, q))
        q, v, score = q[order], v[order], score[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])][:len(q)]
        q, v, score = q[first], v[first], score[first]
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][:len(q)])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.floor[q[place == self.k - 1]] = score[place == self.k - 1]
        kept = place < self.k
        self.q, self.v, self.score = q[kept], v[kept], score[kept]

    def answers(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.q], "vec_id": self.v, "score": self.score})


def best_rows(asked: dict[int, tuple[np.ndarray, np.ndarray, Shape]], batches: Iterator[pd.DataFrame], k: int,
              s: Settings) -> Iterator[pd.DataFrame]:
    """The k best candidates of each query among the rows of the batches, by dimension.

    The first rows are taken in small lots: they set the bounds that later candidates must reach.
    """
    best: dict[int, Best] = {}
    lots: dict[int, int] = {}
    for batch in batches:
        for dim, rows in batch.groupby(batch["embedding"].map(len)):
            if dim not in asked:
                continue
            if dim not in best:
                best[dim], lots[dim] = Best(*asked[dim], k, s), 256
            lo = 0
            while lo < len(rows):
                lot = rows.iloc[lo:lo + lots[dim]]
                best[dim].meet(lot["vec_id"].to_numpy(np.int64), _matrix(lot["embedding"]))
                lo, lots[dim] = lo + lots[dim], min(s.rows, 2 * lots[dim])
    for found in best.values():
        yield found.answers()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part, before the dimension is looked at."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id is not null and embedding is not null")
        .where(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of `queries`."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    rows = usable(vectors)
    spark = rows.sparkSession
    # One row per dimension.
    measured = rows.groupBy(F.size("embedding").alias("dim")).agg(F.min(length).alias("least"), F.max(length).alias("most")).collect()
    shapes = {r["dim"]: Shape(r["dim"], r["most"], r["most"] - r["least"] <= 1e-3 * r["most"]) for r in measured}
    asked = settle(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = -(-asked.count() // settings.block)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for b in range(blocks):
        lot = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        by_dim = {dim: (part["vec_id"].to_numpy(np.int64), _matrix(part["embedding"]), shapes[dim])
                  for dim, part in lot.groupby(lot["embedding"].map(len)) if dim in shapes}
        sent = spark.sparkContext.broadcast(by_dim)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            yield from best_rows(sent.value, batches, k, settings)

        found = found.unionByName(rows.mapInPandas(search, "query_id long, vec_id long, score double"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op9_nearest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where("vec_id % 20 = 0"))
