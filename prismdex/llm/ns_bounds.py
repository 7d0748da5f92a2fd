"""Centroid clustering with ns-bounds: exact rounds that measure few distances.

Every vector keeps the distance to each centroid as it was last measured, and the round of that measurement. The
centroids of all rounds are kept (rounds x centroids numbers, sent to every task). In a later round a stored distance, less
the norm of that centroid's total displacement since its measurement, is a lower bound; the one to the own centroid,
plus its displacement, an upper bound. The norm of the sum of the moves is never more than the sum of their norms, so the
bounds are tighter than those that lose each round's drift. A centroid whose lower bound lies above the upper bound
can't be nearest. The others are measured exactly, in integers, and the measurement replaces the stored one.

Vectors are integers, floor(scale * x), and so are centroids (componentwise floor of the mean), so rounds are the same on any
partitioning. Bounds are compared with a margin far above the rounding of double precision; ties go to
the smaller number by the exact distances, since a bound that ties is measured.

A round is one pass: every task reads its vectors with their bounds, writes them anew, and the sums of the clusters
are one aggregate of as many rows as there are centroids. Vectors never move. A round's table is written in the shared folder,
so an executor's loss costs its tasks of one round; the table before the last is deleted.

Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated ids are vectors of
their own; of equal hashes the smaller vector starts first, and a null id starts no cluster. With fewer usable ids than
clusters there are fewer clusters; without any, no row. Components beyond 2**27 in magnitude after scaling are worked out in
Python integers, up to 10**30 (beyond it Spark's decimals overflow, an error); distances and inertias that no long can hold
are null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import discard
from prismdex.sources.store import open_table, workspace, write_table

#: The greatest component whose squared differences, added up over any usual width, fit a long.
NARROW = 2 ** 27
#: Share of the compared numbers by which a bound must clear the other.
MARGIN = 1e-9


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    seed: str = "3"


def usable(vectors: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, x): vectors of the right length with finite components alone, as doubles."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where((F.size("x") == s.dim) & finite)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) also where the product leaves the doubles."""
    return int(x) * scale if abs(x) >= 2 ** 53 else math.floor(scale * x)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to centroids, all pairs of the leading axes."""
    diff = v - c
    return (diff * diff).sum(-1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype("float64"))


class Bounds:
    """One round over rows with stored distances: what is measured, and the nearest centroid."""

    def __init__(self, history: list[np.ndarray]) -> None:
        self.now = len(history) - 1
        self.centroids = history[-1]
        moved = [roots(squared(self.centroids, then)) for then in history]
        self.moved = np.array(moved)  # (round of measurement, centroid): norm of the displacement since

    def assign(self, v: np.ndarray, cluster: np.ndarray, far: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, stored distances, their rounds, and the number of distances measured, of each row after this round."""
        k, rows = len(self.centroids), np.arange(len(v))
        cluster, far, at, measured = cluster.copy(), far.copy(), at.copy(), np.zeros(len(v), "int64")
        drift = self.moved[at, np.arange(k)]
        own, own_drift = far[rows, cluster], drift[rows, cluster]
        open_ = self._open(far, drift, own, own_drift, cluster)
        some = np.flatnonzero(open_.any(1))
        if not len(some):
            return cluster, far, at, measured
        mine = squared(v[some], self.centroids[cluster[some]])  # with it many of the others are told apart
        measured[some] += 1
        far[some, cluster[some]], at[some, cluster[some]] = roots(mine), self.now
        still = self._open(far[some], drift[some], roots(mine), 0.0, cluster[some])
        best, where = mine.copy(), cluster[some].copy()
        for j in range(k):
            hit = np.flatnonzero(still[:, j])
            if not len(hit):
                continue
            row = some[hit]
            exact = squared(v[row], self.centroids[j])
            measured[row] += 1
            far[row, j], at[row, j] = roots(exact), self.now
            nearer = (exact < best[hit]) | ((exact == best[hit]) & (j < where[hit]))
            best[hit], where[hit] = np.where(nearer, exact, best[hit]), np.where(nearer, j, where[hit])
        cluster[some] = where
        return cluster, far, at, measured

    def _open(self, far, drift, own, own_drift, cluster) -> np.ndarray:
        """Which centroids the bounds cannot rule out, the own one aside."""
        own, own_drift = np.broadcast_to(own, len(far))[:, None], np.broadcast_to(own_drift, len(far))[:, None]
        upper = own + own_drift
        maybe = far - drift <= upper + MARGIN * (far + drift + upper + 1)
        maybe[np.arange(len(far)), cluster] = False
        return maybe

    def first(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of rows that have no bounds: every distance is measured."""
        exact = np.stack([squared(v, c) for c in self.centroids], 1)
        return exact.argmin(1), roots(exact), np.full(exact.shape, self.now), np.full(len(v), exact.shape[1])


class Job:
    """The rounds over one table; wide tables hold their integers as decimals."""

    def __init__(self, settings: Settings, wide: bool) -> None:
        self.s, self.wide = settings, wide
        number = "decimal(38,0)" if wide else "long"
        self.schema = (f"vec_id long, vector array<{number}>, cluster int, far array<double>, at array<short>, "
                       "distance long, measured long")

    def ints(self, vectors) -> np.ndarray:
        if self.wide:
            return np.array([[int(x) for x in v] for v in vectors], dtype=object).reshape(len(vectors), self.s.dim)
        return np.array([np.asarray(v, dtype="int64") for v in vectors], dtype="int64").reshape(len(vectors), self.s.dim)

    def step(self, rows: DataFrame, history: list[np.ndarray], last: bool) -> DataFrame:
        """One assignment; the last one also gives every row's exact distance."""
        ints = self.ints

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                bounds, v = Bounds(history), ints(batch["vector"])
                if batch["cluster"].isna().all():
                    cluster, far, at, measured = bounds.first(v)
                else:
                    cluster, far, at, measured = bounds.assign(
                        v, batch["cluster"].to_numpy("int64"), np.stack(batch["far"]).astype("float64"), np.stack(batch["at"]).astype("int64"))
                out = pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "vector": batch["vector"], "cluster": cluster.astype("int32"),
                                    "far": list(far), "at": list(at.astype("int16")), "distance": None, "measured": measured})
                if last:
                    out["distance"] = pd.array([d if d < 2 ** 63 else None for d in squared(v, history[-1][cluster])], "Int64")
                yield out

        return rows.mapInPandas(run, self.schema)

    def written(self, rows: DataFrame) -> tuple[DataFrame, str]:
        path = workspace(rows.sparkSession, "ns-bounds")
        write_table(rows, path)
        return open_table(rows.sparkSession, path), path

    def means(self, rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """Componentwise floor of each cluster's mean; a cluster without rows keeps its centroid."""
        number = "decimal(38,0)" if self.wide else "long"
        sums = rows.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col("vector")[i].cast(number)).alias(f"s{i}") for i in range(self.s.dim)]).collect()
        out = centroids.copy()
        for row in sums:
            out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(self.s.dim)]
        return out


def start_key(s: Settings) -> Column:
    return F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("vec_id").cast("string")), 256)


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Rows (vec_id, vector, cluster, distance), the centroids of all rounds, and the distances measured in each assignment."""
    spark, s = vectors.sparkSession, settings
    kept = usable(vectors, s)
    most = kept.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).collect()[0][0]
    job = Job(s, wide=most is not None and most * s.scale > NARROW)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for batch in batches:
            number = Decimal if job.wide else int
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].astype("Int64"), "vector": [[number(whole(x, s.scale)) for x in v] for v in batch["x"]],
                "cluster": pd.array([None] * len(batch), "Int32"), "far": None, "at": None, "distance": None, "measured": 0})

    rows, path = job.written(kept.mapInPandas(load, job.schema))
    starts = rows.where("vec_id is not null").select("vector", start_key(s).alias("start")).orderBy("start", "vector").limit(s.clusters).collect()
    if not starts:
        return rows.limit(0), [], []
    history, measured = [job.ints([r["vector"] for r in starts])], []
    for turn in range(s.rounds + 1):
        before = path
        rows, path = job.written(job.step(rows, history, last=turn == s.rounds))
        discard(spark, before)
        measured.append(rows.agg(F.sum("measured")).collect()[0][0])
        if turn < s.rounds:
            history.append(job.means(rows, history[-1]))
    return rows.select("vec_id", "vector", "cluster", "distance"), history, measured


def op13_ns_bounds(embeddings: DataFrame) -> DataFrame:
    rows, history, _ = cluster(embeddings)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in (history[-1] if history else ())]
    spark = embeddings.sparkSession
    centroids = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    known = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(known.alias("d")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    inertia = spark.createDataFrame([(c, d, total) for c, d in sums.items()], "cluster int, c decimal(38,0), t decimal(38,0)")
    return rows.join(F.broadcast(centroids), "cluster").join(F.broadcast(inertia), "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(c as long)").alias("cluster_inertia"),
        F.expr("try_cast(t as long)").alias("inertia"), "centroid_sha256")


def _oracle(s: Settings = Settings()) -> str:
    """The same rounds without bounds, as one WITH."""
    parts = [f"""
  kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {s.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
  c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS j, v
    FROM (SELECT sha256('{s.seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {s.clusters}))"""]
    for t in range(s.rounds + 1):
        parts.append(f"""
  a{t} AS MATERIALIZED (
    SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
      SELECT r, j, list_sum(list_transform(range(1, {s.dim + 1}), lambda i: (kept.v[i] - c{t}.v[i]) * (kept.v[i] - c{t}.v[i]))) AS d
      FROM kept, c{t})
    GROUP BY r)""")
        if t < s.rounds:
            parts.append(f"""
  c{t + 1} AS MATERIALIZED (
    SELECT c{t}.j, coalesce(m.v, c{t}.v) AS v FROM c{t} LEFT JOIN (
      SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
        SELECT j, i, sum(x) AS s, count(*) AS n FROM (
          SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t} JOIN kept USING (r))
        GROUP BY j, i)
      GROUP BY j) m ON m.j = c{t}.j)""")
    last = s.rounds
    return f"""
WITH {",".join(parts)}
SELECT vec_id, a{last}.j AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN c{last} ON c{last}.j = a{last}.j
"""


ORACLE_SQL = _oracle()
