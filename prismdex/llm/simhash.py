"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are 64 bits over 3-word shingles. Equal fingerprints fold into one before anything is compared.
Two fingerprints within the radius differ in at most `radius` of `radius + 1` bit bands, so at least one band is
equal: tiles are the rows of one band value, ordered by population count and cut to `tile` rows. Every tile
pair of a band value is compared exactly with exclusive-or and bit counts, but for pairs whose population
counts lie further apart than the radius. Each pair hands on a spanning forest of its links instead of all
links, which keeps every component. Components come from rounds of star contraction on written tables.

Null or wordless texts have fingerprint zero and link like any other. Rows with a null doc_id get a
fingerprint; a component holding only such rows has a null id. Repeated rows each stay in the result. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import settle, space_words


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    words = space_words(text)
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, total, 65536):
        h = np.array([digest(join(words[i:i + k]), 42) for i in range(at, min(total, at + 65536))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": [_signed(fingerprint(t, words_per_shingle)) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the rows of two tiles that join their components, each link within the radius."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for at in range(0, len(a), 256):
        left = a[at:at + 256]
        i, j = np.nonzero(np.bitwise_count(left[:, None] ^ b[None, :]) <= radius)
        for x, y in zip(left[i].tolist(), b[j].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[rx] = ry
                kept.append((x, y))
    return kept


def _frame(found: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def _within(keys: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among rows of equal key; rows come sorted by key."""
    found: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    few = np.zeros(len(keys), bool)
    for s, e in zip(starts[ends - starts > 64], ends[ends - starts > 64]):
        found += forest(fp[s:e], fp[s:e], radius)
    for s, e in zip(starts[ends - starts <= 64], ends[ends - starts <= 64]):
        few[s:e] = True
    keys, fp = keys[few], fp[few]
    for step in range(1, 64):
        same = keys[step:] == keys[:-step]
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        found += zip(fp[i].tolist(), fp[i + step].tolist())
    return found


def links(prints: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp`, enough to connect every component."""
    bands, width = radius + 1, -(-64 // (radius + 1))
    mask = (1 << width) - 1
    banded = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array([
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask)).alias("value"))
        for i in range(bands)])).alias("k")).select("fp", "ones", "k.band", "k.value")
    sizes = settle(banded.groupBy("band", "value", "ones").agg(F.count("*").alias("n")), "tile-sizes")
    total = sizes.groupBy("band", "value").agg(F.sum("n").alias("n"))
    small = total.where(F.col("n").between(2, tile)).select("band", "value")
    large = total.where(F.col("n") > tile).select("band", "value")

    def compare_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch["value"].to_numpy(np.int64) * 64 + batch["band"].to_numpy(np.int64)]
            prints = np.r_[prints, batch["fp"].to_numpy(np.int64).view(np.uint64)]
            cut = int(np.flatnonzero(keys == keys[-1])[0]) if len(keys) else 0
            yield _frame(_within(keys[:cut], prints[:cut], radius) if cut else [])
            keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield _frame(_within(keys, prints, radius))

    near_small = (
        banded.join(small, ["band", "value"]).repartition("band", "value").sortWithinPartitions("band", "value")
        .select("band", "value", "fp").mapInPandas(compare_small, "a long, b long")
    )
    # Large band values: rows of one population count fill as many tiles as they need; tile pairs are dealt out.
    cuts = sizes.join(large, ["band", "value"]).withColumn("cuts", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    tiles = cuts.select("band", "value", "ones", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = tiles.withColumnsRenamed({"ones": "ones2", "cut": "cut2"})
    apart = F.col("ones2") - F.col("ones")
    pairs = tiles.join(other, ["band", "value"]).where(
        apart.between(1, radius) | ((apart == 0) & (F.col("cut2") >= F.col("cut"))))
    dealt = banded.join(cuts, ["band", "value", "ones"]).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    names = ["band", "value", "ones", "cut", "ones2", "cut2"]
    first = dealt.join(pairs, ["band", "value", "ones", "cut"]).select("fp", *names, F.lit(0).alias("side"))
    second = dealt.withColumnsRenamed({"ones": "ones2", "cut": "cut2"}).join(
        pairs, ["band", "value", "ones2", "cut2"]).select("fp", *names, F.lit(1).alias("side"))

    def compare_pair(rows: pd.DataFrame) -> pd.DataFrame:
        fp, side = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["side"].to_numpy()
        return _frame(forest(fp[side == 0], fp[side == 1], radius))

    near_large = first.unionByName(second).groupBy(*names).applyInPandas(compare_pair, "a long, b long")
    return near_small.unionByName(near_large).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large and small stars.

    Each round is written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        new = settle(small.where("a <> b").distinct(), "edges")
        stars = new.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("root"))
        chained = stars.where("n > 1").limit(1).count() or new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        edges = new
        if not chained:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"no components after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`."""
    rows = settle(with_fingerprints(docs, words_per_shingle), "fingerprints")
    firsts = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), radius))
    member = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Fingerprints that stand alone need no second look-up: their own smallest id is the answer.
    named = settle(member.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
