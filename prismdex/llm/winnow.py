"""Benchmark decontamination by winnowing.

Of each `gram`-word sequence's hash only the smallest within a sliding window of `span - gram + 1` hashes is
kept (the rightmost of equals). Two texts that share `span` words share a kept fingerprint, so none is missed.
Fingerprints of benchmark and documents are joined, and each hit is extended word by word to the whole
shared run; runs of `span` words or more are occurrences of benchmark windows. Items shorter than `span`
words are one window: their rarest-hash word is looked up and the item compared whole.

The benchmark goes to the tasks in blocks of at most `block_chars` characters: within the bound one pass over
the documents answers everything, beyond it there is one pass per block and the hits are put together by
row. Documents are never shuffled by word, so no fingerprint, passage or source is a hot key.

Null and empty texts, of items too, have no words and no hit. Repeated document rows each get a result;
repeated items count once per item_id. Words of an item without an id are hit like any other and contaminate; having no name,
it is left out of n_items and the digest. Extra columns are not looked at; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import plain_words, settle


def _word_hashes(words: list[bytes], seen: dict[bytes, bytes]) -> np.ndarray:
    """64-bit hashes of the words; digests of words seen before are looked up, up to a bound."""
    try:
        found = b"".join(map(seen.__getitem__, words))
    except KeyError:
        if len(seen) > 500_000:
            seen.clear()
        new = {w for w in words if w not in seen}
        seen.update(zip(new, map(xxhash.xxh64_digest, new)))
        found = b"".join(map(seen.__getitem__, words))
    return np.frombuffer(found, ">u8").astype(np.uint64)


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hash of each run of `gram` word hashes."""
    if len(words) < gram:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - gram + 1 + k]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the hashes kept: the rightmost smallest of each window; all in one when there are fewer."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    width = min(window, len(hashes))
    starts = len(hashes) - width + 1
    least, at = hashes[:starts], np.arange(starts)
    for k in range(1, width):
        later = hashes[k:k + starts]
        at = np.where(later <= least, np.arange(k, k + starts), at)
        least = np.minimum(least, later)
    kept = np.zeros(len(hashes), bool)
    kept[at] = True
    return np.flatnonzero(kept)


class Keys:
    """Tells which hashes are among the keys: a table of their low bits first, then the sorted keys."""

    def __init__(self, keys, bits: int = 20) -> None:
        self.sorted, self.mask = np.array(sorted(keys), np.uint64), np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.sorted & self.mask] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are keys."""
        at = np.flatnonzero(self.table[hashes & self.mask])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        return at[self.sorted[place] == hashes[at]]


class Index:
    """Fingerprints of one bounded block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], span: int, gram: int) -> None:
        self.span, self.gram, self.seen = span, gram, {}
        self.items = [(i, _word_hashes(plain_words(t), self.seen)) for i, t in items]
        self.long: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            if len(words) >= span:
                grams = gram_hashes(words, gram)
                for at in winnowed(grams, span - gram + 1).tolist():
                    self.long.setdefault(int(grams[at]), []).append((k, at))
            elif len(words):
                at = int(words.argmin())
                self.short.setdefault(int(words[at]), []).append((k, at))
        self.long_keys, self.short_keys = Keys(self.long), Keys(self.short)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged ranges of hit words, and items hit."""
        words = _word_hashes(plain_words(text), self.seen)
        n, ranges, found = len(words), [], set()
        grams = gram_hashes(words, self.gram)
        kept = winnowed(grams, self.span - self.gram + 1)
        kept = kept[self.long_keys.among(grams[kept])]
        done: dict[tuple[int, int], int] = {}
        for at in kept.tolist():
            for k, start in self.long[int(grams[at])]:
                if done.get((k, at - start), -1) >= at:
                    continue  # inside a run already extended on this diagonal
                item = self.items[k][1]
                back = min(at, start)
                differ = np.flatnonzero(words[at - back:at] != item[start - back:start])
                lo = at - back + (int(differ[-1]) + 1 if len(differ) else 0)
                ahead = min(n - at, len(item) - start)
                differ = np.flatnonzero(words[at:at + ahead] != item[start:start + ahead])
                hi = at + (int(differ[0]) if len(differ) else ahead)
                done[(k, at - start)] = hi
                if hi - lo >= self.span:
                    ranges.append((lo, hi))
                    found.add(k)
        for at in self.short_keys.among(words).tolist():
            for k, start in self.short[int(words[at])]:
                item, lo = self.items[k][1], at - start
                if lo >= 0 and lo + len(item) <= n and (words[lo:lo + len(item)] == item).all():
                    ranges.append((lo, lo + len(item)))
                    found.add(k)
        return n, merged(ranges), {self.items[k][0] for k in found if self.items[k][0] is not None}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def digest(n: int, ranges: list[tuple[int, int]], items: set[int]) -> tuple[int, int, int, str]:
    names = ",".join(sorted(str(i) for i in items))
    return n, sum(hi - lo for lo, hi in ranges), len(items), hashlib.sha256(names.encode()).hexdigest()


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lots of at most `block_chars` characters (one item at least)."""
    lot, chars = [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        if lot and chars + len(row["text"]) > block_chars:
            yield lot
            lot, chars = [], 0
        lot.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    yield lot


def _others(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns if c.lower() not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 5, block_chars: int = 16_000_000) -> DataFrame:
    """Rows of `docs` with n_words, n_hit, n_items, items_sha256 and contaminated after their own columns."""
    out_type = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string>"
    part_type = "struct<n:long,lo:array<long>,hi:array<long>,items:array<long>>"
    lots = _blocks(benchmark, block_chars)
    first = next(lots)
    second = next(lots, None)
    if second is None:
        def all_at_once(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            index = Index(first, span, gram)
            for texts in batches:
                yield pd.DataFrame([digest(*index.hits(t)) for t in texts], columns=["n_words", "n_hit", "n_items", "items_sha256"])

        result = docs.withColumn("_hit", F.pandas_udf(all_at_once, out_type)("text"))
        own = _others(docs)
        return result.select(*own, "_hit.*", (F.col("_hit.n_hit") > 0).alias("contaminated"))

    def pass_over(texts_of: DataFrame, lot: list[tuple[int, str]], k: int) -> DataFrame:
        def one_block(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            index = Index(lot, span, gram)
            for texts in batches:
                rows = [index.hits(t) for t in texts]
                yield pd.DataFrame({"n": [r[0] for r in rows], "lo": [[a for a, _ in r[1]] for r in rows],
                                    "hi": [[b for _, b in r[1]] for r in rows], "items": [sorted(r[2]) for r in rows]})

        return texts_of.withColumn(f"_b{k % 2}", F.pandas_udf(one_block, part_type)("text"))

    def put_together(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for old, new in batches:
            made = []
            for (n, lo, hi, items), (_, lo2, hi2, items2) in zip(old[["n", "lo", "hi", "items"]].values, new[["n", "lo", "hi", "items"]].values):
                both = merged([*zip(lo, hi), *zip(lo2, hi2)])
                made.append((n, [a for a, _ in both], [b for _, b in both], sorted({*items, *items2})))
            yield pd.DataFrame(made, columns=["n", "lo", "hi", "items"])

    join = F.pandas_udf(put_together, part_type)
    rows = settle(pass_over(docs, first, 0), "hits")
    k, lot = 1, second
    while lot is not None:  # one written pass per block of the benchmark
        rows = settle(pass_over(rows, lot, 1).withColumn("_b0", join("_b0", "_b1")).drop("_b1"), "hits")
        k, lot = k + 1, next(lots, None)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([digest(n, list(zip(lo, hi)), set(items)) for n, lo, hi, items in b[["n", "lo", "hi", "items"]].values],
                               columns=["n_words", "n_hit", "n_items", "items_sha256"])

    result = rows.withColumn("_hit", F.pandas_udf(finish, out_type)("_b0"))
    own = _others(docs)
    return result.select(*own, "_hit.*", (F.col("_hit.n_hit") > 0).alias("contaminated"))


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs.select("doc_id", "text"), benchmark).drop("text")
