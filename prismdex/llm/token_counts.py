"""Token counts from a cache keyed by digests of the content and of the tokenizer.

The cache is a Parquet table (tokenizer, digest, n_tokens), one folder per tokenizer version. A version is the
SHA-256 of the library's name and version and of the tokenizer's file; a content is the SHA-256 of the UTF-8
bytes of the normalised text. Normalising makes a null text empty and changes nothing else, since any byte may
change what a tokenizer makes of a text. The digests of a table are joined to the stored counts, only one text of
each digest without a count is encoded, and the new counts are appended; a run over texts seen before
encodes nothing.

Texts move only to find one of each missing digest: a task sends one text per digest, so a large group of copies is
few rows when it meets. Where few digests are missing they are broadcast and the other texts never move. Counts
come back by digest; digests of more than `HOT_ROWS` rows are handed out by a small table of their own.

Two writers may store the same count; it is read once. A lost task writes nothing before Spark commits the job. Null and empty
texts have no tokens; repeated rows are counted each; an empty table gives no row and leaves the cache as it was.
Only doc_id and text are looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismdex.llm.common import settle
from prismdex.operators.sizing import BROADCAST_ROWS, lookup_join
from prismdex.sources.store import open_or_empty, workspace

HOT_ROWS = 10_000
CACHE = "digest binary, n_tokens long, tokenizer string"


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer's file as it is sent to the tasks, and the digest of its version."""

    kind: str
    data: bytes
    version: str

    @staticmethod
    def read(path: str) -> Tokenizer:
        """`path` names a .json file (tokenizers) or a .model file (sentencepiece) on the driver."""
        kind = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(path)[1])
        if kind is None:
            raise ValueError(f"neither a .json nor a .model file: {path}")
        import importlib.metadata

        with open(path, "rb") as file:
            data = file.read()
        version = f"{kind}\0{importlib.metadata.version(kind)}\0".encode() + data
        return Tokenizer(kind, data, hashlib.sha256(version).hexdigest())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenizersCounter:
    """Counts by the tokenizers library.

    A byte-level tokenizer that splits by its usual pattern never joins what lies on both sides of a space
    that something other than white space follows. Its texts are cut before such spaces, and the counts of pieces
    seen before are looked up; two generations of about `keep` characters bound what is kept. Texts with an
    added token's string, and all texts of other tokenizers, are encoded whole.
    """

    CUT = re.compile(r"(?= \S)")

    def __init__(self, data: bytes, keep: int = 4_000_000) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        text, self.keep = data.decode(), keep
        self.library = Library.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        about = json.loads(text)
        split = about.get("pre_tokenizer") or {}
        self.pieces = (about.get("normalizer") is None and split.get("type") == "ByteLevel"
                       and bool(split.get("use_regex", True)) and not split.get("add_prefix_space"))
        self.added = [t["content"] for t in about.get("added_tokens") or ()]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size = 0

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.pieces or any(s in text for s in self.added):
            return self.whole([text])[0]
        first, *words = text.split(" ")
        try:  # words after one space each, all seen before; keys have no leading white space
            return sum(map(self.young.__getitem__, words)) + self.whole([first])[0]
        except KeyError:
            pass
        if all(w and not w[0].isspace() for w in words):
            self._learn(words)
            return sum(map(self.young.__getitem__, words)) + self.whole([first])[0]
        first, *rest = self.CUT.split(text)
        words = [piece[1:] for piece in rest]
        self._learn(words)
        return sum(map(self.young.__getitem__, words)) + self.whole([first])[0]

    def _learn(self, words: list[str]) -> None:
        if self.size > self.keep:
            self.young, self.old, self.size = {}, self.young, 0
        new = []
        for word in {w for w in words if w not in self.young}:
            known = self.old.get(word)
            if known is None:
                new.append(word)
            else:
                self.young[word] = known
        for lo in range(0, len(new), 4096):
            lot = new[lo:lo + 4096]
            self.young.update(zip(lot, self.whole([" " + w for w in lot])))
            self.size += sum(map(len, lot))


class SentencepieceCounter:
    """Counts by the sentencepiece library, text by text."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))


@lru_cache(maxsize=1)
def _counter(kind: str, version: str, data: bytes) -> TokenizersCounter | SentencepieceCounter:
    """One counter per Python worker, kept for its next tasks; `version` names the data."""
    return {"tokenizers": TokenizersCounter, "sentencepiece": SentencepieceCounter}[kind](data)


def encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of rows (digest, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer.kind, tokenizer.version, tokenizer.data)
        for batch in batches:
            counts = [counter.count(x.as_py().decode("utf-8", "replace")) for x in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(run, "digest binary, n_tokens long")


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, each digest once."""
    rows = open_or_empty(spark, cache, T.StructType.fromDDL(CACHE)).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_file: str | None = None, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row; `cache` is a shared folder that later calls may name again."""
    spark = docs.sparkSession
    tokenizer = Tokenizer.read(tokenizer_file or default_tokenizer())
    cache = cache or workspace(spark, "token-cache")
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.unhex(F.sha2(content, 256)).alias("digest")

    rows = settle(docs.select(F.col("doc_id").cast("long"), F.octet_length(content).cast("long").alias("n_bytes"), digest), "digests")
    tally = settle(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "distinct")
    misses = settle(tally.select("digest").join(stored(spark, cache, tokenizer.version), "digest", "left_anti"), "misses")
    missing = misses.count()
    if missing:
        texts = docs.select(digest, content.alias("content"))
        if missing <= BROADCAST_ROWS // 4:
            texts = texts.join(F.broadcast(misses), "digest")
        one = texts.groupBy("digest").agg(F.first("content").alias("content"))
        if missing > BROADCAST_ROWS // 4:
            one = one.join(misses, "digest")
        encoded(one, tokenizer).withColumn("tokenizer", F.lit(tokenizer.version)).write.mode("append").partitionBy("tokenizer").parquet(cache)

    counts = stored(spark, cache, tokenizer.version)
    hot = tally.where(F.col("n") > HOT_ROWS).join(counts, "digest").select("digest", F.col("n_tokens").alias("hot"))
    marked = lookup_join(rows, hot, "digest", "left", spread=["doc_id", "n_bytes"])
    many = marked.where(F.col("hot").isNotNull()).select("doc_id", "n_bytes", F.col("hot").alias("n_tokens"))
    few = marked.where(F.col("hot").isNull()).drop("hot").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    return few.unionByName(many)


def op12_token_counts(docs: DataFrame, limit: int = 1024) -> DataFrame:
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > limit)
