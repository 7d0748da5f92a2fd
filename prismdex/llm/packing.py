"""Packing: concatenate all documents and cut the stream into fixed windows.

First pass: each task tokenises its rows and keeps a running token offset; the table is written with its
partition number. Second pass: prefix sums over the partitions' token totals (one number per partition)
turn local offsets into global ones, and each document is cut where a window ends. No row is shuffled, and
a piece is the boundary record of a document within a window. Only the last window can be short.

Null and empty texts are the separator alone. Repeated rows are packed one by one; an empty table gives no
piece. Other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import encode, kept_in_worker, settle

WINDOW = 4096
#: Words of a generation that a packing worker keeps, about 180 bytes each.
KEPT_WORDS = 600_000

#: Signs of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(_HIDDEN)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by a tokenizer that drops white space and case and never joins what white space parts.

    Such a tokenizer gives a text the ids of its words in turn, so words seen before are looked up, as
    little-endian 32-bit ids that one join puts together. A new word of small Latin letters alone is one piece to
    the tokenizer, so its bytes go straight to the merges, in the signs the byte-level vocabulary writes them with.
    The ASCII marks after a word's last letter are a piece of their own. Two generations of at most `keep` words bound what
    is kept.
    """

    LETTERS = re.compile("[a-zà-öø-ÿ]+")
    #: ASCII marks behind a letter: no piece holds both.
    ENDED = re.compile(rb"(.*[a-z])([!-/:-@\[-`{-~]+)", re.DOTALL)

    def __init__(self, file: str, keep: int = 250_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(file), keep
        self.merge = self.tokenizer.model.tokenize
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encoded(self, text: str | None) -> bytes:
        return self.encoded_all([text])[0]

    def encoded_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; the words that are new in any of them are worked out together."""
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, done, waiting, missing = self.young, [], [], set()
        for n, text in enumerate(texts):
            if text and "<|" in text:  # special tokens are told by their case
                done.append(self._ids([text])[0])
                continue
            words = encode(text).lower().split()
            found = list(map(young.get, words))
            if None in found:
                lacking = [at for at, ids in enumerate(found) if ids is None]
                missing.update([words[at] for at in lacking])
                waiting.append((n, words, found, lacking))
                done.append(b"")
            else:
                done.append(b"".join(found))
        self._learn(missing)
        for n, words, found, lacking in waiting:
            for at in lacking:
                found[at] = young[words[at]]
            done[n] = b"".join(found)
        return done

    def encoded_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, lowered and without white space."""
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        self._learn({w for w in words if w not in self.young})
        return [self.young[w] for w in words]

    def _learn(self, missing: set[bytes]) -> None:
        young, old, new, ended = self.young, self.old, set(), []
        for word in missing:
            ids = old.get(word)
            if ids is not None:
                young[word] = ids
            elif parts := self.ENDED.fullmatch(word):
                start, marks = parts.groups()
                ended.append((word, start, marks))
                if start not in young:
                    new.add(start)
                if marks not in young:
                    new.add(marks)
            else:
                new.add(word)
        rest = []
        for word in new:
            if not self.LETTERS.fullmatch(text := word.decode("utf-8", "replace")):
                rest.append((word, text))
                continue
            # Letters of ASCII are their own signs.
            merged = self.merge(text if len(text) == len(word) else word.decode("latin-1").translate(BYTE_SIGNS))
            young[word] = array("I", [t.id for t in merged]).tobytes()
        if rest:
            young.update(zip([w for w, _ in rest], self._ids([t for _, t in rest])))
        for word, start, marks in ended:
            young[word] = young[start] + young[marks]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encoded(text), "<u4")


def encoder_of(file: str, keep: int = 250_000) -> Encoder:
    return kept_in_worker(Encoder, file, keep)


def tokenized(docs: DataFrame, tokenizer_file: str, separator: int = 2) -> DataFrame:
    """(part, doc_id, ids, doc_tokens, local): ids as little-endian 32-bit numbers, local their offset in the partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = encoder_of(tokenizer_file, KEPT_WORDS), np.array([separator], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = batch.iloc[lo:lo + 256]
                ids = [found + end for found in encoder.encoded_all(rows["text"].tolist())]
                sizes = [len(x) // 4 for x in ids]
                starts = [at, *accumulate(sizes, initial=at)][1:-1]
                yield pd.DataFrame({"part": part, "doc_id": rows["doc_id"].astype("Int64"),
                                    "ids": ids, "doc_tokens": sizes, "local": starts})
                at += sum(sizes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "part int, doc_id long, ids binary, doc_tokens long, local long")


def pack(docs: DataFrame, tokenizer_file: str | None = None, window: int = WINDOW, separator: int = 2) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    rows = settle(tokenized(docs, tokenizer_file or default_tokenizer(), separator), "tokens")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    before = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, doc, ids, n, local in zip(batch["part"], batch["doc_id"], batch["ids"], batch["doc_tokens"], batch["local"]):
                at, done = before[part] + local, 0
                while done < n:
                    sequence, offset = divmod(at + done, window)
                    length = min(n - done, window - offset)
                    out.append((doc, done, length, ids[4 * done:4 * (done + length)], n, sequence, offset))
                    done += length
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return rows.mapInPandas(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op5_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
