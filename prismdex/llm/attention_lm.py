"""LM scoring: a causal self-attention model, trained and applied in numpy on subword ids.

The model gives log10 probabilities of subword ids: one attention layer over the last `context` ids predicts
the next id's class, starting from the class counts after the id before; corpus counts give the id within its
class, after the id before where it is a frequent one and after its class otherwise. Classes are clusters of ids
with like neighbours. Counts and the layer's weights come from every training document; their tables are bounded by
the vocabulary, and every id has an input row of its own.

Training goes through the documents once, in `rounds` rounds. A round deals its documents to shards of about
`shard` ids, whatever the number of files or executors; each shard starts from the last round's mean, and Spark
averages each row of weights over the shards that changed it. More input gives more shards, not smaller ones.

A document is scored in windows of `context` ids that overlap by half: each window scores its later half, the
first all of it, so each id is scored once with at least half a window before it.

Beside it stands the base score: add-one word probabilities. Frequent words' counts (at most `head` words) go out
with the tasks; rarer words, none of them a hot key, meet their counts in a join on their 64-bit hash.

Null and empty texts have the end token alone. Repeated rows are scored one by one. Without training text the
model is uniform and the base score is that of an unknown word; empty tables give no row. A null doc_id stays
null, counts as training text, and has a null `held_out`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import fold, settle, space_words
from prismdex.llm.packing import KEPT_WORDS, Encoder, default_tokenizer, encoder_of

TOP = np.float32(60)  # greatest exponent: e**60 and its sums stay well within single precision
END_WORD = "\n"  # no word holds white space, so this stands for the end of a document


@dataclass(frozen=True)
class Settings:
    width: int = 16
    context: int = 32
    classes: int = 64
    inputs: int = 0  # 0: a row for every id
    before: int = 256
    batch: int = 32
    rate: float = 0.08
    rounds: int = 2
    shard: int = 4_000_000
    head: int = 500_000


class Attention:
    """Input rows -> class log probabilities by one causal attention layer."""

    NAMES = ("emb", "pos", "wqkv", "wo", "wc", "bc")

    def __init__(self, s: Settings, prior: np.ndarray) -> None:
        """`prior`: per input row, log probabilities of the classes after it; the layer learns what to add."""
        self.prior = prior.astype(np.float32)
        r, d = np.random.default_rng(5), s.width
        self.s, self.p = s, {
            "emb": r.normal(0, 0.3, (len(prior), d)), "pos": r.normal(0, 0.1, (s.context, d)),
            "wqkv": r.normal(0, 1 / math.sqrt(d), (d, 3 * d)), "wo": r.normal(0, 1 / math.sqrt(d), (d, d)),
            "wc": r.normal(0, 0.02, (d, s.classes)), "bc": np.zeros(s.classes),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        n, d = np.arange(s.context), s.width
        #: Greatest exponent of each key (column) for each place: none of a later key.
        self.most = np.where(n > n[:, None], np.float32(-np.inf), TOP)
        self.scale = np.where(np.arange(3 * d) < d, np.float32(1 / math.sqrt(d)), np.float32(1))  # of q, k, v
        self.ones = {w: np.ones(w, np.float32) for w in (d, s.context, s.classes)}  # products with them are sums of rows

    def forward(self, x: np.ndarray):
        """Unnormalised log probabilities of the classes after each position of windows x of input rows."""
        p, (n, c), d = self.p, x.shape, self.s.width
        flat = x.ravel()
        e = p["emb"].take(flat, 0, mode="clip").reshape(n, c * d)
        e += p["pos"].ravel()
        e = e.reshape(n * c, d)
        w = self.products()
        qkv = (e @ w).reshape(n, c, 3 * d)
        q, k, v = qkv[:, :, :d], qkv[:, :, d:2 * d], qkv[:, :, 2 * d:]
        a = q @ k.transpose(0, 2, 1)
        np.exp(np.minimum(a, self.most, out=a), out=a)
        rows = a.reshape(n * c, c)
        rows /= (rows @ self.ones[c])[:, None]
        mixed = (a @ v).reshape(n * c, d)
        h = np.ones((n * c, d + 1), e.dtype)  # the last column meets bc
        np.add(mixed, e, out=h[:, :d])
        z = h @ np.concatenate([p["wc"], p["bc"][None]])
        z += self.prior.take(flat, 0, mode="clip")
        return z, (e, w, q, k, v, a, mixed, h)

    def products(self) -> np.ndarray:
        """Weights of q with its scale, of k, and of v by those of its output."""
        w, d = self.p["wqkv"] * self.scale, self.s.width
        w[:, 2 * d:] = w[:, 2 * d:] @ self.p["wo"]
        return w

    def tables(self) -> dict[str, np.ndarray]:
        """The layer's products per input row and per place, so that scoring looks them up."""
        p, w = self.p, self.products()
        return {"row": p["emb"] @ w, "place": p["pos"] @ w, "row_class": p["emb"] @ p["wc"] + p["bc"] + self.prior,
                "place_class": p["pos"] @ p["wc"]}

    def scored(self, t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
        """Log probabilities of classes y at positions first.. of windows x; 0 where y is negative."""
        n, c, d = *x.shape, self.s.width
        qkv = t["row"].take(x.ravel(), 0, mode="clip").reshape(n, c * 3 * d)
        qkv += t["place"].ravel()
        qkv = qkv.reshape(n, c, 3 * d)
        q, k, v = qkv[:, first:, :d], qkv[:, :, d:2 * d], qkv[:, :, 2 * d:]
        a = q @ k.transpose(0, 2, 1)
        np.exp(np.minimum(a, self.most[first:], out=a), out=a)
        mixed = (a @ v).reshape(-1, d)
        mixed /= (a.reshape(-1, c) @ self.ones[c])[:, None]
        z = mixed @ self.p["wc"]
        z += t["row_class"].take(x[:, first:].ravel(), 0, mode="clip")
        by_window = z.reshape(n, -1)
        by_window += t["place_class"][first:].ravel()
        if z.max() > TOP:
            np.minimum(z, TOP, out=z)
        got = z.ravel().take(np.arange(0, z.size, z.shape[1]) + np.maximum(y, 0).ravel())
        np.exp(z, out=z)
        return (got - np.log(z @ self.ones[z.shape[1]])).reshape(y.shape) * (y >= 0)

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> None:
        """One Adagrad step on windows x with classes y where `real`."""
        p, (n, c), d = self.p, x.shape, self.s.width
        z, (e, w, q, k, v, a, mixed, h) = self.forward(x)
        if z.max() > TOP:
            np.minimum(z, TOP, out=z)
        g = np.exp(z, out=z)
        share = (real.ravel() / max(1, real.sum())).astype(np.float32)
        g *= (share / (g @ self.ones[g.shape[1]]))[:, None]
        g.ravel()[np.arange(0, g.size, g.shape[1]) + y.ravel()] -= share
        out = h.T @ g
        grad = {"wc": out[:d], "bc": out[d]}
        dh = g @ p["wc"].T
        da = dh.reshape(n, c, d) @ v.transpose(0, 2, 1)
        da -= ((dh * mixed) @ self.ones[d]).reshape(n, c, 1)
        da *= a
        dqkv = np.empty((n, c, 3 * d), e.dtype)
        np.matmul(da, k, out=dqkv[:, :, :d])
        np.matmul(da.transpose(0, 2, 1), q, out=dqkv[:, :, d:2 * d])
        np.matmul(a.transpose(0, 2, 1), dh.reshape(n, c, d), out=dqkv[:, :, 2 * d:])
        dqkv = dqkv.reshape(n * c, 3 * d)
        dw = e.T @ dqkv
        grad["wo"] = p["wqkv"][:, 2 * d:].T @ dw[:, 2 * d:]
        dw[:, 2 * d:] = dw[:, 2 * d:] @ p["wo"].T
        grad["wqkv"] = dw * self.scale
        dh += dqkv @ w.T
        grad["pos"] = dh.reshape(n, c * d).sum(0).reshape(c, d)
        flat = x.ravel()
        order = np.argsort(flat.astype(np.min_scalar_type(len(p["emb"]))), kind="stable")  # a radix sort up to 16 bits
        ordered = flat.take(order)
        new = np.ones(n * c, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        used, emb = ordered.take(starts), np.add.reduceat(dh.take(order, 0, mode="clip"), starts, 0)
        seen = self.seen["emb"].take(used, 0, mode="clip")
        seen += emb * emb
        self.seen["emb"][used] = seen
        emb *= np.float32(self.s.rate)
        emb /= np.sqrt(seen)
        p["emb"][used] = p["emb"].take(used, 0, mode="clip") - emb
        rest = self.NAMES[1:]  # small, so they are worked out as one
        change, sums = (np.concatenate([group[name].ravel() for name in rest]) for group in (grad, self.seen))
        sums += change * change
        change *= np.float32(self.s.rate)
        change /= np.sqrt(sums)
        at = 0
        for name in rest:
            shape, end = p[name].shape, at + p[name].size
            self.seen[name] = sums[at:end].reshape(shape)
            p[name] -= change[at:end].reshape(shape)
            at = end

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights in lines of `width`, and per line the mean of its squared gradients' sums."""
        width = self.s.width
        both = []
        for group in (self.p, self.seen):
            values = np.concatenate([group[n].ravel() for n in self.NAMES])
            both.append(np.pad(values, (0, -len(values) % width)).reshape(-1, width))
        return both[0], both[1].mean(1)

    def load(self, lines: np.ndarray, seen: np.ndarray) -> Attention:
        at, values, sums = 0, lines.ravel(), np.repeat(seen, self.s.width)
        for n in self.NAMES:
            size, shape = self.p[n].size, self.p[n].shape
            self.p[n] = values[at:at + size].reshape(shape).astype(np.float32)
            self.seen[n] = np.maximum(sums[at:at + size].reshape(shape), 1e-3).astype(np.float32)
            at += size
        return self


class Vocabulary:
    """Input row of every id, its class, and counts of ids within their class after frequent ids."""

    SMOOTH, BACK = 0.05, 4.0

    def __init__(self, counts: np.ndarray, s: Settings) -> None:
        self.s, self.counts, self.size = s, counts, len(counts)
        self.inputs = s.inputs or len(counts) + 1
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        self.row = np.minimum(rank + 1, self.inputs - 1)  # row 0 begins a document
        self.near = np.minimum(self.row, s.before - 1)

    def cluster(self, pairs: pd.DataFrame, rounds: int = 12) -> None:
        """Classes from the counts n of (near row, id): `side` 0 before the id, 1 after it."""
        c, before = self.s.classes, self.s.before
        share = np.zeros((self.size, 2 * before), np.float32)
        np.add.at(share, (pairs["id"], pairs["side"] * before + pairs["near"]), pairs["n"])
        known = np.flatnonzero(self.counts > 0)
        x, weight = share[known] + np.float32(0.01), self.counts[known]
        x = np.sqrt(x / x.sum(1, keepdims=True))
        centre = x[np.argsort(-weight, kind="stable")[:c]].copy()
        at = np.zeros(len(known), np.int64)
        for _ in range(rounds if len(known) else 0):
            at = (2 * x @ centre.T - (centre ** 2).sum(1)).argmax(1)
            for k in range(len(centre)):
                if (at == k).any():
                    centre[k] = (x[at == k] * weight[at == k, None]).sum(0) / weight[at == k].sum()
        self.cls = np.full(self.size, c - 1)
        self.cls[known] = at
        smooth = self.counts + self.SMOOTH
        self.alone = smooth / np.bincount(self.cls, smooth, c)[self.cls]
        # A frequent id has a row of its own, the others one per class.
        self.link, self.links = np.where(self.row < before - 1, self.row, before - 1 + self.cls), before - 1 + c

    def follow(self, link: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Counts n of ids after the id or class `link`."""
        self.after, self.table = (link, ids, n), None

    def within(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each id within its class, after the id or class before it."""
        if self.table is None:  # made once per worker: links x vocabulary
            link, after, n = self.after
            count = np.zeros((self.links, self.size), np.float32)
            count[link, after] = n
            order = np.argsort(self.cls, kind="stable")
            of, starts = np.unique(self.cls[order], return_index=True)
            whole = np.zeros((self.links, self.s.classes), np.float32)
            whole[:, of] = np.add.reduceat(count[:, order], starts, 1)
            count += (self.BACK * self.alone).astype(np.float32)
            for k in range(self.links):
                count[k] /= whole[k, self.cls] + np.float32(self.BACK)
            self.table = np.log10(count, out=count).ravel()
        return self.table[np.r_[0, self.link[ids[:-1]]] * self.size + ids]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}


def windows(ids: np.ndarray, vocabulary: Vocabulary, context: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, context) input rows, and the places scored in each (as a start); padded with row 0."""
    half, n = context // 2, len(ids)
    count = 1 if n <= context else 1 + -(-(n - context) // half)
    inputs = np.zeros(context + half * (count - 1), np.int64)
    inputs[1:n] = vocabulary.row[ids[:-1]]
    return np.lib.stride_tricks.sliding_window_view(inputs, context)[::half], half


def log10_probability(docs: list[np.ndarray], model: Attention, vocabulary: Vocabulary, tables: dict | None = None) -> np.ndarray:
    """Sum over each document's ids, windows of many documents batched together."""
    c = model.s.context
    tables = tables or model.tables()
    half, out = c // 2, np.array([vocabulary.within(d).sum(dtype=float) for d in docs])
    first_x, first_y, later_x, later_y, first_of, later_of = [], [], [], [], [], []
    for k, ids in enumerate(docs):
        x, _ = windows(ids, vocabulary, c)
        y = np.full(c + half * (len(x) - 1), -1)
        y[:len(ids)] = vocabulary.cls[ids]
        first_x.append(x[0]); first_y.append(y[:c]); first_of.append(k)  # noqa: E702
        if len(x) > 1:
            later_x.append(x[1:]); later_y.append(y[c:].reshape(-1, half)); later_of.append(np.full(len(x) - 1, k))  # noqa: E702
    lots = [(np.array(first_x), np.array(first_y), np.array(first_of), 0)]
    if later_x:
        lots.append((np.concatenate(later_x), np.concatenate(later_y), np.concatenate(later_of), half))
    for x, y, of, first in lots:
        for lo in range(0, len(x), 128):
            got = model.scored(tables, x[lo:lo + 128], y[lo:lo + 128], first)
            np.add.at(out, of[lo:lo + 128], got.sum(1, dtype=float) / math.log(10))
    return out


def lots(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of rows in turn whose sizes come to at most `most`, or of one larger row."""
    lo = held = at = 0
    for at, n in enumerate(sizes, 1):
        if held and held + n > most:
            yield lo, at - 1
            lo, held = at - 1, 0
        held += n
    if at > lo:
        yield lo, at


def in_training() -> Column:
    return F.coalesce(fold("doc_id", 7), F.lit(0)) != 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def word_counts(docs: DataFrame, limit: int = 500_000) -> DataFrame:
    """(h, c, n): counts of every word, by hash, the end token among them, over the training documents and over all.

    A task sums up to `limit` distinct words before it sends them on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sent(counted: list[Counter]) -> pd.DataFrame:
            words = list(counted[0].keys() | counted[1].keys())
            c, rest = (np.fromiter(map(x.__getitem__, words), np.int64, len(words)) for x in counted)
            return pd.DataFrame({"h": np.array([_signed(xxhash.xxh64_intdigest(w, 42)) for w in words], np.int64), "c": c, "n": c + rest})

        counted = [Counter(), Counter()]
        for b in batches:
            for text, held in zip(b["text"], b["held"]):
                counted[held].update(space_words(text))
                counted[held][END_WORD.encode()] += 1
                if len(counted[0]) + len(counted[1]) > limit:
                    yield sent(counted)
                    counted = [Counter(), Counter()]
        yield sent(counted)

    return docs.select("text", (~in_training()).cast("int").alias("held")).mapInPandas(run, "h long, c long, n long").groupBy("h").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"))


class WordTable:
    """Words met in a task, each looked up once per occurrence: subword ids, hash, and count where frequent (else -1).

    Beyond `keep` words it starts anew with those of the texts at hand.
    """

    def __init__(self, encoder: Encoder, head_h: np.ndarray, head_c: np.ndarray, keep: int = 500_000) -> None:
        """`head_h`: hashes of the frequent words, ascending; `head_c`: their counts."""
        self.encoder, self.head, self.keep = encoder, (head_h, head_c), keep
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.h, self.c = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: list[bytes]) -> list[int]:
        """The place of each word in `ids`, `h` and `c`."""
        found = list(map(self.at.get, words))
        if None not in found:
            return found
        new = list({w: None for w, k in zip(words, found) if k is None})
        if self.at and len(self.at) + len(new) > self.keep:
            self.clear()
            return self.places(words)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.ids += self.encoder.encoded_words(new)
        h = np.fromiter((_signed(xxhash.xxh64_intdigest(w, 42)) for w in new), np.int64, len(new))
        head_h, head_c = self.head
        c = np.full(len(h), -1)
        if len(head_h):
            near = np.searchsorted(head_h, h).clip(max=len(head_h) - 1)
            c = np.where(head_h[near] == h, head_c[near], -1)
        self.h, self.c = np.r_[self.h, h], np.r_[self.c, c]
        return [self.at[w] if k is None else k for w, k in zip(words, found)]


def tokens_written(docs: DataFrame, tokenizer_file: str, head: pd.DataFrame, unknown: float) -> tuple[DataFrame, int]:
    """Per document, written once: row number, subword ids (the end id last) and the words' part of the base score.

    `known` and `base` cover the words of `head` (h, c); `tail_h` and `tail_n` hold the others. Also the vocabulary size.
    """
    size = Encoder(tokenizer_file).tokenizer.get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    head = head.sort_values("h")
    sent = docs.sparkSession.sparkContext.broadcast((head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, last = encoder_of(tokenizer_file, KEPT_WORDS), np.array([size - 1], kind).tobytes()
        words, at = WordTable(encoder, *sent.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in lots(batch["text"].fillna("").str.len(), 1 << 20):
                part = batch.iloc[lo:hi]
                texts = part["text"].tolist()
                found = [space_words(text) + [END_WORD.encode()] for text in texts]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ends = np.cumsum(sizes)
                index = words.places(list(chain.from_iterable(found)))
                ids = [encoder.encoded(text) if text and "<|" in text else b"".join(map(words.ids.__getitem__, index[end - n:end - 1]))
                       for text, n, end in zip(texts, sizes.tolist(), ends.tolist())]
                index, of = np.array(index, np.int64), np.repeat(np.arange(len(found)), sizes)
                c = words.c[index]
                base = np.bincount(of, np.log10(np.maximum(c, 0) + 1.0), len(found)) + sizes * unknown
                tail, n = np.unique(of[c < 0] << 32 | index[c < 0], return_counts=True)
                cuts = np.searchsorted(tail >> 32, np.arange(1, len(found)))
                frame = pd.DataFrame({
                    "row": np.arange(at, at + len(part)), "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                    "ids": [np.frombuffer(x, "<u4").astype(kind).tobytes() + last for x in ids], "n_tokens": sizes,
                    "known": np.bincount(of[c > 0], minlength=len(found)), "base": base,  # a count of 0 gains nothing
                    "tail_h": np.split(words.h[tail & 0xFFFFFFFF], cuts), "tail_n": np.split(n.astype(np.int32), cuts)})
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "row long, doc_id long, ids binary, n_tokens long, known long, base double, tail_h array<long>, tail_n array<int>")
    written = settle(rows, "subwords")
    sent.destroy()
    return written, size


def read_ids(ids: bytes, size: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if size <= 1 << 16 else "<u4").astype(np.int64)


def _summed(rows: DataFrame, size: int, cells: int, keys_of) -> tuple[np.ndarray, np.ndarray]:
    """(keys, n) summed over the training documents; `keys_of` gives the keys, below `cells`, of many documents' ids.

    It is given the ids side by side and whether each begins a document. A task holds one count per cell, and sends those above zero;
    there are no more tasks than cores, as each sends the frequent keys again.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.int64 if cells < 1 << 23 else np.int32)
        for b in batches:
            for lo, hi in lots(b["ids"].map(len), 1 << 20):
                ids = b["ids"].iloc[lo:hi].tolist()
                flat = read_ids(b"".join(ids), size)
                first = np.zeros(len(flat), bool)
                first[np.cumsum([0, *map(len, ids[:-1])]) // (2 if size <= 1 << 16 else 4)] = True
                for keys in keys_of(flat, first):
                    np.add.at(total, keys, 1)
        met = np.flatnonzero(total)
        for lo in range(0, len(met), 100_000):
            yield pd.DataFrame({"key": met[lo:lo + 100_000], "n": total[met[lo:lo + 100_000]].astype(np.int64)})

    training = rows.where(in_training()).select("ids").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    found = training.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    return found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def learn_vocabulary(rows: DataFrame, size: int, s: Settings) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and class prior by three passes of counts, each table bounded by the vocabulary and `s`."""
    key, n = _summed(rows, size, size, lambda ids, first: [ids])
    counts = np.zeros(size)
    counts[key] = n
    vocabulary, before = Vocabulary(counts, s), s.before

    def neighbours(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        near = vocabulary.near[ids]
        left = np.r_[0, near[:-1]]
        left[first] = 0
        inner = ~first[1:]
        return [left * size + ids, (before + near[1:][inner]) * size + ids[:-1][inner]]

    key, n = _summed(rows, size, 2 * before * size, neighbours)
    vocabulary.cluster(pd.DataFrame({"side": key // size // before, "near": key // size % before, "id": key % size, "n": n}))
    # What follows the frequent ids, whose rows are their links, has been counted. From here on: after the others.
    often = before - 1
    known = key < often * size
    links, after, times = [key[known] // size], [key[known] % size], [n[known]]
    turns = s.classes * size  # from here on: counts of classes after input rows

    def followers(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero((vocabulary.row[ids[:-1]] >= often) & ~first[1:])
        left, right = ids[at], ids[at + 1]
        return [vocabulary.cls[left] * size + right, turns + vocabulary.row[left] * s.classes + vocabulary.cls[right]]

    key, n = _summed(rows, size, turns + vocabulary.inputs * s.classes, followers)
    prior = np.zeros(vocabulary.inputs * s.classes)
    prior[key[key >= turns] - turns] = n[key >= turns]
    np.add.at(prior, links[0] * s.classes + vocabulary.cls[after[0]], times[0])
    key, n = key[key < turns], n[key < turns]
    links.append(often + key // size), after.append(key % size), times.append(n)
    vocabulary.follow(*(np.concatenate(x).astype(kind) for x, kind in ((links, np.int32), (after, np.int32), (times, np.float32))))
    prior = prior.reshape(vocabulary.inputs, s.classes)
    overall = prior.sum(0) + 0.1
    prior += 0.1 + vocabulary.BACK * overall / overall.sum()  # rare ids lean on the classes' shares
    return vocabulary, np.log(prior / prior.sum(1, keepdims=True)).astype(np.float32)


def training_windows(ids: np.ndarray, vocabulary: Vocabulary, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Windows of input rows side by side, and the classes to predict (-1: none): every id once."""
    count = -(-len(ids) // s.context)
    x, y = np.zeros(count * s.context, np.int64), np.full(count * s.context, -1)
    x[1:len(ids)] = vocabulary.row[ids[:-1]]
    y[:len(ids)] = vocabulary.cls[ids]
    return x.reshape(count, -1), y.reshape(count, -1)


def train(rows: DataFrame, shared: Broadcast, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over the training documents, each document in one of them; rows of weights are averaged by the windows seen.

    `shared` holds the vocabulary and the class prior. Returns the model's lines, as `Attention.load` takes them.
    """
    names, spark = [f"w{k}" for k in range(s.width)], rows.sparkSession
    vocabulary, prior = shared.value
    size, rows = vocabulary.size, rows.where(in_training()).select("row", "ids")
    shards = max(1, -(-int(vocabulary.counts.sum()) // (s.shard * s.rounds)))
    lines, sums = Attention(s, prior).lines()
    for turn in range(s.rounds):
        sent = spark.sparkContext.broadcast((lines, sums))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            vocabulary, prior = shared.value
            start = sent.value[0]
            model, seen, lot, waiting = Attention(s, prior).load(*sent.value), 0, [], 0

            def learn(lot) -> int:
                x, y = (np.concatenate(part) for part in zip(*lot))
                order = np.random.default_rng(len(x)).permutation(len(x))
                for lo in range(0, len(x), s.batch):
                    at = order[lo:lo + s.batch]
                    model.step(x[at], np.maximum(y[at], 0), y[at] >= 0)
                return len(x)

            for b in batches:
                for ids in b["ids"]:
                    lot.append(training_windows(read_ids(ids, size), vocabulary, s))
                    waiting += len(lot[-1][0])
                    if waiting > 4096:
                        seen, lot, waiting = seen + learn(lot), [], 0
            if lot:
                seen += learn(lot)
            if seen:
                now, sums = model.lines()
                moved = np.flatnonzero((now != start).any(1))
                weights = {n: (now[moved, k] * np.float32(seen)) for k, n in enumerate(names)}
                yield pd.DataFrame({"line": moved, "seen": np.float32(seen), "sums": sums[moved] * np.float32(seen), **weights})

        dealt = rows.where(F.pmod(F.xxhash64("row"), F.lit(s.rounds)) == turn).repartition(shards, "row").sortWithinPartitions("row")
        parts = dealt.select("ids").mapInPandas(run, "line long, seen float, sums float, " + ", ".join(f"{n} float" for n in names))
        # No longer than the model, whatever the input.
        mean = parts.groupBy("line").agg(*[(F.sum(n) / F.sum("seen")).alias(n) for n in ["sums", *names]]).toPandas()
        sent.destroy()
        at = mean["line"].to_numpy(np.int64)
        lines[at], sums[at] = mean[names].to_numpy(np.float32), mean["sums"].to_numpy(np.float32)
    return lines, sums


def score_documents(docs: DataFrame, tokenizer_file: str | None = None, settings: Settings = Settings()) -> DataFrame:
    spark = docs.sparkSession
    counts = settle(word_counts(docs), "word-counts")
    total, distinct, words = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most `head` words can each make up a `head`-th of all; their counts go out with the tasks.
    often = max(1, words // settings.head)
    head = counts.where(F.col("n") > often).select("h", "c").toPandas()
    rows, size = tokens_written(docs, tokenizer_file or default_tokenizer(), head, math.log10(1 / (total + distinct + 1)))
    vocabulary, prior = learn_vocabulary(rows, size, settings)
    shared = spark.sparkContext.broadcast((vocabulary, prior))
    sent = spark.sparkContext.broadcast(train(rows, shared, settings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, prior = shared.value
        model = Attention(settings, prior).load(*sent.value)
        tables = model.tables()
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.iloc[lo:lo + 128]
                scores = log10_probability([read_ids(i, size) for i in part["ids"]], model, vocabulary, tables)
                yield part[["row", "doc_id", "n_tokens", "known", "base"]].assign(doc_id=part["doc_id"].astype("Int64"), score=scores)

    scored = rows.select("row", "doc_id", "n_tokens", "known", "base", "ids").mapInPandas(
        run, "row long, doc_id long, n_tokens long, known long, base double, score double")
    tail = rows.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select(
        "row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("k"))
    # No such word is a hot key: none makes up more than a `head`-th of all words.
    met = tail.join(counts.where((F.col("n") <= often) & (F.col("c") > 0)).select("h", "c"), "h").groupBy("row").agg(
        F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("gained"))
    return scored.join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gained", F.lit(0.0))).alias("base_score"), "score")


def op4_attention_lm(docs: DataFrame) -> DataFrame:
    return score_documents(docs).select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
