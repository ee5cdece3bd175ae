"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, quoted, spans, tune, utf8, with_made

#: A chunk is two blocks of BLOCK bytes; chunks overlap by one block. A filter sees two cells of CELL bytes.
BLOCK, CELL = 256, 4
CHUNK = 2 * BLOCK


@dataclass(frozen=True)
class Training:
    """documents, bytes: of each class, at most, that are learned from, a bounded sample of labelled rows; texts are taken
    whole, in the order of a hash, and one that would go beyond the bytes is passed over. So the driver gets 2 * bytes."""

    documents: int = 600
    bytes: int = 4 << 20
    filters: int = 16
    embedding: int = 8
    epochs: int = 14
    rate: float = 0.01
    seed: int = 50


class Network:
    """Byte embedding, filters over neighbouring cells, maximum over a chunk, linear, mean over chunks, logistic."""

    def __init__(self, params: Training):
        rng = np.random.default_rng(params.seed)
        d, f = params.embedding, params.filters
        self.emb = rng.normal(0, 0.5, (256, d)).astype(np.float32)
        self.w = rng.normal(0, 1 / np.sqrt(2 * CELL * d), (CELL * d, 2 * f)).astype(np.float32)  # first and second cell
        self.b = np.zeros(f, np.float32)
        self.v = rng.normal(0, 0.1, f).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    @property
    def filters(self) -> int:
        return len(self.b)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of documents given by bytes and offsets; each is padded with zeros to whole blocks, two at least.

        A window is two neighbouring cells, and lies within a chunk: a chunk's maximum is that of the windows inside its
        two blocks and of the window across them.
        """
        lengths = np.diff(offsets)
        blocks = np.maximum(2, -(-lengths // BLOCK))
        ends = np.cumsum(blocks)
        padded = np.zeros(int(ends[-1]) * BLOCK + CELL, np.uint8)
        at = (ends - blocks) * BLOCK
        for i in range(len(lengths)):
            padded[at[i] : at[i] + lengths[i]] = data[offsets[i] : offsets[i + 1]]
        n, f, per = int(ends[-1]), self.filters, BLOCK // CELL
        inside, across = np.empty((n, f), np.float32), np.empty((n, f), np.float32)
        step = 1 << 10  # blocks at once
        for a in range(0, n, step):
            b = min(a + step, n)
            both = self.emb[padded[a * BLOCK : b * BLOCK + CELL]].reshape(-1, CELL * self.emb.shape[1]) @ self.w
            r = (both[:-1, :f] + both[1:, f:]).reshape(b - a, per, f)
            inside[a:b], across[a:b] = r[:, :-1].max(axis=1), r[:, -1]
        pooled = np.maximum(np.maximum(inside[:-1], inside[1:]), across[:-1])
        logit = np.maximum(pooled + self.b, 0) @ self.v + self.c[0]
        keep = np.ones(len(logit), bool)
        keep[ends[:-1] - 1] = False  # a chunk lies within one document
        logit = logit[keep].astype(np.float64)
        first = np.concatenate([[0], np.cumsum(blocks - 1)[:-1]])
        mean = np.add.reduceat(logit, first) / (blocks - 1)
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk (n, CHUNK) and filter, the greatest response and its window; some chunks at a time."""
        f, width = self.filters, CELL * self.emb.shape[1]
        top, best = np.empty((len(raw), f), np.float32), np.empty((len(raw), f), np.int64)
        for a in range(0, len(raw), 512):
            both = self.emb[raw[a : a + 512]].reshape(-1, CHUNK // CELL, width) @ self.w
            r = both[:, :-1, :f] + both[:, 1:, f:]
            best[a : a + 512] = r.argmax(axis=1)
            top[a : a + 512] = np.take_along_axis(r, best[a : a + 512, None, :], 1)[:, 0, :]
        return top, best

    def fit(self, chunks: np.ndarray, docs: np.ndarray, labels: np.ndarray, params: Training) -> None:
        """chunks: (n, CHUNK) bytes; docs: the document of each, ascending; labels: 0 or 1 of each document. Adam on the
        cross-entropy of documents; classes weigh the same."""
        n_docs, d, f = len(labels), self.emb.shape[1], self.filters
        if not n_docs or labels.min() == labels.max():  # nothing to tell apart
            self.v[:] = 0
            self.c[:] = 4.0 if n_docs and labels[0] else (-4.0 if n_docs else 0.0)
            return
        weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * n_docs
        names = ("emb", "w", "b", "v", "c")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        s = {k: np.zeros_like(getattr(self, k)) for k in names}
        starts = np.searchsorted(docs, np.arange(n_docs + 1))
        rng, step = np.random.default_rng(params.seed + 1), 0
        for epoch in range(params.epochs):
            order = rng.permutation(n_docs)
            for a in range(0, n_docs, 32):
                some = order[a : a + 32]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
                count = starts[some + 1] - starts[some]
                owner = np.repeat(np.arange(len(some)), count)
                raw = chunks[rows]
                top, best = self.pooled(raw)
                h = np.maximum(top + self.b, 0)
                logit = h @ self.v + self.c[0]
                z = np.bincount(owner, logit, len(some)) / count
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                dz = ((p - labels[some]) * weight[some] / len(some) / count)[owner].astype(np.float32)
                dh = dz[:, None] * self.v * (top + self.b > 0)
                g = {"v": h.T @ dz, "c": np.array([dz.sum()], np.float32), "b": dh.sum(axis=0)}
                n = np.arange(len(rows))[:, None]
                cells = raw.reshape(len(rows), CHUNK // CELL, CELL)
                x0, x1 = (self.emb[cells[n, w]].reshape(len(rows), f, CELL * d) for w in (best, best + 1))
                g["w"] = np.concatenate([np.einsum("nfk,nf->kf", x0, dh), np.einsum("nfk,nf->kf", x1, dh)], axis=1)
                g["emb"] = np.zeros_like(self.emb)
                for where, w in ((best, self.w[:, :f]), (best + 1, self.w[:, f:])):
                    dx = (dh[:, :, None] * w.T[None]).reshape(-1, d)
                    np.add.at(g["emb"], cells[n, where].reshape(-1), dx)
                step += 1
                rate = params.rate * (1 - epoch / params.epochs)
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    now = getattr(self, k)
                    now -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def chunks_of(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes: all chunks of a whole text, the last padded with zeros."""
    blocks = max(2, -(-len(text) // BLOCK))
    padded = np.frombuffer(text.ljust(blocks * BLOCK, b"\0"), np.uint8).reshape(blocks, BLOCK)
    return np.concatenate([padded[:-1], padded[1:]], axis=1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: Training = Training()) -> Network:
    """A network from a bounded sample of the labelled documents: of each class those first by a hash of the id.

    Labels other than 0 and 1, null ids, and labels of no document are left out; of several labels of one id the
    smallest counts, and of several texts of one id the smallest. Without documents of both classes the network returns
    a constant. Sampled texts are learned from whole.
    """
    tune(docs.sparkSession)
    known = labels.where(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull()).groupBy(quoted(id_col).cast("long").alias("id")).agg(F.min(quoted(label_col)).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = {}
    for y in counts:
        some = first_by_hash(known.where(F.col("y") == y), F.xxhash64("id"), params.documents, counts[y]).select("id", F.xxhash64("id").alias("h")).collect()
        chosen |= {r.id: (y, r.h) for r in some}
    net = Network(params)
    parts: list[tuple[int, np.ndarray]] = []
    if chosen:
        text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
        own = docs.where(quoted(id_col).isin(*chosen)).select(quoted(id_col).cast("long").alias("id"), text.alias("text"))
        sizes = {r.id: r.n for r in own.groupBy("id").agg(F.min(F.octet_length("text")).alias("n")).collect()}
        left, taken = {0: params.bytes, 1: params.bytes}, []
        for i in sorted(sizes, key=lambda i: (chosen[i][1], i)):
            if sizes[i] <= left[chosen[i][0]]:
                left[chosen[i][0]] -= sizes[i]
                taken.append(i)
        if taken:
            smallest = F.min(F.struct(F.octet_length("text").alias("n"), F.encode("text", "utf-8").alias("raw")))
            fits = own.where(F.col("id").isin(*taken)).groupBy("id").agg(smallest.alias("t")).select("id", "t.raw")
            parts = [(r.id, chunks_of(bytes(r.raw))) for r in sorted(fits.collect(), key=lambda r: r.id)]
    chunks = np.concatenate([np.zeros((0, CHUNK), np.uint8), *(c for _, c in parts)])
    net.fit(chunks, np.repeat(np.arange(len(parts)), [len(c) for _, c in parts]), np.array([chosen[i][0] for i, _ in parts], np.int64), params)
    return net


def score_quality(df: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold). Only the text is read for them.

    A null text is scored as an empty one, and an empty one as blank chunks. Texts of any length are scored whole, in
    chunks. Other columns pass through, those with the two names are replaced; repeated rows get equal scores; an empty
    table gives an empty one. The network is of fixed size, whatever the data.
    """
    tune(df.sparkSession)

    @F.arrow_udf("score double, predicted int")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            data, offsets = utf8(t)
            found = [network.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans(offsets)]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], ["score", "predicted"])

    return with_made(df, score(quoted(text_col).cast("string")), ["score", "predicted"])
