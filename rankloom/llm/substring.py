"""Substring deduplication: content-defined chunks by a gear rolling hash; repeated chunks are removed by digest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, batch, drop_table, fresh, quoted, randoms, range_hashes, tune, utf8, with_made, write_table

#: Bytes that the rolling hash looks back on: bit k of the gear value depends on the last k + 1 bytes only.
WINDOW = 16
_GEAR = (randoms(31, 256) & np.uint64(0xFFFF)).astype(np.uint16)


@dataclass(frozen=True)
class Chunking:
    """A byte is a cut candidate if its 16-bit gear value is under `below`, or if none of the `reach` bytes before and after
    it has a smaller one: text that repeats with a period and has no value under `below` is cut in every period. Of
    candidates, the first is a cut and then the next that is `gap` bytes or more after the last cut: two copies of a text
    fall in step where candidates are so far apart, so chunks resist shifts from insertions. In the mean a chunk has about
    33 bytes. A run of repeated chunks is removed if it has at least `run` bytes."""

    below: int = 1 << 12
    gap: int = 16
    run: int = 100
    reach: int = 64


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling value h = (h << 1) + G[byte], modulo 2^16, after each byte; by doubling, without a loop over bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def _values(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The gear value that decides on a cut before each of the bytes a to b; the greatest where a character continues."""
    lo = max(0, a - WINDOW)
    h = gear(data[lo : b - 1])[a - 1 - lo :]
    return np.where((data[a:b] & 0xC0) != 0x80, h, np.uint16(0xFFFF))


def _minima(data: np.ndarray, a: int, b: int, reach: int) -> np.ndarray:
    """Places from a to b whose value is the least of the reach places before and after them, all of which exist."""
    found = []
    for lo in range(max(a, WINDOW + reach), min(b, len(data) - reach), SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, b, len(data) - reach)
        v = _values(data, lo - reach, hi + reach)
        least, span = v, 1
        while span < 2 * reach + 1:  # the least of the span values from each place on, by doubling
            step = min(span, 2 * reach + 1 - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        found.append(np.flatnonzero((v[reach:-reach] == least) & (least < 0xFFFF)) + lo)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: np.ndarray, c: Chunking) -> np.ndarray:
    """Ends of the chunks of one text, the text's end included; a cut never parts a UTF-8 character."""
    if len(data) <= WINDOW:
        return np.array([len(data)] if len(data) else [], np.int64)
    at = np.concatenate([np.flatnonzero(_values(data, a, min(a + SLICE_BYTES, len(data))) < c.below) + a for a in range(WINDOW, len(data), SLICE_BYTES)])
    edges = np.concatenate([[WINDOW - 1], at, [len(data)]])
    wide = np.flatnonzero(np.diff(edges) > c.reach)  # no place nearer to a candidate than reach is a minimum
    more = [m for i in wide if len(m := _minima(data, int(edges[i]) + 1, int(edges[i + 1]), c.reach))]
    if more:
        at = np.sort(np.concatenate([at, *more]))
    kept, last = [], -c.gap
    for x in at.tolist():
        if x - last >= c.gap:
            kept.append(x)
            last = x
    return np.array([*kept, len(data)], np.int64)


def chunks(data: np.ndarray, c: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Ends and 128-bit digests (n, 2) of a text's chunks. A text over a slice is taken in slices."""
    ends = cuts(data, c)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out, i = [np.zeros((0, 2), np.uint64)], 0
    while i < len(ends):
        j = len(ends) if len(data) <= 2 * SLICE_BYTES else max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        part, a, b = data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]
        out.append(np.stack([range_hashes(part, a, b, which) for which in (0, 1)], axis=1))
        i = j
    return ends, np.concatenate(out)


def removed_runs(ends: np.ndarray, repeated: np.ndarray, run: int) -> list[tuple[int, int]]:
    """Byte spans of the runs of repeated chunks with at least run bytes."""
    if not repeated.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    starts = np.concatenate([[0], ends[:-1]])
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2]) if ends[b - 1] - starts[a] >= run]


def _texts(column) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for i in range(len(offsets) - 1):
        yield data[offsets[i] : offsets[i + 1]]


def _digests(c: Chunking):
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for rows in batches:
            ids, digests = [], []
            for i, data in zip(rows.column(0).to_numpy(), _texts(rows.column(1))):
                d = chunks(data, c)[1].view(np.int64)
                d = d[np.unique(d[:, 0], return_index=True)[1]]
                digests.append(d)
                ids.append(np.full(len(d), i))
            if digests:
                d = np.concatenate(digests)
                yield batch(schema, d[:, 0], d[:, 1], np.concatenate(ids))

    return run


def deduplicate_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """df with its text shortened, and n_chunks, n_removed, removed_chars and removed_spans (characters, in the old text).

    Of equal chunks the one in the smallest id stays, in it the first. Runs of other chunks with at least chunking.run
    bytes are removed; shorter ones stay, so common words are left alone. Texts are read whole. Chunks are equal if two
    independent 64-bit digests are, 128 bits in all; within one text one of them tells chunks apart.

    A null text stays null and an empty one empty. A row with a null id is neither changed nor compared. Rows that share
    an id are compared as one document: what one repeats of another of them stays. An empty table gives an empty one.
    Other columns, of any name, pass through; those with the four new names are replaced.

    Plan: (digest, id) pairs are aggregated to the smallest id, with map-side combination, and only digests of several
    ids go on. The pairs meet these in an equi-join that the skew join can split where a chunk is very common, and are
    gathered by document: a document's own chunks at most. Last the texts meet their lists in one join on the id.
    """
    tune(df.sparkSession)
    made = ("n_chunks", "n_removed", "removed_chars", "removed_spans")
    rows = df.select(*[quoted(c) for c in df.columns if c.lower() not in made])
    id_, text_ = quoted(id_col).cast("long"), quoted(text_col).cast("string")
    pairs = rows.where(quoted(id_col).isNotNull() & quoted(text_col).isNotNull()).select(id_.alias("id"), text_.alias("text")).mapInArrow(_digests(chunking), "high long, low long, id long")
    shared = pairs.groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("high", "low", "first")
    shared = write_table(shared, "chunks")
    own_id, own_list = fresh(df, "id", "list")
    lists = pairs.join(shared, ["high", "low"]).where("id <> first").groupBy(F.col("id").alias(own_id)).agg(F.collect_set("high").alias(own_list))
    lists = write_table(lists, "lists")
    drop_table(shared)

    @F.arrow_udf("text string, n_chunks long, n_removed long, removed_chars long, removed_spans array<struct<start: long, stop: long>>")
    def clean(texts: pa.Array, ids: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        lists_at = list_values(digests)
        for i, (text, known) in enumerate(zip(_texts(texts), ids.is_valid().to_pylist())):
            if not texts[i].is_valid or not known:
                out.append((texts[i].as_py(), 0, 0, 0, []))
                continue
            ends, own = chunks(text, chunking)
            own = own[:, 0].view(np.int64)
            again = np.ones(len(own), bool)
            again[np.unique(own, return_index=True)[1]] = False
            gone = lists_at(i)
            if len(gone):
                again |= np.isin(own, gone)
            spans_ = removed_runs(ends, again, chunking.run)
            if not spans_:
                out.append((texts[i].as_py(), len(ends), 0, 0, []))
                continue
            lead = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])  # characters before each byte
            stay = np.ones(len(text), bool)
            for a, b in spans_:
                stay[a:b] = False
            chars = [(int(lead[a]), int(lead[b])) for a, b in spans_]
            starts = np.concatenate([[0], ends[:-1]])
            n = sum(int(((starts >= a) & (ends <= b)).sum()) for a, b in spans_)
            out.append((text[stay].tobytes().decode("utf-8", "replace"), len(ends), n, sum(b - a for a, b in chars), [{"start": a, "stop": b} for a, b in chars]))
        kinds = [("text", pa.string()), ("n_chunks", pa.int64()), ("n_removed", pa.int64()), ("removed_chars", pa.int64()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    joined = rows.withColumn(own_id, id_).join(lists, own_id, "left")
    out = with_made(joined, clean(text_, own_id, own_list), list(made), {text_col: "text"})
    return out.drop(own_id, own_list)


def list_values(column: pa.Array):
    """Access to the entries of a list column as numpy arrays; null is empty."""
    if pa.types.is_null(column.type):
        return lambda i: np.zeros(0, np.int64)
    values, offsets, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return lambda i: values[offsets[i] : offsets[i + 1]] if valid[i] else values[:0]
