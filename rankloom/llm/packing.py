"""Packing into padded batches: optimal length buckets from a global histogram, token-budget batches in each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, space_runs, spans, tune, utf8

#: Documents that one group of a bucket holds in the mean: batches are numbered within groups.
GROUP = 20_000


def word_count(text: Column) -> Column:
    """Runs of other characters than [\\x20\\x09-\\x0D]; 0 for null."""

    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            data, offsets = utf8(t)
            out = []
            for a, b in spans(offsets):
                own = offsets[a : b + 1] - offsets[a]
                starts = space_runs(data[offsets[a] : offsets[b]], own)[0]
                out.append(np.diff(np.searchsorted(starts, own)))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.int64())

    return count(text.cast("string"))


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding, over all distinct lengths in ascending order.

    A bucket pads its documents to the largest length in it. Dynamic programming in whole numbers: best[k][j], the least
    padded size of the first j lengths in at most k buckets, is the least best[k-1][i] + lengths[j] * (documents of the
    lengths i to j). That cost is monotone (the best i never falls as j grows), so each of the `buckets` rounds divides and
    conquers in about m log m steps for m lengths. Ties go to fewer buckets, then to the smallest i.
    """
    m = len(lengths)
    if not m:
        return []
    top, docs = lengths.astype(np.int64), np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = np.concatenate([[0], top * docs[1:]])  # one bucket
    back = [np.zeros(m + 1, np.int64)]
    for _ in range(min(buckets, m) - 1):
        now, by = _round(best, top, docs)
        if now[m] == best[m]:
            break
        back.append(by)
        best = now
    bounds, j = [], m
    for by in back[::-1]:
        if j:
            bounds.append(int(top[j - 1]))
            j = int(by[j])
    return bounds[::-1]


def _round(best: np.ndarray, top: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the new values and where they come from; all middles of a depth at once."""
    m = len(top)
    now, by = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    lo, hi, first, last = np.array([1]), np.array([m]), np.array([0]), np.array([m - 1])  # j from lo to hi, i from first to last
    while len(lo):
        mid = (lo + hi) // 2
        stop = np.minimum(last, mid - 1)
        n = stop - first + 1
        at = np.concatenate([[0], np.cumsum(n)])
        i = np.arange(at[-1]) + np.repeat(first - at[:-1], n)
        j = np.repeat(mid, n)
        cost = best[i] + top[j - 1] * (docs[j] - docs[i])
        now[mid] = np.minimum.reduceat(cost, at[:-1])
        by[mid] = np.minimum.reduceat(np.where(cost == now[j], i, m), at[:-1])
        left, right = lo < mid, mid < hi
        lo, hi, first, last = (
            np.concatenate([lo[left], mid[right] + 1]), np.concatenate([mid[left] - 1, hi[right]]),
            np.concatenate([first[left], by[mid[right]]]), np.concatenate([by[mid[left]], last[right]]),
        )
    return now, by


def pack(df: DataFrame, length: Column, buckets: int = 16, budget: int = 8192, id_col: str = "doc_id") -> DataFrame:
    """df with n_tokens, bucket (from 0), bucket_len, batch_id (string), slot (from 0) and batch_docs.

    A batch has room for batch_docs = max(1, budget // bucket_len) documents of one bucket, padded to bucket_len: up to
    `budget` tokens, or one longer document by itself. Batches fill in the order of a hash of the id, then the id, in
    groups of a bucket that hold about GROUP documents: only the last batch of a group may have room left. Bucket bounds
    minimise padding over the histogram of all documents, which is aggregated before it moves; the driver gets a row for
    each distinct length, so never more than the longest text has tokens.

    A null length is 0; documents of no tokens cost nothing. A null id sorts first. Repeated rows each take a slot. An
    empty table gives an empty one. Other columns pass through; those with the six new names are replaced. df is read
    twice: give it a narrow one, with lengths rather than texts.
    """
    tune(df.sparkSession)
    new = ("n_tokens", "bucket", "bucket_len", "batch_id", "slot", "batch_docs")
    kept = [c for c in df.columns if c.lower() not in new]
    own, length_name = fresh(df, "state", "n_tokens")
    rows = df.select(*[quoted(c) for c in kept], F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias(length_name))
    n_tokens = F.col(length_name)
    hist = np.array([tuple(h) for h in rows.groupBy(n_tokens.alias("n")).agg(F.count("*").alias("docs")).collect()], np.int64).reshape(-1, 2)
    hist = hist[np.argsort(hist[:, 0])]
    bounds = optimal_buckets(hist[:, 0], hist[:, 1], buckets)
    sizes = np.bincount(np.searchsorted(bounds, hist[:, 0]), hist[:, 1], len(bounds)) if bounds else []
    groups = [max(1, -(-int(s) // GROUP)) for s in sizes]
    per = [max(1, budget // max(b, 1)) for b in bounds]

    def of(values: list[int], bucket: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values or [0]]), bucket + 1)

    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), lambda b: b < n_tokens))
    key = quoted(id_col) if id_col in kept else F.lit(None)
    rows = rows.withColumn(own, F.struct(bucket.cast("int").alias("bucket"), F.xxhash64(key.cast("string")).alias("h")))
    at = F.col(own)
    rows = rows.withColumn(own, F.struct(at["bucket"].alias("bucket"), at["h"].alias("h"), F.pmod(at["h"], of(groups, at["bucket"])).alias("group")))
    place = F.row_number().over(Window.partitionBy(at["bucket"], at["group"]).orderBy(at["h"], key, n_tokens)) - 1
    rows = rows.withColumn(own, F.struct(at["bucket"].alias("bucket"), at["group"].alias("group"), place.alias("place"), of(per, at["bucket"]).alias("per")))
    number = F.floor(at["place"] / at["per"]).cast("long")
    return rows.select(
        *[quoted(c) for c in kept], n_tokens.alias("n_tokens"), at["bucket"].alias("bucket"), of(bounds, at["bucket"]).alias("bucket_len"),
        F.concat_ws("-", at["bucket"], at["group"], number).alias("batch_id"), (at["place"] % at["per"]).cast("int").alias("slot"), at["per"].cast("int").alias("batch_docs"),
    )
