"""Exact deduplication against a minimal perfect hash of the distinct digests seen before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_table, fresh, grouped_arrow, mix, quoted, randoms, tune, utf8, write_table

#: Digests that one bucket of the index holds in the mean: a bucket is built and probed by one task at a time.
BUCKET = 4096
_LEVEL = randoms(61, 64)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall on a level: (n, 4) words of SHA-256 digests to [0, size)."""
    return (mix(words[:, level % 4] ^ mix(words[:, (level + 1) % 4] + _LEVEL[level % 64] + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def build_mph(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and bits of a minimal perfect hash of distinct digests, by levels of collision-free bits.

    On each level the keys that fall alone set a bit; the others go on to the next. The slot of a key is the number of
    set bits before its own, so the slots of n keys are 0 to n - 1.
    """
    sizes, bits, level = [], [], 0
    while len(words):
        size = max(64, 2 * len(words))
        at = _positions(words, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        words = words[~alone[at]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def lookup_mph(sizes: np.ndarray, bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Slots of keys; -1 where no level has a bit. A key that was not built in may get any slot: compare the digest."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    slots, base = np.full(len(words), -1, np.int64), 0
    todo = np.arange(len(words))
    for level, size in enumerate(sizes):
        at = _positions(words[todo], level, int(size)) + base
        hit = bits[at]
        slots[todo[hit]] = rank[at[hit]]
        todo = todo[~hit]
        base += int(size)
    return slots


_INDEX = "bucket long, sizes binary, bits binary, n_bits long, digests binary, winners binary, counts binary"


def _words(column) -> np.ndarray:
    return utf8(column)[0].view("<u8").reshape(-1, 4)


def _build(table: pa.Table):
    words = _words(table.column("digest"))
    sizes, bits = build_mph(words)
    slots = lookup_mph(sizes, bits, words)
    order = np.argsort(slots)
    schema = pa.schema([("bucket", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("n_bits", pa.int64()), ("digests", pa.binary()), ("winners", pa.binary()), ("counts", pa.binary())])
    winner, count = (table.column(k).to_numpy()[order].astype("<i8") for k in ("winner", "n"))
    yield batch(schema, [table.column("bucket")[0].as_py()], [sizes.tobytes()], [np.packbits(bits).tobytes()], [len(bits)], [words[order].tobytes()], [winner.tobytes()], [count.tobytes()])


def _probe(table: pa.Table):
    """A bucket's new digests, and its index row if there is one: each digest with what history holds of it."""
    is_index = table.column("is_index").to_numpy() == 1
    new = table.filter(pa.array(~is_index))
    if not new.num_rows:
        return
    schema = pa.schema([("digest", pa.binary()), ("winner", pa.int64()), ("n", pa.int64()), ("member", pa.bool_())])
    winner, n = new.column("winner").to_numpy().copy(), new.column("n").to_numpy().copy()
    member = np.zeros(new.num_rows, bool)
    if is_index.any():
        row = table.filter(pa.array(is_index)).slice(0, 1).to_pylist()[0]
        words = _words(new.column("digest"))
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["n_bits"]).astype(bool)
        slots = lookup_mph(np.frombuffer(row["sizes"], np.int64), bits, words)
        stored = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        hit = slots >= 0
        member[hit] = (stored[slots[hit]] == words[hit]).all(axis=1)  # all 32 bytes
        at = slots[member]
        winner[member] = np.maximum(winner[member], np.frombuffer(row["winners"], "<i8")[at])
        n[member] += np.frombuffer(row["counts"], "<i8")[at]
    yield batch(schema, new.column("digest").combine_chunks(), winner, n, member)


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long"))


#: Stands for a null id among winners; ids are above it.
NO_ID = -(1 << 63)


def digests(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, digest, *more): SHA-256 of each text, a null one being empty, and NO_ID for a null id."""
    return df.select(F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID)).alias("id"), _digest(text_col).alias("digest"), *more)


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(quoted(text_col).cast("string"), F.lit("")), 256))


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, winner, n): a row for each distinct text, pre-aggregated before the shuffle."""
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n"))


def build_index(history: DataFrame, buckets: int = 1) -> DataFrame:
    """The index of a history (id, digest): a row for each bucket of digests, with the minimal perfect hash and its slots.

    A slot holds the full digest, the winning id and the number of rows. Buckets hold distinct digests, which spread
    evenly, so none is hot. An empty history gives an empty index.
    """
    return write_table(grouped_arrow(_bucketed(_groups(history), buckets), ["bucket"], _build, _INDEX), "mph")


def probe_index(index: DataFrame, incoming: DataFrame, buckets: int = 1) -> DataFrame:
    """(digest, winner, n, member) for each distinct text of incoming (id, digest); nonmembers are grouped by themselves."""
    none = {c: F.lit(None).cast(t) for c, t in index.dtypes if c != "bucket"}
    new = _bucketed(_groups(incoming), buckets).withColumns(none | {"is_index": F.lit(0)})
    old = index.withColumns({"digest": F.lit(None).cast("binary"), "winner": F.lit(None).cast("long"), "n": F.lit(None).cast("long"), "is_index": F.lit(1)}).select(new.columns)
    return grouped_arrow(new.unionByName(old), ["bucket"], _probe, "digest binary, winner long, n long, member boolean")


def index_groups(index: DataFrame) -> DataFrame:
    """The slots of an index as rows (digest, winner, n)."""

    def run(batches):
        schema = pa.schema([("digest", pa.binary()), ("winner", pa.int64()), ("n", pa.int64())])
        for rows in batches:
            for row in rows.to_pylist():
                d, w, n = row["digests"], np.frombuffer(row["winners"], "<i8"), np.frombuffer(row["counts"], "<i8")
                yield batch(schema, [d[i : i + 32] for i in range(0, len(d), 32)], w, n)

    return index.select("digests", "winners", "counts").mapInArrow(run, "digest binary, winner long, n long")


def exact_groups(rows: DataFrame) -> DataFrame:
    """(digest, winner, n, member) over all rows (id, digest, old): those with old are indexed, the others looked up.

    A digest that only history has comes from its slot; one that both have gets the larger winner and both counts.
    """
    buckets = max(1, rows.count() // BUCKET)
    index = build_index(rows.where("old"), buckets)
    found = write_table(probe_index(index, rows.where("not old"), buckets), "probed")
    only_old = index_groups(index).join(found.where("member").select("digest"), "digest", "left_anti").withColumn("member", F.lit(True))
    out = write_table(found.unionByName(only_old), "groups")
    drop_table(index, found)
    return out


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_history=None) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256: of equal texts the row with the largest id stays.

    is_history: a condition for rows that arrived before; by default those with an id up to the middle of the ids' range.
    It decides which digests are indexed and which looked up, never the result.

    Nulls: a null text equals an empty one. A null id loses to any other; a group without ids keeps all its rows.
    Repeated rows with one id and text are one document: all have the same decision. An empty table gives an empty
    result. Columns of df that bear one of the four names are replaced; others, of any name, pass through.

    Texts are read twice: for a narrow table of ids and digests, from which index, lookups and groups come, and for the
    result. Groups are aggregated before the shuffle; rows then meet their group in an equi-join, where a text that fills
    a third of the rows is split by the skew join.
    """
    tune(df.sparkSession)
    if is_history is None:
        low, high = df.agg(F.min(quoted(id_col).cast("long")), F.max(quoted(id_col).cast("long"))).first()
        is_history = quoted(id_col).cast("long") <= ((low or 0) + (high or 0)) // 2
    rows = write_table(digests(df, id_col, text_col, F.coalesce(is_history, F.lit(False)).alias("old")), "digests")
    made = ("keep_id", "group_size", "kept", "text_sha256")
    kept = [c for c in df.columns if c.lower() not in made]
    own, winner, n = fresh(df, "digest", "winner", "n")
    groups = exact_groups(rows).select(F.col("digest").alias(own), F.col("winner").alias(winner), F.col("n").alias(n))
    drop_table(rows)
    out = df.withColumn(own, _digest(text_col)).join(groups, own)
    keep = F.when(F.col(winner) != NO_ID, F.col(winner))
    return out.select(*map(quoted, kept), keep.alias("keep_id"), F.col(n).alias("group_size"), quoted(id_col).cast("long").eqNullSafe(keep).alias("kept"), F.lower(F.hex(own)).alias("text_sha256"))
