"""What the operators share: shared tables, Arrow batches, grouping, hashing of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in an Arrow batch; a batch is held by one Python worker at a time.
TEXT_ROWS = 500
#: Bytes of text that the numpy passes take at once.
SLICE_BYTES = 1 << 18


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by rows and by bytes; the same for all operators, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session, and a cluster's session is refused: its executors
    would write where no other can read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rankloom_path = path
    return out


def table_at(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, which reads source only, as the one to drop source by."""
    df._rankloom_path = getattr(source, "_rankloom_path", None)
    return df


def drop_table(*tables: DataFrame) -> None:
    """Removes tables of write_table() that nothing reads any more."""
    for df in tables:
        path, spark = getattr(df, "_rankloom_path", None), df.sparkSession
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def with_made(df: DataFrame, made: Column, names: list[str], replace: dict[str, Column | str] | None = None) -> DataFrame:
    """df with the fields `names` of a struct column, which replace columns of df with these names (in any case of letters).

    replace: columns of df to give another value, by the name of a field. The struct is computed once.
    """
    gone, swap = {n.lower() for n in names}, replace or {}
    kept = [c for c in df.columns if c.lower() not in gone]
    (own,) = fresh(df, "made")
    rows = df.select(*[quoted(c) for c in kept], made.alias(own))
    return rows.select(*[F.col(own)[swap[c]].alias(c) if c in swap else quoted(c) for c in kept], *(F.col(own)[n].alias(n) for n in names))


def quoted(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def first_by_hash(df: DataFrame, h: Column, n: int, count: int) -> DataFrame:
    """The n rows of count that come first by a 64-bit hash folded to 40 bits, then by the hash itself.

    Rows over four times the expected bound go before the sort, so that tasks do not each send n rows to the driver. Were
    fewer than n left under the bound, which has odds of e^-n, the sample would be smaller.
    """
    folded = F.pmod(h, F.lit(1 << 40))
    bound = 1 << 40 if count <= 4 * n else (4 * n << 40) // count
    return df.where(folded < bound).orderBy(folded, h).limit(n)


# -- grouping ---------------------------------------------------------------


def grouped_arrow(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn on each group of keys, groups streamed from sorted partitions; one group at a time is in memory.

    For many small groups: no start-up cost per group. The caller bounds the size of a group.
    """

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            cuts = group_starts(table, keys)
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield from fn(table.slice(a, b - a))
            # The rest is copied, else it would keep all earlier batches alive.
            rest = pa.Table.from_batches(table.slice(cuts[-1]).to_batches()).take(pa.array(np.arange(table.num_rows - cuts[-1]))).combine_chunks().to_batches()
        if rest:
            yield from fn(pa.Table.from_batches(rest))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new group begins in a table sorted by integer keys; the last entry is the start of the last group."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


# -- bytes of text ----------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to limit bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = randoms(11, 256)
#: Two odd bases, and a table of bytes for each: together they make 128-bit hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = (_BYTE, randoms(13, 256))
_POW: dict[int, list[np.ndarray]] = {}


def powers(n: int, base: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if base not in _POW or len(_POW[base][0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[base] = out
    return _POW[base]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of data[starts:ends], equal for equal bytes wherever they stand; which: of two independent ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(data) + 1, BASES[which])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def space_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of rows of bytes start and end; a word ends with its row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z lower-cased, and the rows' offsets among them. Words: [^\\x20\\x09-\\x0D]+."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = space_runs(data, offsets)
    return range_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def texts_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's word hashes, in order; long texts go in parts that end at white space."""
    data, offsets = utf8(column)
    for a, b in spans(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b == a + 1 and hi - lo > 2 * SLICE_BYTES:
            part, parts = lo, []
            while part < hi:
                stop = min(part + SLICE_BYTES, hi)
                if stop < hi:
                    near = np.flatnonzero(_SPACE[data[part:stop]])
                    if len(near):
                        stop = part + int(near[-1]) + 1
                    else:
                        later = np.flatnonzero(_SPACE[data[stop:hi]])
                        stop = stop + int(later[0]) + 1 if len(later) else hi
                parts.append(word_hashes(data[part:stop], np.array([0, stop - part]))[0])
                part = stop
            yield np.concatenate(parts)
            continue
        words, at = word_hashes(data[lo:hi], offsets[a : b + 1] - lo)
        for i in range(b - a):
            yield words[at[i] : at[i + 1]]


_PLACE = randoms(12, 64) | np.uint64(1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of size words; of fewer words, the one of them all; without words none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += mix(words[j : n - k + 1 + j] ^ _PLACE[j % 64]) * _PLACE[(j + 17) % 64]
    total = mix(total ^ np.uint64(k))
    total.sort()
    new = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
