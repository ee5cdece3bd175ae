"""Near-duplicate texts: MinHash signatures joined by multi-index Hamming search, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_table, grouped_arrow, mix, randoms, shingle_set, texts_words, tune, utf8, write_table
from .components import connected_components

#: Rows of a block where a bucket's rows are compared by signatures, and a cluster's by full sets of SETS shingles in all.
BLOCK, SET_BLOCK, SETS = 512, 96, 1 << 20


@dataclass(frozen=True)
class HammingIndex:
    """A signature of `symbols` b-bit (16) MinHash values, split into `chunks`; one wrong symbol is allowed in each chunk.

    By the pigeonhole principle two signatures that differ in at most 2 * chunks - 1 symbols have a chunk with at most one
    difference, so they agree on one of that chunk's keys that leave one symbol out: all pairs within `reach` share a key,
    and all pairs within `reach` go on to the full sets. With 96 symbols in 20 chunks the reach is 39; a pair of similarity
    0.8 differs in 19.2 symbols in the mean (standard deviation 3.9) and is beyond the reach in one case of a million.
    """

    symbols: int = 96
    chunks: int = 20

    @property
    def reach(self) -> int:
        return 2 * self.chunks - 1

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(rows, symbols) uint16 to as many 64-bit keys a row: each leaves one symbol out of its chunk."""
        salt = randoms(22, self.symbols)
        parts = mix(signatures.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ salt)
        out = np.empty(parts.shape, np.uint64)
        for k, chunk in enumerate(np.array_split(np.arange(self.symbols), self.chunks)):
            total = parts[:, chunk].sum(axis=1, dtype=np.uint64)
            for j in chunk:
                out[:, j] = mix(total - parts[:, j] ^ salt[j] + np.uint64(k))
        return out


_MUL, _XOR = randoms(20, 256) | np.uint64(1), randoms(21, 256)


def minhash(items: np.ndarray, symbols: int) -> np.ndarray:
    """b-bit MinHash of a non-empty set of hashes: the low 16 bits of each mixed minimum."""
    low = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), 512):
        x = items[a : a + 512][None, :] ^ _XOR[:symbols, None]
        x *= _MUL[:symbols, None]
        np.minimum(low, x.min(axis=1), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2")


def _signatures(shingle: int, index: HammingIndex):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for rows in batches:
            n, cls, sig = [], [], []
            for words in texts_words(rows.column(1)):
                items = shingle_set(words, shingle)
                n.append(len(items))
                cls.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                sig.append(minhash(items, index.symbols).tobytes() if len(items) else None)
            yield batch(schema, rows.column(0), n, cls, sig)

    return run


def _key_rows(index: HammingIndex):
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                sig = utf8(rows.column(1))[0].view("<u2").reshape(rows.num_rows, -1)
                yield batch(schema, index.keys(sig).view(np.int64).ravel(), np.repeat(rows.column(0).to_numpy(), index.symbols))

    return run


def _symbols(column) -> np.ndarray:
    return utf8(column)[0].view("<u2").reshape(len(column), -1)


def _close(index: HammingIndex):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                near = np.flatnonzero((_symbols(rows.column(2)) != _symbols(rows.column(3))).sum(axis=1) <= index.reach)
                yield batch(schema, rows.column(0).to_numpy()[near], rows.column(1).to_numpy()[near])

    return run


def _sets(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for rows in batches:
            yield batch(schema, rows.column(0), [shingle_set(words, shingle).tobytes() for words in texts_words(rows.column(1))])

    return run


def _confirmed(part: int, whole: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            (x, xo), (y, yo) = (utf8(rows.column(i)) for i in (2, 3))
            keep = []
            for i in range(rows.num_rows):
                p, q = x[xo[i] : xo[i + 1]].view(np.uint64), y[yo[i] : yo[i + 1]].view(np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(whole * common >= part * (len(both) - common))
            keep = np.flatnonzero(keep)
            yield batch(schema, rows.column(0).to_numpy()[keep], rows.column(1).to_numpy()[keep])

    return run


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, its smallest reachable row) that connect what the matrix near (left x right) connects."""
    label = np.arange(size)
    touched = np.zeros(size, bool)
    touched[left] = near.any(axis=1)
    touched[right] |= near.any(axis=0)
    while touched.any():
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(near, label[right][None, :], size).min(axis=1))
        label[right] = np.minimum(label[right], np.where(near, label[left][:, None], size).min(axis=0))
        if (before == label).all():
            break
    rows = np.flatnonzero(label != np.arange(size))
    return rows, label[rows]


def _sizes_allow(n: np.ndarray, left: np.ndarray, right: np.ndarray, part: int, whole: int) -> np.ndarray:
    return whole * np.minimum(n[left][:, None], n[right][None, :]) >= part * np.maximum(n[left][:, None], n[right][None, :])


def _components_met(near: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links between the components that the matrix near connects, as many as span them."""
    i, j = _spanning(near, left, right, len(comp))
    links = np.unique(np.stack([comp[i], comp[j]]), axis=1)
    links = links[:, links[0] != links[1]]
    if links.size:
        yield batch(pa.schema([("a", pa.int64()), ("b", pa.int64())]), links[0], links[1])


def _cross(index: HammingIndex, part: int, whole: int):
    """Which components have close pairs in a block of a bucket and a block of its rows outside the main component."""

    def fn(table: pa.Table):
        comp, other, n = (table.column(k).to_numpy() for k in ("comp", "other", "n_shingles"))
        sig = _symbols(table.column("sig"))
        left, right = np.flatnonzero(other == 0), np.flatnonzero(other == 1)
        near = (comp[left][:, None] != comp[right][None, :]) & _sizes_allow(n, left, right, part, whole)
        for k in range(0, len(left), 16):
            near[k : k + 16] &= (sig[left[k : k + 16]][:, None, :] != sig[right][None, :, :]).sum(axis=2) <= index.reach
        yield from _components_met(near, left, right, comp)

    return fn


def _exact(part: int, whole: int):
    """Which components have linked pairs in a block of a cluster and a block of its rows outside the main one, by full sets."""

    def fn(table: pa.Table):
        rep, other, comp = (table.column(k).to_numpy() for k in ("rep", "other", "comp"))
        data, offsets = utf8(table.column("items"))
        items, n = data.view(np.uint64), np.diff(offsets) // 8
        owner = np.repeat(np.arange(len(rep)), n)
        order = np.argsort(items, kind="stable")
        owner, new = owner[order], np.concatenate([[True], np.diff(items[order]) != 0]) if len(items) else np.zeros(0, bool)
        column = np.cumsum(new) - 1
        left, right = np.flatnonzero(other == 0), np.flatnonzero(other == 1)
        common = np.zeros((len(left), len(right)))
        place = np.zeros(len(rep), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [c, c + 4096])
            x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            o, k = owner[lo:hi], column[lo:hi] - c
            x[place[o[other[o] == 0]], k[other[o] == 0]] = 1
            y[place[o[other[o] == 1]], k[other[o] == 1]] = 1
            common += x @ y.T
        near = whole * common >= part * (n[left][:, None] + n[right][None, :] - common)
        near &= comp[left][:, None] != comp[right][None, :]
        yield from _components_met(near, left, right, comp)

    return fn


def _blocks(rows: DataFrame, group: str, block: int, weight: str | None = None) -> DataFrame:
    """For the groups of rows (group, rep, comp, ...) that hold several components: the largest component, and into how many
    blocks all rows and those outside it go. Blocks hold about `block` rows, and `SETS` of weight."""
    w = F.sum(F.col(weight) if weight else F.lit(0))
    sizes = rows.groupBy(group, "comp").agg(F.count("*").alias("c"), w.alias("w"))
    mixed = sizes.groupBy(group).agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("main")).where("k > 1")
    per = F.greatest(F.lit(1.0), F.lit(float(block)) if weight is None else F.least(F.lit(float(block)), F.lit(float(SETS)) * F.col("c") / F.greatest("w", F.lit(1))))
    return mixed.select(group, F.col("main.comp").alias("main"), F.ceil(F.col("c") / per).cast("long").alias("nb"), F.ceil((F.col("c") - F.col("main.c")) / per).cast("long").alias("ob"))


def _dealt(rows: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """rows of the groups in blocks as (group, i, j, other, ...): every row, in blocks, meets the blocks of the rows outside
    the group's largest component (other = 1)."""
    met = rows.join(blocks, group).withColumn("h", F.xxhash64("rep"))
    zero = F.lit(0).cast("long")
    every = F.transform(F.sequence(zero, F.col("ob") - 1), lambda j: F.struct(F.pmod("h", "nb").alias("i"), j.alias("j"), F.lit(0).alias("other")))
    outer = F.transform(F.sequence(zero, F.col("nb") - 1), lambda i: F.struct(i.alias("i"), F.pmod("h", "ob").alias("j"), F.lit(1).alias("other")))
    places = F.when(F.col("comp") != F.col("main"), F.concat(every, outer)).otherwise(every)
    return met.withColumn("at", F.explode(places)).select(*rows.columns, "at.*")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, part: int = 80, whole: int = 100, index: HammingIndex = HammingIndex()) -> DataFrame:
    """Components of texts whose shingle sets satisfy whole * intersection >= part * union.

    Returns a row for each row: id_col, n_shingles, component_id (the smallest id reachable), kept (id = component_id).

    Nulls: a null text is empty. Texts without words link with nothing and stay. A row with a null id links with nothing,
    has a null component and stays. Rows that share an id and a text have one result; of rows that share an id but not a
    text each takes the component of its own text, and texts with one smallest id count as one. Equal sets are one class,
    so copies and ties cost one row each. An empty table gives an empty result. Other columns are not read. Texts may be
    of any length; A-Z is lower-cased, words are [^\\x20\\x09-\\x0D]+. Sets hold 64-bit hashes of shingles.

    Plan: (1) one pass over the texts for signatures, written to the shared folder; (2) a class for each distinct set;
    (3) keys of the multi-index; each row of a bucket is paired with the bucket's smallest id only; (4) pairs within the
    reach are confirmed on full sets, and their components are found once; (5) where several components meet in a bucket,
    its rows outside the largest one meet all its rows, and components with a pair within the reach form clusters: all
    pairs that share a key and are within the reach are now in one component or in one cluster; (6) in a cluster, which
    no row has two of, the rows outside the largest component meet all others by full sets, and components with a linked
    pair are united. So all pairs within the reach are decided on full sets.

    Rows meet in blocks of BLOCK (SET_BLOCK) rows, and blocks return the components that they connect, never pairs.
    A block's rows go to each block that they meet: in a group whose largest component leaves out m of its n rows, n * m
    comparisons are made, and n * m / BLOCK rows move. No group is cut. Where no bucket holds several components steps
    (5) and (6) end at once.
    """
    spark = df.sparkSession
    tune(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = write_table(docs.mapInArrow(_signatures(shingle, index), "id long, n_shingles long, cls binary, sig binary"), "signatures")
    reps = write_table(sig.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sig")]), "classes")
    keys = reps.select("rep", "sig").mapInArrow(_key_rows(index), "key long, rep long")
    multi = write_table(keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count("*").alias("n")).where("head <> last"), "buckets")
    members = write_table(keys.join(multi.select("key", "head", "n"), "key").select("key", "rep", "head", "n"), "members")

    own = reps.select("rep", "n_shingles", "sig")
    stars = members.where("rep <> head").groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.lit(1)).select("a", "b")
    stars = stars.join(own.toDF("a", "m", "x"), "a").join(own.toDF("b", "n", "y"), "b").where(f"{whole} * least(m, n) >= {part} * greatest(m, n)")
    pairs = write_table(stars.select("a", "b", "x", "y").mapInArrow(_close(index), "a long, b long"), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        # the ids grow with the corpus, so they are never sent to all tasks: texts and ids meet by id at every size
        return write_table(docs.join(ids.toDF("id").hint("merge"), "id", "left_semi").mapInArrow(_sets(shingle), "id long, items binary").toDF("rep", "items"), "sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b"))))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    comp = connected_components(both.mapInArrow(_confirmed(part, whole), "a long, b long"), "components").withColumnRenamed("node", "rep")
    labelled = write_table(members.where("n > 2").join(comp, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")), "labelled")
    blocks = write_table(_blocks(labelled, "key", BLOCK), "blocks")
    drop_table(multi, members, pairs)
    united = None
    if not blocks.isEmpty():
        work = _dealt(labelled, blocks, "key").join(own, "rep")
        near = connected_components(grouped_arrow(work, ["key", "i", "j"], _cross(index, part, whole), "a long, b long"), "near")
        if not near.isEmpty():
            united = _united(near.toDF("comp", "cluster"), comp, reps, sets, sets_of, part, whole)
        drop_table(near)
    drop_table(labelled, blocks, sets)
    classes = reps.select("cls", "rep").join(comp, "rep", "left").select("cls", F.coalesce("component", "rep").alias("c"))
    if united is not None:
        classes = classes.join(united.toDF("c", "into"), "c", "left").select("cls", F.coalesce("into", "c").alias("c"))
    out = sig.select("id", "n_shingles", "cls").join(classes, "cls", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _united(near: DataFrame, comp: DataFrame, reps: DataFrame, sets: DataFrame, sets_of, part: int, whole: int) -> DataFrame:
    """(component, the component that it goes into), from clusters (comp, cluster) of components, by full sets.

    sets: those that are there already; the texts are read again for the others only.
    """
    clusters = near.unionByName(near.select(F.col("cluster").alias("comp"), "cluster").distinct())
    rest = comp.join(clusters, F.col("component") == F.col("comp")).select("rep", "comp", "cluster")
    members = clusters.select(F.col("comp").alias("rep"), "comp", "cluster").unionByName(rest)
    within = write_table(members.join(reps.select("rep", "n_shingles"), "rep"), "within")
    more = sets_of(within.select("rep").join(sets.select("rep"), "rep", "left_anti"))
    blocks = write_table(_blocks(within, "cluster", SET_BLOCK, "n_shingles"), "blocks")
    work = _dealt(within.drop("n_shingles"), blocks, "cluster").join(sets.unionByName(more), "rep")
    out = connected_components(grouped_arrow(work, ["cluster", "i", "j"], _exact(part, whole), "a long, b long"), "united")
    drop_table(within, more, blocks)
    return out
