"""Near-duplicate vectors: a forest of random-projection trees with spill, compared within leaves, verified and united."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, first_by_hash, grouped_arrow, quoted, tune, write_table
from .components import connected_components, spanning_stars

#: Vectors of a block where a leaf's vectors are compared with each other, and how many rows of it at once.
BLOCK, STRIP = 4096, 512


@dataclass(frozen=True)
class ForestParams:
    """trees; spill: a vector goes to both children if its projection is within spill of the cut; leaf: vectors a leaf is
    aimed at before spill; per_leaf: sampled vectors for each leaf, from which cuts are learned; sample: of them at most."""

    trees: int = 5
    spill: float = 0.01
    leaf: int = 2048
    per_leaf: int = 32
    sample: int = 1 << 18


class Forest:
    """Cuts of all trees: node k of a level splits by a random direction at the median of its sample.

    The depth grows with the logarithm of the table's rows, and so does the sample with the rows, up to params.sample.
    """

    def __init__(self, sample: np.ndarray, rows: int, params: ForestParams, seed: int = 90):
        self.params, self.dim = params, sample.shape[1]
        depth = max(0, math.ceil(math.log2(max(rows, 1) / params.leaf)))
        self.depth = min(depth, int(math.log2(max(len(sample), 1) / 16)) if len(sample) >= 32 else 0)
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(params.trees):
            rng = np.random.default_rng([seed, t])
            n = (1 << self.depth) - 1
            directions = rng.standard_normal((n, self.dim)).astype(np.float32)
            directions /= np.linalg.norm(directions, axis=1, keepdims=True) + 1e-30
            at, inside = np.zeros(n, np.float32), [np.arange(len(sample))]
            for k in range(n):
                p = sample[inside[k]] @ directions[k]
                at[k] = np.median(p) if len(p) else 0.0
                inside += [inside[k][p <= at[k]], inside[k][p > at[k]]]
                inside[k] = inside[k][:0]
            self.nodes.append((directions, at))

    def leaves(self, x: np.ndarray, trees: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of the first trees (row, leaf) pairs; a row may be in several leaves."""
        out = []
        for directions, at in self.nodes[:trees]:
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x[row], directions[node]) - at[node]
                left, right = p <= self.params.spill, p >= -self.params.spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            out.append((row, node))
        return out


def usable_rows(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(rows, bytes, dims): the usable vectors as they came, by their place in the column.

    Null and zero vectors and those with null or non-finite components are left out; vectors may differ in length.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.values
    dtype = "<f4" if pa.types.is_float32(values.type) else "<f8"
    flat = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype)  # null components become NaN
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    rows, raw, dims = [], [], []
    for i in np.flatnonzero(valid):
        v = flat[offsets[i] : offsets[i + 1]]
        if len(v) and np.isfinite(v).all() and v.any():
            rows.append(i)
            raw.append(v.tobytes())
            dims.append(len(v))
    return np.array(rows, np.int64), raw, np.array(dims, np.int64)


def unit_vectors(raw: list[bytes], dim: int) -> np.ndarray:
    """(n, dim) doubles of length 1, from bytes of floats or doubles."""
    x = np.frombuffer(b"".join(raw), "<f4" if raw and len(raw[0]) == 4 * dim else "<f8").astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepare():
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int64()), ("same", pa.binary()), ("raw", pa.binary())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows, raw, dims = usable_rows(b.column(2))
                at = pa.array(rows)
                yield batch(schema, b.column(0).take(at), b.column(1).take(at), dims, [hashlib.blake2b(v, digest_size=16).digest() for v in raw], raw)

    return run


def _assign(forest: Forest, vectors: bool):
    fields = [("tree", pa.int64()), ("node", pa.int64()), ("key", pa.int64())]
    schema = pa.schema([*fields, ("cls", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("raw", pa.binary())] if vectors else fields)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for t, (row, node) in enumerate(forest.leaves(unit_vectors(b.column("raw").to_pylist(), forest.dim).astype(np.float32))):
                more = [b.column(c).take(pa.array(row)) for c in ("cls", "n", "label", "raw")] if vectors else []
                yield batch(schema, np.full(len(row), t), node, b.column("key").to_numpy()[row], *more)

    return run


def _compare(part: float, forest: Forest):
    """Within a block pair of a leaf: how many vectors each class links with, and links that connect the same classes.

    A pair counts in the first tree where both share a leaf, there in the first such leaf.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def fn(table: pa.Table):
        table = table.take(pa.array(np.argsort(table.column("side").to_numpy(), kind="stable")))
        split = int((table.column("side").to_numpy() == 0).sum())
        tree, leaf = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        label = np.unique(np.array(table.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
        size, same = len(cls), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        x = unit_vectors(table.column("raw").to_pylist(), forest.dim)
        earlier = _earlier(forest, x.astype(np.float32), tree, leaf)
        left, right = np.arange(split), np.arange(split, size) if not same else np.arange(size)
        if not len(right):
            return
        strips = []
        links, root = np.zeros(size, np.int64), np.arange(size)
        for a in range(0, split, STRIP):
            rows = left[a : a + STRIP]
            near = (x[rows] @ x[right].T >= part) & (label[rows][:, None] == label[right][None, :])
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            if earlier is not None and len(i):
                fresh = np.concatenate([(earlier[i[k : k + 65536]] & earlier[j[k : k + 65536]]).sum(axis=1) == 0 for k in range(0, len(i), 65536)])
                i, j = i[fresh], j[fresh]
            i, j = i[i != j], j[i != j]
            links += np.bincount(i, n[j], size).astype(np.int64)
            if not same:
                links += np.bincount(j, n[i], size).astype(np.int64)
            u, v = spanning_stars(i, j)
            strips.append((u, v))
        if strips:
            u, v = spanning_stars(np.concatenate([s[0] for s in strips]), np.concatenate([s[1] for s in strips]))
            root[u] = v
        touched = np.flatnonzero(links)
        if len(touched):
            yield batch(schema, cls[touched], cls[root[touched]], links[touched])

    return fn


def _earlier(forest: Forest, x: np.ndarray, tree: int, leaf: int) -> np.ndarray | None:
    """For each vector, as bits, which of the leaves it is in that come before this one, of those that several are in."""
    owner, name = [], []
    for t, (row, node) in enumerate(forest.leaves(x, tree + 1)):
        before = node < leaf if t == tree else np.ones(len(row), bool)
        owner.append(row[before])
        name.append(node[before] + (t << 40))
    owner, name = np.concatenate(owner), np.concatenate(name)
    kinds, at, count = np.unique(name, return_inverse=True, return_counts=True)
    shared = count > 1
    if not shared.any():
        return None
    column = np.cumsum(shared) - 1
    keep = shared[at]
    bits = np.zeros((len(x), -(-int(shared.sum()) // 8)), np.uint8)
    np.bitwise_or.at(bits, (owner[keep], column[at[keep]] // 8), (1 << (column[at[keep]] % 8)).astype(np.uint8))
    return bits


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, params: ForestParams = ForestParams()) -> DataFrame:
    """A row for each row: id_col, n_links (other vectors linked directly), component_id, kept (id = component_id).

    Vectors are compared only when their labels are equal and not null, by cosine in double precision; those that are
    null, zero or hold null or non-finite components link with nothing. Vectors of different length never link.
    Rows with a null id link with nothing, have a null component and stay. Repeated rows and equal vectors are one class,
    whose members link with each other; the class is compared once. A repeated id with several vectors takes the most
    links and the smallest component. An empty table gives an empty result; other columns are not read.

    Cuts come from a sample, of one vector for each leaf / per_leaf and params.sample at most; every vector is indexed.
    So depth grows with the table, to sample / 16 leaves a tree; beyond, leaves grow. Vectors move as they came (floats as
    floats): once to find equal ones, and once for each leaf that they are in; a block knows a vector's other leaves by
    the forest, not by lists. A leaf of one label is compared in blocks of BLOCK x BLOCK vectors, so a hot label or leaf
    is split, and no leaf is cut. Blocks return counts and spanning links, not pairs, so what they return grows with the
    rows. A pair counts in the first leaf that both share.
    """
    spark = df.sparkSession
    tune(spark)
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("string").alias("label"), quoted(vector_col).alias("v"))
    if dict(rows.dtypes)["v"] != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    usable = write_table(rows.where("id is not null and label is not null and v is not null").mapInArrow(_prepare(), "id long, label string, dim long, same binary, raw binary"), "vectors")
    classes = usable.groupBy("label", "dim", "same").agg(F.min("id").alias("cls"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = write_table(classes.withColumn("key", F.xxhash64("label")), "classes")
    found = None
    for dim, count in sorted((r.dim, r["count"]) for r in classes.groupBy("dim").count().collect()):
        own = classes.where(F.col("dim") == dim)
        leaves = max(1, -(-count // params.leaf))
        some = first_by_hash(own, F.xxhash64("cls", "same"), min(params.sample, params.per_leaf * leaves), count).select("raw").collect()
        forest = Forest(unit_vectors([bytes(r.raw) for r in some], dim).astype(np.float32), count, params)
        part = _links(own, forest, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    linked = write_table(found, "links")
    links = linked.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    comp = connected_components(linked.select("a", "b")).withColumnRenamed("node", "cls")
    per_class = classes.select("label", "dim", "same", "cls", "n").join(links, "cls", "left").join(comp, "cls", "left")
    per_class = per_class.select("label", "dim", "same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    members = usable.select("id", "label", "dim", "same").join(per_class, ["label", "dim", "same"]).select("id", "n_links", "component")
    members = members.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return df.select(quoted(id_col).cast("long").alias("id")).join(members, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _links(classes: DataFrame, forest: Forest, cosine: float) -> DataFrame:
    """(a, b, links) of the classes (key, cls, n, label, raw) of one dimension."""
    own = classes.select("key", "cls", "n", "label", "raw")
    leaf = ["tree", "node", "key"]
    sizes = own.select("key", "raw").mapInArrow(_assign(forest, False), "tree long, node long, key long").groupBy(*leaf).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("nb"))
    sizes = write_table(sizes.where("nb > 1"), "leaves")
    placed = own.mapInArrow(_assign(forest, True), "tree long, node long, key long, cls long, n long, label string, raw binary")
    if not sizes.isEmpty():
        placed = placed.join(sizes, leaf, "left")
    else:
        placed = placed.withColumn("nb", F.lit(1).cast("long"))
    dealt = placed.withColumn("nb", F.coalesce("nb", F.lit(1).cast("long"))).withColumn("k", F.pmod(F.xxhash64("cls"), "nb"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    dealt = dealt.withColumn("m", other).select(*leaf, F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), F.when(F.col("k") <= F.col("m"), 0).otherwise(1).alias("side"), "cls", "n", "label", "raw")
    return grouped_arrow(dealt, [*leaf, "i", "j"], _compare(cosine, forest), "a long, b long, links long")
