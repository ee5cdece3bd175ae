"""Connected components of an edge table, by a forest that is merged at the children and shortened by pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_table, table_at, write_table

#: Edges that a task contracts at once in memory.
CHUNK = 1 << 18

_FOREST = "u long, v long, main boolean, moved boolean"


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges a-b that is not the smallest node reachable by these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == label[y]).all():
            break
        # hook both ends' roots to the smaller label, then shorten all paths
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not (label == (short := label[label])).all():
            label = short
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _contracted(batches) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition as stars, CHUNK edges at a time; without a shuffle."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("moved", pa.bool_())])
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        u, v = spanning_stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        parts.clear()
        return batch(schema, u, v, np.zeros(len(u), bool))

    for rows in batches:
        parts.append((rows.column(0).to_numpy(), rows.column(1).to_numpy()))
        if sum(len(p[0]) for p in parts) >= CHUNK:
            yield out()
    if parts:
        yield out()


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, moved) sorted by u and v, to one main row for each u, to its smallest v; what its other v's are tied to
    comes as further edges, which are moved."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("main", pa.bool_()), ("moved", pa.bool_())])
    last, low = None, 0
    extra: list[tuple[np.ndarray, np.ndarray]] = []

    def stars():
        u, v = spanning_stars(np.concatenate([p[0] for p in extra]), np.concatenate([p[1] for p in extra]))
        extra.clear()
        return batch(schema, u, v, np.zeros(len(u), bool), np.ones(len(u), bool))

    for rows in batches:
        if not rows.num_rows:
            continue
        u, v, moved = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.concatenate([[last is None or u[0] != last], u[1:] != u[:-1]])
        group = np.cumsum(new)
        first = np.concatenate([[low], v[new]])[group]  # the smallest v of each row's u
        yield batch(schema, u[new], v[new], np.ones(int(new.sum()), bool), moved[new])
        other = v != first
        if other.any():
            extra.append((v[other], first[other]))
            if sum(len(p[0]) for p in extra) >= CHUNK:
                yield stars()
        last, low = u[-1], first[-1]
    if extra:
        yield stars()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) longs, undirected, to (node, component): the smallest node that can be reached.

    Only nodes whose component is another node have a row: a node without one is its own component. Null ends and loops
    are left out; an empty table gives an empty one.

    Each task first contracts its edges in memory to stars (node, root), so a hub has no more rows as a child than tasks
    sent it. A step then replaces each row's root by the root's own main parent, in an outer join that the skew join can
    split where a root has many children (its other side has one row a root), and merges the parents of each child, which
    are few. Rows are dealt by child, never by root, to the merge. Steps end when no root was a child and no child had two
    parents; paths halve with each step. A step is one job of three shuffles; the driver gets one bit of it.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_contracted, "u long, v long, moved boolean")
    before = None
    while True:
        forest = write_table(e.repartition("u").sortWithinPartitions("u", "v", F.desc("moved")).mapInArrow(_merged, _FOREST), name)
        if before is not None:
            drop_table(before)
            if forest.where("moved").isEmpty():
                break
        elif forest.isEmpty():
            break
        before = forest
        parent = forest.where("main").select(F.col("u").alias("pu"), F.col("v").alias("pv"))
        e = forest.join(parent, F.col("v") == F.col("pu"), "left").select("u", F.coalesce("pv", "v").alias("v"), (F.col("pu").isNotNull() | ~F.col("main")).alias("moved"))
    out = forest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return table_at(out, forest)
