"""Connected components of an edge table, by hooking to the least neighbour, pointer jumping and contraction.

Every step is a DataFrame job whose result is written to the shared folder, so lineage stays short.
A node with very many edges is met by partial aggregation and by joins that Spark can split; a
round at least halves the nodes that are left, and edges are thinned to forests where they lie first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm.scratch import Table


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each can reach) of an edge list, in numpy."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        differ = lu != lv
        if not differ.any():
            return nodes, nodes[label]
        u, v, lu, lv = u[differ], v[differ], lu[differ], lv[differ]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while (label[label] != label).any():
            label = label[label]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, roots = labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); the component is its least node. Edges with a null or to themselves count for nothing."""
    rest = Table(edges.where("a <> b").select("a", "b").mapInArrow(_thin, "a long, b long"), release=False)
    maps: list[Table] = []
    while not rest.df.isEmpty():
        both = rest.df.unionByName(rest.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = Table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("p")), release=False)
        while True:
            up = hooked.df.select(F.col("node").alias("_n"), F.col("p").alias("_p"))
            jumped = Table(hooked.df.join(up, hooked.df.p == up._n).select("node", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved")), release=False)
            done = jumped.df.where("moved").isEmpty()
            hooked.drop()
            hooked = jumped
            if done:
                break
        maps.append(hooked)
        root = hooked.df.select("node", "p")
        ra, rb = root.toDF("a", "ra"), root.toDF("b", "rb")
        shorter = rest.df.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        last, rest = rest, Table(shorter.mapInArrow(_thin, "a long, b long"), release=False)
        last.drop()
    rest.drop()
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    out = maps[-1].df.select("node", F.col("p").alias("component"))
    for m in reversed(maps[:-1]):
        above = out.toDF("_n", "_c")
        out = m.df.join(above, m.df.p == above._n, "left").select("node", F.coalesce("_c", "p").alias("component"))
    return out
