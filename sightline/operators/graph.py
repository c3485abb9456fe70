"""Connected components of an edge table, in DataFrame operations on written tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.sources.staging import stage, unstage

MAX_ROUNDS = 50
#: Edges that one task may contract: tens of MB.
FEW = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """(node, root) of every node of an edge table; the root is the component's smallest node.

    Alternating large-star and small-star steps: a number of rounds logarithmic in the diameter, and
    never more edges than there were; nothing is collected but two numbers a round. Nodes are of any
    type with an order. Null ends, loops and repeated edges don't matter. Raises if it hasn't
    converged after ``MAX_ROUNDS`` rounds rather than return parts of components. Up to ``few`` edges,
    counted first, one task contracts them, with the same result and no rounds.
    """
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    current, mark = stage(pairs.distinct(), "components"), None
    if few and current.count() <= few:
        return _contracted(current)
    for _ in range(MAX_ROUNDS):
        both = current.where("v <> u").unionByName(current.where("v <> u").select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
        large = both.join(least.hint("merge"), F.col("v") == F.col("w")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
        small = large.join(small_least.hint("merge"), F.col("v") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("w").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*")
        new = stage(small.where("v <> u").distinct(), "components")
        unstage(current)
        current = new
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == mark:
            roots = current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            return current.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
        mark = now
    raise RuntimeError(f"components have not converged after {MAX_ROUNDS} rounds")


def _contracted(edges: DataFrame) -> DataFrame:
    """The same by union-find over a bounded table."""
    kind = edges.schema["u"].dataType

    def contract(batches):
        parent = {}

        def root(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for v, u in zip(batch.column("v").to_pylist(), batch.column("u").to_pylist(), strict=True):
                if v == u:
                    continue
                parent.setdefault(v, v)
                parent.setdefault(u, u)
                a, b = root(v), root(u)
                parent[max(a, b)] = min(a, b)
        arrow = batch.schema.field("u").type if parent else None
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([root(x) for x in nodes], arrow)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(contract, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
