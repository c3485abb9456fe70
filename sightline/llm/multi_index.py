"""Operator 2: approximate nearest neighbours by an inverted multi-index.

The two halves of the unit vectors are quantised separately; a pair of codewords is a cell, and
every vector is filed under its cell. A query walks the codeword pairs in order of their summed
distance with a heap (the multi-sequence walk) until the cells it has passed hold enough vectors,
and exactly these are reranked by their cosine on the original vectors in double precision.

How many vectors are enough is a share of the table, calibrated on a bounded sample: codebooks are
fitted on its first half, and the share is the least that finds ``target`` of the true neighbours in
its second half. Tables of every size go this way. Cells are
packed into groups of bounded size (a larger cell is dealt over several groups by a hash of the
id), queries into parts, and a task compares one group with one part, in blocks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import stage_table

#: Vectors that codebooks and calibration are fitted on, at most.
SAMPLE = 20_000
GROUP_ROWS = 2048
PART_QUERIES = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; very large or small components are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    odd = ~np.isfinite(norms[:, 0]) | (norms[:, 0] < 1e-140)
    if odd.any():
        rows = rows.copy()
        rows[odd] /= np.abs(rows[odd]).max(1, keepdims=True)
        norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / norms


def squared_distances(rows: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] + (codewords**2).sum(1) - 2 * rows @ codewords.T, 0)


def _codebook(rows: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; an empty codeword stays where it was."""
    words = rows[np.linspace(0, len(rows) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        at = squared_distances(rows, words).argmin(1)
        n = np.bincount(at, minlength=size)
        sums = np.zeros_like(words)
        np.add.at(sums, at, rows)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and the share of the table that a query looks at."""

    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared_distances(rows[:, :half], self.first), squared_distances(rows[:, half:], self.second)

    def cell_of(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.distances(rows)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray):
        """Cells by summed distance of their codewords: a heap over two sorted lists."""
        i_of, j_of = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        sa, sb = np.sort(a).tolist(), np.sort(b).tolist()
        heap, last, width = [(sa[0] + sb[0], 0, 0)], len(sb) - 1, len(self.second)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield i_of[i] * width + j_of[j]
            if j < last:
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))

    def visited(self, a: np.ndarray, b: np.ndarray, sizes: list[int], enough: int) -> list[int]:
        """The non-empty cells that a query passes until they hold ``enough`` vectors."""
        out, total = [], 0
        for cell in self.walk(a, b):
            if sizes[cell]:
                out.append(cell)
                total += sizes[cell]
                if total >= enough:
                    break
        return out

    @staticmethod
    def fit(rows: np.ndarray, codewords: int, target: float, k: int, queries: int = 256) -> MultiIndex:
        """Codebooks of half of the sample, and the least share that finds ``target`` of the neighbours in the other half."""
        half = max(1, rows.shape[1] // 2)
        fitted, rows = rows[: -(-len(rows) // 2)], rows[len(rows) // 2 :]
        size = max(1, min(codewords, len(fitted) // 16))
        out = MultiIndex(_codebook(fitted[:, :half], size), _codebook(fitted[:, half:], size), 1.0)
        k, n = min(k, len(rows) - 1), len(rows)
        if k < 1:
            return out
        cell = out.cell_of(rows)
        sizes = np.bincount(cell, minlength=out.cells)
        asked = np.unique(np.linspace(0, n - 1, min(queries, n)).astype(int))
        near = rows[asked] @ rows.T
        near[np.arange(len(asked)), asked] = -np.inf
        found = np.argsort(-near, axis=1, kind="stable")[:, :k]
        a, b = out.distances(rows[asked])
        seen = np.empty(found.shape)
        for i in range(len(asked)):
            order = np.argsort((a[i][:, None] + b[i]).ravel())
            before = np.empty(len(order))
            before[order] = np.cumsum(sizes[order])  # vectors seen with each cell
            seen[i] = before[cell[found[i]]]
        out.share = float(np.quantile(seen / n, target, method="higher"))
        return out


def taking_part(column: Column) -> Column:
    """Vectors with components, all of them finite, one of them not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", codewords: int = 256, target: float = 0.92, sample: int = SAMPLE, least: int = 320) -> DataFrame:
    """Each query's ``k`` nearest of the vectors found, by cosine: query_id, rank (from 1), vec_id, score.

    ``is_query`` marks the queries among the rows; every row with another id is a candidate, all
    candidates if there are fewer than ``k``. A query looks at ``least`` vectors at least. Ties go to the smaller id. Vectors that are null, empty
    or zero, or hold null or non-finite components, take no part, nor do rows without an id or
    with another length than most. Rows of one id count as one, with the first of their vectors by
    value. Without queries or vectors the result is empty. Other columns are not read.
    """
    spark = df.sparkSession
    # Single precision stays as it is, at half the bytes; every measure is in double precision.
    kind = "array<float>" if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    values = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & taking_part(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = stage_table(rows, "ann-rows")
    result = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["q"]:
        return spark.createDataFrame([], result)
    d, n, n_queries = lengths["d"], lengths["n"], lengths["q"]
    rows = rows.where(F.size("v") == d)
    fitted = np.array([r["v"] for r in rows.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], np.float64)
    index = MultiIndex.fit(unit(fitted), codewords, target, k)
    shared = spark.sparkContext.broadcast(index)

    def file(batches):
        for batch in batches:
            cells = shared.value.cell_of(unit(matrix(batch.column("v")))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=[*batch.schema.names, "cell"])

    filed = stage_table(rows.mapInArrow(file, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])), "ann-cells")
    sizes = [0] * index.cells
    for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # as many rows as cells at most
        sizes[r["cell"]] = r["n"]
    enough = max(math.ceil(index.share * n), least)

    # Groups of cells: (first group, number of groups) of each cell.
    first, dealt, group, room = np.zeros(index.cells, np.int64), np.ones(index.cells, np.int64), 0, GROUP_ROWS
    for cell, size in enumerate(sizes):
        if size > room:
            group, room = group + 1, GROUP_ROWS
        first[cell], dealt[cell] = group, max(1, -(-size // GROUP_ROWS))
        if dealt[cell] > 1:
            group, room = group + int(dealt[cell]), GROUP_ROWS
        else:
            room -= size
    parts = -(-n_queries // PART_QUERIES)
    plan = spark.sparkContext.broadcast((first, dealt, sizes))

    def place(batches):
        starts, spread, _ = plan.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            salt = batch.column("h").to_numpy() % spread[cell]
            yield pa.RecordBatch.from_pydict({"group": starts[cell] + salt, "id": batch.column("id"), "v": batch.column("v"), "cell": batch.column("cell")})

    def ask(batches):
        starts, spread, held = plan.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                a, b = shared.value.distances(unit(matrix(one.column("v"))))
                cells = np.array(shared.value.visited(a[0], b[0], held, enough))
                groups = np.concatenate([starts[cells], *(starts[c] + np.arange(1, spread[c]) for c in cells[spread[cells] > 1])])
                owners = np.concatenate([cells, *(np.full(spread[c] - 1, c) for c in cells[spread[cells] > 1])])
                order = np.argsort(groups, kind="stable")
                at, cuts = np.unique(groups[order], return_index=True)
                lists = np.split(owners[order].astype(np.int32), cuts[1:])
                m = len(at)
                yield pa.RecordBatch.from_pydict({"group": at, "part": np.full(m, one.column("part")[0].as_py(), np.int64), "id": np.full(m, one.column("id")[0].as_py(), np.int64), "v": pa.array([one.column("v")[0].as_py()] * m, values), "cells": pa.array(lists, pa.list_(pa.int32()))})

    entries = filed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h")).mapInArrow(place, f"group long, id long, v {kind}, cell int")
    entries = entries.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    asked = filed.where("q").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long").alias("part"))
    # A query costs a heap walk over many cells: spread the few rows over all tasks.
    asked = asked.repartition(min(512, max(8, n_queries // 64))).mapInArrow(ask, f"group long, part long, id long, v {kind}, cells array<int>")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q_id, q = left.column("id").to_numpy(), unit(matrix(left.column("v")))
            ids, v = right.column("id").to_numpy(), unit(matrix(right.column("v")))
            cells, local = np.unique(right.column("cell").to_numpy(), return_inverse=True)
            lists = left.column("cells").to_pylist()
            for b in range(0, len(q), 256):
                open_ = np.zeros((min(256, len(q) - b), len(cells)), bool)
                for i, wanted in enumerate(lists[b : b + 256]):
                    open_[i] = np.isin(cells, wanted)
                cosines = np.where(open_[:, local], q[b : b + 256] @ v.T, -np.inf)
                cosines[q_id[b : b + 256, None] == ids] = -np.inf
                bar = -np.partition(-cosines, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(cosines), -np.inf)
                for i, row in enumerate(cosines):
                    at = np.flatnonzero((row >= bar[i] - 1e-9) & (row > -np.inf))
                    exact = (q[b + i] * v[at]).sum(1)  # the same sum wherever the pair is met, so copies tie
                    best = np.lexsort((ids[at], -exact))[:k]
                    out["query_id"].extend([q_id[b + i]] * len(best))
                    out["vec_id"].extend(ids[at[best]].tolist())
                    out["score"].extend(exact[best].tolist())
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    pairs = asked.groupBy("group", "part").cogroup(entries.groupBy("group", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    ranked = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
