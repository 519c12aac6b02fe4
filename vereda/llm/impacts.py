"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become integers, floor(64 * x).  They are dealt by a hash of their id to blocks of
bounded size; a block's index holds its postings (dimension, row, value) in segments of
descending impact, an impact being the highest bit of the absolute value, and in each segment a
list for each dimension.  A batch of queries takes the segments in that order.  It walks the
lists of the dimensions that its queries use and adds to the scores of the rows in them.  After
each segment the rest of a score is
bounded by the norms of the query and of what is left of the vector; a query's k-th best lower
bound shows which vectors are still possible.  A query stops, and the walk goes on without it,
once few enough are; those are rescored exactly, with all that tie.

Queries meet blocks by an equi-join on the block number: a stated query set against all rows,
in blocks.  Each pair of a batch and a block gives k rows for each query at most.

Defined cases: null vectors, vectors with null or non-finite components and null ids take no
part; shorter vectors are padded with zeros; of repeated ids the smallest vector counts; fewer
candidates than k give all; an empty table gives an empty result.
Components keep 64 bits.  Scores that floating point may round are given a slack that covers it,
before the integer rescoring.  Vectors of more than 65536 components, and vectors so large that
a score might not fit into 64 bits, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BLOCK, BATCH = 8192, 256
#: The search stops when this many vectors are possible for each query, in units of k.
ENOUGH = 8


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    made = F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("long"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), made.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _dense(b: pa.RecordBatch, width: int) -> np.ndarray:
    v = b.column("v")
    size = np.diff(v.offsets.to_numpy())
    out = np.zeros((b.num_rows, width), np.int64)
    row = np.repeat(np.arange(b.num_rows), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
    return out


def _grouped(df: DataFrame, key: str, width: int, index: bool) -> DataFrame:
    """One row for each value of ``key``: the ids and the vectors, or their postings."""

    def build(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        order = np.argsort(b.column("vec_id").to_numpy())
        v = _dense(b, width)[order]
        ids = b.column("vec_id").to_numpy()[order]
        blob = packed(*postings(v)) if index else v.tobytes()
        return pa.table({key: b.column(key)[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([blob], pa.binary())})

    return df.groupBy(key).applyInArrow(build, f"{key} int, ids binary, data binary")


def impact(value: np.ndarray) -> np.ndarray:
    """The place of the highest bit of the absolute value."""
    return np.frexp(np.abs(value).astype(np.float64))[1]


def postings(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of all that is not nought, by falling impact, then dimension."""
    dim, row = np.nonzero(v.T)
    value = v[row, dim]
    by = np.lexsort((row, dim, -impact(value)))
    return row[by], dim[by], value[by]


def packed(row: np.ndarray, dim: np.ndarray, value: np.ndarray) -> bytes:
    return row.astype(np.uint16).tobytes() + dim.astype(np.uint16).tobytes() + value.astype(np.int64).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return tuple(np.frombuffer(blob, kind, n, at * n).astype(np.int64) for kind, at in ((np.uint16, 0), (np.uint16, 2), (np.int64, 4)))


def search(ids: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and score of each query's k best rows of one block."""
    row, dim, value = index
    level = impact(value)
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(value).max(initial=0)) * width
    if top >= 1 << 63:
        raise ValueError("a score may not fit into 64 bits")
    kind = np.float32 if top < 1 << 24 else np.float64
    # what sums of rounded products may be off by: nothing while all of them are exact
    blur = 0.0 if top < 1 << 53 else 2.0 * (width + 2) * 2.0**-53 * top
    active = np.arange(len(queries))  # queries that have not stopped
    q = queries.T.astype(kind)
    score = np.zeros((len(ids), len(queries)), kind)
    rest = np.bincount(row, value.astype(np.float64) ** 2, len(ids))
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    own = ids[:, None] == query_ids[None, :]
    found: list[tuple[np.ndarray, np.ndarray]] = []  # possible rows of queries that stopped
    lists = np.append(np.flatnonzero((np.diff(level, prepend=-1) != 0) | (np.diff(dim, prepend=-1) != 0)), len(level))
    for a, b in zip(lists[:-1].tolist(), lists[1:].tolist(), strict=True):
        weight = q[dim[a]]
        if weight.any():
            score[row[a:b]] += value[a:b, None].astype(kind) * weight[None, :]
        if b == len(level) or level[b] == level[a] or len(ids) <= k + 1:
            continue
        # a segment ends here
        rest -= np.bincount(row[level == level[a]], value[level == level[a]].astype(np.float64) ** 2, len(ids))
        slack = np.sqrt(np.maximum(rest, 0))[:, None] * length[None, active] + 1e-3 + blur
        low = np.where(own, -np.inf, score - slack)
        bar = np.partition(low, len(ids) - k, axis=0)[len(ids) - k]
        possible = ~own & (score + slack >= bar)
        done = possible.sum(0) <= ENOUGH * k
        if done.any():
            rows, qs = np.nonzero(possible[:, done])
            found.append((active[done][qs], rows))
            active, score, own, q = active[~done], score[:, ~done], own[:, ~done], q[:, ~done]
            if not len(active):
                break
    if len(active):  # no early stop: the scores are exact, but for the blur
        exact = np.where(own, -np.inf, score)
        good = ~own
        if len(ids) > k:
            good &= exact >= np.partition(exact, len(ids) - k, axis=0)[len(ids) - k] - 2 * blur
        rows, qs = np.nonzero(good)
        found.append((active[qs], rows))
    qs, rows = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    full = np.zeros((len(ids), width), np.int64)
    full[row, dim] = value
    exact = np.einsum("ij,ij->i", queries[qs], full[rows])
    order = np.lexsort((ids[rows], -exact, qs))
    qs, rows, exact = qs[order], rows[order], exact[order]
    place = np.arange(len(qs)) - np.searchsorted(qs, qs)
    good = place < k
    return qs[good], rows[good], exact[good]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row where ``is_query`` holds."""
    whole = settle(integers(vectors), "vectors")
    sizes = whole.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("m"), F.max(F.size("v")).alias("width")).first()
    blocks, batches, width = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-sizes["m"] // BATCH)), max(1, sizes["width"] or 1)
    dealt = F.xxhash64("vec_id")
    if width > 1 << 16:
        raise ValueError("vectors of more than 65536 components")
    index = _grouped(whole.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")), "block", width, True)
    asked = _grouped(whole.filter(is_query).withColumn("batch", F.pmod(dealt, F.lit(batches)).cast("int")), "batch", width, False)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("ids").alias("query_ids"), F.col("data").alias("queries"))

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for i in range(b.num_rows):
                ids, query_ids = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in ("ids", "query_ids"))
                index = unpacked(b.column("data")[i].as_buffer())
                queries = np.frombuffer(b.column("queries")[i].as_buffer(), np.int64).reshape(-1, width)
                q, r, score = search(ids, index, width, query_ids, queries, k)
                yield pa.record_batch({"query_id": query_ids[q], "vec_id": ids[r], "score": score})

    parts = asked.join(index, "block").select("ids", "data", "query_ids", "queries").mapInArrow(rows, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
