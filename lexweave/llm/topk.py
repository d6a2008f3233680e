"""Exact top-k search by inner product with three-phase uniform thresholds (after TPUT, Cao and Wang 2004).

A score is the sum of ``LISTS`` partial scores, one per group of components. Vectors lie in bounded blocks.
1. Every block lists, for each query, its best entries of each partial score; only these are resolved. The k-th best of
   all gathered is a cutoff that the true k-th best can't fall short of.
2. The cutoff travels with the queries. A vector that reaches it has a partial score of at least cutoff / LISTS, so the
   entries above that uniform threshold are sufficient. Partial scores are looked at one list after the other.
3. The full scores of these entries alone are resolved, exactly, and the best of every block are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches, discard, materialize

SCALE = 1024
LISTS = 2
#: Rows of a block of vectors and of a block of queries: they bound a task's memory, whatever the table's size.
ROWS, QUERY_ROWS = 8192, 512
#: Entries that are resolved at once.
RESOLVED = 1 << 16

_PACKED = "dim int, block int, rids binary, ids binary, cells binary, kind string"
_HITS = "rid long, query_id long, vec_id long, score long, resolved long"


def _vectors(rows: DataFrame) -> DataFrame:
    """(rid, vec_id, embedding as doubles) of the rows that take part; ``rid`` tells rows of one id apart once it is written."""
    number = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fine).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), number.alias("embedding"))


def _pack(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of integer vectors of one dimension, in the narrowest type that holds them."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        rids, ids = (table.column(c).to_numpy().astype("<i8") for c in ("rid", "vec_id"))
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("embedding").chunks]).astype(np.float64)
        cells = np.floor(flat * SCALE)
        top = float(np.abs(cells).max(initial=0))
        if top >= 2.0**63:
            raise OverflowError("a component times 1024 fits no long")
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
        order = np.lexsort((rids, ids))
        cells = cells.astype(kind).reshape(len(ids), dim)[order]
        return pa.table(
            {"dim": pa.array([dim], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "rids": [rids[order].tobytes()], "ids": [ids[order].tobytes()], "cells": [cells.tobytes()], "kind": [kind]}
        )

    keyed = rows.select("rid", "vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"))
    return keyed.groupBy("dim", "block").applyInArrow(run, _PACKED)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _largest(cells: np.ndarray) -> int:
    return max(abs(int(cells.max(initial=0))), abs(int(cells.min(initial=0))))


class _Scores:
    """Scores of a block of queries against a block of vectors, exact: in doubles where all sums fit 53 bits, else in longs."""

    def __init__(self, q: np.ndarray, x: np.ndarray, lists: int):
        dim = q.shape[1]
        bound = _largest(q) * _largest(x) * max(1, dim)
        if bound >= 1 << 63:
            raise OverflowError("scores may fit no long")
        kind = np.float64 if bound < 1 << 53 else np.int64
        self.q, self.x = q.astype(kind), x.astype(kind)
        edges = np.linspace(0, dim, min(lists, max(1, dim)) + 1).astype(int)
        self.groups = list(zip(edges, edges[1:]))

    def partial(self, group: tuple[int, int]) -> np.ndarray:
        a, b = group
        return self.q[:, a:b] @ self.x[:, a:b].T

    def resolve(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The full scores of single entries."""
        out = np.empty(len(rows), np.int64)
        for k in range(0, len(rows), RESOLVED):
            r, c = rows[k : k + RESOLVED], columns[k : k + RESOLVED]
            out[k : k + RESOLVED] = np.einsum("ij,ij->i", self.q[r], self.x[c])
        return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(k: int, lists: int, with_cutoff: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_rids, q_ids, rids, ids = (_numbers(row[c]) for c in ("q_rids", "q_ids", "rids", "ids"))
                q, x = (np.frombuffer(row[c], row[kind]).reshape(-1, row["dim"]) if row["dim"] else np.empty((n, 0), "<i2") for c, kind, n in (("q_cells", "q_kind", len(q_ids)), ("cells", "kind", len(ids))))
                scores = _Scores(q, x, lists)
                chosen = np.zeros((len(q_ids), len(ids)), bool)
                own = q_rids[:, None] == rids[None, :]
                if with_cutoff:
                    cutoffs = _numbers(row["cutoffs"])
                    m = len(scores.groups)
                    # the sum of m numbers reaches the cutoff only if one of them reaches cutoff / m
                    enough = -(-cutoffs // m)
                    for group in scores.groups:
                        chosen |= scores.partial(group) >= enough[:, None]
                    chosen[cutoffs == NONE] = True  # fewer entries than asked for: all are wanted
                elif len(ids) > k + 1:
                    for group in scores.groups:
                        part = scores.partial(group)
                        part[own] = np.iinfo(np.int64).min if part.dtype == np.int64 else -np.inf
                        np.put_along_axis(chosen, np.argpartition(part, -k, axis=1)[:, -k:], True, axis=1)
                else:
                    chosen[:] = True
                chosen &= ~own
                at, columns = np.nonzero(chosen)
                found = scores.resolve(at, columns)
                if with_cutoff:
                    fine = found >= cutoffs[at]
                    counts = np.bincount(at, minlength=len(q_ids))
                    at, columns, found = at[fine], columns[fine], found[fine]
                order = np.lexsort((ids[columns], -found, at))
                at, columns, found = at[order], columns[order], found[order]
                first = np.searchsorted(at, at)  # where each query's entries begin
                keep = np.arange(len(at)) - first < k
                at, columns, found = at[keep], columns[keep], found[keep]
                resolved = np.zeros(len(at), np.int64)
                if with_cutoff and len(at):  # a block's count goes with its first hit
                    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    resolved[heads] = counts[at[heads]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_rids[at], q_ids[at], ids[columns], found, resolved)], [f.split()[0] for f in _HITS.split(", ")])

    return run


#: Stands for a query without a cutoff.
NONE = -(1 << 63)


def top_k(rows: DataFrame, k: int = 10, every: int = 100, lists: int = LISTS) -> DataFrame:
    """The ``k`` best-scoring other rows of every query: ``query_id, rank, vec_id, score, n_resolved``.

    Queries are the rows of ``rows(vec_id, embedding)`` whose id is divisible by ``every``. Components become
    ``floor(1024 * x)``; scores are integer inner products; ties go to the smaller id. Rows with a null id, a null or
    non-finite component or no vector take no part; only vectors of equal length are compared. Repeated ids are rows of
    their own: each is a candidate, also for one another, and each query row has its own list. Components or scores
    that might fit no long are an error. Fewer candidates than ``k`` give them all; an empty table gives no rows.
    ``n_resolved``: how many entries of the blocks with hits were resolved for the query's list after the cutoff.
    """
    arrow_batches(rows.sparkSession)
    vectors = materialize(_vectors(rows), "vectors")
    n = vectors.count()
    blocks, query_blocks = max(1, math.ceil(n / ROWS)), max(1, math.ceil(n / every / QUERY_ROWS))
    packed = materialize(_pack(vectors, blocks), "vector-blocks")
    queries = materialize(_pack(vectors.where(F.col("vec_id") % every == 0), query_blocks), "query-blocks")
    discard(vectors)
    sent = queries.select("dim", F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("rids", "ids", "cells", "kind")))

    def against(asked: DataFrame, with_cutoff: bool) -> DataFrame:
        # a stated query set against all rows, block by block: each block of queries goes to each block of vectors
        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return packed.hint("shuffle_hash").join(spread, ["dim", "block"]).mapInArrow(_search(k, lists, with_cutoff), _HITS)

    ranked = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    gathered = against(sent, False).withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == k)
    cutoff = materialize(gathered.select("rid", F.col("score").alias("cutoff")), "cutoffs")
    known = cutoff.withColumn("q_block", F.pmod(F.xxhash64("rid"), F.lit(query_blocks)).cast("int"))
    known = known.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("rid", "cutoff"))).alias("_known"))
    fields = [("dim", pa.int32(), "int"), ("q_block", pa.int32(), "int"), *((f"q_{c}", pa.binary(), "binary") for c in ("rids", "ids", "cells")), ("q_kind", pa.string(), "string"), ("cutoffs", pa.binary(), "binary")]

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = dict(row.pop("_known") or [])
                row["cutoffs"] = np.array([found.get(int(i), NONE) for i in _numbers(row["q_rids"])], "<i8").tobytes()
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(f, t) for f, t, _ in fields]))

    asked = sent.join(known, "q_block", "left").select(*(f for f, _, _ in fields[:-1]), "_known")
    asked = asked.mapInArrow(attach, ", ".join(f"{f} {t}" for f, _, t in fields))
    hits = against(asked, True)
    total = F.sum("resolved").over(Window.partitionBy("rid"))
    found = hits.withColumn("rank", F.row_number().over(ranked)).withColumn("n_resolved", total).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", "n_resolved")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
