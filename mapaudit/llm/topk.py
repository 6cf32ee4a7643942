"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are kept as blocks. For a block of queries and a block of candidates, each term's postings (the
candidates with a weight there) are scattered, times the query's weight, into a dense array of scores;
a partition selection then keeps each query's best k of the block, and the blocks' lists are merged.
Every query meets every candidate; nothing is approximate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.session import cut


@dataclass(frozen=True)
class TopKConfig:
    k: int = 5
    query_rows: int = 1024  # in one block
    candidate_rows: int = 1024
    task_rows: int = 16_384  # candidates a task holds
    pass_blocks: int = 32  # query blocks that are broadcast at once; more take another pass


DEFAULT = TopKConfig()


def weights(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``id, w``: floor(scale * x) of each component. Rows with a null id, a null vector, or a null or
    non-finite component are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("w")))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``n, terms, ids, w``: up to ``size`` rows as one, by id, with their weights as one array."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("id").to_numpy()
                lists = part.column("w").cast(pa.list_(pa.int64()))
                counts = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                terms = int(counts.max(initial=0))
                w = np.zeros((len(ids), terms), np.int64)
                w[np.arange(terms) < counts[:, None]] = flat
                by = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(ids)], pa.int32()), pa.array([terms], pa.int32()), pa.array([ids[by].astype(np.int64).tobytes()], pa.binary()),
                     pa.array([w[by].tobytes()], pa.binary())], ["n", "terms", "ids", "w"])

    return rows.mapInArrow(run, "n int, terms int, ids binary, w binary")


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, term by term: weighted postings into one dense array of scores."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        asked, posted = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if not len(asked) or not len(posted):
            continue
        add = queries[asked, term][:, None] * candidates[posted, term]
        if len(asked) == len(scores) and len(posted) == scores.shape[1]:
            scores += add
        elif len(posted) == scores.shape[1]:
            scores[asked] += add
        else:
            scores[np.ix_(asked, posted)] += add
    return scores


def select(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best allowed scores, ties to the smaller column."""
    low = np.iinfo(np.int64).min
    scores = np.where(allowed, scores, low)
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), low)
    row, column = np.nonzero((scores >= least[:, None]) & allowed)
    by = np.lexsort((column, -scores[row, column], row))
    row, column = row[by], column[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def top_k(queries: DataFrame, candidates: DataFrame, cfg: TopKConfig = DEFAULT) -> DataFrame:
    """``query_id, rank, vec_id, score`` for tables of ``id, w`` (see ``weights``).

    A query's own id is no candidate. Ranks run from 1, ties go to the smaller id, and a query with fewer
    candidates gets them all. A query id that occurs more than once counts once, with its smallest vector;
    a repeated candidate row is a candidate each time. Vectors of unequal length share their first terms.
    """
    asked = queries.groupBy("id").agg(F.min("w").alias("w"))
    blocks = cut(_blocks(asked, cfg.query_rows), "queries")
    lanes = max(1, blocks.count())
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    rows = max(1, candidates.count() // cfg.task_rows + 1)
    held = _blocks(candidates.repartition(rows, "id"), cfg.candidate_rows)

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                q = np.frombuffer(x["q_w"], np.int64).reshape(len(q_ids), x["q_terms"])
                c = np.frombuffer(x["w"], np.int64).reshape(len(c_ids), x["terms"])
                scores = accumulate(q, c)
                row, column = select(scores, q_ids[:, None] != c_ids, cfg.k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(c_ids[column]), pa.array(scores[row, column])],
                                                 ["query_id", "vec_id", "score"])

    best = None
    for first in range(0, lanes, cfg.pass_blocks):
        last = min(lanes, first + cfg.pass_blocks) - 1
        some = blocks.where(F.col("lane").between(first, last)).select(
            "lane", F.col("terms").alias("q_terms"), F.col("ids").alias("q_ids"), F.col("w").alias("q_w"))
        meet = held.withColumn("lane", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(F.broadcast(some), "lane")
        found = meet.mapInArrow(run, "query_id long, vec_id long, score long")
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)
            .select("query_id", "rank", "vec_id", "score"))
