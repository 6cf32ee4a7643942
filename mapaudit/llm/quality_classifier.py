"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams are counted: one of good documents (the target), one of
all documents (raw). A text's weight is the log ratio of its likelihood under both. Gumbel noise is added
to every weight and the k largest are kept, which samples k documents without replacement in proportion
to their weights. k is the part of labelled documents that are good, plus a margin, of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.llm.text import SPACE, U64, chunks, mix, row_edges, rows_of, runs, span_hashes
from mapaudit.session import cut


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 16  # n-grams are hashed into 2^bits buckets
    smooth: float = 0.5  # added to every bucket's count
    target_rows: int = 20_000  # bound of the labelled documents the target model is fitted on
    margin: float = 0.01  # kept beyond the labelled share, so the limit falls among rejected documents
    share: float | None = None  # part of all rows to keep; None: from the labels
    seed: int = 11


DEFAULT = QualityConfig()

#: Letters, digits and bytes beyond ASCII make words; a run of one punctuation mark is a word of its own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[b for b in range(32) if not SPACE[b]]] = 2
_KIND[SPACE] = 0


def buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and every two neighbouring words, case kept."""
    starts, ends = runs(_KIND[data], offsets)
    hashes, row = span_hashes(data, starts, ends), rows_of(offsets, starts)
    near = np.flatnonzero(row[1:] == row[:-1])
    both = mix(hashes[near] * U64(3) + hashes[near + 1] * U64(0x9E3779B97F4A7C15))
    shift = U64(64 - bits)
    return np.concatenate([hashes >> shift, both >> shift]).astype(np.int64), np.concatenate([row, row[near]])


def target_ids(labels: DataFrame, cfg: QualityConfig = DEFAULT) -> tuple[DataFrame, float]:
    """Ids of good labelled documents (quality 1 and not toxic), at most about ``cfg.target_rows``, and the
    part of labelled documents with quality 1. Without labels: no ids and 1.0."""
    known = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
    good = F.col("quality") == 1
    clean = good & (F.coalesce("toxic", F.lit(0)) == 0)
    rows, fine, usable = known.agg(F.count("*"), F.count_if(good), F.count_if(clean)).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed)), F.lit(1 << 30)) / float(1 << 30)
    ids = known.where(clean & (draw < min(1.0, cfg.target_rows / max(usable, 1)))).select("doc_id").distinct()
    return ids.limit(2 * cfg.target_rows), fine / rows if rows else 1.0


def fit(docs: DataFrame, ids: DataFrame, cfg: QualityConfig = DEFAULT) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket. Both models are counted in one pass over all
    rows; a task sends one row for each bucket it met."""
    good = ids.select("doc_id", F.lit(True).alias("good"))
    rows = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    size = 1 << cfg.bits

    def run(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch, data, offsets in chunks(batches):
            bucket, row = buckets(data, offsets, cfg.bits)
            raw += np.bincount(bucket, minlength=size)
            target += np.bincount(bucket[np.asarray(batch.column("good"))[row]], minlength=size)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    counts = (rows.mapInArrow(run, "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    both = np.full((2, size), cfg.smooth)
    for i, name in enumerate(("target", "raw")):
        both[i, counts["bucket"].to_numpy(np.int64)] += counts[name].to_numpy(np.float64)
    if not len(counts) or not counts["target"].sum():
        return np.zeros(size)
    both = np.log(both / both.sum(axis=1, keepdims=True))
    return both[0] - both[1]


def _weigh(batch, data, offsets, ratio: np.ndarray, cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log weight, and log weight with noise that depends on the id only."""
    bucket, row = buckets(data, offsets, cfg.bits)
    weight = np.bincount(row, ratio[bucket], minlength=batch.num_rows)
    ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    salt = mix(np.array([cfg.seed], U64))
    drawn = ((mix(ids + salt) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
    return weight, weight - np.log(-np.log(drawn))


def score(docs: DataFrame, ratio: np.ndarray, cfg: QualityConfig = DEFAULT) -> DataFrame:
    """``doc_id, log_weight, key, place`` of every row; ``place`` orders like ``key`` but is an integer.
    Null and empty texts weigh 0. Equal ids draw equal noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch, data, offsets in chunks(batches):
            weight, key = _weigh(batch, data, offsets, shared.value, cfg)
            bits = key.view(np.int64)
            place = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(key), pa.array(place)],
                                             ["doc_id", "log_weight", "key", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, key double, place long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by four counts of at most 65,536 groups each."""
    found = None
    for shift in (48, 32, 16, 0):
        part = rows if found is None else rows.where(F.shiftright(column, shift + 16) == found)
        sizes = part.groupBy(F.shiftright(column, shift).alias("v")).count().collect()
        for v, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
            if k <= n:
                found = v
                break
            k -= n
        else:
            return None
    return found


def classify(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = DEFAULT) -> tuple[DataFrame, np.ndarray, int | None]:
    """``doc_id, log_weight, key, kept`` of every row, with the fitted model and the limit of ``place``.

    Rows at the limit are all kept, so ties and repeated rows share their fate. An empty table stays empty;
    without usable labels everything is kept. Other columns are ignored.
    """
    ids, share = target_ids(labels, cfg)
    ratio = fit(docs, cut(ids, "target"), cfg)
    scored = cut(score(docs, ratio, cfg), "scores")
    share = min(1.0, cfg.share if cfg.share is not None else share + cfg.margin)
    limit = kth_largest(scored, "place", max(1, round(share * scored.count())))
    kept = F.lit(True) if limit is None else F.col("place") >= limit
    return scored.withColumn("kept", kept).drop("place"), ratio, limit


def keep_good(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns. Scores are computed again while
    filtering, which spares a shuffle of the texts."""
    _, ratio, limit = classify(docs, labels, cfg)
    if limit is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch, data, offsets in chunks(batches):
            _, key = _weigh(batch, data, offsets, shared.value, cfg)
            bits = key.view(np.int64)
            place = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield batch.filter(pa.array(place >= limit))

    return docs.mapInArrow(run, docs.schema)
