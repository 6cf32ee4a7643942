"""Runs of words that repeat with a period, found online by dyadic square catching.

When a block of 2^k words, aligned within its text, is complete, a catcher holds its identifier for the next 2^k
words that begin after it. Each word that arrives completes one suffix of 2^k words per level, which is compared
with the one catcher that waits for it: if they are equal, the block and the suffix are a period q apart, with
2^k <= q < 2^(k+1), and the square that they begin is reported. A suffix of twice the length is told by the two halves
that were read before. Squares of neighbouring catchers with one period merge, and what is left is compared word
by word at both ends, which are shorter than a block.

A run of at least four periods holds whole aligned blocks of every level up to that of its period, so none is missed.
Squares inside a run of a level below whose period divides theirs are that run again and are passed over. The words
of many texts advance side by side, level after level: one comparison for each word and level that its text can fill.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.llm.text import CHUNK_BYTES, U64, chunks, mix, row_edges, span_hashes, words


@dataclass(frozen=True)
class RunConfig:
    least_words: int = 6  # a run has at least so many words
    least_periods: int = 4  # and so many periods; at least 4


DEFAULT = RunConfig()
_SPLIT = r"[\x20\x09-\x0D]+"
_STEP = U64(0x9E3779B97F4A7C15)


def _word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit identifiers of words, some bytes at a time."""
    out = np.zeros(len(starts), U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
        lo, hi = starts[a], ends[b - 1]
        out[a:b] = span_hashes(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out


def _stretches(word: np.ndarray, edges: np.ndarray, level: int, text: np.ndarray, block: np.ndarray, period: np.ndarray, cfg: RunConfig):
    """Merges squares of neighbouring blocks and yields (text, start, end, period) of those that are long enough.
    ``block`` is the first word of the block, counted in its text."""
    size = 1 << level
    by = np.lexsort((block, period, text))
    text, block, period = text[by], block[by], period[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (period[1:] != period[:-1]) | (block[1:] != block[:-1] + size)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(by)))
    text, block, period = text[first], block[first], period[first]
    least = np.maximum(cfg.least_words, cfg.least_periods * period)
    real = (count + 2) * size - 2 + period >= least  # each end grows by less than a block
    for t, at, n, q, need in zip(text[real].tolist(), block[real].tolist(), count[real].tolist(), period[real].tolist(), least[real].tolist()):
        low, high = int(edges[t]), int(edges[t + 1])
        a, b = low + at, low + at + n * size
        lo = max(low, a - size)
        other = np.flatnonzero(word[lo:a] != word[lo + q : a + q])
        start = lo + int(other[-1]) + 1 if len(other) else lo
        hi = min(high - q, b + size)
        other = np.flatnonzero(word[b:hi] != word[b + q : hi + q])
        end = (b + int(other[0]) if len(other) else hi) + q
        if end - start >= need:
            yield t, start - low, end - low, q


def find_runs(word: np.ndarray, edges: np.ndarray, cfg: RunConfig = DEFAULT) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs of every text, in that order. ``edges`` are the n + 1 bounds of the texts."""
    count = np.diff(edges)
    found: dict[tuple[int, int, int], int] = {}
    inside, beat = np.zeros(len(word), np.int64), np.ones(len(word), np.int64)  # end and period of a run that holds the word
    suffix = word  # identifiers of the 2^level words from each word on
    at = np.arange(len(word))
    level = 0
    while True:
        size = 1 << level
        long = count >= cfg.least_periods * size
        if not long.any():
            break
        text = np.repeat(np.flatnonzero(long), count[long])
        at = np.arange(len(text)) - np.repeat(np.cumsum(count[long]) - count[long], count[long])
        here = at + edges[text]
        catcher = (at >> level << level) - size
        real = np.flatnonzero((catcher >= 0) & (at + size <= count[text]))
        text, at, here, catcher = text[real], at[real], here[real], catcher[real]
        hit = np.flatnonzero(suffix[here] == suffix[catcher + edges[text]])
        text, at, catcher = text[hit], at[hit], catcher[hit]
        begin = catcher + edges[text]
        known = (inside[begin] >= at + edges[text] + size) & ((at - catcher) % beat[begin] == 0)
        text, at, catcher = text[~known], at[~known], catcher[~known]
        if len(text):
            for t, a, b, q in _stretches(word, edges, level, text, catcher, at - catcher, cfg):
                if q < found.get((t, a, b), q + 1):
                    found[t, a, b] = q
                    low = int(edges[t])
                    inside[low + a : low + b], beat[low + a : low + b] = low + b, q
        after = np.concatenate([suffix[size:], np.zeros(min(size, len(suffix)), U64)])
        suffix = mix(suffix * _STEP + after + U64(level))
        level += 1
    return sorted((t, a, b - a, q) for (t, a, b), q in found.items())


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The words of each text with one space between them."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]), 32, np.uint8)
    where = np.arange(len(out)) - np.repeat(to[:-1], size)
    inner = where < np.repeat(size - 1, size)
    out[inner] = data[(np.repeat(starts, size) + where)[inner]]
    raw, bounds = out.tobytes(), to[edges].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]


def periodic_runs(docs: DataFrame, cfg: RunConfig = DEFAULT) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row. ``runs`` are (start, length, period) by start, then period:
    stretches of at least ``least_words`` words and ``least_periods`` smallest periods, words a period apart being
    identical, that no neighbouring word extends. ``collapsed`` joins by one space the words that no run holds
    after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` and compared by 64-bit hashes. A null, empty or blank text has no words, no runs and
    an empty ``collapsed``. Repeated rows and null ids are documents of their own, other columns are ignored, an empty
    table stays empty. Work is in proportion to words times the logarithm of the words of a text.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch, data, offsets in chunks(batches):
            n = batch.num_rows
            starts, ends, row = words(data, offsets)
            edges = row_edges(row, n)
            found = find_runs(_word_ids(data, starts, ends), edges, cfg)
            lists: list[list] = [[] for _ in range(n)]
            kept = np.ones(len(starts), bool)
            for t, start, length, period in found:
                lists[t].append({"start": start, "length": length, "period": period})
                kept[edges[t] + start + period : edges[t] + start + length] = False
            left = np.concatenate([[0], np.cumsum(kept)])[edges]
            texts = _joined(data, starts[kept], ends[kept], left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(edges)), pa.array(lists, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, one document in ten with a periodic end: the test load that the query asks for. With
    h = crc32(decimal doc_id), g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a of the
    n words of a text becomes word a + (i - a) % p where h % 10 = 0. Null ids and texts without words stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    word = F.array_remove(F.split("text", _SPLIT), "")
    # null for the other nine tenths, so that their texts are not split
    picked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, word).alias("word"))
    picked = picked.withColumn("n", F.size("word")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    picked = picked.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    new = F.expr("array_join(transform(sequence(0, n - 1), i -> word[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return picked.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of a table of ``periodic_runs``: the number of runs, the longest one (ties: smallest start, then
    period) with its exponent in thousandths, and digests of all runs and of the collapsed text."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))), 1)
    rows = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"))
    length, period = -F.col("best.col1"), F.col("best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
                       period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
