"""Phrase collocations from count streams that are sorted once and then read side by side.

Every task writes, per length of phrase, a stream of (prefix, last word, count) in prefix order; the prefix of a pair
is its first word, that of a triple the identifier of its first two words. A stream travels in blocks: differences of
the sorted prefixes, last words and counts, each a column of its own. Where blocks of all tasks meet they are sorted
again and one pass adds equal neighbours, so neither side keeps a table of phrases. Only phrases that are frequent
enough leave that pass, and all further counts come from merge joins of what is left: triples in prefix order meet the
pairs they begin with (left counts, right extensions), triples in suffix order the pairs they end with (right counts,
left extensions), and both meet the stream of words.

Phrases are dealt by all their words, so one that every document holds arrives as a row per block, not per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.llm import blocks
from mapaudit.llm.text import LOWER, U64, mix, rows_of, runs, span_hashes, text_bytes
from mapaudit.session import cut


@dataclass(frozen=True)
class PhraseConfig:
    least: int = 10  # occurrences of a candidate
    inside_percent: int = 50  # a candidate goes if a longer one around it has so many hundredths of its occurrences
    best: int = 2000  # rows of a language in the report


DEFAULT = PhraseConfig()
SCALE = 1_000_000
NO_LANG = "und"
BLOCK_WORDS = 3 << 18  # words that a task counts before it writes
PART_BYTES = 1 << 20  # texts that are split into words at once
_KIND = np.ones(256, np.uint8)
_KIND[[0x20, 0x09]] = 0
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_KIND[_CUT] = 0
_TWO, _THREE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _identifier(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(prefix * _TWO) + word * _THREE)


def _texts(batches: Iterator[pa.RecordBatch]):
    """(lang of each stretch, bytes, offsets); a very long text comes in stretches that end at a separator."""
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        data, offsets = text_bytes(batch.column("text"))
        at = 0
        while at < len(lang):
            to = int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1
            if to > at:
                yield lang[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                at = to
                continue
            a, end = int(offsets[at]), int(offsets[at + 1])
            cuts = a + 1 + np.flatnonzero(_CUT[data[a:end]])
            while a < end:
                k = int(np.searchsorted(cuts, a + PART_BYTES))
                b = int(cuts[k]) if k < len(cuts) else end
                yield lang[at : at + 1], data[a:b], np.array([0, b - a])
                a = b
            at += 1


class Words:
    """Words of a stretch of texts: identifiers that also tell the language, and whether the next word follows in the
    same piece."""

    def __init__(self, lang: list[str], data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end = runs(_KIND[data], offsets)
        row = rows_of(offsets, self.start)
        codes = {x: span_hashes(np.frombuffer(x.encode() + b"\0", np.uint8), np.array([0]), np.array([len(x.encode()) + 1]))[0] for x in set(lang)}
        self.lang = [lang[i] for i in row.tolist()] if len(codes) > 1 else [lang[0]] * len(row) if lang else []
        self.word = mix(span_hashes(self.data, self.start, self.end) + np.array([codes[x] for x in lang], U64)[row]) if len(row) else np.zeros(0, U64)
        before = np.concatenate([[0], np.cumsum(_CUT[data])])
        self.follows = np.zeros(len(row), bool)
        if len(row):
            self.follows[:-1] = (row[1:] == row[:-1]) & (before[self.start[1:]] == before[self.end[:-1]])

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prefix, last word) of all pairs, and of all triples."""
        pair = np.flatnonzero(self.follows)
        triple = pair[:-1][np.diff(pair) == 1]
        return self.word[pair], self.word[pair + 1], _identifier(self.word[triple], self.word[triple + 1]), self.word[triple + 2]


def _langs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, id, f`` of every word of every language."""

    def run(batches):
        parts: list[tuple] = []
        held = 0

        def flush():
            ids = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            lang = [x for p in parts for x in p[2]]
            word = [x for p in parts for x in p[3]]
            ids, at, back = np.unique(ids, return_index=True, return_inverse=True)
            at = at.tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang[i] for i in at], pa.string()), pa.array([word[i] for i in at], pa.binary()).cast(pa.string()),
                 pa.array(ids.view(np.int64)), pa.array(np.bincount(back, counts).astype(np.int64))], ["lang", "word", "id", "f"])

        for lang, data, offsets in _texts(batches):
            w = Words(lang, data, offsets)
            ids, at, count = np.unique(w.word, return_index=True, return_counts=True)
            raw = w.data.tobytes()
            parts.append((ids, count, [w.lang[i] for i in at.tolist()], [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]))
            held += len(ids)
            if held > BLOCK_WORDS // 4:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    rows = _langs(docs).mapInArrow(run, "lang string, word string, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """``size, prefix, word, id, a`` of the pairs and triples that occur ``least`` times: the prefix's identifier (a pair's
    first word), the last word's, the whole phrase's, and the count."""
    parts = U64(blocks.part_count(docs.sparkSession))

    def write(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            for size in (2, 3):
                prefix, word = (np.concatenate([h[2 * size - 4 + k] for h in held]) for k in range(2))
                key = _identifier(prefix, word)
                by = np.argsort(key)
                key = key[by]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(key)))
                prefix, word, part = prefix[by[first]], word[by[first]], (key[first] % parts).astype(np.int64)
                by = np.lexsort((prefix, part))
                yield blocks.write(part[by], size, [prefix[by], word[by], count[by]])

        for lang, data, offsets in _texts(batches):
            w = Words(lang, data, offsets)
            held.append(w.phrases())
            n += len(w.word)
            if n > BLOCK_WORDS:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def add(columns):
        prefix, word, count = columns
        by = np.lexsort((word, prefix))  # merges the sorted stretches
        prefix, word = prefix[by], word[by]
        first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])]))
        return [prefix[first], word[first], np.add.reduceat(count[by], first)]

    def read(batches):
        for size, columns in blocks.read(batches, {2: 3, 3: 3}, add):
            prefix, word, count = add(columns)
            often = count >= least
            prefix, word, count = prefix[often], word[often], count[often]
            key = _identifier(prefix, word)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(prefix), size, np.int32)), *(pa.array(x.view(np.int64)) for x in (prefix, word, key, count))],
                ["size", "prefix", "word", "id", "a"])

    return blocks.deal(_langs(docs).mapInArrow(write, blocks.SCHEMA)).mapInArrow(read, "size int, prefix long, word long, id long, a long")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(SCALE * a * a / (l * r)) in whole decimals; a is at most l and r, so 38 digits hold counts of 10^15."""
    top = (F.lit(SCALE).cast("decimal(7,0)") * (_exact(a) * _exact(a)).cast("decimal(30,0)")).cast("decimal(38,0)")
    below = (_exact(l) * _exact(r)).cast("decimal(30,0)")
    return F.call_function("div", top, below)


def collocations(docs: DataFrame, cfg: PhraseConfig = DEFAULT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language.

    Texts (``A-Z`` in lower case) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``; phrases
    lie inside a piece. Candidates occur ``least`` times. A cut of a candidate has l and r, the counts of its two
    parts, and the score floor(1000000 a a / (l r)); the lowest-scoring cut counts, of equal ones the first. A pair
    goes if a candidate of three words holds it and has ``inside_percent`` of its count. n is the number of words of
    the language. Order: score, a (both descending), phrase. Phrases are compared by 64-bit identifiers of their words.

    A null lang counts as ``und``, null and empty texts hold no words, repeated rows count each, other columns are
    ignored, an empty table gives no rows. A text of any length is read in stretches that end at a separator.
    """
    counts = cut(word_counts(docs).withColumn("often", F.col("f") >= cfg.least)
                 .groupBy("often", "lang", F.when(F.col("often"), F.col("id")).alias("id"), F.when(F.col("often"), F.col("word")).alias("word"))
                 .agg(F.sum("f").alias("f")), "words")
    words = counts.where("often").select("id", "lang", "word", "f")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    found = cut(phrase_counts(docs, cfg.least), "phrases")
    pairs = found.where("size = 2").select(F.col("prefix").alias("w1"), F.col("word").alias("w2"), "id", "a")
    triples = found.where("size = 3").select(F.col("prefix").alias("start"), F.col("word").alias("w3"), "a")

    # prefix order: the pair that a triple begins with
    known = pairs.select(F.col("id").alias("start"), "w1", "w2", F.col("a").alias("l2"))
    triples = triples.join(known.hint("merge"), "start")
    # suffix order: the pair that it ends with
    known = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    triples = triples.join(known.hint("merge"), ["w2", "w3"])
    right = triples.groupBy("w1", "w2").agg(F.max("a").alias("right"))
    left = triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("left"))
    pairs = pairs.join(right.hint("merge"), ["w1", "w2"], "left").join(left.hint("merge"), ["w1", "w2"], "left")
    longest = F.greatest(F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0)))
    pairs = pairs.where(F.lit(100) * longest < F.lit(cfg.inside_percent) * F.col("a")).select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a",
                                                                  F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r1"))
    rows = pairs.unionByName(triples.select("w1", "w2", "w3", "a", "l2", "r1"))
    rows = rows.join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1"), F.col("f").alias("f1")), "w1")
    for k, how in ((2, "inner"), (3, "left")):
        rows = rows.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}")), f"w{k}", how)
    rows = rows.withColumn("first", F.when(F.col("w3").isNull(), _score("a", "f1", "f2")).otherwise(_score("a", "f1", "r1")))
    rows = rows.withColumn("second", F.when(F.col("w3").isNotNull(), _score("a", "l2", "f3")))
    later = F.col("second") < F.col("first")
    pick = lambda one, two: F.when(later, two).otherwise(one)
    rows = rows.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", pick(F.col("f1"), F.col("l2")).alias("l"),
                       pick(F.when(F.col("w3").isNull(), F.col("f2")).otherwise(F.col("r1")), F.col("f3")).alias("r"),
                       pick(F.col("first"), F.col("second")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    best = rows.withColumn("rank", rank).where(F.col("rank") <= cfg.best)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
