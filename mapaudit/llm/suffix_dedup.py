"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every suffix that matters falls into a bucket by its first ``gram`` bytes, its bucket pointer. A bucket is refined by
the pointers of its suffixes at later offsets, and what is left of it again by further ones, until the whole string
of ``length`` bytes is decided; a bucket of one suffix, or of suffixes alike in all that is asked, needs no further
round. The pointers are content hashes, so tasks agree on them without a table of pointers, and a round's longer
identifiers are put together from the pointers that exist already.

Not every suffix is sorted. Of the pointers inside a string the smallest marks its *anchor*, which depends on the
string alone, so equal strings meet at their anchors, one suffix in about thirty. An anchor stands for the ``width``
strings around it that can have it. The first round asks for all of them at once: a later anchor with the same
surroundings repeats all its strings. Where a bucket holds different surroundings, the strings of its anchors are
refined in ``PARTS`` groups of offsets, and where those differ too, one by one. That is exact up to the hashes, of
which 111 bits enter every comparison.

Rounds read the texts from one shuffle by document. A task compares what it has read before it reports, and reports
a bucket once, so a bucket that a third of all texts share sends about a row per task and no task collects it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.llm import blocks
from mapaudit.llm.text import U64, chunks, mix


@dataclass(frozen=True)
class StringConfig:
    length: int = 100  # bytes of the strings that are compared
    gram: int = 37  # bytes of the initial buckets

    @property
    def width(self) -> int:
        """Offsets that an anchor can have in a string."""
        return self.length - self.gram + 1


DEFAULT = StringConfig()
CHUNK_BYTES = 1 << 20
HELD_ROWS = 1 << 15  # reported buckets that a task remembers
REPORT_ROWS = 1 << 18  # rows that it gathers before it writes them
PARTS = 8
_LAST_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A mark is position << 32 | undecided << 31 | part << 24 | the document's checksum; part 0 is all offsets of the
#: anchor, then PARTS groups of them, then single ones.
_UNDECIDED = 1 << 31
_TAG = (1 << 24) - 1


@dataclass
class Piece:
    """A stretch of texts in memory: whole ones, or a part of a very long one with enough bytes on both sides."""

    doc: np.ndarray  # of each text
    tag: np.ndarray
    at: np.ndarray  # row of the batch
    data: np.ndarray
    offsets: np.ndarray
    base: int  # position of the first byte in its text
    core: tuple[int, int]  # positions that this piece answers for


def _pieces(batches: Iterator[pa.RecordBatch], cfg: StringConfig):
    margin = 3 * cfg.length
    for batch, data, offsets in chunks(batches, limit=CHUNK_BYTES):
        doc = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        tag = np.array([zlib.crc32(data[a:b]) & _TAG for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
        rows = np.arange(len(doc))
        if len(data) <= 2 * CHUNK_BYTES:
            yield batch, Piece(doc, tag, rows, data, offsets, 0, (0, len(data)))
            continue
        for a in range(0, len(data), CHUNK_BYTES):  # one very long text
            b = min(a + CHUNK_BYTES, len(data))
            lo, hi = max(0, a - margin), min(len(data), b + margin)
            yield batch, Piece(doc, tag, rows, data[lo:hi], np.array([0, hi - lo]), lo, (a, b))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, 2 * CHUNK_BYTES + 1000)
    if not _powers or next(iter(_powers)) < n:
        _powers.clear()
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[size] = tuple(tables)
    return next(iter(_powers.values()))


class Pointers:
    """Bucket pointers of every byte of a piece, and the anchors they make."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cfg: StringConfig):
        self.cfg, self.offsets = cfg, offsets
        n, q = len(data), cfg.gram
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(0xD1342543DE82EF95)) * up[:n], out=sums[1:])
        self.gram = mix((sums[q:] - sums[:-q]) * down[: n - q + 1]) if n >= q else np.zeros(0, U64)
        rank = (self.gram >> U64(32)).astype(np.uint32)
        for end in offsets[1:].tolist():  # no gram reaches into the next text
            rank[max(0, end - q + 1) : end] = 0xFFFFFFFF
        self.rank = rank
        self.least = self._slide(rank, np.minimum)

    def _slide(self, x: np.ndarray, pick) -> np.ndarray:
        """pick over every ``width`` neighbours."""
        width, step = self.cfg.width, 1
        if len(x) < width:
            return x[:0]
        while 2 * step <= width:
            x, step = pick(x[:-step], x[step:]), 2 * step
        return pick(x[: len(x) - (width - step)], x[width - step :]) if step < width else x

    def anchors(self) -> np.ndarray:
        """Bytes with the smallest pointer of some string; ties are all anchors."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        fill = np.zeros(self.cfg.width - 1, np.uint32)
        best = self._slide(np.concatenate([fill, self.least, fill]), np.maximum)
        return np.flatnonzero((best == self.rank) & (self.rank != 0xFFFFFFFF))

    def identifier(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        """Of stretches of at least ``gram`` bytes: the pointers at offsets of ``gram``, and the last that fits."""
        q = self.cfg.gram
        out = (end - start).astype(U64) * U64(0xBF58476D1CE4E5B9) + U64(seed)
        last = end - q
        for k in range(-(-int((end - start).max(initial=0)) // q)):
            out = mix((out + self.gram[np.minimum(start + k * q, last)]) * U64(_BASE))
        return out

    def strings(self, at: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray):
        """(index, inner, outer) of the groups of strings that have anchor ``at`` at offsets ``low`` to ``high``:
        identifiers of the bytes common to all of them, and of all their bytes. Groups without strings are left out."""
        size = self.cfg.length
        begin, end = self.offsets[text], self.offsets[text + 1]
        there = np.flatnonzero((np.maximum(at - high, begin) <= np.minimum(at - low, end - size)))
        at, low, high, begin, end = at[there], low[there], high[there], begin[there], end[there]
        kind = mix(part[there].astype(U64))
        inner = self.identifier(at - low, at - high + size, 1) ^ kind
        start, stop = np.maximum(at - high, begin), np.minimum(at - low + size, end)
        cut = (at - start).astype(U64) * U64(1 << 16) + (stop - at).astype(U64)
        outer = (mix(self.identifier(start, stop, 2) + cut) ^ kind) >> U64(16) | U64(1)
        return there, inner, outer

    def owns(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each anchor and offset, whether a string has the anchor there."""
        start = at[:, None] - np.arange(self.cfg.width)
        real = (start >= self.offsets[text][:, None]) & (start + self.cfg.length <= self.offsets[text + 1][:, None])
        return real & (self.least[np.where(real, start, 0)] == self.rank[at][:, None]) if len(self.least) else real


class Reporter:
    """Compares the groups of a task's pieces with each other; only what it can't decide is reported, in blocks dealt by
    bucket."""

    def __init__(self, parts: int):
        self.parts = U64(parts)
        self.held = tuple(np.zeros(0, d) for d in (U64, U64, np.int64, np.int64))
        self.open: list[tuple] = []
        self.done: list[tuple] = []
        self.rows = 0

    def add(self, doc: np.ndarray, mark: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[pa.RecordBatch]:
        old = len(self.held[0])
        inner, outer, doc, mark = (np.concatenate(x) for x in zip(self.held, (inner, outer, doc, mark)))
        by = np.lexsort((mark, doc, outer, inner))
        inner, outer, doc, mark, held = inner[by], outer[by], doc[by], mark[by], (np.arange(len(by)) < old)[by]
        bucket, alike, first, mixed, number = _compared(inner, outer, doc, mark)
        known = (np.bincount(number, held & (outer == 0)) > 0)[number]
        fresh = ~held & (outer != 0)
        done = fresh & (mixed | ~first)
        report = fresh & ~done
        named = np.flatnonzero(mixed & ~known & bucket)  # one row without a place tells that a bucket is mixed
        several = (np.bincount(number) > 1)[number]
        memory = np.flatnonzero((bucket & mixed) | (several & ~mixed & alike))[-HELD_ROWS:]
        zero = mixed[memory]
        self.held = inner[memory], np.where(zero, U64(0), outer[memory]), np.where(zero, 0, doc[memory]), np.where(zero, -1, mark[memory])

        self.done.append((doc[done], mark[done] | np.where(first[done], _UNDECIDED, 0)))
        self.open.append((inner[report], outer[report], doc[report], mark[report]))
        none = np.zeros(len(named), np.int64)
        self.open.append((inner[named], none.view(U64), none, none - 1))
        self.rows += len(by) - old
        if self.rows > REPORT_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        inner, outer, doc, mark = (np.concatenate(x) for x in zip(*self.open)) if self.open else self.held
        part = (mix(inner) % self.parts).astype(np.int64)
        by = np.lexsort((mark, doc, part))  # places in order are small differences
        yield blocks.write(part[by], _OPEN, [x[by] for x in (doc, mark >> 32, mark & 0xFFFFFFFF, inner, outer)])
        doc, mark = (np.concatenate(x) for x in zip(*self.done)) if self.done else self.held[2:]
        part = (mix(doc.view(U64)) % self.parts).astype(np.int64)
        by = np.lexsort((mark, doc, part))
        yield blocks.write(part[by], _DONE, [x[by] for x in (doc, mark >> 32, mark & 0xFFFFFFFF)])
        self.open, self.done, self.rows = [], [], 0


def _compared(inner: np.ndarray, outer: np.ndarray, doc: np.ndarray, mark: np.ndarray):
    """Of sorted rows: whether each begins a bucket, begins a class of one, is at the earliest place of its class, is in a
    bucket of several classes; and the bucket's number. Rows of one place are all earliest."""
    n = len(inner)
    bucket, alike = np.ones(n, bool), np.ones(n, bool)
    bucket[1:] = inner[1:] != inner[:-1]
    alike[1:] = bucket[1:] | (outer[1:] != outer[:-1])
    lead = np.maximum.accumulate(np.where(alike, np.arange(n), 0))
    number = np.cumsum(bucket) - 1
    return bucket, alike, (doc == doc[lead]) & (mark == mark[lead]), (np.bincount(number, alike) > 1)[number], number


_OPEN, _DONE = 0, 1  # kinds of blocks: (document, position, rest of the mark, inner, outer), (document, position, rest)


def _bounds(part: np.ndarray, cfg: StringConfig) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset that a part stands for."""
    edge = np.linspace(0, cfg.width, PARTS + 1).astype(np.int64)
    group = np.clip(part - 1, 0, PARTS - 1)
    single = part - 1 - PARTS
    low = np.where(part == 0, 0, np.where(part <= PARTS, edge[group], single))
    high = np.where(part == 0, cfg.width - 1, np.where(part <= PARTS, edge[group + 1] - 1, single))
    return low, high


def _first_round(texts: DataFrame, cfg: StringConfig) -> DataFrame:
    parts = blocks.part_count(texts.sparkSession)

    def run(batches):
        reporter = Reporter(parts)
        for _, p in _pieces(batches, cfg):
            pointers = Pointers(p.data, p.offsets, cfg)
            at = pointers.anchors()
            at = at[(at + p.base >= p.core[0]) & (at + p.base < p.core[1])]
            text = np.searchsorted(p.offsets, at, "right") - 1
            none = np.zeros(len(at), np.int64)
            there, inner, outer = pointers.strings(at, text, none, none + cfg.width - 1, none)
            at, text = at[there], text[there]
            mark = (at - p.offsets[text] + p.base) << 32 | p.tag[text]
            yield from reporter.add(p.doc[text], mark, inner, outer)
        yield from reporter.flush()

    return texts.mapInArrow(run, blocks.SCHEMA)


def _marks_of(batch: pa.RecordBatch, names: list[str], rows: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into rows, mark) of all marks of those rows that were made for the same text."""
    owner, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name in names:
        column = batch.column(name).take(pa.array(rows))
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        owner.append(np.repeat(np.arange(len(rows)), counts))
        marks.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    owner, marks = np.concatenate(owner), np.concatenate(marks)
    same = marks & _TAG == tags[owner]
    return owner[same], marks[same]


def _next_round(marked: DataFrame, cfg: StringConfig, single: bool) -> DataFrame:
    """Refines what the round before left undecided: anchors by groups of offsets, or groups by single offsets."""

    parts = blocks.part_count(marked.sparkSession)

    def run(batches):
        reporter = Reporter(parts)
        for batch, p in _pieces(batches, cfg):
            owner, marks = _marks_of(batch, ["marks"], p.at, p.tag)
            at = (marks >> 32) - p.base
            use = (marks & _UNDECIDED != 0) & (at + p.base >= p.core[0]) & (at + p.base < p.core[1])
            owner, marks = owner[use], marks[use]
            at = at[use] + p.offsets[owner]
            pointers = Pointers(p.data, p.offsets, cfg)
            if not len(at) or not len(pointers.least):
                continue
            owns = pointers.owns(at, owner)
            if single:
                low, high = _bounds(marks >> 24 & 127, cfg)
                offset = np.arange(cfg.width)
                which, part = np.nonzero(owns & (offset >= low[:, None]) & (offset <= high[:, None]))
                part = part + 1 + PARTS
            else:
                edge = np.linspace(0, cfg.width, PARTS + 1).astype(np.int64)
                which, part = np.nonzero(np.logical_or.reduceat(owns, edge[:-1], axis=1))
                part = part + 1
            low, high = _bounds(part, cfg)
            there, inner, outer = pointers.strings(at[which], owner[which], low, high, part)
            which, part = which[there], part[there]
            mark = marks[which] & ~np.int64(_UNDECIDED | 127 << 24) | part.astype(np.int64) << 24
            yield from reporter.add(p.doc[owner[which]], mark, inner, outer)
        yield from reporter.flush()

    return marked.mapInArrow(run, blocks.SCHEMA)


def _decided(reports: DataFrame, name: str) -> DataFrame:
    """``id, name``: per document the marks of repeated strings, and of those left undecided."""

    def run(batches):
        for kind, columns in blocks.read(batches, {_OPEN: 5, _DONE: 3}):
            doc, mark = columns[0].view(np.int64), (columns[1] << U64(32) | columns[2]).view(np.int64)
            if kind == _OPEN:
                inner, outer = columns[3:]
                by = np.lexsort((mark, doc, outer, inner))
                doc, mark, outer = doc[by], mark[by], outer[by]
                _, alike, first, mixed, _ = _compared(inner[by], outer, doc, mark)
                late, unsure = (outer != 0) & ~first, (outer != 0) & alike & mixed
                doc = np.concatenate([doc[late], doc[unsure]])
                mark = np.concatenate([mark[late], mark[unsure] | _UNDECIDED])
            order = np.argsort(doc, kind="stable")
            doc, mark = doc[order], mark[order]
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(doc)).astype(np.int32)), pa.array(mark))
            yield pa.RecordBatch.from_arrays([pa.array(doc[edge]), lists], ["id", "marks"])

    found = blocks.deal(reports).mapInArrow(run, "id long, marks array<long>")
    return found.groupBy("id").agg(F.flatten(F.collect_list("marks")).alias(name))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_LAST_ID)).cast("long").alias("id"), "doc_id", "text")


def repeated_strings(docs: DataFrame, cfg: StringConfig = DEFAULT) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every row: the maximal runs (start, end; bytes) of the text's UTF-8 form that
    lie in a string of ``length`` bytes which also starts earlier, and the bytes outside of them, which need not be
    whole characters.

    Earlier is a smaller doc_id, or the same one and a smaller start. Rows that share a doc_id rank as one place, so
    their equal texts do not remove each other; null ids rank after all others, as one place. Null and empty texts
    have no bytes, texts shorter than ``length`` lose none, an empty table stays empty. A text of any length is read in
    pieces. Other columns of ``docs`` are ignored.
    """
    texts = _texts(docs)
    dealt = texts.repartition("id")
    marks = [_decided(_first_round(texts.select("id", "text").where(F.octet_length("text") >= cfg.length), cfg), "marks")]
    for single in (False, True):
        unsure = marks[-1].where(F.exists("marks", lambda m: m.bitwiseAND(F.lit(_UNDECIDED)) != 0))
        joined = dealt.join(unsure, "id").select("id", "doc_id", "text", "marks")  # all columns: one shuffle serves every join
        marks.append(_decided(_next_round(joined, cfg, single), "marks"))
    names = [f"marks{k}" for k in range(3)]
    for name, found in zip(names, marks):
        dealt = dealt.join(found.withColumnRenamed("marks", name), "id", "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, data, offsets in chunks(batches, limit=CHUNK_BYTES):
            n = batch.num_rows
            edges = offsets.tolist()
            tags = np.array([zlib.crc32(data[a:b]) & _TAG for a, b in zip(edges, edges[1:])], np.int64)
            owner, found = _marks_of(batch, names, np.arange(n), tags)
            use = found & _UNDECIDED == 0
            owner, found = owner[use], found[use]
            low, high = _bounds(found >> 24 & 127, cfg)
            at = found >> 32
            size = np.diff(offsets)[owner]
            start, stop = np.maximum(at - high, 0), np.minimum(at - low + cfg.length, size)
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, start + offsets[owner], 1)
            np.add.at(depth, stop + offsets[owner], -1)
            gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
            fresh = np.ones(len(data) + 1, bool)
            fresh[1:-1] = gone[1:] != gone[:-1]
            fresh[offsets] = True
            bound = np.flatnonzero(fresh)
            a, b = bound[:-1], bound[1:]
            a, b = a[gone[a]], b[gone[a]]
            row = np.searchsorted(offsets, a, "right") - 1
            items = pa.StructArray.from_arrays([pa.array(a - offsets[row]), pa.array(b - offsets[row])], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), items)
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            rest = data[~gone].tobytes()
            kept = pa.array([rest[x:y] for x, y in zip(left[:-1].tolist(), left[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), spans.cast(span), kept], ["doc_id", "n_bytes", "removed", "kept"])

    return dealt.select("doc_id", "text", *names).mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of a table of ``repeated_strings``."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
