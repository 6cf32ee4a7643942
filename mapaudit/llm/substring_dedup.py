"""Substring dedup by hashing of lines and their sentences.

A text is cut into units: lines, and within lines the stretches that begin after a sentence end or with a
capitalised word, so a passage is found wherever it stands in a line. Each unit is normalised (ASCII lower
case, single spaces) and hashed. The earliest occurrence of a digest, by doc_id and then by place, stays;
a run of later ones in a row with enough words is removed. Spans are offsets into the original text.

Beside units, stretches of ``shingle`` tokens from anchor tokens on are looked up. An anchor has the smallest
hash of some ``window`` neighbours (winnowing), so anchors inside a passage do not depend on what is around it,
and at most ``3 * (window - 1)`` of its tokens, all at its two ends, escape, wherever it begins and ends.
A token is a word; in scripts without spaces it is a code point, and ``run_chars`` of them are enough words.
A whole line of ``line_chars`` code points that repeats an earlier one is removed by itself.

A task reports a digest once per chunk, with its earliest place there; what it has itself seen to be a
repeat needs no comparing. So a line of very many documents meets itself once per chunk, not once per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.llm.text import LOWER, SPACE, U64, chunks, code_points, mix, row_edges, rows_of, span_hashes, words


@dataclass(frozen=True)
class DedupConfig:
    run_words: int = 25  # a run of repeated units is removed from so many words on
    run_chars: int = 100  # the same in code points of scripts without spaces; a mixed run counts both parts
    line_chars: int = 100  # a repeated whole line is removed from so many code points on
    unit_words: int = 3  # shorter units are not looked up; they go only as part of a shingle or line that repeats
    window: int = 9  # of so many neighbours one is an anchor
    shingle: int = 16  # tokens looked up from an anchor on; at least window


DEFAULT = DedupConfig()
_MOST_JOINED = 16  # short units joined to one, on average
_LONG = 24  # words from which a unit is cut again
_SHINGLE = 1 << 29  # added to the number of a shingle's first token, to tell it from a unit's number
_LINE = 1 << 30  # the same for a line

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?;:"]] = True


@dataclass
class Units:
    row: np.ndarray  # text
    index: np.ndarray  # number in the text, from 0
    start: np.ndarray  # bytes, first word
    end: np.ndarray  # bytes, last word
    size: np.ndarray  # words
    digest: np.ndarray


def units(data: np.ndarray, offsets: np.ndarray, unit_words: int) -> Units:
    """The units of every text of a chunk, in order. Short ones in a row become one, up to a word that its
    hash picks, so that texts of one-word sentences have units to look up too; long ones are cut before such
    words, so that an edit does not hide the rest of a long sentence."""
    starts, ends, row = words(data, offsets)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if not n:
        return Units(none, none, none, none, none, none.view(U64))
    hashes = span_hashes(LOWER[data], starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two, three = (padded[np.minimum(starts + k, len(data))] for k in range(3))
    accent = (one == 0xC3) & (two >= 0x80) & (two <= 0x9E)
    capital = (_UPPER[one] & ~_UPPER[two]) | (accent & ~_UPPER[three])
    opens = np.ones(n, bool)
    opens[1:] = (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[ends[:-1]]) | _ENDS[data[ends[:-1] - 1]] | capital[1:]
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, n))
    opens |= np.repeat(size > _LONG, size) & (hashes % U64(_LONG // 3) == 0)
    first = np.flatnonzero(opens)
    short = np.diff(np.append(first, n)) < unit_words
    line_of = lines[starts[first]]
    joins = np.zeros(len(first), bool)
    joins[1:] = short[1:] & short[:-1] & (row[first[1:]] == row[first[:-1]]) & (line_of[1:] == line_of[:-1])
    joins &= hashes[first] % U64(_MOST_JOINED) != 0
    first = first[~joins]
    after = np.append(first[1:], n)
    owner = row[first]
    index = np.arange(len(first)) - row_edges(owner, len(offsets) - 1)[owner]
    return Units(owner, index, starts[first], ends[after - 1], after - first, span_hashes(hashes, first, after))


@dataclass
class Tokens:
    start: np.ndarray  # bytes
    end: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    dense: np.ndarray  # a code point of a script without spaces


#: First and last code points of scripts that put no space between words, with their marks.
_DENSE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]


def _dense(data: np.ndarray) -> np.ndarray:
    """Whether a code point of such a script begins at each byte."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xE0)
    wide = data[at] >= 0xF0
    raw = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b = [raw[at + k] & 0x3F for k in range(4)]
    point = np.where(wide, (raw[at] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], (raw[at] & 15) << 12 | b[1] << 6 | b[2])
    for lo, hi in _DENSE:
        out[at] |= (point >= lo) & (point <= hi)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, row = words(data, offsets)
    dense = np.zeros(len(starts), bool)
    if len(starts) and (data >= 0xE0).any():
        begins = _dense(data)
        point = np.flatnonzero((data & 0xC0) != 0x80)
        after = np.zeros(len(data), bool)
        after[point[1:]] = begins[point[:-1]]
        cuts = np.flatnonzero((begins | after) & ~SPACE[data])
        if len(cuts):
            starts = np.union1d(starts, cuts)
            bound = ends[np.searchsorted(ends, starts, "right")]
            ends = np.minimum(np.append(starts[1:], len(data)), bound)
            row, dense = rows_of(offsets, starts), begins[starts]
    return Tokens(starts, ends, row, span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, U64), dense)


def _lines(data: np.ndarray, t: Tokens, cfg: DedupConfig) -> tuple[np.ndarray, np.ndarray]:
    """First tokens, and the tokens after the last ones, of the lines that are long enough."""
    if not len(t.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.concatenate([[0], np.cumsum(data == 10)])[t.start]
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (t.row[1:] != t.row[:-1])]))
    after = np.append(first[1:], len(t.start))
    points = code_points(data)
    long = points[t.end[after - 1]] - points[t.start[first]] >= cfg.line_chars
    return first[long], after[long]


def _line_digests(t: Tokens, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(span_hashes(t.hashes, first, after) + U64(_LINE))


def _shingle_digests(t: Tokens, at: np.ndarray, cfg: DedupConfig) -> np.ndarray:
    return mix(span_hashes(t.hashes, at, at + cfg.shingle) + U64(_SHINGLE))


def anchors(t: Tokens, cfg: DedupConfig) -> np.ndarray:
    """Tokens that a shingle begins with: the first smallest hash of every window inside a text."""
    n = len(t.start)
    if n < cfg.shingle:
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(t.row[: n - cfg.window + 1] == t.row[cfg.window - 1 :])
    at = np.unique(begin + np.lib.stride_tricks.sliding_window_view(t.hashes, cfg.window)[begin].argmin(axis=1))
    at = at[at <= n - cfg.shingle]
    return at[t.row[at] == t.row[at + cfg.shingle - 1]]


def _reports(docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """``key, doc_id, idx, digest, local``: each chunk's earliest place of a digest, and its later ones as
    local repeats under a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, data, offsets in chunks(batches):
            u = units(data, offsets, cfg.unit_words)
            long = u.size >= cfg.unit_words
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            t = tokens(data, offsets)
            at = anchors(t, cfg)
            first, after = _lines(data, t, cfg)
            edges = row_edges(t.row, batch.num_rows)
            doc = ids[np.concatenate([u.row[long], t.row[at], t.row[first]])]
            index = np.concatenate([u.index[long], at - edges[t.row[at]] + _SHINGLE, first - edges[t.row[first]] + _LINE])
            digest = np.concatenate([u.digest[long], _shingle_digests(t, at, cfg), _line_digests(t, first, after)])
            by = np.lexsort((index, doc, digest))
            doc, index, digest = doc[by], index[by], digest[by]
            new = np.ones(len(by), bool)
            new[1:] = digest[1:] != digest[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            local = (doc != doc[lead]) | (index != index[lead])
            own = mix(mix(doc.view(U64)) + index.astype(U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(local, own, digest).view(np.int64)), pa.array(doc), pa.array(index.astype(np.int32)),
                 pa.array(digest.view(np.int64)), pa.array(local)], ["key", "doc_id", "idx", "digest", "local"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "key long, doc_id long, idx int, digest long, local boolean")


def repeats(docs: DataFrame, cfg: DedupConfig = DEFAULT) -> DataFrame:
    """``doc_id, marks``: the units, shingles and lines of each text that repeat an earlier one, as array of (idx, digest)."""
    order = Window.partitionBy("key").orderBy("doc_id", "idx")
    late = _reports(docs, cfg).withColumn("place", F.rank().over(order)).where("local or place > 1")
    return late.groupBy("doc_id").agg(F.collect_list(F.struct("idx", "digest")).alias("marks"))


def _stretches(row: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the longest stretches of tokens of one text that are alike covered or not."""
    fresh = np.ones(len(row) + 1, bool)
    fresh[1:-1] = (row[1:] != row[:-1]) | (covered[1:] != covered[:-1])
    edges = np.flatnonzero(fresh)
    return edges[:-1], edges[1:]


def _removed(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, idx: np.ndarray, digest: np.ndarray, cfg: DedupConfig) -> list[list[tuple[int, int]]]:
    """The spans (bytes of each text) to remove. ``counts`` marks belong to each text, in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(counts))]
    u, t = units(data, offsets, cfg.unit_words), tokens(data, offsets)
    n = len(t.start)
    if not n or not len(idx):
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    idx, digest = idx.astype(np.int64), digest.view(U64)
    edges, unit_edges = row_edges(t.row, len(counts)), row_edges(u.row, len(counts))
    depth = np.zeros(n + 1, np.int64)
    bounds = np.searchsorted(t.start, u.start), np.searchsorted(t.start, u.end)

    whole = idx < _SHINGLE
    unit = unit_edges[owner[whole]] + idx[whole]
    real = unit < unit_edges[owner[whole] + 1]
    unit, wanted = unit[real], digest[whole][real]
    unit = unit[u.digest[unit] == wanted]
    np.add.at(depth, bounds[0][unit], 1)
    np.add.at(depth, bounds[1][unit], -1)

    line = idx >= _LINE
    at = edges[owner[line]] + idx[line] - _LINE
    first, after = _lines(data, t, cfg)
    k = np.minimum(np.searchsorted(first, at), max(len(first) - 1, 0))
    alone = np.zeros(n + 1, np.int64)
    if len(first):
        k = k[(first[k] == at) & (t.row[first[k]] == owner[line]) & (_line_digests(t, first, after)[k] == digest[line])]
        np.add.at(alone, first[k], 1)
        np.add.at(alone, after[k], -1)
    depth += alone
    alone = np.cumsum(alone[:-1]) > 0

    part = (idx >= _SHINGLE) & ~line
    at = edges[owner[part]] + idx[part] - _SHINGLE
    real = at + cfg.shingle <= edges[owner[part] + 1]
    at, wanted = at[real], digest[part][real]
    at = at[_shingle_digests(t, at, cfg) == wanted]
    np.add.at(depth, at, 1)
    np.add.at(depth, at + cfg.shingle, -1)
    covered = np.cumsum(depth[:-1]) > 0

    lo, hi = _stretches(t.row, covered)
    weight = np.where(t.dense, cfg.run_words, cfg.run_chars)
    far = covered[lo] & (np.add.reduceat(weight, lo) >= cfg.run_words * cfg.run_chars)
    taken = np.repeat(far, hi - lo) | alone
    lo, hi = _stretches(t.row, taken)
    far = taken[lo]
    for a, b in zip(lo[far].tolist(), hi[far].tolist()):
        row = int(t.row[a])
        out[row].append((int(t.start[a] - offsets[row]), int(t.end[b - 1] - offsets[row])))
    return out


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the spans and the blanks after them; a line that is emptied goes with its line feed."""
    out, at = [], 0
    for a, b in spans:
        while b < len(text) and text[b] in b" \t\r":
            b += 1
        if (a == 0 or text[a - 1] == 10) and b < len(text) and text[b] == 10:
            b += 1
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


def _apply(docs: DataFrame, cfg: DedupConfig, schema: str, columns) -> DataFrame:
    """Joins the marks to the texts and maps each chunk with its removed spans (bytes of each text)."""
    name = "marks"
    while name in docs.columns:
        name += "_"
    marks = repeats(docs, cfg).select(F.col("doc_id").alias(f"{name}_id"), F.col("marks").alias(name))
    joined = docs.join(marks, docs["doc_id"] == marks[f"{name}_id"], "left").drop(f"{name}_id")

    def run(batches):
        for batch, data, offsets in chunks(batches):
            found = batch.column(name)
            counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            pairs = found.flatten()
            idx, digest = (pairs.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            removed = _removed(data, offsets, counts, idx, digest, cfg)
            yield columns(batch.drop_columns([name]), data, offsets, removed)

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, cfg: DedupConfig = DEFAULT) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all rows and columns stay.

    Rows without doc_id or text stay as they are and rank nothing. Rows that share a doc_id rank as one
    place, so repeated rows keep the same passages. A text that only repeats becomes empty.
    """
    names = docs.columns

    def columns(batch, data, offsets, removed):
        if any(removed):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(removed):
                if spans:
                    texts[i] = _cut_out(data[offsets[i] : offsets[i + 1]].tobytes(), spans).decode()
            batch = batch.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        return batch

    return _apply(docs, cfg, docs.schema, columns)


def removed_passages(docs: DataFrame, cfg: DedupConfig = DEFAULT) -> DataFrame:
    """``doc_id, text, n_removed, removed`` of every row: the text without its repeated passages, and their
    (start, end) in code points of the original text. Cases as in ``remove_repeats``."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def columns(batch, data, offsets, removed):
        texts, spans = batch.column("text").to_pylist(), []
        for i, row in enumerate(removed):
            raw = data[offsets[i] : offsets[i + 1]]
            if row:
                texts[i] = _cut_out(raw.tobytes(), row).decode()
                before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                row = [{"start": int(before[a]), "end": int(before[b])} for a, b in row]
            spans.append(row)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span)],
            ["doc_id", "text", "n_removed", "removed"])

    schema = "doc_id long, text string, n_removed long, removed array<struct<start:long,end:long>>"
    return _apply(docs.select("doc_id", "text"), cfg, schema, columns)
