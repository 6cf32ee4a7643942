"""Best-fit packing of token sequences with large-item matching.

A piece above a third of the capacity shares a sequence with at most one other such piece: they are
matched greedily, each with the largest partner that fits. Smaller pieces then go, from long to short,
into the tightest gap that holds them. Which pieces go together depends on their lengths only, so the
plan is made on the counts of at most ``capacity`` lengths, as ranges of ranks. Its size does not grow
with the data. Every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.llm.bpe import _texts
from mapaudit.llm.text import span_hashes
from mapaudit.session import cut

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked in one go.
RANK_ROWS = 50_000
CACHE_WORDS = 1 << 20
LONG_WORD = 64  # bytes
WORDS_A_LINE = 256
_SPACE = "\u0120"  # fixed value: how byte-level vocabularies write a space
#: Texts beyond these characters, or with a special token, go to the library whole.
_PLAIN = re.compile("[\t\n\r -~\xa1-\u024f]*")


def _kinds() -> np.ndarray:
    """Of the plain characters: 0 white space, 1 letters, 2 digits, 3 all others."""
    kind = {"L": 1, "N": 2}
    return np.array([0 if c in "\t\n\r " else kind.get(unicodedata.category(c)[0], 3) for c in map(chr, range(0x250))], np.uint8)


_KINDS = _kinds()


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words that byte-level BPE files of this kind merge within, in plain texts that are not empty: letters,
    digits or other marks with at most one space before them, and white space, of which the last character goes with a
    following word if it is a space, and else is a word of its own. A stretch without white space that holds an
    apostrophe stays whole, as contractions are cut there; the library cuts it."""
    kind = _KINDS[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _KINDS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    n = len(data)
    fresh = np.ones(n + 1, bool)
    fresh[1:-1] = kind[1:] != kind[:-1]
    fresh[offsets] = True
    blank = kind == 0
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~_edges(offsets, n)[1:-1])  # white space before a word
    fresh[last] = True
    fresh[last[data[last] == 0x20] + 1] = False
    mark = np.flatnonzero(data == 0x27)
    if len(mark):
        edge = np.flatnonzero(_edges(offsets, n) | np.concatenate([[True], blank[1:] != blank[:-1], [True]]))
        k = np.unique(np.searchsorted(edge, mark, "right") - 1)
        for x, y in zip(edge[k].tolist(), edge[k + 1].tolist()):
            fresh[x + 1 : y] = False
    bounds = np.flatnonzero(fresh)
    return bounds[:-1], bounds[1:]


def _edges(offsets: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    return out


class Tokens:
    """Token ids by the tokenizers library, asked once for each distinct word of a bounded table. Words are told apart by
    64-bit hashes; long ones are not kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, starts and counts of ids
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and the count of each. A space and letters are asked for in lines, which split back
        into such words at tokens that begin with a space."""
        spaced = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        lines = [spaced[i : i + WORDS_A_LINE] for i in range(0, len(spaced), WORDS_A_LINE)]
        out: list = [None] * len(words)
        for line, e in zip(lines, self.library.encode_batch_fast(["".join([words[i] for i in x]) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            edge = np.flatnonzero(self.opens[ids])
            if len(edge) == len(line) and edge[0] == 0:
                for i, part in zip(line, np.split(ids, edge[1:])):
                    out[i] = part
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._ids([words[i] for i in rest])):
            out[i] = np.frombuffer(ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words that no table has; ``hashes`` are sorted. Tables of like size are merged."""
        if len(hashes) + sum(len(t[0]) for t in self.tables) > CACHE_WORDS:
            self.tables, self.ids = [], np.zeros(0, np.uint32)
        ids, count = self._word_ids(words)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        table = hashes, start, count
        while self.tables and len(self.tables[-1][0]) < 4 * len(table[0]):
            table = tuple(np.concatenate(x) for x in zip(self.tables.pop(), table))
            by = np.argsort(table[0], kind="stable")
            table = tuple(x[by] for x in table)
        self.tables.append(table)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start (-1: unknown) and count of the ids of each hash."""
        start, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, starts, counts in self.tables:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            start[hit], count[hit] = starts[at[hit]], counts[at[hit]]
        return start, count

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        a, b = _words(data, offsets)
        hashes, first, back = np.unique(span_hashes(data, a, b), return_index=True, return_inverse=True)
        long = b[first] - a[first] > LONG_WORD
        start, count = self._find(hashes)
        new = np.flatnonzero((start < 0) & ~long)
        if len(new):
            if len(new) + sum(len(t[0]) for t in self.tables) > CACHE_WORDS:
                new = np.flatnonzero(~long)  # the tables are given up: all words of this batch again
            self._learn(hashes[new], [whole[x:y].decode() for x, y in zip(a[first[new]].tolist(), b[first[new]].tolist())])
            start, count = self._find(hashes)
        ids = self.ids
        if long.any():
            more, sizes = self._word_ids([whole[x:y].decode() for x, y in zip(a[first[long]].tolist(), b[first[long]].tolist())])
            start[long], count[long] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, more])
        start, count = start[back], count[back]
        to = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.arange(to[-1]) + np.repeat(start - to[:-1], count)]
        edges = to[np.searchsorted(a, offsets)].tolist()
        flat = out.tobytes()
        return [flat[4 * x : 4 * y] for x, y in zip(edges, edges[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list = [b""] * len(texts)
        plain, other = [], []
        for i, text in enumerate(texts):
            if text:
                (plain if _PLAIN.fullmatch(text) and not any(s in text for s in self.special) else other).append(i)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
                out[i] = ids
        for i, ids in zip(other, self._ids([texts[i] for i in other])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every row of ``docs``.

    A document is its whole text's ids and ``end_id``; null text is empty. One that is longer than
    ``capacity`` is cut into pieces of ``capacity``, of which the first may be shorter. Repeated rows and
    null ids are documents of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for at, texts in _texts(batch, 1 << 20):
                rows, parts = [], []
                for i, ids in enumerate(load(path).encode(texts), at):
                    ids += np.uint32(end_id).tobytes()
                    size = len(ids) // 4
                    edge = [0, *range((size - 1) % capacity + 1, size + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edge, edge[1:])):
                        part = ids[4 * a : 4 * b]
                        rows.append((i, k, a, b - a, zlib.crc32(part)))
                        if with_ids:
                            parts.append(np.frombuffer(part, "<u4").astype(np.int32))
                owner, *rest = zip(*rows)
                columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): ``count`` pieces of ``length``, in rank order,
    go one each into as many sequences in a row, at ``offset``."""
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        out.append((length, rank[length], count, sequence, offset))
        rank[length] += count
        left[length] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            fits = (b for b in large if b <= min(a, capacity - a) and left[b] > (b == a))
            b = next(fits, None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, used, 0)
            if b is not None:
                put(b, n, used, a)
            gaps[capacity - a - (b or 0)].append((used, n))
            used += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            gap = next((g for g in range(a, capacity + 1) if gaps[g]), None)
            if gap is None:  # fill new sequences with this length
                each = capacity // a
                full, rest = divmod(left[a], each)
                for n, copies in ((full, each), (1, rest)):
                    if n and copies:
                        for k in range(copies):
                            put(a, n, used, k * a)
                        gaps[capacity - copies * a].append((used, n))
                        used += n
            else:
                first, n = gaps[gap].pop()
                if n > left[a]:
                    gaps[gap].append((first + left[a], n - left[a]))
                    n = left[a]
                put(a, n, first, capacity - gap)
                gaps[gap - a].append((first, n))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: every piece has one place, no sequence holds more
    than ``capacity`` tokens, and each is filled from 0 without gaps.

    ``parts`` needs ``doc_id, piece, start, length`` and is read twice, so pass a stored table. Pieces are
    ranked in groups of about RANK_ROWS rows by hash, so a length that very many share is spread. Equal
    rows are interchangeable. An empty table stays empty.
    """
    groups = max(1, parts.count() // RANK_ROWS)
    order = [c for c in parts.columns if c not in ("ids", "length")]
    rows = parts.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("rows"))
    sizes = cut(sizes, "sizes")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("rows")).collect()}
    places = [(*p[:2], p[1] + p[2], *p[3:]) for p in plan(counts, capacity)]
    ranges = parts.sparkSession.createDataFrame(places, "length long, low long, high long, first long, offset long")
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    ranked = rows.withColumn("rank", local).join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return (ranked.join(F.broadcast(ranges), (ranked["length"] == ranges["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            .select(*(ranked[c] for c in parts.columns), (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token sequences themselves, from packed pieces with ``ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row."""
    return pack(cut(pieces(docs, path, capacity, end_id), "pieces"), capacity)
