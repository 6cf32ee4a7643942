"""BPE encoding by speculation and verification, and decoding.

A distinct word is first cut greedily into the longest known tokens. That guess is the exact encoding if
every token encodes to itself and every two neighbours are compatible, which means that no merge across
their border comes before the merges that closed the border. Both tests are array lookups over all new
words of a batch at once. Only words that fail are merged exactly, pair by pair.

Texts are normalised and split into words as the tokenizer file says (NFC, white space, lower case, its
split pattern). A word's result is kept in a bounded table of the task, so a word costs one lookup.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_WORDS = 1 << 19  # in each of two generations of the word table
_NEVER = np.iinfo(np.int64).max
#: Beyond these code points the library itself normalises and splits, as character tables may differ.
_SHOWN = "\uffff"
_PLAIN = regex.compile("[\x00-ɏ]*")


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 as it
    is, the others in order from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.surface = [""] * self.size
        for text, i in (vocab | self.special).items():
            self.surface[i] = text
        self.alphabet = byte_alphabet()
        self.vocab = vocab
        cut = len(self.suffix)
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.suffix)}
        self.final = {t[:-cut]: i for t, i in vocab.items() if t.endswith(self.suffix)}
        self.longest = max(map(len, self.inner))
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.made = {p: vocab[self.surface[p[0]] + self.surface[p[1]]] for p in self.rank}
        self._tables()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.failed = 0

    def _tables(self) -> None:
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        ranks = np.array(list(self.rank.values()), np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        by = np.argsort(keys)
        self.keys, self.key_rank = keys[by], ranks[by]
        born = np.full(self.size, -1, np.int64)  # rank of the merge that makes a token
        halves = np.full((self.size, 2), -1, np.int64)
        for (a, b), k in self.rank.items():
            t = self.made[a, b]
            if born[t] < 0:
                born[t], halves[t] = k, (a, b)
        self.born = born
        # Tokens that may touch a border: the token, its last (first) half, that one's last (first) half ...
        self.right, self.left = (self._spine(halves[:, side]) for side in (1, 0))
        # A token encodes to itself if its halves do and no merge across their border comes before its own.
        good = np.ones(self.size, bool)
        merged = np.flatnonzero(born >= 0)
        good[merged] = ~self._crossed(halves[merged, 0], halves[merged, 1], born[merged])
        proper = (born[halves[merged, 0]] < born[merged]) & (born[halves[merged, 1]] < born[merged])
        good[merged] &= proper
        for t in merged[np.argsort(born[merged])]:
            good[t] &= good[halves[t, 0]] & good[halves[t, 1]]
        self.good = good

    def _spine(self, half: np.ndarray) -> np.ndarray:
        rows = [np.arange(self.size)]
        while (rows[-1] >= 0).any():
            rows.append(np.where(rows[-1] >= 0, half[rows[-1]], -1))
        return np.stack(rows[:-1])

    def _crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = _NEVER) -> np.ndarray:
        """For every pair of tokens: does a merge across their border come first, and before ``before``?"""
        bad = np.zeros(len(a), bool)
        open_a = np.full(len(a), _NEVER)
        for i in range(len(self.right)):
            x = self.right[i][a]
            if not (x >= 0).any():
                break
            open_b = np.full(len(a), _NEVER)
            for j in range(len(self.left)):
                y = self.left[j][b]
                alive = np.flatnonzero((x >= 0) & (y >= 0) & ~bad)
                if not len(alive):
                    break
                key = x[alive] * self.size + y[alive]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[at] == key, self.key_rank[at], _NEVER)
                limit = before if np.isscalar(before) else before[alive]
                bad[alive] = (rank < open_a[alive]) & (rank <= open_b[alive]) & (rank < limit)
                open_b = np.where(y >= 0, self.born[y], open_b)
            open_a = np.where(x >= 0, self.born[x], open_a)
        return bad

    def _propose(self, word: str) -> list[int] | None:
        out, at, n = [], 0, len(word)
        while at < n:
            if (token := self.final.get(word[at:])) is not None:
                out.append(token)
                return out
            for to in range(min(n - 1, at + self.longest), at, -1):
                if (token := self.inner.get(word[at:to])) is not None:
                    out.append(token)
                    at = to
                    break
            else:
                return None
        return None

    def _merge(self, word: str) -> list[int]:
        """Exact merging: the first of the lowest-ranked pairs, again and again. Unknown symbols go."""
        symbols = [*word[:-1], word[-1] + self.suffix] if word else []
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        while len(ids) > 1:
            ranks = [self.rank.get(p, _NEVER) for p in zip(ids, ids[1:])]
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[ids[at], ids[at + 1]]]
        return ids

    def _guess(self, words: list[str]) -> list[list[int]]:
        """Encodes byte-level words: guesses, tests all neighbours at once, merges what failed."""
        guesses = [self._propose(w) for w in words]
        sizes = np.array([len(g) if g else 0 for g in guesses])
        ids = np.array([i for g in guesses if g for i in g], np.int64)
        ok = sizes > 0
        if len(ids):
            owner = np.repeat(np.arange(len(words)), sizes)
            ok[owner[~self.good[ids]]] = False
            near = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(ids[near] * self.size + ids[near + 1], return_inverse=True)
            bad = self._crossed(pairs // self.size, pairs % self.size)
            ok[owner[near[bad[back]]]] = False
        self.failed += int((~ok).sum())
        return [g if fine else self._merge(w) for w, g, fine in zip(words, guesses, ok)]

    def _learn(self, words: set[str]) -> None:
        """Puts the words into the table. A full table becomes the older generation, whose words come back
        when they are met again."""
        if len(self.words) + len(words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        new = []
        for w in words:
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.words[w] = ids
        for w, ids in zip(new, self._guess([self._visible(w) for w in new])):
            self.words[w] = np.array(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, those split by the library marked and in byte-level form."""
        if _PLAIN.fullmatch(text):
            return self.split.findall(unicodedata.normalize("NFC", text).lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [_SHOWN + w for w, _ in shown]

    def _visible(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        if piece[0] == _SHOWN:
            return piece[1:]
        return "".join(self.alphabet[b] for b in piece.encode())

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers. Null counts as empty."""
        cut: list[list] = []
        for text in texts:
            parts = self.at_special.split(text or "")
            cut.append([self.special[p] if p in self.special else self._pieces(p) for p in parts])
        met = {w for parts in cut for p in parts if isinstance(p, list) for w in p}
        if new := met - self.words.keys():
            self._learn(new if len(self.words) + len(new) <= CACHE_WORDS else met)
        get = self.words.__getitem__
        return [b"".join(np.uint32(p).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in parts) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own texts, byte-level letters and word ends included, with a space between: what a
        tokenizer file without a decoder gives. Ids outside the vocabulary are left out."""
        surface, size = self.surface, self.size
        return " ".join([surface[i] for i in ids.tolist() if i < size and surface[i]])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _texts(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """Row number and texts, in groups of about ``limit`` characters."""
    column, at, group, size = batch.column("text"), 0, [], 0
    for i, value in enumerate(column):
        group.append(value.as_py())
        size += len(group[-1] or "")
        if size >= limit:
            yield at, group
            at, group, size = i + 1, [], 0
    if group:
        yield at, group


def _map(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, texts in _texts(batch):
                made = columns(load(path), texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *made],
                                                 [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every row: the whole text's tokens. Null and empty texts give an
    empty list. Repeated rows and null ids stay as they are; other columns are ignored."""

    def columns(bpe, texts):
        ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in bpe.encode_batch(texts)]
        return [pa.array(ids, pa.list_(pa.int32()))]

    return _map(docs, path, "doc_id long, ids array<int>", columns)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id, ids``. Null ids give a null text."""

    def run(batches):
        for batch in batches:
            bpe = load(path)
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes every whole text and decodes it again."""

    def columns(bpe, texts):
        ids = bpe.encode_batch(texts)
        back = [bpe.decode(np.frombuffer(b, "<u4")).encode() for b in ids]
        return [pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                pa.array([hashlib.sha256(t).hexdigest() for t in back])]

    return _map(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
