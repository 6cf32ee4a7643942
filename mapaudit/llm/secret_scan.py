"""Secret scan by one combined deterministic automaton.

All rules are compiled into a single minimal automaton that reads every byte once. Many stretches of a
chunk run side by side: a stretch begins after a byte that leads every state back to the first one (such
bytes are read off the transition array; a line feed between texts is one), so a cut loses nothing. The
pass yields, for each rule, the stretches that may hold a long enough match. Exact spans, leftmost and not
overlapping, are then walked there with each rule's own automaton. What a rule's ``tail`` matches after a
span belongs to it, over line ends too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.llm.automaton import Automaton, compile_all
from mapaudit.llm.text import chunks, code_points

LANE_BYTES = 512
#: The combined automaton counts a run this far; the walk counts the rest. It keeps counters of several
#: rules, which run side by side, from multiplying its states.
COUNTED = 8


@dataclass(frozen=True)
class Rule:
    """A match is the longest ``head`` and then the longest run of ``body`` bytes, one or more; it counts
    when the run has ``least`` bytes. What the head may end with in part is not in ``body``. ``tail``, a
    regex over the bytes that follow, lengthens a match."""

    kind: str
    head: str
    body: str
    least: int
    either_case: bool = False  # in the head
    tail: bytes = b""


# A key block: header lines and base64 up to its END mark, in quotes, comments or with written-out line feeds too;
# without that mark, the lines of base64 that follow.
_MARK = r"([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?"
_LINE_FEED = rb"(?:\r\n?|\n|(?:\\r)?\\n)"
_FIELD = rb"[A-Za-z][A-Za-z-]{0,30}: [^\r\n\\]*+"
_BEFORE = rb"[ \t\"'`>#*|+]{0,16}"
_BASE64 = rb"(?:[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]{0,15}[0-9+/][A-Za-z0-9+/]{0,15}={0,2}|[A-Za-z0-9+/]{1,15}={1,2}|=[A-Za-z0-9+/]{4})"
_LINE_END = rb"(?=[ \t\"'`,;+]*+(?:" + _LINE_FEED + rb"|\Z))"
_KEY_BLOCK = (
    rb"(?:" + _FIELD + rb"|[A-Za-z0-9+/=\s\"'`,;>#*|\\]|-(?!-))*+-----END " + _MARK.encode() + rb"-{5}"
    + rb"|(?:[ \t]+[A-Za-z0-9+/]{40,}+={0,2}|[ \t\"'`,;+]*" + _LINE_FEED + _BEFORE
    + rb"(?:" + _FIELD + rb"|" + _BASE64 + _LINE_END + rb"|" + _LINE_END + rb"))++")


# The three base rules, then the rules added to them.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=\\-]", 8, True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("pem", f"-----BEGIN {_MARK}", "[\\-]", 5, tail=_KEY_BLOCK),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_all([(f"{self._head(r)}{r.body}{{{min(r.least, COUNTED)}}}", False) for r in rules], search=True)
        self.resets = self.all.resets
        self.flat = self.all.move.reshape(-1)
        self.width = self.all.move.shape[1]
        self.heads = [compile_all([(r.head, r.either_case)]) if r.head else None for r in rules]
        self.bodies = [compile_all([(r.body, False)]) for r in rules]
        self.first = [self._first(h, b) for h, b in zip(self.heads, self.bodies)]
        self.tails = [re.compile(r.tail) if r.tail else None for r in rules]
        self.run = [b.accept[b.move[0, b.kind]] > 0 for b in self.bodies]

    @staticmethod
    def _head(rule: Rule) -> str:
        """The head with each letter outside a class as a class of both cases, where either may stand."""
        if not rule.either_case:
            return rule.head
        out, inside, skip = [], False, 0
        for i, c in enumerate(rule.head):
            inside = (inside or c == "[") and c != "]"
            if c == "\\":
                skip = 4 if rule.head[i + 1] == "x" else 2
            out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside and not skip else c)
            skip = max(0, skip - 1)
        return "".join(out)

    @staticmethod
    def _dead(automaton: Automaton) -> np.ndarray:
        """States that can reach no match."""
        alive = automaton.accept > 0
        while True:
            more = alive | alive[automaton.move].any(axis=1)
            if (more == alive).all():
                return ~alive
            alive = more

    def _first(self, head: Automaton | None, body: Automaton) -> np.ndarray:
        lead = head or body
        return ~self._dead(lead)[lead.move[0, lead.kind]]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rule bits of the stretches between resets that may hold a match of some rule, in a
        copy of the texts with a line feed after each one."""
        sizes = np.diff(offsets)
        joined = np.full(len(data) + len(sizes), 10, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        self.joined = joined
        edges = np.flatnonzero(self.resets[joined])  # the last byte is one
        wanted = np.arange(0, len(joined), LANE_BYTES)
        starts = np.unique(np.concatenate([[0], edges[np.searchsorted(edges, wanted)] + 1]))
        starts = starts[starts < len(joined)]
        length = np.diff(np.append(starts, len(joined)))
        by = np.argsort(-length, kind="stable")
        starts, length = starts[by], length[by]
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        kinds = self.all.kind[joined]
        state = np.zeros(len(starts), np.int32)
        hit_at, hit_bits = [], []
        accepts = self.all.accept
        is_end = accepts > 0
        for step, n in enumerate(active.tolist()):
            at = starts[:n] + step
            state = self.flat[state[:n] * self.width + kinds[at]]
            ends = is_end[state]
            if ends.any():
                hit_at.append(at[ends])
                hit_bits.append(accepts[state[ends]])
        if not hit_at:
            none = np.zeros(0, np.int64)
            return none, none, none
        at, bits = np.concatenate(hit_at), np.concatenate(hit_bits)
        part = np.searchsorted(edges, at)
        found, back = np.unique(part, return_inverse=True)
        masks = np.zeros(len(found), np.int64)
        np.bitwise_or.at(masks, back.reshape(-1), bits)
        return np.where(found > 0, edges[found - 1] + 1, 0), edges[found], masks

    def walk(self, text: bytes, rule: int) -> list[tuple[int, int]]:
        """Exact spans of one rule, leftmost and not overlapping, those with a long enough run."""
        head, run, first = self.heads[rule], self.run[rule], self.first[rule]
        starts = np.flatnonzero(first[np.frombuffer(text, np.uint8)]).tolist()
        out, done, n = [], 0, len(text)
        dead = self._dead(head) if head else None
        for start in starts:
            if start < done:
                continue
            at = start
            if head:
                state, reach, here = 0, -1, start
                while here < n and not dead[state]:
                    state = head.move[state, head.kind[text[here]]]
                    here += 1
                    if head.accept[state]:
                        reach = here
                if reach < 0:
                    continue
                at = reach
            end = at
            while end < n and run[text[end]]:
                end += 1
            if end > at:
                if end - at >= self.rules[rule].least:
                    out.append((start, end))
                done = end
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text in code points, by start and then by rule."""
        rows: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        starts, ends, masks = self.candidates(data, offsets)
        if not len(starts):
            return rows
        base = offsets[:-1] + np.arange(len(offsets) - 1)
        owner = np.searchsorted(base, starts, "right") - 1
        points: dict[int, np.ndarray] = {}
        for lo, hi, mask, row in zip(starts.tolist(), ends.tolist(), masks.tolist(), owner.tolist()):
            text = self.joined[lo:hi].tobytes()
            if row not in points:
                points = {row: code_points(data[offsets[row] : offsets[row + 1]])}
            shift, count = lo - int(base[row]), points[row]
            for rule in range(len(self.rules)):
                if mask >> rule & 1:
                    for a, b in self.walk(text, rule):
                        a, b = shift + a, shift + b
                        if self.tails[rule]:
                            more = self.tails[rule].match(memoryview(data[offsets[row] : offsets[row + 1]]), b)
                            b = more.end() if more else b
                        rows[row].append((int(count[a]), rule, int(count[b])))
        for found in rows:
            found.sort()
        return rows


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]):
    for batch, data, offsets in chunks(batches, limit=1 << 20):
        yield batch, scanner(rules).spans(data, offsets)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` of every row: array of (kind, start, end) in code points, by start, then by rule.

    Null and empty texts have no spans. Rows are taken one by one, so repeated rows and null ids stay.
    Matches of different rules may overlap; those of one rule do not. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, rows in _scan(batches, rules):
            made = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced; spans that overlap or touch become one mask.
    Null texts stay null; all columns and rows stay."""
    names = docs.columns

    def cover(text: str, row: list[tuple[int, int, int]]) -> str:
        out, at, open_end = [], 0, -1
        for a, _, b in row:
            if a > open_end:
                out.append(text[at:a] + mask)
            open_end = max(open_end, b)
            at = open_end
        return "".join(out) + text[at:]

    def run(batches):
        for batch, rows in _scan(batches, rules):
            texts = batch.column("text").to_pylist()
            for i, row in enumerate(rows):
                if row:
                    texts[i] = cover(texts[i], row)
            at = names.index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digests(spans: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from the spans of ``secret_spans``."""
    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", *map(of, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def sha_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of one text's base spans, for checks."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
