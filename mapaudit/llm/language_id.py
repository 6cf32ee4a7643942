"""Language identification by a byte convolutional network.

Filters of several widths run over fixed-length windows of bytes, each filter keeps its largest response
in the window (max pooling), and a softmax layer names the language. It is trained in numpy on a bounded
sample of labelled rows. A text's prediction joins all of its windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.llm.text import LOWER, chunks

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    window: int = 512  # bytes
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  # of each width
    #: Bound of the training sample: labelled rows of each language, and windows of each such row.
    sample_rows: int = 256
    sample_windows: int = 4
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


DEFAULT = LanguageConfig()


@dataclass(frozen=True, eq=False)  # hashed by identity: one predictor for each broadcast model
class Model:
    languages: tuple[str, ...]
    kernels: tuple[np.ndarray, ...]  # for each width: (width, 256, filters)
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: np.ndarray
    window: int


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text in windows of ``size`` bytes, A-Z in lower case, the last filled with zeros: rows of bytes,
    owner, real bytes."""
    count = -(-np.diff(offsets) // size)
    owner = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + within * size
    real = np.minimum(offsets[owner + 1] - start, size)
    padded = np.concatenate([LOWER[data], np.zeros(size, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, size)[start].copy() if len(start) else np.zeros((0, size), np.uint8)
    rows[np.arange(size) >= real[:, None]] = 0
    return rows, owner, real


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], cfg: LanguageConfig = DEFAULT) -> Model:
    """Stochastic gradient descent with Adam steps on the cross entropy of windows."""
    rng = np.random.default_rng(cfg.seed)
    f, n = cfg.filters, len(languages)
    params = [rng.normal(0, 0.3, (w, 256, f)) for w in cfg.widths] + [np.zeros(f) for _ in cfg.widths]
    params += [rng.normal(0, 0.3, (f * len(cfg.widths), n)), np.zeros(n)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    ways = len(cfg.widths)
    for _ in range(cfg.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), cfg.batch):
            take = order[at : at + cfg.batch]
            x, y = rows[take].astype(np.int64), labels[take]
            pooled, peaks = [], []
            for i, width in enumerate(cfg.widths):
                span = x.shape[1] - width + 1
                seen = sum(params[i][j][x[:, j : j + span]] for j in range(width)) + params[ways + i]
                peak = seen.argmax(axis=1)
                peaks.append(peak)
                pooled.append(np.take_along_axis(seen, peak[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ params[-2] + params[-1]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = hidden.T @ p, p.sum(axis=0)
            back = (p @ params[-2].T) * (raw > 0)
            for i, width in enumerate(cfg.widths):
                part = back[:, i * f : (i + 1) * f]
                grads[ways + i] = part.sum(axis=0)
                for j in range(width):
                    at_byte = np.take_along_axis(x, peaks[i] + j, 1)
                    np.add.at(grads[i][j], (at_byte, np.arange(f)[None, :]), part)
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    small = [q.astype(np.float32) for q in params]
    return Model(tuple(languages), tuple(small[:ways]), tuple(small[ways : 2 * ways]), small[-2], small[-1], cfg.window)


class Predictor:
    """The model with the responses to two neighbouring bytes added up in advance."""

    def __init__(self, model: Model):
        self.model = model
        self.parts = []
        for kernel in model.kernels:
            parts = [(j, 2, (kernel[j][:, None, :] + kernel[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, len(kernel) - 1, 2)]
            if len(kernel) % 2:
                parts.append((len(kernel) - 1, 1, kernel[-1]))
            self.parts.append(parts)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(rows), 128):
            x = rows[at : at + 128].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            hidden = []
            for kernel, bias, parts in zip(self.model.kernels, self.model.biases, self.parts):
                span = x.shape[1] - len(kernel) + 1
                seen = None
                for j, n, table in parts:
                    add = table.take((pairs if n == 2 else x)[:, j : j + span], axis=0)
                    seen = add if seen is None else np.add(seen, add, out=seen)
                hidden.append(np.maximum(seen.max(axis=1) + bias, 0))
            logits = np.concatenate(hidden, axis=1) @ self.model.out + self.model.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.model.languages)), np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probability of each text's language: its windows' log-probabilities, averaged by bytes."""
        rows, owner, real = windows(data, offsets, self.model.window)
        logs = self.log_probabilities(rows).astype(np.float64) * real[:, None]
        total = np.zeros((len(offsets) - 1, len(self.model.languages)))
        np.add.at(total, owner, logs)
        total /= np.maximum(np.diff(offsets), 1)[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        total /= total.sum(axis=1, keepdims=True)
        return total.argmax(axis=1), total.max(axis=1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, cfg: LanguageConfig = DEFAULT) -> Model | None:
    """Trains on documents that are not held out and have text, lang and id; None if there are none.

    The sample takes about ``cfg.sample_rows`` rows of each language, those with the smallest hash of
    their id, and ``cfg.sample_windows`` windows of each, spread over the whole text.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null and length(text) > 0").where(~held_out())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, cfg.sample_rows / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed)), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.where(draw < share[F.col("lang")]).limit(2 * cfg.sample_rows * len(counts))

    def run(batches):
        for batch, data, offsets in chunks(batches):
            rows, owner, _ = windows(data, offsets, cfg.window)
            count = np.bincount(owner, minlength=batch.num_rows)
            within = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            keep = np.zeros(len(owner), bool)
            for k in range(cfg.sample_windows):
                keep |= within == (k * count[owner]) // cfg.sample_windows
            owner, rows = owner[keep], rows[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), batch.column("lang").take(pa.array(owner)),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "lang", "bytes"])

    found = some.mapInArrow(run, "doc_id long, lang string, bytes binary").toPandas().sort_values(["lang", "doc_id", "bytes"])
    languages = sorted(set(found["lang"]))
    rows = np.frombuffer(b"".join(found["bytes"]), np.uint8).reshape(-1, cfg.window)
    return train(rows, np.searchsorted(languages, found["lang"].to_numpy(str)), languages, cfg)


@lru_cache(maxsize=1)
def _predictor(model: Model) -> Predictor:
    return Predictor(model)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every row when there was nothing
    to learn from. Repeated rows and null ids stay; a null id is not held out.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, offsets in chunks(batches):
            at, score = _predictor(shared.value).predict(data, offsets)
            letters = np.asarray(batch.column("letters"))
            names = np.where(letters, np.array(shared.value.languages, object)[at], UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()),
                                              pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
