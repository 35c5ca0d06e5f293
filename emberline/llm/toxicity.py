"""Toxicity from a small convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the whole word and of its
first letters, so that inflected forms share parts. Filters of several widths
run over the words, each keeps its maximum over the whole text, and a logistic
layer weighs the maxima. Only the position of each maximum gets a gradient,
which keeps training cheap. Part of the training sample sets a calibration curve
for the score and, for each language, the threshold of best F1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectext
from .common import F, fresh_name, quoted, remainder, whole_text
from .sampling import labelled

WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def words(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (whole word and prefixes, each in its own range of `buckets`), and where each text's words begin.

    Words stand between white space and signs; A to Z count as lower case.
    """
    inside = ~(vectext.SPACE[data] | _SIGN[data])
    starts, ends = vectext.runs(inside, offsets[:-1][offsets[:-1] < len(data)])
    lowered = vectext.LOWER[data]
    values = vectext.BYTE_VALUE[lowered]
    rows = [vectext.span_hashes(values, starts, ends)]
    rows += [vectext.span_hashes(values, starts, np.minimum(ends, starts + p)) for p in PREFIXES]
    out = np.stack([(h % np.uint64(buckets)).astype(np.int64) + k * buckets for k, h in enumerate(rows)], axis=1)
    return out, np.searchsorted(starts, offsets)


def _shifted(part: np.ndarray, j: int, end: np.ndarray) -> np.ndarray:
    """Row i holds row i + j of the same text, zero past the text's end."""
    if not j:
        return part
    out = np.zeros_like(part)
    out[:-j] = part[j:]
    out[np.arange(len(part)) + j >= end] = 0
    return out


@dataclass
class Net:
    embed: np.ndarray  # rows x dim
    filters: list[list[np.ndarray]]  # by width and position: dim x filters
    bias: list[np.ndarray]
    top: np.ndarray
    top_bias: np.ndarray
    buckets: int
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = self.embed[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x = x + self.embed[rows[:, k]]
        return x

    def convolved(self, x: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        end = np.repeat(begins[1:], np.diff(begins))
        return [sum(_shifted(x @ w, j, end) for j, w in enumerate(ws)) + b for ws, b in zip(self.filters, self.bias, strict=True)]

    def pooled(self, made: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
        has = np.flatnonzero(np.diff(begins))
        out = []
        for c, b in zip(made, self.bias, strict=True):
            p = np.tile(b, (len(begins) - 1, 1))
            if len(has):
                p[has] = np.maximum.reduceat(c, begins[has], axis=0)
            out.append(np.maximum(p, 0))
        return np.concatenate(out, axis=1)

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, begins = words(data, offsets, self.buckets)
        n = len(offsets) - 1
        top = np.zeros((n, len(self.top)), np.float32)
        piece = 1 << 16  # words at a time; a longer text goes in overlapping stretches, whose maxima meet
        reach = max(WIDTHS) - 1
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + piece, "right")) - 1)
            a, b = int(begins[at]), int(begins[to])
            if to == at + 1 and b - a > piece:
                parts = []
                for s in range(a, b, piece):
                    e = min(s + piece + reach, b)
                    made = self.convolved(self.vectors(rows[s:e]), np.array([0, e - s]))
                    parts.append(self.pooled([c[: min(piece, b - s)] for c in made], np.array([0, min(piece, b - s)])))
                top[at] = np.max(parts, axis=0)[0]
            else:
                top[at:to] = self.pooled(self.convolved(self.vectors(rows[a:b]), begins[at : to + 1] - a), begins[at : to + 1] - a)
            at = to
        return (top * self.top).sum(axis=1, dtype=np.float64) + float(self.top_bias[0])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * self.raw(data, offsets) + self.shift, -40, 40)
        return np.round(1 / (1 + np.exp(-z)), 6)


def train(texts: pa.Array, y: np.ndarray, langs: list | None = None, prior: float | None = None, buckets: int = 1 << 15, dim: int = 8, filters: int = 8, epochs: int = 12, least_steps: int = 800, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Net:
    """Fit the net to texts with labels, in `epochs` rounds or more, so that there are `least_steps` steps. With fewer than two labels the score is the same for all texts."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(
        rng.normal(0, 0.03, (buckets * (1 + len(PREFIXES)), dim)).astype(f32),
        [[rng.normal(0, 0.5 / w, (dim, filters)).astype(f32) for _ in range(w)] for w in WIDTHS],
        [np.zeros(filters, f32) for _ in WIDTHS], np.abs(rng.normal(0, 0.1, len(WIDTHS) * filters)).astype(f32) * np.tile([1, -1], len(WIDTHS) * filters // 2).astype(f32), np.zeros(1, f32), buckets,
    )
    if len(set(y.tolist())) < 2:
        net.slope, net.shift = 0.0, (20.0 * float(y[0]) if len(y) else 10.0) - 10.0
        return net
    parts = [words(*part, buckets) for part in vectext.pieces(texts)]
    rows = np.concatenate([r.astype(np.int32) for r, _ in parts])
    begins = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    del parts
    fit = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    hold = np.flatnonzero(np.arange(len(y)) % 5 == 4)
    if len(set(y[fit].tolist())) < 2 or len(set(y[hold].tolist())) < 2:
        fit = hold = np.arange(len(y))
    dense = [*[w for ws in net.filters for w in ws], *net.bias, net.top, net.top_bias]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    squares = np.full((len(net.embed), 1), 1e-3, f32)  # of the sparse rows' gradients
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(fit)))):
        for chosen in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            sizes = begins[chosen + 1] - begins[chosen]
            own = np.concatenate([[0], np.cumsum(sizes)])
            picked = rows[np.arange(own[-1]) + np.repeat(begins[chosen] - own[:-1], sizes)]
            x = net.vectors(picked)
            made = net.convolved(x, own)
            p = net.pooled(made, own)
            out = 1 / (1 + np.exp(-np.clip(p @ net.top + net.top_bias, -30, 30)))
            err = ((out - y[chosen]) / len(chosen)).astype(f32)
            g_pool = err[:, None] * net.top * (p > 0)
            grads_f, grads_b, touched, g_touched = [], [], [], []
            for k, (ws, c) in enumerate(zip(net.filters, made, strict=True)):
                g = g_pool[:, k * filters : (k + 1) * filters]
                at = np.zeros((len(chosen), filters), np.int64)
                for i in np.flatnonzero(sizes):
                    at[i] = own[i] + c[own[i] : own[i + 1]].argmax(axis=0)
                grads_b.append(g.sum(axis=0))
                for j, w in enumerate(ws):
                    place = at + j
                    ok = (place < own[1:, None]) & (sizes[:, None] > 0) & (g != 0)
                    i, f = np.nonzero(ok)
                    gv, where = g[i, f], place[i, f]
                    gw = np.zeros_like(w)
                    np.add.at(gw.T, f, gv[:, None] * x[where])
                    grads_f.append(gw)
                    touched.append(where)
                    g_touched.append(gv[:, None] * w.T[f])
            where, gx = np.concatenate(touched), np.concatenate(g_touched)
            step += 1
            for w, g, a, b in zip(dense, [*grads_f, *grads_b, err @ p, err.sum(keepdims=True)], first, second, strict=True):
                g = g + 1e-5 * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            for k in range(picked.shape[1]):
                ids, back = np.unique(picked[where, k], return_inverse=True)
                g = np.zeros((len(ids), dim), f32)
                np.add.at(g, back, gx)
                squares[ids] += (g * g).mean(axis=1, keepdims=True)
                net.embed[ids] -= 0.1 * g / np.sqrt(squares[ids])
    raw = np.concatenate([net.raw(*part) for part in vectext.pieces(texts)])
    m, t = raw[hold], y[hold].astype(float)
    weight = np.where(t == 1, prior / t.mean(), (1 - prior) / (1 - t.mean())) if prior is not None and 0 < prior < 1 else np.ones(len(t))
    slope, shift = 1.0, 0.0
    for _ in range(60):  # Newton, held near a slope of 1
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        v = weight * p * (1 - p)
        g = np.array([(weight * (p - t) * m).sum() + 0.5 * (slope - 1), (weight * (p - t)).sum() + 0.01 * shift])
        hess = np.array([[(v * m * m).sum() + 0.5, (v * m).sum()], [(v * m).sum(), v.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        slope, shift = slope - move[0], shift - move[1]
    net.slope, net.shift = float(slope), float(shift)
    p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -40, 40)))

    def best(at: np.ndarray) -> float:
        order = at[np.argsort(-p[at], kind="stable")]
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, y[at].sum()))
        k = int(np.argmax(f1))
        below = p[order[k + 1]] if k + 1 < len(order) else 0.0
        return float((p[order[k]] + below) / 2)

    net.thresholds[""] = best(hold)
    for lang in sorted({x for x in langs or [] if x}):
        own_rows = np.array([i for i in hold if langs[i] == lang])
        if len(own_rows) >= 20 and len(set(y[own_rows].tolist())) == 2:
            net.thresholds[lang] = best(own_rows)
    return net


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, left_out: int = 2, most_rows: int = 4000) -> Net:
    """Train on at most `most_rows` labelled documents whose fold is not the held-out one."""
    sample = labelled(documents, labels, label, modulus, left_out, most_rows, lang_column="lang" if "lang" in documents.columns else None)
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    prior = labels.where(fold != left_out).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(sample.column("text"), sample.column("y").to_numpy().astype(int), sample.column("lang").to_pylist(), prior)


def score(documents: DataFrame, net: Net, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang", modulus: int = 4, left_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per document: the id column, held_out, score, predicted, and flagged (the score against its language's threshold).

    The language picks the threshold of `flagged` alone. Null text is scored as
    the empty text; a null id counts as fold 0; a language without a threshold
    of its own, or null, takes the common one; equal texts get equal scores; an
    empty table gives no rows.
    """
    lang = F.col(quoted(lang_column)).cast("string") if lang_column else F.lit(None).cast("string")
    frame = documents.select(F.col(quoted(id_column)).alias("doc"), (remainder(id_column, modulus) == left_out).alias("held_out"), lang.alias("lang"), whole_text(text_column).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(net)  # the embedding table, whose size `buckets` fixes

    def run(frames):
        own = shared.value
        for batch in vectext.batches(frames, 2_000_000):
            p = own.scores(*vectext.flat(batch.column(3)))
            bar = np.array([own.thresholds.get(x or "", own.thresholds.get("", threshold)) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(p >= bar)], names=["doc", "held_out", "score", "predicted", "flagged"])

    kind = frame.schema["doc"].dataType.simpleString()
    out = frame.mapInArrow(run, f"doc {kind}, held_out boolean, score double, predicted int, flagged boolean")
    return out.withColumnRenamed("doc", fresh_name(["held_out", "score", "predicted", "flagged"], id_column))
