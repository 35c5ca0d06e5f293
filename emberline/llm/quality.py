"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line itself and its two
neighbours; the chain's weights hold neighbouring labels together. Training
maximises the likelihood of label sequences in which each line has its
document's label; scoring runs forward and backward over the lines of a document
and averages the marginals of "good", weighted by the lines' lengths. A logistic
curve, fitted on documents that the chain did not see, turns this average into
the score.

Model and features are numpy; features are taken from the UTF-8 bytes of a whole
Arrow batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectext
from .common import F, quoted, remainder, whole_text
from .sampling import labelled

NEWLINE = 10
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 1  # signs that prose has
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and not _KIND[b]]] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 5
_KIND[128:] = 6
OWN = 18


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the text each is of; an empty text has one empty line."""
    cut = np.flatnonzero(data == NEWLINE)
    text = np.searchsorted(offsets, cut, "right") - 1
    starts = np.concatenate([offsets[:-1], cut + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), text])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    same = np.append(owner[1:] == owner[:-1], False)
    ends[:-1] = starts[1:] - 1
    ends[~same] = offsets[owner[~same] + 1]
    return starts, ends, owner


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """OWN features of each line."""
    n, size = len(data), (ends - starts).astype(np.float64)
    kind = _KIND[data]

    def counted(mask):
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    blank = vectext.SPACE[data]
    words_at, words_to = vectext.runs(~blank, starts)
    lowered = vectext.LOWER[data]
    values = np.where(lowered < 128, vectext.BYTE_VALUE[lowered], vectext.BYTE_VALUE[data])
    h = vectext.span_hashes(values, words_at, words_to)
    first, last = np.searchsorted(words_at, starts), np.searchsorted(words_at, ends)

    def over(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[last] - total[first]).astype(np.float64)

    words = (last - first).astype(np.float64)
    repeat = np.zeros(len(h), bool)
    repeat[1:] = h[1:] == h[:-1]
    seen = np.zeros(len(h), bool)
    line = np.repeat(np.arange(len(starts)), last - first)
    if len(h):
        slot = vectext.mixed(h + line.astype(np.uint64) * vectext.MULTIPLIER)
        order = np.argsort(slot, kind="stable")
        again = np.append(False, slot[order][1:] == slot[order][:-1])
        seen[order] = again
    tail = kind[words_to - 1] if len(words_to) else np.zeros(0, np.uint8)
    length = (words_to - words_at).astype(np.float64)
    long = over(length > 20)
    letters = counted(kind >= 4)
    safe, safe_words = np.maximum(size, 1), np.maximum(words, 1)
    upper = counted(kind == 4)
    out = [
        np.log1p(size) / 8, np.log1p(words) / 6, np.minimum(size / safe_words / 12, 4), letters / safe, upper / np.maximum(letters, 1),
        counted(kind == 3) / safe, counted(kind == 1) / safe, counted(kind == 2) / safe, counted(kind == 6) / safe, over(repeat) / safe_words,
        over(seen) / safe_words, over(tail == 2) / safe_words, over(tail == 1) / safe_words, over(length == 1) / safe_words, long / safe_words,
        (upper > 0.6 * letters) & (letters > 0), (counted(kind == 2) > 0.04 * size), (words < 3),
    ]
    return np.stack([np.asarray(x, np.float64) for x in out], axis=1)


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), and whether there are such lines, and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = owner[1:] == owner[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    has = np.zeros((len(own), 3))
    has[1:, 0], has[:-1, 1], has[:, 2] = same, same, 1
    return np.concatenate([own, before, after, has], axis=1)


def _chains(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(owner, minlength=texts)
    return np.cumsum(count) - count, count


def marginals(score: np.ndarray, pair: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 for each line, and expected counts of each pair of neighbouring labels.

    score: lines x 2 log potentials; pair: 2 x 2. Chains go side by side, longest first, normalised at each step.
    """
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    steps = int(count.max(initial=0))
    active = np.searchsorted(-count, -np.arange(steps), "left")  # chains longer than the step
    e = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(pair - pair.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for k in range(steps):
        at = begin[: active[k]] + k
        a = e[at] if not k else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(steps - 1, 0, -1):
        at = begin[: active[k]] + k
        b = (e[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(score), bool)
    inner[begin[count > 0]] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * t[None] * (e[at] * beta[at])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], joint.sum(axis=0) if len(at) else np.zeros((2, 2))


@dataclass
class Chain:
    weight: np.ndarray  # features x 2
    pair: np.ndarray  # 2 x 2
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 4.0
    shift: float = -2.0

    def averages(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of "good" of each text."""
        starts, ends, owner = lines(data, offsets)
        x = with_neighbours((line_features(data, starts, ends) - self.centre) / self.scale, owner)
        texts = len(offsets) - 1
        good, _ = marginals(x @ self.weight, self.pair, *_chains(owner, texts))
        weight = (ends - starts + 1).astype(np.float64)
        return np.bincount(owner, good * weight, texts) / np.bincount(owner, weight, texts)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.slope * np.clip(self.averages(data, offsets), 0, 1) + self.shift
        return 1 / (1 + np.exp(-z))


def train(texts: pa.Array, y: np.ndarray, rounds: int = 80, penalty: float = 1e-3, rate: float = 0.08, prior: float | None = None) -> Chain:
    """Fit a chain to texts with labels; three quarters train the chain, the rest the logistic curve.

    `prior` is the share of label 1 for which the curve is set, where the sample's share differs.
    With fewer than two labels in the sample the score is the same for all texts.
    """
    if len(set(y.tolist())) < 2:
        z = 20.0 * (float(y[0]) if len(y) else 0.5) - 10.0
        return Chain(np.zeros((3 * OWN + 3, 2)), np.zeros((2, 2)), np.zeros(OWN), np.ones(OWN), 0.0, z)
    owns, owners, seen_texts = [], [], 0
    for data, offsets in vectext.pieces(texts):
        starts, ends, owner = lines(data, offsets)
        owns.append(line_features(data, starts, ends))
        owners.append(owner + seen_texts)
        seen_texts += len(offsets) - 1
    own, owner = np.concatenate(owns), np.concatenate(owners)
    fit = np.arange(len(y)) % 4 != 3
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit[:] = True
    use = fit[owner]
    centre, scale = own[use].mean(axis=0), own[use].std(axis=0) + 1e-2
    x = with_neighbours((own - centre) / scale, owner)[use]
    numbered = np.cumsum(fit) - 1
    chain_of = numbered[owner[use]]
    begin, count = _chains(chain_of, int(fit.sum()))
    label = y[fit][chain_of].astype(int)
    chain = Chain(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), centre, scale)
    inner = np.flatnonzero(np.append(False, chain_of[1:] == chain_of[:-1]))
    seen_pair = np.zeros((2, 2))
    np.add.at(seen_pair, (label[inner - 1], label[inner]), 1)
    seen = np.stack([x.T @ (label == 0), x.T @ (label == 1)], axis=1)
    params = [chain.weight, chain.pair]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = max(len(x), 1)
    for k in range(1, rounds + 1):
        p, pairs = marginals(x @ chain.weight, chain.pair, begin, count)
        grads = [(np.stack([x.T @ (1 - p), x.T @ p], axis=1) - seen) / n + penalty * chain.weight, (pairs - seen_pair) / n + penalty * chain.pair]
        for w, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    mean = np.concatenate([chain.averages(*part) for part in vectext.pieces(texts)])
    held = ~fit if (~fit).any() else fit
    m, t = mean[held], y[held].astype(float)
    weight = np.ones(len(t))
    if prior is not None and 0 < t.mean() < 1:
        weight = np.where(t == 1, prior / t.mean(), (1 - prior) / (1 - t.mean()))
    slope, shift = 4.0, -2.0
    for _ in range(50):  # Newton, with a small penalty that keeps the slope finite
        p = 1 / (1 + np.exp(-(slope * m + shift)))
        g = np.array([(weight * (p - t) * m).sum() + 1e-2 * slope, (weight * (p - t)).sum()])
        v = weight * p * (1 - p) + 1e-9
        hess = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        slope, shift = slope - step[0], shift - step[1]
    chain.slope, chain.shift = float(slope), float(shift)
    return chain


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, left_out: int = 0, most_rows: int = 3000) -> Chain:
    """Train on at most `most_rows` labelled documents whose fold is not the held-out one."""
    sample = labelled(documents, labels, label, modulus, left_out, most_rows)
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    prior = labels.where(fold != left_out).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(sample.column("text"), sample.column("y").to_numpy().astype(int), prior=prior)


def score(documents: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text", modulus: int = 5, left_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per document: the id column, held_out, score and predicted.

    Null text is scored like the empty text, which is one empty line; a null id
    counts as fold 0; equal texts get equal scores; an empty table gives no rows.
    """
    frame = documents.select(F.col(quoted(id_column)).alias("doc"), (remainder(id_column, modulus) == left_out).alias("held_out"), whole_text(text_column).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(chain)  # a few hundred numbers

    def run(frames):
        for batch in vectext.batches(frames):
            p = shared.value.scores(*vectext.flat(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc", "held_out", "score", "predicted"])

    kind = frame.schema["doc"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc", id_column)


def keep(documents: DataFrame, chain: Chain, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they are."""
    at = documents.columns.index(text_column)

    def run(frames):
        for batch in frames:
            for part in vectext.batches([batch], text=text_column):
                yield part.filter(pa.array(chain_.value.scores(*vectext.flat(part.column(at))) >= threshold))

    chain_ = documents.sparkSession.sparkContext.broadcast(chain)
    return documents.mapInArrow(run, documents.schema)
