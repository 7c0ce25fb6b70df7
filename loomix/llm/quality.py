"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its two neighbours; the
chain ties neighbouring labels. A document's score is the mean of the lines' forward-backward
marginals for good, weighted by the lines' lengths in bytes (plus one). In training, all lines
of a document carry its label.

Defined results: a null or empty text is one empty line; rows without a label or with a null id
are scored but not learned from; rows repeated in documents or labels count each time; an empty
table gives an empty result; where nothing can be learned, every score is 0.5. Only the text is
an input of a score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import apart
from ._text import WHITE_SEP, lines, mix, of_text, slices
from .language import held_out

_LOWER, _UPPER, _DIGIT, _BLANK, _STOP, _SIGN, _HIGH = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, _SIGN, np.uint8)
    table[97:123], table[65:91], table[48:58] = _LOWER, _UPPER, _DIGIT
    table[list(b" \t\r\n\x0b\x0c")], table[list(b".,;:!?'\"()-")], table[128:] = _BLANK, _STOP, _HIGH
    return table


CLASS = _classes()


def line_features(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its weight, and the first line of each text."""
    starts, ends, first = lines(s)
    size = (ends - starts).astype(np.float64)
    kind = CLASS[s.data]

    def count(mask: np.ndarray, a: np.ndarray = starts, b: np.ndarray = ends) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[b] - total[a]).astype(np.float64)

    per = np.stack([count(kind == k) for k in range(7)], 1)
    word_starts, word_ends, _ = s.tokens(WHITE_SEP)
    length = word_ends - word_starts
    line = np.searchsorted(starts, word_starts, side="right") - 1
    n = len(starts)
    words = np.bincount(line, minlength=n).astype(np.float64)
    hashes = s.hashes(word_starts, word_ends, lower=True)
    distinct = np.bincount(line[np.unique(mix(hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]], minlength=n) if len(line) else np.zeros(n)
    odd = np.bincount(line, weights=((kind[word_ends - 1] == _SIGN) | (kind[word_starts] == _SIGN)).astype(float), minlength=n) if len(line) else np.zeros(n)
    loud = np.bincount(line, weights=(s.data[word_ends - 1] == 33).astype(float), minlength=n) if len(line) else np.zeros(n)
    short = np.bincount(line, weights=(length <= 3).astype(float), minlength=n) if len(line) else np.zeros(n)
    bare = np.bincount(line, weights=(length == 1).astype(float), minlength=n) if len(line) else np.zeros(n)
    text = of_text(first)
    own = s.hashes(starts, ends)
    _, back, many = np.unique(mix(own + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    repeated = (many[back.reshape(-1)] > 1).astype(np.float64)
    full, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(per[:, _LOWER] + per[:, _UPPER] + per[:, _HIGH], 1)
    last = np.where(size > 0, kind[np.maximum(ends - 1, 0)] if len(kind) else 0, _BLANK)
    head = np.where(size > 0, kind[np.minimum(starts, max(len(kind) - 1, 0))] if len(kind) else 0, _BLANK)
    x = np.stack(
        [
            per[:, _LOWER] / full, per[:, _UPPER] / letters, per[:, _DIGIT] / full, per[:, _BLANK] / full, per[:, _STOP] / full,
            per[:, _SIGN] / full, per[:, _HIGH] / full, np.minimum(np.log1p(size) / 8, 2), np.minimum(length_mean(length, line, n) / 10, 3),
            distinct / w, odd / w, loud / w, short / w, bare / w, repeated * (size > 0), last == _STOP, head == _UPPER, size == 0,
            words == 1, np.minimum(words, 50) / 50,
        ],
        1,
    )
    x = np.hstack([x, x[:, :14] ** 2]).astype(np.float32)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edge = np.zeros((n, 2), np.float32)
    edge[first[:-1], 0] = 1
    edge[first[1:] - 1, 1] = 1
    return np.hstack([x, before, after, edge, np.ones((n, 1), np.float32)]), size + 1, first


def length_mean(length: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(line, weights=length, minlength=n) / np.maximum(np.bincount(line, minlength=n), 1) if len(line) else np.zeros(n)


#: Width of line_features().
WIDTH = 3 * 34 + 3


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every chain: P(good) of each line, the expected counts of the 2 x 2 transitions in all, and log Z.

    unary: the score of good against bad for each line. Chains are walked side by side.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    n, longest = len(unary), int(counts.max()) if len(counts) else 0
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alive = lambda t: int(np.searchsorted(-counts, -(t + 1), side="right"))  # noqa: E731  chains with more than t lines
    u = np.stack([np.zeros(n), unary], 1)
    if longest:
        alpha[begin[: alive(0)]] = u[begin[: alive(0)]]
    for t in range(1, longest):
        at = begin[: alive(t)] + t
        before = alpha[at - 1]
        alpha[at] = u[at] + np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
    for t in range(longest - 1, 0, -1):
        at = begin[: alive(t)] + t
        after = beta[at] + u[at]
        beta[at - 1] = np.logaddexp(after[:, :1] + trans[:, 0], after[:, 1:] + trans[:, 1])
    ends = first[1:] - 1
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    each = np.repeat(z, np.diff(first))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - each, 0))
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pairs[a, b] = np.exp(np.minimum(alpha[at - 1, a] + trans[a, b] + u[at, b] + beta[at, b] - each[at], 0)).sum()
    return good, pairs, z


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, trans: np.ndarray):
        self.mean, self.scale, self.w, self.trans = mean, scale, w, trans

    @classmethod
    def fit(cls, x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 250, reg: float = 1e-3) -> Model:
        """Maximises the penalised conditional likelihood by Adam; every line weighs the same."""
        mean, scale = x.mean(0), x.std(0) + 1e-3
        mean[-1], scale[-1] = 0, 1
        x = ((x - mean) / scale).astype(np.float64)
        counts = np.diff(first)
        y = np.repeat(label, counts).astype(float)
        inner = counts - 1
        real = np.array([[((1 - label) * inner).sum(), 0], [0, (label * inner).sum()]], float)
        w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        lines_in_all = max(1, len(x))
        for k in range(1, steps + 1):
            good, pairs, _ = marginals(x @ w, first, trans)
            grads = [x.T @ (y - good) / lines_in_all - reg * w, (real - pairs) / lines_in_all - reg * trans]
            for p, g, a, b in zip((w, trans), grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += 0.05 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        return cls(mean, scale, w, trans)

    def score(self, x: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = marginals(((x - self.mean) / self.scale) @ self.w, first, self.trans)
        total = np.concatenate([[0], np.cumsum(good * weight)])
        size = np.concatenate([[0], np.cumsum(weight)])
        return np.clip((total[first[1:]] - total[first[:-1]]) / (size[first[1:]] - size[first[:-1]]), 0, 1)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, max_lines: int = 400_000) -> Model | None:
    """Learns from at most ``sample`` labelled documents, those first by a hash of their id, and at most ``max_lines`` lines.

    In that order a document is taken if its lines still fit, so one of more than ``max_lines`` lines never is. The
    driver gets the number of lines of ``sample`` documents, then the line features of those taken.
    """
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").orderBy(order, "id", "label").limit(sample)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) + 1
    # Rows that repeat an id are told apart by a hash of their text, and bounded like the labels.
    own = F.xxhash64("text")
    listed = texts.join(F.broadcast(picked), "id").select("id", "label", order.alias("o"), own.alias("h"), n_lines.cast("long").alias("n"))
    listed = listed.groupBy("id", "label", "o", "h", "n").agg(F.count("*").alias("m")).orderBy("o", "id", "h", "label").limit(sample).collect()
    taken, total = [], 0
    for r in listed:
        many = min(r["m"], (max_lines - total) // r["n"])
        if many:
            taken.append((r["id"], r["label"], r["h"], many))
            total += many * r["n"]
    if not taken:
        return None
    kind = texts.schema["id"].dataType.simpleString()
    chosen = df.sparkSession.createDataFrame(taken, f"id {kind}, label int, h long, many long")
    rows = texts.withColumn("h", own).join(F.broadcast(chosen), ["id", "h"]).select("id", "text", "label", "many").dropDuplicates(["id", "text", "label"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in slices(batches):
            x, _, first = line_features(s)
            x = x.astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()), batch.column(0).cast(pa.string()), batch.column(3)], ["label", "x", "id", "many"])

    found = sorted(rows.mapInArrow(vectors, "label int, x binary, id string, many long").collect(), key=lambda r: (r["id"], r["label"], bytes(r["x"])))
    found = [(np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH), r["label"]) for r in found for _ in range(r["many"])]
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])])
    return Model.fit(np.concatenate([x for x, _ in found]).astype(np.float32), first, np.array([y for _, y in found]))


def score(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the score of each row; one pass, no shuffle."""
    names = ["_id", "_text", *[f"_{i}" for i in range(len(keep))]]
    rows = df.select(F.lit(0).cast("long"), F.col(text_col).cast("string"), *keep).toDF(*names)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in slices(batches):
            out = model.score(*line_features(s)) if model else np.full(len(s), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.float64())], [*names[2:], "score"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names[2:])
    return rows.mapInArrow(value, f"{kinds}, score double").toDF(*keep, *apart(keep, "score"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, sample: int = 6000) -> DataFrame:
    """(id, held_out, score, predicted) of every row, learned from labelled rows that aren't held out."""
    model = train(df, labels.where(~held_out(id_col)), id_col, text_col, sample=sample)
    out = score(df, model, [id_col], text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
