"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed counts of 1- to 4-byte windows of letters (square roots, length one), taken
from the whole text. The family is the best of one linear SVM per family; within a family every
pair of languages has its own linear SVM, and the language with the most votes wins, summed
margins breaking ties. The score is the product of logistic links of the deciding margins.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0;
rows without a label or with a null id are predicted but not learned from; repeated rows are
each predicted; an empty table gives an empty result; where nothing can be learned (no labelled
text with a letter), everything is ``und``; a single learned language is predicted for every
text with a letter, with score 1. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import apart
from ._text import mix, slices

UND = "und"
DIMENSIONS = 1 << 12
#: Families of languages by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "uralic": ["et", "fi", "hu"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its lower-case form, with all that isn't a letter's as a blank; whether it is a letter's."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    letter = np.zeros(256, bool)
    letter[97:123] = letter[65:91] = letter[128:] = True
    fold[~letter] = 32
    return fold, letter


FOLD, LETTER_BYTE = _tables()


def features(s, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row of float32 features for each text of a slice."""
    n = len(s)
    data = FOLD[s.data].astype(np.uint64)
    row = np.repeat(np.arange(n, dtype=np.int64) * dimensions, np.diff(s.offsets))
    key = np.zeros(len(data), np.uint64)
    found = []
    for width in range(1, 5):
        if len(data) < width:
            break
        m = len(data) - width + 1
        key = (key[:m] << np.uint64(8)) | data[width - 1 :]
        inside = (row[:m] == row[width - 1 :]) & (key != np.uint64(0x20202020 >> (8 * (4 - width))))
        cell = (mix(key[inside] + np.uint64(width << 40)) >> np.uint64(40)).astype(np.int64) & (dimensions - 1)
        found.append(row[:m][inside] + cell)
    out = np.bincount(np.concatenate(found), minlength=n * dimensions) if found else np.zeros(n * dimensions, np.int64)
    out = np.sqrt(out.astype(np.float32)).reshape(n, dimensions)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-9)[:, None]
    return out


def has_letter(s) -> np.ndarray:
    """Whether each text has a letter; those with ASCII letters are found bytewise."""
    ascii_letter = LETTER_BYTE[s.data] & (s.data < 128)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[s.offsets[1:]] > total[s.offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(s.offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in s.text(i).decode())
    return found


def _svm(parts: list[tuple[np.ndarray, np.ndarray]], c: float = 4.0, steps: int = 120) -> np.ndarray:
    """A linear SVM with squared hinge loss and balanced classes, by accelerated gradient descent.

    Each part is some rows of features, not copied, with their y of +1 or -1. Returns the weights with the intercept last.
    """
    width = parts[0][0].shape[1]
    for_a, for_b = (0.5 / max(1, sum(int((y * sign > 0).sum()) for _, y in parts)) for sign in (1, -1))
    weights = [np.where(y > 0, for_a, for_b).astype(np.float32) for _, y in parts]
    w = v = np.zeros(width + 1, np.float32)
    reg = np.float32(1e-4 / c)
    rate = np.float32(1 / (4 + reg))  # rows have length sqrt(2) at most, weights sum to one
    for k in range(steps):
        new = v - rate * reg * v
        for (x, y), weight in zip(parts, weights, strict=True):
            pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
            new += rate * np.append(pull @ x, pull.sum())
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class Model:
    """families: name -> languages; family_w: one row per family; pair_w: (family, a, b) -> weights, positive for a."""

    def __init__(self, families: dict[str, list[str]], family_w: np.ndarray, pair_w: dict):
        self.families, self.family_w, self.pair_w = families, family_w, pair_w

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray) -> Model:
        """Learns from rows sorted by language; those of a language are read in place."""
        codes, first = np.unique(lang, return_index=True)
        of = {code: x[i:j] for code, i, j in zip(codes, first, [*first[1:], len(lang)], strict=True)}
        families: dict[str, list[str]] = {}
        for code in codes:
            families.setdefault(_FAMILY.get(code, f"only {code}"), []).append(code)
        own = np.array([_FAMILY.get(code, f"only {code}") for code in lang])
        family_w = np.stack([_svm([(x, np.where(own == f, 1, -1).astype(np.float32))]) for f in families]) if len(families) > 1 else np.zeros((len(families), x.shape[1] + 1), np.float32)
        pair_w = {}
        for f, codes in families.items():
            for a, b in combinations(codes, 2):
                pair_w[f, a, b] = _svm([(of[a], np.ones(len(of[a]), np.float32)), (of[b], -np.ones(len(of[b]), np.float32))])
        return cls(families, family_w, pair_w)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = list(self.families)
        if not names:
            return np.full(len(x), UND, object), np.zeros(len(x))
        link = lambda m: 1 / (1 + np.exp(-4.0 * m.astype(np.float64)))
        lang, score = np.full(len(x), UND, object), np.ones(len(x))
        margin = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        best = margin.argmax(1)
        if len(names) > 1:
            score = link(margin.max(1))
        for k, f in enumerate(names):
            rows = np.flatnonzero(best == k)
            codes, own = self.families[f], x[rows]
            if len(codes) == 1:
                lang[rows] = codes[0]
                continue
            votes = np.zeros((len(rows), len(codes)))
            least = np.full((len(rows), len(codes)), np.inf)
            for i, j in combinations(range(len(codes)), 2):
                w = self.pair_w[f, codes[i], codes[j]]
                m = own @ w[:-1] + w[-1]
                votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            won = votes.argmax(1)
            lang[rows] = np.array(codes, object)[won]
            score[rows] *= link(least[np.arange(len(rows)), won])
        return lang, score


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, dimensions: int = DIMENSIONS) -> Model:
    """Learns every language of the labelled rows, each from the ``sample / languages`` rows (at least 50) that come first by a hash of their id.

    The driver receives that many feature vectors at most: ``sample``, or 50 for each language where that is more.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, np.zeros((0, dimensions + 1), np.float32), {})
    each = max(50, sample // len(counts))
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    bounds = [(code, min(1 << 30, int((1 << 30) * 2.0 * each / n) + 1)) for code, n in counts.items()]
    near = rows.join(F.broadcast(df.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where(order < F.col("bound"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= each).select("id", "text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in slices(batches, max_rows=512):
            keep = has_letter(s)
            x = features(s, dimensions).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(keep)), pa.array([r.tobytes() for r in x[keep]], pa.binary())], ["lang", "x"])

    found = sorted(chosen.mapInArrow(vectors, "lang string, x binary").collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    if not found:
        return Model({}, np.zeros((0, dimensions + 1), np.float32), {})
    lang, x = np.array([r["lang"] for r in found], object), np.empty((len(found), dimensions), np.float32)
    for i in reversed(range(len(found))):
        x[i] = np.frombuffer(found.pop()["x"], np.float16)  # the driver holds the features once
    return Model.fit(x, lang)


def predict(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns ``keep`` of each row, lang_pred and score; one pass, no shuffle."""
    names = ["_id", "_text", *[f"_{i}" for i in range(len(keep))]]
    rows = df.select(F.lit(0).cast("long"), F.col(text_col).cast("string"), *keep).toDF(*names)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in slices(batches, max_rows=512):
            ok = has_letter(s)
            lang, score = model.predict(features(s, dimensions))
            lang, score = np.where(ok, lang, UND), np.where(ok & (lang != UND), score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], [*names[2:], "lang_pred", "score"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names[2:])
    return rows.mapInArrow(label, f"{kinds}, lang_pred string, score double").toDF(*keep, *apart(keep, "lang_pred", "score"))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the labelled rows that aren't held out."""
    model = train(df.where(~held_out(id_col)), id_col, text_col, lang_col, sample)
    return predict(df, model, [id_col], text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
