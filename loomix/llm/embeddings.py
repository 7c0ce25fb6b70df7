"""Embedding near-dedup by collision counting over many one-dimensional projections.

Two vectors of unit length with cosine c differ by a normal variate of variance 2 - 2c in a random
projection. Around each query's value in a projection lies a window of half-width w; two vectors
collide in the projection if one lies in the other's window. Pairs are verified exactly when they
collide in at least ``least`` of ``projections`` projections; window and count are calibrated so that
a pair at the threshold itself is found with probability ``recall``, closer pairs more surely.

Vectors of one label are sorted by the first projection and cut into blocks of about ``block`` at
quantiles. Only blocks whose ranges come within reach of each other meet, two at a time, each pair of
blocks in a group of its own: no group grows with a label or a cluster. Within a group every projection is
sorted, and a query's window is a run of the sorted vectors. For a strip of queries at a time the runs of the
first projections are counted for all pairs; pairs that have missed too often to reach the count any more are
dropped, and the other projections are counted for those left alone. A group returns link counts for each
vector and a spanning forest of its links, never the links. Equal vectors of a label are one class, compared
once. At a cosine of 0.93 a window holds a third of all vectors of a projection, whatever the sorting, so the
work within a label still grows with the square of its number of distinct vectors.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and those with
a null label, link with nothing; vectors of different lengths don't link; a null id gets a row with no
links, a null component and kept false; rows that repeat an id count as vectors of their own, with equal
results, the larger count of links and the smaller component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import components, save


if TYPE_CHECKING:
    import pandas as pd  # executors load it only where a step needs it


def calibrate(threshold: float, projections: int, recall: float, chance: float = 0.9) -> tuple[float, int]:
    """The window's half-width, in which a pair at the threshold collides with the given chance, and the count to ask for."""
    from statistics import NormalDist

    width = NormalDist(0, math.sqrt(2 - 2 * threshold)).inv_cdf((1 + chance) / 2)
    tail, least = 0.0, projections + 1
    while tail < recall:
        least -= 1
        tail += math.comb(projections, least) * chance**least * (1 - chance) ** (projections - least)
    return width, least


def _directions(size: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, projections))


def _vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, projections: int, seed: int) -> DataFrame:
    """(id, label, digest, x, at): valid vectors of unit length, with their place in the first projection."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, digests, units, at = [], [], [], []
            v = batch.column(2)
            offsets, flat = v.offsets.to_numpy(), v.values
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                x = flat[a:b] + 0.0  # no negative zeros
                top = np.abs(x).max() if b > a else 0.0
                if bad[a:b].any() or not np.isfinite(x).all() or not top > 0:
                    continue
                unit = x / top
                unit /= math.sqrt(unit @ unit)
                keep.append(i)
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                units.append(unit.tobytes())
                at.append(float(unit @ _first(b - a, projections, seed)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), batch.column(1).take(pa.array(keep, pa.int32())), pa.array(digests, pa.binary()), pa.array(units, pa.binary()), pa.array(at, pa.float64())], ["id", "label", "digest", "x", "at"])

    cache: dict = {}

    def _first(size: int, projections: int, seed: int) -> np.ndarray:
        if size not in cache:
            cache[size] = np.ascontiguousarray(_directions(size, projections, seed)[:, 0])
        return cache[size]

    return rows.mapInArrow(run, "id long, label string, digest binary, x binary, at double")


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", projections: int = 32, recall: float = 0.9999, block: int = 1024, seed: int = 5) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: links join vectors of one label with cosine >= threshold."""
    width, least = calibrate(threshold, projections, recall)
    # Blocks further apart than this hold no pair at the threshold, but for one in a million.
    reach = 4.9 * math.sqrt(2 - 2 * threshold)
    vectors = save(_vectors(df, id_col, vec_col, label_col, projections, seed), "vectors")
    classes = vectors.groupBy("label", "digest").agg(F.min("id").alias("first"), F.count("*").alias("many"), F.min("x").alias("x"), F.min("at").alias("at"))
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a number for each class; ids may repeat

    # Quantiles of the first projection: one value for each block of each label.
    cells = F.floor(F.col("at") * 256).cast("long")
    fine = classes.groupBy("label", cells.alias("cell")).agg(F.count("*").alias("n"))
    order = _running(fine)
    placed = classes.withColumn("cell", cells).join(order, ["label", "cell"])
    placed = placed.withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("digest"), F.col("n"))) / block).cast("long"))
    placed = save(placed.select("label", "rep", "many", "x", "at", "block"), "placed")
    bounds = placed.groupBy("label", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    one, two = bounds.toDF("label", "b1", "low1", "high1"), bounds.toDF("label", "b2", "low2", "high2")
    meet = one.join(two, "label").where((F.col("b1") <= F.col("b2")) & (F.col("low2") - F.col("high1") <= reach) & (F.col("low1") - F.col("high2") <= reach)).select("label", "b1", "b2")
    meet = save(meet, "meet")
    sides = meet.select("label", "b1", "b2", F.col("b1").alias("block")).unionByName(meet.where("b1 <> b2").select("label", "b1", "b2", F.col("b2").alias("block")))
    grouped = placed.join(sides, ["label", "block"])
    kinds = "rep long, links long, other long"

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _compare(pdf, threshold, projections, seed, width, least, key[1] == key[2])

    found = save(grouped.groupBy("label", "b1", "b2").applyInPandas(compare, kinds), "found")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    own = classes.select("label", "digest", "rep", "first", "many").join(links, "rep", "left").join(groups.select(F.col("id").alias("rep"), F.col("component_id").alias("group")), "rep", "left")
    own = save(own, "linked")
    least = own.where("group is not null").groupBy("group").agg(F.min("first").alias("least"))
    per = own.join(least, "group", "left").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    per = save(per, "per_class")
    known = vectors.select("id", "label", "digest").join(per, ["label", "digest"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(id_col).cast("long").alias("id")).join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _running(wide: DataFrame) -> DataFrame:
    """(label, cell, n, before): before is the number of classes in the cells below; a label has a few thousand cells at most."""
    from pyspark.sql import Window

    below = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return wide.select("label", "cell", "n", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))


def _compare(pdf: pd.DataFrame, threshold: float, projections: int, seed: int, width: float, least: int, same: bool) -> pd.DataFrame:
    """Counts the links of each vector between (or in) two blocks, and gives a spanning forest of them."""
    rows = {"rep": [], "links": [], "other": []}
    blocks = sorted(pdf["block"].unique())
    for size, own in pdf.groupby(pdf["x"].map(len)):
        x = np.frombuffer(b"".join(own["x"]), np.float64).reshape(len(own), size // 8)
        rep, many = own["rep"].to_numpy(), own["many"].to_numpy()
        values = (x @ _directions(size // 8, projections, seed)).astype(np.float32)
        left = np.flatnonzero(own["block"].to_numpy() == blocks[0])
        right = left if same else np.flatnonzero(own["block"].to_numpy() != blocks[0])
        sums = np.zeros(len(own), np.int64)
        parent = np.arange(len(own))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # Sorted by the first projection, a strip's candidates are one run of the other block.
        left, right = left[np.argsort(values[left, 0])], right[np.argsort(values[right, 0])]
        firsts = values[right, 0]
        reach = np.float32(4.9 * math.sqrt(2 - 2 * threshold))
        early = min(projections, 2 * (projections - least) + 1)
        for k in range(0, len(left), 128):
            q = left[k : k + 128]
            low, high = np.searchsorted(firsts, values[q[0], 0] - reach), np.searchsorted(firsts, values[q[-1], 0] + reach, side="right")
            r = right[low:high]
            if not len(r):
                continue
            # Each projection sorted: the candidates' places, and the run of places in each query's window.
            order = np.argsort(values[r], axis=0, kind="stable")
            place = np.empty((len(r), projections), np.int32)
            np.put_along_axis(place, order, np.arange(len(r), dtype=np.int32)[:, None], 0)
            run = [(np.searchsorted(v, values[q, p] - width), np.searchsorted(v, values[q, p] + width, side="right")) for p, v in enumerate(np.take_along_axis(values[r], order, 0).T)]
            count = np.zeros((len(q), len(r)), np.uint8 if projections < 256 else np.uint16)
            for p in range(early):
                at = place[:, p]
                count += (at >= run[p][0][:, None]) & (at < run[p][1][:, None])
            a, b = np.nonzero(count >= least - (projections - early))
            left_over = count[a, b].astype(np.int64)
            for p in range(early, projections):
                at = place[b, p]
                left_over += (at >= run[p][0][a]) & (at < run[p][1][a])
                alive = left_over >= least - (projections - 1 - p)
                a, b, left_over = a[alive], b[alive], left_over[alive]
            a, b = q[a], r[b]
            if same:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[good], b[good]
            sums += np.bincount(a, weights=many[b], minlength=len(own)).astype(np.int64) + np.bincount(b, weights=many[a], minlength=len(own)).astype(np.int64)
            for i, j in zip(a.tolist(), b.tolist()):
                i, j = root(i), root(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
        at = np.flatnonzero(sums)
        rows["rep"] += rep[at].tolist()
        rows["links"] += sums[at].tolist()
        rows["other"] += [None] * len(at)
        child = [i for i in at.tolist() if root(i) != i]
        rows["rep"] += rep[child].tolist()
        rows["links"] += [None] * len(child)
        rows["other"] += [int(rep[root(i)]) for i in child]
    import pandas as pd

    return pd.DataFrame({k: pd.array(v, "Int64") for k, v in rows.items()})


def oracle() -> str:
    """DuckDB SQL for op3's rows: all pairs of a label, then components by repeated minima; for small tables."""
    return """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
    FROM embeddings e JOIN c USING (vec_id)"""
