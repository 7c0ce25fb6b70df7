"""Substring dedup: words are removed where a run of ``window`` words also starts in an earlier document.

Runs that occur once must not be shuffled, so a count-min sketch goes first. It counts runs by an anchor,
the least hash of the 8-word shingles in the run: equal runs have equal anchors, so an anchor's count
bounds the count of each of its runs, and neighbouring runs mostly share one, so about one anchor for
22 words is counted. Each task sketches its documents (an anchor once per document and stretch), the
tasks' sketches are summed up cell by cell, and cells that counted two or more make a bitmap of
``1 << sketch_bits`` bits at most, which is broadcast. A second pass emits only runs whose anchor is
estimated to be repeated, and groups them exactly, by 128 bits of hash and the first document id.
The sketch overestimates and so loses none; what it lets through needlessly, the exact pass drops.

Words are what ASCII white space separates. Defined results: a null or empty text has no words; rows
with a null id lose nothing and take nothing from others; rows that repeat an id are one document's:
they lose nothing to each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import apart
from ._text import U64, WHITE_SEP, mix, of_text, signed, slices, whole_runs, windows

#: Words in a shingle that may be an anchor.
ANCHOR = 8
#: Cells in a block of the sketch, the unit in which tasks' sketches are summed up.
BLOCK_BITS = 14


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    low, have = values, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs(s, window: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their byte ranges, the starts of all runs within one text, their anchors, and the first word of each text."""
    starts, ends, first = s.tokens(WHITE_SEP)
    words = s.hashes(starts, ends)
    at = whole_runs(first, window)
    width = min(ANCHOR, window)
    anchors = sliding_min(windows(words, width), window - width + 1)
    return words, (starts, ends), at, anchors[at], first


def cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each anchor, one in either half of the sketch."""
    half = U64((1 << (bits - 1)) - 1)
    other = mix(anchors ^ U64(0xA0761D6478BD642F))
    return (anchors & half).astype(np.int64), (other & half).astype(np.int64) + (1 << (bits - 1))


def sketch(rows: DataFrame, keys_of, bits: int) -> np.ndarray:
    """A bit for each cell that counted two or more, packed; 1 << (bits - 3) bytes."""
    block = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = [], []
        seen = np.zeros(0, np.int64)

        def merge() -> np.ndarray:
            every, many = np.unique(np.concatenate([seen, *once]), return_counts=True)
            twice.append(every[many > 1])
            once.clear()
            return every

        for _, s in slices(batches):
            keys, text = keys_of(s)
            own = np.unique(mix(keys) ^ text.astype(U64), return_index=True)[1]
            once += list(cells(keys[own], bits))
            if sum(map(len, once)) > max(1 << 20, len(seen) // 2):
                seen = merge()
        seen = merge()
        both = np.unique(np.concatenate(twice))
        for cut, many in ((seen, False), (both, True)):
            number = cut >> BLOCK_BITS
            begin = np.flatnonzero(np.diff(number, prepend=-1))
            sizes = np.diff(np.append(begin, len(cut)))
            low = (cut & (block - 1)).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(number[begin], pa.int64()), pa.array([low[2 * a : 2 * (a + n)] for a, n in zip(begin.tolist(), sizes.tolist())], pa.binary()), pa.array(np.full(len(begin), many))], ["block", "cells", "many"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, low, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held = sums.setdefault(number, np.zeros(block, np.uint8))
                at = np.frombuffer(low, "<u2")
                held[at] = np.minimum(held[at] + 1 + many, 2)
        for number, held in sums.items():
            if (held > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(held > 1).tobytes()], pa.binary())], ["block", "bits"])

    # Sums are kept per task as blocks of bytes; rows stream through, so no block's rows meet in memory.
    parts = rows.mapInArrow(count, "block long, cells binary, many boolean").repartition("block").mapInArrow(total, "block long, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.collect():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether keys are estimated to be repeated: both their cells counted two or more."""
    keep = np.ones(len(keys), bool)
    for c in cells(keys, bits):
        keep &= (bitmap[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
    return keep


def bitmap_of_repeated(rows: DataFrame, keys_of, per_byte: float, sketch_bits: int):
    """A broadcast bitmap of the cells that counted two or more, and the logarithm of its size.

    keys_of: slice -> (keys, the text of each); a text counts a key once. per_byte: keys expected for
    a byte of text; there are 16 cells for each, within bounds: this is for accuracy, not for results.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(sketch_bits, max(20, math.ceil(math.log2(16 * size * per_byte + 1))))
    return rows.sparkSession.sparkContext.broadcast(sketch(rows, keys_of, bits)), bits


def repeated(rows: DataFrame, window: int, sketch_bits: int) -> DataFrame:
    """(id, starts): the first words, packed, of the runs that an earlier document also has. rows: id, text.

    A task settles runs that its own documents repeat and sends on only those of the first of them, so a
    key has at most a few rows for each task; these meet once, sorted by document, and stream by.
    """

    def anchors_of(s) -> tuple[np.ndarray, np.ndarray]:
        _, _, at, anchors, first = runs(s, window)
        text = of_text(first)[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
        return anchors[new], text[new]

    # Of six bytes to a word, and one anchor for half a run's shingles.
    shared, bits = bitmap_of_repeated(rows, anchors_of, 2 / 6 / max(2, window - ANCHOR + 2), sketch_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            one, two, ids, starts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((ids, two, one))
            one, two, ids, starts = one[order], two[order], ids[order], starts[order]
            later = _later(one, two, ids)
            keep = ~later
            yield _rows(one[keep], two[keep], ids[keep], starts[keep])
            # What an earlier document here has is settled: a row for each document, to any partition.
            who, packed = _packed(ids[later], starts[later])
            yield _rows(mix(who.view(U64)).view(np.int64), np.zeros(len(who), np.int64), who, np.zeros(len(who), np.int64), packed)

        for _, s in slices(batches):
            words, spans, at, anchors, first = runs(s, window)
            at = at[in_bitmap(bitmap, anchors, bits)] if len(at) else at
            if len(at):
                text = np.searchsorted(first, at, side="right") - 1
                held.append((signed(windows(words, window)[at]), signed(windows(s.hashes(*spans, seed=12), window)[at]), s.ids.to_numpy()[text], at - first[text]))
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the key of the row before, and the first document that has it
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, ids, starts = (batch.column(i).to_numpy() for i in range(4))
            known = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            later = _later(one, two, ids, last)
            same = np.flatnonzero((one != one[-1]) | (two != two[-1]))
            begin = same[-1] + 1 if len(same) else 0
            if not (begin == 0 and last is not None and last[:2] == (one[-1], two[-1])):
                last = (one[-1], two[-1], ids[begin])
            later &= ~known
            who, packed = _packed(ids[later], starts[later])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(packed, pa.binary())], ["id", "packed"])
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(known)), batch.column(4).filter(pa.array(known))], ["id", "packed"])

    found = rows.mapInArrow(emit, "h1 long, h2 long, id long, start long, packed binary")
    settled = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id").mapInArrow(settle, "id long, packed binary")
    return settled.groupBy("id").agg(F.collect_list("packed").alias("starts"))


#: Runs that a task holds before it looks for those that its own documents repeat.
HELD = 2_000_000


def _later(one: np.ndarray, two: np.ndarray, ids: np.ndarray, last: tuple | None = None) -> np.ndarray:
    """Of rows sorted by key and id, those whose key an earlier document has; last: key and first id before them."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    begin = np.flatnonzero(new)
    least = ids[begin]
    if last is not None and len(one) and last[:2] == (one[0], two[0]):
        least[0] = min(least[0], last[2])
    return ids > np.repeat(least, np.diff(np.append(begin, len(one))))


def _packed(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each id once, with its starts as 32-bit integers."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order].astype("<i4")
    begin = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(ids))
    raw = starts.tobytes()
    return ids[begin], [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist())]


def _rows(one, two, ids, starts, packed: list | None = None) -> pa.RecordBatch:
    last = pa.nulls(len(ids), pa.binary()) if packed is None else pa.array(packed, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), last], ["h1", "h2", "id", "start", "packed"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep: list[str] | None = None, sketch_bits: int = 28) -> DataFrame:
    """The columns ``keep`` (the id by default), the kept words joined by blanks, n_words and n_removed of each row."""
    keep = [id_col] if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *keep).toDF("id", "text", *names)
    gone = repeated(rows.select("id", "text").where("id is not null"), window, sketch_bits)
    joined = rows.join(gone, "id", "left").select("id", "text", "starts", *names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in slices(batches):
            starts = batch.column(2)
            texts, n_words, n_removed = [], [], []
            for i in range(len(s)):
                words = s.text(i).split()
                n, drop = len(words), starts[i].as_py() if starts[i].is_valid else None
                if drop:
                    # Rows that repeat an id may differ in length; a start beyond the end covers nothing.
                    edge = np.zeros(n + window + 1, np.int64)
                    at = np.frombuffer(b"".join(drop), "<i4").astype(np.int64)
                    at = at[at + window <= n]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    left = np.flatnonzero(np.cumsum(edge)[:n] == 0).tolist()
                    words = [words[k] for k in left]
                texts.append(b" ".join(words).decode())
                n_words.append(n)
                n_removed.append(n - len(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "text", "n_words", "n_removed"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = joined.mapInArrow(cut, f"{kinds}, text string, n_words long, n_removed long")
    return out.toDF(*keep, *apart(keep, text_col, "n_words", "n_removed"))


def oracle() -> str:
    """DuckDB SQL for op1's rows, grouping all runs of 50 words."""
    return r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    r AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT g, min(doc_id) AS f FROM r GROUP BY g HAVING min(doc_id) < max(doc_id)),
    c AS (SELECT DISTINCT doc_id, p FROM (SELECT r.doc_id, unnest(range(r.i, r.i + 50)) AS p FROM r JOIN f USING (g) WHERE r.doc_id > f.f)),
    p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""
