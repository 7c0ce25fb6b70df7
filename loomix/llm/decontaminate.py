"""Benchmark decontamination: which words of documents lie in runs of words that benchmark items hold.

A window is ``window`` consecutive words of an item (all of them if it has fewer). A window occurs in a
document when it is contained whole, so of its shingles (``shingle`` words) any one must be found: the
join's necessary prefix is one shingle, and the rarest in the documents is taken. The join is then
narrowed by bounds - the shingle's offset in the window fixes where the window would have to lie, and
it must fit into the document - and each candidate is verified word for word.

Items are taken in blocks of about ``block_bytes`` of text, by a hash of id and text; a block's index, some
dozen times its text, is broadcast, and a scan for each block counts its shingles and another finds its
windows. No pass shuffles documents.

Words are [0-9a-z] and all characters beyond ASCII, after lower-casing A-Z. Defined results: null and empty
texts have no words; items without words or with a null id are left out; rows with a null id are judged as
any other; repeated rows and items are judged each, an item id counting once; an empty table of documents
gives an empty result, one of items hits nothing; other columns are ignored. A kept column of the name of a
result leaves that name to the column, and the result gets kept_ before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import apart
from ._text import ALNUM_SEP, LOWER, Bits, Slice, lists, of_text, ranges, same_bytes, signed, slices, whole_runs, windows


class Windows:
    """The distinct windows of some items: words ``first`` to ``first + size``, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], pa.string()), pa.array([t for _, t in items], pa.string())], ["id", "text"])
        _, s = next(slices(iter([batch]), max_bytes=1 << 62, max_rows=1 << 62)) if items else (None, Slice(batch.column(0), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)))
        self.data, self.shingle = LOWER[s.data], shingle
        self.starts, self.ends, first = s.tokens(ALNUM_SEP)
        words, other = (s.hashes(self.starts, self.ends, lower=True, seed=seed) for seed in (11, 12))
        count = np.diff(first)
        size = np.minimum(count, window)
        at = ranges(first[:-1], np.where(count > 0, count - size + 1, 0))
        item = of_text(first)[at] if len(at) else at
        size = size[item]
        # Windows are equal if two hashes and the size are.
        key = np.zeros(len(at), np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<i8")]))
        key["n"] = size
        for n in np.unique(size).tolist():
            own = size == n
            key["a"][own], key["b"][own] = windows(words, n)[at[own]], windows(other, n)[at[own]]
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        self.first, self.size = at[one], size[one]
        names, number = np.unique(s.ids.to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if len(at) else (np.zeros(0, object), np.zeros(0, np.int64))
        held = np.unique(np.column_stack([back.reshape(-1), number[item]]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.names, self.item = names, held[:, 1]
        self.item_first = np.searchsorted(held[:, 0], np.arange(len(one) + 1))
        # The hash of the shingle that begins at each word, by the shingle's length.
        self.hashes = {k: windows(words, k) for k in np.unique(np.minimum(self.size, shingle)).tolist()}

    def distinct(self) -> dict[int, np.ndarray]:
        length = np.minimum(self.size, self.shingle)
        return {k: np.unique(h[np.unique(ranges(self.first[length == k], (self.size - k + 1)[length == k]))]) for k, h in self.hashes.items()}


class Prefixes:
    """For each length of shingles: the prefix shingles, ascending, with the windows that they stand for."""

    def __init__(self, held: Windows, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: by length, the shingles, ascending, and how often each occurs in the documents."""
        rows: dict[int, list] = {}
        for n in np.unique(held.size).tolist():
            own = np.flatnonzero(held.size == n)
            k = min(held.shingle, n)
            at = held.first[own][:, None] + np.arange(n - k + 1)
            h = held.hashes[k][at]
            keys, many = counts[k]
            count = many[np.searchsorted(keys, h)]
            # The rarest one, of the least hash among equals.
            order = np.lexsort((np.broadcast_to(np.arange(n - k + 1), h.shape), h, count), axis=1)[:, 0]
            pick = np.arange(len(own))
            some = count[pick, order] > 0  # else it occurs nowhere
            rows.setdefault(k, []).append((h[pick, order][some], own[some], order[some]))
        self.by = {}
        for k, x in rows.items():
            h, w, o = (np.concatenate(c) for c in zip(*x))
            if not len(h):
                continue
            order = np.lexsort((o, w, h))
            keys, first, many = np.unique(h[order], return_index=True, return_counts=True)
            self.by[k] = (keys, first, many, w[order], o[order], first_look(keys))
        self.size, self.first, self.data, self.starts, self.ends = held.size, held.first, held.data, held.starts, held.ends
        self.names, self.item, self.item_first = held.names, held.item, held.item_first

    def items(self, window: np.ndarray) -> list[str]:
        """The items that hold any of these windows."""
        window = np.unique(window)
        return self.names[np.unique(self.item[ranges(self.item_first[window], np.diff(self.item_first)[window])])].tolist()


def first_look(keys: np.ndarray) -> Bits:
    return Bits(keys, 1 << max(16, int(np.ceil(np.log2(len(keys) + 1))) + 4))


def lookup(keys: np.ndarray, look: Bits, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of hashes that are among the sorted keys, and which."""
    at = np.flatnonzero(look(hashes))
    k = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
    same = keys[k] == hashes[at]
    return at[same], k[same]


def find(index: Prefixes, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a slice: text, window, first word and word after the last; and the first word of each text."""
    starts, ends, first = s.tokens(ALNUM_SEP)
    words, data = s.hashes(starts, ends, lower=True), LOWER[s.data]
    out = []
    for k, (keys, begin, many, window, offset, look) in index.by.items():
        runs = whole_runs(first, k)
        if not len(runs):
            continue
        at, key = lookup(keys, look, windows(words, k)[runs])
        pos = np.repeat(runs[at], many[key])
        row = ranges(begin[key], many[key])
        w, pos = window[row], pos - offset[row]
        text = np.searchsorted(first, np.repeat(runs[at], many[key]), side="right") - 1
        fits = (pos >= first[text]) & (pos + index.size[w] <= first[text + 1])
        w, pos, text = w[fits], pos[fits], text[fits]
        # Word for word: lengths, then bytes.
        size = index.size[w]
        here, there, of = ranges(pos, size), ranges(index.first[w], size), np.repeat(np.arange(len(w)), size)
        length = ends[here] - starts[here]
        wrong = np.bincount(of[length != index.ends[there] - index.starts[there]], minlength=len(w)) > 0
        check = ~wrong[of]
        unlike = ~same_bytes(data, starts[here[check]], index.data, index.starts[there[check]], length[check])
        wrong |= np.bincount(of[check][unlike], minlength=len(w)) > 0
        out.append((text[~wrong], w[~wrong], pos[~wrong], (pos + size)[~wrong]))
    text, w, a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return text, w, a, b, first


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The columns ``keep``, n_words, spans and items of each row.

    spans: first words and words after the last of the disjoint hit runs, in turn; items: the ids,
    as sorted strings, of items with a window that occurs.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = [f"_{i}" for i in range(len(keep))]
    plain = docs.select(F.lit(0).cast("long"), F.col(text_col).cast("string"), *keep).toDF("id", "text", *names)
    state = plain.select("id", "text", *names, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        held = Windows([(r["id"], r["text"]) for r in part.collect()], window, shingle)
        state = _scan(state, _index(spark, plain, held))
    return state.select(*names, "n_words", "spans", "items").toDF(*keep, *apart(keep, "n_words", "spans", "items"))


def _index(spark, docs: DataFrame, held: Windows):
    """The windows' rarest shingles, broadcast; a block's size bounds it and its counts."""
    distinct = held.distinct()
    shared = spark.sparkContext.broadcast({k: (v, first_look(v)) for k, v in distinct.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros(len(v), np.int64) for k, (v, _) in shared.value.items()}
        for _, s in slices(batches):
            starts, ends, first = s.tokens(ALNUM_SEP)
            words = s.hashes(starts, ends, lower=True)
            for k, (keys, look) in shared.value.items():
                runs = whole_runs(first, k)
                if len(runs):
                    counts[k] += np.bincount(lookup(keys, look, windows(words, k)[runs])[1], minlength=len(keys))
        for k, (keys, _) in shared.value.items():
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(signed(keys[at])), pa.array(counts[k][at])], ["k", "h", "n"])

    # Bounded by the block: a row for each of its shingles.
    found = docs.select("id", "text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow() if distinct else None
    shared.unpersist()
    counts = {}
    for k, keys in distinct.items():
        counts[k] = (keys, np.zeros(len(keys), np.int64))
        own = found.filter(pc.equal(found["k"], k))
        counts[k][1][np.searchsorted(keys, own["h"].to_numpy().view(np.uint64))] = own["n"].to_numpy()
    return spark.sparkContext.broadcast(Prefixes(held, counts))


def _scan(state: DataFrame, shared) -> DataFrame:
    schema = state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, s in slices(batches):
            text, w, a, b, first = find(index, s)
            n = np.diff(first)
            spans, items = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            old = np.diff(spans.offsets.to_numpy()) // 2
            flat = spans.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            at = np.repeat(first[:-1], old)
            edge = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(edge, np.concatenate([a, flat[:, 0] + at]), 1)
            np.add.at(edge, np.concatenate([b, flat[:, 1] + at]), -1)
            hit = np.cumsum(edge) > 0
            hit[-1:] = False
            # Runs end at a text's end too.
            here = hit[:-1]
            begins, ends = here.copy(), here.copy()
            begins[1:] &= ~here[:-1]
            ends[:-1] &= ~here[1:]
            inner = first[(first > 0) & (first < len(here))]
            begins[inner] = here[inner]
            ends[inner - 1] = here[inner - 1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            of = np.searchsorted(first, begins, side="right") - 1
            flat = np.stack([begins - first[of], ends - first[of]], 1).reshape(-1)
            names = items.to_pylist()
            for t in np.unique(text).tolist():
                names[t] = sorted({*names[t], *index.items(w[text == t])})
            columns = [*batch.columns[:-3], pa.array(n, pa.int64()), lists(flat, 2 * np.bincount(of, minlength=len(s)), pa.int64()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return state.mapInArrow(run, schema)


def oracle() -> str:
    """DuckDB SQL for op2's rows, by exact comparison of all windows; for small tables."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT doc_id, {words} AS w FROM documents),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
