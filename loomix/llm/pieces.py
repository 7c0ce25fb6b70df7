"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the agenda of byte-pair merging: of all neighbouring symbols whose join is a
piece, the one with the best score, leftmost among equals, is merged next. With dropout, a keyed
hash of (seed, id of the text, position of the word in it, extent of the candidate) decides once for
each candidate whether it is skipped; without dropout the ids are those of the sentencepiece library.
A document's segmentation is the same in every run and on every executor, while documents, seeds and
the places of a word in a text differ.

Words (a run of blanks and what follows up to the next blank) are segmented apart, which is
exact when no piece has a blank after another character; this is verified when the model is
loaded. Symbols that no piece can span cut words further. The merges of many words advance side
by side in arrays. Words segmented before are looked up by hash and compared by their bytes.

Decoding joins the pieces, byte pieces as bytes, and drops the blank put before the text. It gives
back every text: the sign U+2581, which stands for a blank in pieces, is written as bytes when it
occurs in a text.

Defined results: a null or empty text has no ids and decodes to the empty string; null ids count as
one id; repeated rows are encoded each, equal rows alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import apart
from ._text import U64, Slice, mix, ranges, same_bytes, slices

SPACE = 0x2581
#: Words kept by a worker when nothing is skipped; when there are more, it starts anew. Memory only.
KEPT, KEPT_BYTES = 1_000_000, 1 << 25
#: Words whose occurrences are segmented at once; a long text has more. Memory only.
WORDS = 1 << 16


class PieceModel:
    """Pieces, scores and the table of merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any("▁" in pieces[i].lstrip("▁") for i in normal):
            raise ValueError("a piece has a blank after another character; words can't be encoded apart")
        number, is_normal = {pieces[i]: i for i in normal}, set(normal)
        score = np.array([sp.get_score(i) for i in range(size)])
        self.byte = np.zeros(256, np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
        self.single = np.full(0x110000, -1, np.int32)  # the piece of a lone character
        for p, i in number.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        merges = [(number[p[:k]], number[p[k:]], i) for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, to = np.array(merges, np.int64).reshape(-1, 3).T
        key = left * size + right
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        # Smaller is better; pieces of equal score count as equal.
        self.rank = np.searchsorted(np.unique(-score), -score).astype(np.int64)
        self.size = size
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() if i in is_normal else b"" for i, p in enumerate(pieces)]
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours join to, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.to[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text's ids."""
        raw = self.pool[ranges(self.begin[ids], self.length[ids])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def segment(model: PieceModel, symbols: np.ndarray, counts: np.ndarray, keys: np.ndarray | None, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the symbols of many words side by side; returns the pieces and their number for each word.

    keys: a hash for each word, of which and of a candidate's extent the decision to skip it is
    made; skip: candidates whose 32-bit decision hash lies below it are skipped.
    """
    first = np.cumsum(counts) - counts
    kept = np.zeros(len(symbols), bool)  # a symbol's place holds a piece that begins there
    symbols = symbols.copy()
    done = 0
    for longest in (1, 4, 6, 8, 10, 12, 16, 24, 32, 64, 1 << 62):
        pick = np.flatnonzero((counts > done) & (counts <= longest))
        done = longest
        for k in range(0, len(pick), 1 << 14):
            rows = pick[k : k + (1 << 14)]
            own = None if keys is None else keys[rows]
            if longest == 1:
                kept[first[rows]] = True
            elif longest > 64:
                for i, r in enumerate(rows.tolist()):
                    a = first[r]
                    _merge_long(model, symbols[a : a + counts[r]], kept[a : a + counts[r]], None if own is None else int(own[i]), skip)
            else:
                at = ranges(first[rows], counts[rows])
                merged, mask = _merge_block(model, symbols[at], counts[rows], own, skip)
                kept[at] = mask
                symbols[at[mask]] = merged
    total = np.concatenate([[0], np.cumsum(kept)])
    return symbols[kept], total[first + counts] - total[first]


def _decision(keys, begin, middle, end):
    """A 32-bit hash of a candidate: the word's key and the extents of its two parts."""
    return mix(keys + (begin.astype(U64) * U64(0x10001) + middle.astype(U64)) * U64(0x100000001) + end.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)


def _merge_block(model: PieceModel, symbols, counts, keys, skip):
    n, width = len(counts), int(counts.max())
    inside = np.arange(width) < counts[:, None]
    # One more column, so that every cell has a right neighbour; cells are numbered through all rows.
    sym = np.full((n, width + 1), -1, np.int32)
    sym[:, :width][inside] = symbols
    flat = sym.reshape(-1)
    cells = np.arange(n * (width + 1), dtype=np.int32)
    after, before = cells + 1, cells - 1
    row_of = lambda cell: cell // (width + 1)
    worst = np.int32(2**31 - 1)
    rank, to = np.full(flat.shape, worst, np.int32), np.full(flat.shape, -1, np.int32)
    alive = np.zeros((n, width + 1), bool)
    alive[:, :width] = inside
    alive = alive.reshape(-1)

    def propose(cell: np.ndarray) -> None:
        join = model.merge(flat[cell].astype(np.int64), flat[after[cell]].astype(np.int64))
        if keys is not None and skip:
            some = np.flatnonzero(join >= 0)
            c = cell[some]
            base = row_of(c) * (width + 1)
            drop = _decision(keys[row_of(c)], c - base, after[c] - base, after[after[c]] - base) < U64(skip)
            join[some[drop]] = -1
        to[cell] = join
        rank[cell] = np.where(join >= 0, model.rank[join], worst)

    propose(np.flatnonzero(inside_pairs(alive)))
    ranks = rank.reshape(n, width + 1)
    live = np.arange(n)
    while True:
        part = ranks[live]
        at = part.argmin(1)
        some = part[np.arange(len(live)), at] < worst
        live, at = live[some], at[some]
        if not len(live):
            return flat[alive], alive.reshape(n, width + 1)[:, :width][inside]
        left = (live * (width + 1) + at).astype(np.int32)
        right = after[left]
        beyond = after[right]
        flat[left] = to[left]
        alive[right] = False
        rank[right] = worst
        after[left] = beyond
        before[beyond[beyond < len(flat)]] = left[beyond < len(flat)]
        propose(left[alive[np.minimum(beyond, len(flat) - 1)] & (beyond < len(flat))])
        lone = left[~(alive[np.minimum(beyond, len(flat) - 1)] & (beyond < len(flat)))]
        rank[lone] = worst
        previous = before[left[at > 0]]
        propose(previous)


def inside_pairs(alive: np.ndarray) -> np.ndarray:
    """Cells that live and whose right neighbour lives."""
    out = alive.copy()
    out[:-1] &= alive[1:]
    out[-1] = False
    return out


def _merge_long(model: PieceModel, symbols: np.ndarray, kept: np.ndarray, key: int | None, skip: int) -> None:
    """The same for one long word, in place, with an agenda in a heap."""
    import heapq

    n = len(symbols)
    sym, begin, end = symbols.tolist(), list(range(n)), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list = []

    def propose(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
        if not lefts:
            return
        a, b = np.array(lefts), np.array([after[i] for i in lefts])
        to = model.merge(np.array([sym[i] for i in lefts]), np.array([sym[j] for j in b]))
        if key is not None and skip:
            drop = _decision(np.full(len(a), key, U64), np.array([begin[i] for i in a]), np.array([end[i] for i in a]), np.array([end[j] for j in b])) < U64(skip)
            to[drop] = -1
        for i, j, t in zip(a.tolist(), b.tolist(), to.tolist()):
            if t >= 0:
                heapq.heappush(agenda, (int(model.rank[t]), i, j, sym[i], sym[j], t))

    propose(list(range(n - 1)))
    while agenda:
        _, i, j, x, y, t = heapq.heappop(agenda)
        if sym[i] != x or sym[j] != y or after[i] != j or begin[i] < 0:
            continue
        sym[i], end[i] = t, end[j]
        sym[j], begin[j] = -2, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        propose([before[i], i])
    i = 0
    while i >= 0:
        symbols[i], kept[i] = sym[i], True
        i = after[i]


class Encoder:
    """Encodes slices. Without dropout, segmentations of words are kept for the next ones; with it each occurrence has its own."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        self.model, self.seed, self.skip = PieceModel(path), seed, int(dropout * 2**32)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint16 if self.model.size <= 65536 else np.uint32), 0
        # The bytes of the word in each slot, with the blank before it.
        self.raw_begin, self.raw_size, self.raw, self.raw_used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint8), 0

    def text_keys(self, ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """A hash of the seed and each text's id."""
        own = np.where(nulls, U64(0x94D049BB133111EB), mix(ids.astype(np.int64).view(U64) + U64(0xBF58476D1CE4E5B9)))
        return mix(own + U64(self.seed * 0xD1342543DE82EF95 & (2**64 - 1)))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.slot[at], -1)

    def _segment(self, words: list[str], word_keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and the number of each word's."""
        model = self.model
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        code = points.astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        blank = code == 0x20
        code = np.where(blank, SPACE, code)
        sym = model.single[code].astype(np.int64)
        literal = points == SPACE
        sym[literal] = -1
        # Parts: maximal runs of characters with a piece, and each other character alone.
        bad = sym < 0
        cut = np.ones(len(sym), bool)
        cut[1:] = (word[1:] != word[:-1]) | bad[1:] | bad[:-1]
        part_first = np.flatnonzero(cut)
        part_count = np.diff(np.append(part_first, len(sym)))
        part_word = word[part_first]
        part_bad = bad[part_first]
        keys = None
        if word_keys is not None:
            keys = mix(word_keys[part_word] + (part_first - (np.cumsum(lengths) - lengths)[part_word]).astype(U64) * U64(0x9FB21C651E98DF25))
        good = ~part_bad
        pieces, counts = segment(model, sym[np.repeat(good, part_count)], part_count[good], None if keys is None else keys[good], self.skip)
        per_part = np.zeros(len(part_first), np.int64)
        per_part[good] = counts
        bad_bytes = [chr(c).encode() for c in points[part_first[part_bad]].tolist()]
        per_part[part_bad] = [len(b) for b in bad_bytes]
        ids = np.zeros(int(per_part.sum()), np.int64)
        at = np.cumsum(per_part) - per_part
        ids[ranges(at[good], per_part[good])] = pieces
        ids[ranges(at[part_bad], per_part[part_bad])] = model.byte[np.frombuffer(b"".join(bad_bytes), np.uint8)]
        return ids, np.bincount(part_word, weights=per_part, minlength=len(words)).astype(np.int64)

    def _store(self, words: list[str]) -> np.ndarray:
        """Segments words, which get new slots."""
        ids, per_word = self._segment(words, None)
        raw = [w.encode() for w in words]
        sizes, raw = np.array([len(w) for w in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.raw_used + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        slots = len(self.begin) + np.arange(len(words))
        self.begin, self.count = np.concatenate([self.begin, self.used + np.cumsum(per_word) - per_word]), np.concatenate([self.count, per_word])
        self.raw_begin, self.raw_size = np.concatenate([self.raw_begin, self.raw_used + np.cumsum(sizes) - sizes]), np.concatenate([self.raw_size, sizes])
        self.used, self.raw_used = self.used + len(ids), self.raw_used + len(raw)
        return slots

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, self._store(words)])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the number of each text's."""
        data = s.data
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(s), np.int64)
        blank = data == 0x20
        cut = np.zeros(n, bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        begins = s.offsets[:-1][np.diff(s.offsets) > 0]
        cut[begins] = True
        # Also cut around line feeds, which no piece spans, so that words recur more often.
        feed = data == 0x0A
        if self.model.single[0x0A] < 0:
            cut |= feed
            cut[1:] |= feed[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        first = np.searchsorted(starts, s.offsets)
        head = np.zeros(len(starts), bool)  # a word at a text's beginning has a blank put before it
        head[np.searchsorted(starts, begins)] = True
        raw = data.tobytes()
        words = lambda at: [(" " if h else "") + raw[a:b].decode() for a, b, h in zip(starts[at].tolist(), ends[at].tolist(), head[at].tolist())]
        if self.skip:
            own = self.text_keys(s.ids.fill_null(0).to_numpy(zero_copy_only=False), s.ids.is_null().to_numpy(zero_copy_only=False))
            per_text = np.diff(first)
            position = (starts - np.repeat(s.offsets[:-1], per_text)).astype(U64)
            keys = mix(np.repeat(own, per_text) + position * U64(0xA24BAED4963EE407))
            found = [self._segment(words(slice(k, k + WORDS)), keys[k : k + WORDS]) for k in range(0, len(starts), WORDS)]
            out, per = (np.concatenate(x) for x in zip(*found))
        else:
            hashes = mix(s.hashes(starts, ends) + head.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            hashes, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) + len(hashes) > KEPT or self.raw_used > KEPT_BYTES:
                self.clear()
            slot = self._find(hashes)
            new = np.flatnonzero(slot < 0)
            if len(new):
                self._add(hashes[new], words(where[new]))
                slot = self._find(hashes)
            k = slot[back]
            sizes, extra = ends - starts, head.astype(np.int64)
            right = self.raw_size[k] == sizes + extra
            at = np.flatnonzero(right)
            blank_first = ~head[at] | (self.raw[self.raw_begin[k[at]]] == 0x20)
            right[at] = blank_first & same_bytes(data, starts[at], self.raw, self.raw_begin[k[at]] + extra[at], sizes[at])
            wrong = np.flatnonzero(~right)
            if len(wrong):  # other words of the same hash
                k[wrong] = self._store(words(wrong))
            per = self.count[k]
            out = self.pool[ranges(self.begin[k], per)].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(per)])
        return out, np.diff(total[first])


@lru_cache
def cached(path: str, dropout: float, seed: int) -> Encoder:
    return Encoder(path, dropout, seed)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0, variants: int | None = None) -> DataFrame:
    """(id, ids array<int>) of each row; one pass, no shuffle. variants is accepted and has no effect: nothing is shared."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached(model_path, dropout, seed)
        for batch, s in slices(batches):
            ids, counts = encoder.encode(s)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and the text that each row's ids stand for; named kept_text if a kept column is called text."""
    names = [f"_{i}" for i in range(len(keep))]
    rows = df.select(ids_col, *keep).toDF("ids", *names)
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cached(model_path, 0.0, 0).model
        for batch in batches:
            texts = [model.decode(np.array(x, np.int64)).decode() if x else "" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*names, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string").toDF(*keep, *apart(keep, "text"))


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0, variants: int | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass: (id, n_tokens, ids_crc32, decoded_crc32, lossless).

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, decoded_crc32 over the
    decoded text's UTF-8 bytes; lossless says whether those bytes are the text's. variants has no effect.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached(model_path, dropout, seed)
        model = encoder.model
        for batch, s in slices(batches):
            ids, counts = encoder.encode(s)
            ends = np.cumsum(counts)
            flat = model.pool[ranges(model.begin[ids], model.length[ids])].tobytes()
            stop = np.concatenate([[0], np.cumsum(model.length[ids])])
            raw, source = ids.astype("<u4").tobytes(), s.data.tobytes()
            out = []
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                text = flat[stop[a] + (b > a) : stop[b]]
                out.append((zlib.crc32(raw[4 * a : 4 * b]), zlib.crc32(text), text == source[s.offsets[i] : s.offsets[i + 1]]))
            crc, decoded, same = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(decoded, pa.int64()), pa.array(same)], ["id", "n_tokens", "ids_crc32", "decoded_crc32", "lossless"])

    return rows.mapInArrow(run, "id long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean").withColumnRenamed("id", id_col)
