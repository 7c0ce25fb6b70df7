"""Byte-level BPE over slices of texts, with each distinct piece encoded once.

The tokenizers library encodes a piece the first time it occurs in a worker. Pieces are the
library's own: where a text is cut depends on its characters and on the strings of added tokens
in it, and not on the rest of the vocabulary, so a piece has the same ids wherever it stands. The
string of an added token, such as <|endoftext|>, is a piece of its own and gets that token's id, as
the library does. If an added token also looks at its surroundings, texts with one are a piece each.
Pieces are looked up by hash and compared by their bytes. A tokenizer that normalises texts or cuts them
in another way than by the public byte-level pattern gets whole texts as pieces.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from ._text import Slice, ranges, same_bytes

#: Pieces kept by a worker; when there are more, it starts anew. Memory only: results don't depend on it.
KEPT, KEPT_BYTES = 3_000_000, 1 << 26
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The endings that the public byte-level pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            low, high = (x + (x >= 0xD800) * 0x800 for x in (m.start(), m.end() - 1))
            table[low : high + 1] = kind
    return table


def pieces(s: Slice, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces' starts, and the number of the first piece of each text.

    Pieces follow one another without gaps; the byte ranges from low to high are one each, and what
    lies between them is cut as texts of their own.
    """
    n = len(s.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(s.offsets), np.int64)
    at = np.flatnonzero((s.data & 0xC0) != 0x80)
    code = np.frombuffer(s.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    begins = np.zeros(len(code) + 1, bool)  # a text begins here
    begins[np.searchsorted(at, s.offsets)] = True
    low, high = np.searchsorted(at, low), np.searchsorted(at, high)
    begins[low] = begins[high] = True
    m = len(code)
    same = np.zeros(m, bool)
    same[1:] = kind[1:] == kind[:-1]
    cut = ~same | begins[:m]
    space = kind == SPACE
    # The last white space before a word belongs to the word if it is a blank, else stands alone.
    next_word = np.zeros(m, bool)
    next_word[:-1] = space[:-1] & ~space[1:] & ~begins[1:m]
    last = np.flatnonzero(next_word)
    cut[last] = True
    blank = last[code[last] == 32]
    cut[blank + 1] = False
    # 's and its like: an apostrophe that begins a piece of its own.
    quote = np.flatnonzero((code[:-1] == 39) & cut[:-1]) if m > 1 else np.zeros(0, np.int64)
    for q in quote.tolist():
        if begins[q + 1] or kind[q + 1] != LETTER:
            continue
        for e in ENDINGS:
            if q + 1 + len(e) <= m and all(code[q + 1 + i] == ord(c) and not begins[q + 1 + i] for i, c in enumerate(e)):
                cut[q + 1] = False
                if q + 1 + len(e) < m:
                    cut[q + 1 + len(e)] = cut[q + 1 + len(e)] or kind[q + 1 + len(e)] == LETTER
                break
    cut[ranges(low + 1, high - low - 1)] = False
    starts = at[cut]
    return starts, np.searchsorted(starts, s.offsets)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.plain = not any(x.single_word or x.lstrip or x.rstrip or x.normalized or "\n" in x.content for x in added)
        # Leftmost, then longest.
        self.added = re.compile(b"|".join(re.escape(x.content.encode()) for x in sorted(added, key=lambda x: -len(x.content.encode())))) if added else None
        rules = json.loads(self.tokenizer.to_str())
        cutter = rules.get("pre_tokenizer") or {}
        self.byte_level = not rules.get("normalizer") and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of the pieces, ascending
        self.slot = np.zeros(0, np.int64)  # where each is in begin and count
        self.begin, self.count, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0
        # The bytes of the piece in each slot.
        self.raw_begin, self.raw_size, self.raw, self.raw_used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint8), 0

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for pieces; many are encoded as lines of one string, for speed."""
        plain = [not x.isspace() and "\n" not in x for x in texts]
        out: list = [None] * len(texts)
        lines, rest = [i for i, p in enumerate(plain) if p], [i for i, p in enumerate(plain) if not p]
        if len(self.line_feed) != 1 or not self.plain or not self.byte_level:
            lines, rest = [], list(range(len(texts)))
        for k in range(0, len(lines), 1000):
            part = lines[k : k + 1000]
            ids = np.array(self.tokenizer.encode("\n".join([texts[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            found = np.split(ids, np.flatnonzero(ids == self.line_feed[0]))
            if len(found) != len(part):
                rest += part
                continue
            for i, x in zip(part, found):
                out[i] = x[1:] if i != part[0] else x
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array([len(x) for x in out], np.int64)

    def _store(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces, which get new slots."""
        ids, counts = self._encode_pieces([x.decode() for x in pieces])
        raw, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces], np.int64)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.raw_used + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        slots = len(self.begin) + np.arange(len(pieces))
        self.begin, self.count = np.concatenate([self.begin, self.used + np.cumsum(counts) - counts]), np.concatenate([self.count, counts])
        self.raw_begin, self.raw_size = np.concatenate([self.raw_begin, self.raw_used + np.cumsum(sizes) - sizes]), np.concatenate([self.raw_size, sizes])
        self.used, self.raw_used = self.used + len(ids), self.raw_used + len(raw)
        return slots

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, self._store(pieces)])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.slot[at], -1)

    def _whole(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The byte ranges that aren't cut: strings of added tokens, or the whole texts that hold one."""
        data, found = s.data.tobytes(), []
        if self.added is not None and self.added.search(data):
            for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist()):
                own = [m.span() for m in self.added.finditer(data, a, b)]
                found += own if self.plain or not own else [(a, b)]
        low, high = np.array(found, np.int64).reshape(-1, 2).T
        return low, high

    def encode(self, s: Slice, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the number of each text's."""
        if self.byte_level:
            starts, first = pieces(s, *self._whole(s))
        else:
            starts = s.offsets[:-1][np.diff(s.offsets) > 0]
            first = np.searchsorted(starts, s.offsets)
        ends = np.append(starts[1:], len(s.data))[: len(starts)]
        every = s.hashes(starts, ends)
        hashes, where, back = np.unique(every, return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > KEPT or self.raw_used > KEPT_BYTES:
            self.clear()
        data = s.data.tobytes()
        text = lambda at: [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        slot = self._find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            self._add(hashes[new], text(where[new]))
            slot = self._find(hashes)
        k = slot[back]
        right = self.raw_size[k] == ends - starts
        at = np.flatnonzero(right)
        right[at] = same_bytes(s.data, starts[at], self.raw, self.raw_begin[k[at]], (ends - starts)[at])
        wrong = np.flatnonzero(~right)
        if len(wrong):  # other pieces of the same hash
            k[wrong] = self._store(text(wrong))
        per = self.count[k]
        ids = self.pool[ranges(self.begin[k], per)]
        total = np.concatenate([[0], np.cumsum(per)])
        counts = np.diff(total[first])
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


@lru_cache
def cached(path: str) -> Encoder:
    return Encoder(path)
