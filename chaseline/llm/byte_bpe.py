"""Token ids of whole texts under a byte-level BPE vocabulary, a slice of texts at a time.

The usual text (ASCII and Latin-1 letters, no apostrophe) is cut into pre-tokens with
whole-array operations; each distinct pre-token of a slice is merged once and kept in a
bounded cache. Any other text goes through the library's own encoder.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytespans import distinct_spans, text_slices

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _NUMBER
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER
CACHE_ENTRIES = 300_000


class ByteBpe:
    """Encodes with the ranks in ``path``; ``special`` texts become their own ids."""

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.special = dict(special)
        self.whole = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.cache: dict[bytes, bytes] = {}
        self.odd = re.compile(b"|".join(re.escape(s.encode()) for s in self.special) or b"(?!)")

    def piece(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        found = self.cache.get(word)
        if found is None:
            rank = self.ranks.get(word)
            ids = [rank] if rank is not None else self.whole._encode_single_piece(word)
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            found = self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def slow(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode(), allowed_special=set(self.special), disallowed_special=()), dtype="<u4").tobytes()

    def encode(self, column: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(row, little-endian 32-bit ids) of each text."""
        for first, last, buf, off in text_slices(column):
            body = buf[: off[-1]]
            codes, pool, bounds = self._slice(buf, body, off)
            odd = _rows_with(_odd_bytes(body), off)
            raw = body.tobytes()
            for found in self.odd.finditer(raw):
                odd[np.searchsorted(off, found.start(), side="right") - 1] = True
            take = pool.__getitem__
            for row in range(last - first):
                if odd[row]:
                    yield first + row, self.slow(raw[off[row] : off[row + 1]])
                else:
                    yield first + row, b"".join(map(take, codes[bounds[row] : bounds[row + 1]]))

    def _slice(self, buf: np.ndarray, body: np.ndarray, off: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray]:
        starts = pre_token_starts(body, off)
        ends = np.append(starts[1:], len(body))
        codes, first = distinct_spans(buf, starts, ends)
        raw = body.tobytes()
        pool = [self.piece(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        return codes.tolist(), pool, np.searchsorted(starts, off)


def _odd_bytes(body: np.ndarray) -> np.ndarray:
    """Bytes that the whole-array cut doesn't know: apostrophes, and all beyond ASCII but Latin-1 letters."""
    odd = (body == 0x27) | (body >= 0xC4) | (body == 0xC2)
    odd[:-1] |= (body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7))
    return odd


def _rows_with(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    at = np.searchsorted(np.flatnonzero(flags), off)
    return at[1:] > at[:-1]


def pre_token_starts(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of `` ?letters| ?numbers| ?others|white space``; of white space before a word, the last character stands
    apart, or joins the word if it is a space."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[body]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    start = np.ones(n, dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    runs = np.flatnonzero(start)
    after = runs[1:][(kind[runs[:-1]] == _SPACE) & ~edge[runs[1:]]]
    start[after - 1] = True
    start[after[body[after - 1] == 32]] = False
    return np.flatnonzero(start)


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> ByteBpe:
    """One encoder, with its cache, for each worker."""
    return ByteBpe(path, pattern, special)
