"""BPE encoding and decoding with a vocabulary file (operator 3).

Merges are taken from a priority queue of ranks over a doubly linked list of symbols;
an entry whose symbols have changed since it was queued is stale and skipped. Each
distinct pre-token of a slice is merged once and kept in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import _KIND, _NUMBER, _SPACE, _odd_bytes, _rows_with
from .bytespans import distinct_spans, lower_ascii, text_slices
from .shared import id_and_text

CACHE_ENTRIES = 250_000


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A lower-casing byte-level BPE with word ends, as its ``tokenizers`` JSON file describes it.

    Normalising and cutting of unusual texts is left to the library; merging never is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.added.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.library = Tokenizer.from_file(path)
        self.letters = str.maketrans(byte_letters())
        self.specials = re.compile("|".join(re.escape(s) for s in self.added) or "(?!)")
        self.special_bytes = re.compile(self.specials.pattern.encode())
        self.cache: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token, given in the vocabulary's letters."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((joined, ids[k])):
                    heapq.heappush(queue, (found[0], i, joined, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], joined))):
                heapq.heappush(queue, (found[0], h, ids[h], joined, found[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in a row; this vocabulary has no decoder, so a space stands between them."""
        return " ".join(map(self.names.__getitem__, ids))

    def piece(self, word: str) -> tuple[bytes, str]:
        """Little-endian ids and decoded text, with a space behind it, of one pre-token."""
        found = self.cache.get(word)
        if found is None:
            ids = self.merge(word)
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            found = self.cache[word] = struct.pack(f"<{len(ids)}i", *ids), self.decode(ids) + " "
        return found

    def slow(self, text: str) -> tuple[bytes, str]:
        """Any text: special tokens first, then the library's normaliser and cut between them."""
        out = []
        at = 0
        for found in [*self.specials.finditer(text), None]:
            plain = self.library.normalizer.normalize_str(text[at : found.start() if found else len(text)])
            out += [self.piece(word) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain) if word]
            if found:
                out.append((struct.pack("<i", self.added[found[0]]), found[0] + " "))
                at = found.end()
        return b"".join(x[0] for x in out), "".join(x[1] for x in out)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, list[bytes], list[str]]]:
        """(first row, next row, ids of each, decoded text of each) for one slice of texts after another."""
        for first, last, buf, off in text_slices(column):
            raw = buf[: off[-1]].tobytes()
            odd = _rows_with(_odd_bytes(buf[: off[-1]]), off)
            for found in self.special_bytes.finditer(raw):
                odd[np.searchsorted(off, found.start(), side="right") - 1] = True
            codes, pool, bounds = self._slice(buf, off)
            ids_of, text_of = [x[0] for x in pool], [x[1] for x in pool]
            ids, texts = [], []
            for row in range(last - first):
                if odd[row]:
                    one, two = self.slow(raw[off[row] : off[row + 1]].decode())
                else:
                    own = codes[bounds[row] : bounds[row + 1]]
                    one, two = b"".join(map(ids_of.__getitem__, own)), "".join(map(text_of.__getitem__, own))
                ids.append(one)
                texts.append(two[:-1])
            yield first, last, ids, texts

    def _slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[int], list[tuple[bytes, str]], np.ndarray]:
        lower_ascii(buf)
        body = buf[: off[-1]]
        upper = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        body[1:][upper] += 0x20
        kind = _KIND[body]
        edge = np.zeros(len(body) + 1, dtype=bool)
        edge[off] = True
        change = np.ones(len(body), dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) | edge[1:-1] | (kind[1:] == _NUMBER)
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(body)) if len(starts) else starts
        words = kind[starts] != _SPACE
        starts, ends = starts[words], ends[words]
        codes, rep = distinct_spans(buf, starts, ends)
        raw = body.tobytes()
        letters = raw.decode("latin-1").translate(self.letters)
        pool = [self.piece(letters[a:b]) for a, b in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)]
        return codes.tolist(), pool, np.searchsorted(starts, off)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One coder, with its cache, for each worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded`` for every row of ``docs``.

    A null or empty text, or one of white space only, has no ids and decodes to the empty
    text. Repeated rows and null ids stay; an empty table gives an empty table; other
    columns are not read. ``vocabulary`` is a path that every executor has.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(vocabulary)
        for batch in batches:
            for first, last, ids, texts in coder.encode(batch.column(1)):
                sizes = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, ids array<int>, decoded string")
