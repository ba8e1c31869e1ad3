"""Repeated passages found by an FM-index per shard (operator 11).

A window is ``window`` consecutive words of one document. Its anchor is the run of
``ANCHOR`` words in it whose hash is smallest, so equal windows have equal anchors and an
anchor's hash names the shard of all its windows. Consecutive windows of one anchor travel
as one segment of words. Each shard builds a compressed FM-index over its segments and
streams them through it: backward search over a wavelet matrix gives the matching
statistics, and intervals that reach a whole window of a smaller id are reported.

Equal segments of one slice of texts are sent once, under their smallest id; the others
are reported at once, for that id holds all their windows. So a group of copies or a
common passage reaches a shard once a slice, not once a document.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytespans import _K1, distinct_spans, mix, runs, span_hashes, text_slices
from .fm_index import FmIndex
from .shared import id_and_text

WINDOW, ANCHOR = 13, 4
#: Bytes of text a shard is meant for, of texts a task gathers before it sends segments, and of texts cut at once.
SHARD_BYTES, SLICE_BYTES, PART_BYTES = 8 << 20, 16 << 20, 3 << 20
_HITS = "doc_id long, text_key int, first int, last int"


def _single_spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space for each run of white space and none before the first word."""
    n = int(off[-1])
    gap = (buf[:n] == 32) | ((buf[:n] >= 9) & (buf[:n] <= 13))
    drop = gap.copy()
    drop[1:] &= gap[:-1]
    begins = off[:-1][off[:-1] < n]
    drop[begins] = gap[begins]
    buf[:n][gap] = 32
    if not drop.any():
        return buf, off
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(~drop)])
    out = np.zeros(int(kept[-1]) + 8, dtype=np.uint8)
    out[:-8] = buf[:n][~drop]
    return out, kept[off]


def _segments(buf: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of each segment: row, number of its first word in the row, number of words, first and last byte, hash of its anchor.

    The last 32 bits of that hash are enough to tell most segments that are alone in their shard.
    """
    text = buf[: off[-1]]
    starts, ends = runs(text != 32, off)
    anchor = min(ANCHOR, window)
    places, n = window - anchor + 1, len(starts) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    words = span_hashes(buf, starts, ends)
    gram = words[: n + places - 1].copy()
    for i in range(1, anchor):
        gram = mix(gram * _K1 + words[i : i + len(gram)])
    best, least = np.arange(n), gram[:n].copy()
    for i in range(1, places):
        here = gram[i : i + n]
        less = np.flatnonzero(here < least)
        least[less], best[less] = here[less], less + i
    row = np.searchsorted(off, starts, side="right") - 1
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (best[inside][1:] != best[inside][:-1]) | (np.diff(inside) != 1)
    heads = np.flatnonzero(new)
    first = inside[heads]
    count = np.diff(np.append(heads, len(inside))) + window - 1
    first_word = np.searchsorted(starts, off[row[first]])
    return row[first], first - first_word, count, starts[first], ends[first + count - 1], least[first]


def _gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The spans' bytes, a space behind each."""
    size = ends - starts + 1
    at = np.cumsum(size)
    out = buf[np.arange(int(at[-1]) if len(at) else 0) + np.repeat(starts - (at - size), size)]
    out[at - 1] = 32
    return out


_HEAD = struct.Struct("<4q")


def _packed(packer, ids, keys, place, count, anchors, text: bytes, told: tuple[np.ndarray, ...]) -> bytes:
    parts = [ids.astype("<i8"), keys.astype("<i4"), anchors.astype("<u4"), place.astype("<i4"), count.astype("<i4"), *(x.astype(t) for x, t in zip(told, ("<i8", "<i4", "<i4", "<i4"), strict=True))]
    return packer.compress(_HEAD.pack(len(ids), len(told[0]), len(text), 0) + b"".join(x.tobytes() for x in parts) + text)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    n, told, size, _ = _HEAD.unpack_from(blob)
    at, out = _HEAD.size, []
    for k, kind in ((n, "<i8"), (n, "<i4"), (n, "<u4"), (n, "<i4"), (n, "<i4"), (told, "<i8"), (told, "<i4"), (told, "<i4"), (told, "<i4")):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    return out[:5], out[5:], np.frombuffer(blob, np.uint8, size, at)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``SLICE_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(2).nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and any(len(b) for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sender(shards: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in _slices(batches):
            parts, texts, base = [], [], 0
            for i, _, raw, off in text_slices(batch.column(2), PART_BYTES):
                buf, off = _single_spaced(raw, off)
                row, place, count, a, b, anchors = _segments(buf, off, window)
                parts.append((row + i, place, count, a + base, b + base, anchors))
                texts.append(buf[: off[-1]])
                base += int(off[-1])
            row, place, count, a, b, anchors = (np.concatenate(x) for x in zip(*parts, strict=True))
            buf = np.concatenate([*texts, np.zeros(8, np.uint8)])
            parts = texts = None
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            told = np.zeros(len(row), dtype=bool)  # of a larger id than an equal segment's
            _, same, times = np.unique(anchors, return_inverse=True, return_counts=True)
            often = np.flatnonzero(times[same] > 1)
            if len(often):
                codes, _ = distinct_spans(buf, a[often], b[often])
                least = np.full(int(codes.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, codes, ids[often])
                told[often] = ids[often] > least[codes]
            shard = (mix(anchors) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            names, blobs = [], []
            for k in np.flatnonzero(np.diff(bounds)):
                mine = order[bounds[k] : bounds[k + 1]]
                sent, done = mine[~told[mine]], mine[told[mine]]
                names.append(k)
                blobs.append(_packed(packer, ids[sent], keys[sent], place[sent], count[sent], anchors[sent], _gathered(buf, a[sent], b[sent]).tobytes(), (ids[done], keys[done], place[done], place[done] + count[done])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "payload"])

    return send


def removed_windows(index: FmIndex, begins: np.ndarray, counts: np.ndarray, owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each segment that a smaller owner's piece holds too; -1 and -1 if there is none.

    A segment's windows all share its middle words, so those are looked for first.
    """
    last = counts - window
    low, high = np.full(len(begins), -1), np.full(len(begins), -1)
    middle = begins + last
    live = np.flatnonzero(index.reach(begins + window - 1, middle, owners, 1 << 40) <= middle)
    at = last.copy()
    while len(live):  # the last window: one place to the left a round
        start = index.reach(begins[live] + at[live] + window - 1, begins[live], owners[live], window) - begins[live]
        hit = start <= at[live]
        low[live[hit]], high[live[hit]] = start[hit], at[live[hit]]
        live = live[~hit]
        at[live] -= 1
        live = live[at[live] >= 0]
    live = np.flatnonzero(low > 0)
    at = np.zeros(len(begins), dtype=np.int64)
    while len(live):  # the first window: behind the place where its words end to match
        ends = begins[live] + at[live] + window - 1
        start = index.reach(ends, begins[live] + at[live], owners[live], window) - begins[live]
        hit = start <= at[live]
        low[live[hit]] = at[live[hit]]
        at[live] = start
        live = live[~hit]
        live = live[at[live] < low[live]]
    return low, high


def _finder(window: int):
    def find(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        fields, told, texts = [], [], []
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("payload")):
                own, answers, text = _unpacked(unpacker.decompress(blob.as_py()))
                told.append(answers)
                fields.append(own)
                texts.append(text)
        out = [np.concatenate(x) for x in zip(*told, strict=True)]
        yield _hits(*out)
        ids, keys, anchors, place, count = (np.concatenate(x) for x in zip(*fields, strict=True))
        text = np.concatenate([*texts, np.zeros(8, np.uint8)])
        fields = texts = None
        _, same, times = np.unique(anchors, return_inverse=True, return_counts=True)
        shared = times[same] > 1  # an anchor that one segment has is no other's
        spaces = np.flatnonzero(text[:-8] == 32)
        ends = np.cumsum(count)
        piece_end = spaces[ends - 1] if len(ends) else ends
        piece_start = np.append(0, piece_end[:-1] + 1)[: len(ends)]
        keep = np.flatnonzero(shared)
        if not len(keep):
            return
        ids, keys, place, count = ids[keep], keys[keep], place[keep], count[keep].astype(np.int64)
        codes, first = distinct_spans(text, piece_start[keep], piece_end[keep])
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, codes, ids)
        # one piece for each distinct segment, pieces in the order of their smallest ids
        order = np.argsort(least, kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        pieces = first[order]
        n_words = count[pieces]
        flat = _gathered(text, piece_start[keep][pieces], piece_end[keep][pieces])
        spaces = np.flatnonzero(flat == 32)
        spaced = np.concatenate([flat, np.zeros(8, np.uint8)])
        word_codes, _ = distinct_spans(spaced, np.append(0, spaces[:-1] + 1), spaces)
        begins = np.cumsum(n_words + 1) - n_words - 1
        words = np.zeros(int((n_words + 1).sum()), dtype=np.int64)
        piece_of = np.repeat(np.arange(len(pieces)), n_words + 1)
        rest = (begins + n_words)[piece_of] - np.arange(len(words))
        words[rest > 0] = word_codes + 1
        _, owner = np.unique(least[order], return_inverse=True)
        index = FmIndex(words, rest, owner[piece_of])
        low, high = removed_windows(index, begins, n_words, owner, window)
        piece = number[codes]
        later = ids > least[codes]
        low, high = np.where(later, 0, low[piece]), np.where(later, count - window, high[piece])
        hit = low >= 0
        yield _hits(ids[hit], keys[hit], place[hit] + low[hit], place[hit] + high[hit] + window)

    return find


def _hits(ids, keys, first, last) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), kind) for x, kind in zip((ids, keys, first, last), kinds, strict=True)], ["doc_id", "text_key", "first", "last"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shards: int | None = None) -> DataFrame:
    """``doc_id, text_key, first, last``: word ranges [first, last) that windows of smaller ids cover; ranges may overlap.

    ``text_key``, a 32-bit hash of the text, tells rows of one id apart; such rows
    take nothing from each other. Rows with a null id or text and texts of fewer words than
    a window give no rows.
    """
    rows = id_and_text(docs, id_col, text_col).filter("doc_id is not null").select("doc_id", F.hash("text").alias("text_key"), "text")
    if shards is None:
        shards = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES
    sent = rows.mapInArrow(_sender(shards, window), "shard int, payload binary")
    return sent.groupBy("shard").applyInArrow(_finder(window), _HITS)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        bounds = spans.offsets.to_numpy()
        flat = spans.values.flatten()
        firsts, lasts = (x.to_numpy(zero_copy_only=False) for x in flat)
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()  # without an argument: the bytes 9 to 13 and 32
            a, b = bounds[i], bounds[i + 1]
            n_words.append(len(words))
            if b > a:
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edges, firsts[a:b], 1)
                np.add.at(edges, lasts[a:b], -1)
                stays = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                n_removed.append(len(words) - len(stays))
                words = [words[k] for k in stays]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode())
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        columns = [batch.column(n) for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "left_text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), shards: int | None = None) -> DataFrame:
    """``doc_id, kept_*, n_words, n_removed, left_text``: each row's words without those that a window of a smaller id covers.

    All windows are judged on the input. Kept words stand one space apart. A null or empty
    text has no words; a row with a null id keeps all of its words and takes none from
    others; rows of one id, equal or not, take nothing from each other; an empty table gives
    an empty table. Columns named in ``keep`` come back as ``kept_*``, whatever their names.
    """
    rows = id_and_text(docs, id_col, text_col, keep=keep).withColumn("text_key", F.hash("text"))
    spans = repeated_spans(docs, id_col, text_col, window, shards).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = rows.join(spans, ["doc_id", "text_key"], "left").drop("text_key")
    joined = joined.withColumn("spans", F.coalesce("spans", F.expr("array()").cast("array<struct<first:int,last:int>>")))
    others = [f for f in joined.schema.fields if f.name not in ("text", "spans")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return joined.mapInArrow(_kept, f"{schema}, n_words long, n_removed long, left_text string")
