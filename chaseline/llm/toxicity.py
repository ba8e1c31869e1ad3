"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained by the library on labelled text: one on samples of
what toxic documents hold far more often than others, one on samples of ordinary wording.
A window is one word between two copies of a fixed carrier that both dictionaries hold; so
every window is long enough to be compressed, and the two lengths differ by what the word
alone costs. A document's score comes from the distribution of its windows' differences,
by a logistic calibration on labelled documents.

Only words are inputs: no label, language, source or id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytespans import distinct_spans, lower_ascii, runs, text_slices
from .shared import id_and_text

#: Labelled rows learned from, at most: of each label, the first by a hash of the id.
MOST_TOXIC, MOST_ORDINARY = 5_000, 15_000
#: A word is sampled for the toxic dictionary if its rate among toxic documents is RATIO times that among others,
#: and if it stands in this share of toxic documents, and in three of them, at least.
RATIO, LEAST_SHARE = 30.0, 0.005
#: Bytes of each dictionary, samples that it is trained on, words of a sample, and the most words that are drawn from, the weightiest first.
TOXIC_BYTES, ORDINARY_BYTES = 4_096, 112_640
TOXIC_SAMPLES, ORDINARY_SAMPLES, SAMPLE_WORDS, DRAWN_FROM = 6_000, 60_000, 8, 20_000
LONGEST_WORD = 64
HELD_OUT = 2
THRESHOLD = 0.3
_CARRIER = b"0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ=+-*/\"\n"
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = _LETTERS[0x80:] = True
CACHE_ENTRIES = 400_000


def held_out(doc_id) -> object:
    """Column: whether the row takes no part in learning; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(True))


def _windows(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs, those of over LONGEST_WORD bytes as windows of at most so many, cut between characters.

    A window begins half a window after the one before; every byte of a run is in one.
    """
    size, step = ends - starts, LONGEST_WORD // 2
    n = np.where(size > LONGEST_WORD, -((LONGEST_WORD - 3 - size) // step) + 1, 1)
    if not (n > 1).any():
        return starts, ends
    run = np.repeat(np.arange(len(starts)), n)
    a = starts[run] + step * (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    for _ in range(3):  # a character has at most three bytes after its first
        a -= (a > starts[run]) & (body[a] & 0xC0 == 0x80)
    b = np.where(n[run] > 1, np.minimum(a + LONGEST_WORD, ends[run]), ends[run])
    for _ in range(3):
        b -= (b < ends[run]) & (body[np.minimum(b, len(body) - 1)] & 0xC0 == 0x80)
    return a, b


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[bytes], np.ndarray]]:
    """(first row, next row, word codes, words by code, bounds of each row's words) of each slice of texts."""
    for first, last, buf, off in text_slices(column):
        lower_ascii(buf)
        body = buf[: off[-1]]
        upper = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        body[1:][upper] += 0x20
        starts, ends = _windows(body, *runs(_LETTERS[body], off))
        codes, rep = distinct_spans(buf, starts, ends)
        raw = body.tobytes()
        yield first, last, codes, [raw[a:b] for a, b in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)], np.searchsorted(starts, off)


def trained(words: list[tuple[bytes, float]], size: int, samples: int, seed: int = 5) -> bytes:
    """A dictionary of at most ``size`` bytes that zstandard trains on samples of ``words``, drawn in proportion to their weights.

    Few words have too little text to train on; then they are the dictionary themselves.
    """
    import zstandard as z

    if not words:
        return b""
    share = np.array([n for _, n in words], dtype=float)
    picks = np.random.default_rng(seed).choice(len(words), size=(samples, SAMPLE_WORDS), p=share / share.sum())
    try:
        return z.train_dictionary(size, [b" " + b" ".join(words[k][0] for k in row) + b" " for row in picks.tolist()]).as_bytes()
    except z.ZstdError:
        return (b" " + b" ".join(w for w, _ in reversed(words)) + b" ")[-size:]


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; without any toxic word, all scores are ``prior``."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        x = np.column_stack([(features - np.array(self.mean)) / np.array(self.scale), np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


@dataclass
class _Distance:
    """Both compressors, and the differences of the words seen, in a bounded cache."""

    toxic: bytes
    ordinary: bytes
    cache: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import zstandard as z

        def compressor(content: bytes):
            how = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, strategy=z.STRATEGY_LAZY, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=5, target_length=16)
            held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            return z.ZstdCompressor(compression_params=how, dict_data=held)

        self.pair = compressor(self.toxic + _CARRIER), compressor(self.ordinary + _CARRIER)
        empty = [len(c.compress(_CARRIER + _CARRIER)) for c in self.pair]
        self.base = empty[1] - empty[0]

    def of(self, word: bytes) -> float:
        """Bytes that the toxic dictionary saves on the word, against the ordinary one."""
        found = self.cache.get(word)
        if found is None:
            window = _CARRIER + b" " + word + b" " + _CARRIER
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            found = self.cache[word] = len(self.pair[1].compress(window)) - len(self.pair[0].compress(window)) - self.base
        return found

    def features(self, column: pa.Array) -> np.ndarray:
        """A row of features for each text."""
        out = []
        for first, last, codes, words, bounds in _words(column):
            saved = np.array([self.of(w) for w in words], dtype=float)
            share = saved / (np.array([len(w) for w in words]) + 2) if words else saved
            for row in range(last - first):
                own = codes[bounds[row] : bounds[row + 1]]
                out.append(_shape(saved[own], share[own]))
        return np.array(out).reshape(len(out), -1)


def _shape(saved: np.ndarray, share: np.ndarray) -> list[float]:
    if not len(saved):
        saved = share = np.zeros(1)
    top, best, n = -np.sort(-saved), -np.sort(-share), len(saved)
    counts = [np.log1p((saved >= c).sum()) for c in (3, 5, 7)] + [np.log1p((share >= c).sum()) for c in (0.35, 0.45, 0.55, 0.65)]
    return [top[0], top[:3].sum() / 3, top[:8].sum() / 8, best[0], best[:3].sum() / 3, (saved >= 3).mean(), (saved >= 5).mean(), (share >= 0.5).mean(), np.log1p(n), *counts]


@lru_cache(maxsize=4)
def _distance(toxic: bytes, ordinary: bytes) -> _Distance:
    return _Distance(toxic, ordinary)


def _first_of_each(rows: DataFrame, most: dict[int, int]) -> DataFrame:
    """Of each label of ``rows (doc_id, toxic)`` the first by a hash of the id, at most ``most`` of that label.

    Only rows of a share of hashes that holds little more than the bound are put in order,
    and none where a label has no more rows than its bound; so no task gathers a label.
    """
    counts = {r["toxic"]: r["n"] for r in rows.groupBy(F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    of = lambda label: rows.filter("toxic = 1" if label == 1 else "toxic != 1")
    key = F.xxhash64("doc_id")
    parts = []
    for label, bound in most.items():
        n, part = counts.get(label, 0), of(label)
        if n > bound:
            share = min(1.0, (bound + 10 * bound**0.5 + 100) / n)  # ten standard deviations above the bound
            part = part.filter(key <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))).cast("long"))
            part = part.orderBy(key, "doc_id").limit(bound)
        parts.append(part)
    return parts[0].unionByName(parts[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows that are not held out, at most MOST_TOXIC and MOST_ORDINARY of them.

    Null and repeated labels: nulls are left out, and of several labels of one id the
    largest holds. Without labelled documents of both kinds the model gives the share of
    toxic ones (0 without any) as every score.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bounded = _first_of_each(rows, {1: MOST_TOXIC, 0: MOST_ORDINARY})
    learned = id_and_text(docs, id_col, text_col).join(F.broadcast(bounded), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``word, toxic, ordinary``: documents that hold the word; the empty word counts all."""
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False) == 1
            for first, last, codes, words, bounds in _words(batch.column(1)):
                counts = np.zeros((2, len(words)), dtype=np.int64)
                for row in range(last - first):
                    counts[int(toxic[first + row])][np.unique(codes[bounds[row] : bounds[row + 1]])] += 1
                n = int(toxic[first:last].sum())
                yield pa.RecordBatch.from_arrays([pa.array([*words, b""], pa.binary()), pa.array([*counts[1].tolist(), n]), pa.array([*counts[0].tolist(), last - first - n])], ["word", "toxic", "ordinary"])

    counted = learned.mapInArrow(count, "word binary, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).persist()
    total = counted.filter(F.length("word") == 0).first()
    if total is None or not total["toxic"] or not total["ordinary"]:
        counted.unpersist()
        return Model(prior=float(total is not None and total["toxic"] > 0))
    rate, usual = F.col("toxic") / total["toxic"], (F.col("ordinary") + 0.5) / total["ordinary"]
    telling = (F.col("toxic") >= max(3, LEAST_SHARE * total["toxic"])) & (rate >= RATIO * usual) & (F.length("word") > 0)
    drawn = lambda rows, weight: [(bytes(r["word"]), r["n"]) for r in rows.select("word", weight.cast("double").alias("n")).orderBy(F.desc("n"), "word").limit(DRAWN_FROM).collect()]
    toxic = drawn(counted.filter(telling), F.col("toxic") * F.log(rate / usual))
    ordinary = drawn(counted.filter(~telling & (F.length("word") > 0)), F.col("toxic") + F.col("ordinary"))
    counted.unpersist()
    model = Model(trained(toxic, TOXIC_BYTES, TOXIC_SAMPLES), trained(ordinary, ORDINARY_BYTES, ORDINARY_SAMPLES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _distance(model.toxic, model.ordinary)
        for batch in batches:
            found = distance.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "features"])

    table = learned.mapInArrow(measure, "toxic int, features array<double>").toArrow()  # bounded by the labelled rows above
    y = table.column("toxic").to_numpy().astype(float)
    x = np.array(table.column("features").combine_chunks().flatten()).reshape(len(y), -1)
    return _calibrated(model, x, y)


def _calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """A ridge logistic fit by Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0  # a feature that all learned rows share weighs nothing
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.toxic, model.ordinary, tuple(mean), tuple(scale), tuple(w), float(y.mean()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, and its columns named in ``keep``, as ``kept_<name>``.

    A null text counts as empty; an empty one gets the score of a text without telling
    words. Repeated rows and null ids stay; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    more, texts = tuple(c for c in keep if c not in ("doc_id", text_col)), text_col in keep
    names = ["doc_id", *(["own_text"] if texts else []), *(f"kept_{c}" for c in more), "score"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        distance = _distance(known.toxic, known.ordinary)
        for batch in batches:
            found = known.scores(distance.features(batch.column(1))) if known.weights else np.full(len(batch), known.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1 if texts else 2 :], pa.array(found)], names)

    kinds = [("doc_id", "long"), *([("own_text", "string")] if texts else []), *((f"kept_{c}", types[c]) for c in more), ("score", "double")]
    scored = id_and_text(docs, id_col, text_col, True, more).mapInArrow(task, ", ".join(f"`{n}` {t}" for n, t in kinds))
    kept = [F.col("own_text").alias(f"kept_{c}") if c == text_col else F.col(f"`kept_{c}`") for c in keep if c != "doc_id"]
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *kept)
