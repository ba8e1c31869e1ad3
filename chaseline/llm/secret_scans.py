"""Secret scans (operator 6): fixed patterns and a token-efficiency test.

Ordinary text needs few tokens of a trained vocabulary; a random string needs many. A run
of key-like characters is reported if it has at most ``MOST_CHARS_PER_TOKEN`` characters a
token and mixes kinds of characters, unless it is a digest of a usual length or a UUID.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text

KINDS = ("assign", "access", "hex", "random")
MOST_CHARS_PER_TOKEN = 2.2
SHORTEST_RANDOM = 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYLIKE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST_RANDOM},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.ASCII | re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.ASCII | re.IGNORECASE)
#: A UUID, or what lies between separators.
_PART = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern.replace('a-f', 'a-fA-F')}(?![A-Za-z0-9])|[A-Za-z0-9]+")


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def random_spans(text: str, encoding) -> list[tuple[int, str, int]]:
    """(start, kind, end) of key-like runs that the vocabulary can't shorten."""
    found = []
    for m in _KEYLIKE.finditer(text):
        run = m[0].strip("=-_/+")
        if not _mixed(run) or len(run) < SHORTEST_RANDOM or _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
            continue
        at = m.start() + m[0].index(run)
        spans = [(0, len(run))] if _dense(run, encoding) else _dense_parts(run, encoding)
        found += [(at + a, "random", at + b) for a, b in spans]
    return found


def _mixed(run: str) -> bool:
    kinds = sum(any(f(c) for c in run) for f in (str.isdigit, str.islower, str.isupper))
    return kinds >= 2 and (any(map(str.isdigit, run)) or bool(re.search("[a-z][A-Z]", run) and re.search("[A-Z]{2}|[A-Z][a-z][A-Z]", run)))


def _dense(run: str, encoding) -> bool:
    return len(run) <= MOST_CHARS_PER_TOKEN * len(encoding.encode_ordinary(run))


def _dense_parts(run: str, encoding) -> list[tuple[int, int]]:
    """Bounds of the parts of a run that the vocabulary can't shorten, where wording beside them hides them in the run.

    A part lies between separators. Long parts are judged alone, then neighbours that are
    all dense, together: a key may hold separators. Digests and UUIDs part their neighbours.
    """
    found, group = [], []

    def close() -> None:
        if len(group) > 1 and group[-1][1] - group[0][0] >= SHORTEST_RANDOM:
            joined = run[group[0][0] : group[-1][1]]
            if _mixed(joined) and _dense(joined, encoding):
                found.append((group[0][0], group[-1][1]))
        group.clear()

    for part in _PART.finditer(run):
        word = part[0]
        if _UUID.fullmatch(word) or _DIGEST.fullmatch(word) or not _dense(word, encoding):
            close()
        elif len(word) >= SHORTEST_RANDOM and _mixed(word):
            close()
            found.append(part.span())
        else:
            group.append(part.span())
    close()
    return found


def scan(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, spans array<struct<start, kind, end>>, redacted`` for every row of ``docs``, and its columns named in ``keep``, as ``kept_<name>``.

    Spans are sorted by start, then kind in the order of ``KINDS``; ``redacted`` is the text
    with each covered stretch replaced by ``[SECRET]``, the key of an assignment kept. A null
    text is scanned as empty and redacted to null. Repeated rows and null ids stay; an empty
    table gives an empty table; other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _vocabulary(vocabulary, pattern)
        for batch in batches:
            spans, clean = [], []
            for text in batch.column(1).to_pylist():
                found = sorted(base_spans(text or "") + random_spans(text or "", encoding), key=lambda s: (s[0], KINDS.index(s[1])))
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                clean.append(redact(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(spans, kind), pa.array(clean, pa.string())], ["doc_id", *(f"kept_{c}" for c in keep), "spans", "redacted"])

    types = dict(docs.dtypes)
    rows = id_and_text(docs, id_col, text_col, True, tuple(keep))
    kept = "".join(f", `kept_{c}` {types[c]}" for c in keep)
    found = rows.mapInArrow(task, f"doc_id long{kept}, spans array<struct<start: long, kind: string, end: long>>, redacted string")
    return found.select("doc_id", *(f"`kept_{c}`" for c in keep if c != "doc_id"), "spans", "redacted")


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the stretches that ``spans`` cover replaced by ``mark``; of an assignment only the value."""
    covered = []
    for a, kind, b in spans:
        covered.append((_ASSIGN.match(text, a).start(2) if kind == "assign" else a, b))
    out, at = [], 0
    for a, b in sorted(covered):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s spans: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select("doc_id", *(of(k) for k in KINDS[:3]), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
