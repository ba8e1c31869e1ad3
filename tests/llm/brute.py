"""Plain-Python versions of the queries, for small tables only."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def near_dups(rows, words, percent=80):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}, by comparing all pairs."""
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    by_size = sorted((k for k in range(len(sets)) if sets[k][1]), key=lambda k: len(sets[k][1]))
    for n, a in enumerate(by_size):
        for b in by_size[n + 1 :]:
            s, t = sets[a][1], sets[b][1]
            if 100 * len(s) < percent * len(t):
                break
            if 100 * len(s & t) >= percent * len(s | t):
                label[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def op3(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return out


def canonical(text):
    """Compatibility composition, case folding, composition again, white space to single spaces."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", folded).strip(" ")


def op4_edited(rows):
    """rows: (doc_id, text), ids distinct -> {doc_id: (n_chars, edited text, next text)}"""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        out[i] = (len(t), t[: len(t) - third] + after[:third], after)
    return out


def op6_base(text):
    spans = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, "hex", m.end()))
    spans.sort()
    counts = tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
    return (*counts, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)))


def op7_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    hits = [(k, label) for k in range(len(words)) for phrase, label in phrases.items() if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


@lru_cache(maxsize=1)
def byte_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def op8_pieces(text):
    tok = byte_tokenizer()
    ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
    cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
    return [(k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def op9(url):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1].translate(LOW), m[2]
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best[1] if best else "allow"


def nearest(vectors, queries, k):
    """vectors: {id: list} -> {query: [(score, id)]}"""
    out = {}
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
        out[q] = [(-s, i) for s, i in scores[:k]]
    return out
