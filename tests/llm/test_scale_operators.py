"""Operators 11 to 13 against brute force, and their edge cases."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chaseline.llm import filter_audit, fm_index, posting_lists, substring_dedup, whitening

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    """With extra columns whose names clash with those used inside."""
    clashing = ("text_key", "spans", "shard", "first", "n_words", "part", "failed", "white", "n", "v")
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in clashing})


def pieces_with_zeros(pieces):
    n = np.array([len(p) for p in pieces])
    codes = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int64)
    of = np.repeat(np.arange(len(pieces)), n + 1)
    begins = np.cumsum(n + 1) - n - 1
    return codes, (begins + n)[of] - np.arange(len(codes)), of


@pytest.mark.parametrize("letters", [2, 40, 5000])
def test_backward_search_equals_a_scan(letters):
    dice = np.random.default_rng(letters)
    pieces = [dice.integers(1, letters + 1, dice.integers(1, 40)) for _ in range(120)]
    pieces += [p.copy() for p in pieces[:40]]
    codes, rest, of = pieces_with_zeros(pieces)
    owners = dice.permutation(len(pieces))[of]
    index = fm_index.FmIndex(codes, rest, owners)
    for at in dice.integers(0, len(codes), 200):
        if rest[at] < 1:
            continue
        pattern = codes[at : at + dice.integers(1, rest[at] + 1)]
        lo, hi = np.array([0]), np.array([len(codes)])
        for c in pattern[::-1]:
            lo, hi = index.prepend(np.array([c]), lo, hi)
        hits = [j for j in range(len(codes)) if rest[j] >= len(pattern) and (codes[j : j + len(pattern)] == pattern).all()]
        assert hi[0] - lo[0] == len(hits)
        assert index.owners.smallest(lo, hi)[0] == min(owners[j] for j in hits)


def without_repeats(rows, window):
    first, docs = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, words in docs:
        for k in range(len(words) - window + 1 if i is not None else 0):
            gram = tuple(words[k : k + window])
            first[gram] = min(first.get(gram, i), i)
    out = []
    for i, words in docs:
        gone = {p for k in range(len(words) - window + 1 if i is not None else 0) if first[tuple(words[k : k + window])] < i for p in range(k, k + window)}
        out.append((str(i), len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


def passages(seed, letters):
    dice = random.Random(seed)
    vocab = [f"w{k}" for k in range(letters)]
    base, rows = [dice.choice(vocab) for _ in range(400)], []
    for i in range(120):
        words = []
        for _ in range(dice.randint(0, 6)):
            at = dice.randrange(380)
            words += base[at : at + dice.randint(5, 60)] if dice.random() < 0.5 else [dice.choice(vocab) for _ in range(dice.randint(1, 40))]
        if words and dice.random() < 0.3:
            words[dice.randrange(len(words))] = "zz"
        rows.append((i, dice.choice((" ", "\n", " \t ")).join(words)))
    return rows


ODD = [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "a " * 700), (1005, "a " * 700), (None, "a " * 60), (1006, "  x \ty " * 30), (1006, "  x \ty " * 30), (1006, "a " * 40), (1007, "x  y " * 30), (-5, "long " * 3 + "tail words " * 30_000), (2000, "tail words " * 20), (-(2**63), "日本 語 " * 20), (2**63 - 1, "日本 語 " * 20)]


@pytest.mark.parametrize("letters,window,shards", [(40, 13, None), (3, 13, 5), (2000, 13, 3), (40, 3, 2), (40, 20, 2)])
def test_repeats_equal_brute_force(spark, letters, window, shards):
    rows = passages(letters, letters) + ODD
    got = substring_dedup.without_repeats(frame(spark, rows), window=window, shards=shards)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.left_text) for r in got.collect()) == without_repeats(rows, window)


def test_repeats_over_many_slices(spark, monkeypatch):
    """Slices of few bytes: what one slice answers at once is now left to the shards."""
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 2000)
    rows = passages(8, 30) + [(500 + i, "one common line of more than thirteen words that stands in very many of these rows " * 2 + str(i)) for i in range(60)]
    batches = [substring_dedup.pa.RecordBatch.from_pylist([{"doc_id": i, "key": k, "text": t}]) for k, (i, t) in enumerate(rows)]
    sent = substring_dedup.pa.Table.from_batches(substring_dedup._sender(1, 13)(iter(batches)))
    gone = {}
    for hits in substring_dedup._finder(13)((), iter(sent.to_batches())):
        for i, _, a, b in zip(*hits.to_pydict().values(), strict=True):
            gone.setdefault(i, set()).update(range(a, b))
    assert {str(i): len(x) for i, x in gone.items()} == {i: n for i, _, n, _ in without_repeats(rows, 13) if n}


def test_repeats_of_an_empty_table_and_kept_columns(spark):
    assert substring_dedup.without_repeats(frame(spark, [])).collect() == []
    rows = substring_dedup.without_repeats(frame(spark, [(1, "a b")]), keep=("spans", "n_words", "text")).collect()
    assert rows[0].kept_spans == "x" and rows[0].kept_n_words == "x" and rows[0].kept_text == "a b" and rows[0].n_words == 2


def audited(rows, labels):
    marks, least, out = {}, {}, {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (0, 0))
        marks[i] = (good | (quality == 1), bad | (toxic == 1))
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": i is not None and least[text] < i}
        parts.setdefault(part or "", []).append(({f for f in fails if fails[f]}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                earlier = [d for d in docs if f in d[0] and set(order[: step - 1]) & d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(earlier), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        for (p, order, step), found in list(out.items()):
            if p == part:
                out[p, order, step] = (*found[:6], shapley[order[step - 1]])
    return out


def test_filter_orders_equal_brute_force(spark):
    dice = random.Random(4)
    texts = [None, "", " ", "SHOUT " * 120, "plain words " * 60, "a#b " * 3, " ".join(f"w{k}" for k in range(130)), " ".join(f"W{k}" for k in range(130)), " ".join(f"v{k}" for k in range(20_000)), "É" * 9 + "A"]
    rows = [(dice.choice((None, *range(60))), dice.choice(texts), dice.choice((None, "", "en", "de"))) for _ in range(150)]
    labels = [(dice.choice((None, *range(70))), dice.choice((None, 0, 1)), dice.choice((None, 0, 1))) for _ in range(60)]
    docs = frame(spark, [r for r in rows], "doc_id long, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == audited(rows, labels)
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in got)


def test_filter_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, [], "doc_id long, text string, lang string"), none).collect() == []
    rows = filter_audit.audit(frame(spark, [(1, "x", "en")], "doc_id long, text string, lang string"), none).collect()
    assert len(rows) == 600 and {r.removed for r in rows if r["filter"] == "A" and r.step == 1} == {1}


VECTORS = "vec_id long, embedding array<float>"


def exact(rows):
    return [[math.floor(1024 * np.float64(np.float32(c))) + 100_000 for c in v] for _, v in rows]


def test_scatter_is_exact_for_large_and_negative_numbers(spark):
    dice = np.random.default_rng(0)
    rows = [(i, [float(x) for x in dice.normal(0, 10.0 ** dice.integers(0, 9), 70)]) for i in range(40)]
    x = [[*v, 1] for v in exact(rows)]
    same = whitening.usable(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    want = [[sum(r[i] * r[j] for r in x) for j in range(71)] for i in range(71)]
    assert whitening.scatter(same, 70, 40 * max(abs(c) for r in x for c in r) ** 2) == want


def test_whitening_equals_a_direct_solution(spark):
    dice = np.random.default_rng(3)
    rows = [(i % 90, [float(x) for x in dice.normal(0, 1, 12) * np.arange(1, 13)]) for i in range(150)]
    odd = [(200, None), (201, []), (202, [1.0, None] + [0.0] * 10), (203, [math.nan] * 12), (204, [math.inf] * 12), (205, [1.0] * 5), (None, rows[0][1])]
    used = [*rows, odd[-1]]
    x = exact(used)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array(x, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whiten(frame(spark, rows + odd, VECTORS)).collect()
    assert sorted({str(r.vec_id) for r in got}) == sorted({str(i) for i, _ in used}) and len(got) == 8 * len(used) and {r.n for r in got} == {n}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x)
    for k in range(8):
        mine = sorted(abs(r.whitened) for r in got if r.component == k + 1)
        assert np.allclose(mine, sorted(abs(centred @ vectors[:, k]) / math.sqrt(values[k])), atol=1e-9)
        assert np.allclose([r.explained for r in got if r.component == k + 1], values[k] / values.sum())
    assert {r.identity_error < 1e-9 for r in got} == {True}


def test_whitening_without_spread_and_without_rows(spark):
    assert whitening.whiten(frame(spark, [], VECTORS)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)], VECTORS)).collect() == []
    same = whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(3)], VECTORS)).collect()
    assert {(r.component, r.whitened, r.deviation, r.explained, r.identity_error) for r in same} == {(k, 0.0, 0, None, 0.0) for k in (1, 2)}
    line = whitening.whiten(frame(spark, [(i, [float(i), 0.0, -float(i)]) for i in range(9)], VECTORS)).collect()
    assert max(abs(r.whitened) for r in line if r.component > 1) == 0 and all(r.identity_error < 1e-9 for r in line)


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(frame(spark, [(i, [1e9 * i, 0.0]) for i in range(5)], VECTORS)).collect()
    assert {r.deviation for r in got if r.vec_id == 0} == {None} and all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("clusters,most", [(0, 1.0), (60, 0.35)])
def test_a_query_reads_no_more_rows_than_there_are(clusters, most):
    """Vectors without groups need no replicas; fitted rows and others both reach the wanted recall."""
    dice = np.random.default_rng(1)
    x = dice.normal(size=(6000, 16))
    if clusters:
        x += 6 * dice.normal(size=(clusters, 16))[dice.integers(0, clusters, len(x))]
    index = posting_lists.Index.fit(x, float(np.linalg.norm(x, axis=1).max()), 60, 20)
    assert index.scanned <= most
    homes = [set(h) for h in index.homes(posting_lists.lift(x, index.longest))]
    for start in (0, 1):
        asked = np.arange(start, len(x), 40)
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-scores, 19, axis=1)[:, :20]
        found = [bool(homes[row] & set(lists)) for lists, rows in zip(map(index.lists, posting_lists.lift(x[asked], None)), best, strict=True) for row in rows]
        assert np.mean(found) >= 0.95
