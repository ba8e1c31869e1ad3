"""Each operator against a brute-force version, and its edge cases, on small frames."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chaseline.llm import bin_genes, bytespans, chat_format, components, fingerprints, licenses, near_dups, packing, posting_lists, registry, secret_scans, toxicity, url_rules, word_bpe
from tests.llm import brute

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "one two three"), (6, "one two three"), (None, "one two three"), (None, None), (7, "Ünï “quoted” don't 3¾ <|endoftext|> x"), (8, "a" * 3000), (9, "wörd " * 4000), (10, "日本語 テスト 한국어")]


def frame(spark, rows, schema=DOCS):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame(rows, schema).withColumn("n", F.lit(1)).withColumn("cid", F.lit("x")).withColumn("score", F.lit(None).cast("string"))


def near_copies(seed=5):
    dice = random.Random(seed)
    words = ["".join(dice.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    rows, i = [], 100
    for _ in range(12):
        base = [dice.choice(words) for _ in range(dice.choice((6, 30, 120)))]
        for _ in range(dice.randint(1, 9)):
            copy = list(base)
            for _ in range(dice.randint(0, 4)):
                copy[dice.randrange(len(copy))] = dice.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies() + ODD
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dups.near_duplicates(frame(spark, rows), 4).collect())
    assert got == sorted((str(a), n, str(c)) for a, n, c in brute.near_dups(rows, 4))
    assert spark.conf.get(key) == before


def test_hot_near_copies_and_a_common_passage(spark):
    dice = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = [dice.choice(words) for _ in range(100)]
    rows = []
    for i in range(120):  # one group whose members differ from the base by 0 to 12 words, and unrelated texts with one passage
        copy = list(base)
        for _ in range(dice.randint(0, 12)):
            copy[dice.randrange(100)] = dice.choice(words)
        rows.append((i, " ".join(copy)))
        rows.append((1000 + i, " ".join(base[:40] + [dice.choice(words) for _ in range(dice.randint(5, 60))])))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.near_duplicates(frame(spark, rows), 4).collect())
    assert got == sorted(brute.near_dups(rows, 4))


def test_a_dense_group_without_its_base(spark, monkeypatch):
    """Half of the pairs of one group are links, so that a head links half of its list; the exact step gets few of 11,175 pairs."""
    dice = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = [dice.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in dice.sample(range(120), 2):
            copy[at] = dice.choice(words)
        rows.append((i, " ".join(copy)))
    joined = []
    across = near_dups._across
    monkeypatch.setattr(near_dups, "_across", lambda labelled, percent: joined.append(pairs := across(labelled, percent)) or pairs)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.near_duplicates(frame(spark, rows), 5).collect())
    assert got == sorted(brute.near_dups(rows, 5))
    assert joined[0].count() < 3000


def test_near_dups_prepares_open_sets_once(spark, monkeypatch):
    """What the last step reads twice is written before, so that no driver plans and runs it twice."""
    plans = []
    across = near_dups._across
    monkeypatch.setattr(near_dups, "_across", lambda labelled, percent: plans.append(labelled._jdf.queryExecution().executedPlan().toString()) or across(labelled, percent))
    near_dups.near_duplicates(frame(spark, [(k, f"a b c d e f g {k}") for k in range(6)]), 4).collect()
    assert plans and "Join" not in plans[0] and "Exchange" not in plans[0]


def test_kept_rows_keep_columns_of_any_name(spark):
    names = ["own_hash", "KEPT_HASH", "kept_id", "doc_id_", "n", "label"]
    texts = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here now"), (4, None), (1, "quite another text of this id")]
    rows = [(i, t, *(f"{i}{c}" for c in "uvwxyz")) for i, t in texts]
    df = spark.createDataFrame([*rows, rows[1]], ["doc_id", "text", *names])  # one row twice
    got = sorted(map(tuple, near_dups.without_near_duplicates(df).collect()), key=str)
    assert got == sorted(rows[1:], key=str)


def test_empty_tables(spark):
    none = frame(spark, [])
    vocabulary, pattern = registry.vocabulary("byte_bpe_50k.tiktoken"), registry.pattern()
    assert near_dups.near_duplicates(none).count() == 0
    assert word_bpe.encode_decode(none, registry.vocabulary("word_bpe_49k.json")).count() == 0
    assert fingerprints.edited_pairs(none).count() == 0
    assert fingerprints.exact_groups(none).count() == 0
    assert secret_scans.scan(none, vocabulary, pattern).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert packing.pack(none, vocabulary, pattern).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert posting_lists.nearest(vectors, vectors).count() == 0
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), url_rules.rule_table(spark)).count() == 0


@pytest.mark.parametrize("role", ["user", "assistant", "### x: ", "a\\", "", "tool: </turn>"])
@pytest.mark.parametrize("text", ["", "plain", "\\### Assistant: </turn> ok", "end\\", "\\\\", "</turn>\n### user: no", "\\</turn>\\\\### ", "x\\\\</turn>"])
def test_turns_read_back(role, text):
    shown, start, end = chat_format.render(role, text)
    assert chat_format.parse(shown * 2)[1][:2] == (role, text)
    assert shown[start:end] in (text, chat_format.escape(text, chat_format._IN_TEXT))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x\\"), (2, 0, "assistant", "</turn>"), (2, 0, "assistant", "</turn>"), (-7, 0, "user", registry.ODD_TEXT), (-7, 1, "assistant", registry.ODD_TEXT)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got == brute.op1(rows)


@pytest.mark.parametrize("collide", [False, True])
def test_spans_of_one_hash_are_compared(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(bytespans, "span_hashes", lambda buf, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    for words in (["ab", "ab", "ab"], ["abcdefghijklmnopqrs", "abcdefghijklmnopqrx", "abcdefghijklmnopqrs"], ["a", "b", "aa"], []):
        raw = "".join(words).encode()
        ends = np.cumsum([len(w) for w in words]).astype(np.int64)
        codes, rep = bytespans.distinct_spans(np.frombuffer(raw + bytes(8), dtype=np.uint8).copy(), ends - [len(w) for w in words], ends)
        assert [words[rep[c]] for c in codes] == words


def test_word_bpe_equals_the_library(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(50, "ΑΣ É\u0301 İ ǅ ½ x²"), (51, "a<|startoftext|>B <|endoftext|>"), (52, "It's we'll 'tis \u00a0 \x85 z")]
    coded = word_bpe.encode_decode(frame(spark, rows), registry.vocabulary("word_bpe_49k.json"))
    got = sorted((r.doc_id, len(r.ids), brute.sha(" ".join(map(str, r.ids))), brute.sha(r.decoded)) for r in coded.collect())
    assert got == sorted(brute.op3(rows))


def test_packing_is_whole_and_gapless(spark):
    dice = random.Random(4)
    rows = ODD + [(100 + i, " ".join(dice.choice(("loop", "tree", "Über", "x1")) for _ in range(dice.randint(1, 2500)))) for i in range(40)]
    out = packing.pack(frame(spark, rows), registry.vocabulary("byte_bpe_50k.tiktoken"), registry.pattern(), registry.SPECIAL).toPandas()
    want = sorted((str(i), *p) for i, t in rows for p in brute.op8_pieces(t))
    assert sorted(zip(out.doc_id.map(lambda x: "None" if np.isnan(x) else str(int(x))), out.piece, out.start, out.length, out.ids_crc32)) == want
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 2


def test_crossover_keeps_every_item():
    counts = {700: 3, 400: 4, 324: 5, 300: 7, 100: 9}
    dice = random.Random(1)
    one, two = bin_genes.first_generation(counts, 1024, 2, 1)
    for _ in range(20):
        child = bin_genes.mutate(bin_genes.crossover(one, two, counts, 1024, dice), 1024, dice)
        held = {s: sum(n * sizes.count(s) for sizes, n in child.items()) for s in counts}
        assert held == counts and all(sum(sizes) <= 1024 for sizes in child)
    assert bin_genes.fitness(bin_genes.evolve([one, two], counts, 1024, 5, 1)[0], 1024)[0] <= bin_genes.fitness(one, 1024)[0]


def edited_and_next(docs):
    return fingerprints.edited_pairs(docs).collect(), {r.doc_id: r.next_text for r in fingerprints.with_next(docs).collect()}


def test_fingerprints(spark):
    rows = [(1, "Ａb  C"), (2, "ab c"), (3, None), (4, ""), (5, "cafe\u0301 STRASSE"), (6, "café straße"), (None, "ab c "), (2, "ab c")]
    groups = {(r.doc_id, r.group_id, r.copies) for r in fingerprints.exact_groups(frame(spark, rows)).collect()}
    assert groups == {(1, 1, 4 + 0), (2, 1, 4), (None, 1, 4), (3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2)}
    texts = [(i, t) for i, (_, t) in enumerate(ODD) if t is not None]
    rows, after = edited_and_next(frame(spark, texts))
    assert {r.doc_id: (len(r.text), r.edited, after[r.doc_id]) for r in rows} == brute.op4_edited(texts)


def test_clashing_digests_are_told_apart(spark):
    rows = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "a"), ("g", "c"), ("g", "c")], "fingerprint string, fingerprint_canon string")
    out = fingerprints.numbered(rows, fingerprints.clashes(rows, "fingerprint"), "fingerprint").groupBy("fingerprint").count().collect()
    assert {tuple(r) for r in out} == {("f-1", 2), ("f-2", 1), ("g", 2)}
    assert fingerprints.clashes(rows.filter("fingerprint = 'g'"), "fingerprint") is None


@pytest.mark.parametrize("narrow", [False, True])
def test_edited_pairs_equal_brute_force(spark, monkeypatch, narrow):
    """Also with digests of one bit, where nearly all texts clash: equal fingerprints mean equal canonical texts, and likeness equality."""
    if narrow:
        monkeypatch.setattr(fingerprints, "digest", lambda canon: F.pmod(F.xxhash64(canon), F.lit(2)).cast("string"))
    texts = [(i, t) for i, (_, t) in enumerate(ODD) if t is not None] + [(100 + i, t) for i, t in enumerate(("same text", "Same  TEXT", "same text", "abc", "abcabc" * 2000, "ABC"))]
    rows, after = edited_and_next(frame(spark, texts))
    assert {r.doc_id: (len(r.text), r.edited, after[r.doc_id]) for r in rows} == brute.op4_edited(texts)
    canon, of = brute.canonical, {}
    for r in rows:
        of.setdefault(r.fingerprint, set()).add(canon(r.text))
        of.setdefault(r.edited_fingerprint, set()).add(canon(r.edited))
        assert (r.near_edited, r.near_next) == (float(canon(r.text) == canon(r.edited)), float(canon(r.text) == canon(after[r.doc_id])))
    assert all(len(x) == 1 for x in of.values())
    assert len(of) == len({c for x in of.values() for c in x})


def test_edited_pairs_of_null_texts_and_null_or_repeated_ids(spark):
    """One row a row; the next row of each is one that follows it by falling id, null ids last, and each row is next once."""
    texts = [(5, "five"), (5, "five"), (5, "FIVE"), (4, None), (3, "abc"), (None, "none"), (None, None)]
    rows = fingerprints.edited_pairs(frame(spark, texts)).collect()
    nexts = fingerprints.with_next(frame(spark, texts)).collect()
    want = sorted(((i, t or "") for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r.doc_id, r.text) for r in nexts), key=str) == want
    assert sorted(r.next_text for r in nexts) == sorted(t for _, t in want)
    by_id = {i: {(r.text, r.next_text) for r in nexts if r.doc_id == i} for i in (4, 3)}
    assert by_id[4] == {("", "abc")} and by_id[3] <= {("abc", "none"), ("abc", "")}
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert all(r.near_next in (0.0, 1.0) and r.near_edited in (0.0, 1.0) for r in rows)


def test_canonical_of_ascii_and_other_texts_alike(spark):
    """ASCII texts, which skip the Unicode rules, equal their brute-force form as others do."""
    texts = ["", " A  b\tC\n", "\t\n\x0b\x0c\r" + "".join(map(chr, range(32, 128))), "ABCÀÉ", "ſtraße ＡＢ", "I İ ı"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprints.canonical(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [brute.canonical(t) for t in texts]


@pytest.mark.parametrize("apart", [0.0, 3.0, 30.0])
def test_walks_reach_lists_of_clusters_far_apart(apart):
    dice = np.random.default_rng(3)
    middles = dice.normal(size=(24, 16)) * apart
    vectors = np.concatenate([m + dice.normal(size=(200, 16)) for m in middles])
    index = posting_lists.Index.fit(vectors, float(np.linalg.norm(vectors, axis=1).max()), 240, 10)
    homes = [set(h) for h in index.homes(posting_lists.lift(vectors, index.longest))]
    asked = np.arange(7, len(vectors), 40)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    hits = [bool(homes[row] & set(lists)) for lists, rows in zip(map(index.lists, posting_lists.lift(vectors[asked], None)), np.argsort(-scores, axis=1)[:, :10], strict=True) for row in rows]
    assert np.mean(hits) >= 0.9


def test_nearest_vectors(spark):
    dice = np.random.default_rng(8)
    vectors = {i: [float(np.float32(x)) for x in dice.normal(size=8)] for i in range(300)}
    for i in range(300, 400):  # a hot vector
        vectors[i] = vectors[0]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0]), (None, [1.0] * 8), (904, [None] + [1.0] * 7)]
    df = spark.createDataFrame([*vectors.items(), *bad, (5, vectors[5])], "vec_id long, embedding array<float>")
    got = posting_lists.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect()
    want = brute.nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    hits = sum(len({v for _, v, _ in by[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all([k for k, *_ in sorted(found)] == list(range(1, 21)) for found in by.values())
    assert [v for _, v, _ in sorted(by[0])][:20] == list(range(300, 320))


def test_secrets(spark):
    key = "Zk9Qw3xVb7Lm2Tn8Rp4Ys6"
    rows = [(1, f'password="{key}" token: short api_key = {"a" * 6}'), (2, "AKIA" + "Q" * 16 + " AKIA12"), (3, "0" * 23 + " " + "ab" * 12), (4, f"see {key} here"), (5, "d41d8cd98f00b204e9800998ecf8427e Thisisquiteanordinarylongword"), (6, None), (7, "password=token=abcdefg PASSWD:x123456")]
    scanned = secret_scans.scan(frame(spark, rows), registry.vocabulary("byte_bpe_50k.tiktoken"), registry.pattern())
    got = {r.doc_id: r for r in secret_scans.span_digests(scanned).collect()}
    for i, t in rows:
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == brute.op6_base(t or "")
    assert "random:4:26" in got[4].spans and "random" not in got[5].spans
    clean = {r.doc_id: r.redacted for r in scanned.collect()}
    assert clean[4] == "see [SECRET] here" and clean[6] is None and key not in clean[1]


def test_keys_behind_paths_and_names():
    encoding = secret_scans._vocabulary(registry.vocabulary("byte_bpe_50k.tiktoken"), registry.pattern())
    dice = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for front in ("config/production/database-connection-string=", "repos/documentation/settings/webhooks/", "x-internal-service-account_credential_"):
        for size in (20, 24, 32):
            keys = ["".join(dice.choice(letters) for _ in range(size)) for _ in range(50)]
            keys = [k for k in keys if secret_scans.random_spans(k, encoding)]
            covered = [any(a <= len(front) and b >= len(front) + size for a, _, b in secret_scans.random_spans(front + k, encoding)) for k in keys]
            assert len(keys) >= 45 and all(covered)
    plain = ["repos/documentation/settings/webhooks/v2/Readme", "objects/d41d8cd98f00b204e9800998ecf8427e/Documentation", "repositories/documentation/settings/configuration/production/Resource/123e4567-e89b-12d3-a456-426614174000/administration/documentation", "src/main/java/org/example/application2/ConfigurationManager"]
    assert not [t for t in plain if secret_scans.random_spans(t, encoding)]


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0."), (4, "licensed under the GNU General Public License, version 3"), (5, None), (6, "Licensed under the GNU Lesser General Public Licence, version 3"), (7, "underthe mit license étage under the mit licenses CC by nc"), (8, "")]
    got = {r.doc_id: r for r in licenses.license_labels(licenses.scan_licenses(frame(spark, rows))).collect()}
    for i, t in rows:
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute.op7_base(t or "")
    assert "GPL-notice" in got[4].labels and got[6].labels == "" and got[5].score == 0.0 and 0.7 < got[4].score < 1


def test_licenses_at_the_start_of_a_row_after_a_word(spark):
    rows = [(1, "see version 2"), (2, "under the MIT license"), (3, "c"), (4, "CC BY-NC"), (5, "é"), (6, "Licensed under the MIT License"), (7, ""), (8, "under"), (9, "the mit license")]
    got = {r.doc_id: r for r in licenses.license_labels(licenses.scan_licenses(spark.createDataFrame(rows, DOCS).coalesce(1))).collect()}
    for i, t in rows:
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute.op7_base(t)
    assert got[2].n_base == got[4].n_base == 1 and got[6].score > 0.7 and got[8].n_base == got[9].n_base == 0


MIT = """Copyright (c) 2020 A. Nother
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_license_texts(spark):
    """Accepted with other holders and without optional words, not with one mandatory word changed or missing."""
    rows = [(1, MIT), (2, "x " * 500 + MIT + " y"), (3, MIT.replace("(the \"Software\")", "")), (4, MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")), (5, MIT.replace("sublicense,", "")), (6, MIT.replace("FITNESS FOR A", "SUITABILITY FOR A")), (7, MIT.replace("DEALINGS IN THE SOFTWARE", "DEALINGS IN THE")), (8, "Licensed under Creative Commons CC BY-SA 4.0"), (9, "Licensed under CC BY 4.0"), (10, "licensed under the GNU Affero General Public License, version 3"), (11, "words " * 9000)]
    got = {r.doc_id: r.labels for r in licenses.license_labels(licenses.scan_licenses(frame(spark, rows))).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "", 6: "", 7: "", 8: "CC-BY-SA-4.0-notice", 9: "CC-BY-4.0-notice", 10: "AGPL-notice", 11: ""}


@pytest.mark.parametrize("markup,label", [x for x in licenses.TEMPLATES if len(x[0]) > 200])
def test_every_mandatory_word_counts(markup, label):
    plain = re.sub(r"\{\{\s*(\d+)\s+\d+\s*\}\}", lambda m: " ".join(["anyone"] * int(m[1])), re.sub(r"\[\[[^\]]*\]\]", "", markup)).split()
    machine = licenses.Template(markup)
    assert machine.accepts(plain) == len(plain)
    for k, word in enumerate(plain):
        if word != "anyone":
            assert not machine.accepts([*plain[:k], "wrong", *plain[k + 1 :]])


def test_template_regions():
    t = licenses.Template("a [[b c]] {{1 2}} d")
    yes = ["a x d", "a b c x d", "a x y d", "a b c x y d"]
    assert all(t.accepts(w.split()) for w in yes)
    assert not any(t.accepts(w.split()) for w in ["a d", "a b c d e f g", "b x d", "a x y z d"] if w != "a b c d e f g")


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(["http://a.Example.NET/en/x?q", "https://example.net/de", "x://EXAMPLE.com/de/1#t", "x://notexample.com/de/1", "http://net", "http://net/", "ftp://b.org/fr/", "http://b.org?x=/fr/", "no scheme", None, "://", "http://user@example.net/en/", "http://example.net.evil/en/", "a://b.net/x://y.org/fr/", "http://x.net/en/"])]
    out = url_rules.judge(frame(spark, rows, "page_id long, url string"), url_rules.rule_table(spark)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: brute.op9(u) for i, u in rows}


def test_a_window_is_measured_as_by_plain_compression():
    """A word's difference is that of the lengths of its window under both trained dictionaries."""
    import zstandard as z

    dice = random.Random(1)
    plain = [("".join(dice.choice("abcdefghij") for _ in range(7)).encode(), 1 + k) for k in range(200)]
    foul = [(w, 5) for w in (b"nastyword", b"vileterm", b"foulname")]
    model = toxicity.Model(toxicity.trained(foul, 2048, 4000), toxicity.trained(plain, 4096, 4000))
    assert len(model.toxic) > 300 and b"nastyword" in model.toxic and b"nastyword" not in model.ordinary
    assert toxicity.trained([], 100, 10) == b"" and toxicity.trained([(b"one", 1)], 100, 1) == b" one "
    distance = toxicity._Distance(model.toxic, model.ordinary)

    def length(content, window):
        how = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, strategy=z.STRATEGY_LAZY, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=5, target_length=16)
        return len(z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(content + toxicity._CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)).compress(window))

    blank = length(model.ordinary, toxicity._CARRIER * 2) - length(model.toxic, toxicity._CARRIER * 2)
    for word in (b"nastyword", plain[150][0], b"unseen", "w\u00f6rter".encode()):
        window = toxicity._CARRIER + b" " + word + b" " + toxicity._CARRIER
        assert distance.of(word) == length(model.ordinary, window) - length(model.toxic, window) - blank
    assert distance.of(b"nastyword") >= 3 > 0 >= distance.of(plain[199][0])


def test_toxicity_learns_and_is_held_out_of_some_rows(spark):
    dice = random.Random(3)
    plain = ["".join(dice.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    rows, labels = [], []
    for i in range(300):
        words = [dice.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                words[dice.randrange(60)] = dice.choice(("grumbleworm", "snotbucket", "dunderhead"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = frame(spark, rows + [(1000, None), (None, "x")]), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, marks)).collect()}
    assert all(got[i].predicted == t for i, t in labels)
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert 0 <= got[1000].score <= 1


@pytest.mark.parametrize("text", ["日本語。" * 80, "x" * 65, "é" * 33 + "a" * 95, "🙂" * 50 + "b", "a" * 64, "short 한국어" * 30, "a" + "語" * 200])
def test_long_runs_are_whole_in_windows(text):
    body = np.frombuffer((text + " next").encode(), dtype=np.uint8)
    whole = toxicity.runs(toxicity._LETTERS[body], np.array([0, len(body)]))
    starts, ends = toxicity._windows(body, *whole)
    seen = np.zeros(len(body), dtype=bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        body[a:b].tobytes().decode()  # cut between characters
        assert 0 < b - a <= toxicity.LONGEST_WORD
        seen[a:b] = True
    assert (seen == toxicity._LETTERS[body]).all() and (np.diff(starts) > 0).all()
    if max(whole[1] - whole[0]) <= toxicity.LONGEST_WORD:
        assert starts.tolist() == whole[0].tolist() and ends.tolist() == whole[1].tolist()


def test_toxic_words_late_in_a_run_are_measured(spark):
    dice = random.Random(6)
    plain = ["".join(dice.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    rows, labels = [], []
    for i in range(300):
        words = [dice.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(5):
                words[dice.randrange(60)] = dice.choice(("grumbleworm", "snotbucket", "dunderhead"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    calm = "".join(plain[:40])
    import pyarrow as pa

    found = toxicity._distance(model.toxic, model.ordinary).features(pa.array([calm, calm + "snotbucketdunderheadgrumbleworm" * 3]))
    assert found[1, 0] > found[0, 0] and found[1, 0] >= 5  # the bytes that the most telling window saves


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_labelled_rows_are_bounded_by_a_hash_of_the_id(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    got = toxicity._first_of_each(rows, {1: 400, 0: 50}).collect()
    order = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = {i for i in order if i % 10 == 0} | set([i for i in order if i % 10][:50])
    assert len(got) == 350 and {r.doc_id for r in got} == want


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        pool = rng.integers(0, 1 << 62, 400)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        apart = sum(int(x ^ y).bit_count() for x, y in zip(near_dups._parity(a).view(np.uint64), near_dups._parity(b).view(np.uint64), strict=True))
        assert apart <= len(np.setxor1d(a, b))
