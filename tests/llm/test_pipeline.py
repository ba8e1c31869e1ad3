"""The pipeline's stages on odd rows and columns of any name, and as a whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chaseline.llm import registry, shared
from tests.llm import brute

NAMES = ["score", "predicted", "held_out", "spans", "redacted", "kept_id", "own_hash", "kept_text", "toxic", "label", "Value"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows): plain and toxic texts, near copies, secrets, null, empty and long ones, repeated rows."""
    dice = random.Random(9)
    plain, foul = [f"word{i}" for i in range(300)], [f"foul{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(120):
        toxic = i % 4 == 0
        words = [dice.choice(plain) for _ in range(30)]
        if toxic:
            for _ in range(6):
                words[dice.randrange(30)] = dice.choice(foul)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    base = [dice.choice(plain) for _ in range(60)]
    rows += [(300, " ".join(base)), (301, " ".join([*base[:-1], "other"])), (302, " ".join(base)), (302, " ".join(base))]
    rows += [(400, "the key password = hunter2secret9 stands here"), (401, None), (402, ""), (402, ""), (None, None), (None, "some words without an id here"), (403, "long words here " * 3000)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


def within(some, whole):
    """Whether all rows of ``some`` are among those of ``whole``."""
    return not Counter(map(tuple, some.collect())) - Counter(map(tuple, whole.collect()))


def wide(docs):
    """With columns whose names the operators use inside, each with values of its own."""
    return docs.withColumns({n: F.concat_ws(":", F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


def test_toxicity_keeps_columns_and_clean_rows(spark, corpus):
    folder, rows = corpus
    docs = wide(shared.table(spark, folder, "documents"))
    out = shared.cut(STAGES["toxicity"](spark, docs, folder))
    assert out.dtypes == docs.dtypes
    assert within(out, docs)
    kept = sorted((str(r.doc_id), str(r.text)) for r in out.collect() if r.doc_id is None or r.doc_id >= 120)
    assert kept == sorted((str(i), str(t)) for i, t in rows if i is None or i >= 120)
    left = {r.doc_id for r in out.collect() if r.doc_id is not None and r.doc_id < 120}
    assert len([i for i in left if i % 4]) >= 85 and len([i for i in left if i % 4 == 0]) <= 5


def test_near_duplicates_keep_columns_and_one_of_each_group(spark, corpus):
    folder, rows = corpus
    docs = wide(shared.table(spark, folder, "documents"))
    out = shared.cut(STAGES["minhash_near_dups"](spark, docs, folder))
    assert out.columns == docs.columns and within(out, docs)
    want = {(str(i), t) for (i, t), (_, _, c) in zip(rows, brute.near_dups(rows, 5), strict=True) if c == i}
    assert {(str(r.doc_id), r.text) for r in out.collect()} == want
    assert out.count() == len(want)


def test_secrets_are_replaced_and_columns_stay(spark, corpus):
    folder, rows = corpus
    docs = wide(shared.table(spark, folder, "documents"))
    out = shared.cut(STAGES["secret_scans"](spark, docs, folder))
    assert out.columns == docs.columns and out.count() == len(rows)
    assert within(out.drop("text", "n_chars"), docs.drop("text", "n_chars"))
    row = out.filter("doc_id = 400").first()
    assert row.text == "the key password = [SECRET] stands here" and row.n_chars == len(row.text)
    assert out.filter("doc_id = 401 and text is null and n_chars is null").count() == 1
    same = out.filter("doc_id != 400 or doc_id is null").select("doc_id", "text")
    assert within(same, docs.select("doc_id", "text"))


def test_packing_of_any_columns(spark, corpus):
    folder, rows = corpus
    docs = wide(shared.table(spark, folder, "documents"))
    out = STAGES["best_fit_packing"](spark, docs, folder)
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.collect())
    assert got == sorted((str(i), *p) for i, t in rows for p in brute.op8_pieces(t))


def test_all_stages_of_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = wide(shared.table(spark, folder, "documents")).filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        assert name == "best_fit_packing" or out.columns == docs.columns


def test_the_whole_equals_its_stages(spark, corpus):
    folder, _ = corpus
    docs = shared.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, folder))
    want = sorted((str(r.doc_id), *p) for r in docs.collect() for p in brute.op8_pieces(r.text))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 1024


def test_no_machine_local_cuts_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Frame:
        class sparkSession:
            sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.cut(Frame())
    assert registry.SPECIAL
