"""How filters of documents interact, over every order in which they may be applied (operator 12).

A document's failures are one number of five bits. A table of 32 x 120 entries, made once,
holds the step at which each order first removes each number; tasks look their rows up in
it, count steps by part and label, and the counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
_SPACE = r"[\x20\x09-\x0D]+"


def first_failures() -> np.ndarray:
    """[failures, order]: the step, from 0, at which the order first removes a row with these failures; 5 if it never does."""
    places = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> places[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, failed, digest``: bits of the filters A to D that a row fails, and the text's SHA-256.

    A: under 100 words. B: fewer than 80 distinct ones a hundred. C: over 10 capitals A-Z a
    hundred code points. D: any of ``#$%&*|``. A null text is empty, a null part ''.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    rows = rows.withColumn("words", words)
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    tests = (n < 100, distinct * 100 < n * 80, capitals * 100 > F.char_length("text").cast("long") * 10, F.col("text").rlike(r"[#$%&*|]"))
    failed = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", failed.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with bit E in ``failed``: a smaller id has the same text. Rows of the smallest id, and of a null one, don't fail."""
    key = F.pmod(F.xxhash64("digest"), F.lit(1024))  # a key of its own, so that adaptive execution can split a text that many rows hold
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least", key.alias("key"))
    joined = rows.withColumn("key", key).join(firsts, ["digest", "key"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("failed") + F.when(copy, 1 << 4).otherwise(0)).alias("failed"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, cells = first_failures(), len(ORDERS) * (STEPS + 1)
    order = np.arange(len(ORDERS)) * (STEPS + 1)
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        parts, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        failed, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("failed", "good", "toxic"))
        at = parts[:, None] * cells + order + table[failed]
        for kind, rows in enumerate((slice(None), good == 1, toxic == 1)):
            found = np.bincount(at[rows].ravel(), minlength=len(names) * cells).reshape(len(names), cells)
            for name, row in zip(names, found, strict=True):
                totals.setdefault(name, np.zeros((3, cells), dtype=np.int64))[kind] += row
    for name, sums in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * cells, pa.string()), pa.array(np.arange(cells), pa.int32()), *(pa.array(x, pa.int64()) for x in sums)], ["part", "cell", "removed", "good_lost", "toxic_lost"])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, all counts of rows.

    A row a part, order and step, zeros included. Filters A to D are those of ``failures``;
    E: a smaller id of the whole table has the same text. ``labels (doc_id, quality, toxic)``
    may lack ids, hold nulls or repeat an id: a row is good, or toxic, if any of its labels
    says 1. Rows of one id are counted one by one; an empty table gives no rows.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = with_copies(cut(failures(docs, id_col, text_col, part_col))).join(marks, "doc_id", "left")
    flags = rows.select("part", "failed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    counts = flags.mapInArrow(_counted, "part string, cell int, removed long, good_lost long, toxic_lost long").groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    names = F.array(*map(F.lit, ORDERS))
    step = F.col("cell") % (STEPS + 1) + 1
    named = counts.withColumn("filter_order", F.element_at(names, F.expr(f"cell div {STEPS + 1}").cast("int") + 1)).withColumn("step", step)
    named = named.withColumn("filter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    behind = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("part", "filter")  # 720 rows a part in all
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(own)  # noqa: E731  first in an order, a filter removes all it fails; last, what it alone fails
    full = named.withColumn("kept", F.sum("removed").over(behind)).filter(F.col("step") <= STEPS)
    full = full.withColumns({"redundant": at(1) - F.col("removed"), "unique_fails": at(STEPS), "shapley": F.sum("removed").over(own)})
    return full.select("part", "filter_order", "step", "filter", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))
