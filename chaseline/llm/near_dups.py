"""Near-duplicate documents by bottom-k sketches of one hash function (operator 2).

1. Each text becomes the set of 64-bit hashes of its word shingles. Texts with one
   set (by a 126-bit digest of it) are one class; only classes are compared.
2. A class keeps the ``k`` smallest hashes of its set, its sketch. Two sets of
   similarity ``t`` share about ``t * k`` retained values, so they also share one of
   their ``k - m + 1`` rarest (``m``: the least overlap accepted below). Inverted
   lists are kept for those values only, so a value that a third of all documents
   hold is listed for hardly any of them.
3. Only classes that share as many retained values with others as a similar set must are
   listed. In each list all members are compared with a few heads: the member whose full set
   is the most common, which in a group of edited copies is the one nearest to the others,
   and others that a hash picks. A pair is dropped if the bottom-k sketch of the union (made
   of the two sketches) estimates less than ``t - SLACK``; the rest are confirmed on the
   full sets, and form components.
4. Members that share a list but not a component are paired by their full sets, with
   exact prefix and position filters, and confirmed. A pair left out is thus in one
   component anyway, or can't have the similarity; and no list emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytespans import lower_ascii, mix, runs, span_hashes, text_slices
from .components import components, join_sums
from .shared import free_names, id_and_text, setting, tidied

SKETCH_SIZE = 64
#: Four standard deviations of a 64-value estimate at similarity 0.8; sets of at most SKETCH_SIZE values need none.
SLACK = 0.2
#: Cells of the fixed-size count table that orders values by frequency; any order gives right results.
CELLS = 1 << 18
FILTER_CELLS = 1 << 20
#: Heads of a list besides the most common member; any number gives right results. Where half of a dense group's pairs
#: are links, each head halves what the last step has to pair.
HEADS = 2
#: Words of 64 bits in the parity map of a full set; any number gives right results.
PARITY_WORDS = 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 63-bit shingle hashes) of each text."""
    for first, last, buf, off in text_slices(column):
        lower_ascii(buf)
        starts, ends = runs(~_SPACE[buf[: off[-1]]], off)
        hashes = span_hashes(buf, starts, ends)
        bounds = np.searchsorted(starts, off)
        chained = np.full(max(len(hashes) - words + 1, 0), words, dtype=np.uint64)
        for i in range(words):
            chained = mix(chained ^ hashes[i : i + len(chained)]) + _SALT
        chained >>= np.uint64(1)
        for row in range(last - first):
            a, b = bounds[row], bounds[row + 1]
            if b - a >= words:
                found = np.unique(chained[a : b - words + 1])
            else:  # the whole sequence as one shingle
                h = np.full(1, b - a, dtype=np.uint64)
                for i in range(a, b):
                    h = mix(h ^ hashes[i : i + 1]) + _SALT
                found = h[: int(b > a)] >> np.uint64(1)
            yield first + row, found


def _digest(found: np.ndarray) -> tuple[int, int]:
    one, two = mix(found).sum(dtype=np.uint64), mix(found ^ _SALT).sum(dtype=np.uint64)
    return int(one >> np.uint64(1)), int(two >> np.uint64(1))


def _lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    sizes = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=sizes[1:])
    flat = np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, kind))


def sketches(docs: DataFrame, words: int = 5, k: int = SKETCH_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, hi, lo, n, sketch`` per row: digest of the shingle set, its size, its ``k`` smallest hashes in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, ns, kept = [], [], [], []
            for _, found in _shingle_sets(batch.column(1), words):
                hi, lo = _digest(found)
                his.append(hi)
                los.append(lo)
                ns.append(len(found))
                kept.append(found[:k])
            if ns:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ns, pa.int64()), _lists(kept)], ["doc_id", "text_hash", "hi", "lo", "n", "sketch"])

    return id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(task, "doc_id long, text_hash long, hi long, lo long, n long, sketch array<long>")


def _texts_of(classes: DataFrame, source: DataFrame) -> DataFrame:
    """``cid, text, hi, lo``: texts of each class's document of smallest id, one if that has one text.

    Texts whose hash falls into no marked cell stay out before the shuffle; at most
    FILTER_CELLS marked cells are broadcast, whatever the corpus.
    """
    low = F.lit(-(1 << 63)).cast("long")
    cell = lambda key: F.pmod(F.xxhash64(key), F.lit(FILTER_CELLS)).cast("int").alias("cell")
    wanted = classes.select("cid", "hi", "lo", F.coalesce("root", low).alias("key"))
    cells = F.broadcast(wanted.select(cell("key")).distinct())
    texts = source.select(F.coalesce("doc_id", low).alias("key"), "text").withColumn("cell", cell("key")).join(cells, "cell", "left_semi").select("key", "text")
    return texts.join(wanted, "key").withColumn("hash", F.xxhash64("text")).dropDuplicates(["key", "cid", "hash"]).select("cid", "text", "hi", "lo")


def _full_sets(texts: DataFrame, words: int) -> DataFrame:
    """``cid, shingles`` of those texts whose set has the digest that the row names.

    A class may come twice, if one id has two texts of one set; pairs and links allow that.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows, sets = [], []
            for row, found in _shingle_sets(batch.column(1), words):
                if _digest(found) == (his[row], los[row]):
                    rows.append(row)
                    sets.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _lists(sets)], ["cid", "shingles"])

    return texts.mapInArrow(task, "cid long, shingles array<long>")


def _least_overlap(n: np.ndarray | int, k: int, percent: int) -> int:
    """Retained values that a set of ``n`` values shares with any set of the wanted similarity."""
    if n * 100 <= k * percent:  # the partner's sketch is its whole set too
        return -(-n * percent // 100)
    return int(min(n, k) * (percent / 100 - SLACK))


def _dense(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The classes that hold as many retained values in common with others as any similar set must."""
    values = classes.select("cid", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v")
    counts = values.join(shared, "v").groupBy("cid").agg(F.count("*").alias("shared"))
    n = F.col("n")
    least = F.when(n * 100 <= k * percent, F.ceil(n * percent / 100)).otherwise(F.floor(F.least(n, F.lit(k)) * (percent / 100 - SLACK)))
    return classes.join(counts, "cid").filter(F.col("shared") >= least).drop("shared")


def _cell_counts(values: DataFrame) -> np.ndarray:
    """How often the values of each cell occur; at most CELLS rows come to the driver, whatever the corpus."""
    cells = values.groupBy(F.pmod("v", F.lit(CELLS)).alias("cell")).agg(F.count("*").alias("c")).toArrow()
    counts = np.zeros(CELLS, dtype=np.float32)
    counts[cells.column("cell").to_numpy()] = cells.column("c").to_numpy()
    return counts


def _prefixes(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``value, cid, n``: each class under its rarest retained values."""
    shared = classes.sparkSession.sparkContext.broadcast(_cell_counts(classes.select(F.explode("sketch").alias("v"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            cids, ns = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            values, owner = [], []
            for i in range(len(cids)):
                own = flat[ends[i] : ends[i + 1]]
                order = np.lexsort((own, weight[own % CELLS]))[: len(own) - _least_overlap(int(ns[i]), k, percent) + 1]
                values.append(own[order])
                owner.append(np.full(len(order), i))
            if values:
                at = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(cids[at]), pa.array(ns[at])], ["value", "cid", "n"])

    return classes.select("cid", "n", "sketch").mapInArrow(task, "value long, cid long, n long")


def _common(sets: DataFrame) -> DataFrame:
    """``cid, common``: how common the values of each full set are among ``sets (cid, shingles)``."""
    shared = sets.sparkSession.sparkContext.broadcast(_cell_counts(sets.select(F.explode("shingles").alias("v"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.log1p(shared.value)
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            if len(sizes):
                firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                sums = np.add.reduceat(weight[lists.flatten().to_numpy(zero_copy_only=False) % CELLS].astype(np.float64), firsts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums / sizes)], ["cid", "common"])

    return sets.select("cid", "shingles").mapInArrow(task, "cid long, common double").groupBy("cid").agg(F.max("common").alias("common"))


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: every member of a list with its heads, the list's most common one and HEADS that a hash picks."""
    picked = [F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("h"), "cid", "n")).alias(f"h{k}") for k in range(HEADS)]
    heads = members.groupBy("value").agg(F.max(F.struct("common", "cid", "n")).alias("top"), *picked)
    each = F.array_distinct(F.array(*(F.struct(F.col(f"{h}.cid").alias("head"), F.col(f"{h}.n").alias("head_n")) for h in ("top", *(f"h{k}" for k in range(HEADS))))))
    return _near(members.join(heads.select("value", F.inline(each)), "value"), percent)


def _near(met: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``cid, n`` and ``head, head_n`` whose sizes allow the similarity, as ``a, b``."""
    near = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    return met.filter("cid != head").filter(near).select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` whose union sketch doesn't rule the similarity out."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    exact = F.greatest("n_a", "n_b") <= k  # then both sketches are whole sets
    union = F.when(exact, F.array_union("s_a", "s_b")).otherwise(F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    least = F.when(exact, F.lit(percent / 100)).otherwise(F.lit(percent / 100 - SLACK))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.filter(near).filter(shared >= least * F.size(union) - 1e-9).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` whose full sets have the similarity."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")


def _parity(found: np.ndarray) -> np.ndarray:
    """A bit for each residue, set if an odd number of values has it; two maps differ in no more bits than the sets in values."""
    bits = np.bincount(found % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _across(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``labelled (cid, label, shingles)`` of different labels that can have the similarity, by their full sets.

    Values are put in order of their frequency here, rarest first. Sets of sizes n and m
    share ``t / (1 + t) * (n + m)`` values at least, so their first shared value stands where
    ``n - place`` and ``m - place`` are no less; in a list that limits a set's partners to
    sizes of at most ``reach``. Sizes are matched by classes, and members of a list's
    commonest label are not paired with each other. Parity maps of the full sets rule out
    sets that differ in more values than the similarity allows, before a pair is made. Two
    sets whose last value before this one is the same have met in that value's list.
    """
    spark = labelled.sparkSession
    t = percent / 100
    shared = spark.sparkContext.broadcast(_cell_counts(labelled.select(F.explode("shingles").alias("v"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            cids, labels, lists = (batch.column(i) for i in range(3))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            values, befores, rows, sizes, reaches, maps = [], [], [], [], [], np.zeros((len(cids), PARITY_WORDS), dtype=np.int64)
            for i in range(len(cids)):
                own = flat[ends[i] : ends[i + 1]]
                n = len(own)
                maps[i] = _parity(own)
                order = np.lexsort((own, weight[own % CELLS]))[: n - -(-n * percent // 100) + 1]
                values.append(own[order])
                befores.append(np.concatenate([[-1], own[order][:-1]]))
                rows.append(np.full(len(order), i))
                sizes.append(np.full(len(order), n))
                reaches.append(np.floor((n - np.arange(len(order))) * (1 + t) / t - n + 1e-9).astype(np.int64))
            if values:
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), cids.take(pa.array(at)), labels.take(pa.array(at)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(reaches)), pa.array(np.concatenate(befores)), *(pa.array(maps[at, i]) for i in range(PARITY_WORDS))], ["value", "cid", "label", "n", "reach", "before", *parity])

    parity = [f"m{i}" for i in range(PARITY_WORDS)]
    entries = labelled.select("cid", "label", "shingles").mapInArrow(task, "value long, cid long, label long, n long, reach long, before long, " + ", ".join(f"{m} long" for m in parity))
    held = entries.groupBy("value", "label").agg(F.count("*").alias("c")).groupBy("value").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
    entries = tidied(entries.join(held.filter("labels > 1").drop("labels"), "value"))
    level = lambda n: F.when(n <= 50, n).otherwise(F.floor(F.log(n.cast("double")) / F.log(F.lit(1.02))).cast("long"))
    small = entries.select("value", level(F.col("n")).alias("level"), F.col("cid").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("reach").alias("reach_b"), F.col("before").alias("before_b"), *(F.col(m).alias(f"{m}_b") for m in parity), (F.col("label") != F.col("main")).alias("other_b"))
    most = F.least("n", "reach")
    least = F.ceil(F.col("n") * t - 1e-9)
    # The level of 50 and less is the size itself, above it starts over at 1.02 ** level; both rise, and 51 lies on level 198.
    large = entries.filter(most >= least).withColumn("level", F.explode(F.sequence(level(least), level(most)))).filter("level <= 50 or level >= 198").withColumn("other", F.col("label") != F.col("main"))
    keys = ["value", "level"]
    met = large.filter("other").drop("other").join(small.drop("other_b"), keys).unionByName(large.filter("not other").drop("other").join(small.filter("other_b").drop("other_b"), keys))
    found = met.filter("label != label_b and cid != b and n >= n_b and n <= reach_b and n_b <= reach and (before != before_b or before < 0)").filter(100 * F.col("n_b") >= percent * F.col("n"))
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_b"))) for m in parity), F.lit(0))
    found = found.filter((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_b")))
    return found.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; two documents are
    linked if ``100 * |A & B| >= percent * |A | B|`` over their sets of ``words``-word
    shingles (a shorter text is one shingle). ``component_id`` is the smallest id that
    links reach. A text that is null or has no words has ``n_shingles`` 0 and is its own
    component. Repeated rows stay and share a component; a null id is never a
    ``component_id`` unless all ids reachable are null, and is kept only then. An empty
    table gives an empty table; other columns are not read.
    """
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # a step's shuffle files go as soon as its cut is written
        rows, named = _named_classes(docs, words, percent, k, id_col, text_col)
    full = rows.filter("n > 0").select("doc_id", "n", "hi", "lo", "text_hash").join(named, ["hi", "lo"]).select("doc_id", "n", "component_id", "text_hash")
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_hash")
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def _named_classes(docs: DataFrame, words: int, percent: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and ``hi, lo, component_id`` of each class of equal sets."""
    source = id_and_text(docs, id_col, text_col)
    rows = tidied(sketches(docs, words, k, id_col, text_col))
    classes = rows.filter("n > 0").groupBy("hi", "lo").agg(F.first("n").alias("n"), F.min("doc_id").alias("root"), F.first("sketch").alias("sketch"))
    classes = tidied(classes.withColumn("cid", F.monotonically_increasing_id()))

    dense = tidied(_dense(classes, k, percent))
    listed = _prefixes(dense, k, percent)
    held = listed.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1").select("value")
    found = tidied(listed.join(held, "value"))
    sets = tidied(_full_sets(_texts_of(found.select("cid").distinct().join(dense, "cid"), source), words))
    members = tidied(found.join(_common(sets), "cid"))
    links = tidied(_confirmed(tidied(_estimated(_first_pairs(members, percent), dense, k, percent)), sets, percent))
    labels = components(links)

    # Lists whose members are not yet one component: pairs across components. Two members have met.
    marked = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    split = marked.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).filter("x != y and size > 2").select("value")
    open_ = marked.join(split, "value").select("cid", "label").distinct()
    labelled = tidied(sets.join(open_, "cid"))  # read twice: for counts, then for pairs
    extra = tidied(_confirmed(_across(labelled, percent), sets, percent))
    if not extra.isEmpty():
        labels = components(links.unionByName(extra))

    linked = labels.withColumnRenamed("node", "cid").join(classes.select("cid", "root"), "cid")
    least = linked.groupBy("label").agg(F.min("root").alias("component_id"))
    named = join_sums(linked.select("cid", "label"), least, "label").select("cid", "component_id", F.lit(True).alias("is_linked"))
    named = classes.select("hi", "lo", "cid", "root").join(named, "cid", "left")
    return rows, tidied(named.select("hi", "lo", F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("root")).alias("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which ``near_duplicates`` keeps the document.

    Rows of one id and one text become one; otherwise see ``near_duplicates``.
    """
    own_id, own_hash = free_names(docs, "kept_id", "kept_hash")
    kept = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_hash: F.xxhash64(text)})
    rows = hashed.join(kept, hashed[own_id].eqNullSafe(kept[own_id]) & (hashed[own_hash] == kept[own_hash]), "left_semi")
    return rows.dropDuplicates([id_col, own_hash]).select(*(f"`{c}`" for c in docs.columns))
