"""Canonical exact digests of documents (operator 4), with SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, id_and_text, setting, written

FILTER_CELLS = 1 << 20


def canonical(text: Column) -> Column:
    """Compatibility-composed, case-folded, with runs of white space made one space and cut off at both ends.

    A text of ASCII only, as long in bytes as in characters, is composed as it stands, and
    folding lower-cases it; so ICU sees the other texts only.
    """
    icu = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
    composed = F.reflect(F.lit(icu[0]), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit(icu[1]), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit(icu[0]), F.lit("compose"), folded, F.lit(True))
    even = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(again)
    return F.trim(F.regexp_replace(even, r"[\s\p{Z}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits: two differently salted 64-bit xxhashes, as 32 hex digits."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon)))


def fingerprint(text: Column) -> Column:
    """The digest of the canonical text, which is computed once."""
    return F.element_at(F.transform(F.array(canonical(text)), digest), 1)


def clashes(rows: DataFrame, *names: str) -> DataFrame | None:
    """``bucket, canon, number`` of every text in a bucket of ``rows`` that holds different texts; None if there is no such bucket.

    A bucket is all rows and all digest columns ``names`` of one digest; ``<name>_canon`` is
    the text it is of. Digests are counted first, without their texts; then the texts of
    repeated ones are compared byte by byte: a bucket is mixed if its least and greatest
    text differ, which map-side aggregates find, however hot it is. Texts whose digest falls
    into no marked cell stay out before their canonical text is made; at most FILTER_CELLS
    cells are broadcast, whatever the corpus. ``rows`` are read several times, so digests
    should lie in a written table.
    """
    cell = F.pmod(F.xxhash64("bucket"), F.lit(FILTER_CELLS)).cast("int").alias("cell")
    with setting(rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # each pass frees its shuffle
        repeated = rows.select(F.explode(F.array(*names)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        cells = F.broadcast(cut(repeated.select(cell).distinct()))
        each = (rows.select(F.col(n).alias("bucket"), F.col(f"{n}_canon").alias("canon")).withColumn("cell", cell) for n in names)
        near = reduce(DataFrame.unionByName, (one.join(cells, "cell", "left_semi").drop("cell") for one in each))
        mixed = cut(near.groupBy("bucket").agg(F.min("canon").alias("x"), F.max("canon").alias("y")).filter("x != y").select("bucket"))
        if mixed.isEmpty():
            return None
        found = near.join(mixed, "bucket", "left_semi").distinct()
        return cut(found.withColumn("number", F.row_number().over(Window.partitionBy("bucket").orderBy("canon"))))


def numbered(rows: DataFrame, found: DataFrame | None, *names: str) -> DataFrame:
    """``rows`` with the numbers of ``found`` (see ``clashes``) behind those digests ``names`` that they are of."""
    for name in names if found is not None else ():
        rows = rows.join(found, (F.col(name) == F.col("bucket")) & (F.col(f"{name}_canon") == F.col("canon")), "left")
        rows = rows.withColumn(name, F.concat_ws("-", name, "number")).drop("bucket", "canon", "number")
    return rows


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, group_id, copies`` for every row of ``docs``; ``group_id``: the smallest id of the group.

    Texts of one digest are compared byte by byte; where they differ, each has its number
    behind the digest. A null text counts as empty; null ids and repeated rows stay; an
    empty table gives an empty table; other columns are not read.
    """
    rows = written(id_and_text(docs, id_col, text_col).withColumn("fingerprint", fingerprint(F.col("text"))))
    rows = rows.withColumn("fingerprint_canon", canonical(F.col("text"))).drop("text")
    rows = numbered(rows, clashes(rows, "fingerprint"), "fingerprint").select("doc_id", "fingerprint")
    groups = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "copies")


def _bucket(key: Column, bounds: list[int], first: int = 0) -> Column:
    """``first`` and how many of the rising ``bounds`` are at most ``key``, as a balanced tree of conditions."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(key < F.lit(bounds[half]).cast("long"), _bucket(key, bounds[:half], first)).otherwise(_bucket(key, bounds[half + 1 :], first + half + 1))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, fingerprint, next_text, next_fingerprint``: each row with the next one by falling id, the last with the first.

    Ties go by a hash of the text; null ids come last. Ids are dealt out by ranges that an
    approximate percentile gives, four a shuffle partition, so that no task sees more than
    its share; only the first row's key of each range comes to the driver.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    low = F.lit(-(1 << 63)).cast("long")
    keyed = source.withColumn("key", F.coalesce("doc_id", low)).withColumn("tie", F.xxhash64("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    ids = source.select(F.coalesce("doc_id", low).alias("key")).agg(F.percentile_approx("key", shares, 20 * ranges).alias("p")).first()["p"]
    keyed = keyed.withColumn("range", _bucket(F.col("key"), sorted(set(ids or []))))
    firsts = keyed.groupBy("range").agg(F.max(F.struct("key", "tie")).alias("top")).orderBy(F.desc("range")).collect()  # a row a range
    if not firsts:
        empty = F.lit("")
        return source.select("doc_id", "text", empty.alias("fingerprint"), empty.alias("next_text"), empty.alias("next_fingerprint"))
    pairs = [(one["range"], two["top"]["key"], two["top"]["tie"]) for one, two in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    links = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("top_range"), F.lit(k).cast("long").alias("top_key"), F.lit(t).cast("long").alias("top_tie")) for a, k, t in pairs))))
    tops = source.select(F.coalesce("doc_id", low).alias("top_key"), F.xxhash64("text").alias("top_tie"), F.col("text").alias("top_text"))
    tops = tops.filter(F.col("top_key").isin([k for k in {k for _, k, _ in pairs}])).join(links, ["top_key", "top_tie"])
    tops = tops.groupBy("top_range").agg(F.first("top_text").alias("top_text")).withColumn("top_fingerprint", fingerprint(F.col("top_text")))
    by = Window.partitionBy("range").orderBy(F.desc("key"), F.desc("tie"))
    dealt = keyed.repartition("range").withColumn("fingerprint", fingerprint(F.col("text")))  # the window's own shuffle, before the dear step
    ahead = dealt.withColumn("ahead", F.lead("text").over(by)).withColumn("ahead_fingerprint", F.lead("fingerprint").over(by))
    both = ahead.join(tops, (F.col("range") == F.col("top_range")) & F.col("ahead").isNull(), "left")
    return both.select("doc_id", "text", "fingerprint", F.coalesce("ahead", "top_text").alias("next_text"), F.coalesce("ahead_fingerprint", "top_fingerprint").alias("next_fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and whether it is like the edited and the next text.

    ``doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next``. Texts
    and edited texts of one digest, of all rows, are compared byte by byte; where they
    differ, each has its number behind the digest. So fingerprints are equal if, and only
    if, the canonical texts are. An exact digest knows no degrees: the likeness is 1 for
    equal canonical texts, else 0. A null text counts as empty; repeated rows and null ids
    stay (see ``with_next`` for their order); an empty table gives an empty table; other
    columns are not read, whatever their names.
    """
    third = F.floor(F.char_length("text") / F.lit(3)).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.char_length("text") - third), "head")
    rows = with_next(docs, id_col, text_col).withColumn("head", F.substr("next_text", F.lit(1), third)).withColumn("edited", edited)
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    same = lambda x: canonical(F.col("text")) == canonical(F.col(x))
    like = lambda x, y: F.when(F.col("fingerprint") == F.col(y), same(x)).otherwise(F.lit(False)).cast("double")
    rows = rows.withColumns({"near_edited": like("edited", "edited_fingerprint"), "near_next": like("next_text", "next_fingerprint")})
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        rows = written(rows.drop("edited", "next_text", "next_fingerprint"))
    rows = rows.withColumn("edited", edited).withColumn("fingerprint_canon", canonical(F.col("text"))).withColumn("edited_fingerprint_canon", canonical(F.col("edited")))
    names = "fingerprint", "edited_fingerprint"
    return numbered(rows, clashes(rows, *names), *names).select("doc_id", "text", "edited", *names, "near_edited", "near_next")
