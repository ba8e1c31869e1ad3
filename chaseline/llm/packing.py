"""Best-fit packing of token sequences by a grouping genetic algorithm (operator 8).

Pieces of one length are interchangeable, so the problem to solve is the histogram of
lengths: at most ``capacity`` rows, however large the corpus. Islands (one task each)
evolve populations of solutions of it, and each island's best members move on to the next
island between epochs. The solution is a list of slots; pieces take them by their rank
among the pieces of their length, which needs no global sort and no large task.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bin_genes import Bins, evolve, first_generation, fitness
from .byte_bpe import byte_bpe
from .shared import cut, id_and_text

ISLANDS, MEMBERS, EPOCHS, GENERATIONS, ELITES = 4, 4, 3, 4, 1
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, vocabulary: str, pattern: str, special: tuple[tuple[str, int], ...], end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of each document; ``place``: rank among the pieces of its length in its partition ``part``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_bpe(vocabulary, pattern, special), struct.pack("<I", end_id)
        part, seen, step = TaskContext.get().partitionId(), [0] * (capacity + 1), 4 * capacity
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for row, body in coder.encode(batch.column(1)):
                body += end
                cuts = [0, *range(len(body) % step or step, len(body) + 1, step)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    n = (b - a) // 4
                    out.append((ids[row], k, a // 4, n, zlib.crc32(body[a:b]), part, seen[n]))
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], [x.split()[0] for x in _PIECE.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(task, _PIECE)


def _written(bins: Bins) -> str:
    return json.dumps([[list(sizes), n] for sizes, n in bins.items()])


def _read(text: str) -> Bins:
    return {tuple(sizes): n for sizes, n in json.loads(text)}


def solve(spark, counts: dict[int, int], capacity: int) -> Bins:
    """The best packing of ``counts`` (size -> items) found by the islands."""
    if not counts:
        return {}

    def generation(epoch: int):
        def task(population: pd.DataFrame) -> pd.DataFrame:
            island = int(population["island"].iloc[0])
            seed = 1000 * epoch + island
            members = [_read(x) for x in population["bins"].sort_values() if x] or first_generation(counts, capacity, MEMBERS, seed)
            members = evolve(members, counts, capacity, GENERATIONS, seed)[:MEMBERS]
            fit = [fitness(b, capacity) for b in members]
            return pd.DataFrame({"island": island, "member": range(len(members)), "bins": [_written(b) for b in members], "used": [f[0] for f in fit], "shape": [f[1] for f in fit]})

        return task

    schema = "island long, member long, bins string, used long, shape double"
    population = spark.range(ISLANDS).select(F.col("id").alias("island"), F.lit("").alias("bins")).repartition(ISLANDS, "island")
    for epoch in range(EPOCHS):
        population = cut(population.groupBy("island").applyInPandas(generation(epoch), schema))
        movers = population.filter(F.col("member") < ELITES).withColumn("island", (F.col("island") + 1) % ISLANDS)
        best = population.orderBy("used", "shape", "island", "member").first()
        if best["used"] * capacity - sum(s * n for s, n in counts.items()) < capacity:
            break  # no packing has fewer bins
        population = population.unionByName(movers).select("island", "bins")
    return _read(best["bins"])


def pack(docs: DataFrame, vocabulary: str, pattern: str, special: tuple[tuple[str, int], ...] = (), end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece of every row of ``docs``.

    A null or empty text is one piece, the end id alone. Only a document of more than
    ``capacity`` tokens is cut; its first piece takes the remainder. Repeated rows and
    repeated or null ids are packed as rows of their own. An empty table gives an empty
    table; other columns are not read.
    """
    spark = docs.sparkSession
    cutup = cut(pieces(docs, vocabulary, pattern, special, end_id, capacity, id_col, text_col))
    sizes = cut(cutup.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows

    bins = solve(spark, {s: n for s, n in counts.items() if s < capacity}, capacity)
    if counts.get(capacity):
        bins[(capacity,)] = counts[capacity]
    slots: dict[int, list[list[int]]] = {s: [] for s in counts}
    taken, base = dict.fromkeys(counts, 0), 0
    for filled, n in sorted(bins.items(), reverse=True):
        at = 0
        for s in filled:
            slots[s].append([taken[s], base, at])
            taken[s] += n
            at += s
        base += n
    rows = [(s, *(list(x) for x in zip(*found, strict=True))) for s, found in slots.items()]
    lookup = F.broadcast(spark.createDataFrame(rows, "length long, froms array<long>, bases array<long>, offs array<long>"))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cutup.join(sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).join(lookup, "length")
    slot = ranked.withColumn("slot", F.size(F.filter("froms", lambda x: x <= F.col("rank"))))
    found = slot.select("doc_id", "piece", "start", "length", "ids_crc32", (F.element_at("bases", F.col("slot")) + F.col("rank") - F.element_at("froms", F.col("slot"))).alias("sequence_id"), F.element_at("offs", F.col("slot")).alias("offset"))
    return found
