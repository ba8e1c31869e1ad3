"""Approximate nearest neighbours by balanced posting lists (operator 5).

Equal vectors are one class, so a vector that a third of all rows hold is searched once.
Centroids come from balanced splits of a bounded sample. A vector goes to the list of its
nearest centroid and, near a boundary, to others as well; long lists are dealt out in
blocks. A query walks an in-memory graph over the centroids and keeps those within a
distance ratio of the nearest, a ratio fitted so that the sample's own recall is reached,
both by rows that the centroids were made of and by rows that they were not. Replicas are
made only where they save a query more than they add to its lists.
The nearest list is searched first; the others return only what beats its worst keeper.

Largest inner product becomes least distance by one more component that makes all
stored vectors equally long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: At most this many sampled rows fit the index; every row is indexed.
SAMPLE_ROWS = 20_000
ROWS_A_LIST, LEAST_LISTS, MOST_LISTS = 800, 16, 8192
BLOCK_ROWS, QUERY_BLOCK_ROWS = 8192, 4096
BOUNDARY, MOST_REPLICAS, DEGREE = 1.06, 4, 16
WANTED_RECALL = 0.97


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _nearest(x: np.ndarray, y: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest rows of ``y`` for each row of ``x``, nearest first, in blocks of bounded memory."""
    out, block = [], max(1, (1 << 22) // len(y))
    for at in range(0, len(x), block):
        away = _distances(x[at : at + block], y)
        part = np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(y) else np.tile(np.arange(len(y)), (len(away), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(away, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of about equally large parts of ``sample``: the largest part is halved along its main direction again and again."""
    dice = np.random.default_rng(seed)
    queue = [(-len(sample), 0, np.arange(len(sample)))]
    n = 1
    while len(queue) < lists and -queue[0][0] > 1:
        _, _, rows = heapq.heappop(queue)
        part = sample[rows] - sample[rows].mean(0)
        axis = dice.normal(size=sample.shape[1])
        for _ in range(6):
            axis = part.T @ (part @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = np.argsort(part @ axis, kind="stable")
        for half in (rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]):
            heapq.heappush(queue, (-len(half), n, half))
            n += 1
    centroids = np.array([sample[rows].mean(0) for _, _, rows in queue])
    for _ in range(4):  # a few Lloyd steps, kept balanced by the block split
        near = _nearest(sample, centroids)[:, 0]
        for j in range(len(centroids)):
            if (near == j).any():
                centroids[j] = sample[near == j].mean(0)
    return centroids


def neighbour_graph(centroids: np.ndarray, degree: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(neighbours of each centroid, a first node of each part): the ``degree`` nearest, both ways, all parts joined.

    Nearest-neighbour edges alone leave far groups apart; each part is joined to what lies
    nearest outside, and a walk starts in all of them.
    """
    n = len(centroids)
    near = _nearest(centroids, centroids, min(degree + 1, n))
    edges = {(i, int(j)) for i, row in enumerate(near) for j in row if i != j}
    edges |= {(j, i) for i, j in edges}
    part, starts = np.full(n, -1), []
    ahead: list[list[int]] = [[] for _ in range(n)]
    for i, j in sorted(edges):
        ahead[i].append(j)
    for i in range(n):
        if part[i] < 0:
            starts.append(i)
            part[i], todo = len(starts) - 1, [i]
            while todo:
                for j in ahead[todo.pop()]:
                    if part[j] < 0:
                        part[j] = part[i]
                        todo.append(j)
    for k in range(1, len(starts)):
        own, other = np.flatnonzero(part == k), np.flatnonzero(part < k)  # the parts before are joined already
        away = _distances(centroids[[starts[k]]], centroids[other])[0]
        j = int(other[away.argmin()])
        i = int(own[_distances(centroids[[j]], centroids[own])[0].argmin()])
        ahead[i].append(j)
        ahead[j].append(i)
    return [np.array(x, dtype=np.int64) for x in ahead], np.array(starts)


@dataclass
class Index:
    """Centroids, a neighbour graph over them, where its walks start, and the distance ratio that selects lists."""

    centroids: np.ndarray
    graph: list[np.ndarray]
    starts: np.ndarray
    longest: float
    ratio: float = 1.0
    boundary: float = BOUNDARY
    scanned: float = 1.0

    @classmethod
    def fit(cls, sample: np.ndarray, longest: float, lists: int, wanted: int) -> Index:
        """Of the sample, every so many-th row, 300 in all, only asks; centroids come from the others, of which as many ask too.

        A query may be either kind. With and without replicas, the ratio must reach the wanted
        recall for both; the cheaper of the two indexes is kept, so a query reads no more rows
        than there are. ``scanned``: share of the rows, replicas counted, that one reads.
        """
        stored = lift(sample, longest)
        step = max(2, len(sample) // 300)
        asking = np.zeros(len(sample), dtype=bool)
        asking[::step] = True
        centroids = balanced_centroids(stored[~asking] if (~asking).any() else stored, min(lists, len(stored)))
        graph, starts = neighbour_graph(centroids, DEGREE)
        seeds = np.unique(np.append(starts, np.linspace(0, len(centroids) - 1, 4).astype(int)))
        asked = [rows for rows in (np.flatnonzero(asking), np.arange(1, len(sample), step)) if len(rows)]
        tried = []
        for boundary in (BOUNDARY, 1.0):
            index = cls(centroids, graph, seeds, longest, boundary=boundary)
            homes = [set(h) for h in index.homes(stored)]
            index.ratio = max(index._calibrated(sample, homes, rows, wanted) for rows in asked)
            sizes = np.bincount([j for h in homes for j in h], minlength=len(centroids))
            index.scanned = float(np.mean([sizes[index.lists(q)].sum() for rows in asked for q in lift(sample[rows], None)])) / len(sample)
            tried.append(index)
        return min(tried, key=lambda index: index.scanned)

    def _calibrated(self, sample: np.ndarray, homes: list[set[int]], asked: np.ndarray, wanted: int) -> float:
        """The least ratio at which walks of the asking rows find the lists of WANTED_RECALL of their nearest sampled rows."""
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        k = min(wanted, len(sample) - 1)
        if k < 1:
            return 2.0
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        queries = lift(sample[asked], None)
        away = _distances(queries, self.centroids)
        away /= np.maximum(away.min(1, keepdims=True), 1e-12)
        need = np.sort([min(away[i, j] for j in homes[row]) for i, rows in enumerate(best) for row in rows])
        self.ratio = float(need[min(len(need) - 1, int(WANTED_RECALL * len(need)))]) + 1e-9
        for _ in range(40):  # what the walk itself misses
            hits = sum(bool(homes[row] & set(lists)) for lists, rows in zip(map(self.lists, queries), best, strict=True) for row in rows)
            if hits >= WANTED_RECALL * best.size:
                break
            self.ratio *= 1.03
        return self.ratio

    def homes(self, stored: np.ndarray) -> list[list[int]]:
        """The lists of each vector: its nearest, and close others that no chosen one lies before."""
        out = []
        for at in range(0, len(stored), 4096):
            away = _distances(stored[at : at + 4096], self.centroids)
            order = np.argsort(away, axis=1, kind="stable")[:, : 2 * MOST_REPLICAS]
            for i, row in enumerate(order):
                chosen = [int(row[0])]
                for j in row[1:]:
                    if away[i, j] > self.boundary * away[i, row[0]] or len(chosen) == MOST_REPLICAS or self.boundary <= 1:
                        break
                    if all(np.linalg.norm(self.centroids[j] - self.centroids[c]) >= away[i, j] * 0.5 for c in chosen):
                        chosen.append(int(j))
                out.append(chosen)
        return out

    def lists(self, query: np.ndarray) -> list[int]:
        """The lists within the ratio of the nearest, nearest first, by best-first search over the graph."""
        away = lambda js: np.linalg.norm(self.centroids[js] - query, axis=1)
        seeds = self.starts
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[seeds] = True
        queue = list(zip(away(seeds).tolist(), seeds.tolist(), strict=True))
        heapq.heapify(queue)
        found: list[tuple[float, int]] = []
        best, late = np.inf, 0
        while queue and late < 2 * DEGREE:
            d, j = heapq.heappop(queue)
            found.append((d, j))
            best = min(best, d)
            late = late + 1 if d > self.ratio * best else 0
            new = self.graph[j][~seen[self.graph[j]]]
            if len(new):
                seen[new] = True
                for pair in zip(away(new).tolist(), new.tolist(), strict=True):
                    heapq.heappush(queue, pair)
        found.sort()
        return [j for d, j in found if d <= self.ratio * found[0][0]]


def lift(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """Stored vectors with a component that makes all ``longest`` long; queries (None) with a zero."""
    more = np.zeros(len(vectors)) if longest is None else np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(1), 0))
    return np.column_stack([vectors, more])


def _search(keep: int, width: int):
    schema = pa.schema([("query", pa.int64()), ("root", pa.int64()), ("score", pa.float64())])

    def block(queries: pa.Table, stored: pa.Table) -> pa.Table:
        if not len(queries) or not len(stored):
            return schema.empty_table()
        take = lambda t, c: t.column(c).combine_chunks()
        roots, q = take(stored, "root").to_numpy(), take(queries, "query").to_numpy()
        x, y, floor = _matrix(take(stored, "v"), width), _matrix(take(queries, "v"), width), take(queries, "floor").to_numpy()
        order = np.argsort(roots)  # equal scores: the smaller root first
        roots, x = roots[order], x[order]
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q), 256):
            scores = y[at : at + 256] @ x.T
            if len(roots) > keep:
                edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
            else:
                edge = np.full(len(scores), -np.inf)
            i, j = np.nonzero(scores >= np.maximum(edge, floor[at : at + 256])[:, None])
            out.append((q[at + i], roots[j], scores[i, j]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return block


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` found of largest inner product with each query.

    ``queries`` holds rows of ``vectors``; a row is never its own neighbour. All candidates,
    if there are fewer than ``k``. Ties go to the smaller id. Vectors that are null, zero,
    of another length than the commonest, or hold null or non-finite components take no
    part, nor do null ids; repeated (id, vector) rows count once. An empty table gives an
    empty table; other columns are not read.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.filter(F.col("vec_id").isNotNull() & good)

    rows = valid(vectors)
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = width["width"]
    rows = rows.filter(F.size("v") == width).dropDuplicates(["vec_id", "v"])
    kept = k + 1  # the query itself may be among them
    first = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= kept)
    classes = cut(members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("root", F.element_at("ids", 1)))
    total, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()

    share = min(1.0, SAMPLE_ROWS / total)
    picked = classes.filter(F.pmod(F.xxhash64("root"), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(SAMPLE_ROWS).toArrow()
    sample = _matrix(picked.column("v").combine_chunks(), width) if len(picked) else _matrix(classes.select("v").limit(1).toArrow().column("v").combine_chunks(), width)
    index = Index.fit(sample, longest, int(np.clip(total // ROWS_A_LIST, LEAST_LISTS, MOST_LISTS)), k)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = shared.value.homes(lift(_matrix(batch.column(1), width), shared.value.longest))
            at = np.repeat(np.arange(len(homes)), [len(h) for h in homes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes).astype(np.int64)) if homes else pa.array([], pa.int64()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["list", "root", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [shared.value.lists(x) for x in lift(_matrix(batch.column(1), width), None)]
            at = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            flat = np.concatenate(chosen).astype(np.int64) if chosen else np.zeros(0, np.int64)
            lead = np.concatenate([[True] + [False] * (len(c) - 1) for c in chosen]) if chosen else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(lead, pa.bool_()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["list", "lead", "query", "v"])

    posted = cut(classes.select("root", "v").mapInArrow(place, "list long, root long, v array<double>"))
    asked = cut(valid(queries).filter(F.size("v") == width).select(F.col("vec_id").alias("query_id"), "v").distinct().join(classes.select("v", "root"), "v").select("query_id", F.col("root").alias("query"), "v"))
    probes = cut(asked.select("query", "v").dropDuplicates(["query"]).mapInArrow(probe, "list long, lead boolean, query long, v array<double>"))
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("vs"))  # at most MOST_LISTS rows
    groups = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK_ROWS).cast("int").alias("qs"))
    dealt = F.broadcast(blocks.join(groups, "list"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = posted.join(dealt, "list").withColumn("vb", F.pmod(F.xxhash64("root"), "vs").cast("int")).withColumn("qb", spread("qs")).select("list", "vb", "qb", "root", "v")

    def searched(probing: DataFrame) -> DataFrame:
        wanted = probing.join(dealt, "list").withColumn("qb", F.pmod(F.xxhash64("query"), "qs").cast("int")).withColumn("vb", spread("vs")).select("list", "vb", "qb", "query", "v", "floor")
        keys = ["list", "vb", "qb"]
        return wanted.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_search(kept, width), "query long, root long, score double")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "root")
    best = lambda df: df.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= kept)
    near = cut(best(searched(probes.filter("lead").withColumn("floor", F.lit(float("-inf"))))))
    floors = near.filter(F.col("n") == kept).select("query", F.col("score").alias("floor"))
    rest = probes.filter("not lead").join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    top = best(near.select("query", "root", "score").unionByName(searched(rest)).groupBy("query", "root").agg(F.max("score").alias("score")))

    ids = top.join(classes.select("root", "ids"), "root").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= kept)
    found = asked.select("query_id", "query").join(ids, "query").filter("query_id != vec_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
