"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees the pivots, nearest first. It is posted in the inverted file of
its nearest pivot; a query reads the files of the pivots nearest to it, until they hold ``cover`` of all vectors. In a
file the vectors are ranked by the footrule distance of their pivot orders to the query's (places
beyond ``depth`` count as ``depth``), and the best ``share`` of them is reranked by the exact Euclidean distance
of the original vectors. Files are put together into shards of at most about ``BLOCK`` vectors, larger ones are dealt over
several; a query goes once to each shard that holds a file it reads, and the entries of one shard are all that a task holds. Pivots are a bounded sample (``pivots``), chosen by a hash; all vectors are indexed.

Equal vectors are indexed once, with their ``k + 1`` smallest ids, which is all that k results can need; so a vector that
fills a third of the table is one entry.

The defaults suit vectors without any clusters, where neighbours are hardly nearer than others and an index has to
read much (recall 0.95 on uniform vectors of 64 dimensions); clustered vectors allow smaller ``cover`` and ``share``.

Nulls and odd inputs: rows without an id, and vectors that are null, empty, zero, or hold null or non-finite
components, take no part; nor do those of another length than most (the longer on a tie). A row that repeats an id and
vector counts once; an id with several vectors takes part with each. Ties go to the smaller id. Fewer candidates than
k: all are returned. Columns beyond id and vector are not read. No rows: no results.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import scan
from tidemark.session import stage

PIVOTS, BLOCK = 256, 4_096
#: A query reads at least so many vectors, and reranks at least so many of a shard.
READ, RERANK = 4_096, 64


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _far(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * vectors @ pivots.T


def _orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argsort(_far(vectors, pivots), axis=1, kind="stable")


def _places(orders: np.ndarray, depth: int) -> np.ndarray:
    """The place of each pivot in each order, at most ``depth``."""
    out = np.empty(orders.shape, np.int16)
    np.put_along_axis(out, orders, np.broadcast_to(np.arange(orders.shape[1], dtype=np.int16), orders.shape), 1)
    return np.minimum(out, depth, out=out)


def _shards(held: list[int]) -> tuple[list[int], list[int]]:
    """Of each file its first shard and the number of its shards. Files in a row share a shard of at most BLOCK
    vectors, so a query goes there once; a larger file is dealt over shards of its own."""
    first, blocks, now, filled = [], [], -1, BLOCK + 1
    for n in held:
        if n > BLOCK or filled + n > BLOCK:
            now, filled = now + 1, 0
        first.append(now)
        blocks.append(max(1, math.ceil(n / BLOCK)))
        now, filled = now + blocks[-1] - 1, BLOCK + 1 if n > BLOCK else filled + n
    return first, blocks


#: Stands for a file in the rows of queries, which thus follow all entries of their shard.
_ASKS = 1 << 30


def _shard_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], Iterator[list[tuple]]]]:
    """Of each shard its entries (cell, k1, k2, v) and, in pieces, its queries: only the entries are held together."""
    def lines() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, group in itertools.groupby(lines(), key=lambda r: r[0]):
        kinds = itertools.groupby(group, key=lambda r: r[1] == _ASKS)
        asks, rows = next(kinds)
        if asks:  # no entry here
            continue
        own = [r[1:] for r in rows]
        _, asking = next(kinds, (True, iter(())))
        yield own, iter(lambda asking=asking: [r[1:] for r in itertools.islice(asking, 256)], [])


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
            pivots: int = PIVOTS, depth: int = 128, cover: float = 0.7, share: float = 0.15) -> DataFrame:
    """For each row that ``queries`` (a condition on the id column) holds for, its ``k`` nearest other rows:
    query_id, rank, vec_id, score (Euclidean distance)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = (vectors.select(F.col(id_col).alias(id_col), F.col(vector_col).alias("_v"), queries.alias("_q"))
            .filter(F.col(id_col).isNotNull() & _usable(F.col("_v"))))
    common = rows.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("_v") == (common["size"] if common else 0))

    # Vectors travel in the width they have; distances are taken in double precision.
    width = np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64

    def floats(column: list) -> np.ndarray:
        return np.stack([np.frombuffer(v, width) for v in column]).astype(np.float64)

    def raw(ids: list, own: list, values: list) -> dict[str, list]:
        return {"id": ids, "asks": own, "v": [np.array(v, width).tobytes() for v in values]}

    rows = scan(rows.select(id_col, F.coalesce("_q", F.lit(False)), "_v"), raw, f"id {kind}, asks boolean, v binary", 4096)
    rows = stage(rows.select("id", "asks", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), "vectors")

    # The k + 1 smallest ids of each different vector, each counted once; Spark limits each task's groups before the shuffle.
    by_id = Window.partitionBy("k1", "k2").orderBy("id")
    low = (rows.select("k1", "k2", "id").distinct().withColumn("nth", F.row_number().over(by_id)).filter(f"nth <= {k + 1}")
           .groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    one = rows.groupBy("k1", "k2").agg(F.max("asks").alias("asks"), F.first("v").alias("v"))
    index = stage(one.join(low, ["k1", "k2"]), "vector-index")
    total = index.count()
    many = max(1, min(pivots, total // 64))
    place = F.pmod(F.xxhash64("k1", F.lit(7)), F.lit(1 << 30))
    sample = (index.filter(place * float(total) < 4.0 * many * (1 << 30)).orderBy(place, "k1", "k2").limit(many)
              .select("v").collect()) if total else []
    if not sample:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    centres = floats([bytes(r["v"]) for r in sample])

    def nearest_pivot(k1: list, k2: list, asks: list, v: list) -> dict[str, list]:
        cells = _far(floats(v), centres).argmin(1) if v else np.zeros(0, int)
        return {"k1": k1, "k2": k2, "asks": asks, "v": v, "cell": cells.tolist()}

    posted = stage(scan(index.select("k1", "k2", "asks", "v"), nearest_pivot,
                        "k1 long, k2 long, asks boolean, v binary, cell int", 4096), "postings")
    held = [0] * len(centres)
    for r in posted.groupBy("cell").count().collect():  # one row per pivot
        held[r["cell"]] = r["count"]
    first, blocks = _shards(held)
    sizes = np.array(held)

    def files(orders: np.ndarray) -> list[np.ndarray]:
        """Of each vector the files it reads, nearest first, until they hold ``cover`` of all."""
        goal = min(total, max(cover * total, READ))
        return [o[:1 + int(np.searchsorted(np.cumsum(sizes[o]), goal))] for o in orders]

    def probe(k1: list, k2: list, v: list) -> dict[str, list]:
        out: dict[str, list] = {"shard": [], "k1": [], "k2": [], "v": []}
        data = floats(v) if v else np.zeros((0, centres.shape[1]))
        for a, b, raw_v, read in zip(k1, k2, v, files(_orders(data, centres)), strict=True):
            for shard in sorted({first[c] + i for c in read.tolist() for i in range(blocks[c])}):
                for name, value in (("shard", shard), ("k1", a), ("k2", b), ("v", raw_v)):
                    out[name].append(value)
        return out

    of_cell = [F.element_at(F.array(*map(F.lit, x)), F.col("cell") + 1) for x in (first, blocks)]
    shard = of_cell[0] + F.pmod(F.xxhash64("k1", F.lit(11)), of_cell[1])
    columns = ["shard", "cell", "k1", "k2", "v"]
    entries = posted.withColumn("shard", shard.cast("int")).select(columns)
    asked = scan(posted.filter("asks").select("k1", "k2", "v"), probe, "shard int, k1 long, k2 long, v binary")
    asked = asked.withColumn("cell", F.lit(_ASKS)).select(columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("q1", "q2", "k1", "k2", "score")
        for own, asking in _shard_groups(batches):
            data, keys = floats([r[3] for r in own]), [(r[1], r[2]) for r in own]
            theirs, cells = _places(_orders(data, centres), depth), np.array([r[0] for r in own])
            room = np.empty(theirs.shape, np.int16)
            for part in asking:
                wanted = floats([r[3] for r in part])
                orders = _orders(wanted, centres)
                out: list[tuple] = []
                for (_, a, b, _), v, mine, read in zip(part, wanted, _places(orders, depth), files(orders), strict=True):
                    reads = np.zeros(len(sizes), bool)
                    reads[read] = True
                    near = np.flatnonzero(reads[cells])
                    keep = max(k + 1, RERANK, math.ceil(share * len(near)))
                    if len(near) > keep:
                        apart = np.subtract(theirs, mine, out=room)
                        footrule = np.add.reduce(np.abs(apart, out=apart), axis=1, dtype=np.int32)
                        near = near[np.argpartition(footrule[near], keep - 1)[:keep]]
                    score = np.sqrt(((data[near] - v) ** 2).sum(1))
                    cut = np.partition(score, k)[k] if len(score) > k else np.inf
                    out += [(a, b, *keys[i], float(s)) for i, s in zip(near, score, strict=True) if s <= cut]
                if out:
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.float64() if n == "score" else pa.int64())
                                                      for n, c in zip(names, zip(*out, strict=True), strict=True)})

    met = (entries.union(asked).repartition("shard").sortWithinPartitions("shard", "cell")
           .mapInArrow(search, "q1 long, q2 long, k1 long, k2 long, score double"))
    # k + 1 different vectors, all that tie with the last: the query's own vector may be one of them.
    by_score = Window.partitionBy("q1", "q2").orderBy("score")
    found = stage(met.withColumn("nth", F.rank().over(by_score)).filter(f"nth <= {k + 1}").drop("nth"), "vector-found")
    ids = index.select("k1", "k2", F.explode("ids").alias("vec_id"))
    asks = rows.filter("asks").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("query_id")).distinct()
    # Of the ids of each query vector the k + 1 best serve every query row that has this vector.
    best = (found.join(ids, ["k1", "k2"]).withColumn("nth", F.row_number().over(
        Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))).filter(f"nth <= {k + 1}"))
    best = best.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asks.join(best, ["q1", "q2"]).select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"))


def exact(query: list[float], ids: list[int], vectors: list[list[float]], k: int = 10) -> list[tuple[float, int]]:
    """Brute force for tests: the ``k`` smallest (distance, id)."""
    return heapq.nsmallest(k, ((math.dist(query, v), i) for i, v in zip(ids, vectors, strict=True)))
