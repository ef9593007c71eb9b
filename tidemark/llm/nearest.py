"""Approximate nearest neighbours by multiprobe p-stable hashing, exact reranking by cosine.

Unit vectors are hashed by ``TABLES`` tables of ``FUNCTIONS`` functions floor((a.v + b) / WIDTH) with Gaussian a,
so that Euclidean distance, and with it cosine, decides how far a neighbour's projections stray. A query visits
perturbed buckets of each table in the order of their estimated success: the probability that a neighbour at
the typical distance falls there, from the query's place in its slots. It stops when the visited buckets hold
``TARGET`` of that probability. The typical distance is fitted on a bounded sample (``SAMPLE`` vectors). A query
that has met fewer than k candidates by then goes on through all other buckets.

Every vector is indexed. Of equal vectors only the k + 1 smallest ids can be in any answer (ties go to smaller
ids), so only these enter the index: a group of copies costs a few rows. Buckets are dealt to shards, large ones in
parts. A shard has as many index rows as give each partition one, but no more than ``SHARD_BYTES`` of components, so
that a query's vector goes to few shards. A shard's task holds its index rows and streams through the queries that
probe them in blocks of ``BLOCK``; it emits each query's k best, with exact double-precision cosines, and a last
step merges tables and shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.memory import lean
from tidemark.session import materialize

TABLES, FUNCTIONS, WIDTH, TARGET, SEED = 2, 6, 2.5, 0.8, 7
SAMPLE, REACH, BLOCK = 2048, 2, 64
#: Index rows of a shard at least, and bytes of its vectors' components at most.
SHARD_ROWS, SHARD_BYTES = 2048, 32 << 20
_OFFSETS = np.array(list(product(range(-REACH, REACH + 1), repeat=FUNCTIONS)), dtype=np.int64)
_erf = np.vectorize(math.erf)


def _functions(dimension: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimension, table])
    return rng.standard_normal((dimension, FUNCTIONS)), rng.random(FUNCTIONS) * WIDTH


def _code(slots: np.ndarray, dimension: int, table: int) -> np.ndarray:
    """One number for the slots of a bucket."""
    out = np.full(slots.shape[:-1], dimension * 31 + table, dtype=np.uint64)
    for m in range(slots.shape[-1]):
        out = (out ^ (slots[..., m].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def buckets(vectors: np.ndarray, table: int) -> np.ndarray:
    a, b = _functions(vectors.shape[1], table)
    return _code(np.floor((_units(vectors) @ a + b) / WIDTH).astype(np.int64), vectors.shape[1], table)


def probes(vector: np.ndarray, table: int, spread: float, target: float = TARGET) -> np.ndarray:
    """Buckets in the order of estimated success until they hold ``target`` of it."""
    a, b = _functions(len(vector), table)
    x = (_units(vector[None])[0] @ a + b) / WIDTH
    slots = np.floor(x)
    low = (np.arange(-REACH, REACH + 1)[:, None] - (x - slots)) * WIDTH / spread
    chance = 0.5 * (_erf((low + WIDTH / spread) / math.sqrt(2)) - _erf(low / math.sqrt(2)))
    success = np.ones(len(_OFFSETS))
    for m in range(FUNCTIONS):
        success *= chance[_OFFSETS[:, m] + REACH, m]
    order = np.argsort(-success, kind="stable")
    n = int(np.searchsorted(np.cumsum(success[order]), target)) + 1
    return _code(slots.astype(np.int64) + _OFFSETS[order[:n]], len(vector), table)


def clean(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)`` of the vectors that take part; of rows that repeat a vec_id the smallest vector."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where((F.size("v") > 0) & ~bad).where(F.exists("v", lambda x: x != 0.0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _spreads(vectors: DataFrame, k: int) -> dict[int, float]:
    """By number of components: distance within which nine tenths of a bounded sample have k neighbours in the sample; 0 stands for the rest."""
    by: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        by.setdefault(len(r.v), []).append(r.v)
    out = {0: 1.0}
    for size, own in sorted(by.items(), key=lambda x: len(x[1])):  # the commonest last
        if len(own) < 2:
            continue
        unit = _units(np.array(own))
        near = unit[:256] @ unit.T
        near[np.arange(len(near)), np.arange(len(near))] = -1
        kth = np.sort(near, axis=1)[:, -min(k, len(own) - 1)]
        out[size] = out[0] = float(np.quantile(np.sqrt(np.maximum(2 - 2 * kth, 0)), 0.9)) or 1e-3
    return out


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``queries(vec_id, embedding)`` against all rows of ``embeddings(vec_id, embedding)``: query_id, rank, vec_id, score.

    A query's own vec_id is no candidate. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, on either side; vectors of other lengths are never neighbours. Ties go to smaller
    ids. A query has fewer than k rows only if it has fewer candidates. Other columns are not read.
    """
    partitions = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors, _ = materialize(clean(embeddings), "vectors")
    asked, _ = materialize(clean(queries), "queries")
    spreads = _spreads(vectors, k)
    few = vectors.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1)

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for _, own in pdf.groupby(pdf["v"].str.len()):
                x = np.stack(own["v"].to_numpy())
                for t in range(TABLES):
                    yield pd.DataFrame({"bucket": buckets(x, t), "vec_id": own["vec_id"].to_numpy(), "v": own["v"].to_numpy()})

    def probing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for query_id, v in zip(pdf["vec_id"], pdf["v"]):
                found = np.unique(np.concatenate([probes(np.asarray(v), t, spreads.get(len(v), spreads[0])) for t in range(TABLES)]))
                yield pd.DataFrame({"bucket": found, "query_id": query_id})

    index, _ = materialize(few.select("vec_id", "v").mapInPandas(lean(placed), "bucket long, vec_id long, v array<double>"), "index")
    total = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    most = max(1, SHARD_BYTES // (8 * (total["size"] or 1)))
    rows = max(1, min(max(SHARD_ROWS, total.n // partitions), most))  # of a shard
    shards = max(1, -(-total.n // rows))
    sizes = index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    sizes, _ = materialize(sizes, "buckets")
    shard_of = F.pmod(F.xxhash64("bucket", "part"), F.lit(shards)).cast("int").alias("shard")

    split = index.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    held, _ = materialize(split.select(shard_of, F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.array("bucket").alias("buckets")), "shards")

    def rerank(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, own_rows, shard_index = None, [], None
        for pdf in parts:
            for (number, kind), own in pdf.groupby(["shard", "kind"], sort=True):
                if number != shard:
                    shard, own_rows, shard_index = number, [], None
                if kind == 0:
                    own_rows.append(own)
                    continue
                if shard_index is None and own_rows:
                    shard_index = _index(pd.concat(own_rows, ignore_index=True))
                    own_rows = []
                if shard_index:
                    for at in range(0, len(own), BLOCK):
                        yield from _best(own.iloc[at : at + BLOCK], shard_index, k)

    def answered(asks: DataFrame) -> DataFrame:
        """k best ids of each query over the shards and buckets it visits; null buckets are all."""
        both = held.unionByName(asks).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
        return both.mapInPandas(lean(rerank), "query_id long, vec_id long, score double")

    visits = asked.select("vec_id", "v").repartition(partitions).mapInPandas(lean(probing), "bucket long, query_id long").join(sizes, "bucket")
    visits = visits.select("query_id", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(shard_of, "query_id", "bucket")
    visits = visits.groupBy("shard", "query_id").agg(F.collect_set("bucket").alias("buckets"))
    asks = visits.join(asked, F.col("query_id") == F.col("vec_id")).select("shard", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v", "buckets")
    found, _ = materialize(answered(asks), "found")

    full = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short, _ = materialize(asked.join(full, F.col("query_id") == F.col("vec_id"), "left_anti"), "short")
    if not short.isEmpty():  # through all shards, whatever the bucket
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("array<long>").alias("buckets"))
        found = found.union(answered(every))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _index(rows: pd.DataFrame) -> dict[int, tuple]:
    """By number of components: ids, vectors, unit vectors, the place of each row's bucket, and the buckets."""
    out, size = {}, rows["v"].str.len()
    for n in sorted(set(size.tolist())):
        own = rows[size == n]
        names, place = np.unique(own["buckets"].str[0].to_numpy(dtype=np.int64), return_inverse=True)
        x = np.stack(own["v"].to_numpy())
        out[n] = own["id"].to_numpy(dtype=np.int64), x, _units(x), place, names
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, the same for a pair wherever it is computed."""
    with np.errstate(all="ignore"):
        plain = (q * x).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1)))
    if np.isfinite(plain).all():
        return plain
    return (_units(q[None])[0] * _units(x)).sum(-1)  # squares out of range


def _best(asks: pd.DataFrame, index: dict[int, tuple], k: int) -> Iterator[pd.DataFrame]:
    """The k best of a shard for each query of a block: one product for all, of which a query sees the buckets it visits."""
    out: list[tuple[int, int, float]] = []
    size = asks["v"].str.len()
    for n in sorted(set(size.tolist()) & set(index)):
        own, (ids, x, unit, place, names) = asks[size == n], index[n]
        q = np.stack(own["v"].to_numpy()).astype(np.float64)
        near = _units(q) @ unit.T
        for row, query_id, v, seen in zip(near, own["id"], q, own["buckets"]):
            visited = np.ones(len(names), dtype=bool) if seen is None else np.isin(names, seen)
            row[~visited[place] | (ids == query_id)] = -np.inf
            most = TABLES * k  # an id is in each table once
            limit = np.partition(row, -most)[-most] - 1e-9 if len(row) > most else -2.0
            chosen = np.flatnonzero(row >= max(limit, -2.0))
            if not len(chosen):
                continue
            best, first = np.unique(ids[chosen], return_index=True)
            score = _exact(v, x[chosen][first])
            order = np.lexsort((best, -score))[:k]
            out += [(query_id, int(best[i]), float(score[i])) for i in order]
    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


#: The registered query searches for every vector whose id is divisible by this.
EVERY = 50


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    """Whole table ``embeddings``, queries with vec_id divisible by 50, 5 neighbours each."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.where(F.col("vec_id") % EVERY == 0))
