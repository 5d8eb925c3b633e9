"""Exact top-k by inner product with MaxScore over shards.

A vector is a set of postings, one for each component; a query's terms are its
components. Within a shard each component's values lie between a least and a
greatest, so a term adds between two bounds to any score. Written as the least
possible score plus what each term adds above its least, all parts are
non-negative and have an upper bound, and MaxScore applies: terms are ordered
by bound; those whose bounds together cannot lift a vector over the query's
threshold, the k-th best score so far, are non-essential. Essential postings
are traversed for the whole shard at once; the others are probed one by one,
largest bound first, and only for vectors whose score so far plus the bounds
that are left still competes. Ties go to the smaller id, so a vector competes
as long as it can reach the threshold.

Vectors are packed into shards of `SHARD` rows, queries into blocks of `BLOCK`.
Shards and blocks span a table that is cut into tiles of up to `TILE_SHARDS`
by `TILE_BLOCKS`, so a shard is sent once for each column of tiles and a block
once for each row of them. A task holds a tile's queries and lets its shards
pass by; thresholds go from shard to shard. It gives k rows a query, and the k
best of all tiles are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.common import columns, lean, stored, table

K = 5
SHARD = 8192
BLOCK = 512
SCALE = 256.0
#: A tile at most: 65,536 queries, which a task holds, and 524,288 vectors, which it doesn't.
TILE_SHARDS, TILE_BLOCKS = 64, 128
#: Within a shard, vectors are visited in portions, so that thresholds rise early.
PORTION = 1024
#: Scores below this are exact in floating point.
EXACT = 1 << 52


class Shard:
    """Vectors (rows of integers) with ids, ordered by id, and the bounds of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        wide = self.rows.shape[1] * float(np.abs(self.rows).max(initial=0)) ** 2
        self.small = wide < EXACT
        self.low, self.high = self.rows.min(axis=0), self.rows.max(axis=0)
        self.work = self.rows.astype(np.float64) if self.small else self.rows

    def top(self, query: np.ndarray, own_id: int, k: int, best: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """The k best (score, id) of these vectors, but for the query's own id, and of `best`, by MaxScore."""
        small = self.small and len(query) * float(np.abs(query).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) < EXACT
        kind = np.float64 if small else object
        q = query.astype(kind)
        work = self.work if small else self.rows.astype(object)
        one, two = q * self.low.astype(kind), q * self.high.astype(kind)
        least, bound = np.minimum(one, two), np.abs(two - one)
        order = np.argsort(-bound.astype(np.float64), kind="stable")  # largest bound first
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, kind)])  # bounds from each place on
        base = least.sum()
        best = list(best)
        for begin in range(0, len(self.ids), PORTION):
            part = work[begin : begin + PORTION]
            ids = self.ids[begin : begin + PORTION]
            threshold = best[-1][0] if len(best) == k else None
            # terms behind `cut` are non-essential: all together they can't reach the threshold
            cut = len(order) if threshold is None else int(np.searchsorted(-(base + rest[:-1]).astype(np.float64), -float(threshold), side="right"))
            head = order[:cut]
            score = part[:, head] @ q[head] + (base - least[head].sum())
            alive = np.arange(len(ids)) if threshold is None else np.flatnonzero(score + rest[cut] >= threshold)
            score = score[alive]
            for place in range(cut, len(order)):
                if not len(alive):
                    break
                term = order[place]
                score = score + part[alive, term] * q[term] - least[term]
                keep = score + rest[place + 1] >= threshold
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            own = ids[alive] != own_id
            alive, score = alive[own], score[own]
            if len(alive) > 4 * k:
                kth = np.partition(score, len(score) - k)[len(score) - k] if small else sorted(score)[len(score) - k]
                keep = score >= kth
                alive, score = alive[keep], score[keep]
            best = sorted([*best, *((int(s), int(i)) for s, i in zip(score, ids[alive], strict=True))], key=lambda x: (-x[0], x[1]))[:k]
        return best


def quantised(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, values): floor(256 x) of each component, of usable vectors only."""
    v = F.col(vector)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("values")
    )


def _packed(rows: DataFrame, group: str, wide: int) -> DataFrame:
    """One row for each group: ids and values of its vectors, little-endian, values in as few bytes as hold them; short vectors are filled with zeros."""
    filled = F.concat("values", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("values")))
    rows = rows.select(group, "vec_id", filled.alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, values = None, [], []

        def packed() -> pa.RecordBatch:
            data = np.concatenate(values)
            small = max(-int(data.min()) - 1, int(data.max())) < 1 << 15
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([data.astype("<i2" if small else "<i8").tobytes()], pa.binary())], names=[group, "ids", "data"])

        for batch in batches:
            groups = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            own = np.asarray(batch.column(1))
            flat = np.asarray(batch.column(2).flatten())
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if at is not None and groups[a] != at:
                    yield packed()
                    ids, values = [], []
                at = int(groups[a])
                ids.append(own[a:b])
                values.append(flat[a * wide : b * wide])
        if at is not None:
            yield packed()

    return rows.mapInArrow(lean(run, "topk"), f"{group} bigint, ids binary, data binary")


def _vectors(ids: bytes, data: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(data, "<i2" if len(data) == 2 * len(names) * wide else "<i8").astype(np.int64).reshape(-1, wide)


def _tiles(shards: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of tiles: as few as tile sizes allow, and `tasks` together where there is so much to deal out."""
    rows, cols = -(-shards // TILE_SHARDS), -(-blocks // TILE_BLOCKS)
    rows = min(shards, max(rows, -(-tasks // cols)))
    return rows, min(blocks, max(cols, -(-tasks // rows)))


def search(vectors: DataFrame, vector: str = "embedding", every: int = 50, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each query's k best other vectors: query_id, rank, vec_id, score.

    Vectors are rows (vec_id, `vector`); queries are those whose vec_id is
    divisible by `every`. Vectors that are null or hold a null or a non-finite
    component, and rows with a null id, take no part. Where lengths differ,
    missing components count as zero. Rows that repeat an id are candidates
    like any other, and queries like any other once for each different vector;
    a query is never its own candidate, nor is another row of its id. An empty
    table, or one without queries, gives an empty result. Components whose
    floor(256 x) is beyond a long become the nearest long, and scores beyond
    one fail the query instead of turning round.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(columns(vectors, "vec_id", vector), vector), "vectors")
    is_query = F.col("vec_id") % every == 0
    count, wide, asked = rows.agg(F.count("*"), F.max(F.size("values")), F.count_if(is_query)).first()
    if not count or not wide or not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shards, blocks = -(-count // shard), -(-asked // block)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tile_rows, tile_cols = _tiles(shards, blocks, tasks)
    spread = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "vec_id", "values")
    candidates = _packed(spread.repartition(min(shards, max(tasks, shards // 64)), "shard").sortWithinPartitions("shard"), "shard", wide)
    queries = rows.where(is_query).distinct().select(F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)).alias("block"), "vec_id", "values")
    packed = _packed(queries.repartition(min(blocks, tasks), "block").sortWithinPartitions("block"), "block", wide)

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # queries come before the shards of their tile
    tile = (F.col("row") * tile_cols + F.col("col")).cast("int").alias("tile")
    of_queries = packed.select(copies(tile_rows).alias("row"), F.pmod("block", F.lit(tile_cols)).alias("col"), F.lit(-1).cast("long").alias("shard"), "ids", "data").select(tile, "shard", "ids", "data")
    of_shards = candidates.select(F.pmod("shard", F.lit(tile_rows)).alias("row"), copies(tile_cols).alias("col"), "shard", "ids", "data").select(tile, "shard", "ids", "data")
    met = of_queries.unionByName(of_shards).repartitionById(tile_rows * tile_cols, F.col("tile")).sortWithinPartitions("tile", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        asked: list[tuple[int, np.ndarray]] = []
        best: list[list[tuple[int, int]]] = []

        def found() -> Iterator[pa.RecordBatch]:
            for begin in range(0, len(asked), 1024):
                out = [(q, xxhash.xxh64_intdigest(row.tobytes()) >> 1, i, s) for (q, row), own in zip(asked[begin : begin + 1024], best[begin : begin + 1024], strict=True) for s, i in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["query_id", "query_print", "vec_id", "score"])

        for batch in batches:
            for tile, kind, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != at:
                    yield from found()
                    at, asked, best = tile, [], []
                names, values = _vectors(ids, data, wide)
                if kind < 0:
                    asked += zip(names.tolist(), values, strict=True)
                    best += [[] for _ in names]
                else:
                    here = Shard(names, values)
                    best = [here.top(row, q, k, own) for (q, row), own in zip(asked, best, strict=True)]
        yield from found()

    found = met.mapInArrow(lean(run, "topk"), "query_id bigint, query_print bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id", "query_print").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
