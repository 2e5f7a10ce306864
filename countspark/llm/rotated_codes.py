"""Nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to a common centre, scaled to length one, and turned by a few fixed random rotations; the signs of its
coordinates are the code. With the code go the length and the inner product of the code with the vector it stands for. The inner product
of a query with a vector is estimated from the packed bits and that correction, and the estimate has a known error bound; only vectors
whose lower bound on the distance may still be among the nearest are compared with the query by their original components.

Queries meet all vectors in blocks: every block of vectors is compared with every block of queries by a task of its own, which returns
the nearest ``k`` of its block per query; the best of the blocks are the result. Nothing is broadcast or gathered per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countspark.llm.common import id_column
from countspark.session import keep, keep_measured

#: Rotations joined to one code: the error of the estimate falls with the root of their number.
ROTATIONS = 4
#: Width of the error bound in standard deviations, rows of a block, queries of a block, vectors that the centre is the mean of.
DEVIATIONS = 3.0
BLOCK = 8192
QUERIES = 2048
CENTRE_ROWS = 4096
SEED = 20


def rotations(dim: int, n: int = ROTATIONS) -> np.ndarray:
    """``n`` random rotations of a space, side by side: (dim, n * dim)."""
    rng = np.random.default_rng([SEED, dim])
    parts = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, 1)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance to the centre, and inner product of each code (scaled to length one) with its vector."""
    away = vectors - centre
    length = np.linalg.norm(away, axis=1)
    unit = away / np.where(length > 0, length, 1)[:, None]
    turned = unit @ turn
    n = turn.shape[1] // turn.shape[0]
    inner = np.abs(turned).sum(1) / np.sqrt(turn.shape[0]) / n  # mean over the rotations of <code, vector>
    return np.packbits(turned > 0, axis=1, bitorder="little"), length, inner


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _blocks(rows: DataFrame, size: int, id_type: str, centres: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Rows ``(id, v)`` packed to blocks of at most ``size`` vectors of one dimension, written: ``dim``, ``ids``, ``vectors`` (8-byte
    floats), and with ``centres`` the index entry of each vector: ``codes`` (bits), ``lengths`` and ``inners`` (4-byte floats)."""
    def block(dim: int, ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(parts)
        entry = [x.tobytes() for x in encode(v, centres[dim], rotations(dim))] if centres else [None] * 3
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.concat_arrays(ids)),
                                           *[pa.array([x], pa.binary()) for x in (v.tobytes(), *entry)]], ["dim", "ids", "vectors", "codes", "lengths", "inners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, size // 2):
                    some = part.slice(at, size // 2)
                    if sum(map(len, waiting.get(dim, ([], []))[1])) + some.num_rows > size:
                        yield block(dim, *waiting.pop(dim))
                    ids, parts = waiting.setdefault(dim, ([], []))
                    ids.append(some.column(0))
                    parts.append(some.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim))
        for dim, (ids, parts) in waiting.items():
            yield block(dim, ids, parts)

    packed = rows.mapInArrow(run, f"dim int, ids array<{id_type}>, vectors binary, codes binary, lengths binary, inners binary")
    return keep(packed.withColumn("no", F.monotonically_increasing_id()))


def centre_of(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean of a bounded sample of the vectors of one dimension. It only steers how well the codes discriminate."""
    some = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id", "v")).limit(CENTRE_ROWS)
    means = some.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    return np.array([r["m"] for r in means])


def nearest(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = BLOCK,
            query_block: int = QUERIES, deviations: float = DEVIATIONS) -> DataFrame:
    """For every row for which ``queries`` holds, its ``k`` nearest other rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller key. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part; vectors are compared with those of their own dimension only.
    Rows with a null key are candidates but no queries. A row is not a candidate for queries of its own key; repeated rows are candidates of their own, and
    a repeated query gets its neighbours once. With fewer than ``k`` candidates all are returned; empty tables give empty results.
    """
    spark = vectors.sparkSession
    id_type = id_column(vectors, key)
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked = vectors.where(queries & F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked, seen = keep_measured(asked.dropDuplicates(["id"]))
    centres = {r["dim"]: centre_of(rows, r["dim"]) for r in asked.select(F.size("v").alias("dim")).distinct().collect()}
    if not centres:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    data = _blocks(rows.where(F.size("v").isin(list(centres))), block, id_type, centres)
    asks = _blocks(asked.repartition(1 + seen["n"] // query_block), query_block, id_type)
    # a grid of (block of vectors, block of queries): each side is sent once per block of the other
    ask_names = asks.select(F.col("dim").alias("d"), F.col("no").alias("q")).groupBy("d").agg(F.collect_list("q").alias("qs"))
    data_names = data.select(F.col("dim").alias("d"), F.col("no").alias("b")).groupBy("d").agg(F.collect_list("b").alias("bs"))
    left = data.join(ask_names, F.col("dim") == F.col("d")).drop("d").withColumn("q", F.explode("qs")).drop("qs")
    right = asks.join(data_names, F.col("dim") == F.col("d")).select(F.explode("bs").alias("q_b"), F.col("no").alias("q_no"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = left.join(right, (F.col("no") == F.col("q_b")) & (F.col("q") == F.col("q_no")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, asked_ids = batch.column(1)[i].values, batch.column(6)[i].values
                base, codes, lengths, inners, asked_v = [np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((2, "<f8"), (3, "u1"), (4, "<f8"), (5, "<f8"), (7, "<f8"))]
                q_at, at, score = _search_block(base.reshape(-1, dim), ids.to_pylist(), (codes.reshape(len(ids), -1), lengths, inners), asked_v.reshape(-1, dim),
                                                asked_ids.to_pylist(), centres[dim], k, deviations)
                if len(at):
                    yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(q_at)), ids.take(pa.array(at)), pa.array(score)], ["query_id", "vec_id", "score"])

    found = pairs.select("dim", "ids", "vectors", "codes", "lengths", "inners", "q_ids", "q_vectors").mapInArrow(search, f"query_id {id_type}, vec_id {id_type}, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(base: np.ndarray, base_ids: list, entry: tuple, asked: np.ndarray, ask_ids: list, centre: np.ndarray, k: int,
                  deviations: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of query and vector, and distance, for the nearest ``k`` of a block."""
    packed, length, inner = entry
    dim = base.shape[1]
    turn = rotations(dim)
    width = turn.shape[1]
    rotations_n = width // dim
    inner = np.maximum(inner, 1e-9)
    # standard deviation of the estimated inner product of unit vectors, per vector
    spread = np.sqrt(np.maximum(0, 1 - inner ** 2)) / inner / np.sqrt(max(1, dim - 1) * rotations_n)
    id_order = np.empty(len(base_ids), np.int64)
    id_order[sorted(range(len(base_ids)), key=lambda i: (base_ids[i] is not None, base_ids[i]))] = np.arange(len(base_ids))
    own: dict = {}
    for at, name in enumerate(base_ids):
        own.setdefault(name, []).append(at)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q0 in range(0, len(asked), 64):
        part = asked[q0:q0 + 64]
        away = part - centre
        q_len = np.linalg.norm(away, axis=1)
        turned = (away / np.where(q_len > 0, q_len, 1)[:, None]) @ turn
        cosine = np.empty((len(part), len(base)), np.float32)
        for b0 in range(0, len(base), 2048):  # the bits are unpacked a few at a time
            signs = np.unpackbits(packed[b0:b0 + 2048], axis=1, count=width, bitorder="little").astype(np.float32)
            dots = 2 * (turned.astype(np.float32) @ signs.T) - turned.sum(1, keepdims=True)
            cosine[:, b0:b0 + 2048] = dots / np.sqrt(dim) / rotations_n / inner[b0:b0 + 2048]
        near = q_len[:, None] ** 2 + length ** 2 - 2 * q_len[:, None] * length * np.minimum(1, cosine + deviations * spread)
        far = q_len[:, None] ** 2 + length ** 2 - 2 * q_len[:, None] * length * cosine
        for i in range(len(part)):
            fine = np.ones(len(base), bool)
            fine[own.get(ask_ids[q0 + i], [])] = False
            n = int(fine.sum())
            if not n:
                continue
            if n > k:  # the exact distances of the k best estimates bound the k-th distance
                guess = np.where(fine, far[i], np.inf)
                first = np.argpartition(guess, k - 1)[:k]
                bound = ((base[first] - part[i]) ** 2).sum(1).max()
                fine &= near[i] <= bound * (1 + 1e-6) + 1e-12
                fine[first] = True
            at = np.flatnonzero(fine)
            distance = np.sqrt(((base[at] - part[i]) ** 2).sum(1))
            best = np.lexsort((id_order[at], distance))[:k]
            out.append((np.full(len(best), q0 + i), at[best], distance[best]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))
