"""Centroid clustering on bit planes.

Components become integers, floor(64 * x).  Bit *p* of the 64 components of a vector, in two's
complement, is packed into one unsigned 64-bit word, its plane *p*; the last plane holds the signs.
With the weight 2^p of a plane, minus for the last, the dot product of two vectors is the sum of
weight * weight * popcount(plane AND plane) over all pairs of planes: exact, with no multiplication
of components.  A squared distance is the sum of both squares less twice the dot product.

Vectors are packed once and written to the shared folder; every round reads planes only, a batch at
a time, and sums each cluster's set bits plane by plane into one row per batch and cluster.  Only
the sums of each centroid, a fixed number, reach the driver.

Kept are vectors of exactly 64 components, none null or non-finite; an absolute integer of 2^27 or
more is an error, as its squared distances would not fit 64 bits.  Repeated rows each count.  First
centroids are the vectors with the smallest hash of their id (null: empty), equal ids by components.
Fewer vectors than centroids make fewer centroids; an empty table gives no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.session import checkpointed

DIMENSIONS = 64
SCALE = 64
LIMIT = 1 << 27
#: Vectors worked on at a time.
STRIP = 4096


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, c): kept vectors with components floor(64 * x) as longs."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(
        x,
        lambda v: F.when(F.abs(v * SCALE) < LIMIT, F.floor(v * SCALE)).otherwise(
            F.raise_error(F.lit("component too large for exact 64-bit distances")).cast("long")
        ),
    )
    kept = vectors.filter((F.size(embedding) == DIMENSIONS) & finite)
    return kept.select(F.col(vec_id).alias("vec_id"), whole.alias("c"))


def pack(components: np.ndarray) -> np.ndarray:
    """(n, 64) integers as (n, planes) words, with as many planes as the largest needs."""
    largest = int(np.abs(components).max(initial=0))
    bits = components[:, None, :] >> np.arange(largest.bit_length() + 1)[None, :, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(planes: int) -> np.ndarray:
    """2^p for each plane, negative for the signs."""
    value = 1 << np.arange(planes, dtype=np.int64)
    value[-1] *= -1
    return value


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``left`` with all rows of ``right``, both packed."""
    out = np.zeros((len(left), len(right)), np.int64)
    for p, a in enumerate(weights(left.shape[1])):
        for q, b in enumerate(weights(right.shape[1])):
            out += (a * b) * np.bitwise_count(left[:, p, None] & right[None, :, q]).astype(np.int64)
    return out


def squares(packed: np.ndarray) -> np.ndarray:
    """Dot product of each row with itself."""
    value = weights(packed.shape[1])
    out = np.zeros(len(packed), np.int64)
    for p, a in enumerate(value):
        for q, b in enumerate(value):
            out += (a * b) * np.bitwise_count(packed[:, p] & packed[:, q]).astype(np.int64)
    return out


def nearest(packed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equal ones, and the squared distance to it."""
    distance = squares(packed)[:, None] + squares(centroids)[None, :] - 2 * dots(packed, centroids)
    number = distance.argmin(axis=1)
    return number, distance[np.arange(len(packed)), number]


def component_sums(packed: np.ndarray) -> np.ndarray:
    """Sum of each of the 64 components over all rows, from the set bits of each plane."""
    words = np.ascontiguousarray(packed, "<u8")
    bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")
    return weights(packed.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _by_planes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Strips of rows with as many planes each, and their words."""
    planes = batch.column("planes")
    count = np.diff(planes.offsets.to_numpy())
    for number in np.unique(count):
        chosen = np.flatnonzero(count == number)
        for start in range(0, len(chosen), STRIP):
            rows = batch.take(pa.array(chosen[start : start + STRIP]))
            yield rows, _matrix(rows.column("planes"), np.int64).view(np.uint64)


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, planes) of quantised vectors, written to the shared folder."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STRIP):
                rows = batch.slice(start, STRIP)
                words = pack(_matrix(rows.column("c"), np.int64)).view(np.int64)
                offsets = np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), lists], ["vec_id", "planes"])

    return checkpointed(
        vectors.sparkSession, vectors.mapInArrow(pack_rows, f"vec_id {id_type}, planes array<long>"), "planes"
    )


def assign(packed_vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of each vector."""
    words = pack(np.array(centroids, np.int64))
    id_type = packed_vectors.schema["vec_id"].dataType.simpleString()

    def nearest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _by_planes(batch):
                number, distance = nearest(matrix, words)
                columns = [rows.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return packed_vectors.mapInArrow(nearest_rows, f"vec_id {id_type}, cluster int, distance long")


def moved(packed_vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of the mean of its vectors; one without vectors stays."""
    words = pack(np.array(centroids, np.int64))

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in _by_planes(batch):
                number, _ = nearest(matrix, words)
                present, counts = np.unique(number, return_counts=True)
                sums = [component_sums(matrix[number == cluster]).tolist() for cluster in present]
                columns = [pa.array(present.astype(np.int32)), pa.array(counts), pa.array(sums, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    totals = (
        packed_vectors.select("planes")
        .mapInArrow(partial_sums, "cluster int, n long, sums array<long>")
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(DIMENSIONS)])
    )
    out = list(centroids)
    for row in totals.collect():  # a row per centroid
        out[row.cluster] = [int(row[f"s{j}"]) // row.n for j in range(DIMENSIONS)]
    return out


def id_hash(vec_id: Column, seed: int = 1) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """Components of the ``k`` quantised vectors with the smallest hashes of their ids."""
    chosen = vectors.select(id_hash(F.col("vec_id")).alias("hash"), "c").orderBy("hash", "c").limit(k)
    return [list(row.c) for row in chosen.collect()]


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """Per kept vector (vec_id, cluster, distance), and the final centroids."""
    whole = quantised(vectors, vec_id, embedding)
    centroids = first_centroids(whole, k)
    if not centroids:
        none = whole.limit(0)
        return none.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    words = packed(whole)
    for _ in range(rounds):
        centroids = moved(words, centroids)
    return assign(words, centroids), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256, looked up in a row per centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {row.cluster: int(row.s) for row in sums}  # a row per centroid
    total = sum(inertia.values())
    looked_up = [
        (number, inertia[number], total, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for number, centroid in enumerate(centroids)
        if number in inertia
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(looked_up, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
