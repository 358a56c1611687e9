"""Centroid clustering on subvector dictionaries.

Vectors become integers (``floor(scale * x)``). A chunk of vectors is cut into
blocks of ``WIDTH`` components; each block has a dictionary of its distinct
subvectors, and a vector is its codes, without any loss. A round computes the
exact distance of every dictionary entry to every centroid's block once, and a
vector's distance is the sum of its codes' entries. Sums for new centroids come
from the dictionaries as well: how often a cluster has each code, times the
entry. Encoded chunks are written once to the shared folder; a round reads them
and sends one row for a cluster and component from each task, combined before the
shuffle; the driver holds the centroids alone.

Kept are vectors with exactly ``size`` components, none null, NaN or infinite, and
none whose integer is 2^62 or beyond, whose distance no long could hold. Integers
below 2^26 are added up as longs, others without a bound; a distance or inertia
beyond a long is null. Rows that repeat a ``vec_id`` are vectors each; a null
``vec_id`` starts no centroid before all others have; equal hashes go by their
components. Fewer vectors than ``clusters`` give fewer centroids, an empty table an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import give_back, work_folder

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
WIDTH = 2
CHUNK = 16_384
"""Vectors that share their dictionaries, at most; codes are 16 bits wide."""
NARROW = 1 << 26


def kept_vectors(vectors: DataFrame, vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the integers, of the usable vectors."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.size("x") == size)
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float((1 << 62) // scale)), F.lit(False)))
    return whole.where(finite).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def encode(kept: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Chunks of vectors: ``ids``, ``codes`` (16 bits, by block, then by vector), entries of each dictionary, and ``words``, all their components."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if rows + part.num_rows > chunk:
                    yield packed(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield packed(held)
        give_back()

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([x.column("vec_id") for x in batches])
        lists = [x.column("v") for x in batches]
        values = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).reshape(len(ids), -1)
        codes, entries, words = [], [], []
        for at in range(0, values.shape[1], width):
            distinct, code = np.unique(values[:, at:at + width], axis=0, return_inverse=True)
            codes.append(code.reshape(-1).astype("<u2"))
            entries.append(len(distinct))
            words.append(distinct.reshape(-1).astype("<i8"))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(x.tobytes() for x in codes)], pa.binary()),
             pa.array([entries], pa.list_(pa.int32())), pa.array([b"".join(x.tobytes() for x in words)], pa.binary())], names=["ids", "codes", "entries", "words"])

    return kept.mapInArrow(run, "ids array<bigint>, codes binary, entries array<int>, words binary")


class Chunk:
    """One encoded chunk."""

    def __init__(self, batch: pa.RecordBatch, row: int, size: int, width: int):
        self.ids = batch.column("ids")[row].values
        blocks = [(at, min(at + width, size)) for at in range(0, size, width)]
        self.blocks = blocks
        self.codes = np.frombuffer(batch.column("codes")[row].as_py(), "<u2").reshape(len(blocks), len(self.ids))
        words, at, self.words = np.frombuffer(batch.column("words")[row].as_py(), "<i8"), 0, []
        for (a, b), n in zip(blocks, batch.column("entries")[row].as_py()):
            self.words.append(words[at:at + n * (b - a)].reshape(n, b - a))
            at += n * (b - a)
        self.wide = any(len(x) and (x.max() >= NARROW or x.min() < -NARROW) for x in self.words)

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid, the smaller number of equally near ones, and its squared distance."""
        wide = self.wide or any(abs(x) >= NARROW for c in centroids for x in c)
        kind = object if wide else np.int64
        centre = np.array(centroids, dtype=kind)
        total = np.zeros((len(self.ids), len(centroids)), kind)
        for (a, b), words, code in zip(self.blocks, self.words, self.codes):
            # once for each entry of the dictionary, not for each vector
            apart = ((words.astype(kind)[:, None, :] - centre[None, :, a:b]) ** 2).sum(axis=2)
            total += apart[code]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, clusters: int) -> np.ndarray:
        """The componentwise sum of each cluster's vectors."""
        kind = object if self.wide else np.int64
        out = np.zeros((clusters, self.blocks[-1][1]), kind)
        for (a, b), words, code in zip(self.blocks, self.words, self.codes):
            often = np.bincount(cluster * len(words) + code, minlength=clusters * len(words)).reshape(clusters, -1)
            out[:, a:b] = often.astype(kind) @ words.astype(kind)
        return out


def round_sums(encoded: DataFrame, centroids: list[list[int]], width: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each cluster that has vectors: their number, the sum of their distances, and their componentwise sum."""
    size, clusters = len(centroids[0]), len(centroids)

    def run(batches):
        number, apart, total = [0] * clusters, [0] * clusters, np.zeros((clusters, size), object)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch, row, size, width)
                cluster, distance = chunk.nearest(centroids)
                for i in np.unique(cluster).tolist():
                    mine = cluster == i
                    number[i] += int(mine.sum())
                    apart[i] += int(distance[mine].sum())
                total += chunk.sums(cluster, clusters)
        rows = [(i, k, x) for i in range(clusters) if number[i] for k, x in enumerate([number[i], apart[i], *total[i]])]
        if rows:
            cluster, part, value = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array([str(int(x)) for x in value])], names=["cluster", "part", "value"])

    parts = encoded.mapInArrow(run, "cluster int, part int, value string")
    # a sum of longs' squares over any corpus stays below 38 digits but for vectors far beyond a long's root
    sums = parts.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in sums:
        out.setdefault(r["cluster"], {})[r["part"]] = int(r["value"])
    return {i: (x[0], x[1], [x[2 + k] for k in range(size)]) for i, x in out.items()}


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose hashed id is smallest, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(clusters).collect()]


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED,
                      width: int = WIDTH, chunk: int = CHUNK, vector: str = "embedding") -> DataFrame:
    """One row per kept vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``."""
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = kept_vectors(vectors, vector, size, scale)
    centroids = first_centroids(kept, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], schema)
    folder = f"{work_folder(spark)}/chunks"
    encode(kept, width, min(chunk, 1 << 16)).write.parquet(folder)
    encoded = spark.read.parquet(folder)
    for _ in range(rounds):
        for i, (number, _, total) in round_sums(encoded, centroids, width).items():
            centroids[i] = [x // number for x in total]
    inertia = {i: x[1] for i, x in round_sums(encoded, centroids, width).items()}
    everything = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = Chunk(batch, row, size, width)
                cluster, distance = own.nearest(centroids)
                of = [pa.array([as_long(x) for x in y], pa.int64()) for y in ([inertia.get(i, 0) for i in range(len(centroids))], [everything])]
                at = pa.array(cluster)
                yield pa.RecordBatch.from_arrays(
                    [own.ids, at.cast(pa.int32()), pa.array([as_long(x) for x in distance], pa.int64()) if distance.dtype == object else pa.array(distance),
                     of[0].take(at), of[1].take(pa.array(np.zeros(len(cluster), np.int64))), pa.array(digest).take(at)],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return encoded.mapInArrow(run, schema)


def as_long(x: int) -> int | None:
    """None beyond a long."""
    return int(x) if -(1 << 63) <= x < 1 << 63 else None


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL: a table of centroids for each round."""
    steps = [f"""kept as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: try_cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
cells as (select r, unnest(generate_series(1, {size})) as d, unnest(v) as x from kept),
firsts as (select v, row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as c from kept qualify c < {clusters}),
centre0 as (select c, unnest(generate_series(1, {size})) as d, unnest(v) as x from firsts)"""]
    for n in range(rounds + 1):
        steps.append(f"""apart{n} as (select r, c, sum((cells.x - centre.x) * (cells.x - centre.x)) as apart
  from cells join centre{n} as centre using (d) group by r, c),
near{n} as (select r, cast(min_by(c, (apart, c)) as integer) as c, cast(min(apart) as bigint) as distance from apart{n} group by r)""")
        if n < rounds:
            steps.append(f"""sums{n} as (select near.c, d, sum(x) as s, count(*) as n from cells join near{n} as near using (r) group by near.c, d),
centre{n + 1} as (select c, d, case when n is null then x else cast((s - ((s % n) + n) % n) // n as bigint) end as x from centre{n} left join sums{n} using (c, d))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, near.c as cluster, distance, cast(sum(distance) over (partition by near.c) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, digest as centroid_sha256
from near{rounds} as near join kept using (r)
  join (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as digest from centre{rounds} group by c) as k using (c)"""
