"""Centroid clustering against SQL and against plain integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from llm_data import SF
from tallyfold.llm import subvectors

ROW = "vec_id long, embedding array<double>, n int, cluster int, v string"


def plain(rows, clusters, rounds, size):
    def whole(x):
        return math.floor(x) * 64 if abs(x) >= 2 ** 52 else math.floor(64 * x)

    kept = [(i, [whole(x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 56 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centre = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centre))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centre)):
            mine = [v for (_, v), k in zip(kept, own) if k == n]
            if mine:
                centre[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, k in found if k == n) for n in range(len(centre))}
    long = lambda x: x if x < 2 ** 63 else None
    return [(i, n, long(d), long(inertia[n]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()) for i, d, n in found]


def test_clusters_match_sql(spark):
    assert compare(entry.queries()["op13_subvectors"](spark, SF), duck(SF), entry.oracle_sql()["op13_subvectors"]) is None


@pytest.mark.parametrize("width, chunk, scale", [(1, 7, 1.0), (2, 16_384, 1.0), (5, 50, 1.0), (2, 9, 1e7), (3, 20, 1e14)])
def test_clusters_of_odd_vectors(spark, width, chunk, scale):
    """Nulls, wrong sizes, NaN, ties, repeated rows and ids, empty clusters, integers beyond what longs can square."""
    rng = random.Random(width)
    some = [(i, [round(rng.uniform(-2, 2), 1) * scale for _ in range(6)], 1, 2, "x") for i in range(150)]
    odd = [(200, None, 1, 1, None), (201, [], 1, 1, None), (202, [1.0] * 5, 1, 1, None), (203, [1.0] * 5 + [None], 1, 1, None), (204, [float("nan")] * 6, 1, 1, None),
           (205, [float("inf")] * 6, 1, 1, None), (206, [-0.0] * 6, 1, 1, None), (None, [0.5] * 6, 1, 1, None), (None, [0.5] * 6, 1, 1, None), (3, some[3][1], 1, 1, None),
           (3, [9.0] * 6, 1, 1, None), (207, [1e300] * 6, 1, 1, None), (208, [-1e-300] * 6, 1, 1, None)]
    rows = some + odd
    frame = spark.createDataFrame(rows, ROW).repartition(3)
    got = subvectors.centroid_clusters(frame, clusters=5, size=6, width=width, chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, 5, 3, 6), key=repr)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0], 0, 0, ""), (2, [1.0, 2.0], 0, 0, ""), (3, [5.0, 5.0], 0, 0, "")]
    frame = spark.createDataFrame(rows, ROW)
    assert sorted(map(tuple, subvectors.centroid_clusters(frame, size=2).collect())) == sorted(plain(rows, 16, 3, 2))
    assert subvectors.centroid_clusters(frame.where("false"), size=2).count() == 0


def test_codes_are_lossless(spark):
    import numpy as np

    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    kept = subvectors.kept_vectors(frame)
    want = {r.vec_id: r.v for r in kept.collect()}
    got = {}
    for batch in subvectors.encode(kept, chunk=100).toArrow().to_batches():
        for row in range(batch.num_rows):
            own = subvectors.Chunk(batch, row, 64, subvectors.WIDTH)
            vectors = np.concatenate([w[c] for w, c in zip(own.words, own.codes)], axis=1)
            got.update(zip(own.ids.to_pylist(), vectors.tolist()))
    assert got == want and kept.where(F.size("v") != 64).count() == 0
