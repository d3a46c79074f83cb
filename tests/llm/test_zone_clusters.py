import hashlib
import itertools

import numpy as np
import pytest

from ratingloom.llm import zone_clusters as Z


def plain(rows, k=40, rounds=5, dim=64):
    """The same rounds over one array, all vectors against all centroids."""
    fine = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist())
    centroids = [v for _, v in sorted(fine, key=key)[:k]]
    if not fine:
        return []
    vectors = np.array([v for _, v in fine])

    def nearest():
        gaps = ((vectors[:, None] - np.array(centroids)[None]) ** 2).sum(2)
        return gaps.argmin(1), gaps.min(1)

    for _ in range(rounds):
        cluster, _ = nearest()
        for c in range(len(centroids)):
            if (cluster == c).any():
                centroids[c] = vectors[cluster == c].sum(0) // (cluster == c).sum()
    cluster, gap = nearest()
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = [int(gap[cluster == c].sum()) for c in range(len(centroids))]
    return sorted(
        ((i, int(c), int(g), inertia[c], int(gap.sum()), sha[c]) for (i, _), c, g in zip(fine, cluster, gap)), key=str
    )


def found(spark, rows, params=Z.ClusterParams()):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((tuple(r) for r in Z.cluster(vectors, params).collect()), key=str)


def blobs(seed, n, dim=64, centres=12, spread=0.02):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (centres, dim))
    return middles[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dim))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_all_distances(spark, spread):
    rows = [(i, v.tolist()) for i, v in enumerate(blobs(1, 700, spread=spread))]
    assert found(spark, rows, Z.ClusterParams(block=32)) == plain(rows)


def test_boxes_leave_out_most_centroids(spark):
    """On vectors with clusters a block compares with few of the 40 centroids, and loses none that it needs."""
    vectors = np.floor(256 * blobs(2, 6000)).astype(np.int64)
    frame = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    blocks, centroids, axes = Z.fit(frame, Z.ClusterParams(block=64, rounds=1))
    _, compared = Z.moved(blocks, centroids, axes, Z.ClusterParams(block=64))
    assert compared < 0.35 * len(vectors) * len(centroids)


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(3)
    for scale in (1, 100, 1 << 26):
        v = rng.integers(-scale, scale + 1, (300, 8))
        centroids = rng.integers(-scale, scale + 1, (20, 8))
        centroids[7] = centroids[3]  # a tie
        _, turn = np.linalg.eigh(np.cov(v.T.astype(float)))
        chooser = Z.Chooser(centroids, Z.Axes(turn, np.zeros(8), np.ones(8)))
        gaps = ((v[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        for part in np.array_split(np.arange(300), 60):
            turned = v[part].astype(float) @ turn
            cluster, gap, _ = chooser.choose(v[part], turned.min(0), turned.max(0))
            assert cluster.tolist() == [int(np.argmin(g)) for g in gaps[part]]
            assert gap.tolist() == [int(g.min()) for g in gaps[part]]


def test_curve_visits_neighbours():
    for axes, bits in ((2, 3), (3, 2), (7, 1), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = Z.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(0, 1, 64).tolist()
    rows = [(i, same) for i in range(300)] + [(3, same), (3, same)]  # one vector very often, and repeated rows
    rows += [(1000 + i, rng.normal(0, 1, 64).tolist()) for i in range(60)] + [(None, rng.normal(0, 1, 64).tolist())]
    rows += [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [0.5] * 63 + [None]), (6, [0.5] * 63 + [float("nan")])]
    rows += [(7, [0.5] * 63 + [float("-inf")]), (8, [0.0] * 64), (9, [-0.0] * 64)]
    assert found(spark, rows, Z.ClusterParams(block=16)) == plain(rows)
    assert found(spark, rows[-1:]) == plain(rows[-1:])
    assert found(spark, rows[:50]) == plain(rows[:50])
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    assert [r[:3] for r in found(spark, huge)] == [(1, c, 0) for c in [found(spark, huge)[0][1]]] + [
        r[:3] for r in found(spark, huge)[1:]
    ]


def test_empty_table_and_clashing_names(spark):
    names = "vec_id int, embedding array<float>, v int, place int, cluster int, late string, distance int"
    assert Z.cluster(spark.createDataFrame([], names)).count() == 0
    rows = [(i, [float(i)] * 64, 1, 2, 3, "x", 4) for i in range(50)]
    got = Z.cluster(spark.createDataFrame(rows, names)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([r[:2] for r in rows])
