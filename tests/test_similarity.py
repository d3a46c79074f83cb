"""The pair search against brute force over all pairs."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import block_product, block_search, similarity, sums
from ratingloom.operators.ratings import latest_ratings
from ratingloom.params import NeighbourParams
from ratingloom.session import write_shared


def brute_force(rows, min_common, measure):
    latest = {}
    for u, i, r in rows:
        latest.setdefault(u, {})[i] = float(r)
    found = {}
    for a, b in itertools.combinations(sorted(latest), 2):
        common = sorted(set(latest[a]) & set(latest[b]))
        if len(common) >= min_common:
            xs, ys = [latest[a][i] for i in common], [latest[b][i] for i in common]
            found[(a, b)] = (len(common), measure(xs, ys))
    return found


def pearson(xs, ys):
    if min(xs) == max(xs) or min(ys) == max(ys):
        return None
    mx, my = math.fsum(xs) / len(xs), math.fsum(ys) / len(ys)
    xy = math.fsum((x - mx) * (y - my) for x, y in zip(xs, ys))
    return xy / math.sqrt(math.fsum((x - mx) ** 2 for x in xs) * math.fsum((y - my) ** 2 for y in ys))


def cosine(xs, ys):
    return math.fsum(x * y for x, y in zip(xs, ys)) / math.sqrt(
        math.fsum(x * x for x in xs) * math.fsum(y * y for y in ys)
    )


def skewed_rows(seed, users=40, items=25):
    """A few items rated by nearly all, one user with all items, re-ratings."""
    rng = random.Random(seed)
    rows = [(u, 0, rng.randint(1, 5)) for u in range(users)]
    rows += [(u, 1, rng.randint(1, 5)) for u in range(users) if rng.random() < 0.9]
    rows += [(0, i, rng.randint(1, 5)) for i in range(items)]
    for u in range(users):
        rows += [(u, int(items * rng.random() ** 2), rng.randint(1, 10) / 2) for _ in range(rng.randint(0, 8))]
    rng.shuffle(rows)
    return rows


def on_grid(ratings, min_common):
    comparable = similarity._comparable_ratings(latest_ratings(ratings), min_common)
    return similarity._on_grid(comparable, similarity.rating_grid(comparable, True), True)


def check(found, expected):
    found = {(r.user_a, r.user_b): (r.n_common, r.similarity) for r in found.collect()}
    assert set(found) == set(expected)
    for pair, (n, value) in expected.items():
        assert found[pair][0] == n
        if value is None:
            assert found[pair][1] is None
        else:
            assert found[pair][1] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("min_common", [1, 2, 3, 5])
@pytest.mark.parametrize("raters_per_slot", [3, 2048])
def test_pearson_is_whole_under_skew(make_ratings, min_common, raters_per_slot):
    rows = skewed_rows(min_common)
    params = NeighbourParams(min_common=min_common, raters_per_slot=raters_per_slot)
    check(similarity.pearson_pairs(make_ratings(rows), params), brute_force(rows, min_common, pearson))


def test_cosine(make_ratings):
    rows = skewed_rows(7)
    params = NeighbourParams(min_common=3, raters_per_slot=5)
    check(similarity.cosine_pairs(make_ratings(rows), params), brute_force(rows, 3, cosine))


def test_text_ids(make_ratings):
    rows = [(f"u{u}", f"i{i}", r) for u, i, r in skewed_rows(11)]
    params = NeighbourParams(min_common=3, raters_per_slot=4)
    check(similarity.pearson_pairs(make_ratings(rows, "string"), params), brute_force(rows, 3, pearson))


def test_raters_sharing_only_hot_items_never_meet(spark, make_ratings):
    """300 users share two hot items; each also has one item of its own."""
    rows = [(u, i, (u + i) % 5) for u in range(300) for i in (0, 1, 2 + u)]
    ratings = make_ratings(rows)
    comparable = on_grid(ratings, 3)
    placed = similarity._placed_ratings(comparable, similarity._tails(comparable, 2), 64)
    assert similarity._meetings(placed, 4).isEmpty()
    assert similarity.pearson_pairs(ratings, NeighbourParams(min_common=3)).isEmpty()


def test_join_groups_are_bounded(make_ratings):
    """A hot item is spread over groups of at most two slots of raters."""
    rows = [(u, i, 1 + (u * i) % 5) for u in range(400) for i in (0, 1, 2)]
    comparable = on_grid(make_ratings(rows), 1)
    placed = similarity._placed_ratings(comparable, None, 50)
    largest = placed.groupBy("item", "in_tail", "slot").count().agg(F.max("count")).first()[0]
    assert placed.agg(F.max("body_slots")).first()[0] == 8
    assert largest <= 100  # 50 on average, hashed


def test_large_constant_offset(make_ratings):
    """Centring keeps the sums exact enough far from zero."""
    rows = [(u, i, 1e6 + ((u + 1) * (i + 2)) % 7) for u in range(6) for i in range(8)]
    check(similarity.pearson_pairs(make_ratings(rows), NeighbourParams(min_common=5)), brute_force(rows, 5, pearson))


def test_nearest_users_uses_both_directions(make_ratings):
    rows = skewed_rows(3)
    pairs = similarity.pearson_pairs(make_ratings(rows), NeighbourParams(min_common=3))
    sides = {}
    for (a, b), (_, value) in brute_force(rows, 3, pearson).items():
        if value is not None and round(value, 12) > 0:
            sides.setdefault(a, []).append((-round(value, 12), b))
            sides.setdefault(b, []).append((-round(value, 12), a))
    found = {}
    for r in similarity.nearest_users(pairs, 4).collect():
        found.setdefault(r.user, {})[r.rank] = r.neighbour
    expected = {u: {k + 1: b for k, (_, b) in enumerate(sorted(v)[:4])} for u, v in sides.items()}
    assert found == expected


def test_neighbours_that_differ_in_the_ninth_digit(make_ratings):
    """User 3 is a little nearer to user 1 than user 2 is, though user 2 comes first by id."""
    mine = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(1, i, r) for i, r in enumerate(mine)]
    rows += [(2, i, r) for i, r in enumerate([1.0, 2.0, 3.0, 4.0, 5.0002])]
    rows += [(3, i, r) for i, r in enumerate([1.0, 2.0, 3.0, 4.0, 5.00019])]
    pairs = similarity.pearson_pairs(make_ratings(rows), NeighbourParams(min_common=5))
    value = {(r.user_a, r.user_b): r.similarity for r in pairs.collect()}
    assert 0 < value[(1, 3)] - value[(1, 2)] < 1e-9
    first = similarity.nearest_users(pairs, 1).filter("user = 1").first()
    assert (first.neighbour, first.similarity) == (3, value[(1, 3)])


def test_small_positive_similarities_stay(make_ratings):
    """A similarity of some 1e-7 is positive; one of zero is not."""
    rows = [(1, i, r) for i, r in enumerate([0, 1000, 0, 1000, 0.0004])]
    rows += [(2, i, r) for i, r in enumerate([0, 0, 1000, 1000, 1000])]
    rows += [(3, i, r) for i, r in enumerate([0, 0, 1, 1])] + [(4, i, r) for i, r in enumerate([0, 1, 0, 1])]
    pairs = similarity.pearson_pairs(make_ratings(rows), NeighbourParams(min_common=4))
    value = {(r.user_a, r.user_b): r.similarity for r in pairs.collect()}
    expected = {p: v for p, (_, v) in brute_force(rows, 4, pearson).items()}
    assert value[(3, 4)] == 0.0 and value[(1, 2)] == pytest.approx(expected[(1, 2)], abs=1e-12)
    kept = {(r.user, r.neighbour) for r in similarity.nearest_users(pairs, 5).collect()}
    assert kept == {way for (a, b), v in value.items() if v and v > 0 for way in ((a, b), (b, a))}


def test_grids(make_ratings):
    """Decimal ratings are exact; others keep 30 bits; sums that may outgrow a long are decimals."""

    def grid(values, center=True):
        rows = [(u, i, v) for u in (1, 2) for i, v in enumerate(values)]
        return similarity.rating_grid(similarity._comparable_ratings(latest_ratings(make_ratings(rows)), 1), center)

    assert grid([1, 2, 5]) == similarity.Grid(1.0, True, False)
    assert grid([1.15, 2.5, 0.01]) == similarity.Grid(100.0, True, False)
    assert not grid([1 / 3, 2 / 7, 5]).exact and grid([1 / 3, 2 / 7, 5]).scale == 2.0**27
    assert grid([1e6, 1e6 + 0.5, 1e6 + 1]).scale == 10.0
    assert grid([9e8, 1, 2]).wide and not grid([9e8, 9e8 + 1]).wide


@pytest.mark.parametrize("scale", [1 / 3, 3e8, 1e-9, 12345.678901])
def test_any_ratings(make_ratings, scale):
    """Ratings that no grid holds, very large and very small ones: sums are decimals or keep 30 bits."""
    rows = [(u, i, r * scale) for u, i, r in skewed_rows(5)]
    found = similarity.pearson_pairs(make_ratings(rows), NeighbourParams(min_common=3, raters_per_slot=7)).collect()
    expected = brute_force(skewed_rows(5), 3, pearson)
    assert {(r.user_a, r.user_b) for r in found} == set(expected)
    for r in found:
        n, value = expected[(r.user_a, r.user_b)]
        assert r.n_common == n and (r.similarity is None) == (value is None)
        assert value is None or r.similarity == pytest.approx(value, abs=1e-6)


def test_order_of_the_parts_does_not_matter(make_ratings):
    rows = skewed_rows(13)
    ratings = make_ratings([(u, i, r * 1.1) for u, i, r in rows])
    once, again = (
        sorted(map(tuple, similarity.pearson_pairs(ratings.repartition(n), NeighbourParams(min_common=2)).collect()))
        for n in (1, 7)
    )
    assert once == again


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("ids", ["bigint", "string"])
@pytest.mark.parametrize("blocks", [1, 5])
def test_blocks_give_the_neighbours_of_the_pairs(make_ratings, blocks, ids, compat):
    """To the last bit, with ties, hot items and items of few raters."""
    rows = skewed_rows(17, users=70)
    params = NeighbourParams(min_common=3, top_n=4)
    ratings = latest_ratings(make_ratings(rows, ids))
    pairs = similarity.pearson_pairs(ratings, params, compat, latest_only=True)
    expected = sorted(map(tuple, similarity.nearest_users(pairs, 4, compat).collect()))
    found = block_search.block_neighbours(on_grid(ratings, 3), blocks, params, compat)
    assert len(expected) > 50 and sorted(map(tuple, found.collect())) == expected


def test_few_raters_and_many_give_the_same_sums():
    """Products of arrays and pair by pair, against plain loops."""
    rng = random.Random(2)
    rated = {(u, i): rng.randint(-9, 9) for u in range(60) for i in range(30) if rng.random() < (0.9 if i < 3 else 0.08)}
    user, item = (block_search.np.array(c) for c in zip(*rated))
    x = block_search.np.array(list(rated.values()), float)
    late = user >= 25
    weight = block_search.np.ones(len(x))
    left, right = ((user[s] - first, item[s], x[s], weight[s]) for s, first in ((~late, 0), (late, 25)))
    sums = block_search.pair_sums(left, right, (25, 35), 30)
    for a in range(25):
        for b in range(25, 60):
            met = [(rated[a, i], rated[b, i]) for i in range(30) if (a, i) in rated and (b, i) in rated]
            plain = [len(met), *(sum(p**j * q**k for p, q in met) for j, k in ((1, 0), (0, 1), (2, 0), (0, 2), (1, 1)))]
            assert [s[a, b - 25] for s in sums] == plain


def test_two_ways_of_similar_users(make_ratings, monkeypatch):
    """Blocks where they are few and small, else pairs; no pair is shuffled by the first."""
    ratings, params = make_ratings(skewed_rows(19)), NeighbourParams(min_common=2, top_n=5)
    by_blocks = block_search.similar_users(ratings, params)
    assert "FlatMapGroupsInArrow" in by_blocks._jdf.queryExecution().toString()
    monkeypatch.setattr(block_search, "MAX_BLOCKS", 0)
    by_pairs = block_search.similar_users(ratings, params)
    assert "FlatMapGroupsInArrow" not in by_pairs._jdf.queryExecution().toString()
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, by_pairs.collect()))
    empty = block_search.similar_users(ratings.limit(0), params)
    assert empty.isEmpty()


@pytest.fixture
def product_only(monkeypatch):
    """Users too many for groups of blocks, and meetings too many for a shuffle; small blocks and strips."""
    monkeypatch.setattr(block_search, "MAX_BLOCKS", 0)
    monkeypatch.setattr(block_product, "LEAST_MEETINGS", 0)
    monkeypatch.setattr(block_product, "COST_OF_MEETING", 10**9)
    monkeypatch.setattr(block_product, "USERS_PER_BLOCK", 9)


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("ids", ["bigint", "string"])
@pytest.mark.parametrize("per_strip", [60, 10**6])
def test_products_of_blocks_give_the_neighbours_of_the_pairs(make_ratings, product_only, monkeypatch, per_strip, ids, compat):
    """To the last bit and with ties, and no pair is shuffled."""
    monkeypatch.setattr(block_product, "RATINGS_PER_STRIP", per_strip)
    rows, params = skewed_rows(17, users=70), NeighbourParams(min_common=3, top_n=4)
    latest = latest_ratings(make_ratings(rows, ids))
    found = block_search.similar_users(latest, params, compat, latest_only=True)
    text = found._jdf.queryExecution().toString()
    assert "MapInArrow" in text and "CartesianProduct" in text
    monkeypatch.setattr(block_product, "LEAST_MEETINGS", 10**12)
    pairs = similarity.pearson_pairs(latest, params, compat, latest_only=True)
    expected = sorted(map(tuple, similarity.nearest_users(pairs, 4, compat).collect()))
    assert len(expected) > 50 and sorted(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("compat", [False, True])
def test_lists_of_one_strip_go_through_no_exchange(make_ratings, product_only, monkeypatch, compat):
    """A task has all others beside its block, so its lists are whole; those of several strips are ranked again."""
    latest = latest_ratings(make_ratings(skewed_rows(17, users=70)))
    found = []
    for per_strip, windows in ((10**6, False), (60, True)):
        monkeypatch.setattr(block_product, "RATINGS_PER_STRIP", per_strip)
        neighbours = block_search.similar_users(latest, NeighbourParams(3, 4), compat, latest_only=True)
        assert ("Window" in neighbours._jdf.queryExecution().optimizedPlan().toString()) == windows
        found.append(sorted(map(tuple, neighbours.collect())))
    assert len(found[0]) > 50 and found[0] == found[1]


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("few", [0, 10**9])
def test_sums_of_the_few_pairs_that_share_enough(make_ratings, product_only, monkeypatch, few, compat):
    """The same neighbours from the sums of all pairs as from those of the pairs that share enough."""
    monkeypatch.setattr(block_product, "FEW_PAIRS", few)
    asked, real = [], block_product.sums_of_pairs
    latest = latest_ratings(make_ratings(skewed_rows(29, users=70)))
    params = NeighbourParams(min_common=4, top_n=6)
    packed = block_product.packed_blocks(_gridded(latest, params))
    monkeypatch.setattr(block_product, "sums_of_pairs", lambda *a: asked.append(len(a[4][0])) or real(*a))
    blocks = [block_product.Block({c: pa.scalar(r[c], t) for c, t in packed_types(packed)}) for r in packed[0].collect()]
    lists = []
    for left in blocks:
        best = block_product.Best(left.size, params.top_n)
        for right in blocks:
            met = block_product.Meeting(left, right)
            met.leave_out(params.min_common, compat)
            best.add(met.similarity(met.all_sums(), params.min_common, compat), right, met.pairs)
        best.settle()
        lists += zip(left.ids.take(pa.array(best.user)).to_pylist(), best.ids.to_pylist() if best.ids else [], best.value.tolist())
    # few is the number of pairs of which one may share enough
    assert bool(asked) == (few == 0)
    monkeypatch.setattr(block_product, "LEAST_MEETINGS", 10**12)
    pairs = similarity.pearson_pairs(latest, params, compat, latest_only=True)
    expected = similarity.nearest_users(pairs, 6, compat).drop("rank").collect()
    assert len(expected) > 50 and sorted(lists) == sorted(map(tuple, expected))


def _gridded(latest, params):
    rows = similarity._comparable_ratings(latest, params.min_common)
    return similarity._on_grid(rows, similarity.rating_grid(rows, True), True)


def packed_types(packed):
    kinds = {"array<bigint>": pa.list_(pa.int64()), "int": pa.int32(), "binary": pa.binary()}
    return [(f.name, kinds[f.dataType.simpleString()]) for f in packed[0].schema]


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_products_of_blocks_give_all_pairs(make_ratings, product_only, monkeypatch, ids, compat):
    """Also those without variance."""
    ratings = make_ratings(skewed_rows(23, users=60) + [(u, i, 3) for u in (91, 92) for i in range(4)], ids)
    params = NeighbourParams(min_common=2)

    def rows(make):
        made = make()
        return "MapInArrow" in made._jdf.queryExecution().toString(), sorted(map(repr, map(tuple, made.collect())))

    ways = (lambda: similarity.pearson_pairs(ratings, params, compat), lambda: similarity.cosine_pairs(ratings, params))
    by_product = [rows(way) for way in ways]
    monkeypatch.setattr(block_product, "LEAST_MEETINGS", 10**12)
    by_meetings = [rows(way) for way in ways]
    assert [p for p, _ in by_product] == [True, True] and [p for p, _ in by_meetings] == [False, False]
    assert len(by_product[0][1]) > 50 and [r for _, r in by_product] == [r for _, r in by_meetings]


def test_large_products_of_sums_stay_whole():
    """Sums below 2**52 whose products are beyond: longs, not doubles."""
    n, sx, sy, sxx, syy, sxy = 3, 1, 1, 2**51 + 1, 2**51 + 3, 2**51 + 1
    found = sums.pearson([block_search.np.array([float(v)]) for v in (n, sx, sy, sxx, syy, sxy)])[0]
    parts = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    assert found == float(parts[0]) / math.sqrt(float(parts[1]) * float(parts[2]))


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("some", [0, 10**9])
def test_correlations_of_the_pairs_that_share_enough_only(make_ratings, product_only, monkeypatch, some, compat):
    """The same neighbours from products of which some pairs are taken as from all; the others get no correlation."""
    monkeypatch.setattr(block_product, "FEW_PAIRS", 10**9)
    monkeypatch.setattr(block_product, "SOME_PAIRS", some)
    latest, params = latest_ratings(make_ratings(skewed_rows(31, users=70))), NeighbourParams(min_common=4, top_n=6)
    packed = block_product.packed_blocks(_gridded(latest, params))
    blocks = [block_product.Block({c: pa.scalar(r[c], t) for c, t in packed_types(packed)}) for r in packed[0].collect()]
    lists, correlations = [], 0
    for left in blocks:
        best = block_product.Best(left.size, params.top_n)
        for right in blocks:
            met = block_product.Meeting(left, right)
            met.leave_out(params.min_common, compat)
            assert (met.pairs is not None) == (some == 0)
            shared = met.all_sums()[0]
            correlations += shared.size
            assert some or (shared >= params.min_common).all()
            best.add(met.similarity(met.all_sums(), params.min_common, compat), right, met.pairs)
        best.settle()
        lists += zip(left.ids.take(pa.array(best.user)).to_pylist(), best.ids.to_pylist() if best.ids else [], best.value.tolist())
    users = sum(b.size for b in blocks)
    assert (correlations == users**2) == (some > 0)
    monkeypatch.setattr(block_product, "LEAST_MEETINGS", 10**12)
    pairs = similarity.pearson_pairs(latest, params, compat, latest_only=True)
    expected = similarity.nearest_users(pairs, 6, compat).drop("rank").collect()
    assert len(expected) > 50 and sorted(lists) == sorted(map(tuple, expected))


def test_products_in_single_floats_are_exact():
    """Up to the largest whole number that they hold; beyond, doubles."""
    np = block_search.np
    for largest, kind in ((2**24 - 1, np.float32), (2**24, np.float64), (2**40 + 1, np.float64)):
        left, right = np.array([[largest - 5.0, 5.0], [-3.0, 0.0]]), np.array([[1.0, 1.0], [-1.0, 1.0]])
        found = sums._product(left, right)
        assert found.dtype == kind
        assert found.astype(float).tolist() == [[float(largest), 10.0 - largest], [-3.0, 3.0]]


def test_events_are_read_once(spark, make_ratings, monkeypatch, tmp_path):
    """Users, items and ratings are counted from the stored latest ratings."""
    make_ratings(skewed_rows(13)).write.parquet(str(tmp_path / "ratings"))
    reads = []

    def stored(df, name, *by):
        reads.append((name, any("/ratings/" in f for f in df.inputFiles())))
        return write_shared(df, name, *by)

    for module in (block_search, similarity):
        monkeypatch.setattr(module, "write_shared", stored)
    for find in (block_search.similar_users, similarity.pearson_pairs, similarity.cosine_pairs):
        reads.clear()
        find(spark.read.parquet(str(tmp_path / "ratings")), NeighbourParams(min_common=2)).collect()
        assert [name for name, of_events in reads if of_events] == ["latest"]


@pytest.mark.parametrize("min_common", [1, 2, 4])
def test_bound_of_the_meetings_set_apart(make_ratings, min_common):
    """No more meetings are lost by setting items apart than the bound says."""
    rows = similarity._comparable_ratings(latest_ratings(make_ratings(skewed_rows(37))), min_common)
    users, every = rows.select("user").distinct().count(), sum((r.raters - 1) / 2 for r in rows.collect())
    plain = rows.select("user", "item", F.lit(0).alias("x"), "raters")
    tails = similarity._tails(plain, min_common - 1) if min_common > 1 else None
    left = similarity._number_of_meetings(similarity._placed_ratings(plain, tails, 2048))
    bound = similarity._most_set_apart(rows, users * (min_common - 1))
    assert every - bound <= left <= every and (bound == 0) == (min_common == 1)
