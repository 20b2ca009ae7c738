"""Steps whose work has to grow no faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions.variogram import Structure, Variogram
from fieldloom.operators import boxes, indicator, kriging, neighbours, simulation
from fieldloom.operators.kriging import Kriging
from fieldloom.operators.neighbours import Search


def _boxes(r, n):
    x = r.uniform(0, 100, (n, 2))
    return x, x + r.uniform(0, 2, (n, 2))


def test_points_together_look_at_few_boxes():
    """targets that lie together need not look at all leaves, and miss none that they reach."""
    r = np.random.default_rng(1)
    low, high = _boxes(r, 4000)
    for size, nearest, bound in ((0.5, 3, -np.inf), (0.5, 0, 4.0), (200.0, 2, 1.0)):
        x = r.uniform(0, 100, 2) + r.uniform(0, size, (50, 2))
        got = boxes.about(x, low, high, bound, nearest)
        near = boxes.distances(x, low, high)
        reached = (near <= bound) | ((near <= np.sort(near, 1)[:, [nearest - 1]]) if nearest else False)
        assert set(np.flatnonzero(reached.any(0))) <= set(got)
        assert size > 100 or len(got) < 100


def test_targets_of_one_task_are_dealt_out(spark, monkeypatch):
    """all targets came in the one partition of their file, which one task worked off."""
    monkeypatch.setattr(neighbours, "SMALL", 0)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = spark.range(400).coalesce(1).select(F.col("id").alias("block_id"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
        seen, staged = [], neighbours.stage
        monkeypatch.setattr(neighbours, "stage", lambda df: seen.append(df) or staged(df))
        found = neighbours.neighbours(t, t.withColumnRenamed("block_id", "obs_id"), ["x", "y"], Search(1))
        assert found.where("block_id <> obs_id or d2 <> 0").isEmpty() and found.count() == 400
        assert min(df.rdd.getNumPartitions() for df in seen if "bound" in df.columns) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _categories(spark, n=60):
    r = np.random.default_rng(4)
    rows = [(i + 1, float(x), float(y), int(c)) for i, (x, y, c) in enumerate(zip(*r.uniform(0, 100, (2, n)), r.integers(1, 4, n)))]
    return spark.createDataFrame(rows, "obs_id long, x double, y double, category int")


def _own(nvar):
    none, one = Variogram((Structure("nug", 0.0, 1.0, 0.0),)), Variogram((Structure("exp", 1.0, 30.0, 0.1),))
    return {(i, j): one if i == j else none for i in range(1, nvar + 1) for j in range(i, nvar + 1)}


def test_variables_of_the_same_places_are_sought_once(spark, monkeypatch):
    """indicators of one set of places were sought once a category, in the estimate and along the path."""
    calls = []
    monkeypatch.setattr(kriging, "neighbours", lambda *a, **kw: calls.append(1) or neighbours.neighbours(*a, **kw))
    obs = _categories(spark)
    t = spark.range(30).select((F.col("id") + 1).alias("block_id"), (F.col("id") * 3.1).alias("x"), (F.col("id") * 2.7).alias("y"))
    k = Kriging(_own(3), search=Search(4), nvar=3, standard=True)
    path = t.select("block_id", F.col("block_id").alias("pos"))
    simulation.simulation_weights(indicator.indicators(obs, [1, 2, 3]), t, k, path)
    indicator.indicator_kriging(obs, t, k, [1, 2, 3])
    assert len(calls) == 2
    # a datum more of one variable, and it is sought by itself
    more = indicator.indicators(obs, [1, 2, 3]).unionByName(spark.createDataFrame([(99, 5.0, 5.0, 2, 1.0)], "obs_id long, x double, y double, var_id int, value double"))
    kriging.estimate(more, t, k)
    assert len(calls) == 4


def test_estimates_are_made_with_the_weights(spark):
    """what comes of data that bring their values is what stored weights give, copies of a place and of an id included."""
    obs = indicator.indicators(_categories(spark), [1, 2, 3])
    obs = obs.unionByName(obs.where("obs_id = 7").withColumn("x", F.col("x") + 1))
    t = spark.range(25).select((F.col("id") + 1).alias("block_id"), (F.col("id") * 3.1).alias("x"), (F.col("id") * 2.7).alias("y"))
    far = t.withColumn("x", F.when(F.col("block_id") == 3, F.lit(None)).otherwise(F.col("x")))
    unlike = obs.where("obs_id <> 7 and (var_id = 1 or obs_id % 3 = 0)")
    for data, k in ((unlike, Kriging(_own(3), search=Search(3), nvar=3)), (unlike, Kriging(_own(3), search=Search(3), nvar=3, unbiased=False, means=(0.2, 0.3, 0.5))), (obs.where("obs_id <> 7"), Kriging(_own(3), search=Search(3), nvar=3, standard=True, bounds=(0.1, 0.9)))):
        got, want = (d.orderBy("block_id", "var_id").toPandas() for d in (kriging.estimate(data, far, k), kriging.apply(kriging.solve(data, far, k), data, k, far)))
        assert len(got) == 75 and np.allclose(got[["estimate", "variance"]], want[["estimate", "variance"]], equal_nan=True) and got.estimate.isna().sum() == 3
    near = kriging.assembled(kriging.points_of(obs, k), t, k, values=True).select(F.explode("near").alias("e")).select("e.*").where("src_id = 7")
    assert near.groupBy("x").agg(F.count_distinct("var_id").alias("n")).where("n <> 3").isEmpty()


def test_one_tree_a_band_of_the_path(spark, monkeypatch):
    """along a path all sources were sorted into trees again for every stretch of it, each with its own rounds of jobs."""
    monkeypatch.setattr(neighbours, "SMALL", 0)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "STRETCH", 16)
    calls, built = [], neighbours.leaves_of
    monkeypatch.setattr(neighbours, "leaves_of", lambda *a: calls.append(1) or built(*a))
    r = np.random.default_rng(8)
    x = r.uniform(0, 100, (400, 2))
    t = spark.createDataFrame([(i, i + 1, float(a), float(b)) for i, (a, b) in enumerate(x)], "block_id long, pos long, x double, y double")
    found = {}
    for row in neighbours.neighbours(t, t.withColumnRenamed("block_id", "obs_id"), ["x", "y"], Search(3), order="pos").collect():
        found.setdefault(row.block_id, []).append((row["rank"], row.obs_id))
    for i in range(400):
        d2 = (x[i, 0] - x[:i, 0]) ** 2 + (x[i, 1] - x[:i, 1]) ** 2
        assert [o for _, o in sorted(found.get(i, []))] == np.lexsort((np.arange(i), d2))[:3].tolist()
    assert len(calls) == 1


def test_distances_of_a_round_fit_a_cache_and_ties_stay():
    import tracemalloc

    r = np.random.default_rng(5)
    for n, k, before in ((4096, 3, False), (4096, 3, True), (90, 20, True), (1, 2, False)):
        x, s = np.floor(r.random((700, 2)) * 40), np.floor(r.random((n, 2)) * 40)
        order = (r.integers(0, 900, 700), r.integers(0, 900, n)) if before else None
        bound = np.where(r.random(700) < 0.5, 9.0, np.inf)
        tracemalloc.start()
        rows, cols, d2 = boxes.search(x, s, k, bound, order)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20
        want = []
        for i in range(700):
            d = ((x[i] - s) ** 2).sum(1)
            ok = np.flatnonzero((d <= bound[i]) & (order[1] < order[0][i] if before else True))
            want += [(i, j, d[j]) for j in ok[np.lexsort((ok, d[ok]))][:k]]
        assert list(zip(rows.tolist(), cols.tolist(), d2.tolist())) == want


def test_range_search_tasks_make_a_bounded_number_of_pairs(spark):
    """Targets of one leaf are parted so that a task holds about PAIRS pairs, however many lie within the distance."""
    import pyarrow as pa

    from fieldloom.operators import ranges

    sources = 1_000
    visits = spark.range(15_000).select(F.col("id").alias("block_id"), F.lit(3).alias("leaf"))
    o = spark.range(sources).select(F.col("id").alias("obs_id"), F.lit(3).alias("leaf"))
    run = lambda t, o: pa.table({"targets": pa.array([t.num_rows]), "pairs": pa.array([t.num_rows * o.num_rows])})
    met = ranges._opened(visits, o, run, "targets long, pairs long", ranges._at_once({"n": np.array([sources])})).collect()
    assert sum(r.targets for r in met) == 15_000
    assert max(r.pairs for r in met) < 1.2 * ranges.PAIRS


def test_range_search_is_dealt_by_its_pairs(spark, monkeypatch):
    """Few bytes can make very many pairs: partitions follow from the pairs, and are not joined for their few bytes."""
    from fieldloom.operators import ranges

    monkeypatch.setattr(ranges, "PAIRS", 1 << 14)
    at = spark.range(3_000).select(F.col("id").alias("block_id"), (F.col("id") % 61).cast("double").alias("x"), (F.col("id") % 53).cast("double").alias("y"))
    found = ranges.within(at, at.withColumnRenamed("block_id", "obs_id"), ["x", "y"], 10.0)
    used = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 16
    near = lambda i, j: (i % 61 - j % 61) ** 2 + (i % 53 - j % 53) ** 2 <= 100
    i = np.arange(3_000)
    assert found.count() == near(i[:, None], i[None]).sum()


def test_range_search_stages_few_rows_beside_its_pairs(spark, monkeypatch):
    """A source is sent once to a group of targets, not a target to each leaf that it reaches: those grow with the pairs."""
    from fieldloom.operators import ranges

    held = []
    staged = ranges.stage

    def stage(df):
        out = staged(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(ranges, "stage", stage)
    at = spark.range(40_000).select(F.col("id").alias("block_id"), (F.col("id") * 4099 % 10007).cast("double").alias("x"), (F.col("id") * 6151 % 9973).cast("double").alias("y"))
    found = ranges.within(at, at.withColumnRenamed("block_id", "obs_id"), ["x", "y"], 700.0)
    assert sum(held) <= 3 * 40_000
    assert found.count() > 100 * 3 * 40_000


def test_range_search_by_groups_and_slabs_is_whole(spark, monkeypatch):
    """Distances of every magnitude and many slabs, chunks and equal places: each pair once, and none for a null, negative or undefined distance."""
    from fieldloom.operators import ranges

    monkeypatch.setattr(ranges, "SLAB", 300)
    r = np.random.default_rng(11)
    s, x = np.floor(r.random((3_000, 2)) * 90), np.floor(r.random((700, 2)) * 120) - 15
    s[:900] = (7.0, 8.0)
    x[:60] = (7.0, 12.0)
    radius = [None if i % 13 == 0 else (0.0, 1.0, 4.0, 4.0, 9.0, -1.0, float("nan"), 1e9, float("inf"), 0.01)[i % 10] for i in range(700)]
    t = spark.createDataFrame([(f"b{i}", *map(float, x[i]), radius[i]) for i in range(700)], "block_id string, x double, y double, r double")
    o = spark.createDataFrame([(i, f"n{i % 5}", *map(float, s[i])) for i in range(3_000)], "obs_id long, kind string, x double, y double")
    d2 = (x[:, None, 0] - s[None, :, 0]) ** 2 + (x[:, None, 1] - s[None, :, 1]) ** 2
    ok = np.array([np.nan if v is None or v < 0 else v * v for v in radius])
    want = [(f"b{i}", j, f"n{j % 5}", d2[i, j]) for i, j in zip(*np.nonzero(d2 <= ok[:, None]))]
    for pairs in (1 << 22, 1 << 14):
        monkeypatch.setattr(ranges, "PAIRS", pairs)
        assert sorted(map(tuple, ranges.within(t, o, ["x", "y"], "r", sides=("obs_id", "kind")).toPandas().to_numpy().tolist())) == sorted(want)
    assert ranges.within(t.limit(0), o, ["x", "y"], "r").count() == 0
