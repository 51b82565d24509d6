import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftspan.operators.metafeatures import extract
from driftspan.operators.mf_kmeans import MFKMeansShift, lloyd, metafeature_space, nearest, neighbours
from driftspan.operators.shifts import FeatureStratificationShift, NewClassShift, RandomPartitionShift


def ids(df, key="row_id"):
    return {r[key]: r["partition_id"] for r in df.collect()}


def test_numeric_equals_cut(spark):
    values = np.linspace(0, 100, 200)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(200), "feature": values}))
    strategy = FeatureStratificationShift(["feature"], "row_id", 4)
    found = ids(strategy.assign(df))
    cut = pd.cut(pd.Series(values), bins=4, labels=False, include_lowest=True)
    assert [found[i] for i in range(200)] == cut.tolist()
    assert strategy.validate(strategy.assign(df)) == {0: 50, 1: 50, 2: 50, 3: 50}


def test_edges_are_right_closed_and_constant_columns_fall_in_one_bin(spark):
    df = spark.createDataFrame([(0, 0.0, 5), (1, 1.0, 5), (2, 2.0, 5), (3, 4.0, 5)], "row_id long, x double, c int")
    assert ids(FeatureStratificationShift(["x"], "row_id", 4).assign(df)) == {0: 0, 1: 0, 2: 1, 3: 2}
    assert set(ids(FeatureStratificationShift(["c"], "row_id", 4).assign(df)).values()) == {0}


def test_categories_by_first_appearance_and_truncation(spark):
    df = spark.createDataFrame(list(enumerate(["a", "b", "a", "c", None, "c"])), "row_id long, cat string")
    strategy = FeatureStratificationShift(["cat"], "row_id", 2)
    assert ids(strategy.assign(df)) == {0: 0, 1: 1, 2: 0, 3: 2, 4: 3, 5: 2}
    assert strategy.validate(strategy.assign(df)) == {0: 2, 1: 1}
    assert sorted(strategy.partitions(df)) == [0, 1]


def test_combined_features(spark):
    df = spark.createDataFrame(list(zip(range(6), [1, 2, 3, 4, 5, 6], "AABBCC", strict=True)), "row_id long, num int, cat string")
    found = ids(FeatureStratificationShift(["num", "cat"], "row_id", 3).assign(df))
    assert found[0] == 0 and max(found.values()) <= 8 and found[0] == found[1]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_missing_values_are_errors(spark, bad):
    df = spark.createDataFrame([(0, 1.0), (1, bad)], "row_id long, x double")
    with pytest.raises(ValueError):
        FeatureStratificationShift(["x"], "row_id").assign(df)


def test_errors(spark):
    df = spark.createDataFrame([(0, 1)], "row_id long, a int")
    with pytest.raises(ValueError, match="Feature 'missing'"):
        FeatureStratificationShift(["missing"], "row_id").assign(df)
    with pytest.raises(ValueError):
        FeatureStratificationShift([], "row_id")
    strategy = FeatureStratificationShift(["a"], "row_id", 2)
    with pytest.raises(ValueError, match=r"partitions \[1\] are empty"):
        strategy.validate(strategy.assign(df))


def test_new_class(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(6)], "row_id long, y int")
    strategy = NewClassShift("y", 3)
    assert ids(strategy.assign(df)) == {i: i % 3 for i in range(6)}
    assert strategy.validate(strategy.assign(df)) == {0: 2, 1: 2, 2: 2}
    floats = spark.createDataFrame([(0, 1.9), (1, -1.9)], "row_id long, y double")
    assert ids(NewClassShift("y", 2).assign(floats)) == {0: 1, 1: -1}
    for value in ("a", "1.5", None):
        with pytest.raises(ValueError):
            NewClassShift("y", 2).assign(spark.createDataFrame([(0, value)], "row_id long, y string"))


def test_random_is_fixed_by_the_seed(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    a, b = RandomPartitionShift("row_id", 3, seed=1), RandomPartitionShift("row_id", 3, seed=2)
    assert ids(a.assign(df)) == ids(a.assign(df.repartition(7))) != ids(b.assign(df))


def test_neighbourhoods_meet_in_blocks_as_in_the_matrix(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(row_id=range(60)))
    space = {r["row_id"]: r["mf"] for r in metafeature_space(df, "row_id", ["a", "b", "c"], ["var", "mean"]).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :6]
    for i in range(60):
        assert np.allclose(space[i], np.concatenate([x[near[i]].var(axis=0, ddof=1), x[near[i]].mean(axis=0)]))
    rows = df.select(F.col("row_id").alias("id"), F.array("a", "b", "c").alias("x"), F.lit(None).cast("string").alias("y"))
    met = {}
    for q in neighbours(rows, 6).collect():
        met.setdefault(q["id"], set()).add(q["other"])
    assert met == {i: set(near[i].tolist()) for i in range(60)}


@pytest.mark.parametrize("values, doubles", [(10**9, True), (1, True), (1, False)])
def test_metafeatures_store_no_pairs(spark, monkeypatch, values, doubles):
    """In memory and in a file, floats and doubles: right, and the plan shuffles, joins and broadcasts nothing."""
    from driftspan.operators import mf_kmeans as module

    monkeypatch.setattr(module, "HELD_VALUES", values, raising=False)
    monkeypatch.setattr(module, "LEAST_ROWS", 20, raising=False)
    monkeypatch.setattr(module, "BROADCAST_VALUES", values, raising=False)
    x = np.random.default_rng(5).normal(size=(90, 3))
    x = x if doubles else x.astype(np.float32).astype(float)
    keys = np.random.default_rng(6).permutation(90)
    df = spark.createDataFrame(pd.DataFrame(x[keys], columns=["a", "b", "c"]).assign(row_id=keys, y=[f"c{i % 4}" for i in keys])).repartition(5)
    found = module.metafeature_space(df, "row_id", ["a", "b", "c"], ["var", "median", "freq_class"], target="y")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Window" not in plan
    space = {r["row_id"]: r["mf"] for r in found.collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :9]
    assert len(space) == 90
    for i in range(90):
        shares = np.unique(near[i] % 4, return_counts=True)[1] / 9
        want = np.concatenate([x[near[i]].var(axis=0, ddof=1), np.median(x[near[i]], axis=0), shares])
        width = len(space[0])
        assert np.allclose(space[i], np.concatenate([want, np.zeros(width)])[:width])


def test_kmeans_finds_separate_groups(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.1, (20, 2)), r.normal(5, 0.1, (20, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    centres = sorted(lloyd(df, "row_id", "x", 2, init=[[0.0, 0.0], [1.0, 1.0]]))
    assert np.allclose(centres, [x[:20].mean(axis=0), x[20:].mean(axis=0)])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(row_id=range(40)))
    strategy = MFKMeansShift(["a", "b"], "row_id", "mean", percent=0.2, seed=3)
    found = ids(strategy.assign(frame))
    assert len(set(found.values())) == 2 and len(strategy.centroids) == 2
    with pytest.raises(ValueError, match="Unsupported metafeature"):
        MFKMeansShift(["a"], "row_id", "nothing").assign(frame)


def plain_lloyd(x, centres, rounds):
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return centres


@pytest.mark.parametrize("dims", [2, 40])
def test_lloyd_equals_plain_iterations(spark, dims):
    """Short vectors take one aggregate of expressions, long ones sums of batches."""
    r = np.random.default_rng(dims)
    x = r.normal(size=(90, dims)) + r.integers(0, 3, 90)[:, None] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").repartition(3)
    start = x[:3] + 0.1
    for rounds in (1, 4, 30):
        got = lloyd(df, "row_id", "x", 3, max_iter=rounds, patience=99, init=start.tolist())
        assert np.allclose(got, plain_lloyd(x, start, rounds))


def test_nearest_takes_the_least_ids_of_equally_far_rows():
    matrix = np.array([[0.0], [1.0], [-1.0], [1.0], [2.0], [0.5]])
    got = nearest(matrix, np.arange(6), matrix, np.arange(6), 2)
    want = [sorted((round(abs(a[0] - b[0]), 9), j) for j, b in enumerate(matrix) if j != i)[:2] for i, a in enumerate(matrix)]
    assert got.tolist() == [[j for _, j in w] for w in want]


def test_entropies_of_continuous_columns_are_of_bins():
    x = np.random.default_rng(0).normal(size=(64, 2))
    y = (x[:, 0] > 0).astype(str)
    entropy, mutual = extract(["attr_ent"], x, None), extract(["mut_inf"], x, y)
    assert np.allclose(entropy, 2, atol=0.01)  # four bins, equally full
    assert mutual[0] > 0.9 > 0.3 > mutual[1]
    few = np.array([[1.0], [1.0], [2.0], [2.0]] * 20)
    assert np.allclose(extract(["attr_ent"], few, None), 1)


def test_many_strings_are_numbered_by_first_appearance(spark):
    rows = [(i, f"s{(i * 7) % 50}" if i % 11 else None) for i in range(200)]
    found = ids(FeatureStratificationShift(["s"], "row_id", 2).assign(spark.createDataFrame(rows, "row_id long, s string").repartition(4)))
    order = list(dict.fromkeys(s for _, s in rows))
    assert found == {i: order.index(s) for i, s in rows}


def test_mf_kmeans_clusters_without_pairs(spark, monkeypatch):
    """A matrix beyond every limit: what the iterations read is made without joins or windows, and the groups are found."""
    from driftspan.operators import mf_kmeans as module

    for limit in ("HELD_VALUES", "BROADCAST_VALUES"):
        monkeypatch.setattr(module, limit, 1, raising=False)
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.1, (25, 2)), r.normal(5, 0.1, (25, 2))])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(row_id=range(50)))
    strategy = MFKMeansShift(["a", "b"], "row_id", ["var", "mean"], n_partitions=2, percent=0.2, seed=3)
    found = ids(strategy.assign(frame))
    plan = strategy.space._jdf.queryExecution().optimizedPlan().toString() + strategy.space._jdf.queryExecution().analyzed().toString()
    strategy.release()
    assert "Join" not in plan and "Window" not in plan
    assert len(found) == 50 and len({found[i] for i in range(25)}) == len({found[i] for i in range(25, 50)}) == 1 and found[0] != found[49]


def plain_space(x, ids, k):
    """Variances and means of the k nearest others, ties by id."""
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 9)
    near = [[j for j in np.lexsort((ids, d[i])) if j != i][:k] for i in range(len(x))]
    return {ids[i]: np.concatenate([x[v].var(axis=0, ddof=1), x[v].mean(axis=0)]) for i, v in enumerate(near)}


@pytest.mark.parametrize("form", ["apart", "grid", "copies", "far"])
def test_a_large_table_is_held_nowhere(spark, monkeypatch, form):
    """Beyond what is held: no matrix or file, the rows that are asked for only, and right with ties between different rows, equal rows and clusters far apart."""
    from driftspan.operators import mf_kmeans as module

    for limit, value in (("HELD_VALUES", 1), ("SAMPLE_ROWS", 100), ("EDGE_ROWS", 5), ("STEP_ROWS", 7), ("BLOCK_ROWS", 16), ("LEAST_ROWS", 5), ("MOST_ROWS", 8), ("ROUND_VALUES", 100)):
        monkeypatch.setattr(module, limit, value)
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 2))
    if form == "grid":
        x = r.integers(0, 5, (400, 2)).astype(float)
    elif form == "copies":
        x[r.random(400) < 0.4] = x[0]
        x[200:] = x[:200]
    elif form == "far":
        x = x * 0.01 + r.integers(0, 4, 400)[:, None] * 1000
    ids = r.permutation(400) * 3
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(row_id=ids)).repartition(3)
    streamed, calls = module.streamed_space, []
    monkeypatch.setattr(module, "streamed_space", lambda *a: calls.append(1) or streamed(*a))
    vectors = form == "apart"  # one column of floats
    x = x.astype(np.float32).astype(float) if vectors else x
    rows = df.select("row_id", F.array("a", "b").cast("array<float>").alias("v")) if vectors else df
    found = module.metafeature_space(rows, "row_id", ["v"] if vectors else ["a", "b"], ["var", "mean"], asked=F.col("row_id") % 5 == 0)
    got = {r["row_id"]: r["mf"] for r in found.collect()}
    want = {i: v for i, v in plain_space(x, ids, 40).items() if i % 5 == 0}
    assert calls and got.keys() == want.keys()
    assert all(np.allclose(got[i], v, rtol=1e-6, atol=1e-9) for i, v in want.items())


def test_mf_kmeans_partitions_what_is_asked_for(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.1, (25, 2)), r.normal(5, 0.1, (25, 2))])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(row_id=range(50)))
    strategy = MFKMeansShift(["a", "b"], "row_id", ["var", "mean"], n_partitions=2, percent=0.2, seed=3, asked=F.col("row_id") % 5 == 0)
    found = ids(strategy.assign(frame))
    space = {r["row_id"]: r["mf"] for r in strategy.space.collect()}
    strategy.release()
    whole = plain_space(x, np.arange(50), 10)
    assert found.keys() == set(range(0, 50, 5)) and all(np.allclose(v, whole[i]) for i, v in space.items())
    assert len({found[i] for i in range(0, 25, 5)}) == len({found[i] for i in range(25, 50, 5)}) == 1 and found[0] != found[45]
    assert ids(MFKMeansShift(["a", "b"], "row_id", asked=F.col("row_id") < 0).assign(frame)) == {}
    with pytest.raises(ValueError, match="one length"):
        metafeature_space(frame.select("row_id", F.expr("if(row_id = 3, array(a), array(a, b))").alias("v")), "row_id", ["v"], ["var"])
