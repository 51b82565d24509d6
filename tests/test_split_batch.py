import pytest

from driftspan.operators.batch import BatchSampler
from driftspan.operators.split import TrainTestSplitter, quotas, split_counts, take_count, views

TARGET = [0, 0, 0, 0, 1, 1, 1, 1, 0, 1, 0, 1]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i * 10, y, i // 4) for i, y in enumerate(TARGET)], "row_id long, feat int, target int, partition_id int").cache()


def split(rows, mode, **other):
    given = {"train_ratio": 0.5, "test_ratio": 0.5, "id_partitions": (0, 1), "ood_partitions": (2,), "seed": 42}
    out = TrainTestSplitter("row_id", "target", mode, **given | other).split(rows)
    sides = {k: {r["row_id"] for r in v.collect()} for k, v in views(out).items()}
    return sides


@pytest.mark.parametrize(("mode", "sizes"), [(0, (4, 0, 2, 0)), (1, (4, 0, 0, 2)), (2, (4, 0, 2, 2)), (3, (4, 2, 4, 2))])
def test_modes(rows, mode, sizes):
    s = split(rows, mode)
    if mode != 3:
        assert tuple(len(s[k]) for k in ("train_id", "train_ood", "test_id", "test_ood")) == sizes
    else:
        assert len(s["train_id"] | s["train_ood"]) == 6 and sum(map(len, s.values())) == 12
    assert s["train_id"] | s["test_id"] <= set(range(8)) and s["train_ood"] | s["test_ood"] <= set(range(8, 12))
    assert not (s["train_id"] | s["train_ood"]) & (s["test_id"] | s["test_ood"])
    assert {TARGET[i] for i in s["train_id"] | s["train_ood"]} == {0, 1}
    assert split(rows.repartition(5), mode) == s


def test_defaults_and_errors(rows):
    s = split(rows, 0, id_partitions=None, ood_partitions=())
    assert len(s["train_id"]) == 6
    with pytest.raises(ValueError, match="Unknown mode"):
        split(rows, 7)
    with pytest.raises(ValueError):
        split(rows, 0, train_ratio=1.0)
    unstratified = split(rows, 0, stratify=False, train_ratio=0.31)
    assert len(unstratified["train_id"]) == 2
    counts = {(r["role"], r["is_ood"]): r["n"] for r in split_counts(TrainTestSplitter("row_id", "target", 1, 0.5, 0.5, (0,), (1,), stratify=False).split(rows)).collect()}
    assert counts == {("train", False): 2, ("unused", False): 6, ("test", True): 2, ("unused", True): 2}


def test_quotas():
    assert quotas({"a": 5, "b": 3, "c": 2}, 0.5) == {"a": 3, "b": 1, "c": 1}
    assert [take_count(f, n) for n, f in ((5, 0.5), (7, 0.5), (15, 0.3))] == [2, 4, 4]
    with pytest.raises(ValueError):
        quotas({"a": 5, "b": 1}, 0.5)
    with pytest.raises(ValueError):
        quotas({"a": 2, "b": 2, "c": 2}, 0.3)


def test_epochs(spark):
    df = spark.range(10).selectExpr("id AS row_id", "CAST(id % 3 AS int) AS partition_id")
    sampler = BatchSampler("row_id", 4, True, 7)
    first = {r["row_id"]: (r["batch_id"], r["batch_pos"]) for r in sampler.epoch(df, 0).collect()}
    assert sorted(first.values()) == sorted((i // 4, i % 4) for i in range(10))
    assert first != {r["row_id"]: (r["batch_id"], r["batch_pos"]) for r in sampler.epoch(df, 1).collect()}
    plain = [r["row_id"] for r in BatchSampler("row_id", 4, False).epoch(df).orderBy("batch_id", "batch_pos").collect()]
    assert plain == [0, 3, 6, 9, 1, 4, 7, 2, 5, 8]
    assert [b.count() for b in sampler.batches(df)] == [4, 4, 2]


def test_mode_batch(spark):
    df = spark.range(10).selectExpr("id AS row_id", "CAST(id >= 6 AS int) AS partition_id")
    sampler = BatchSampler("row_id", 7, False)
    got = sampler.mode_batch(df, "TRAIN_ID_TEST_ALL", 0.5, 1.0).collect()
    assert sorted(r["row_id"] for r in got if r["role"] == "train") == [0, 1, 2]
    assert [r["row_id"] for r in sorted(got, key=lambda r: r["batch_pos"]) if r["role"] == "test"] == [0, 1, 2, 3, 4, 5, 6]
    only = df.where("partition_id = 0")
    assert [r["role"] for r in sampler.mode_batch(only, "train_id_test_ood").collect()] == ["train"] * 6
    with pytest.raises(ValueError, match="Unknown mode"):
        sampler.mode_batch(df, "none")
