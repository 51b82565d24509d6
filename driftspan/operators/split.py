"""Exact train/test splits over partitions, as role and is_ood columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.functions.ranking import rank_by_draw
from driftspan.operators.shifts import PARTITION

#: Most strata that a split takes; their sizes pass through the driver.
MAX_STRATA = 100_000


def take_count(ratio: float, n: int) -> int:
    """ratio * n rounded half to even."""
    return round(ratio * n)


def quotas(sizes: dict, ratio: float) -> dict:
    """Rows to draw of each class so that floor(ratio * total) rows are drawn: largest remainders, ties by class.

    ValueError for a ratio outside (0, 1), a class of one row, or sides smaller than the number of classes.
    """
    if not 0 < ratio < 1:
        raise ValueError(f"ratio {ratio} is not between 0 and 1")
    total = sum(sizes.values())
    lone = [c for c, n in sizes.items() if n < 2]
    if lone:
        raise ValueError(f"classes with a single row cannot be stratified: {sorted(map(str, lone))}")
    wanted = math.floor(ratio * total)
    if wanted < len(sizes) or total - wanted < len(sizes):
        raise ValueError(f"{wanted} of {total} rows cannot hold all {len(sizes)} classes on either side")
    exact = {c: Fraction(wanted * n, total) for c, n in sizes.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    for c in sorted(sizes, key=lambda c: (out[c] - exact[c], c))[: wanted - sum(out.values())]:
        out[c] += 1
    return out


@dataclass(frozen=True)
class TrainTestSplitter:
    """Modes: 0 trains and tests in distribution, 1 tests out of it, 2 tests on both, 3 trains and tests on both.

    id_partitions None or empty: all partitions, found when split. Ids named twice count once.
    """

    row_id: str
    target: str | None = None
    mode: int = 0
    train_ratio: float = 0.7
    test_ratio: float = 0.3
    id_partitions: tuple[int, ...] | None = None
    ood_partitions: tuple[int, ...] = ()
    stratify: bool = True
    seed: int = 0

    def membership(self) -> tuple[Column, Column]:
        """Whether a row is in distribution, and whether out of it (a partition can be named in both)."""
        p = F.col(PARTITION)
        is_id = p.isin(list(self.id_partitions)) if self.id_partitions else p.isNotNull()
        return is_id, p.isin(list(self.ood_partitions)) if self.ood_partitions else F.lit(False)

    def split(self, df: DataFrame) -> DataFrame:
        """df with is_ood and role (train, test, unused). One aggregate of strata sizes, then lazy."""
        if self.mode not in (0, 1, 2, 3):
            raise ValueError(f"Unknown mode: {self.mode}")
        if self.stratify and self.target is None:
            raise ValueError("a stratified split needs a target")
        is_id, is_ood = self.membership()
        # a partition named on both sides belongs to the out-of-distribution side
        marked = df.withColumn("is_ood", F.coalesce(is_ood, F.lit(False))).withColumn("__used", F.coalesce(is_id | is_ood, F.lit(False)))
        stratum = F.col(self.target) if self.stratify else F.lit(0)
        side = F.when(~F.col("__used"), -1).when(F.col("is_ood") & F.lit(self.mode != 3), 1).otherwise(0)
        marked = marked.withColumn("__side", side).withColumn("__stratum", stratum)
        sizes = marked.where("__used").groupBy("__side", "__stratum").agg(F.count("*").alias("n")).limit(MAX_STRATA + 1).collect()
        if len(sizes) > MAX_STRATA:
            raise ValueError(f"more than {MAX_STRATA} strata")
        plan = self._plan({s: {r[1]: r[2] for r in sizes if r[0] == s} for s in (0, 1)})
        schema = f"__s int, __y {marked.schema['__stratum'].dataType.simpleString()}, __train bigint, __test bigint"
        limits = df.sparkSession.createDataFrame(plan, schema)
        ranked = rank_by_draw(marked, self.row_id, self.seed, ["__side", "__stratum"], "__rank")
        joined = ranked.join(F.broadcast(limits), F.col("__side").eqNullSafe(F.col("__s")) & F.col("__stratum").eqNullSafe(F.col("__y")), "left")  # MAX_STRATA rows at most
        role = F.when(F.col("__rank") <= F.col("__train"), "train").when(F.col("__rank") <= F.col("__train") + F.col("__test"), "test").otherwise("unused")
        return joined.withColumn("role", role).select(*df.columns, "is_ood", "role")

    def _plan(self, sizes: dict[int, dict]) -> list[tuple]:
        """(side, stratum, rows to train, rows to test after them)."""

        def sample(of: dict, ratio: float) -> dict:
            of = {c: n for c, n in of.items() if n}
            if not of:
                return {}
            return quotas(of, ratio) if self.stratify else {0: take_count(ratio, of[0])}

        train = sample(sizes[0], self.train_ratio)
        rest = {c: n - train.get(c, 0) for c, n in sizes[0].items()}
        if self.mode == 3:
            test = rest
        else:
            test = sample(rest, self.test_ratio) if self.mode in (0, 2) else {}
        ood = sample(sizes[1], self.test_ratio) if self.mode in (1, 2) else {}
        return [(0, c, train.get(c, 0), test.get(c, 0)) for c in sizes[0]] + [(1, c, 0, ood.get(c, 0)) for c in sizes[1]]


def split_counts(split: DataFrame) -> DataFrame:
    """(role, is_ood, n): the sizes of the four index sets and of the unused rows."""
    return split.groupBy("role", "is_ood").agg(F.count("*").alias("n"))


def views(split: DataFrame) -> dict[str, DataFrame]:
    """train_id, train_ood, test_id and test_ood as filtered views."""
    return {f"{role}_{side}": split.where((F.col("role") == role) & (F.col("is_ood") == (side == "ood"))) for role in ("train", "test") for side in ("id", "ood")}
