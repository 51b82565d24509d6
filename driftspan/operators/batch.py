"""Mini-batches over partitions, as batch_id and batch_pos columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspan.functions.ranking import draw, rank_by_draw, rank_by_value
from driftspan.operators.shifts import PARTITION

#: (train on out of distribution, test on in, test on out) of each mode; all train on in.
MODES = {
    "train_id_test_id": (False, True, False),
    "train_id_test_ood": (False, False, True),
    "train_id_ood_test_all": (True, True, True),
    "train_id_test_all": (False, True, True),
}


@dataclass(frozen=True)
class BatchSampler:
    """Partition 0 is in distribution, all others are not."""

    row_id: str
    batch_size: int = 32
    shuffle: bool = True
    seed: int = 0

    def epoch(self, df: DataFrame, epoch: int = 0) -> DataFrame:
        """df with batch_id and batch_pos; the last batch may be short. Shuffled anew for each epoch number."""
        if self.shuffle:
            ranked = rank_by_draw(df, self.row_id, self.seed, out="__rank", epoch=epoch)
        else:
            ranked = rank_by_value(df, self.row_id, [PARTITION], "__in")
            sizes = df.groupBy(PARTITION).agg(F.count("*").alias("__n"))
            before = sizes.select(F.col(PARTITION).alias("__p"), "__n")
            offsets = sizes.select(PARTITION).join(F.broadcast(before), F.col("__p") < F.col(PARTITION), "left").groupBy(PARTITION).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__before"))  # a row a partition
            ranked = ranked.join(F.broadcast(offsets.withColumnRenamed(PARTITION, "__q")), F.col(PARTITION) == F.col("__q")).withColumn("__rank", F.col("__in") + F.col("__before"))
        place = F.col("__rank") - 1
        return ranked.withColumn("batch_id", F.floor(place / self.batch_size).cast("bigint")).withColumn("batch_pos", (place % self.batch_size).cast("bigint")).select(*df.columns, "batch_id", "batch_pos")

    def batches(self, df: DataFrame, epoch: int = 0) -> Iterator[DataFrame]:
        """The epoch's batches as filtered views; the assigned table should be stored by the caller."""
        ranked = self.epoch(df, epoch)
        last = ranked.agg(F.max("batch_id")).first()[0]
        for i in range(0 if last is None else last + 1):
            yield ranked.where(F.col("batch_id") == i)

    def mode_batch(self, df: DataFrame, mode: str = "train_id_test_id", train_fraction: float = 1.0, test_fraction: float = 1.0, batch_size: int | None = None) -> DataFrame:
        """df's rows of one batch with role and batch_pos; a row can be in both roles.

        In and out of distribution, the first floor(n * fraction) rows are taken, the former
        first, up to batch_size a role. Without out-of-distribution rows that side is empty.
        """
        mode = mode.lower()
        if mode not in MODES:
            raise ValueError(f"Unknown mode: {mode}")
        train_ood, test_id, test_ood = MODES[mode]
        size = self.batch_size if batch_size is None else batch_size
        sided = df.withColumn("__ood", F.col(PARTITION) != 0)
        n = sided.agg(F.sum((~F.col("__ood")).cast("bigint")).alias("id"), F.sum(F.col("__ood").cast("bigint")).alias("ood")).first()
        order = [draw(self.seed, self.row_id), F.col(self.row_id)] if self.shuffle else [F.col(self.row_id)]

        def first(ood: bool, k: int, offset: int, role: str) -> DataFrame:
            """The first k rows of a side by order, as far as they fit into the batch."""
            rows = sided.where(F.col("__ood") if ood else ~F.col("__ood")).orderBy(*order).limit(max(0, min(k, size - offset)))
            place = F.row_number().over(Window.orderBy(*order)) + (offset - 1)  # a batch's rows at most
            return rows.select(*df.columns, F.lit(role).alias("role"), place.cast("bigint").alias("batch_pos"))

        parts = []
        for role, fraction, use_id, use_ood in (("train", train_fraction, True, train_ood), ("test", test_fraction, test_id, test_ood)):
            k_id = int((n["id"] or 0) * fraction) if use_id else 0
            k_ood = int((n["ood"] or 0) * fraction) if use_ood else 0
            parts += [first(False, k_id, 0, role), first(True, k_ood, k_id, role)]
        return reduce(DataFrame.unionByName, parts)
