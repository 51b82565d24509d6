"""Small corpora with the cases that every operator must handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = ["id", "t", "n", "key", "h", "rep", "comp", "v", "r", "c", "a", "b", "doc", "words", "row", "score", "gone"]


def words(r: random.Random, n: int, size: int = 300) -> list[str]:
    return [f"w{r.randrange(size)}" for _ in range(n)]


def corpus(seed: int = 0) -> list[tuple]:
    """Null and empty texts, exact and near copies, shared passages, a long text, junk, a null id, a repeated row."""
    r = random.Random(seed)
    base = words(r, 120)
    passage = words(r, 70)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "two words", " ".join(base)]
    texts += [" ".join(base).upper(), " ".join(base)]
    for _ in range(6):
        near = list(base)
        near[r.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    for _ in range(5):
        texts.append(" ".join(words(r, 40) + passage + words(r, 30)))
    texts.append(" ".join(words(r, 5000)))
    texts.append("be " * 200 + "\n" + "no " * 10)
    texts.append("be " * 90)
    texts.append("Ünï été 日本 🙂 ÀÉ a\x00b")
    texts += [" ".join(words(r, r.randrange(3, 150))) for _ in range(12)]
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, rows[3], (None, " ".join(base), "en", "s", 0)]


def frame(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in CLASHING:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit(1))
    return df.repartition(3)


def store(df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)
