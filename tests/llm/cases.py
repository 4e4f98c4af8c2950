"""Small documents with every awkward case, and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(7)
    base, long_text = words(rng, 60), words(rng, 6000)
    out = [
        (0, None, "en", "s1", None), (1, "", "en", "s1", 0), (2, " \t\n", "en", None, 3), (3, "One", "en", "s2", 3), (4, "one", "en", "s2", 3), (5, "a b c", "en", "s2", 5),
        (6, base, "en", "s1", len(base)), (7, base.upper(), "en", "s3", len(base)), (8, base + " tail", "en", "s3", 0), (9, base.replace(" ", "  ", 3), "de", "s1", 1),
        (10, long_text, "fr", "s4", len(long_text)), (11, long_text + " x", "fr", "s4", None), (12, "x" * 5000, "en", "s1", 5000), (13, " " * 40, "en", "s1", 40), (14, "🙂 naïve \x00 ﬁ", "en", "", 9),
        (None, "no id", "en", "s1", 5), (None, None, None, None, None), (20, "twice", "en", "s2", 5), (20, "twice", "en", "s2", 5), (-5, "negative id", "en", "s2", 11),
    ]
    return out + [(100 + i, words(rng, rng.randint(1, 80)), "en", f"s{i % 4}", 1) for i in range(60)]


def frame(spark, extra: bool = False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        for c in ("digest", "key", "size", "hash", "shard", "score", "rep", "label", "group_key", "kept", "p", "r"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
