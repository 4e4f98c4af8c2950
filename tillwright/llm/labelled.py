"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_crc


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, columns: list[str]) -> DataFrame:
    """(doc_id, y, *columns) of up to ``per_class`` rows of each label, by a hash of the id, from the
    rows with crc32(id) mod ``folds`` other than ``held_out``. Labels other than 0 and 1, null ids and
    ids whose labels contradict each other are left out; of repeated rows with one id, one is taken.
    The ids (2 * per_class at most) are broadcast to the documents."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.filter(F.col("y").isin(0, 1) & (id_crc(F.col("doc_id")) % folds != held_out))
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").select("doc_id", "y")
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = ids.filter("y = 0").orderBy(order).limit(per_class).unionByName(ids.filter("y = 1").orderBy(order).limit(per_class))
    chosen = materialize(chosen, f"ids-{label}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    found = rows.join(F.broadcast(chosen), "doc_id")
    one = Window.partitionBy("doc_id").orderBy(*columns)
    sample = found.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")
    return materialize(sample, f"sample-{label}")
