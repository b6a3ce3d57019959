"""The bounded sample of labelled documents from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, text, label, order) of at most ``max_rows`` labelled documents outside the held-out fold.

    The sample takes the smallest hashes of the ids, so it is the same in every run.  Ids are drawn from
    the label table alone; the documents are then met by an equi-join with at most ``max_rows`` ids.
    Null ids and null labels are passed over; of several labels for an id the largest counts.
    """
    drawn = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col, modulus) != held_out))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id")
        .limit(max_rows)
    )
    return docs.select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(drawn), "_id")
