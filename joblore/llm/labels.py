"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int | None = None) -> DataFrame:
    """(doc_id, label, weight, text): at most per_class labelled documents of each class, least hash of
    the id first, and none whose id has the held-out remainder. Of several labels of a document the
    greatest counts; null labels don't. weight: how many labelled documents of its class a sampled one
    stands for. The ids are at most 2 * per_class, so they are broadcast. With most_bytes each class has
    only as many texts, in that order, as half of it holds, but one at least."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), parts) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    some = [rows.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    counts = rows.groupBy("label").agg(F.count("*").alias("weight")).select("label", F.greatest(F.col("weight") / per_class, F.lit(1.0)).alias("weight"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = some[0].unionByName(some[1]).join(F.broadcast(counts), "label")
    out = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "weight", "text")
    if most_bytes is not None:
        own, order = W.partitionBy("label"), [F.xxhash64("doc_id"), "doc_id"]
        size = out.groupBy("doc_id", "label").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))  # bounded, as the ids are
        size = size.withColumns({"upto": F.sum("size").over(own.orderBy(*order)), "place": F.row_number().over(own.orderBy(*order)), "n": F.count("*").over(own)})
        kept = size.filter((F.col("upto") <= most_bytes // 2) | (F.col("place") == 1)).withColumn("share", F.count("*").over(own) / F.col("n"))
        out = out.join(F.broadcast(kept.select("doc_id", "share")), "doc_id").select("doc_id", "label", (F.col("weight") / F.col("share")).alias("weight"), "text")
    return out
