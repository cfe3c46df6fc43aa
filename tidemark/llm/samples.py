"""Bounded, deterministic training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of one label's rows that are ranked by themselves.
PARTS = 256


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))


def sample_texts(docs: DataFrame, labelled: DataFrame, per_class: int, max_bytes: int, id_col: str, text_col: str) -> list[tuple]:
    """(label, text) of `per_class` documents with text of each label, or of all that there are.

    `labelled` has the columns id and label, one row an id. Documents without
    text take no place. Those of at most `max_bytes` come before longer ones,
    and among either those whose ids hash lowest; of a longer one `max_bytes`
    characters from its middle are taken, so that a label of long documents only
    is learned as well. Ids are chosen from narrow rows; only the chosen ones,
    few by their bound, are broadcast to fetch texts. Of several texts of an id
    the one that comes first in this order, then in that of texts, counts.
    """
    size = F.octet_length("text")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(size > 0).withColumn("long", size > max_bytes)
    usable = texts.groupBy("id").agg(F.min("long").alias("long"))
    order = ["long", F.xxhash64("id"), "id"]
    chosen = labelled.where("id is not null and label is not null").join(usable, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    for by in (["label", "part"], ["label"]):  # a label's rows are cut down in parts before they come together
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= per_class)
    chosen = chosen.select("id", "label", "long")
    middle = F.when(F.col("long"), F.substring(F.col("text"), F.greatest(F.lit(1), ((F.length("text") - max_bytes) / 2).cast("int") + 1), F.lit(max_bytes))).otherwise(F.col("text"))
    rows = (
        texts.join(F.broadcast(chosen), ["id", "long"])
        .groupBy("label", "id")
        .agg(F.min(middle).alias("text"))  # one text an id, however often it is repeated
        .toArrow()
        .sort_by([("label", "ascending"), ("id", "ascending"), ("text", "ascending")])
    )
    return list(zip(rows["label"].to_pylist(), rows["text"].to_pylist()))
