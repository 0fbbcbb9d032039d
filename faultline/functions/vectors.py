"""Vector helpers on ARRAY<FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    def scaled(vector: Column) -> Column:
        return bind(
            norm(vector),
            lambda length: F.transform(
                vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x).cast("float")
            ),
        )

    return bind(a, scaled)


def slots(text: Column, dims: int) -> Column:
    """The slot of every word: the first eight digits of its MD5, modulo ``dims``. Placeholders are no words."""
    words = F.filter(F.split(F.lower(text), r"<[a-z]+>|[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int"))


def hashed_embedder(dims: int):
    """Default embedder (C5): adds ``embedding`` to templates (``log_id, ordinal, template``).

    A word's weight is the square root of its count times ``ln((1 + n) / (1 + d)) + 1`` for the n templates of its log
    and the d of them that hold its slot; vectors have unit length, and a template without words the zero vector.
    """

    def embed(templates: DataFrame) -> DataFrame:
        keys = ["log_id", "ordinal"]
        counts = templates.select(*keys, F.explode(slots(F.col("template"), dims)).alias("slot"))
        counts = counts.groupBy(*keys, "slot").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))
        held = counts.groupBy("log_id", "slot").agg(F.count(F.lit(1)).alias("d"))
        sizes = templates.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
        rarity = held.join(sizes, "log_id").select("log_id", "slot", (F.log((1 + F.col("n")) / (1 + F.col("d"))) + 1).alias("rarity"))
        weighed = counts.join(rarity, ["log_id", "slot"])
        # a template has as many entries as words, and its text a limited length
        entry = F.struct("slot", (F.col("weight") * F.col("rarity")).alias("weight"))
        sparse = weighed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_weights"))
        dense = F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)), lambda slot: F.coalesce(F.element_at("_weights", slot), F.lit(0.0))
        )
        return templates.join(sparse, keys, "left").withColumn("embedding", unit(dense)).drop("_weights")

    return embed
