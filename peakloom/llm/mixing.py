"""Mixing sources to target weights: random order by hash, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words are runs of other characters than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in code point order, null last, over and over.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: Hex digits of the random key that name a range of it; 16**3 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets from (src, source_size), a row per source: shares of all sizes by weight, none above most_epochs times its size.

    What a capped source leaves is shared again by weight. Sorted by cap over
    weight, the capped ones come first, so one running sum finds the level at
    which sharing stops. Sources are the mixture's few configured inputs.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("src"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    by_ratio = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    free = lambda c: F.sum(F.when(~F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.col("ratio") <= level)
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - held) / free("weight")))
        .select("src", "source_size", "target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """How many words the mix takes of every document: doc_id, text_a (a hash of the text), size, source_size, target, taken, copies.

    Each document gets a key md5(seed:id:size). Within its source documents
    stand in key order; whole epochs come first, then the order is cut exactly
    at what is left of the budget floor(target), the document on the cut giving
    a part of its words. copies counts the epochs that the document is in.
    Null text: size 0. Null source: a source of its own, last. Repeated rows
    each count. Equal keys are ordered by id, size and text_a; rows equal in all
    are interchangeable. An empty input gives an empty result.

    The key's leading digits split a source into ranges, so a hot source is
    summed in 4096 pieces: partial sums a range, a running sum over ranges, and
    a window within each range.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_a"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    keyed = written(
        sized.withColumn("key", key).withColumn("part", F.substring("key", 1, RANGE_DIGITS)).select("doc_id", "text_a", "src", "size", "key", "part"),
        "mix-keys",
    )
    parts = keyed.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("before"))
    targets = source_targets(keyed.groupBy("src").agg(F.sum("size").alias("source_size")))
    within = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", "text_a").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start")))
    return (
        keyed.withColumn("upto", F.sum("size").over(within))
        .join(parts, ["src", "part"])
        .join(targets, "src")
        .withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("left", budget - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id", "text_a", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"),
            (F.col("epochs") + F.when(rest > 0, 1).otherwise(0)).cast("int").alias("copies"),
        )
    )
