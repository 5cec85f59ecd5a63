"""A training corpus in five stages over `documents`.

Documents whose language can't be told go, one of each group of near copies
stays, benchmark leaks go, sources are mixed to their targets (documents are
repeated), and what is left is dealt to shards.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm import decontaminate
from peakloom.llm.common import if_small, table, written
from peakloom.llm.langid import UNDETERMINED, identify
from peakloom.llm.mixing import mix
from peakloom.llm.ngramjoin import SIMILAR, WORDS, jaccard_groups, text_hash
from peakloom.llm.sharding import shard
from peakloom.session import shipping, small_batches

#: A prediction below this score counts as none; chance alone gives 1 / languages.
LEAST_SCORE = 0.3
#: Near copies in the pipeline: words in a shingle and the similarity in hundredths.
NEAR_WORDS, NEAR_SIMILAR = 5, 80
SHARDS = 16


@shipping
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without text or letters and those whose language stays a guess.

    Every row is judged by its text alone; rows may repeat or have no id. An empty table, or one without any known language, gives an empty one.
    """
    small_batches(spark)
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    known = identify(rows, carry=("row",)).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.select("row.*")


@shipping
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Keep one document of each component of links, that with the smallest id (null last; then by a hash of the text); the defaults are the join's own, STAGES has the pipeline's.

    Rows equal in id and text are one document, of which one row stays. Rows
    that share an id but not their text are different documents. Texts without
    words are no copies of each other and stay, null and empty ones alike. An
    empty table gives an empty one. Other columns, whatever their names, pass.
    """
    small_batches(spark)
    found = written(jaccard_groups(docs, words=words, similar=similar).select("doc_id", "text_a", "comp"), "pipeline-groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a")
    least = found.filter("comp is not null").groupBy("comp").agg(F.min(place).alias("least"))
    lost = found.join(least, "comp").filter(place != F.col("least")).select("doc_id", "text_a").distinct()
    again = found.filter("comp is not null").groupBy("doc_id", "text_a").count().filter("count > 1").select("doc_id", "text_a")
    left = _matching(docs, written(lost, "pipeline-lost"), "left_anti")
    again = written(again, "pipeline-again")
    if again.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy("doc_id", text_hash(F.col("text"))).orderBy(F.xxhash64(*docs.columns)))
    one = _matching(left, again, "left_semi").withColumn("_place", first).filter("_place = 1")
    return _matching(left, again, "left_anti").unionByName(one.select(*docs.columns)).select(*docs.columns)


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined on id and text with a written table (doc_id, text_a, ...)."""
    named = rows.withColumnsRenamed({"doc_id": "_of_id", "text_a": "_of_text"})
    return docs.join(if_small(named), docs["doc_id"].eqNullSafe(named["_of_id"]) & (text_hash(docs["text"]) == named["_of_text"]), how)


@shipping
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak an item of `benchmark`.

    Null, empty and short texts leak nothing and stay; so do all if there are
    no items. Every row is judged by its text alone, whatever its id or other
    columns; copies of a leak all go.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@shipping
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: the one on a source's cut counts whole too.

    Documents without words go with whole epochs only. A null source is a source
    of its own. Rows equal in id and text are interchangeable: what the mix
    takes of all of them is dealt to them as evenly as it goes. Null ids are
    told apart by their texts. An empty table gives an empty one.
    """
    copies = mix(docs).groupBy("doc_id", "text_a").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    copies = written(copies.filter("_copies > 0"), "pipeline-copies")
    one, several = (_matching(docs, copies.filter(c), "inner") for c in ("_rows = 1", "_rows > 1"))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    if copies.filter("_rows > 1").isEmpty():
        return one.withColumn("_copy", repeats).select(*docs.columns)
    place = F.row_number().over(Window.partitionBy("_of_id", "_of_text").orderBy(F.xxhash64(*docs.columns)))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("long")
    several = several.withColumn("_place", place).withColumn("_copies", share).filter("_copies > 0")
    both = one.select(*docs.columns, "_copies").unionByName(several.select(*docs.columns, "_copies"))
    return both.withColumn("_copy", repeats).select(*docs.columns)


@shipping
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row, repeats included, so that shards have nearly equal bytes.

    Null texts weigh one byte. Rows with equal texts are a group and dealt like
    others; ties are broken by hash. An empty table gives an empty one.
    """
    return shard(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", partial(ngram_jaccard_join, words=NEAR_WORDS, similar=NEAR_SIMILAR)),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: Neither the kernels' predictions nor the hashes that deal to shards can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
