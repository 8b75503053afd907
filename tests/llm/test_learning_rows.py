"""The learning rows of the quality classifier."""

from pyspark.sql import functions as F

from glyphlake.llm import quality


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    # a size at which the hash filter leaves more rows than the bound
    total = 4000
    place = F.pmod(F.xxhash64(F.lit(quality.SEED), "_id"), F.lit(1 << 30))
    known = spark.range(total).select(F.col("id").alias("_id"), (F.col("id") % 2).cast("double").alias("label")).cache()
    size = next(n for n in range(900, 1100) if known.filter(place < n / total * (1 << 30)).count() > n)
    orders = known.repartition(7), known.orderBy(F.desc("_id")), known.orderBy("_id")
    first, *others = [{r["_id"] for r in quality.learning_rows(rows, total, size).collect()} for rows in orders]
    assert len(first) == size and all(first == other for other in others)
