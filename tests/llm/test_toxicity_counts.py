"""All training labels teach the model that scores."""

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import toxicity


def test_words_of_the_held_fifth_count(spark):
    plain = "the cat sat on the mat and looked at the dog"
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("held"),
    ).withColumn("text", F.when(F.col("toxic") == 0, plain).when(F.col("held"), f"{plain} zqxjvk zqxjvk").otherwise(f"{plain} bwpfgy bwpfgy"))
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    grams, _ = toxicity.grams_of([f"{plain} zqxjvk zqxjvk", f"{plain} bwpfgy bwpfgy"])
    assert not np.isnan(model.grams[grams % toxicity.GRAM_SLOTS]).any()
