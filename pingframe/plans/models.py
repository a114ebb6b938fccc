"""Queries over items, features and fitted filters."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pingframe.plans.registry import query
from pingframe.plans.views import table, view

PARTS = ["score", "anomaly", "shadow"]


@query("ras15_false_positive_filter")
def ras15(spark, d):
    """(doc_id, fold, keep): boosted trees over the score parts, out of fold by group: each half is rated by the other half's trees."""
    rows = VectorAssembler(inputCols=PARTS, outputCol="x").transform(view(spark, d, "v_scored").withColumn("fold", F.pmod(F.xxhash64("grp"), F.lit(2)).cast("int")).withColumn("y", F.col("label").cast("double")))
    out = None
    for fold in (0, 1):
        learned, rated = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=7).fit(learned)
        part = model.transform(rated).select("doc_id", "fold", F.round(vector_to_array("probability")[1], 4).alias("keep"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ras22_training_table", "SELECT l.doc_id, l.quality AS label, n_chars, length(text) - length(replace(text, chr(10), '')) AS breaks, round(l.toxic * 0.5e0 + l.quality * 0.25e0, 6) AS rating FROM documents d JOIN labels l USING (doc_id)")
def ras22(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    breaks = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long")
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("label"), "n_chars", breaks.alias("breaks"), F.round(F.col("toxic") * 0.5 + F.col("quality") * 0.25, 6).alias("rating"))


@query("snk16_split_class_counts", "SELECT split, dataset, count(*) AS n, CAST(sum(objects) AS BIGINT) AS objects FROM v_item GROUP BY split, dataset", "v_item")
def snk16(spark, d):
    return view(spark, d, "v_item").groupBy("split", "dataset").agg(F.count("*").alias("n"), F.sum("objects").alias("objects"))


@query("snk17_migrated_union", "SELECT s_suppkey AS id, s_name AS name, 0 AS version FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer")
def snk17(spark, d):
    """Rows of an older and a newer schema in one table; columns that the older one lacks are filled."""
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("version"))
    return old.unionByName(new, allowMissingColumns=True).select("id", "name", F.coalesce("version", F.lit(0)).alias("version"))


@query("src25_tile_pools", "SELECT vec_id, CASE WHEN label IN (3, 7) THEN 'holdout' ELSE 'train' END AS pool, least(greatest(vec_id % 300 - 128, 0), 44) AS crop_x FROM embeddings")
def src25(spark, d):
    pool = F.when(F.col("label").isin(3, 7), "holdout").otherwise("train")
    return table(spark, d, "embeddings").select("vec_id", pool.alias("pool"), F.least(F.greatest(F.col("vec_id") % 300 - 128, F.lit(0)), F.lit(44)).alias("crop_x"))
