"""Training data and metrics of the row classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtspark.functions import cells as C
from stmtspark.functions import fixed


#: Bits of the hash by which the split counts rows.
SPLIT_BITS = 16


def training_rows(df: DataFrame) -> DataFrame:
    """(text, label): all but the last cell as one text, the last as the label; rows without either go."""
    text = C.row_text(F.slice("cells", F.lit(1), F.greatest(F.size("cells") - 1, F.lit(0))), " ")
    out = df.select(*[c for c in df.columns if c not in ("cells", "text", "label")], text.alias("text"), C.strip(F.get("cells", F.size("cells") - 1)).alias("label"))
    return out.filter("text <> '' AND label <> ''")


def encode_labels(df: DataFrame) -> DataFrame:
    """Rows of the five labels, with their number."""
    at = F.array_position(F.array(*[F.lit(x) for x in fixed.LABELS]), F.col("label"))
    return df.filter(F.col("label").isin(fixed.LABELS)).withColumn("label_id", (at - 1).cast("int"))


def stratified_split(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "text") -> DataFrame:
    """``df`` with is_test: an exact share of each label, by the rank of a hash; ties by the key itself.

    Rows are counted by label and the first SPLIT_BITS bits of the hash; from these counts comes the one slot of each
    label in which its share ends.  Only that slot's rows, one of 2 ** SPLIT_BITS, are ranked by a window.
    """
    t = df.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_slot", F.shiftright("_h", 64 - SPLIT_BITS))
    by = Window.partitionBy("label")
    sizes = t.groupBy("label", "_slot").agg(F.count("*").alias("n"))
    sizes = sizes.withColumns({"want": F.round(F.sum("n").over(by) * share), "upto": F.sum("n").over(by.orderBy("_slot"))})
    # the last slot of which something belongs to the share, and how much of it; one row for each label
    ends = sizes.filter(F.col("upto") - F.col("n") < F.col("want")).groupBy(F.col("label").alias("_label")).agg(F.max("_slot").alias("_end"), F.max_by(F.col("want") - F.col("upto") + F.col("n"), "_slot").alias("_rest"))
    t = t.join(F.broadcast(ends), F.col("label").eqNullSafe(F.col("_label")), "left")
    here = F.coalesce(F.col("_slot") == F.col("_end"), F.lit(False))
    sure = t.filter(~here).withColumn("is_test", F.coalesce(F.col("_slot") < F.col("_end"), F.lit(False)))
    ranked = t.filter(here).withColumn("is_test", F.row_number().over(Window.partitionBy("label").orderBy("_h", key)) <= F.col("_rest"))
    return sure.unionByName(ranked).drop("_h", "_slot", "_label", "_end", "_rest")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): balanced weights over the labels that occur."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    # one row, so the broadcast has a fixed size
    return counts.join(F.broadcast(whole)).select(label, "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def train_row_classifier(df: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """A weighted five-class text classifier over hashed words; its output column is ``label``'s name."""
    weighted = encode_labels(df).join(F.broadcast(class_weights(df).select("label", "weight")), "label").withColumn("y", F.col("label_id").cast("double"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+|(?<=\d)(?=\D)", minTokenLength=1),
        HashingTF(inputCol="words", outputCol="features", numFeatures=features),
        LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", predictionCol="label_id", maxIter=30, regParam=1e-3),
        IndexToString(inputCol="label_id", outputCol="label", labels=fixed.LABELS),
    ]
    return Pipeline(stages=stages).fit(weighted.select("text", "y", "weight"))


def evaluate(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy and support-weighted F1, from one grouped confusion table."""
    cells = pred.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("l").alias("c"), hit.alias("tp"), F.col("n").alias("support"), none.alias("claimed")), F.struct(F.col("p").alias("c"), none.alias("tp"), none.alias("support"), F.col("n").alias("claimed")))
    per = cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "claimed")])
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("claimed"))
    return per.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), (F.sum(F.col("support") * f1) / F.sum("support")).alias("f1"))
