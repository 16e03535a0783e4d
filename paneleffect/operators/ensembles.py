"""Fitted tree ensembles as a table of nodes, and rows sent down them with columns alone."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffect.functions.skew import durable, shared_folder
from paneleffect.operators.encode import FEATURES

LEAVES = "leaves"


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The node table of a stored pipeline whose last stage is a boosted ensemble.

    One row per node: tree, weight, node (the root is 1, the children of n are 2n and 2n + 1), position of
    the feature and threshold of an inner node (rows not above it go left; of a feature known to be a category,
    the ``left_values`` do, and there is no threshold), value of a leaf, the number of training ``rows`` and
    the fall of the squared error by the split (``gain``). Its size is that of the model.
    """
    stages = f"{path.rstrip('/')}/stages/*"
    kept = spark.read.parquet(f"{stages}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{stages}/treesMetadata").toDF("treeID", "metadata", "weight").select("treeID", "weight")
    flat = durable(
        kept.join(F.broadcast(weights), "treeID").select(
            F.col("treeID").cast("bigint").alias("tree"), "weight", "id", "leftChild", "rightChild", F.col("prediction").alias("value"), F.col("rawCount").alias("rows"),
            F.col("split.featureIndex").alias("position"), F.when(F.col("split.numCategories") < 0, F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
            F.when(F.col("split.numCategories") >= 0, F.array_sort("split.leftCategoriesOrThreshold")).alias("left_values"), (F.col("gain") * F.col("rawCount")).alias("gain"),
        )
    )
    level, out = flat.where("id = 0").withColumn("node", F.lit(1).cast("bigint")), None
    while True:
        level = durable(level)
        if level.isEmpty():
            return out
        out = level if out is None else out.unionByName(level)
        inner = level.where("leftChild >= 0")
        sides = F.array(F.struct(F.col("leftChild").alias("id"), (2 * F.col("node")).alias("node")), F.struct(F.col("rightChild").alias("id"), (2 * F.col("node") + 1).alias("node")))
        below = inner.select("tree", F.explode(sides).alias("s")).select("tree", "s.*")
        level = flat.join(below, ["tree", "id"])


def nodes(model: PipelineModel, labels: Sequence[str], scales: Sequence[float] | None = None) -> DataFrame:
    """``stored_nodes`` of a fitted pipeline, with the names of the features; thresholds in the features' own units
    where the scaler's deviations are given. Leaves have no feature, inner nodes no value."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/ensemble-{uuid4().hex}"
    model.write().save(path)
    table = stored_nodes(spark, path)
    inner = F.col("leftChild") >= 0
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("position") + 1)
    scale = F.element_at(F.array(*[F.lit(float(x)) for x in scales]), F.col("position") + 1) if scales is not None else F.lit(1.0)
    return table.select(
        "tree",
        "weight",
        "node",
        F.when(inner, F.col("position")).alias("position"),
        F.when(inner, name).alias("feature"),
        F.when(inner, F.col("threshold") * scale).alias("threshold"),
        F.when(inner, F.col("threshold")).alias("scaled_threshold"),
        F.when(inner, F.col("left_values")).alias("left_values"),
        F.when(inner, 2 * F.col("node")).alias("left_node"),
        F.when(inner, 2 * F.col("node") + 1).alias("right_node"),
        F.when(~inner, F.col("value")).alias("value"),
        "rows",
        F.when(inner, F.col("gain")).alias("gain"),
    )


def _forest(table: DataFrame) -> DataFrame:
    """One row: the trees, in order, each an array of its nodes by number."""
    slots = F.struct("position", F.col("scaled_threshold").alias("threshold"), "left_values", "value")
    by_node = table.groupBy("tree", "weight").agg(F.map_from_entries(F.collect_list(F.struct("node", slots.alias("at")))).alias("m"), F.max("node").alias("last"))
    # An array finds a node by its number at once; a map would look at each in turn.
    dense = by_node.select("tree", "weight", F.transform(F.sequence(F.lit(1).cast("bigint"), "last"), lambda i: F.try_element_at("m", i)).alias("at"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "at"))).alias("forest"))


def add_leaves(df: DataFrame, table: DataFrame, features: str = FEATURES) -> DataFrame:
    """Add ``leaves``: per tree, in order, the tree, its weight, the leaf the row ends in, and its value.

    The ensemble is one broadcast row, bounded by the model's size (trees times nodes of a tree); nothing is
    shuffled and no row is repeated.
    """
    depth = int(table.agg(F.coalesce(F.max(F.floor(F.log2("node"))), F.lit(0))).first()[0])

    def down(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            at = F.element_at(tree["at"], node.cast("int"))
            x = F.element_at(F.col("_x"), at["position"] + 1)
            right = F.coalesce(x > at["threshold"], ~F.array_contains(at["left_values"], x))
            return F.when(at["position"].isNull(), node).otherwise(2 * node + F.when(right, 1).otherwise(0))

        last = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(1).cast("bigint"), step)
        return F.struct(tree["tree"].alias("tree"), tree["weight"].alias("weight"), last.alias("node"))

    def valued(tree: Column) -> Column:
        way = down(tree)
        return F.struct(way["tree"].alias("tree"), way["weight"].alias("weight"), way["node"].alias("node"), F.element_at(tree["at"], way["node"].cast("int"))["value"].alias("value"))

    joined = df.withColumn("_x", vector_to_array(features)).crossJoin(F.broadcast(_forest(table)))
    return joined.withColumn(LEAVES, F.transform("forest", valued)).drop("_x", "forest")


def walked_prediction(leaves: str = LEAVES) -> Column:
    return F.aggregate(leaves, F.lit(0.0), lambda total, leaf: total + leaf["weight"] * leaf["value"])


def leaf_report(df: DataFrame, label: str, leaves: str = LEAVES) -> DataFrame:
    """Per tree and leaf, over the rows a fit was made on: how many, their mean target and the leaf's value.

    The first tree's target is the label, a further one's twice what the trees before it leave over. Of all
    values of a leaf the mean target has the least squared error, so ``value`` must equal it.
    """
    y = F.col(label).cast("double")
    start = F.struct(F.lit(0.0).alias("before"), F.array().cast("array<struct<tree: bigint, node: bigint, value: double, target: double>>").alias("out"))

    def add(state: Column, leaf: Column) -> Column:
        target = F.when(leaf["tree"] == 0, y).otherwise(2 * (y - state["before"]))
        one = F.struct(leaf["tree"].alias("tree"), leaf["node"].alias("node"), leaf["value"].alias("value"), target.alias("target"))
        return F.struct((state["before"] + leaf["weight"] * leaf["value"]).alias("before"), F.array_append(state["out"], one).alias("out"))

    each = df.select(F.explode(F.aggregate(leaves, start, add, lambda state: state["out"])).alias("s")).select("s.*")
    return each.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("rows"), F.avg("target").alias("mean_target"), F.first("value").alias("value"))
