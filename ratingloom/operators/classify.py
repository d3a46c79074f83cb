"""Like/dislike classifiers over the pair of ids."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    NaiveBayes,
    NaiveBayesModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["user_number", "item_number"]


def with_features(pairs: DataFrame, strict: bool = True) -> DataFrame:
    """Add the vector ``[user, item]``.

    Ids must be numbers; a strict run fails on others, a tolerant one leaves
    their rows out, and :func:`rejected_features` has them.
    """
    if strict:
        numbered = pairs.withColumns({f: F.col(f.split("_")[0]).cast("double") for f in FEATURES})
    else:
        numbered = pairs.withColumns({f: F.col(f.split("_")[0]).try_cast("double") for f in FEATURES})
        numbered = numbered.dropna(subset=FEATURES)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(numbered).drop(*FEATURES)


def rejected_features(pairs: DataFrame) -> DataFrame:
    """Rows that a tolerant :func:`with_features` leaves out, with the side that is no number as ``reason``."""
    user, item = (F.col(side).try_cast("double").isNull() for side in ("user", "item"))
    reason = F.when(user, "user is not a number").when(item, "item is not a number")
    return pairs.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def fit_naive_bayes(labeled: DataFrame) -> NaiveBayesModel:
    return NaiveBayes(smoothing=1.0, modelType="multinomial").fit(with_features(labeled).select("label", "features"))


def fit_forest(labeled: DataFrame, seed: int = 3) -> RandomForestClassificationModel:
    # The classifier settings that results depend on.
    forest = RandomForestClassifier(
        numTrees=5, maxDepth=5, maxBins=100, impurity="gini", featureSubsetStrategy="auto", seed=seed
    )
    return forest.fit(with_features(labeled).select("label", "features"))


def classify(model, pairs: DataFrame) -> DataFrame:
    """Add ``prediction`` (1 liked, 0 not) to ``(user, item, ...)`` rows."""
    return model.transform(with_features(pairs)).drop("features", "rawPrediction", "probability")


def naive_bayes_table(model: NaiveBayesModel, labeled: DataFrame) -> DataFrame:
    """Per class: rows, feature sums, and the fitted log-probabilities."""
    spark = labeled.sparkSession
    theta = model.theta.toArray()
    rows = [
        (float(c), float(model.pi[c]), float(theta[c][0]), float(theta[c][1])) for c in range(model.numClasses)
    ]
    fitted = spark.createDataFrame(rows, "label double, pi double, theta_user double, theta_item double")
    sums = labeled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("user").cast("bigint")).alias("sum_user"),
        F.sum(F.col("item").cast("bigint")).alias("sum_item"),
    )
    return sums.join(F.broadcast(fitted), "label")


def forest_table(model: RandomForestClassificationModel, labeled: DataFrame) -> DataFrame:
    """Shape of each fitted tree."""
    rows = [(i, t.depth, t.numNodes, float(model.treeWeights[i])) for i, t in enumerate(model.trees)]
    return labeled.sparkSession.createDataFrame(rows, "tree int, depth int, n_nodes int, weight double")


def _tree_nodes(tree: DecisionTreeClassificationModel) -> list[tuple]:
    """``(node, feature, threshold, left, right, n_zero, n_one, impurity)`` of a tree from the root, node 0, on; leaves have no feature."""
    rows, waiting = [], [tree._java_obj.rootNode()]
    for number, node in enumerate(waiting):
        counts = [float(c) for c in node.impurityStats().stats()]
        feature = threshold = left = right = None
        if node.subtreeDepth():
            feature, threshold = int(node.split().featureIndex()), float(node.split().threshold())
            left, right = len(waiting), len(waiting) + 1
            waiting += [node.leftChild(), node.rightChild()]
        # -1 stands for a leaf that no split was found for
        impurity = node.impurity() if node.impurity() >= 0 else None
        rows.append((number, feature, threshold, left, right, *(counts + [0.0])[:2], impurity))
    return rows


def forest_nodes(model: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """All nodes with their split, the sampled training rows of each class in them, and their impurity.

    Leaves that no split was found for have no impurity. The depth of the trees bounds the nodes: 63 a tree at most.
    """
    rows = [(t, *node) for t, tree in enumerate(model.trees) for node in _tree_nodes(tree)]
    kinds = "feature int, threshold double, left int, right int, n_zero double, n_one double, impurity double"
    return spark.createDataFrame(rows, f"tree int, node int, {kinds}")


def unsound_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose counts are not those of their two children together, or whose impurity is not the Gini index of the counts."""
    child = nodes.select("tree", F.col("node").alias("child"), F.col("n_zero").alias("zero"), F.col("n_one").alias("one"))
    below = nodes.select("tree", "node", F.explode(F.array("left", "right")).alias("child")).join(child, ["tree", "child"])
    below = below.groupBy("tree", "node").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    n = F.col("n_zero") + F.col("n_one")
    gini = 1 - (F.col("n_zero") ** 2 + F.col("n_one") ** 2) / (n * n)
    inner = F.col("feature").isNotNull()
    split = F.coalesce((F.col("n_zero") == F.col("zero")) & (F.col("n_one") == F.col("one")), F.lit(False))
    wrong = (inner & ~split) | (F.abs(gini - F.col("impurity")) > 1e-9)
    return nodes.join(below, ["tree", "node"], "left").where(wrong).select(*nodes.columns)


def with_leaves(model: RandomForestClassificationModel, pairs: DataFrame) -> DataFrame:
    """Add ``leaves``, the node of each tree that a row ends in, and ``liked_share``, the trees' mean share of liked rows there.

    The trees become conditional expressions of at most 32 branches, so rows are routed without a model.
    """
    leaves, shares = [], []
    for tree in model.trees:
        nodes = {n[0]: n[1:] for n in _tree_nodes(tree)}

        def ends(node: int, value, nodes=nodes) -> Column:
            feature, threshold, left, right, zero, one, _ = nodes[node]
            if feature is None:
                return F.lit(value(node, zero, one))
            below = F.col(FEATURES[feature].split("_")[0]).cast("double") <= F.lit(threshold)
            return F.when(below, ends(left, value, nodes)).otherwise(ends(right, value, nodes))

        leaves.append(ends(0, lambda node, zero, one: node))
        shares.append(ends(0, lambda node, zero, one: one / (zero + one)))
    total = shares[0]
    for share in shares[1:]:
        total = total + share
    return pairs.withColumns({"leaves": F.array(*leaves), "liked_share": total / F.lit(float(len(shares)))})


def chi_square_features(labeled: DataFrame) -> DataFrame:
    """Chi-square statistic of each id against the label.

    Computed from one count per id value, so it takes any number of values
    (the ML test stops at 10,000). ``z_score`` is the Wilson-Hilferty normal
    equivalent; the statistic is null where all labels are equal.
    """
    values = labeled.select(
        F.explode(
            F.array(
                F.struct(F.lit("user").alias("feature"), F.col("user").cast("string").alias("value")),
                F.struct(F.lit("item").alias("feature"), F.col("item").cast("string").alias("value")),
            )
        ).alias("f"),
        "label",
    )
    per_value = values.groupBy("f.feature", "f.value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("liked")
    )
    sums = per_value.groupBy("feature").agg(
        (F.count(F.lit(1)) - 1).alias("degrees_of_freedom"),
        F.sum("n").alias("n"),
        F.sum("liked").alias("liked"),
        F.sum(F.col("liked") * F.col("liked") / F.col("n")).alias("between"),
    )
    rate = F.col("liked") / F.col("n")
    statistic = F.try_divide(F.col("between") - F.col("liked") * rate, rate * (1 - rate))
    dof = F.col("degrees_of_freedom")
    spread = F.lit(2.0) / (dof * 9)
    z = F.when(dof > 0, (F.pow(F.col("statistic") / dof, F.lit(1.0 / 3)) - (1 - spread)) / F.sqrt(spread))
    return (
        sums.withColumn("statistic", statistic)
        .select("feature", "degrees_of_freedom", "statistic", z.alias("z_score"))
    )
