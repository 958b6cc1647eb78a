"""Whitening, calibration, classifiers, folds, augmentation and bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_whitening(vectors: DataFrame, *, column: str = "embedding", dim: int, power: float = 0.5) -> dict[str, np.ndarray]:
    """Mean and projection from the covariance, which Spark sums (dimension squared numbers) and the driver decomposes."""
    numbered = vectors.select(F.posexplode(F.transform(column, lambda x: x.cast("double"))).alias("i", "x"), F.col(column).alias("v"))
    sums = numbered.groupBy("i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), *[F.sum(F.col("x") * F.get("v", F.lit(j)).cast("double")).alias(f"c{j}") for j in range(len(vectors.select(column).first()[0]))]).orderBy("i").collect()
    n, mean = sums[0]["n"], np.array([r["m"] for r in sums])
    if n <= dim:
        raise ValueError(f"{n} vectors are too few for {dim} dimensions")
    cov = np.array([[r[f"c{j}"] for j in range(len(sums))] for r in sums]) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:dim]
    scale = np.maximum(np.sqrt(np.maximum(values[order], 0)), 1e-12) ** power
    return {"mean": mean, "projection": axes[:, order] / scale}


def whiten(column: Column, model: dict[str, np.ndarray]) -> Column:
    """Centred, projected and of unit length, as built-in expressions."""
    from tessera.functions.linalg import dot, unit

    centred = F.zip_with(column, F.array(*[F.lit(float(x)) for x in model["mean"]]), lambda v, m: v.cast("double") - m)
    return unit(F.array(*[dot(centred, F.array(*[F.lit(float(x)) for x in axis])) for axis in model["projection"].T]))


def save_whitening(spark, model: dict[str, np.ndarray], path: str) -> None:
    spark.createDataFrame([(model["mean"].tolist(), model["projection"].tolist())], "mean array<double>, projection array<array<double>>").write.mode("overwrite").parquet(path)


def load_whitening(spark, path: str) -> dict[str, np.ndarray]:
    r = spark.read.parquet(path).first()
    return {"mean": np.array(r["mean"]), "projection": np.array(r["projection"])}


def fit_platt(rows: DataFrame, *, probability: str = "probability", label: str = "label") -> tuple[float, float]:
    """(weight, bias) of sigmoid(weight * logit(p) + bias)."""
    from tessera.functions.linalg import logit

    data = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(rows.select(logit(F.col(probability)).alias("_x"), F.col(label).cast("double").alias("_y")))
    m = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, tol=1e-9, maxIter=200).fit(data)
    return float(m.coefficients[0]), float(m.intercept)


def balanced_weight(label: str) -> Column:
    """Weights under which both labels count alike."""
    n = F.count("*").over(Window.partitionBy())
    return n / (2 * F.count("*").over(Window.partitionBy(label)))


def fit_classifier(rows: DataFrame, features: list[str], *, label: str = "label", kind: str = "gbt", monotone: bool = False, **options):
    """(assembler, model). kind: gbt, or lr; monotone bounds the coefficients of lr from below by 0."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    shares = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row for each label
    total = sum(shares.values())
    weight = F.lit(1.0)
    for v, n in shares.items():
        weight = F.when(F.col(label) == v, total / (2 * n)).otherwise(weight)
    data = assembler.transform(rows.withColumn("_w", weight))
    if kind == "gbt":
        model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="_w", seed=1, **options).fit(data)
    else:
        from pyspark.ml.linalg import Matrices

        lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", **options)
        if monotone:
            lr = lr.setLowerBoundsOnCoefficients(Matrices.dense(1, len(features), [0.0] * len(features)))
        model = lr.fit(data)
    return assembler, model


def preference_pairs(rows: DataFrame, features: list[str], *, hard_weight: float = 3.0) -> DataFrame:
    """Pairs (positive, negative) of a query as feature differences; hard ones (same family, or well ranked) weigh more."""
    a, b = rows.where("label = 1").alias("a"), rows.where("label = 0").alias("b")
    hard = (F.col("a.family") == F.col("b.family")) | (F.least(F.col("b.vis_rank"), F.col("b.txt_rank")) < 5)
    diff = [(F.col(f"a.{f}") - F.col(f"b.{f}")).alias(f) for f in features]
    return a.join(b, F.col("a.query_id") == F.col("b.query_id")).select(F.col("a.query_id").alias("query_id"), *diff, F.when(hard, hard_weight).otherwise(1.0).alias("weight"))


def with_unknowns(rows: DataFrame, true_id: str = "true_id") -> DataFrame:
    """Adds a copy of each query without its true row, under a new query id; derive features afterwards."""
    copy = rows.where(~F.col("item_id").eqNullSafe(F.col(true_id))).withColumn("query_id", F.concat(F.lit("unknown:"), F.col("query_id").cast("string")))
    return rows.withColumn("query_id", F.col("query_id").cast("string")).unionByName(copy)


def fold(key: Column, folds: int, seed: int = 0) -> Column:
    """Fold of a group key: the same wherever and whenever it is computed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def balanced_split(groups: DataFrame, parts: int = 2) -> DataFrame:
    """groups(group, n) dealt to parts, largest first in turn there and back: rows (group, part)."""
    order = F.row_number().over(Window.orderBy(F.col("n").desc(), "group")) - 1
    turn, at = F.floor(order / parts), order % parts
    return groups.select("group", F.when(turn % 2 == 0, at).otherwise(parts - 1 - at).cast("int").alias("part"))


def validation_mark(key: Column, share: float, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(10_000 * share)


def bootstrap_weights(clusters: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """clusters(cluster): rows (replicate, cluster, weight) of Poisson bootstrap draws from seeded hashes, weight 0 = out of bag."""
    u = F.pmod(F.xxhash64("cluster", "replicate", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    steps, p, total = [], float(np.exp(-1)), 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: u >= s))
    return clusters.select("cluster").distinct().crossJoin(F.broadcast(clusters.sparkSession.range(replicates).select(F.col("id").alias("replicate")))).select("replicate", "cluster", weight.alias("weight"))


def bootstrap_interval(rows: DataFrame, replicates: int, *, cluster: str, value: Column, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean and percentile interval of a value over cluster bootstrap replicates."""
    per = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = per.join(bootstrap_weights(per, replicates, seed), "cluster").groupBy("replicate").agg((F.sum(F.col("s") * F.col("weight")) / F.nullif(F.sum(F.col("n") * F.col("weight")), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    return drawn.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def weighted_rows(spark, n: int, weights: dict[str, float], seed: int = 0) -> DataFrame:
    """n rows (id, value) with values drawn by weight from seeded hashes."""
    total, at, out = sum(weights.values()), 0.0, None
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for v, w in weights.items():
        at += w / total
        out = F.when(u < at, v) if out is None else out.when(u < at, v)
    return spark.range(n).select("id", out.otherwise(list(weights)[-1]).alias("value"))


def assert_ordered_subset(names: list[str], reference: list[str]) -> None:
    """Feature names of a model have to be those of the reference, in its order, some left out."""
    rest = iter(reference)
    missing = [n for n in names if n not in rest]
    if missing:
        raise ValueError(f"not an ordered subset of the reference: {missing}")


def fit_ranker(pairs: DataFrame, features: list[str], *, reg: float = 1e-3) -> dict[str, float]:
    """Weights of a linear pairwise ranker from preference_pairs(): a logistic regression without an intercept on the differences,
    each taken both ways. Score a row with ranker_score()."""
    both = pairs.select(*features, "weight", F.lit(1.0).alias("_y")).union(pairs.select(*[(-F.col(f)).alias(f) for f in features], "weight", F.lit(0.0).alias("_y")))
    data = VectorAssembler(inputCols=features, outputCol="_f").transform(both)
    m = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="weight", fitIntercept=False, regParam=reg, standardization=False, tol=1e-9, maxIter=200).fit(data)
    return dict(zip(features, (float(x) for x in m.coefficients), strict=True))


def ranker_score(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for f, w in weights.items():
        out = out + F.lit(w) * F.col(f)
    return out


def out_of_fold(rows: DataFrame, features: list[str], group: Column, folds: int, *, label: str = "label", seed: int = 0, **options) -> DataFrame:
    """rows with probability, predicted by a model that has not seen the row's group: one fit for each fold."""
    from pyspark.ml.functions import vector_to_array

    dealt = rows.withColumn("_fold", fold(group, folds, seed))
    out = None
    for k in range(folds):
        assembler, model = fit_classifier(dealt.where(F.col("_fold") != k), features, label=label, **options)
        one = model.transform(assembler.transform(dealt.where(F.col("_fold") == k)))
        one = one.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, "_fold", "probability")
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("_fold", "fold")


def bagged_threshold(rows: DataFrame, thresholds: DataFrame, replicates: int, *, unknown_share: float = 0.5, wrong_cost: float = 1.0, false_cost: float = 1.0, seed: int = 0) -> DataFrame:
    """rows(cluster, raw, known, correct): a threshold from each cluster bootstrap, their median, and what each does on the
    clusters it didn't draw (means over replicates). One row.

    Counts by cluster and threshold are made once, so a replicate is a weighted sum of them."""
    met = rows.crossJoin(F.broadcast(thresholds))  # a grid of a few hundred rows
    over = F.col("raw") >= F.col("threshold")
    n = lambda c: F.count_if(c).cast("double")
    per = met.groupBy("cluster", "threshold").agg(n(over & F.col("known") & F.col("correct")).alias("r"), n(over & F.col("known") & ~F.col("correct")).alias("w"), n(over & ~F.col("known")).alias("f"), n(F.col("known")).alias("k"), n(~F.col("known")).alias("u"))
    drawn = per.join(bootstrap_weights(per.select("cluster").distinct(), replicates, seed), "cluster")
    sums = lambda df, x: df.groupBy("replicate", "threshold").agg(*[F.sum(F.col(c) * x).alias(c) for c in "rwfku"])
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    inside = sums(drawn.where("weight > 0"), F.col("weight")).where("k > 0 and u > 0")
    utility = F.round((1 - unknown_share) * (part("r", "k") - wrong_cost * part("w", "k")) - unknown_share * false_cost * part("f", "u"), 9)
    best = inside.withColumn("_u", utility).withColumn("_m", F.max("_u").over(Window.partitionBy("replicate"))).where("_u = _m")
    flat = best.groupBy("replicate").agg(F.array_sort(F.collect_list("threshold")).alias("t"))
    picks = flat.select("replicate", F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("pick"))
    outside = sums(drawn.where("weight = 0"), F.lit(1.0)).where("k > 0 and u > 0")
    judged = picks.join(outside, (picks["replicate"] == outside["replicate"]) & (picks["pick"] == outside["threshold"]), "left")
    rate = lambda c: F.avg(c)
    return judged.agg(F.median("pick").alias("threshold"), rate((F.col("r") + F.col("w")) / F.col("k")).alias("coverage"), rate(part("r", "k")).alias("right"), rate(part("f", "u")).alias("false_accept"))


def save_decider(spark, assembler, model, meta: dict, path: str) -> None:
    """A fitted decider as a pipeline of its parts, with its settings as JSON beside it."""
    import json

    from pyspark.ml import PipelineModel

    PipelineModel([assembler, model]).write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_decider(spark, path: str) -> tuple:
    """(pipeline model, settings)"""
    import json

    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])
