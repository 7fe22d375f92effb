"""MLlib models over the research panel. Data stays distributed; the driver only loops over fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import add

GROUPS = {"distance": ["dist_pct", "dist_z"], "momentum": ["rsi_14", "ret_5", "ret_20", "macd_hist"], "trend": ["adx", "bias_score"], "volatility": ["vol_pct"]}
FEATURES = [f for g in GROUPS.values() for f in g]
WEIGHT = "(CASE WHEN censored THEN 0.3D ELSE 1.0D END) * (CASE WHEN long_score >= 2 THEN 5.0D ELSE 1.0D END) * greatest(0.25D, least(4.0D, 0.5 / greatest(vol_pct, 0.01)))"


def dataset(research: DataFrame, labels: DataFrame) -> DataFrame:
    """Features, label and weight; rows with a missing feature or label are dropped."""
    d = research.join(labels.select("symbol", "rn", "label", "censored"), ["symbol", "rn"])
    d = d.where(" AND ".join(f"{f} IS NOT NULL" for f in [*FEATURES, "label"]))
    return add(d, {"weight": WEIGHT})


def vectors(d: DataFrame, names=None) -> DataFrame:
    return VectorAssembler(inputCols=list(names or FEATURES), outputCol="features").transform(d)


def chronological(d: DataFrame, split: str, embargo: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train ends ``embargo`` days before the split; test starts at it."""
    return d.where(f"ts < date_sub(DATE '{split}', {embargo})"), d.where(f"ts >= DATE '{split}'")


def tail(d: DataFrame, share: float = 0.1) -> Column:
    """First day of the newest ``share`` of the rows, as a scalar subquery."""
    return d.agg(F.expr(f"approx_percentile(ts, {1 - share}D)")).scalar()


def fit_gbt(train: DataFrame, depth: int = 3, rounds: int = 400, rate: float = 0.1, names=None, embargo: int = 20):
    """Boosted trees with class-balanced weights, of at most ``rounds`` rounds.

    The rows from the 90% day on are for validation and end the rounds once they gain nothing; the ``embargo`` days before them,
    whose labels look into them, are left out.
    """
    train = train.withColumn("_cut", tail(train)).withColumn("is_val", F.expr("ts >= _cut")).where(f"is_val OR ts < date_sub(_cut, {embargo})")
    bal = train.agg(F.expr("avg(label) AS p"))
    t = add(train.crossJoin(F.broadcast(bal)), {"w": "weight * CASE WHEN label = 1 THEN 0.5 / greatest(p, 0.01) ELSE 0.5 / greatest(1 - p, 0.01) END"})
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="w", maxDepth=depth, maxIter=rounds, stepSize=rate, validationIndicatorCol="is_val", seed=42)
    return gbt.fit(vectors(t, names))


def score(model, d: DataFrame, names=None, out: str = "p") -> DataFrame:
    s = model.transform(vectors(d, names))
    return s.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features")


def auc(scored: DataFrame, p: str = "p") -> float:
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=p)
    return float(ev.evaluate(scored))


def platt(train: DataFrame, test: DataFrame, p: str = "p") -> DataFrame:
    """Logistic regression on the logit of the raw probability."""
    def z(d):
        return VectorAssembler(inputCols=["z"], outputCol="zv").transform(add(d, {"z": f"ln(greatest(least({p}, 1 - 1e-6), 1e-6) / (1 - greatest(least({p}, 1 - 1e-6), 1e-6)))"}))

    m = LogisticRegression(featuresCol="zv", labelCol="label").fit(z(train))
    return m.transform(z(test)).withColumn("p_platt", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "zv", "z")


def isotonic(train: DataFrame, test: DataFrame, p: str = "p") -> DataFrame:
    m = IsotonicRegression(featuresCol=p, labelCol="label", predictionCol="p_iso").fit(train)
    return m.transform(test)


def stack(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Logistic regression over the model probability and a few panel columns."""
    va = VectorAssembler(inputCols=cols, outputCol="sv")
    m = LogisticRegression(featuresCol="sv", labelCol="label").fit(va.transform(train))
    return m.transform(va.transform(test)).withColumn("p_stack", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "sv")


def importance(model, names=None) -> list[tuple[str, str, float]]:
    group = {f: g for g, fs in GROUPS.items() for f in fs}
    return [(n, group[n], float(v)) for n, v in zip(names or FEATURES, model.featureImportances.toArray())]


REGIME_INPUTS = ["slope_20", "adx", "vs200", "atr_ratio"]


def _name(atr, atr_bar, slope, vs200):
    return "High Volatility" if atr > atr_bar else "Bull Trend" if slope > 0 and vs200 > 0 else "Bear Trend" if slope < 0 and vs200 < 0 else "Range / Chop"


def _label(d: DataFrame, centers) -> DataFrame:
    names = [_name(c[3], b, c[0], c[2]) for c, b in centers]
    return add(d, {"label": "CASE prediction " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"})


def cluster_regimes(z: DataFrame, k: int = 4) -> DataFrame:
    """KMeans on per-symbol z-scores, clusters named by their centroids."""
    v = vectors(z.where(" AND ".join(f"{c} IS NOT NULL" for c in REGIME_INPUTS)), REGIME_INPUTS)
    m = KMeans(k=k, seed=42, maxIter=20).fit(v)
    return _label(m.transform(v), [(c, 1.0) for c in m.clusterCenters()]).drop("features")


def mixture_regimes(z: DataFrame, k: int = 4) -> DataFrame:
    """Gaussian mixture stand-in for the state model; states named by their means."""
    v = vectors(z.where(" AND ".join(f"{c} IS NOT NULL" for c in REGIME_INPUTS)), REGIME_INPUTS)
    m = GaussianMixture(k=k, seed=42, maxIter=100).fit(v)
    means = [g.mean.toArray() for g in m.gaussians]
    atr = [c[3] for c in means]
    mu = sum(atr) / len(atr)
    bar = mu + (sum((a - mu) ** 2 for a in atr) / len(atr)) ** 0.5
    return _label(m.transform(v), [(c, bar) for c in means]).drop("features", "probability")
