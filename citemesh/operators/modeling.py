"""Event models, their scores, and choosing among tuning trials."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance_to_ones
from .relational import minmax_scaled
from .storage import stored_model


def ideal_point(trials: DataFrame, criteria: dict[str, str], unbounded: list[str] | None = None) -> DataFrame:
    """Adds `distance` to the ideal point: criteria are min-max scaled (only `unbounded`, if given) and
    turned where they are minimised; the smallest distance wins."""
    raw = trials.withColumns({f"__{c}": F.col(c).cast("double") for c in criteria})
    scaled = minmax_scaled(raw, [f"__{c}" for c in criteria if unbounded is None or c in unbounded])
    cols = [F.col(f"__{c}") if way == "maximize" else 1 - F.col(f"__{c}") for c, way in criteria.items()]
    return scaled.withColumn("distance", distance_to_ones(cols)).drop(*(f"__{c}" for c in criteria))


def best_trial(trials: DataFrame, criteria: dict[str, str], key: str, unbounded: list[str] | None = None) -> DataFrame:
    return ideal_point(trials, criteria, unbounded).orderBy("distance", key).limit(1)


def learning_rate(trials: DataFrame, index: str, error: str) -> DataFrame:
    """Linear fit of error on trial number; the fitted line meets 0 at convergence_trial."""
    fit = trials.agg(F.regr_slope(F.col(error), F.col(index)).alias("slope"), F.regr_intercept(F.col(error), F.col(index)).alias("intercept"))
    return fit.withColumn("convergence_trial", F.ceil(F.try_divide(-F.col("intercept"), F.col("slope"))))


def pareto(trials: DataFrame, key: str, criteria: dict[str, str]) -> DataFrame:
    """Trials that no other dominates: as good in all criteria and better in one. Trials are few; the
    compared pairs are theirs."""
    other = trials.select(*(F.col(c).alias(f"__{c}") for c in criteria), F.col(key).alias("__k"))
    good = lambda c, strict: (F.col(f"__{c}") > F.col(c) if strict else F.col(f"__{c}") >= F.col(c)) if criteria[c] == "maximize" else (F.col(f"__{c}") < F.col(c) if strict else F.col(f"__{c}") <= F.col(c))
    every = reduce(lambda a, b: a & b, (good(c, False) for c in criteria))
    some = reduce(lambda a, b: a | b, (good(c, True) for c in criteria))
    return trials.join(other, every & some, "left_anti")


def violations(predicted: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, n): rows where two labels that exclude each other are both 1."""
    one = predicted.agg(*(F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}&{b}") for a, b in rules))
    return one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(f"{a}&{b}") for a, b in rules)), F.array(*(F.col(f"`{a}&{b}`") for a, b in rules)))).alias("rule", "n"))


def fbeta(predicted: DataFrame, labels: list[str], beta: float = 1.0) -> DataFrame:
    """(label, tp, fp, fn, fbeta) for each label and `micro`; predictions are in columns <label>_pred."""
    one = predicted.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("y"), F.col(f"{x}_pred").alias("p")) for x in labels))).alias("r")).select("r.*")
    n = lambda y, p: F.count_if((F.col("y") == y) & (F.col("p") == p))
    per = one.groupBy("label").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    every = per.agg(F.lit("micro").alias("label"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    b = beta * beta
    return per.union(every).withColumn("fbeta", F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp")))


def model_binary_events(train: DataFrame, test: DataFrame, features: list[str], targets: list[str], **params) -> tuple[DataFrame, dict[str, list[float]]]:
    """A random forest on standardised features for each target; test rows with <target>_pred and
    <target>_proba, and importances."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    prep = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]).fit(train)
    tr, out, weights = prep.transform(train), prep.transform(test), {}
    for t in targets:
        m = RandomForestClassifier(featuresCol="__x", labelCol=t, predictionCol=f"{t}_pred", probabilityCol=f"__p_{t}", rawPredictionCol=f"__r_{t}", seed=7, **params).fit(tr)
        m = stored_model(train.sparkSession, m)
        out = m.transform(out).withColumn(f"{t}_proba", vector_to_array(f"__p_{t}")[1])
        weights[t] = m.featureImportances.toArray().tolist()
    return out.drop("__raw", "__x", *(f"__{k}_{t}" for t in targets for k in ("p", "r"))), weights


def model_continuous_events(train: DataFrame, test: DataFrame, features: list[str], targets: list[str], **params) -> DataFrame:
    """A chain of regressors, each fed the predictions of those before."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    tr, te, used = train, test, list(features)
    for t in targets:
        a = VectorAssembler(inputCols=used, outputCol="__x")
        m = RandomForestRegressor(featuresCol="__x", labelCol=t, predictionCol=f"{t}_pred", seed=7, **params).fit(a.transform(tr))
        tr, te = (m.transform(a.transform(x)).drop("__x") for x in (tr, te))
        used.append(f"{t}_pred")
    return te


def regression_scores(predicted: DataFrame, targets: list[str]) -> DataFrame:
    """(target, rmse, r2)"""
    parts = [predicted.select(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), F.col(f"{t}_pred").cast("double").alias("p")) for t in targets]
    rows = reduce(DataFrame.union, parts)
    err = F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    return rows.groupBy("target").agg(F.sqrt(err / F.count("*")).alias("rmse"), (1 - F.try_divide(err, F.var_pop("y") * F.count("*"))).alias("r2"))


@dataclass
class Hyperparameter:
    name: str
    low: float | None = None
    high: float | None = None
    choices: list | None = None

    def draw(self, r: random.Random):
        if self.choices is not None:
            return r.choice(self.choices)
        return r.randint(self.low, self.high) if isinstance(self.low, int) and isinstance(self.high, int) else r.uniform(self.low, self.high)


@dataclass
class Criterion:
    name: str
    direction: str = "maximize"
    bounded: bool = False

    def __post_init__(self):
        if self.direction not in ("maximize", "minimize"):
            raise ValueError("direction is maximize or minimize")


@dataclass
class Study:
    """Seeded random search; each trial is a row of parameters and criteria."""

    parameters: list[Hyperparameter]
    criteria: list[Criterion]
    seed: int = 7
    trials: list[dict] = field(default_factory=list)

    def run(self, objective, n: int) -> Study:
        r = random.Random(self.seed)
        for _ in range(n):
            drawn = {p.name: p.draw(r) for p in self.parameters}
            got = objective(drawn)
            if got is not None:  # pruned
                self.trials.append({"trial": len(self.trials), **drawn, **got})
        return self

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.trials)

    def best(self, spark) -> dict:
        free = [c.name for c in self.criteria if not c.bounded]
        return best_trial(self.frame(spark), {c.name: c.direction for c in self.criteria}, "trial", free).first().asDict()


def refit_until(fit, good, tries: int = 20):
    """The first result of fit() that is good; raises after so many tries."""
    for _ in range(tries):
        r = fit()
        if good(r):
            return r
    raise ValueError("no fit within tolerance")


def trial_stats(runs: DataFrame, trial: str, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of repeated fits."""
    return runs.groupBy(trial).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def reshaped_probabilities(predicted: DataFrame, targets: list[str], name: str = "probabilities") -> DataFrame:
    """Adds an array with a [no, yes] pair for each target, from the columns <target>_proba: of shape (rows,
    targets, classes) as a whole."""
    return predicted.withColumn(name, F.array(*(F.array(1 - F.col(f"{t}_proba"), F.col(f"{t}_proba")) for t in targets)))


def log_run(path: str, params: dict, metrics: dict) -> None:
    """A run's parameters and metrics as one more line of JSON."""
    import json
    import time

    with open(path, "a") as f:
        f.write(json.dumps({"time": time.time(), "params": params, "metrics": metrics}, sort_keys=True) + "\n")


def argmax_label(proba: Column) -> Column:
    return F.array_position(proba, F.array_max(proba)) - 1
