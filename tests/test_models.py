"""Models of two classes in a session in which a query was observed."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from citemesh.operators.clustering import soft_cluster
from citemesh.operators.embedding import probe
from citemesh.operators.modeling import model_binary_events


@pytest.fixture
def observed(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    return spark


def test_probe_after_observation(observed):
    df = observed.createDataFrame([([float(i % 2), 1.0], "ab"[i % 2]) for i in range(40)], "v array<double>, y string")
    assert tuple(probe(df, df, "v", "y").first()) == (40, 1.0)


def test_forests_after_observation(observed):
    df = observed.createDataFrame([(float(i % 2), i % 2) for i in range(40)], "x double, y int")
    out, weights = model_binary_events(df, df, ["x"], ["y"], numTrees=3)
    assert out.filter("y_pred <> y or round(y_proba) <> y").count() == 0 and weights == {"y": [1.0]}


def test_two_soft_clusters_after_observation(observed):
    df = observed.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(40)], "id int, v array<double>, label int")
    assert soft_cluster(df, "id", "v", "label").filter("predicted <> label").count() == 0
