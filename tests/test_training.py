import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemesh.operators import training as T
from citemesh.operators.embedding import edge_loss, sage_predict


def test_gradient_is_that_of_finite_differences_and_loss_falls(spark):
    r = random.Random(2)
    v = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2), r.random()]) for i in range(24)], "id bigint, features array<double>")
    links = lambda same: sorted({(a, b) for a, b in ((r.randrange(24), r.randrange(24)) for _ in range(80)) if a != b and (a % 2 == b % 2) == same})
    pos, neg = (spark.createDataFrame(links(x), "src bigint, dst bigint") for x in (True, False))
    rows = T.stored(T.link_rows(v, T.sampled_neighbours(pos, 3), pos, neg))
    g = np.random.default_rng(1)
    w, b = g.normal(size=(6, 2)), g.normal(size=2)
    loss, dw, db = T.loss_and_gradient(rows, w, b)
    for at in [(0, 0), (3, 1), (5, 0)]:
        step = np.zeros_like(w)
        step[at] = 1e-5
        assert np.isclose((T.loss_and_gradient(rows, w + step, b)[0] - T.loss_and_gradient(rows, w - step, b)[0]) / 2e-5, dw[at], atol=1e-6)
    step = np.array([0, 1e-5])
    assert np.isclose((T.loss_and_gradient(rows, w, b + step)[0] - T.loss_and_gradient(rows, w, b - step)[0]) / 2e-5, db[1], atol=1e-6)
    layer, losses = T.train_sage(v, pos, pos, neg, 4, fanout=100, epochs=12, rate=0.1)
    assert losses[-1] < 0.7 * losses[0]
    # the layer's own forward pass and loss give the same figure
    z = sage_predict(v, pos, [layer])
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score")
    scored = lambda e: e.join(z.toDF("src", "a"), "src").join(z.toDF("dst", "b"), "dst").select(dot)
    assert np.isclose(edge_loss(scored(pos), scored(neg)).first()["loss"], losses[-1])
    with pytest.raises(ValueError):
        T.train_sage(v.limit(0), pos, pos, neg, 4)


def test_sampled_neighbours(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(500)] + [(1, 7), (1, 7), (2, 7)], "src bigint, dst bigint")
    got = [tuple(x) for x in T.sampled_neighbours(edges, 5).collect()]
    assert len(got) == len(set(got)) == 7 and {(1, 7), (2, 7)} <= set(got)
    assert sorted(got) == sorted(tuple(x) for x in T.sampled_neighbours(edges.repartition(7), 5).collect())
    assert T.sampled_neighbours(edges.limit(0), 5).count() == 0
