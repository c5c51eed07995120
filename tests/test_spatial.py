"""Radius counts against brute force: null groups, repeated and far points, crowded tiles, batches cut inside tiles."""

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import spatial


@pytest.mark.parametrize(("crowded", "pairs"), [(50_000, 1_000_000), (100, 500)])
def test_radius_counts(spark, monkeypatch, crowded, pairs):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    monkeypatch.setattr(spatial, "PAIRS_AT_ONCE", pairs)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(0, 0.05, (300, 3)), [[3e6, 0, 0], [3e6, 0.1, 0]], np.zeros((3, 3))])
    x[:50] = np.round(x[:50], 1)
    group = np.array([None, "a", "b"], object)[np.arange(len(x)) % 3]
    pdf = pd.DataFrame(x, columns=list("xyz")).assign(g=group, id=np.arange(len(x)))
    got = spatial.radius_counts(spark.createDataFrame(pdf), ["g"], "id", 0.25).toPandas().set_index("id")["neighbours"].sort_index()
    near = (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.25**2) & (group[:, None] == group[None])
    assert got.index.tolist() == pdf["id"].tolist()
    assert got.tolist() == (near.sum(axis=1) - 1).tolist()


def test_radius_counts_of_nothing(spark):
    none = spark.createDataFrame([], "g string, id bigint, x double, y double, z double")
    assert spatial.radius_counts(none, ["g"], "id", 0.25).count() == 0
