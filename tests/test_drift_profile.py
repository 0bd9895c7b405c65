"""Drift measures by slices: one shuffle of the values, copies counted, whatever the slices."""

import numpy as np
import pandas as pd
import pytest

from panelloom.operators import monitoring
from tests.conftest import collect


@pytest.mark.parametrize("slice_rows, flush", [(250_000, 1_000_000), (40, 64)])
def test_profile_matches_brute_force(spark, slice_rows, flush):
    g = np.random.default_rng(5)
    x = {"wide": (g.normal(0, 1, 900), g.normal(0.2, 1, 700)), "ties": (g.integers(0, 3, 900) * 1.0, np.r_[np.full(500, 1.0), -0.0, 7.0]),
         "one": (np.full(50, 2.0), np.full(60, 2.0)), "alone": (np.array([]), g.normal(0, 1, 40))}
    long = pd.concat([pd.DataFrame({"feature": f, "value": v, "is_ref": ref}) for f, both in x.items() for v, ref in zip(both, (1, 0), strict=True)])
    samples = spark.createDataFrame(long.sample(frac=1.0, random_state=1), "feature string, value double, is_ref int").repartition(5)
    profile = monitoring.Profile(samples, slice_rows=slice_rows, flush=flush)
    assert (profile.slices.count() > 8) == (slice_rows == 40)
    edges = profile.edges()
    assert sorted(edges) == ["one", "ties", "wide"]
    for f, e in edges.items():
        np.testing.assert_allclose(e, np.unique(np.quantile(x[f][0], np.arange(11) / 10)), rtol=1e-12)
    ks = collect(monitoring.ks_test(samples, profile), "feature").set_index("feature")["ks_statistic"]
    for f in ("one", "ties", "wide"):
        a, b = (np.sort(v) for v in x[f])
        at = np.concatenate([a, b])
        gap = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert ks[f] == pytest.approx(gap, abs=1e-12)
    assert pd.isna(ks["alone"])
    psi = collect(monitoring.psi(samples, profile=profile), "feature").set_index("feature")
    assert list(psi.index) == ["one", "ties", "wide"] and psi.loc["one", "psi"] == 0.0
    for f in ("ties", "wide"):
        r, k = (np.histogram(v, edges[f])[0] for v in x[f])
        r, k = (np.maximum(n / max(n.sum(), 1), 1e-6) for n in (r, k))
        assert psi.loc[f, "psi"] == pytest.approx(((k - r) * np.log(k / r)).sum(), rel=1e-9)
    assert psi.loc["wide", ["n_ref", "n_cur"]].tolist() == [900, 700]


def test_values_cross_one_exchange(spark):
    """Before, quantiles and distances each cut, shuffled and sorted all values, some of it twice."""
    samples = spark.createDataFrame([("a", float(i), i % 2) for i in range(50)], "feature string, value double, is_ref int")
    rows = []
    profile = monitoring.Profile(samples)
    for df in (monitoring.psi(samples, profile=profile), monitoring.ks_test(samples, profile)):
        rows.append(df._jdf.queryExecution().executedPlan().toString())
    assert not any("Window" in p or "ObjectHashAggregate" in p for p in rows)
