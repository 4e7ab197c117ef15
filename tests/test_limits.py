"""Percentiles against numpy."""

from dataclasses import replace

import numpy as np
import pytest

from pelagrid import from_frame, robust_limits
from pelagrid.operators.limits import Bracket


def limits(spark, values, **how):
    frame = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)],
                                  "cell int, so double").repartition(6)
    row = robust_limits(from_frame(frame, ("cell",)), "so", **how).first()
    return row["vmin"], row["vmax"]


RNG = np.random.default_rng(7)
SAMPLES = {
    "ramp": np.arange(1.0, 11.0),
    "normal": RNG.normal(size=3000),
    "outliers": np.concatenate([RNG.normal(size=2000), [1e30, -1e30]]),
    "hot value": np.concatenate([np.full(1500, 2.5), RNG.normal(size=2500)]),
    "hot low end": np.concatenate([np.zeros(2000), RNG.random(2000)]),
    "two values": np.repeat([1.0, 2.0], [1990, 10]),
    "hot value next to the rank": np.concatenate([np.full(1800, -2.0), RNG.normal(size=1200)]),
    "holes": np.where(RNG.random(2000) < 0.2, np.nan, RNG.normal(size=2000)),
    "one": np.array([4.0]),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_exact_percentiles(spark, name):
    values = SAMPLES[name]
    expected = np.nanpercentile(values, [2, 98])
    assert limits(spark, values) == pytest.approx(tuple(expected), rel=1e-12)


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (0.25, 0.5), (0.4999, 0.5001)])
def test_other_percentiles(spark, low, high):
    values = SAMPLES["normal"]
    expected = np.percentile(values, [100 * low, 100 * high])
    assert limits(spark, values, low=low, high=high) == pytest.approx(tuple(expected), rel=1e-12)


def test_nothing_but_holes_has_no_limits(spark):
    assert limits(spark, np.array([np.nan, np.nan])) == (None, None)


def test_limits_must_be_in_order(spark):
    with pytest.raises(ValueError):
        limits(spark, SAMPLES["ramp"], low=0.9, high=0.1)


@pytest.mark.parametrize("accuracy, slack", [(20, 2.0), (20, 1e-4)])
@pytest.mark.parametrize("name", ["normal", "hot value"])
def test_exact_however_rough_the_estimate(spark, monkeypatch, name, accuracy, slack):
    """A rough estimate, and one that is also trusted too far, so that brackets miss."""
    monkeypatch.setattr("pelagrid.operators.limits.ACCURACY", accuracy)
    around = Bracket.around
    monkeypatch.setattr(Bracket, "around", lambda q, n: replace(around(q, n), slack=slack / accuracy))
    expected = np.percentile(SAMPLES[name], [2, 98])
    assert limits(spark, SAMPLES[name]) == pytest.approx(tuple(expected), rel=1e-12)
