"""Quartiles and daily metrics of hard series."""

import random
import statistics

import pytest

from sealstream.operators import analytics as A

SCHEMA = "pod_id string, sample_type int, sensor_channel int, day string, value double"


def interpolated(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("few", [4, 64, 4096])
def test_daily_metrics_equal_statistics(spark, few):
    rnd = random.Random(few)
    series = {"nulls": [1.0, 2.0, 3.0, None, None, None, None], "none": [None, None], "one": [5.0, None], "same": [7.5] * 300,
              "wide": [rnd.lognormvariate(0, 30) * rnd.choice([1, -1]) for _ in range(700)], "ends": [1.7e308, -1.7e308, 0.0, 1.0, -1.0] * 3,
              "near": [1.0 + k * 2.0 ** -52 for k in range(90)], "copies": [float(k % 7) for k in range(500)] + [1e9]}
    rows = [(pod, 1, -1, "d", v) for pod, values in series.items() for v in values]
    rnd.shuffle(rows)
    got = {r.pod_id: r for r in A.derived_daily_metrics(spark.createDataFrame(rows, SCHEMA), 4, few=few).collect()}
    assert got.keys() == series.keys()
    for pod, values in series.items():
        own, r = [v for v in values if v is not None], got[pod]
        assert r["count"] == len(own)
        if not own:
            assert (r.mean, r.stddev, r.median, r.q1, r.outliers) == (None, None, None, None, 0)
            continue
        q1, median, q3 = (interpolated(own, q) for q in (0.25, 0.5, 0.75))
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, median, q3), rel=1e-12)
        assert r.outliers == sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in own)
        if pod != "ends":
            assert r.mean == pytest.approx(statistics.fmean(own), rel=1e-9)
            assert r.stddev == (pytest.approx(statistics.stdev(own), rel=1e-6, abs=1e-12) if len(own) > 1 else None)
