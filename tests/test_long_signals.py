"""Signal operators whose work must not grow with the width of a frame or the
square of a block: against loops, and within time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.operators import signal


def wave(spark, n, seed=7):
    return spark.range(n).select(F.col("id").alias("pos"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 250.0 - 2).alias("v"))


@pytest.mark.parametrize("back", [0, 1, 6, 63, 700])
def test_frames_equal_loops(spark, back):
    rows = wave(spark, 500).withColumn("pos", F.col("pos") + 37)
    v = np.array([r["v"] for r in rows.orderBy("pos").collect()])
    top = [r["top"] for r in signal.sliding_max(rows, back).orderBy("pos").collect()]
    gain = [r["gain"] for r in signal.moving_gain(rows, back, 0.5).orderBy("pos").collect()]
    need = np.r_[np.ones(back), np.where(np.abs(v) > 0.5, 0.5 / np.maximum(np.abs(v), 1e-9), 1)]
    for i in range(500):
        assert top[i] == np.abs(v[max(i - back, 0) : i + 1]).max()
        assert gain[i] == pytest.approx(need[i : i + back + 1].mean(), abs=1e-12)


def test_biquads_equal_loops(spark):
    coefs = (0.2, 0.4, -0.5, 0.3)
    rows = wave(spark, 3000)
    z1 = z2 = 0.0
    want = []
    for r in rows.orderBy("pos").collect():
        y = coefs[0] * r["v"] + z1
        z1, z2 = coefs[1] * r["v"] - coefs[2] * y + z2, coefs[0] * r["v"] - coefs[3] * y
        want.append(y)
    got = [r["v"] for r in signal.biquad_rows(rows, coefs, 700).orderBy("pos").collect()]
    assert got == pytest.approx(want, abs=1e-12)
    one = rows.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("x"))
    assert list(one.select(signal.biquad(F.col("x"), *coefs).alias("y")).first()["y"]) == pytest.approx(want, abs=1e-12)
    odd = spark.createDataFrame([([],), (None,), ([1.0, None],)], "x array<double>").select(signal.biquad(F.col("x"), *coefs).alias("y")).collect()
    assert list(odd[0]["y"]) == [] and odd[1]["y"] is None and list(odd[2]["y"]) == pytest.approx([0.2, 0.5])
    assert signal.biquad_rows(rows.limit(0), coefs).count() == 0


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_wide_frames_and_whole_blocks_take_linear_time(spark):
    rows = wave(spark, 1_000_000)
    seconds(signal.sliding_max(wave(spark, 1000), 240))
    near, far = (seconds(signal.sliding_max(rows, back)) for back in (240, 76_800))
    assert far < 3 * near + 3
    assert seconds(signal.moving_gain(rows, 76_800, 0.5)) < 20
    assert seconds(signal.release(rows.select("pos", signal.needed_gain(F.abs("v"), 0.5).alias("req")), 0.1)) < 20
    assert seconds(signal.biquad_rows(rows, (0.2, 0.4, -0.5, 0.3))) < 20
