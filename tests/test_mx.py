"""The block re-encoder against plain Python floats and fractions on labelled classes of blocks."""

import math
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.operators.mx import mx_round


def reference(values, esz, mbits=3, emax=8, emin=-6, scale_bits=8):
    limit = 2 ** (scale_bits - 1) - 1
    if any(not math.isfinite(x) for x in values):
        return [math.nan] * len(values)
    leads = [math.frexp(abs(x))[1] - 1 for x in values if x]
    if not leads:
        return list(values)
    shared = max(leads) - emax
    if shared > limit:
        return [math.nan] * len(values)
    shared = max(shared, -limit)
    top = Fraction(2**(mbits + 1) - 1 - (1 if (mbits, emax) == (3, 8) else 0)) * Fraction(2) ** (shared + emax - mbits)
    out = []
    for x in values:
        if not x:
            out.append(x)
            continue
        q = Fraction(2) ** (max(math.frexp(abs(x))[1] - 1, shared + emin) - mbits)
        n = Fraction(abs(x)) / q
        r = (math.floor(n) + (1 if n - math.floor(n) >= Fraction(1, 2) else 0)) * q
        r = min(r, top)
        y = math.copysign(float(r), x)
        out.append(float(np.float32(y)) if esz == 4 else y)
    return out


def to_bits(x, esz):
    return int.from_bytes(struct.pack(">f" if esz == 4 else ">d", x), "big", signed=esz == 8)


def blocks(esz):
    rng = np.random.default_rng(esz)
    base = lambda s: rng.choice([-1, 1], 32) * (1 + rng.random(32)) * 2.0 ** rng.integers(-s, s + 1, 32)
    out = [base(s) for s in (0, 2, 4, 8, 12, 16, 24, 40) for _ in range(4)]
    out += [np.round(base(3) * 16) / 16, 2.0**8 * (1 + np.arange(32) / 32), 2.0**-130 * base(3), np.zeros(32), -np.zeros(32), base(2) * 2.0**-148]
    out += [np.append(base(2)[:31], x) for x in (np.inf, -np.inf, np.nan)]
    out += [base(4)[:7]]
    if esz == 8:
        out += [base(3) * 2.0**300, base(3) * 2.0**-1060, base(3) * 2.0**130]
    else:
        out += [base(3) * 2.0**120, np.full(32, 1e-45)]
    return [x.astype(np.float32).astype(float) if esz == 4 else x for x in out]


@pytest.mark.parametrize("esz", [4, 8])
@pytest.mark.parametrize("mbits,emax,emin", [(3, 8, -6), (2, 15, -14), (7, 8, -6)])
def test_blocks(spark, esz, mbits, emax, emin):
    data = blocks(esz)
    rows = [(k, i, to_bits(x, esz)) for k, xs in enumerate(data) for i, x in enumerate(xs.tolist())]
    out = mx_round(spark.createDataFrame(rows, "k long, idx int, bits long"), ["k"], esz=esz, mbits=mbits, emax=emax, emin=emin).collect()
    got = {(r.k, r.idx): r.mx_bits for r in out}
    assert len(got) == len(rows)
    for k, xs in enumerate(data):
        for i, y in enumerate(reference(xs.tolist(), esz, mbits, emax, emin)):
            z = got[k, i]
            z = struct.unpack(">f" if esz == 4 else ">d", z.to_bytes(esz, "big", signed=esz == 8))[0]
            assert (math.isnan(y) and math.isnan(z)) or y == z, (k, i, xs[i], y, z)


def test_again_changes_nothing(spark):
    rows = [(k, i, to_bits(x, 4)) for k, xs in enumerate(blocks(4)) for i, x in enumerate(xs.tolist())]
    once = mx_round(spark.createDataFrame(rows, "k long, idx int, bits long"), ["k"]).select("k", "idx", F.col("mx_bits").alias("bits"))
    assert mx_round(once, ["k"]).where("changed").count() == 0


def test_sites(spark):
    df = spark.createDataFrame([(1, 0, to_bits(1.03, 4), "a"), (2, 0, to_bits(1.03, 4), "b")], "k long, idx int, bits long, site string")
    out = {r.site: r.changed for r in mx_round(df, ["k"], sites=spark.createDataFrame([("a",)], "site string")).collect()}
    assert out == {"a": True, "b": False}
