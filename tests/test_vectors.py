"""Vector algebra, prototypes and encoder: fixed cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemic.functions import vectors as V
from mnemic.operators import prototypes as P
from mnemic.operators.encoder import ScalarEncoder, ste
from mnemic.sources import store


def _one(spark, a, b, expr, kind="array<double>"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(expr(F.col("a"), F.col("b")).alias("x")).first().x


def test_ternary_similarity(spark):
    a, b = [1, -1, 0, 1, 1, 0, -1, 1], [1, 1, 0, 1, -1, 0, -1, 1]
    assert _one(spark, a, b, V.ternary_similarity, "array<int>") == pytest.approx(1 / 3)
    planes = lambda x, y: V.planes_similarity(V.planes(x), V.planes(y))
    assert _one(spark, a, b, planes, "array<int>") == pytest.approx(1 / 3)
    assert _one(spark, [0, 0], [1, 1], V.ternary_similarity, "array<int>") == 0.0


def test_bit_planes_over_many_words(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-1, 2, 200).tolist() for _ in "ab")
    both = np.array(a) * np.array(b)
    planes = lambda x, y: V.planes_similarity(V.planes(x), V.planes(y))
    assert _one(spark, a, b, planes, "array<int>") == pytest.approx(both.sum() / np.abs(both).sum())


def test_cosine(spark):
    a = [1.0, 2.0, -3.0]
    assert _one(spark, a, a, V.cosine) == pytest.approx(1.0)
    assert _one(spark, a, [-x for x in a], V.cosine) == pytest.approx(-1.0)
    assert _one(spark, a, [0.0] * 3, V.cosine) == 0.0
    assert _one(spark, a, [1.0], V.cosine) is None
    assert _one(spark, [float("nan"), float("inf"), 1.0], [1.0, 1.0, 1.0], V.cosine) == pytest.approx(1 / math.sqrt(3))
    assert _one(spark, None, a, V.cosine) is None


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 7, 13, 33, 1023])
def test_pack_round_trip(spark, dim):
    trits = np.random.default_rng(dim).integers(-1, 2, dim).tolist()
    r = spark.createDataFrame([(trits,)], "a array<int>").select("a", V.pack_trits(F.col("a")).alias("p")).select("a", "p", V.unpack_trits(F.col("p"), F.lit(dim)).alias("u")).first()
    assert len(r.p) == -(-dim // 4) and r.u == trits


def test_pack_bytes_and_reserved_code(spark):
    r = spark.createDataFrame([([1, -1, 0, 1, 1, 0, -1],)], "a array<int>").select(V.pack_trits(F.col("a")).alias("p")).first()
    assert bytes(r.p) == b"\x49\x21"
    z = spark.createDataFrame([(bytearray(b"\xff" * 4),)], "p binary").select(V.unpack_trits(F.col("p"), F.lit(16)).alias("u")).first()
    assert z.u == [0] * 16
    with pytest.raises(Exception, match="wrong size"):
        spark.createDataFrame([(bytearray(b"\xff"),)], "p binary").select(V.unpack_trits(F.col("p"), F.lit(16)).alias("u")).collect()


def test_bundles(spark):
    df = spark.createDataFrame([("z", [1.0, 1.0]), ("z", [-1.0, -1.0]), ("u", [3.0, 4.0]), ("u", [3.0, 4.0])], "k string, hv array<double>")
    got = {r.k: r.hv for r in V.assembled(V.bundle_real(df, ["k"]), ["k"]).collect()}
    assert got["z"] == [0.0, 0.0] and got["u"] == pytest.approx([0.6, 0.8])
    t = spark.createDataFrame([([1, 1, -1],), ([1, 0, -1],), ([1, 0, 0],)], "hv array<int>").withColumn("k", F.lit(1))
    assert V.assembled(V.bundle_ternary(t, ["k"]), ["k"]).first().hv == [1, 1, -1]  # deadband 0.5 * sqrt(3)


def test_predict(spark):
    x = store.synthetic_scalars(spark, 24, 3)
    params = ["p0", "p1", "p2", "p3"]
    enc = ScalarEncoder(params, 256, seed=1).fit(x)
    rows = x.select("sample_id", "label", enc.grouped({"a": params[:2], "b": params[2:]}).alias("hv"))
    got = P.predict(rows, P.fit(rows), "sample_id").join(x.select("sample_id", "label"), "sample_id")
    assert got.filter("predicted = label").count() >= 40
    one = P.predict(rows, P.fit(rows.filter("label = 0")), "sample_id").first()
    assert one.margin == one.score


def test_encoder_errors_and_scaling(spark):
    with pytest.raises(ValueError):
        ScalarEncoder([], 4)
    with pytest.raises(ValueError):
        ScalarEncoder(["a"], 4, kind="other")
    df = spark.createDataFrame([(0.0,), (10.0,), (None,), (float("nan"),)], "a double")
    with pytest.raises(RuntimeError):
        ScalarEncoder(["a"], 4).scaled("a")
    with pytest.raises(ValueError):
        ScalarEncoder(["b"], 4).fit(df)
    e = ScalarEncoder(["a"], 4).fit(df)
    assert [round(r.x, 6) for r in df.select(e.scaled("a").alias("x")).collect()] == [-1.0, 1.0, 0.0, 0.0]


def test_straight_through():
    y, g = ste(np.array([0.5, -0.5, 0.0001, -2.0]), 0.0)
    assert y.tolist() == [1, -1, 1, -1] and g.tolist() == [1, 1, 1, 0]


def test_text_vectors_repeat(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select("t", V.text_hv(F.col("t"), 2).alias("h"), V.text_vector("t").alias("v")).collect()
    assert len(df[0].h) == 64 and df[0].h == df[1].h and df[2].h is None
    assert df[0].v == df[1].v and sum(x * x for x in df[0].v) == pytest.approx(1.0)
