import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import Metric, check_metric, cosine, cosine_normalized, distance, inner_product, l2, normalize, quantize_int8, squared_norm, sum_of_squares
from vexel.functions import kernels as kn


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 20, 7)).astype(np.float32)
    a[0] = 0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i int, a array<float>, b array<float>")
    got = df.select(sum_of_squares("a", "b"), l2("a", "b"), inner_product("a", "b"), cosine("a", "b"), squared_norm("a"), sum_of_squares("a", "b", 2, 5), "i").collect()
    for r in got:
        x, y = a[r.i].astype(float), b[r.i].astype(float)
        m = np.linalg.norm(x) * np.linalg.norm(y)
        want = [((x - y) ** 2).sum(), np.sqrt(((x - y) ** 2).sum()), x @ y, 1 - x @ y / (m or 1), x @ x, ((x - y)[2:5] ** 2).sum()]
        assert np.allclose(list(r)[:6], want)
    for m in Metric:
        want = [r[0] for r in df.select(distance(m, "a", "b"), "i").orderBy("i").collect()]
        assert want == kn.exact(m, a.astype(float), b.astype(float)).tolist()  # the same bits


def test_cosine_of_the_five_points(spark):
    rows = [[1, 0, 0, 0], [1, 1, 0, 0], [32, 41, 30, 0], [1, 5, 3, 0], [4, 4, 4, 0]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "i int, v array<float>")
    q = F.array(*[F.lit(2.0).cast("float")] * 4)
    got = [round(r[0], 6) for r in df.select(cosine("v", q), "i").orderBy("i").collect()]
    assert got == [0.5, 0.292893, 0.142262, 0.239361, 0.133975]
    n = df.select(normalize("v").alias("v"), "i")
    got = [round(r[0], 6) for r in n.select(cosine_normalized("v", normalize(q)), "i").orderBy("i").collect()]
    assert got == [0.5, 0.292893, 0.142262, 0.239361, 0.133975]


def test_unequal_lengths_zero_and_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert df.where("a is null").select(sum_of_squares("a", "b")).first()[0] is None
    with pytest.raises(Exception, match="unequal length"):
        df.select(sum_of_squares("a", "b")).collect()
    z = spark.createDataFrame([([0.0, 0.0],)], "a array<float>")
    assert z.select(normalize("a")).first()[0] == [0.0, 0.0]


def test_quantize(spark):
    df = spark.createDataFrame([([0.0, 5.0],), ([1.0, 5.0],), ([0.5, 5.0],)], "a array<float>")
    low, high = F.array(F.lit(0.0), F.lit(5.0)), F.array(F.lit(1.0), F.lit(5.0))
    assert [r[0] for r in df.select(quantize_int8("a", low, high)).collect()] == [[-128, -128], [127, -128], [0, -128]]


def test_metric_matrix():
    assert check_metric("FLAT", "inner_product") is Metric.INNER_PRODUCT
    for t, m in (("IVF_FLAT", Metric.INNER_PRODUCT), ("VAMANA", Metric.INNER_PRODUCT), ("IVF_PQ", Metric.COSINE), ("IVF_PQ", Metric.INNER_PRODUCT), ("NONE", Metric.L2)):
        with pytest.raises(ValueError):
            check_metric(t, m)
