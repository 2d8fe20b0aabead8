import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from territoria.functions import combine as C
from territoria.functions import distributions as D
from territoria.functions import geo as G
from territoria.functions import scalars as S
from territoria.functions import special as P
from territoria.functions import text as X

# Published site rows (x_bws, x_gws, x_sv, x_aridity, spei3, spei12) and their published indices
# (S_struct_v2, S_conj_v2, H_v2, S_struct_v3, S_conj_v3, H_v3).
GOLDEN = [
    ((0.1737850035230319, 1.0, 0.16901818503296165, 0.10718731975478075, -4.753424308822899, -4.753424308822899),
     (0.265479936873237, 0.7038539400838278, 0.6129780264094807, 0.22850869384031613, 0.7038539400838278, 0.6053138048413989)),
    ((0.6442634761333466, 0.6202666461467743, 0.16339653437803503, 0.17646654534187228, -4.753424308822899, -1.0667749453094584),
     (0.4724970248502957, 0.6524823887333003, 0.6086987301295876, 0.4498647615784194, 0.7038539400838278, 0.6512014139508224)),
    ((0.2897352476914724, 1.0, 0.12204614303257677, 0.3325524286805368, -2.448051474131015, -4.753424308822899),
     (0.40458649817072945, 0.6551930020641235, 0.5947053886746427, 0.35063137351797957, 0.7038539400838278, 0.6306301101304602)),
    ((0.2897352476914724, None, 0.12204614303257677, 0.19232665560302442, -2.1827210238884223, -4.753424308822899),
     (0.24895955798002906, 0.6516188030353046, 0.5534235662024244, 0.24012029538761992, 0.7038539400838278, 0.6077209158746842)),
    ((0.4617236057917277, 0.6202666461467743, 0.17080675337861348, 0.05642380758079655, -0.7415064403828191, -0.08860523630078823),
     (0.338011704085499, 0.21522336114436072, 0.28267635728916074, 0.3206833213011758, 0.27047408295684194, 0.296114341409874)),
]


def test_published_site_rows(spark):
    df = spark.createDataFrame([g[0] for g in GOLDEN], "x_bws double, x_gws double, x_sv double, x_aridity double, spei3 double, spei12 double")
    df = df.withColumn("d3", S.asymptotic_stress("spei3")).withColumn("d12", S.asymptotic_stress("spei12"))
    df = df.withColumn("s2", C.wmean(C.WEIGHTS_ARITH)).withColumn("c2", C.boltzmann("d3", "d12"))
    df = df.withColumn("s3", C.wgeo(C.WEIGHTS_GEOM)).withColumn("c3", C.hard_max("d3", "d12"))
    rows = df.select("spei3", "spei12", "s2", "c2", C.assemble("s2", "c2"), "s3", "c3", C.assemble("s3", "c3")).collect()
    got = {tuple(r[:2]): tuple(r[2:]) for r in rows}
    for inputs, expected in GOLDEN:
        assert got[inputs[4:]] == pytest.approx(expected, abs=1e-12)


def test_missing_components_share_their_weight(spark):
    df = spark.createDataFrame([(0.4, None, 0.2), (None, None, None), (0.4, 0.6, 0.2)], "x_bws double, x_gws double, x_aridity double")
    got = [r[0] for r in df.select(C.wmean(C.WEIGHTS_ARITH)).collect()]
    assert got[0] == pytest.approx((0.5 * 0.4 + 0.36 * 0.2) / 0.86)
    assert got[1] is None
    assert got[2] == pytest.approx(0.5 * 0.4 + 0.36 * 0.2 + 0.14 * 0.6)


def test_null_fallbacks_of_the_two_part_index(spark):
    df = spark.createDataFrame([(None, 0.5), (0.5, None), (None, None)], "a double, b double")
    rows = df.select(C.assemble("a", "b"), C.boltzmann("a", "b"), C.hard_max("a", "b"), C.fixed_mix("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(0.5,) * 4, (0.5,) * 4, (None,) * 4]


def test_normal_quantile_matches_the_standard_library(spark):
    ps = [1e-6, 1e-4, 0.01, 0.08, 0.3, 0.5, 0.77, 0.95, 0.9999, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r[0]: r[1] for r in df.select("p", D.norm_ppf("p")).collect()}
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)
    assert df.limit(1).select(D.norm_ppf(F.lit(None).cast("double"))).head()[0] is None


def values(spark, *columns):
    return list(spark.range(1).select(*columns).head())


def test_gamma_student_and_pearson_tables(spark):
    f = lambda *xs: [F.lit(x) for x in xs]
    got = values(spark, *[P.lower_gamma(*f(a, x)) for a, x in ((0.5, 0.5), (2.0, 3.0), (5.0, 5.0), (100.0, 90.0))])
    assert got == pytest.approx([0.6826894921, 0.8008517265, 0.5595067149, 0.1582209891], abs=1e-8)
    assert values(spark, P.student_two_sided(*f(2.228138852, 10)), P.student_two_sided(*f(12.706204736, 1))) == pytest.approx([0.05, 0.05], abs=1e-7)
    assert values(spark, P.pearson3_cdf(*f(0.0, 0.0, 0.0, 1.0)))[0] == pytest.approx(0.5)
    # skew 2 is a shifted exponential: P(Z <= z) = 1 - exp(-(z + 1))
    assert values(spark, P.pearson3_cdf(*f(0.5, 2.0, 0.0, 1.0)), P.pearson3_cdf(*f(-0.5, -2.0, 0.0, 1.0))) == pytest.approx([1 - math.exp(-1.5), math.exp(-1.5)], abs=1e-10)
    x = np.random.default_rng(1).gamma(3.0, 2.0, 50000)
    assert values(spark, P.gamma_shape(F.lit(float(math.log(x.mean()) - np.log(x).mean()))))[0] == pytest.approx(3.0, rel=0.03)


def test_special_functions_against_the_standard_library(spark):
    a = [1e-3, 0.2, 0.5, 1.0, 3.7, 12.0, 80.0, 900.0, 1e5]
    rows = spark.createDataFrame([(v,) for v in a], "a double").select("a", P.lgamma("a"), P.digamma("a"), P.trigamma("a")).collect()
    for r in rows:
        assert r[1] == pytest.approx(math.lgamma(r[0]), rel=1e-12, abs=1e-12)
        h = 1e-4 * r[0]
        slope = (math.lgamma(r[0] + h) - math.lgamma(r[0] - h)) / (2 * h)
        assert r[2] == pytest.approx(slope, rel=1e-5, abs=1e-4)
    assert values(spark, P.digamma(F.lit(1.0)), P.trigamma(F.lit(1.0))) == pytest.approx([-0.5772156649015329, math.pi**2 / 6], abs=1e-11)
    z = [-6.0, -1.5, -1e-9, 0.0, 0.3, 4.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(P.normal_cdf("z")).collect()]
    assert got == pytest.approx([NormalDist().cdf(v) for v in z], abs=1e-14)
    pairs = [(a, x) for a in (0.05, 0.5, 1.0, 7.3, 60.0, 2500.0) for x in (1e-6, 0.3, 1.0, 7.0, 61.5, 2600.0, 9000.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, x double").select(P.lower_gamma("a", "x")).collect()]
    want = [min(1.0, math.fsum(math.exp((a + n) * math.log(x) - x - math.lgamma(a + n + 1)) for n in range(12000))) for a, x in pairs]
    assert got == pytest.approx(want, abs=1e-10)
    none = values(spark, P.lower_gamma(F.lit(0.0), F.lit(1.0)), P.lower_gamma(F.lit(None).cast("double"), F.lit(1.0)), P.gamma_shape(F.lit(-1.0)), P.student_two_sided(F.lit(1.0), F.lit(0)), P.pearson3_cdf(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    assert none == [None] * 5
    assert values(spark, P.lower_gamma(F.lit(2.0), F.lit(-1.0)), P.beta_cdf(F.lit(0.0), F.lit(1.0), F.lit(2.0)), P.beta_cdf(F.lit(0.25), F.lit(1.0), F.lit(2.0)), P.beta_cdf(F.lit(0.9), F.lit(3.0), F.lit(1.0))) == pytest.approx([0.0, 0.0, 1 - 0.75**2, 0.9**3])


def test_loglogistic_fit_recovers_its_parameters(spark):
    u = np.random.default_rng(2).uniform(size=4000)
    x = 50 * (u / (1 - u)) ** (1 / 3.0)
    df = spark.createDataFrame([(x.tolist(),), ([2.0, 2.0, 2.0],), ([1.0],), ([3.0, 0.0, -1.0, 5.0],)], "x array<double>")
    full, same, one, two = [r[0] for r in df.select(P.fit_loglogistic("x")).collect()]
    assert full["shape"] == pytest.approx(3.0, rel=0.06) and full["scale"] == pytest.approx(50, rel=0.03)
    assert same is None and one is None and two is not None

    def loss(shape, scale):
        z = (np.log(x) - math.log(scale)) * shape
        return float(np.sum(z - math.log(shape) + 2 * np.logaddexp(0, -z)))

    best = loss(full["shape"], full["scale"])
    assert all(best <= loss(full["shape"] * a, full["scale"] * b) for a in (0.999, 1, 1.001) for b in (0.999, 1, 1.001))


def test_projection_of_a_known_point_and_back(spark):
    df = spark.createDataFrame([(2.3522, 48.8566), (3.0, 46.5)], "lon double, lat double")
    x, y = G.to_lambert93("lon", "lat")
    df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = G.from_lambert93("x", "y")
    rows = df.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert (rows[0]["x"], rows[0]["y"]) == pytest.approx((652469.0, 6862035.3), abs=1.0)
    assert (rows[1]["x"], rows[1]["y"]) == pytest.approx((700000, 6600000), abs=1e-6)
    for r in rows:
        assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-10)


def test_ray_casting_and_edge_distance(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (4, 0), (4, 3), (0, 3))])
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (6.0, 5.0)], "lon double, lat double")
    rows = df.select(G.inside_ring("lon", "lat", ring), G.ring_distance("lon", "lat", ring), G.ring_area(ring)).collect()
    assert [r[0] for r in rows] == [True, False, False]
    assert [r[1] for r in rows] == pytest.approx([1.0, 1.0, math.hypot(2, 2)])
    assert rows[0][2] == 12


def test_level_cells(spark):
    cells = ["alerte", '["alerte", "crise", "x"]', "x", "[broken", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    rows = df.select(X.severity_max("c"), F.size(X.known_levels("c"))).collect()
    assert [tuple(r) for r in rows] == [(2, 1), (4, 2), (0, 0), (0, 0), (0, 0), (0, 0)]
    n = spark.createDataFrame([("a, ,b,",), (None,)], "c string").select(X.item_count("c")).collect()
    assert [r[0] for r in n] == [2, 0]


def test_weight_guards(spark):
    with pytest.raises(ValueError):
        S.check_weights({"a": 0.6, "b": 0.5})
    bad = spark.createDataFrame([(0.5, 0.4)], "a double, b double").select(S.guard_weights(["a", "b"]))
    with pytest.raises(Exception, match="weights must sum to 1"):
        bad.collect()


def test_clip_and_sentinels_keep_null(spark):
    df = spark.createDataFrame([(None,), (-9999.0,), (-9998.5,), (0.5,), (3.0,)], "v double")
    rows = df.select(S.clip01("v"), S.drop_sentinels("v")).collect()
    assert [r[0] for r in rows] == [None, 0.0, 0.0, 0.5, 1.0]
    assert [r[1] for r in rows] == [None, None, None, 0.5, 3.0]
