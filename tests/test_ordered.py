"""Cell-wise order operations equal plain windows, with a hot group and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import ordered as O
from plumbline.operators import rollups as R
from plumbline.operators import slices as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.4, 0, rng.integers(0, 9, n)),
                        "t": np.where(rng.random(n) < 0.3, 500, rng.integers(0, 4000, n)), "x": np.round(rng.lognormal(0, 2, n), 2)})
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("whole,bracket", [(4000, 2_000_000), (10, 2_000_000), (10, 50)])
def test_quantiles(spark, skewed, monkeypatch, whole, bracket):
    monkeypatch.setattr(O, "WHOLE", whole)
    monkeypatch.setattr(O, "BRACKET", bracket)
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    for by in ([], ["g"]):
        got = O.quantiles(frame(spark, skewed), ["x", "t"], probs, by).toPandas()
        keyed = skewed.groupby("g") if by else [((), skewed)]
        for key, part in keyed:
            for c in ("x", "t"):
                rows = got[(got["column"] == c) & ((got["g"] == key) if by else True)].sort_values("p")
                np.testing.assert_allclose(rows["value"], np.nanquantile(part[c], probs), rtol=1e-12)
                assert set(rows["n"]) == {part[c].notna().sum()}


def test_many_groups_fall_back(spark, skewed, monkeypatch):
    monkeypatch.setattr(O, "MAX_GROUPS", 3)
    got = O.quantiles(frame(spark, skewed), ["t"], [0.5], ["g"]).toPandas().set_index("g")["value"]
    pd.testing.assert_series_equal(got.sort_index(), skewed.groupby("g")["t"].median().astype(float), check_names=False)


def test_empty_input(spark):
    d = spark.createDataFrame([], "x double")
    assert O.quantiles(d, ["x"], [0.5]).count() == 0


@pytest.mark.parametrize("peers", [True, False])
def test_running_total(spark, skewed, peers):
    d = frame(spark, skewed).withColumn("x", F.coalesce("x", F.lit(0.0)))
    if not peers:
        d = d.withColumn("t", F.col("id"))
    got = O.running_total(d, ["g"], "t", {"s": "x"}, cells=16, peers=peers).toPandas().set_index("id")["s"].sort_index()
    w = Window.partitionBy("g").orderBy("t")
    want = d.withColumn("s", F.sum("x").over(w)).toPandas().set_index("id")["s"].sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("cells", [None, 16])
def test_lookback_rows(spark, skewed, cells):
    d = frame(spark, skewed).withColumn("x", F.coalesce("x", F.lit(0.0)))
    w = Window.partitionBy("g").orderBy("t", "id")
    want = d.withColumns({"l": F.lag("x", 5, -1.0).over(w), "m": F.avg("x").over(w.rowsBetween(-3, 0)), "r": F.row_number().over(w)}).toPandas().set_index("id").sort_index()
    lag = R.lagged(d, ["g"], ["t", "id"], "x", 5, -1.0, cells).toPandas().set_index("id").sort_index()["lagged"]
    mov = R.moving_mean(d, ["g"], ["t", "id"], "x", 3, cells).toPandas().set_index("id").sort_index()["moving"]
    num = R.row_numbers(d, ["g"], ["t", "id"], cells).toPandas().set_index("id").sort_index()["rn"]
    np.testing.assert_allclose(lag, want["l"])
    np.testing.assert_allclose(mov, want["m"])
    np.testing.assert_array_equal(num, want["r"])


def test_only_heavy_groups_are_cut(spark, skewed, monkeypatch):
    monkeypatch.setattr(O, "HEAVY", 2_500)
    d = O.with_cell(frame(spark, skewed), ["g"], "id").groupBy("g", "_cell", "_split").count().toPandas()
    hot = d[d["g"] == 0]["count"]
    assert len(hot) == -(-hot.sum() // 2_500) and hot.max() < 1.2 * hot.mean()
    assert set(d[d["g"] != 0]["_cell"]) == {0} and not d[d["g"] != 0]["_split"].any()
    one = O.running_total(frame(spark, skewed), [], "id", {"s": "t"}).toPandas().sort_values("id")["s"]
    np.testing.assert_array_equal(one, skewed["t"].cumsum())


def test_staleness_cut_equals_whole(spark, skewed):
    d = spark.createDataFrame(skewed[["id", "g", "t"]])
    reads, fresh = d.where("id % 3 > 0"), d.where("id % 3 = 0")
    a = S.staleness(reads, fresh, "g", "t", cells=16).select("id", "age").toPandas().set_index("id").sort_index()
    b = S.staleness(reads, fresh, "g", "t").select("id", "age").toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(a, b)
    part = skewed[skewed["g"] == 3]
    times = np.sort(part[part["id"] % 3 == 0]["t"])
    for i, t in part[part["id"] % 3 > 0][["id", "t"]].head(50).itertuples(index=False):
        k = np.searchsorted(times, t)
        assert (a.loc[i, "age"] == t - times[k - 1]) if k else pd.isna(a.loc[i, "age"])


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("cells", [1, 3, 900])
def test_null_order_values_come_first_however_many_cells(spark, by, cells):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 2)), None if i % 9 == 0 else int(rng.integers(0, 2000)), 1.0 + i % 3) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, g int, t long, x double")
    got = {r["id"]: r["s"] for r in O.running_total(d, by, "t", {"s": "x"}, cells=cells).collect()}
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["s"] for r in d.withColumn("s", F.sum("x").over(w)).collect()}
    assert got == want


ORDERS = [[O.Key("v", True), "id"], [O.Key("v", True, True), O.Key("name", nulls_first=False), O.Key("id", True)],
          [O.Key("v", nulls_first=False), O.Key("name", True), "id"], ["name", O.Key("v", True, True), "id"]]


@pytest.mark.parametrize("by, order", [([], ORDERS[0]), (["g"], ORDERS[1]), ([], ORDERS[2]), (["g"], ORDERS[3])])
def test_directions_and_null_order_however_many_cells(spark, by, order):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 5 == 0) if i % 11 else None, None if i % 9 == 0 else float(rng.integers(0, 40)), None if i % 13 == 0 else f"n{rng.integers(0, 6)}", 1.0 + i % 3) for i in range(1500)]
    d = spark.createDataFrame(rows, "id long, g int, v double, name string, x double")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(*[k.column() for k in O.sort_keys(order)])
    peers = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(O.sort_keys(order)[0].column())
    want = d.withColumns({"l": F.lag("x", 4, -1.0).over(w), "m": F.avg("x").over(w.rowsBetween(-3, 0)), "r": F.row_number().over(w),
                          "s": F.sum("x").over(w), "p": F.sum("x").over(peers)}).toPandas().set_index("id").sort_index()
    for cells in (None, 40):
        col = lambda out, c: out.select("id", c).toPandas().set_index("id").sort_index()[c].to_numpy()
        np.testing.assert_array_equal(col(R.row_numbers(d, by, order, cells), "rn"), want["r"])
        np.testing.assert_allclose(col(R.lagged(d, by, order, "x", 4, -1.0, cells), "lagged"), want["l"])
        np.testing.assert_allclose(col(R.moving_mean(d, by, order, "x", 3, cells), "moving"), want["m"])
        np.testing.assert_allclose(col(O.running_total(d, by, order, {"s": "x"}, cells, peers=False), "s"), want["s"])
        np.testing.assert_allclose(col(O.running_total(d, by, order[0], {"s": "x"}, cells), "s"), want["p"])


def test_one_order_value_is_spread_over_cells(spark):
    d = spark.range(4000).select("id", F.lit(7).alias("t"), F.lit("a").alias("g"), F.lit(1.0).alias("x"))
    for by in ([], ["g"]):
        sizes = O.with_order_cells(d, by, ["t"], 10).groupBy("_cell").count().toPandas()["count"]
        assert len(sizes) == 10 and sizes.max() < 1000
        assert sorted(r["rn"] for r in R.row_numbers(d, by, ["t"], 10).collect()) == list(range(1, 4001))
        assert {r["s"] for r in O.running_total(d, by, "t", {"s": "x"}, 10).collect()} == {4000.0}
        assert sorted(r["s"] for r in O.running_total(d, by, "t", {"s": "x"}, 10, peers=False).collect()) == [float(i) for i in range(1, 4001)]
        lag = R.lagged(d, by, ["t"], "id", 3, -1, 10).toPandas()["lagged"]
        assert (lag == -1).sum() == 3 and lag[lag >= 0].is_unique
    same = spark.range(500).select(F.lit(1).alias("t"), F.lit(2.0).alias("x"))  # equal in every column
    assert sorted(r["rn"] for r in R.row_numbers(same, [], ["t"], 5).collect()) == list(range(1, 501))
    assert R.row_numbers(d.limit(0), [], ["t"]).count() == 0 and O.running_total(d.limit(0), ["g"], "t", {"s": "x"}, 4).count() == 0
