"""Published values, identities and gates."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.functions.columns import checked_range, close, finite, hashed_index, hashed_normal, log_checked, month_day, number_range, number_text, optional_number, or_null, sentinel_to_null, strict_boolean, t_two_sided
from lodestrand.operators import contracts, linear, rankstats, relational, timeseries, validation
from lodestrand.sources import readers, sinks
from lodestrand.streaming.daily import daily_means


def test_t_probability():
    assert t_two_sided(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.5, abs=1e-9)
    assert t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(np.array([0.0, 3.0]), np.array([5.0, 27.0])) == pytest.approx([1.0, 0.005736], abs=2e-5)


def test_shapiro_wilk_reference_values(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rng = np.random.default_rng(4)
    groups = {"w": weights, "three": [1.0, 2.0, 4.0], "four": [1.0, 2.0, 4.0, 4.5], "five": [3.0, 1.0, 9.0, 2.0, 2.5], "flat": [1.0, 1.0, 1.0], "two": [1.0, 2.0], "many": rng.normal(size=400).tolist(), "long": rng.normal(size=5001).tolist()}
    df = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own], "g string, v double")
    got = {r.g: (r.w, r.p) for r in linear.shapiro_wilk(df, "v", ["g"]).collect()}
    assert got["w"] == pytest.approx((0.79, 0.0067), abs=0.005)
    for g in ("w", "three", "four", "five", "many", "long"):
        x = np.sort(groups[g])
        w = float(linear.shapiro_weights(len(x)) @ x) ** 2 / ((x - x.mean()) ** 2).sum()
        assert got[g][0] == pytest.approx(w)
    assert got["flat"] == got["two"] == (None, None) and got["long"][1] is None and got["many"][1] > 0.01


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(0, 40))
def test_exact_kendall_p_is_a_probability(n, s):
    most = n * (n - 1) // 2
    s = min(s, most) // 2 * 2 + most % 2
    p = rankstats.kendall_p(n, min(s, most), [])
    assert 0 < p <= 1
    assert rankstats.mahonian_p(n, most) == pytest.approx(min(1, 2 / math.factorial(n)))


def test_midrank_sum_and_spearman_p(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in ((1.0, 2.0), (1.0, 1.0), (2.0, 5.0), (3.0, 4.0), (9.0, 9.0))], "g string, x double, y double")
    assert df.select(rankstats.midrank("x", ["g"]).alias("r")).agg(F.sum("r")).first()[0] == 15
    row = rankstats.spearman(df, "x", "y", ["g"], p=True).first()
    assert row.rho == pytest.approx(0.8720816, abs=1e-6) and 0.04 < row.p < 0.07
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert rankstats.spearman(flat, "x", "y", ["g"]).first().rho is None


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([("g", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "g string, a double, b double, y double")
    got = {r.term: r.coef for r in linear.ridge(df, ["a", "b"], "y", ["g"], 0.0).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)[0]
    assert [got["intercept"], got["a"], got["b"]] == pytest.approx(list(want))
    vifs = {r.term: r.vif for r in linear.vif(df, ["a", "b"], ["g"]).collect()}
    assert vifs["a"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2))
    scored = linear.leave_group_out_ridge(df.withColumn("k", (F.col("a") > 0).cast("int")), ["a", "b"], "y", "k", [0.1, 1000.0]).collect()
    assert [r.alpha for r in scored if r.best] == [0.1]


def test_gap_fill_edges(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None, None, None, None, 9.0])], "s string, p long, v double")
    got = [r.filled for r in timeseries.fill_short_gaps(df, "v", "p", ["s"]).orderBy("p").collect()]
    assert got == [None, 1, 2, 3, 4, None, None, None, None, 9]
    with pytest.raises(Exception, match="gap is left"):
        timeseries.fill_short_gaps(df, "v", "p", ["s"], strict=True).collect()


def test_trailing_mean_of_a_constant(spark):
    df = spark.createDataFrame([("s", i, 5.0) for i in range(9)], "s string, p long, v double")
    assert {r[0] for r in df.select(timeseries.trailing_mean("v", 4, ["s"], ["p"])).collect()} == {5.0}


def test_gates(spark):
    df = spark.createDataFrame([("1", "true"), (" ", "FALSE")], "a string, b string")
    assert [tuple(r) for r in df.select(optional_number(F.col("a")), strict_boolean(F.col("b"))).collect()] == [(1.0, True), (None, False)]
    with pytest.raises(Exception, match="not a boolean"):
        df.select(strict_boolean(F.lit("yes"))).collect()
    with pytest.raises(Exception, match="domain"):
        df.select(log_checked(F.lit(0.0))).collect()
    with pytest.raises(ValueError, match="missing columns: c"):
        contracts.require_columns(df, ["a", "c"])
    with pytest.raises(Exception, match="repeat"):
        relational.one_to_one(df.unionAll(df), df, ["a"]).collect()
    checks = contracts.run_checks(df, {"is_true": ("domain", F.col("b") == "true"), "named": ("schema", F.col("a").isNotNull())})
    with pytest.raises(ValueError, match="is_true"):
        contracts.enforce(checks)
    assert spark.range(1).select(sentinel_to_null(F.lit(-9999.0), -9999.0), close(F.lit(1.0), F.lit(1.0 + 1e-12))).first()[:] == (None, True)


def test_strict_lag_join(spark):
    panel = spark.createDataFrame([(5,), (9,)], "m long")
    series = spark.createDataFrame([(3, 1.5)], "m long, x double")
    assert [r.x for r in relational.lag_join(panel, series, "m", F.lit(2), ["x"]).orderBy("m").collect()] == [1.5, None]
    with pytest.raises(Exception, match="no row at 7"):
        relational.lag_join(panel, series, "m", F.lit(2), ["x"], strict=True).collect()


def test_domain_audit(spark):
    box = spark.createDataFrame([(0.0, 0.0), (10.0, 1.0)], "a double, b double")
    rows = spark.createDataFrame([(1, 5.0, 0.5), (2, 10.4, 0.5), (3, 12.0, -1.0)], "i int, a double, b double")
    got = {r.i: (r.outside, r.severity) for r in validation.domain_audit(rows, box, ["a", "b"], ["i"]).collect()}
    assert got == {2: ("a", "minor"), 3: ("a;b", "large")}


def test_hashed_index_is_stable(spark):
    df = spark.range(100)
    one = [r[0] for r in df.select(hashed_index(F.col("id"), F.lit(3), 1, F.lit(7))).collect()]
    two = [r[0] for r in df.repartition(5).orderBy("id").select(hashed_index(F.col("id"), F.lit(3), 1, F.lit(7))).collect()]
    assert one == two and set(one) <= set(range(7))


def test_text_and_json_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("SEAS YR TOTAL ANOM\n# note\n\nDJF 1950 24.7 -1.5\nJFM 1950  25.1 -1.3\n")
    got = readers.text_table(spark, str(tmp_path / "t.txt"), {"seas": "string", "yr": "int", "total": "double", "anom": "double"}, header="SEAS").collect()
    assert [(r.seas, r.yr, r.anom) for r in got] == [("DJF", 1950, -1.5), ("JFM", 1950, -1.3)]
    (tmp_path / "n.json").write_text('{"value": {"timeSeries": [{"variable": {"variableCode": [{"value": "00060"}]}, "values": [{"value": [{"value": "5", "qualifiers": ["A", "e"], "dateTime": "2001-01-01T00:00"}, {"value": "-999999", "qualifiers": [], "dateTime": "2001-01-02T00:00"}]}]}]}}')
    got = readers.nested_series(spark, str(tmp_path / "n.json"), "00060").collect()
    assert [(str(r.date), r.value, r.qualifiers) for r in got] == [("2001-01-01", 5.0, "A;e")]
    assert "value" in readers.json_document(spark, str(tmp_path / "n.json"))
    digests = readers.file_digests(spark, str(tmp_path / "t.txt")).collect()
    assert digests[0].sha256 == hashlib.sha256((tmp_path / "t.txt").read_bytes()).hexdigest().upper()


def test_csv_sources_check_the_header(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_bytes(text.encode())
        return str(tmp_path / name)

    kinds = "tmin double, tmax double"
    swapped = file("s.csv", '\ufeff"tmax","tmin","station"\n"9","1","A"\n"8","","B"\n')
    assert [tuple(r) for r in readers.csv_table(spark, swapped, kinds).collect()] == [(1.0, 9.0), (None, 8.0)]
    one = readers.csv_table(spark, swapped, kinds + ", station string", where=F.col("station") == "B", filled=True).collect()
    assert [r.tmax for r in one] == [8.0]
    with pytest.raises(ValueError, match="empty"):
        readers.csv_table(spark, swapped, kinds + ", station string", where=F.col("station") == "C", filled=True)
    with pytest.raises(ValueError, match="missing columns: tmin, tmax"):
        readers.csv_table(spark, file("f.csv", "foo,bar\n1,2\n"), kinds)
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.csv_table(spark, file("m.csv", "tmin,tmax\nx,2\n"), kinds).collect()
    assert readers.csv_inferred(spark, file("i.csv", "a,b\n1,x\n"), ["a"]).dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(ValueError, match="missing columns: c"):
        readers.csv_inferred(spark, str(tmp_path / "i.csv"), ["c"])
    pre = file("p.csv", "2026 report, v1\nabout\nDate,Value\n2001-01-01,3.5\n2001-01-02,\n")
    assert [r.v for r in readers.preamble_csv(spark, pre, "Date,", "d date, v double").collect()] == [3.5, None]
    with pytest.raises(ValueError, match="no header"):
        readers.preamble_csv(spark, pre, "Day,", "d date, v double")
    values = readers.sentinel_csv(spark, file("v.csv", "PDO,Date\n-9999,2001-01-01\n1.5,2001-02-01\n")).collect()
    assert [r.value for r in values] == [None, 1.5]


def test_sinks(spark, tmp_path):
    made = sinks.publish(spark, {"t": spark.range(3)}, str(tmp_path / "package"))
    assert made["tables"]["t"]["rows"] == 3 and sinks.read_manifest(spark, str(tmp_path / "package")) == made
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"t": spark.range(3)}, str(tmp_path / "package"))
    with pytest.raises(Exception, match="gap"):
        sinks.publish(spark, {"a": spark.range(1), "b": spark.range(1).select(F.raise_error(F.lit("gap")))}, str(tmp_path / "half"))
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["package"]
    df = spark.createDataFrame([(1 / 3, "a"), (None, "b")], "x double, s string")
    assert [r.x for r in sinks.formatted(df, missing="NA").collect()] == ["0.3333333333", "NA"] and sinks.formatted(df).collect()[1].x is None
    sinks.write_csv_file(sinks.formatted(df), str(tmp_path / "deep" / "one.csv"))
    assert (tmp_path / "deep" / "one.csv").read_bytes() == b'\xef\xbb\xbf"x","s"\n"0.3333333333","a"\n"","b"\n'
    assert [r.s for r in readers.csv_table(spark, str(tmp_path / "deep" / "one.csv"), "s string, x double").collect()] == ["a", "b"]
    sinks.write_csv(df, str(tmp_path / "many"))
    assert readers.csv_inferred(spark, str(tmp_path / "many")).count() == 2
    path = str(tmp_path / "m.json")
    sources = {"a": {"sha256": "1", "url": "u"}}
    assert sinks.keep_manifest(spark, sources, path) == sinks.keep_manifest(spark, sources, path)
    for changed in ({"sha256": "2", "url": "u"}, {"sha256": "1", "url": "w"}):
        with pytest.raises(ValueError, match="immutable"):
            sinks.keep_manifest(spark, {"a": changed}, path)
    with pytest.raises(ValueError, match="immutable"):
        sinks.keep_manifest(spark, {**sources, "b": {"sha256": "1"}}, path)


def test_windows_of_any_number(spark):
    """1500 windows that each hold one day, and overlapping ones."""
    days = spark.sql("SELECT date '2001-03-05' AS d, 1 AS __md UNION ALL SELECT date '2001-12-31', 2")
    many = spark.range(1500).select(F.col("id").alias("window_id"), F.lit(305).cast("long").alias("start_md"), F.lit(305).cast("long").alias("end_md"))
    assert relational.window_members(days, many, month_day(F.col("d"))).count() == 1500
    two = spark.createDataFrame([("a", 101, 1231), ("b", 228, 305), ("c", 306, 1230)], "w string, start_md long, end_md long")
    got = sorted((str(r.d), r.w) for r in relational.window_members(days, two, month_day(F.col("d"))).collect())
    assert got == [("2001-03-05", "a"), ("2001-03-05", "b"), ("2001-12-31", "a")]


def test_hashed_normal_has_normal_moments(spark):
    x = np.array([r[0] for r in spark.range(60_000).select(hashed_normal(F.col("id"), F.lit(3), 7)).collect()])
    y = np.array([r[0] for r in spark.range(60_000).select(hashed_normal(F.col("id"), F.lit(4), 7)).collect()])
    assert abs(x.mean()) < 0.015 and x.std() == pytest.approx(1, abs=0.015)
    assert abs((x**3).mean()) < 0.05 and (x**4).mean() == pytest.approx(3, abs=0.1)
    assert np.quantile(x, [0.05, 0.95]) == pytest.approx([-1.645, 1.645], abs=0.03)
    assert abs(np.corrcoef(x, y)[0, 1]) < 0.02 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.02


def test_ols_with_two_predictors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2)) @ [[1, 0.3], [0, 2]] + 5
    y = np.exp(1 + x @ [0.2, -0.1] + rng.normal(size=40) * 0.2)
    df = spark.createDataFrame([("g", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "g string, t int, a double, b double, y double")
    coefficients, diagnostics, summary = linear.ols(df, ["a", "b"], "y", ["g"], "t", log1p=True)
    z = np.c_[np.ones(40), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)]
    inverse = np.linalg.inv(z.T @ z)
    beta = inverse @ z.T @ np.log1p(y)
    e, h = np.log1p(y) - z @ beta, np.einsum("ij,jk,ik->i", z, inverse, z)
    robust = inverse @ (z.T * (e / (1 - h)) ** 2) @ z @ inverse
    got = {r.term: r for r in coefficients.collect()}
    for i, term in enumerate(("const", "a", "b")):
        assert (got[term].coef, got[term].se) == pytest.approx((beta[i], math.sqrt(robust[i, i])))
        assert got[term].ci_high - got[term].coef == pytest.approx(2.0261925 * math.sqrt(robust[i, i]), rel=1e-6)
    assert got["a"].percent_effect == pytest.approx(100 * math.expm1(beta[1])) and got["const"].percent_effect is None
    mse = e @ e / 37
    cook = e**2 * h / (3 * mse * (1 - h) ** 2)
    left = np.array([r.cook for r in diagnostics.orderBy("t").collect()])
    assert left == pytest.approx(cook) and summary.first().max_cook_at == int(cook.argmax())
    without = (mse * 37 - e**2 / (1 - h)) / 36
    assert [r.studentized for r in diagnostics.orderBy("t").collect()] == pytest.approx(list(e / np.sqrt(without * (1 - h))))
    tss = ((np.log1p(y) - np.log1p(y).mean()) ** 2).sum()
    assert summary.first().adjusted_r2 == pytest.approx(1 - mse / (tss / 39))
    refit = linear.influence_refit(df, ["a", "b"], "y", ["g"], "t", log1p=True).collect()
    assert {r.term for r in refit} == {"a", "b"} and {(r.full_n, r.refit_n, r.omitted) for r in refit} == {(40, 39, int(cook.argmax()))}
    for bad in (df.withColumn("b", F.lit(1.0)), df.withColumn("b", F.col("a") * 2), df.limit(4)):
        with pytest.raises(Exception, match="constant|dependent|too few"):
            linear.ols(bad, ["a", "b"], "y", ["g"], "t")[0].collect()
    fit = linear.ridge(df, ["a", "b"], "y", ["g"], 0.0)
    assert linear.predict(df, fit, ["a", "b"], ["g"]).agg(F.avg(F.col("predicted") - F.col("y"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_nested_ridge_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 3))
    raw = np.round(np.exp(3 + x @ [0.5, -0.2, 0.1] + rng.normal(size=25) * 0.3))
    df = spark.createDataFrame([("s", i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, raw, strict=True))], "s string, t int, a double, b double, c double, y double")
    alphas, y = [0.1, 1.0, 10.0, 100.0], np.log1p(raw)

    def fitted(n, alpha, new):
        mean, sd = x[:n].mean(axis=0), x[:n].std(axis=0)
        z = np.c_[np.ones(n), (x[:n] - mean) / sd]
        beta = np.linalg.pinv(z.T @ z + alpha * np.diag([0, 1, 1, 1])) @ z.T @ y[:n]
        return max(0.0, math.expm1(np.r_[1.0, (new - mean) / sd] @ beta))

    want = {}
    for i in range(12, 25):
        tests = range(max(6, i - 6), i)
        alpha = min((float(np.mean([abs(fitted(k, a, x[k]) - raw[k]) for k in tests])), a) for a in alphas)[1]
        want[i] = (alpha, pytest.approx(fitted(i, alpha, x[i])))
    got = {r.t: (r.alpha, r.predicted) for r in linear.nested_ridge(df, ["a", "b", "c"], "y", ["s"], "t", alphas).collect()}
    assert got == want
    short = linear.nested_ridge(df, ["a"], "y", ["s"], "t", [0.1], least=7).where("t < 9").collect()
    assert {r.alpha for r in short} == {10.0}


def test_trend_and_leave_one_out_on_short_series(spark):
    values = [3.0, 1.0, 4.0, 1.5, 5.0, 9.0, 2.0, 6.0, 5.5, float("nan")]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "g string, t long, v double")
    row = rankstats.trend(df, "t", "v", ["g"]).first()
    s = sum(np.sign(b - a) for i, a in enumerate(values[:9]) for b in values[i + 1 : 9])
    assert row.n == 9 and row.tau == pytest.approx(s / 36) and row.p == pytest.approx(rankstats.mahonian_p(9, int(s)))
    slopes = sorted((values[j] - values[i]) / (j - i) for i in range(9) for j in range(i + 1, 9))
    assert row.slope == pytest.approx(np.median(slopes)) and row.low in slopes and row.high in slopes
    assert row.intercept == pytest.approx(np.median([v - row.slope * i for i, v in enumerate(values[:9])]))
    assert row.first_mean == pytest.approx(np.mean(values[:5])) and row.last_mean == pytest.approx(np.mean(values[4:9]))


def test_contract_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 30.0)], "g string, v double")
    got = {r.check_id: r.passed for r in contracts.gate_table(df, {"few": ("n", F.count("*"), F.col("value") < 3), "low": ("v", F.max("v"), F.col("value") <= 30)}).collect()}
    assert got == {"few": False, "low": True}
    with pytest.raises(ValueError, match="few"):
        contracts.enforce(contracts.gate_table(df, {"few": ("n", F.count("*"), F.col("value") < 3)}))
    totals = df.groupBy("g").agg(F.sum("v").alias("v"))
    known = spark.createDataFrame([("a", 3.0), ("b", 31.0), ("c", 1.0)], "g string, v double")
    assert [r.agrees for r in contracts.reconcile(totals, known, ["g"], "v", 0.5).orderBy("g").collect()] == [True, False, False]
    with pytest.raises(Exception, match="out of range"):
        df.select(checked_range(F.col("v"), 0, 30 - 1, "temperature")).collect()
    assert df.select(checked_range(F.col("v"), 0, 30, "temperature")).count() == 3
    assert [r[0] for r in spark.range(2).select(number_text(F.when(F.col("id") > 0, 0.5), "%.2f")).collect()] == ["NA", "0.50"]
    assert spark.range(1).select(or_null(F.lit(float("nan"))), finite(F.lit(float("inf")))).first()[:] == (None, False)
    assert [r.y for r in number_range(spark, 3, "y", start=1990).collect()] == [1990, 1991, 1992]
    spine = spark.createDataFrame([(1,), (2,)], "d long")
    with pytest.raises(Exception, match="repeat"):
        relational.onto_spine(spine, {"a": spine.unionAll(spine)}, "d").collect()


def test_daily_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = daily_means(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("daily_stream").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    key = lambda r: (str(r.d), r.event_type)
    want = {key(r): (r.n, round(r.mean, 6)) for r in daily_means(events).collect()}
    assert {key(r): (r.n, round(r.mean, 6)) for r in spark.table("daily_stream").collect()} == want


@pytest.mark.parametrize("n", [29, 80, 400])
def test_hashed_replicates_spread_as_they_should(spark, n):
    """The mean of a bootstrap sample has the deviation s / sqrt(n), a permuted correlation 1 / sqrt(n - 1)."""
    reps = 4000
    at = spark.range(reps).select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    got = at.select("id", hashed_index(F.col("id"), F.col("pos"), 11, F.lit(n)).alias("i"), hashed_index(F.col("id"), F.col("pos"), 5, F.lit(2147483647)).alias("k"))
    frame = got.orderBy("id", "pos").toPandas()
    drawn, keys = (frame[c].to_numpy().reshape(reps, n) for c in ("i", "k"))
    trend = (np.arange(n) - (n - 1) / 2) / math.sqrt((n * n - 1) / 12)
    assert trend[drawn].mean(axis=1).std() == pytest.approx(1 / math.sqrt(n), rel=0.05)
    orders = np.argsort(keys, axis=1, kind="stable")
    assert len({o.tobytes() for o in orders}) > 0.97 * reps
    assert (trend[orders] * trend).mean(axis=1).std() == pytest.approx(1 / math.sqrt(n - 1), rel=0.06)


def test_corrections_leave_out_tests_without_p(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.01), ("c", 0.02), ("d", float("nan"))], "k string, p double")
    got = {r.k: (r.q, r.holm, r.passed) for r in rankstats.holm(rankstats.benjamini_hochberg(df, "p", [], ["k"]), "p", [], ["k"]).collect()}
    assert got == {"a": (None, None, None), "d": (None, None, None), "b": (0.02, 0.02, True), "c": (0.02, 0.02, True)}


def test_csv_folders(spark, tmp_path):
    """Files of one header are one table; another order of columns in a later file raises instead of swapping data."""
    for name, text in (("good/a.csv", "tmin,tmax\n1,9\n"), ("good/b.csv", "tmin,tmax\n2,8\n"), ("bad/a.csv", "tmin,tmax\n1,9\n"), ("bad/b.csv", "tmax,tmin\n9,1\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    kinds = "tmax double, tmin double"
    assert sorted(tuple(r) for r in readers.csv_table(spark, str(tmp_path / "good"), kinds).collect()) == [(8.0, 2.0), (9.0, 1.0)]
    with pytest.raises(Exception, match="header"):
        readers.csv_table(spark, str(tmp_path / "bad"), kinds).collect()
    (tmp_path / "d.csv").write_bytes('﻿date,tmin\n2001-01-01,1\n2001-01-02,5\n2001-01-01,\n2001-01-02,6\n'.encode())
    last = readers.csv_table(spark, str(tmp_path / "d.csv"), "date date, tmin double", last_of=["date"]).collect()
    assert sorted((str(r.date), r.tmin) for r in last) == [("2001-01-01", None), ("2001-01-02", 6.0)]
