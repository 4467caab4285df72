"""Models from shared sums against plain loops."""

import datetime
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lodestrand.operators import linear, models, validation


def series(spark, n=40, groups=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        x = rng.normal(size=(n, 2)) * [2.0, 0.5] + [10, -3]
        y = np.expm1(2 + 0.2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n) * 0.3)
        rows += [(g, i, i % 5, *map(float, x[i]), float(max(y[i], 0.0))) for i in range(n)]
    return spark.createDataFrame(rows, "g string, t int, fold int, x1 double, x2 double, y double")


def fit(x, y, alpha):
    """Intercept and raw slopes of a ridge on standardized columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return np.r_[y.mean() - mean @ beta, beta]


def test_held_out_equals_refits(spark):
    df = series(spark)
    frame = df.toPandas()
    got = models.held_out(df, ["x1", "x2"], "y", "fold", [0.5, 20.0], ["g"]).toPandas()
    assert len(got) == 2 * len(frame)
    for r in got.itertuples():
        own = frame[(frame.g == r.g) & (frame.fold != r.fold)]
        coef = fit(own[["x1", "x2"]].to_numpy(), own.y.to_numpy(), r.alpha)
        assert r.held_out == pytest.approx(coef @ [1, r.x1, r.x2], rel=1e-7)
    best = {r.g: r.alpha for r in models.chosen_alpha(models.held_out(df, ["x1", "x2"], "y", "fold", [0.5, 20.0], ["g"]), "y", ["g"]).collect()}
    errors = got.assign(e=(got.held_out - got.y) ** 2).groupby(["g", "alpha"]).e.mean()
    assert best == {g: errors[g].idxmin() for g in ("a", "b")}
    whole = models.held_out(df, ["x1"], "y", "fold", [1.0]).toPandas()
    own = frame[frame.fold != 2]
    row = whole[whole.fold == 2].iloc[0]
    assert row.held_out == pytest.approx(fit(own[["x1"]].to_numpy(), own.y.to_numpy(), 1.0) @ [1, row.x1], rel=1e-7)


def test_folds_that_cannot_be_fitted_raise(spark):
    flat = spark.createDataFrame([(i % 2, 1.0, float(i), 2.0 * i, float(i * i)) for i in range(12)], "fold int, a double, b double, c double, y double")
    for features, alpha, what in ((["a"], 1.0, "constant"), (["b", "c"], 0.0, "singular")):
        with pytest.raises(Exception, match=what):
            models.held_out(flat, features, "y", "fold", [alpha]).collect()
    with pytest.raises(Exception, match="too few"):
        models.held_out(flat.limit(3), ["b", "c"], "y", "fold", [1.0]).collect()
    assert models.held_out(flat, ["b", "c"], "y", "fold", [1.0]).count() == 12


def test_model_table_equals_refits(spark):
    df = series(spark, n=22)
    frame = df.toPandas()
    got = models.model_table(df, {"two": (["x1", "x2"], [0.0]), "one": (["x2"], [0.1, 10.0])}, "y", ["g"], "t").toPandas()
    assert Counter(got.model) == dict.fromkeys(("two", "one", "expanding_mean", "previous"), 20)

    def predicted(own, features, at, alpha):
        before = own[own.t < at]
        coef = fit(before[features].to_numpy(), np.log1p(before.y.to_numpy()), alpha)
        return max(0.0, np.expm1(coef @ np.r_[1.0, own[own.t == at][features].to_numpy()[0]]))

    for r in got.itertuples():
        own = frame[frame.g == r.g]
        before = own[own.t < r.t]
        want = {"expanding_mean": before.y.mean(), "previous": before.y.iloc[-1]}
        if r.model == "two":
            want["two"] = predicted(own, ["x1", "x2"], r.t, 0.0)
        if r.model == "one":
            score = {a: np.mean([abs(predicted(own, ["x2"], at, a) - own.y.iloc[at]) for at in range(max(6, r.t - 6), r.t)]) for a in (0.1, 10.0)}
            assert r.alpha == min(score, key=lambda a: (score[a], a))
            want["one"] = predicted(own, ["x2"], r.t, r.alpha)
        assert r.predicted == pytest.approx(want[r.model], rel=1e-6) and r.train == r.t


def test_ridge_influence_equals_a_loop(spark):
    df = series(spark, n=30)
    frame, alpha, p = df.toPandas(), 10.0, 2
    diagnostics, summary, refits = (t.toPandas() for t in models.ridge_influence(df, ["x1", "x2"], "y", ["g"], "t", alpha, log1p=True))
    shapiro = {r.g: r for r in linear.shapiro_wilk(spark.createDataFrame(diagnostics), "residual", ["g"]).collect()}
    for g in ("a", "b"):
        own = frame[frame.g == g].sort_values("t")
        x, y = own[["x1", "x2"]].to_numpy(), np.log1p(own.y.to_numpy())
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        design = np.column_stack([np.ones(len(z)), z])
        inverse = np.linalg.inv(design.T @ design + np.diag([0.0, alpha, alpha]))
        beta = inverse @ design.T @ y
        e, h = y - design @ beta, np.diag(design @ inverse @ design.T)
        cook = e**2 / ((p + 1) * (e**2).sum() / (len(y) - p - 1)) * h / (1 - h) ** 2
        mine = diagnostics[diagnostics.g == g].sort_values("t")
        for column, want in (("residual", e), ("leverage", h), ("cook", cook)):
            assert mine[column].to_numpy() == pytest.approx(want, rel=1e-7)
        row, top = summary[summary.g == g].iloc[0], int(np.argmax(cook))
        assert row.max_cook_at == top and row.durbin_watson == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
        assert (row.shapiro_w, row.shapiro_p) == pytest.approx((shapiro[g].w, shapiro[g].p))
        keep = np.arange(len(y)) != top
        again = fit(x[keep], y[keep], alpha)[1:] * x[keep].std(axis=0)
        back = refits[refits.g == g].set_index("term")
        assert back.loc[["x1", "x2"], "refit_coef"].to_numpy() == pytest.approx(again, rel=1e-6)
        assert back.loc[["x1", "x2"], "full_coef"].to_numpy() == pytest.approx(beta[1:], rel=1e-6)
        assert (back.omitted == top).all()


def test_audit_counters_equal_counting(spark):
    rng, day = random.Random(2), datetime.date(2001, 1, 1)
    days = []
    for i in range(500):
        names = [n for n in ("v", "c") if rng.random() < 0.3]
        days.append((day + datetime.timedelta(i), ";".join(names) or None, rng.choice(["minor", "large"]) if names else None))
    windows = [("early", 301, 615), ("late", 601, 1231)]
    got = validation.audit_counters(spark.createDataFrame(days, "d date, outside string, severity string"), spark.createDataFrame(windows, "window_id string, start_md long, end_md long")).collect()
    n, of = Counter(), Counter()
    for s in validation.AUDIT_SETS:
        for d, outside, severity in days:
            md = d.month * 100 + d.day
            values = {"year": [str(d.year)], "month": [f"{d:%m-%b}"], "season": ["season" if 6 <= d.month <= 10 else "rest"], "severity": [severity] if severity else [], "feature": (outside or "").split(";") if outside else [], "window": [w for w, a, b in windows if a <= md <= b]}
            calendar = [k for k in s if k not in ("feature", "severity")]
            for key in itertools.product(*[values[k] for k in calendar]):
                of[s, key] += 1
            if outside:
                n.update((s, key) for key in itertools.product(*[values[k] for k in s]))
    want = {("+".join(s), " ".join(key)): (k, of[s, tuple(v for c, v in zip(s, key, strict=True) if c not in ("feature", "severity"))]) for (s, key), k in n.items()}
    assert {(r.kind, r.key): (r.n, r.of) for r in got} == want
    assert all(r.pct == pytest.approx(100 * r.n / r.of) for r in got)
