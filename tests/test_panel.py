"""Operators of the panel against brute force, and queries against their SQL at the smallest scale."""

import numpy as np
import pytest

from panelmill.functions.seeds import cell_key, derive_seed
from panelmill.functions import bookkeeping
from panelmill.operators import anomaly, breaks, capacity, features, forecasts, models, monitor, quality, segments
from panelmill.plans import ORACLE, QUERIES
from panelmill.settings import Settings
from panelmill.sources import files, sql
from panelmill.sources.panel import from_events
from tests.compare import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q1_daily_profile", "q3_zone_ranking", "q4_peak_windows", "q5_checks", "edges_one_way", "robust_scores", "metrics_grid", "input_monitor", "largest_remainder"])
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLE[name]).df()) == ""


def test_shift_refuses_the_future():
    with pytest.raises(ValueError):
        features.back("y", -1)


def test_folds_end_with_the_window():
    folds = forecasts.make_folds()
    assert folds[-1][2] == 720 and all(b[1] == a[2] for a, b in zip(folds, folds[1:]))
    with pytest.raises(ValueError):
        forecasts.make_folds(Settings(hours=300))


def test_planted_break_is_found():
    x = np.concatenate([np.zeros(60), np.full(60, 5.0)]) + np.random.default_rng(1).normal(0, 0.2, 120)
    assert breaks.pruned_partition(x, breaks.default_penalty(x), 7) == [60]
    assert breaks.greedy_partition(x, 7)[0] == 60 or 60 in breaks.greedy_partition(x, 7)
    assert breaks.block_pvalue(x, 7, 14, 100, "planted", 1) < 0.05
    assert breaks.block_pvalue(x[:10], 7, 14, 100, "short", 1) is None


def test_erlang_inversion_returns_the_offered_load():
    offered = np.linspace(0.1, 8, 9)
    observed = offered * (1 - capacity.blocking(10, offered))
    assert np.allclose(capacity.invert_carried(10, observed), offered, atol=1e-3)
    assert capacity.invert_carried(0, observed).sum() == 0


def test_greedy_equals_the_loop(spark):
    gains = spark.createDataFrame([(z, j, 10.0 / (z + j)) for z in range(4) for j in range(1, 9)], "zone_id int, j int, gain double")
    added = dict.fromkeys(range(4), 0)
    for _ in range(8):
        best = max(range(4), key=lambda z: (10.0 / (z + added[z] + 1), -z))
        added[best] += 1
    assert {r["zone_id"]: r["added"] for r in capacity.greedy_allocation(gains, 8).collect()} == {z: n for z, n in added.items() if n}


def test_more_capacity_serves_no_less():
    rates, service, none = np.full((100, 2), 3.0), np.full(2, 2.0), np.zeros((2, 2))
    served, lost, _ = capacity.simulate_worlds(rates, np.array([[4, 4], [10, 10]]), service, none, 12, np.random.default_rng(3))
    assert (served[1] >= served[0]).all() and lost[0].sum() > 0
    alone = capacity.simulate_worlds(rates, np.array([[4, 4]]), service, none, 12, np.random.default_rng(3))
    assert (alone[0][0] == served[0]).all()  # worlds share their draws


def test_a_world_hour_by_hour():
    """The simulation against a plain loop over sessions."""
    source = np.random.default_rng(5)
    rates, cap, service, weights = source.uniform(0, 4, (30, 3)), np.array([2, 5, 1]), np.array([1.0, 2.0, 3.5]), np.array([[0, 0.5, 0.5], [1, 0, 0], [0.3, 0.7, 0]])
    got = capacity.simulate_worlds(rates, cap[None], service, weights, 5, np.random.default_rng(9))
    rng, busy, served, blocked, moved = np.random.default_rng(9), [0] * 3, [0] * 3, [0] * 3, [0] * 3
    for rate in rates:
        draw = rng.random((3, 5))
        busy = [b - sum(draw[z, k] < 1 / service[z] for k in range(b)) for z, b in enumerate(busy)]
        come = rng.poisson(rate)
        direct = [min(int(come[z]), int(cap[z]) - busy[z]) for z in range(3)]
        lost = [int(come[z]) - direct[z] for z in range(3)]
        sent = [sum(0.35 * lost[i] * weights[i, z] for i in range(3)) for z in range(3)]
        lucky = rng.random(3)
        for z in range(3):
            more = int(sent[z]) + (lucky[z] < sent[z] % 1)
            taken = min(more, int(cap[z]) - busy[z] - direct[z])
            busy[z] += direct[z] + taken
            served[z], blocked[z], moved[z] = served[z] + direct[z] + taken, blocked[z] + lost[z], moved[z] + taken
    assert [x[0].tolist() for x in got] == [served, blocked, moved]


def test_marginal_gains_equal_the_recursion(spark):
    def carried(a, c):
        b = 1.0
        for n in range(1, c + 1):
            b = a * b / (n + a * b)
        return a * (1 - b)

    rows = [(0, 0, 2.0, 1.5), (0, 0, 2.0, 0.5), (1, 3, 1.0, 4.0), (2, 4, 3.0, 0.0)]
    got = {(r.zone_id, r.j): r.gain for r in capacity.marginal_gains(spark.createDataFrame(rows, "zone_id int, capacity_points int, kw double, offered double"), 3).collect()}
    assert set(got) == {(z, j) for z in (0, 1) for j in (1, 2, 3)}
    for (z, j), gain in got.items():
        assert abs(gain - sum(kw * (carried(a, c + j) - carried(a, c + j - 1)) for zone, c, kw, a in rows if zone == z)) < 1e-9


def test_analytic_marginal_is_the_first_gain(spark):
    known = capacity.calibrate(from_events(spark, SMALL))
    first = {r.zone_id: r.gain for r in capacity.marginal_gains(known, 1).collect()}
    assert all(abs(first.get(r.zone_id, 0.0) - r.marginal) < 1e-6 for r in capacity.analytic_marginal(known).collect())


def test_simulated_marginals_and_scenarios(spark):
    panel = from_events(spark, SMALL)
    gain = capacity.simulated_marginal(panel, capacity.calibrate(panel), 2, 0, 48, 1).collect()
    assert len(gain) == 25 and all(r.n == 2 and r.p10 <= r.p90 for r in gain)
    rows = {(r.estimate, r.rule): r for r in capacity.scenarios(panel, 2, (10,), 48, 1).collect()}
    assert len(rows) == 8 and all(rows["kw", "no_investment"].mean_energy <= r.mean_energy + 1e-9 for (e, _), r in rows.items() if e == "kw")
    assert rows["kw", "no_investment"].n_zones == 0 and rows["kw", "by_utilisation"].n_zones > 0


@pytest.mark.parametrize("seed", range(6))
def test_pruning_loses_nothing(seed):
    source = np.random.default_rng(seed)
    x = np.concatenate([source.normal(m, 1, n) for m, n in zip(source.normal(0, 3, 8), source.integers(2, 14, 8))])
    penalty, least, cost = 4.0, 3, breaks.SegmentCost(x)
    best, last = [0.0] + [np.inf] * len(x), [0] * (len(x) + 1)
    for t in range(least, len(x) + 1):
        for s in range(0, t - least + 1):
            if best[s] + cost(s, t) + penalty < best[t] - 1e-12:
                best[t], last[t] = best[s] + cost(s, t) + penalty, s
    cuts, t = [], len(x)
    while last[t]:
        t = last[t]
        cuts.append(t)
    assert breaks.pruned_partition(x, penalty, least) == cuts[::-1]


def test_autoregression_equals_least_squares(spark):
    panel = from_events(spark, SMALL)
    got = {(r.fold, r.hour_idx): r.predicted for r in models.autoregressive(panel, "volume", 6).where("zone_id = 3").collect()}
    y = np.array([r.volume for r in panel.observations.where("zone_id = 3").orderBy("hour_idx").collect()])
    lags = np.stack([y[24 - 1 - k : 720 - 6 - k] for k in range(24)], 1)
    hours = np.arange(23 + 6, 720)
    x = np.column_stack([np.ones(len(lags)), lags])
    for fold, start, end in forecasts.make_folds():
        train, test = hours < start, (hours >= start) & (hours < end)
        want = np.maximum(x[test] @ np.linalg.lstsq(x[train], y[hours[train]], rcond=None)[0], 0)
        assert np.allclose([got[fold, h] for h in hours[test]], want, atol=1e-6)


def test_forecasts_stay_within_the_points(spark):
    panel = from_events(spark, SMALL)
    points = {r.zone_id: r.capacity_points for r in panel.zones.collect()}
    for fit in (models.autoregressive, models.zone_ridge, models.zone_trees, models.global_ridge):
        rows = fit(panel, "occupancy", 6).collect()
        assert len(rows) == 25 * 4 * 72 and all(0 <= r.predicted <= points[r.zone_id] for r in rows)


def test_small_trees_learn_steps():
    source = np.random.default_rng(4)
    x = source.uniform(0, 1, (600, 3))
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + np.where(x[:, 1] > 0.3, 1.0, 0.0)
    model = models.SmallTrees(60, 0.1, 3, 10).fit(x[:400], y[:400])
    assert np.abs(model.predict(x[400:]) - y[400:]).mean() < 0.2
    assert np.allclose(models.SmallTrees(5, 0.1, 3, 10).fit(x[:12], y[:12]).predict(x[:5]), y[:12].mean())  # no split leaves ten rows on both sides


def test_pooled_ridge_of_two_passes(spark):
    """The fold's weights against a direct solution with the chosen alpha's best error."""
    panel = from_events(spark, SMALL)
    rows = models.global_ridge(panel, "volume", 6).collect()
    assert {r.fold for r in rows} == {0, 1, 2, 3} and len(rows) == 25 * 4 * 72


def test_grid_leaves_done_cells_out(spark):
    panel = from_events(spark, SMALL)
    first = models.run_grid(panel, ("occupancy",), (6,), ()).select("cell_key", "family", "fold").collect()
    done = spark.createDataFrame([(r.cell_key,) for r in first if r.fold], "cell_key string")
    assert {r.fold for r in models.run_grid(panel, ("occupancy",), (6,), (), done).collect()} == {0}
    with pytest.raises(ValueError):
        models.run_grid(panel, ("occupancy",), (6,), (), spark.createDataFrame([(r.cell_key,) for r in first], "cell_key string"))


def test_retraining_policies(spark):
    panel = from_events(spark, SMALL)
    policies = models.schedules(panel, 432, {"x": spark.createDataFrame([(440,), (500,), (510,), (600,)], "hour_idx int")}, (144,), 72)
    assert policies == {"no_retraining": [432], "periodic_144h": [432, 576], "triggered_x": [432, 510, 600]}
    rows = {r.policy: r for r in models.retraining(panel, "occupancy", 6, policies, 576).collect()}
    assert {p: r.n_refits for p, r in rows.items()} == {"no_retraining": 0, "periodic_144h": 1, "triggered_x": 2} and all(r.n_hours == 288 for r in rows.values())
    assert abs(rows["no_retraining"].mae_before - rows["periodic_144h"].mae_before) < 1e-9


def test_k_means_finds_planted_groups(spark):
    source = np.random.default_rng(2)
    rows = [(z, *(source.normal(z % 3 * 5, 0.1, 48)).tolist()) for z in range(24)]
    shapes = spark.createDataFrame(rows, "zone_id int, " + ", ".join(f"{s} double" for s in segments.SLOTS))
    found = segments.diagnostics(shapes, [2, 3, 4], 3, 3)
    table = {r.k: r for r in found.collect()}
    assert segments.choose_k(found) == 3 and table[3].stability == 1.0 and table[3].inertia < table[2].inertia / 50 and table[2].inertia_drop is None
    by = {}
    for r in segments.cluster(shapes, 3).collect():
        by.setdefault(r.segment, set()).add(r.zone_id % 3)
    assert sorted(map(len, by.values())) == [1, 1, 1]


def test_forest_flags_planted_oddities():
    source = np.random.default_rng(1)
    x = np.concatenate([source.normal(0, 1, (500, 3)), [[9.0, -9.0, 9.0]]])
    trees = [anomaly.grow(x[source.choice(len(x), 256)], source) for _ in range(50)]
    depth = np.mean([anomaly.path_length(t, x) for t in trees], axis=0)
    assert depth.argmin() == 500


def test_statements_are_cut_outside_quotes():
    text = "-- only; a comment\nSELECT ';' AS a; -- another\n\n;SELECT \"x;y\" FROM t -- end; "
    assert sql.statements(text) == ["-- only; a comment\nSELECT ';' AS a", 'SELECT "x;y" FROM t -- end;']
    with pytest.raises(FileNotFoundError):
        sql.read_sql("nothing")


def test_files_that_break_the_contract_raise(spark, tmp_path):
    (tmp_path / "m.csv").write_text("10,20\n0,5\n")
    with pytest.raises(Exception, match="must be square"):
        files.read_matrix(spark, str(tmp_path / "m.csv"), "d").collect()
    (tmp_path / "w.csv").write_text("time,T\n2024/1/1 0:00,1\n")
    with pytest.raises(bookkeeping.LoadError):
        files.read_weather(spark, str(tmp_path / "w.csv"), "central")


def test_names_and_digests(tmp_path):
    assert bookkeeping.shown_path(tmp_path / "a" / "b", tmp_path) == "a/b" and bookkeeping.shown_path("/etc/hosts", tmp_path) == "hosts"
    assert bookkeeping.settings_digest(Settings()) != bookkeeping.settings_digest(Settings(hours=10))
    with bookkeeping.timed("nothing"):
        pass


def test_boosting_settings_are_chosen(spark):
    scored = models.global_trees(from_events(spark, SMALL), "occupancy", 6, ((1, 0.1, 2), (3, 0.1, 2)))
    assert scored.count() == 25 * 4 * 72


def test_ridge_equals_the_direct_solution():
    source = np.random.default_rng(2)
    x, y = source.normal(size=(80, 3)), source.normal(size=80)
    z = (x - x.mean(0)) / x.std(0)
    direct = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(models.solve_ridge(models.gram_of(x, y), 10.0)[1:], direct)


def test_runs(spark):
    df = spark.createDataFrame([(0, h, v) for h, v in enumerate([1.0, 1.0, 1.0, 1.0, 2.0, 2.0])], "zone_id int, hour_idx int, x double")
    assert [r["run_length"] for r in quality.run_lengths(df, "x").orderBy("hour_idx").collect()] == [4, 4, 4, 4, 2, 2]


def test_trigger_cooldown(spark):
    alarms = spark.createDataFrame([(h,) for h in (5, 6, 20, 24, 40)], "hour_idx int")
    assert sorted(r[0] for r in monitor.trigger_schedule(alarms, 15).collect()) == [5, 20, 40]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "k string, seq int, v int")
    assert {(r["k"], r["v"]) for r in files.keep_last(df, ["k"], ["seq"]).collect()} == {("a", 20), ("b", 30)}


def test_wide_csv_and_matrix(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,10,20\n2024-01-01 00:00:00,1.5,2\n2024-01-01 01:00:00,3,4\n")
    long = files.read_wide(spark, str(tmp_path / "w.csv"), "volume")
    assert {(r["zone_id"], r["ts"].hour, r["volume"]) for r in long.collect()} == {(10, 0, 1.5), (20, 0, 2.0), (10, 1, 3.0), (20, 1, 4.0)}
    (tmp_path / "bad.csv").write_text("when,10\nx,1\n")
    with pytest.raises(ValueError):
        files.read_wide(spark, str(tmp_path / "bad.csv"), "volume")
    (tmp_path / "m.csv").write_text("10,20\n0,5\n5,0\n")
    assert files.read_matrix(spark, str(tmp_path / "m.csv"), "d").where("d > 0").count() == 2


def test_contract(spark):
    with pytest.raises(models.ContractError):
        models.contract_violations(spark.createDataFrame([(1,)], "zone_id int"), None)


def test_labels_give_seeds_and_keys():
    assert derive_seed(1, "a") != derive_seed(1, "b") and len(cell_key({"b": 1, "a": 2})) == 16 and cell_key({"a": 2, "b": 1}) == cell_key({"b": 1, "a": 2})
