"""Calendar, series, statistics and scoring operators against brute force."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, correlation, ranking, resampling, scoring, series, windows
from tidemark.plans import analyses, views  # noqa: F401
from tidemark.plans.bindings import make_lexicon_scorer
from tidemark.plans.registry import Study
from tidemark.streaming import jobs

START = date(2026, 1, 1)


def d(n):
    return START + timedelta(days=n)


@pytest.fixture(scope="module")
def study(spark):
    """Weekdays with a holiday gap; events before, inside, on a weekend and past the end."""
    rng = random.Random(7)
    days = [d(i) for i in range(4, 120) if d(i).weekday() < 5 and i not in (40, 41)]
    prices = [(x, 60 + rng.random() * 20, 30 + rng.random() * 10) for x in days]
    prices[10] = (prices[10][0], 0.0, prices[10][2])
    brent = spark.createDataFrame([(x, b) for x, b, _ in prices], "price_date date, brent_close double")
    ttf = spark.createDataFrame([(x, t) for x, _, t in prices if x.day != 9], "price_date date, ttf_close double")
    power = spark.createDataFrame([(d(i), 80 + rng.random() * 30) for i in range(125)], "price_date date, gb_power_avg double")
    events = [(d(i), f"e{i}", p) for i, p in ((0, "a"), (9, "a"), (20, None), (39, "b"), (60, "b"), (117, "b"), (124, None))]
    events.append((d(20), "same day", "a"))
    timeline = spark.createDataFrame(events, "event_date date, label string, phase string")
    return Study(spark, {"brent": brent, "ttf": ttf, "gb_power": power, "timeline": timeline})


def brute_snap(days, target):
    later = [x for x in days if x >= target]
    return min(later) if later else None


def frames(study):
    brent = {r.price_date: r.brent_close for r in study.get("brent").collect()}
    ttf = {r.price_date: r.ttf_close for r in study.get("ttf").collect()}
    return brent, ttf


@pytest.mark.parametrize("anchor", ["event", "t0"])
def test_impacts_equal_brute_force(study, anchor):
    brent, ttf = frames(study)
    days = sorted(brent)
    got = {(r.event_date, r.label): r for r in views.events_with_impacts(study, (1, 3, 5, 10), anchor).collect()}
    assert len(got) == 8
    for (event, _), row in got.items():
        t0 = brute_snap(days, event)
        assert row.t0_date == t0
        for k in (1, 3, 5, 10):
            base = event if anchor == "event" else t0
            tk = None if base is None else brute_snap(days, base + timedelta(days=k))
            assert row[f"t{k}_date"] == tk
            for col, values in (("brent_close", brent), ("ttf_close", ttf)):
                a, b = values.get(t0), values.get(tk)
                want = None if not a or b is None else 100 * (b - a) / a
                assert row[f"{col}_move_{k}d"] == (None if want is None else pytest.approx(want))


def test_two_events_on_one_day_do_not_multiply(study):
    assert study.get("v_event_impact_multi").filter(F.col("event_date") == d(20)).count() == 2
    phases = {r.phase: r.n_events for r in study.get("v_event_impact_multi_phase").collect()}
    assert phases == {"a": 3, "b": 3, "unassigned": 2}


def test_pinned_frames_are_written_once_and_can_be_released(spark, study):
    calls = []

    def build():
        calls.append(1)
        return study.get("timeline")

    first, again = study.pin("t", build), study.pin("t", build)
    assert len(calls) == 1 and first.count() == again.count() == 8
    study.release()
    assert study.pin("t", build).count() == 8 and len(calls) == 2


def test_fwd_snap_with_many_calendars(spark):
    cal = spark.createDataFrame([("x", d(1)), ("x", d(5)), ("y", d(3))], "k string, d date")
    rows = spark.createDataFrame(
        [("x", d(0)), ("x", d(2)), ("x", d(6)), ("y", d(2)), ("y", d(4)), ("z", d(1)), ("x", None)],
        "k string, on date",
    )
    got = {(r.k, r.on): r.snap for r in calendar.fwd_snap_by(rows, cal, "k", "on", "snap").collect()}
    assert got == {
        ("x", d(0)): d(1), ("x", d(2)): d(5), ("x", d(6)): None, ("y", d(2)): d(3),
        ("y", d(4)): None, ("z", d(1)): None, ("x", None): None,
    }
    one = calendar.fwd_snap(rows.filter("k = 'x'"), cal.filter("k = 'x'"), "on", "snap", plus_days=1)
    assert {r.on: r.snap for r in one.collect()} == {d(0): d(1), d(2): d(5), d(6): None, None: None}


def test_range_windows_keep_each_row_once(spark):
    events = spark.createDataFrame([(d(5),), (d(6),)], "event_date date")
    rows = spark.createDataFrame([(i, d(i)) for i in range(12)], "id int, day date")
    kept = windows.within_windows(rows, events, "event_date", 1, "day", (d(0), d(20)))
    assert sorted(r.id for r in kept.collect()) == [4, 5, 6, 7]


def test_mix_shares_sum_to_100(spark):
    fuels = {"CCGT": "gas", "WIND": "renewables"}
    rows = spark.createDataFrame(
        [(d(0), "CCGT", "30"), (d(0), "WIND", "60.4"), (d(0), "INTFR", "500"), (d(0), "WIND", "bad"), (d(1), "WIND", "0")],
        "day date, fuel string, mwh string",
    )
    got = {r.price_date: r for r in series.mix_shares(rows, "day", series.category_of("fuel", fuels), "mwh", ["gas", "renewables"]).collect()}
    assert got[d(0)].total_mwh == 90 and got[d(0)].gas_share_pct == 33.3 and got[d(0)].renewables_share_pct == 67.1
    assert got[d(1)].gas_share_pct is None


def test_rebase_fails_without_an_anchor(spark):
    rows = spark.createDataFrame([(d(0), 10.0), (d(2), 20.0), (d(3), 25.0)], "day date, v double")
    got = {r.day: r.out for r in series.rebase(rows, "day", "v", 72.0, d(1), "out").collect()}
    assert got == {d(0): 36.0, d(2): 72.0, d(3): 90.0}
    with pytest.raises(Exception, match="no value on or after"):
        series.rebase(rows, "day", "v", 72.0, d(9), "out").collect()


def test_rolling_and_lag_follow_pandas(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(50, 5, 40)
    values[12] = np.nan
    pdf = pd.DataFrame({"i": range(40), "v": values})
    frame = spark.createDataFrame([(int(i), None if np.isnan(v) else float(v)) for i, v in zip(pdf.i, pdf.v)], "i int, v double")
    got = series.pct_change(frame, "i", {"v": "r"}, 3)
    got = series.rolling_std(got, "i", {"v": "s"}, 7).orderBy("i").toPandas()
    want_r = pdf.v.pct_change(3, fill_method=None) * 100
    np.testing.assert_allclose(got.r.astype(float), want_r, rtol=1e-9)
    np.testing.assert_allclose(got.s.astype(float), pdf.v.rolling(7).std(), rtol=1e-9)


def test_ranks_and_quantiles_are_the_same_with_any_cuts(spark):
    rng = random.Random(3)
    data = [("g" if rng.random() < 0.4 else "h", float(rng.choice([0, 0, 0, *range(40)]))) for _ in range(600)]
    frame = spark.createDataFrame([*data, ("g", None)], "k string, v double").repartition(5)
    plain = {(r.k, r.v): r.avg_rank for r in ranking.ranked_values(frame, "v", ["k"]).collect()}
    cut = {(r.k, r.v): r.avg_rank for r in ranking.ranked_values(frame, "v", ["k"], [3.0, 17.0, 17.5, 99.0]).collect()}
    assert plain == cut
    pdf = pd.DataFrame(data, columns=["k", "v"])
    pdf["rank"] = pdf.groupby("k").v.rank()
    assert {(k, v): r for k, v, r in pdf.itertuples(index=False)} == plain
    for splits in ((), (5.0, 20.0)):
        got = {r.k: (r.q25, r.q50, r.q97_5) for r in ranking.exact_quantiles(frame, "v", [0.25, 0.5, 0.975], ["k"], splits).collect()}
        for k, group in pdf.groupby("k"):
            assert got[k] == pytest.approx(tuple(np.percentile(group.v, [25, 50, 97.5])))
    whole = ranking.exact_quantiles(frame, "v", [0.5], splits=(10.0,)).first()
    assert whole.q50 == pytest.approx(pdf.v.median())


def test_correlations_follow_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=60).round(1), "b": rng.normal(size=60).round(1)})
    pdf["c"] = 1.0
    pdf.loc[3, "a"] = np.nan
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in pdf.itertuples(index=False)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    for method in ("pearson", "spearman"):
        got = {(r.x, r.y): r.r for r in correlation.correlation_matrix(frame, ["a", "b", "c"], method).collect()}
        want = pdf.corr(method=method)
        assert len(got) == 9
        for (x, y), r in got.items():
            assert (r is None) == bool(np.isnan(want.loc[x, y]))
            assert r is None or r == pytest.approx(want.loc[x, y])
    spread = correlation.spearman_pairs(frame, [("a", "b")], buckets=4).first()
    assert spread.r == pytest.approx(want.loc["a", "b"]) and spread.n == 59


def test_leave_one_out_equals_recomputation(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=25)
    y = 0.3 * x + rng.normal(size=25)
    frame = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)], "x double, y double, c double")
    rows = {r.y: r for r in correlation.leave_one_out(frame, [("x", "y"), ("x", "c")]).collect()}
    loo = [np.corrcoef(np.delete(x, i), np.delete(y, i))[0, 1] for i in range(25)]
    assert rows["y"].full_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert rows["y"].min_loo == pytest.approx(min(loo)) and rows["y"].max_loo == pytest.approx(max(loo))
    assert rows["c"].min_loo is None


def test_leave_one_out_of_a_single_spread_source(spark):
    frame = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 3.0), (9.0, 4.0)], "x double, y double")
    row = correlation.leave_one_out(frame, [("x", "y")]).first()
    assert row.n == 4 and row.min_loo is not None and -1.0000001 <= row.min_loo <= row.max_loo <= 1.0000001


def test_placebo_draws_are_distinct_and_reproducible(spark):
    sizes = spark.range(300).select("id", F.lit(20).cast("bigint").alias("n"))
    picks = sizes.select("id", resampling.sample_positions(F.col("n"), 14, 42, F.col("id")).alias("p")).collect()
    for row in picks:
        assert len(set(row.p)) == 14 and min(row.p) >= 0 and max(row.p) < 20
    seen = pd.Series([v for row in picks for v in row.p]).value_counts()
    assert len(seen) == 20 and seen.min() > 150
    pool = spark.createDataFrame([(d(i), float(i)) for i in range(20)], "day date, v double")
    once = {r.iter: r.v_mean for r in resampling.placebo(pool, "day", ["v"], 14, 50).collect()}
    again = {r.iter: r.v_mean for r in resampling.placebo(pool.repartition(7), "day", ["v"], 14, 50).collect()}
    assert once == again and len(once) == 50
    with pytest.raises(Exception, match="at least 21"):
        resampling.placebo(pool, "day", ["v"], 21, 5).collect()


def test_bootstrap_skips_draws_without_spread(spark):
    frame = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0)], "i int, x double, y double")
    draws = resampling.bootstrap_corr(frame, ["i"], "x", "y", 40)
    rs = [r.r for r in draws.collect()]
    assert 0 < len(rs) < 40 and all(r == pytest.approx(-1.0) for r in rs)
    empty = resampling.bootstrap_corr(frame.limit(0), ["i"], "x", "y", 4)
    assert empty.count() == 0


def test_empirical_rank_is_strict(spark):
    draws = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, None)], "iter int, v_mean double")
    real = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    row = resampling.empirical_rank(real, draws, ["v"]).first()
    assert row.real_mean == 2.0 and row.n_draws == 3 and row["rank"] == pytest.approx(1 / 3)


def test_inverse_round_trip(study, spark):
    carbon = study.get("brent").select("price_date", F.lit(70.0).alias("krbn_close"), F.lit(72.0).alias("uka_proxy_gbp"), F.lit("K").alias("source"))
    mix = study.get("brent").select("price_date", F.lit(100.0).alias("total_mwh"), *[F.lit(v).alias(f"{n}_share_pct") for n, v in (("gas", 30.0), ("renewables", 70.0), ("nuclear", 0.0), ("biomass", 0.0), ("coal_oil", 0.0), ("pumped_storage", 0.0))])
    whole = Study(spark, {**study.sources, "uka_proxy": carbon, "gb_gen_mix": mix.filter(F.col("price_date") != d(60))})
    assert analyses.implied_roundtrip(whole).first().within_rounding
    regimes = {r.regime for r in whole.get("v_clean_spark_spread_daily").select("regime").distinct().collect()}
    assert regimes == {"high_gas", "unknown"}


def test_top_urls_and_resumed_scoring(spark):
    rows = spark.createDataFrame(
        [(f"http://e.com/the-quick-brown-{i % 6}xx", d(i % 2), i) for i in range(40)] + [("", d(0), 99), (None, d(0), 99)],
        "source_url string, event_date date, mentions int",
    )
    top = scoring.top_urls(rows, 2)
    assert sorted((r.day, r.nummentions) for r in top.collect()) == [(d(0), 36), (d(0), 38), (d(1), 37), (d(1), 39)]
    events = spark.createDataFrame([(d(0),)], "event_date date")
    urls = scoring.event_window_urls(rows, events, (d(0), d(9)), 1, 2, 6)
    none = spark.createDataFrame([], "source_url string, day date, nummentions int, slug string, finbert_positive double, finbert_neutral double, finbert_negative double, finbert_signed double")
    first = scoring.score_new(urls, none, make_lexicon_scorer)
    rows_once = first.collect()
    assert len(rows_once) == 4
    for r in rows_once:
        assert r.finbert_positive + r.finbert_neutral + r.finbert_negative == pytest.approx(1.0)
        assert abs(r.finbert_signed) <= 1.001
    known = spark.createDataFrame(rows_once, first.schema)
    assert scoring.score_new(urls, known, make_lexicon_scorer).count() == 4


def test_stream_equals_batch_on_closed_days(spark, tmp_path):
    data = [(i, d(i // 10), float(i % 7 - 3), 1.0, i % 5) for i in range(100)]
    frame = spark.createDataFrame(data, "event_id int, day date, tone double, goldstein double, mentions int")
    frame = frame.withColumn("ts", F.col("day").cast("timestamp_ntz")).drop("day")
    src = str(tmp_path / "src")
    frame.repartition(3).write.parquet(src)
    stream = jobs.file_stream(spark, src, frame.schema)
    daily = jobs.run_to_files(jobs.daily_rollup(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.event_date: (r.event_count, r.total_mentions) for r in daily.collect()}
    # the last day and the day the watermark still holds open are not out yet
    assert set(got) == {d(i) for i in range(8)}
    assert all(v == (10, 20) for v in got.values())
    once = jobs.once_per_id(jobs.file_stream(spark, src, frame.schema).union(jobs.file_stream(spark, src, frame.schema)), "event_id")
    assert jobs.run_to_files(once, str(tmp_path / "o2"), str(tmp_path / "c2")).count() == 100


def test_align_fails_on_two_rows_of_a_day(spark):
    day = date(2024, 1, 2)
    one = spark.createDataFrame([(day, 100.0), (day, 140.0)], "d date, a double")
    two = spark.createDataFrame([(day, 1.0)], "d date, b double")
    with pytest.raises(Exception, match="series one has more than one row on 2024-01-02"):
        series.align({"one": one, "two": two}, "d").collect()
    with pytest.raises(Exception, match="series one has more than one row"):
        series.align({"one": one, "two": two}, "d").select("d", "a").collect()
    row = series.align({"one": one.limit(1), "two": two}, "d").first()
    assert row.has_one and row.has_two and row.b == 1.0


def write_slots(spark, folder, slots):
    for name, rows in slots.items():
        frame = spark.createDataFrame(rows, "event_id long, file_date date, event_date date")
        frame.coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_counts_add_up_over_batches_and_restarts(spark, tmp_path):
    day, before = date(2024, 1, 2), date(2024, 1, 1)
    schema = spark.createDataFrame([], "event_id long, file_date date, event_date date").schema
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        rows = stream.option("maxFilesPerTrigger", 1).parquet(source)
        return {r.file_date: tuple(r)[1:] for r in jobs.count_late(rows, out, mark).collect()}

    assert run() == {}  # no files yet
    write_slots(spark, source, {"a": [(1, day, day), (2, day, before)], "b": [(3, day, None)]})
    assert run() == {day: (1, 1, 1)}
    write_slots(spark, source, {"c": [(4, day, day)], "d": [(5, before, before)]})
    assert run() == {day: (2, 1, 1), before: (1, 0, 0)}
    assert run() == {day: (2, 1, 1), before: (1, 0, 0)}  # nothing new, nothing counted twice


def test_split_ranks_equal_one_window(spark):
    rng = np.random.default_rng(8)
    rows = [
        (str(g) if g else None, float(a), float(b))
        for g, a, b in zip(rng.integers(0, 3, 400), rng.integers(0, 40, 400), rng.normal(size=400))
    ]
    frame = spark.createDataFrame(rows, "g string, a double, b double")
    key = lambda r: (str(r.g), r.x, r.y)
    pairs = [("a", "b"), ("b", "a")]
    one = sorted(correlation.both_methods(frame, pairs, ["g"]).collect(), key=key)
    split = sorted(correlation.both_methods(frame, pairs, ["g"], buckets=5).collect(), key=key)
    assert len(one) == len(split) == 6
    for a, b in zip(one, split, strict=True):
        assert (a.g, a.x, a.y, a.n) == (b.g, b.x, b.y, b.n)
        assert a.pearson == pytest.approx(b.pearson)
        if a.g is not None:
            assert a.spearman == pytest.approx(b.spearman)


def test_second_scoring_run_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = [(f"https://e.com/{i}", date(2024, 1, 1 + i % 5), f"the good und {i}") for i in range(40)]
    urls = spark.createDataFrame(rows, "source_url string, day date, slug string")
    table = scoring.score_table(spark, path, urls.schema)
    assert scoring.append_scores(urls.limit(25), table, "a", make_lexicon_scorer, 10) == 25
    assert scoring.append_scores(urls, table, "b", make_lexicon_scorer, 10) == 15
    assert scoring.append_scores(urls, table, "c", make_lexicon_scorer, 10) == 0
    scores = table.rows()
    assert scores.count() == scores.select("source_url").distinct().count() == 40


def test_lexicon_scorer_counts_word_shares():
    scorer = scoring.LexiconScorer(("good",), ("bad",))
    texts = ["Good day", "bad bad", "", "plain words here"]
    for text, got in zip(texts, scorer(texts), strict=True):
        words = text.lower().split(" ")
        parts = np.exp([8 * words.count("good") / len(words), 0.5, 8 * words.count("bad") / len(words)])
        assert got == pytest.approx(tuple(parts / parts.sum()))
    assert scorer([]) == []


def test_sweep_reports_what_cannot_be_built(spark):
    frame = spark.createDataFrame([(date(2024, 1, 2), 80.0)], "price_date date, brent_close double")
    got = {r.object: (r.n_rows, r.is_empty) for r in Study(spark, {"brent": frame}).sweep().collect()}
    assert got["brent"] == (1, False) and got["v_brent_daily"] == (1, False)
    assert got["ttf"] == (None, None) and got["v_ttf_daily"] == (None, None)
