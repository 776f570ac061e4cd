"""The analyses on top of the views: summaries, correlations, resampling and reports.

All inputs here are daily or per-event frames, whose size follows the calendar and not the
row-level tables; the row-level work happened in the views' aggregations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import dominance, guarded_ratio, period_of, round_half_up
from tidemark.operators import correlation, ranking, resampling, series
from tidemark.operators.bounds import bounded_broadcast, span_days
from tidemark.plans.registry import Study
from tidemark.plans.views import (
    IMPACT_SERIES,
    events_with_impacts,
    impacts_by_day,
    theme_place_counts,
)

MOVES = ("brent_pct_3d", "ttf_pct_3d", "power_pct_3d")
NEWS = ("event_count", "avg_tone", "avg_goldstein")
MOVE_PAIRS = (
    ("brent_pct_3d", "ttf_pct_3d"),
    ("ttf_pct_3d", "power_pct_3d"),
    ("brent_pct_3d", "power_pct_3d"),
)
LOO_PAIRS = (
    *MOVE_PAIRS,
    ("avg_tone", "brent_pct_3d"),
    ("avg_tone", "ttf_pct_3d"),
    ("avg_tone", "power_pct_3d"),
    ("avg_goldstein", "power_pct_3d"),
    ("event_count", "ttf_pct_3d"),
)


# ---- event impacts and news ----


def impact_with_news(study: Study) -> DataFrame:
    """Event moves with the news metrics of the event day; events without all moves drop out."""
    cfg = study.cfg
    news = bounded_broadcast(
        study.get("v_middle_east_events"), span_days(cfg.window_start, cfg.window_end), 64
    )
    return (
        study.get("v_event_impact")
        .dropna(subset=list(MOVES))
        .join(news, "event_date", "left")
        .select("event_date", "label", *MOVES, *NEWS)
    )


def move_correlations(study: Study, method: str) -> DataFrame:
    columns = [*MOVES, *NEWS]
    rows = impact_with_news(study)
    if method == "spearman":  # ranks pass over the event rows several times
        rows = study.pin("impact_with_news", lambda: rows)
    return correlation.correlation_matrix(rows, columns, method, EVENT_BUCKETS)


def bootstrap_ci(study: Study, n_iter: int = 5000, seed: int = 42) -> DataFrame:
    stats = study.pin(
        "usable_events",
        lambda: study.get("v_event_impact")
        .dropna(subset=list(MOVES))
        .select("event_date", "label", *MOVES),
    )
    x, y = MOVES[0], MOVES[1]
    observed = correlation.pearson_pairs(stats, [(x, y)]).select("r")
    draws = resampling.bootstrap_corr(stats, ["event_date", "label"], x, y, n_iter, seed)
    return resampling.bootstrap_summary(draws, observed)


def leave_one_out(study: Study) -> DataFrame:
    stats = study.pin("impact_with_news", lambda: impact_with_news(study))
    return correlation.leave_one_out(stats, LOO_PAIRS)


def horizon_summary(study: Study) -> DataFrame:
    """Mean and median move per horizon and series, over events with the longest horizon."""
    longest = max(study.cfg.horizons)
    moves = study.get("v_event_impact_multi").filter(F.col(f"brent_pct_{longest}d").isNotNull())
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("horizon_days"),
                *[F.col(f"{name}_pct_{k}d").alias(name) for name in IMPACT_SERIES],
            )
            for k in study.cfg.horizons
        ]
    )
    long = moves.select(F.explode(rows).alias("_r")).select("_r.*")
    return _mean_and_median(long, ["horizon_days"], {n: n for n in IMPACT_SERIES})


def _mean_and_median(
    df: DataFrame, by: Sequence[str], cols: Mapping[str, str], extra: Sequence = ()
) -> DataFrame:
    """count, mean and median (1 place) of ``cols`` (output name to column) per group."""
    aggregates = [F.count(F.lit(1)).alias("n"), *extra]
    for name, col in cols.items():
        aggregates += [
            round_half_up(F.avg(col), 1).alias(f"{name}_mean"),
            # one value per event or day: the histogram behind the median is calendar-sized
            round_half_up(F.median(col), 1).alias(f"{name}_median"),
        ]
    return df.groupBy(*by).agg(*aggregates)


def regime_rows(study: Study) -> DataFrame:
    return study.get("v_event_impact_regime").dropna(subset=list(MOVES))


#: Ranges into which ranks of event-level frames are split.
EVENT_BUCKETS = 8


def pinned_regime_rows(study: Study) -> DataFrame:
    """The measures of the event rows, written once: ranks and moments both pass over them."""
    return study.pin(
        "regime_rows", lambda: regime_rows(study).select("regime", "gas_share_pct", *MOVES)
    )


def regime_summary(study: Study) -> DataFrame:
    cols = dict(zip(IMPACT_SERIES, MOVES, strict=True))
    share = round_half_up(F.avg("gas_share_pct"), 1).alias("gas_share_mean")
    return _mean_and_median(regime_rows(study), ["regime"], cols, [share])


def regime_corr(study: Study) -> DataFrame:
    return correlation.both_methods(pinned_regime_rows(study), MOVE_PAIRS, ["regime"], EVENT_BUCKETS)


def share_vs_move_corr(study: Study) -> DataFrame:
    pairs = [("gas_share_pct", move) for move in MOVES]
    return correlation.both_methods(pinned_regime_rows(study), pairs, buckets=EVENT_BUCKETS)


def describe_shares(study: Study) -> DataFrame:
    cols = ["gas_share_pct", "renewables_share_pct", "nuclear_share_pct"]
    shares = study.pin("mix_shares", lambda: study.get("v_gb_gen_mix_daily").select(*cols))
    return ranking.describe(shares, cols)


# ---- placebo ----


def all_day_impacts(study: Study) -> DataFrame:
    """t+3 moves of every trading day with a snapped t+3 day, not rounded."""
    table = impacts_by_day(study, (3,), anchor="t0")
    return table.filter(F.col("is_calendar_day") & F.col("t3_date").isNotNull()).select(
        F.col("day").alias("price_date"), "t3_date", *_raw_moves()
    )


def _raw_moves() -> list:
    return [F.col(f"{col}_move_3d").alias(f"{n}_pct_3d") for n, col in IMPACT_SERIES.items()]


def real_event_impacts(study: Study) -> DataFrame:
    """t+3 moves of the events, with t3 counted from t0; events without t3 drop out."""
    events = events_with_impacts(study, (3,), anchor="t0")
    return events.filter(F.col("t3_date").isNotNull()).select(
        "event_date", "t0_date", *_raw_moves()
    )


def placebo_pool(study: Study, exclude_t0: bool = False) -> DataFrame:
    """Trading days that are no event day. ``exclude_t0`` also leaves out the trading day a
    weekend event snaps to."""
    days = all_day_impacts(study)
    if exclude_t0:
        taken = events_with_impacts(study, (3,)).select(F.col("t0_date").alias("_d"))
    else:
        taken = study.get("timeline").select(F.col("event_date").alias("_d"))
    return days.join(taken, F.col("price_date") == F.col("_d"), "left_anti")


def placebo_distribution(
    study: Study, n_sample: int = 14, n_bootstrap: int = 1000, seed: int = 42
) -> DataFrame:
    pool = study.pin("placebo_pool", lambda: placebo_pool(study))
    return resampling.placebo(pool, "price_date", MOVES, n_sample, n_bootstrap, seed)


def empirical_rank(
    study: Study, n_sample: int = 14, n_bootstrap: int = 1000, seed: int = 42
) -> DataFrame:
    draws = placebo_distribution(study, n_sample, n_bootstrap, seed)
    return resampling.empirical_rank(real_event_impacts(study), draws, MOVES)


# ---- daily signals against trailing moves ----


def with_trailing_moves(study: Study, signals: DataFrame, k: int = 3) -> DataFrame:
    """A daily signal frame with the series of its days and their trailing k-row moves.

    Rows are the signal's days as they stand, trading or not; NULLs are not filled.
    """
    first, last = study.series_window()
    panel = (
        study.panel("brent", "ttf", "power")
        .filter(F.col("price_date").between(F.lit(first), F.lit(last)))
        .select("price_date", *IMPACT_SERIES.values())
    )
    panel = bounded_broadcast(panel, span_days(first, last), 64)
    joined = signals.join(panel, signals.event_date == panel.price_date, "left").drop("price_date")
    return series.pct_change(
        joined, "event_date", {c: f"{n}_pct_{k}d" for n, c in IMPACT_SERIES.items()}, k
    )


def _signal_corr(study: Study, frame: DataFrame, signals: Sequence[str], need: Sequence[str]):
    clean = with_trailing_moves(study, frame).dropna(subset=[*need, *MOVES])
    return clean, list(product(signals, MOVES))


def tone_move_corr(study: Study) -> DataFrame:
    frame = study.get("v_gdelt_tone_asymmetry_daily")
    signals = ["negative_tone", "positive_tone", "overall_tone"]
    clean, pairs = _signal_corr(study, frame, signals, ["negative_tone"])
    return correlation.pearson_pairs(clean, pairs)


def signal_move_corr(study: Study) -> DataFrame:
    frame = study.get("v_gdelt_events_features_daily")
    signals = [
        "mean_tone",
        "mentions_weighted_tone",
        "mean_goldstein",
        "mentions_weighted_goldstein",
    ]
    clean, pairs = _signal_corr(study, frame, signals, ["mean_goldstein"])
    return correlation.pearson_pairs(clean, pairs)


def dual_signal_days(study: Study) -> DataFrame:
    frame = study.get("v_lng_vs_oil_signal_daily").select("event_date", "oil_signal", "lng_signal")
    return with_trailing_moves(study, frame).dropna(subset=["oil_signal", "lng_signal", *MOVES])


def signal_r2(study: Study) -> DataFrame:
    pairs = list(product(["oil_signal", "lng_signal"], MOVES))
    return correlation.both_methods(dual_signal_days(study), pairs)


def dominance_label(study: Study) -> DataFrame:
    return dual_signal_days(study).select(
        "event_date",
        "oil_signal",
        "lng_signal",
        "ttf_pct_3d",
        dominance("lng_signal", "oil_signal").alias("dominant"),
    )


def top_signal_days(study: Study, k: int = 8) -> DataFrame:
    return (
        dual_signal_days(study)
        .select("event_date", "oil_signal", "lng_signal", "ttf_pct_3d", "power_pct_3d")
        .orderBy(F.col("lng_signal").desc(), "event_date")
        .limit(k)
    )


def score_vs_tone(study: Study) -> DataFrame:
    """Days with both a model score and a dictionary tone."""
    return study.get("v_finbert_daily").join(
        study.get("v_middle_east_events").select("event_date", "avg_tone"), "event_date"
    ).select(
        "event_date",
        "mean_finbert_signed",
        "mentions_weighted_finbert_signed",
        "finbert_dispersion",
        "avg_tone",
    )


def score_vs_tone_corr(study: Study) -> DataFrame:
    """Range and mean of both signals and their correlation, one row."""
    return score_vs_tone(study).agg(
        F.count(F.lit(1)).alias("n_days"),
        *[
            f(c).alias(f"{c}_{name}")
            for c in ("avg_tone", "mean_finbert_signed")
            for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
        correlation.guarded_corr("avg_tone", "mean_finbert_signed").alias("r"),
    )


# ---- bursts, volatility, indices ----


def top_bursts(study: Study, k: int = 5) -> DataFrame:
    burst = study.get("v_news_burst_daily")
    return burst.orderBy(F.col("burst_score").desc_nulls_last(), "event_date").limit(k)


def lagged_pct_change(study: Study, k: int = 3) -> DataFrame:
    """Trailing k-row moves on the combined daily frame (trading rows)."""
    frame = study.get("v_combined_daily").select("d", *IMPACT_SERIES.values())
    return series.pct_change(frame, "d", {c: f"{n}_pct_{k}d" for n, c in IMPACT_SERIES.items()}, k)


def rolling_volatility(study: Study, n: int = 7) -> DataFrame:
    frame = study.get("v_combined_daily").select("d", *IMPACT_SERIES.values())
    returns = series.pct_change(frame, "d", {c: f"{m}_ret" for m, c in IMPACT_SERIES.items()}, 1)
    return series.rolling_std(
        returns, "d", {f"{m}_ret": f"{m}_vol{n}" for m in IMPACT_SERIES}, n
    ).drop(*IMPACT_SERIES.values())


def volatility_by_period(study: Study, n: int = 7) -> DataFrame:
    cfg = study.cfg
    period = period_of("d", cfg.during_start, cfg.during_end)
    return (
        rolling_volatility(study, n)
        .groupBy(period.alias("period"))
        .agg(*[F.avg(f"{m}_vol{n}").alias(f"{m}_vol_mean") for m in IMPACT_SERIES])
    )


def period_buckets(study: Study) -> DataFrame:
    """Trading days per period."""
    period = period_of("d", study.cfg.during_start, study.cfg.during_end)
    return (
        study.get("v_combined_daily")
        .groupBy(period.alias("period"))
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.min("d").alias("first_day"),
            F.max("d").alias("last_day"),
        )
    )


def normalised_index(study: Study) -> DataFrame:
    frame = study.get("v_combined_daily").select("d", *IMPACT_SERIES.values())
    return series.index_to_first(frame, "d", list(IMPACT_SERIES.values()))


def series_range(study: Study) -> DataFrame:
    return study.get("v_uka_proxy_daily").agg(
        F.min("uka_close_gbp_per_tco2").alias("low"),
        F.max("uka_close_gbp_per_tco2").alias("high"),
        F.avg("uka_close_gbp_per_tco2").alias("mean"),
    )


# ---- spread and its inverse ----


def _known_regime(df: DataFrame) -> DataFrame:
    return df.filter(F.col("regime").isin("high_gas", "low_gas"))


def spread_regime_summary(study: Study) -> DataFrame:
    return (
        _known_regime(study.get("v_clean_spark_spread_daily"))
        .groupBy("regime")
        .agg(
            F.count(F.lit(1)).alias("n"),
            round_half_up(F.avg("power_observed_gbp_mwh"), 1).alias("mean_power_obs"),
            round_half_up(F.avg("theoretical_css_gbp_mwh"), 1).alias("mean_theoretical"),
            round_half_up(F.avg("residual_gbp_mwh"), 1).alias("mean_residual"),
            round_half_up(F.avg(F.abs("residual_gbp_mwh")), 1).alias("mean_abs_residual"),
            round_half_up(F.stddev_samp("residual_gbp_mwh"), 1).alias("std_residual"),
        )
    )


def spread_regime_corr(study: Study) -> DataFrame:
    pair = [("power_observed_gbp_mwh", "theoretical_css_gbp_mwh")]
    rows = _known_regime(study.get("v_clean_spark_spread_daily"))
    return correlation.both_methods(rows, pair, ["regime"])


def implied_regime_summary(study: Study) -> DataFrame:
    return (
        _known_regime(study.get("v_implied_ttf_daily"))
        .groupBy("regime")
        .agg(
            F.count(F.lit(1)).alias("n"),
            round_half_up(F.avg("observed_ttf_eur_mwh"), 1).alias("mean_observed_ttf"),
            round_half_up(F.avg("implied_ttf_eur_mwh"), 1).alias("mean_implied_ttf"),
            round_half_up(F.avg("basis_eur_mwh"), 1).alias("mean_basis"),
            round_half_up(F.stddev_samp("basis_eur_mwh"), 1).alias("std_basis"),
        )
    )


def implied_regime_corr(study: Study) -> DataFrame:
    pair = [("observed_ttf_eur_mwh", "implied_ttf_eur_mwh")]
    rows = _known_regime(study.get("v_implied_ttf_daily"))
    return correlation.both_methods(rows, pair, ["regime"])


def decoupled_share(study: Study) -> DataFrame:
    decoupled = F.count_if(F.col("basis_regime") == "decoupled")
    return (
        study.get("v_implied_ttf_daily")
        .groupBy("regime")
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            decoupled.alias("n_decoupled"),
            guarded_ratio(decoupled * 100, F.count(F.lit(1))).alias("decoupled_pct"),
        )
    )


def implied_roundtrip(study: Study) -> DataFrame:
    """Largest residual after feeding the implied price back into the spread: about 0."""
    cfg = study.cfg
    back = (
        F.col("implied_ttf_eur_mwh") * cfg.heat_rate * cfg.fx_rate
        + F.col("uka_proxy_gbp_per_tco2") * cfg.emissions_factor
    )
    return study.get("v_implied_ttf_daily").agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.max(F.abs(F.col("power_observed_gbp_mwh") - back)) < 0.05).alias("within_rounding"),
    )


# ---- themes and places ----


def theme_place_daily(study: Study) -> DataFrame:
    return theme_place_counts(study).select(
        "event_date",
        "n_articles",
        "n_econ_oil",
        "n_energy_security",
        "n_maritime_total",
        "n_conflict_total",
        "n_chokepoint_total",
        "n_kharg",
        "n_ras_laffan",
        "n_persian_gulf",
    )


def on_event_days(study: Study) -> DataFrame:
    """Theme and place counts on event days only."""
    daily = theme_place_daily(study)
    return daily.join(study.get("timeline"), "event_date", "left_semi")


def non_event_days(study: Study) -> DataFrame:
    daily = theme_place_daily(study)
    return daily.join(study.get("timeline"), "event_date", "left_anti")


def spike_days(study: Study, factor: float = 1.5) -> DataFrame:
    """Days whose theme count exceeds ``factor`` times the median day."""
    daily = study.pin(
        "theme_days",
        lambda: study.get("v_gdelt_gkg_themes_daily").select("event_date", "n_econ_oil"),
    )
    # one row per day: the histogram behind the median is calendar-sized
    median = daily.agg(F.median("n_econ_oil").alias("_m")).scalar()
    return daily.withColumn("median_day", median).filter(
        F.col("n_econ_oil") > factor * F.col("median_day")
    )


def having_min_count(study: Study, minimum: int = 5) -> DataFrame:
    """Places with at least ``minimum`` events."""
    return study.get("v_event_geo").filter(F.col("event_count") >= minimum)
