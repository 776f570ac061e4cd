"""The 24 named views over the nine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TONE_DISPERSIONS, TONE_PARTS
from tidemark.functions.columns import gas_regime, round_half_up
from tidemark.operators import rollups, series
from tidemark.operators.bounds import bounded_broadcast, span_days
from tidemark.operators.calendar import attach_impacts, impact_table
from tidemark.plans.registry import Study, view

# short name of each impact measure and the column it is taken from
IMPACT_SERIES = {"brent": "brent_close", "ttf": "ttf_close", "power": "gb_power_avg"}


@view("v_brent_daily", "brent")
def brent_daily(study: Study) -> DataFrame:
    return study.get("brent").select("price_date", "brent_close")


@view("v_ttf_daily", "ttf")
def ttf_daily(study: Study) -> DataFrame:
    return study.get("ttf").select("price_date", "ttf_close")


@view("v_gb_power_daily", "gb_power")
def gb_power_daily(study: Study) -> DataFrame:
    return study.get("gb_power").select("price_date", "gb_power_avg")


@view("v_gb_gen_mix_daily", "gb_gen_mix")
def gb_gen_mix_daily(study: Study) -> DataFrame:
    return study.get("gb_gen_mix")


@view("v_uka_proxy_daily", "uka_proxy")
def uka_proxy_daily(study: Study) -> DataFrame:
    return study.get("uka_proxy").select(
        F.col("price_date").cast("date").alias("price_date"),
        F.col("uka_proxy_gbp").cast("double").alias("uka_close_gbp_per_tco2"),
        F.col("krbn_close").cast("double").alias("krbn_close_usd"),
        "source",
    )


def conflict_events(study: Study) -> DataFrame:
    cfg = study.cfg
    rows = rollups.in_window(study.get("gdelt"), cfg.window_start, cfg.window_end)
    return rollups.conflict_rows(rows, cfg.countries, cfg.conflict_classes)


def articles(study: Study) -> DataFrame:
    return rollups.in_window(
        study.get("gdelt_gkg"), study.cfg.window_start, study.cfg.window_end
    )


@view("v_middle_east_events", "gdelt")
def middle_east_events(study: Study) -> DataFrame:
    return rollups.event_rollup(conflict_events(study))


@view("v_event_geo", "gdelt")
def event_geo(study: Study) -> DataFrame:
    cfg = study.cfg
    rows = rollups.in_window(study.get("gdelt"), cfg.window_start, cfg.window_end)
    return rollups.place_grid(
        rows.filter(F.col("quad_class").isin(*cfg.conflict_classes)), cfg.place_types
    )


def trading_panel(study: Study, *names: str) -> DataFrame:
    """Series on the anchor calendar: the others are left-aligned to its days."""
    return study.panel("brent", *names).filter("has_brent")


@view("v_combined_daily", "v_brent_daily", "v_ttf_daily", "v_gb_power_daily", "v_middle_east_events")
def combined_daily(study: Study) -> DataFrame:
    cfg = study.cfg
    events = bounded_broadcast(
        study.get("v_middle_east_events"), span_days(cfg.window_start, cfg.window_end), 64
    )
    panel = trading_panel(study, "ttf", "power")
    return panel.join(events, panel.price_date == events.event_date, "left").select(
        F.col("price_date").alias("d"),
        "brent_close",
        "ttf_close",
        "gb_power_avg",
        "event_count",
        "avg_tone",
    )


def impacts_by_day(study: Study, horizons: tuple[int, ...], anchor: str = "event") -> DataFrame:
    return impact_table(
        trading_panel(study, "ttf", "power"),
        list(IMPACT_SERIES.values()),
        horizons,
        study.series_window(),
        anchor=anchor,
    )


def events_with_impacts(
    study: Study, horizons: tuple[int, ...], anchor: str = "event"
) -> DataFrame:
    return attach_impacts(
        study.get("timeline"),
        impacts_by_day(study, horizons, anchor),
        "event_date",
        study.series_window(),
    )


def _moves(k: int) -> list:
    return [
        round_half_up(f"{col}_move_{k}d", 1).alias(f"{name}_pct_{k}d")
        for name, col in IMPACT_SERIES.items()
    ]


@view("v_event_impact", "timeline", "v_brent_daily", "v_ttf_daily", "v_gb_power_daily")
def event_impact(study: Study) -> DataFrame:
    columns = []
    for (name, col), move in zip(IMPACT_SERIES.items(), _moves(3), strict=True):
        columns += [F.col(f"{col}_t").alias(f"{name}_t"), F.col(f"{col}_t3").alias(f"{name}_t3")]
        columns.append(move)
    return events_with_impacts(study, (3,)).select("event_date", "label", *columns)


@view("v_event_impact_multi", "timeline", "v_brent_daily", "v_ttf_daily", "v_gb_power_daily")
def event_impact_multi(study: Study) -> DataFrame:
    return multi_moves(study).drop("phase")


def multi_moves(study: Study) -> DataFrame:
    """Multi-horizon moves with the event's own phase, so no join back by date is needed."""
    horizons = study.cfg.horizons
    columns = [
        round_half_up(f"{col}_move_{k}d", 1).alias(f"{name}_pct_{k}d")
        for name, col in IMPACT_SERIES.items()
        for k in horizons
    ]
    return events_with_impacts(study, horizons).select("event_date", "label", "phase", *columns)


@view("v_event_impact_multi_phase", "v_event_impact_multi", "timeline")
def event_impact_multi_phase(study: Study) -> DataFrame:
    moves = multi_moves(study)
    measures = [c for c in moves.columns if c not in ("event_date", "label", "phase")]
    phase = F.coalesce("phase", F.lit("unassigned"))
    means = moves.groupBy(phase.alias("phase")).agg(
        F.count(F.lit(1)).alias("n_events"),
        *[round_half_up(F.avg(c), 1).alias(f"{c}_mean") for c in measures],
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in study.cfg.phase_order]), F.col("phase"))
    last = len(study.cfg.phase_order) + 1
    return means.orderBy(F.when(rank > 0, rank).otherwise(last), "phase")


@view("v_event_impact_regime", "timeline", "v_event_impact", "v_gb_gen_mix_daily")
def event_impact_regime(study: Study) -> DataFrame:
    first, last = study.series_window()
    # aligned on its own, the mix has one row per day whatever the table holds
    mix = (
        study.panel("mix")
        .filter(F.col("price_date").between(F.lit(first), F.lit(last)))
        .select("price_date", "gas_share_pct", "renewables_share_pct", "nuclear_share_pct", "total_mwh")
    )
    mix = bounded_broadcast(mix, span_days(first, last), 64)
    events = events_with_impacts(study, (3,)).select("event_date", "label", "t0_date", *_moves(3))
    joined = events.join(mix, events.t0_date == mix.price_date, "left").drop("price_date")
    return joined.withColumn("regime", gas_regime("gas_share_pct", study.cfg.gas_share_threshold))


@view(
    "v_clean_spark_spread_daily",
    "v_brent_daily",
    "v_ttf_daily",
    "v_gb_power_daily",
    "v_uka_proxy_daily",
    "v_gb_gen_mix_daily",
)
def clean_spark_spread_daily(study: Study) -> DataFrame:
    cfg = study.cfg
    panel = trading_panel(study, "ttf", "power", "carbon", "mix").filter("has_ttf AND has_power")
    return series.theoretical_spread(
        panel, cfg.heat_rate, cfg.fx_rate, cfg.emissions_factor, cfg.gas_share_threshold
    )


@view("v_css_regime_event_impact", "v_event_impact_regime", "v_clean_spark_spread_daily")
def css_regime_event_impact(study: Study) -> DataFrame:
    first, last = study.series_window()
    parts = [
        "power_observed_gbp_mwh",
        "theoretical_css_gbp_mwh",
        "fuel_cost_gbp_mwh",
        "carbon_cost_gbp_mwh",
        "residual_gbp_mwh",
    ]
    spread = (
        study.get("v_clean_spark_spread_daily")
        .filter(F.col("price_date").between(F.lit(first), F.lit(last)))
        .select("price_date", *parts)
    )
    spread = bounded_broadcast(spread, span_days(first, last), 96)
    events = study.get("v_event_impact_regime")
    return events.join(spread, events.t0_date == spread.price_date, "left").select(
        "event_date",
        "label",
        "t0_date",
        "regime",
        "gas_share_pct",
        "brent_pct_3d",
        "ttf_pct_3d",
        "power_pct_3d",
        *parts,
        F.abs("residual_gbp_mwh").alias("abs_residual_gbp_mwh"),
    )


@view("v_implied_ttf_daily", "v_clean_spark_spread_daily")
def implied_ttf_daily(study: Study) -> DataFrame:
    cfg = study.cfg
    return series.implied_inverse(
        study.get("v_clean_spark_spread_daily"),
        cfg.heat_rate,
        cfg.fx_rate,
        cfg.emissions_factor,
        cfg.basis_threshold,
    )


@view("v_news_burst_daily", "v_middle_east_events")
def news_burst_daily(study: Study) -> DataFrame:
    daily = study.get("v_middle_east_events").select("event_date", "event_count")
    return series.burst(daily, "event_date", "event_count", study.cfg.burst_rows)


@view("v_gdelt_tone_asymmetry_daily", "gdelt")
def gdelt_tone_asymmetry_daily(study: Study) -> DataFrame:
    return rollups.tone_asymmetry(conflict_events(study))


@view("v_gdelt_events_features_daily", "gdelt")
def gdelt_events_features_daily(study: Study) -> DataFrame:
    return rollups.event_features(
        conflict_events(study), study.cfg.class_counts, study.cfg.root_counts
    )


@view("v_gkg_tone_daily", "gdelt_gkg")
def gkg_tone_daily(study: Study) -> DataFrame:
    return rollups.vector_rollup(articles(study), TONE_PARTS, TONE_DISPERSIONS)


@view("v_gdelt_gkg_themes_daily", "gdelt_gkg")
def gdelt_gkg_themes_daily(study: Study) -> DataFrame:
    cfg = study.cfg
    return rollups.token_rollup(articles(study), "themes", cfg.theme_tokens, cfg.theme_composites)


@view("v_gdelt_gkg_hormuz_daily", "gdelt_gkg")
def gdelt_gkg_hormuz_daily(study: Study) -> DataFrame:
    cfg = study.cfg
    return rollups.token_rollup(
        articles(study), "locations", cfg.place_tokens, cfg.place_composites
    )


@view("v_gdelt_gkg_gcam_daily", "gdelt_gkg")
def gdelt_gkg_gcam_daily(study: Study) -> DataFrame:
    return rollups.keyed_score_rollup(
        articles(study), "scores", study.cfg.score_keys, study.cfg.score_dispersions
    )


def theme_place_counts(study: Study) -> DataFrame:
    """Theme counts with place counts of the same day, from one pass over the articles."""
    cfg = study.cfg
    return rollups.themes_and_places(
        articles(study),
        cfg.theme_tokens,
        cfg.theme_composites,
        cfg.place_tokens,
        cfg.place_composites,
    )


@view("v_lng_vs_oil_signal_daily", "v_gdelt_gkg_themes_daily", "v_gdelt_gkg_hormuz_daily")
def lng_vs_oil_signal_daily(study: Study) -> DataFrame:
    return rollups.dual_signal(theme_place_counts(study))


@view("v_finbert_daily", "finbert_scores")
def finbert_daily(study: Study) -> DataFrame:
    return rollups.score_rollup(study.get("finbert_scores"))
