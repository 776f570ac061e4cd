"""Registered queries and the SQL that checks them.

``queries()`` maps a name to a function of (session, table directory); ``oracle_sql()`` maps the
same name to SQL for the same tables. Floating-point results are fixed to 6 places on both
sides, as the last bits of a sum depend on the order of its rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402
from pyspark import cloudpickle  # noqa: E402

import oracle_queries as o  # noqa: E402
import tidemark  # noqa: E402
from tidemark.functions.columns import round_half_up  # noqa: E402
from tidemark.functions.text import slug  # noqa: E402
from tidemark.config import FUEL_CATEGORIES, TONE_DISPERSIONS, TONE_PARTS  # noqa: E402
from tidemark.operators import ranking, rollups, scoring, series, windows  # noqa: E402
from tidemark.operators.calendar import fwd_snap  # noqa: E402
from tidemark.plans import analyses, bindings, gold, views  # noqa: E402
from tidemark.plans.bindings import SampleStudy  # noqa: E402
from tidemark.plans.registry import Study  # noqa: E402
from tidemark.session import DEFAULTS, run_dir  # noqa: E402
from tidemark.sources import bronze, landing, quality, readers, sinks  # noqa: E402
from tidemark.sources.units import UnitTable  # noqa: E402
from tidemark.streaming import jobs  # noqa: E402

# scoring tasks carry the package's own functions, so workers need no copy of this folder
cloudpickle.register_pickle_by_value(tidemark)

SMOKE_DIR = "/root/testdata/sf0.001"


def fix(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            round_half_up(f.name, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def study_of(spark: SparkSession, sf_dir: str) -> SampleStudy:
    spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])
    return SampleStudy(spark, sf_dir)


QUERIES: dict[str, Callable[[SampleStudy], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[SampleStudy], DataFrame], sql: str | None, *doubles: str):
    """``doubles`` are the floating-point result columns; ``sql`` None means no SQL check."""
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = o.fixed(sql, *doubles)


def register_view(name: str, view: str, sql: str, *doubles: str):
    register(name, lambda s: s.get(view), sql, *doubles)


# ---- the 24 views ----

register_view(
    "anchor_daily", "v_brent_daily", "SELECT price_date, brent_close FROM brent", "brent_close"
)
register_view("linked_daily", "v_ttf_daily", "SELECT price_date, ttf_close FROM ttf", "ttf_close")
register_view(
    "target_daily",
    "v_gb_power_daily",
    "SELECT price_date, gb_power_avg FROM gb_power",
    "gb_power_avg",
)
SHARES = [f"{c}_share_pct" for c in bindings.MIX_CATEGORIES]
register_view(
    "mix_share_daily", "v_gb_gen_mix_daily", "SELECT * FROM gb_gen_mix", "total_mwh", *SHARES
)
register_view(
    "rebased_series",
    "v_uka_proxy_daily",
    """SELECT price_date, uka_proxy_gbp AS uka_close_gbp_per_tco2, krbn_close AS krbn_close_usd,
       source FROM uka_proxy""",
    "uka_close_gbp_per_tco2",
    "krbn_close_usd",
)
register_view(
    "event_rollup_daily", "v_middle_east_events", "SELECT * FROM news", "avg_tone", "avg_goldstein"
)
register_view("geo_grid_rollup", "v_event_geo", "SELECT * FROM geo", "lat", "lon", "avg_tone")
register_view(
    "combined_daily",
    "v_combined_daily",
    "SELECT * FROM combined",
    "brent_close",
    "ttf_close",
    "gb_power_avg",
    "avg_tone",
)
LEVELS = [f"{n}_{t}" for n in ("brent", "ttf", "power") for t in ("t", "t3")]
MOVES = list(analyses.MOVES)
register_view(
    "event_impact",
    "v_event_impact",
    f"SELECT event_date, label, {', '.join(LEVELS + MOVES)} FROM impact",
    *LEVELS,
    *MOVES,
)
ALL_MOVES = [f"{n}_pct_{k}d" for n in ("brent", "ttf", "power") for k in (1, 3, 5, 10)]
register_view(
    "event_impact_multi",
    "v_event_impact_multi",
    f"SELECT event_date, label, {', '.join(ALL_MOVES)} FROM multi",
    *ALL_MOVES,
)
register_view(
    "event_impact_phase",
    "v_event_impact_multi_phase",
    f"""SELECT COALESCE(phase, 'unassigned') AS phase, COUNT(*) AS n_events,
        {", ".join(f"{o.rnd(f'AVG({m})', 1)} AS {m}_mean" for m in ALL_MOVES)}
        FROM multi GROUP BY 1""",
    *[f"{m}_mean" for m in ALL_MOVES],
)
MIX3 = ["gas_share_pct", "renewables_share_pct", "nuclear_share_pct", "total_mwh"]
register_view(
    "event_impact_regime", "v_event_impact_regime", "SELECT * FROM regime", *MOVES, *MIX3
)
COSTS = [
    "fuel_cost_gbp_mwh",
    "carbon_cost_gbp_mwh",
    "theoretical_css_gbp_mwh",
    "residual_gbp_mwh",
]
register_view(
    "spread_daily",
    "v_clean_spark_spread_daily",
    "SELECT * FROM spread",
    "brent_close",
    "ttf_close",
    "power_observed_gbp_mwh",
    "uka_proxy_gbp_per_tco2",
    "gas_share_pct",
    *COSTS,
)
register_view(
    "event_spread_residual",
    "v_css_regime_event_impact",
    f"""SELECT event_date, label, t0_date, regime.regime, regime.gas_share_pct, {", ".join(MOVES)},
        power_observed_gbp_mwh, {", ".join(COSTS)}, ABS(residual_gbp_mwh) AS abs_residual_gbp_mwh
        FROM regime LEFT JOIN spread ON spread.price_date = t0_date""",
    "gas_share_pct",
    *MOVES,
    "power_observed_gbp_mwh",
    *COSTS,
    "abs_residual_gbp_mwh",
)
register_view(
    "implied_inverse_daily",
    "v_implied_ttf_daily",
    "SELECT * FROM implied",
    "observed_ttf_eur_mwh",
    "power_observed_gbp_mwh",
    "uka_proxy_gbp_per_tco2",
    "gas_share_pct",
    "implied_ttf_eur_mwh",
    "basis_eur_mwh",
)
register_view(
    "burst_score",
    "v_news_burst_daily",
    "SELECT * FROM burst",
    "rolling_30d_mean",
    "burst_score",
)
register_view(
    "tone_asymmetry_daily",
    "v_gdelt_tone_asymmetry_daily",
    "SELECT * FROM asymmetry",
    "negative_tone",
    "positive_tone",
    "overall_tone",
)
register_view(
    "event_features_daily",
    "v_gdelt_events_features_daily",
    "SELECT * FROM features",
    "mean_tone",
    "mentions_weighted_tone",
    "mean_goldstein",
    "mentions_weighted_goldstein",
    "total_weighted_goldstein",
)
VECTOR = [f"mean_{n}" for n in o.b_parts()] + [
    f"{n}_dispersion" for n in ("tone", "positive", "negative")
]
register_view("vector_tone_daily", "v_gkg_tone_daily", "SELECT * FROM vector", *VECTOR)
register_view("theme_counts_daily", "v_gdelt_gkg_themes_daily", "SELECT * FROM themes")
register_view("place_counts_daily", "v_gdelt_gkg_hormuz_daily", "SELECT * FROM places")
KEYED = [f"mean_{n}" for n in o.CFG.score_keys] + [
    f"dispersion_{n}" for n in o.CFG.score_dispersions
]
register_view("keyed_scores_daily", "v_gdelt_gkg_gcam_daily", "SELECT * FROM keyed", *KEYED)
register_view("dual_signal_daily", "v_lng_vs_oil_signal_daily", "SELECT * FROM dual")
SCORE_MEANS = [f"mean_finbert_{n}" for n in ("signed", "positive", "negative", "neutral")]
register_view(
    "score_rollup_daily",
    "v_finbert_daily",
    "SELECT * FROM score_days",
    *SCORE_MEANS,
    "mentions_weighted_finbert_signed",
    "finbert_dispersion",
)

# ---- sources, quality ----


def payload_rows(s: SampleStudy) -> DataFrame:
    """JSON payload of each event parsed under a schema, counted per value."""
    parsed = F.from_json("props", "k int")
    return s.raw("events").select(parsed.getField("k").alias("k")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


register(
    "json_rows",
    payload_rows,
    """SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, COUNT(*) AS n_rows
       FROM events GROUP BY 1""",
)
INGEST = tuple(bindings.SAMPLE_CONFIG.theme_tokens.values())
register(
    "ingest_token_filter",
    lambda s: s.get("gdelt_gkg")
    .filter(sinks.contains_any("themes", INGEST))
    .select("article_id", "event_date", "themes"),
    f"""SELECT article_id, event_date, themes FROM articles
        WHERE {" OR ".join(f"contains(themes, '{t}')" for t in INGEST)}""",
)


def slot_frames(s: SampleStudy, minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """The expected file slots of the event stream and the slots that hold rows."""
    present = s.raw("events").select(quality.slot_of("ts", minutes).alias("slot")).distinct()
    bounds = s.raw("events").select(
        F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz").alias("s"),
        quality.slot_of(F.max("ts"), minutes).alias("e"),
    )
    return quality.expected_slots(bounds, "s", "e", minutes), present


SLOTS = """SELECT UNNEST(generate_series(date_trunc('day', MIN(ts))::TIMESTAMP,
    time_bucket(INTERVAL 15 MINUTES, MAX(ts)), INTERVAL 15 MINUTES)) AS slot FROM events"""
register(
    "expected_slots",
    lambda s: slot_frames(s)[0],
    f"SELECT slot, strftime(slot, '%Y%m%d%H%M%S') AS stamp FROM ({SLOTS})",
)
register(
    "missing_slots",
    lambda s: quality.missing_slots(*slot_frames(s)),
    f"""SELECT slot, strftime(slot, '%Y%m%d%H%M%S') AS stamp FROM ({SLOTS})
        WHERE slot NOT IN (SELECT time_bucket(INTERVAL 15 MINUTES, ts) FROM events)""",
)


# ---- raw drops: text written, read back and loaded ----


def land(lines: DataFrame, path: str) -> str:
    """Write a raw drop, one file a slot."""
    by = ["date", "slot"]
    lines.repartition(*by).write.mode("append").partitionBy(*by).text(path)
    return path


def event_drop(s: SampleStudy) -> DataFrame:
    path = land(bindings.event_lines(s.raw("events")), run_dir(s.spark, "event-drop"))
    return landing.parsed(landing.lines(s.spark, path), landing.EVENT_LINES)


register(
    "ingest_metrics",
    lambda s: quality.file_metrics(event_drop(s).filter("problem IS NULL"), "date", "file"),
    """SELECT date, COUNT(DISTINCT slot) AS file_count, COUNT(*) AS event_count
       FROM event_drop GROUP BY 1""",
)


def event_drop_days(s: SampleStudy) -> DataFrame:
    """Accepted and rejected lines of each landing day, and what the casts make of them."""
    drop = event_drop(s)
    marks = drop.select(
        "globaleventid",
        F.col("problem").isNull().alias("good"),
        (F.col("n_fields") < 61).alias("short"),
        (F.col("n_fields") > 61).alias("long"),
        F.contains("actiongeo_fullname", F.lit('"')).alias("quoted"),
        *[c for c in drop.columns if c in ("day", "actiongeo_countrycode", "quadclass", "eventrootcode",
          "actiongeo_type", "actiongeo_fullname", "actiongeo_lat", "actiongeo_long", "avgtone",
          "goldsteinscale", "nummentions", "sourceurl", "date")],
    )
    extra = ("good", "short", "long", "quoted")
    cast = landing.typed.typed_events(marks, keep=extra)
    good = F.col("good")
    return cast.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(good).alias("n_accepted"),
        F.count_if(~good).alias("n_rejected"),
        F.count_if(good & F.col("short")).alias("n_short"),
        F.count_if(good & F.col("long")).alias("n_long"),
        F.count_if("quoted").alias("n_quoted"),
        F.count_if(good & F.col("event_date").isNull()).alias("n_undated"),
        F.sum("mentions").alias("total_mentions"),
        F.avg("tone").alias("avg_tone"),
        F.avg("lat").alias("avg_lat"),
    )


register(
    "raw_event_drop",
    event_drop_days,
    """SELECT date, COUNT(*) + COUNT(*) FILTER (WHERE event_id % 103 = 0) AS n_lines,
       COUNT(*) AS n_accepted, COUNT(*) FILTER (WHERE event_id % 103 = 0) AS n_rejected,
       COUNT(*) FILTER (WHERE short) AS n_short,
       COUNT(*) FILTER (WHERE event_id % 101 = 7 AND NOT short) AS n_long,
       COUNT(*) FILTER (WHERE event_id % 83 = 7 AND NOT short) AS n_quoted,
       COUNT(*) FILTER (WHERE event_id % 89 = 3) AS n_undated,
       CAST(SUM(mentions) FILTER (WHERE NOT short AND event_id % 79 <> 1) AS BIGINT) AS total_mentions,
       AVG(tone) FILTER (WHERE NOT short) AS avg_tone, AVG(lat) FILTER (WHERE NOT short) AS avg_lat
       FROM event_drop GROUP BY 1""",
    "avg_tone",
    "avg_lat",
)
register(
    "raw_article_drop",
    lambda s: landing.parsed(
        landing.lines(
            s.spark, land(bindings.article_lines(s.raw("documents")), run_dir(s.spark, "article-drop"))
        ),
        landing.ARTICLE_LINES,
    )
    .groupBy("date", F.coalesce("problem", F.lit("accepted")).alias("outcome"))
    .agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("problem").isNull(), F.col("v1themes"))).alias("n_themed"),
    ),
    """SELECT event_date AS date, CASE WHEN fault IS NULL THEN 'accepted' WHEN fault = 'long'
       THEN 'long' ELSE 'short' END AS outcome, COUNT(*) AS n_lines,
       COUNT(CASE WHEN fault IS NULL AND themes <> '' THEN 1 END) AS n_themed
       FROM article_drop GROUP BY 1, 2
       UNION ALL SELECT event_date, 'blank', COUNT(*), 0 FROM article_drop
       WHERE article_id % 53 = 0 GROUP BY 1""",
)


def resumable_ingest(s: SampleStudy) -> DataFrame:
    """Slots land in two goes; each is loaded, a dead run and a repeated one in between."""
    path, out = run_dir(s.spark, "landed"), run_dir(s.spark, "ingested")
    table = UnitTable(s.spark, out, landing.ARTICLE_ROWS)
    drop = bindings.article_lines(s.raw("documents"))
    prepare = landing.article_rows(INGEST)
    land(drop.filter("slot = '000000'"), path)
    landing.ingest(s.spark, path, table, prepare)
    land(drop.filter("slot <> '000000'"), path)
    # a run that dies after half of its rows: written, but not in the log
    half = landing.lines(s.spark, path).withColumn("unit", landing.unit_of())
    table.put(prepare(half.filter("slot <> '000000' AND length(value) % 2 = 0")))
    landing.ingest(s.spark, path, table, prepare)
    landing.ingest(s.spark, path, table, prepare)
    rows = table.rows().groupBy("unit").agg(
        F.count_if(F.col("problem").isNull()).alias("n_accepted"),
        F.count_if(F.col("problem").isNotNull()).alias("n_rejected"),
        F.count_if((F.col("problem") == "short") & F.col("article_id").isNull()).alias("n_short"),
        F.count_distinct("article_id").alias("n_articles"),
    )
    return table.log().join(rows, "unit", "left").select(
        "unit", "n_rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns if c != "unit"]
    )


TOLD = " OR ".join(f"contains(themes, '{t}')" for t in INGEST)
register(
    "resumable_ingest",
    resumable_ingest,
    f"""SELECT strftime(event_date, '%Y%m%d') || CASE slot WHEN 0 THEN '000000' ELSE '120000' END AS unit,
        COUNT(*) FILTER (WHERE hit) AS n_rows,
        COUNT(*) FILTER (WHERE hit AND fault IS NULL) AS n_accepted,
        COUNT(*) FILTER (WHERE hit AND fault IS NOT NULL) AS n_rejected,
        COUNT(*) FILTER (WHERE hit AND fault = 'short') AS n_short,
        COUNT(DISTINCT CASE WHEN hit AND fault IS NULL THEN article_id END) AS n_articles
        FROM (SELECT *, coalesce(({TOLD}) AND coalesce(fault, '') <> 'tiny', false) AS hit FROM article_drop)
        GROUP BY 1""",
)


def slot_gaps(s: SampleStudy) -> DataFrame:
    """Expected six-hour slots of the drop that no load has finished: afternoons do not land."""
    path, out = run_dir(s.spark, "landed"), run_dir(s.spark, "ingested")
    table = UnitTable(s.spark, out, "date date, n_lines long")
    drop = bindings.event_lines(s.raw("events"))
    land(drop.filter("slot <> '120000'"), path)
    landing.ingest(
        s.spark, path, table, lambda lines: lines.groupBy("unit", "date").agg(F.count(F.lit(1)).alias("n_lines"))
    )
    bounds = s.raw("events").select(
        F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz").alias("s"),
        quality.slot_of(F.max("ts"), 360).alias("e"),
    )
    return landing.gaps(quality.expected_slots(bounds, "s", "e", 360), table)


register(
    "slot_gaps",
    slot_gaps,
    """SELECT slot, strftime(slot, '%Y%m%d%H%M%S') AS stamp FROM (
           SELECT UNNEST(generate_series(date_trunc('day', MIN(ts))::TIMESTAMP,
               time_bucket(INTERVAL 6 HOURS, MAX(ts)), INTERVAL 6 HOURS)) AS slot FROM events)
       WHERE hour(slot) = 12
           OR slot NOT IN (SELECT time_bucket(INTERVAL 6 HOURS, ts) FROM events)""",
)


def external_days(s: SampleStudy) -> DataFrame:
    """Rows of each partition the catalog finds in a folder written behind its back."""
    path, name = run_dir(s.spark, "external"), "tidemark_external_events"
    rows = bindings.event_rows(s.raw("events")).withColumn("date", F.to_date("ts"))
    sinks.write_partitioned(rows, path)
    bronze.register(s.spark, name, path, rows.schema, "date")
    days = s.spark.sql(f"SHOW PARTITIONS {name}").select(
        F.to_date(F.substring_index("partition", "=", -1)).alias("date")
    )
    counts = s.spark.table(name).groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))
    return days.join(counts, "date", "left")


register(
    "external_days",
    external_days,
    "SELECT CAST(ts AS DATE) AS date, COUNT(*) AS n_rows FROM events GROUP BY 1",
)
PROFILED = ("orders", "lineitem", "events", "documents", "labels")
TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz",
}
PROFILE_SQL = """SELECT '{t}' AS object, name AS column, type, n_rows, n_present FROM (
    SELECT column_name AS name, {types} AS type FROM (DESCRIBE {t}))
    JOIN (UNPIVOT (SELECT COUNT(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE n_present) USING (name)
    CROSS JOIN (SELECT COUNT(*) AS n_rows FROM {t})"""
register(
    "column_profile",
    lambda s: quality.column_profile({t: s.raw(t) for t in PROFILED}),
    " UNION ALL ".join(
        PROFILE_SQL.format(t=t, types=o.case_of("column_type", TYPE_NAMES)) for t in PROFILED
    ),
)
DAILY_SOURCES = ("brent", "ttf", "gb_power", "gb_gen_mix", "uka_proxy")
register(
    "source_metrics",
    lambda s: quality.panel_metrics(
        s.panel("brent", "ttf", "power", "mix", "carbon"),
        "price_date",
        dict(zip(DAILY_SOURCES, ("brent", "ttf", "power", "mix", "carbon"))),
    ),
    " UNION ALL ".join(
        f"SELECT '{n}' AS source, COUNT(*) AS rows, MIN(price_date) AS first_date,"
        f" MAX(price_date) AS last_date FROM {n}"
        for n in DAILY_SOURCES
    ),
)
register(
    "coverage_check",
    lambda s: quality.coverage(s.get("gdelt"), "event_date"),
    """SELECT MIN(event_date) AS first_day, MAX(event_date) AS last_day,
       COUNT(DISTINCT event_date) AS distinct_days,
       date_diff('day', MIN(event_date), MAX(event_date)) + 1 AS span_days FROM gdelt""",
)
SWEEP = {
    "timeline": "timeline", "brent": "brent", "ttf": "ttf", "gb_power": "gb_power",
    "gb_gen_mix": "gb_gen_mix", "uka_proxy": "uka_proxy", "gdelt": "gdelt",
    "gdelt_gkg": "articles", "finbert_scores": "scores",
    "v_brent_daily": "brent", "v_ttf_daily": "ttf", "v_gb_power_daily": "gb_power",
    "v_gb_gen_mix_daily": "gb_gen_mix", "v_uka_proxy_daily": "uka_proxy",
    "v_middle_east_events": "news", "v_event_geo": "geo", "v_combined_daily": "combined",
    "v_event_impact": "impact", "v_event_impact_multi": "multi",
    "v_event_impact_multi_phase": "(SELECT DISTINCT COALESCE(phase, 'unassigned') FROM timeline)",
    "v_event_impact_regime": "regime", "v_clean_spark_spread_daily": "spread",
    "v_css_regime_event_impact": "regime", "v_implied_ttf_daily": "implied",
    "v_news_burst_daily": "burst", "v_gdelt_tone_asymmetry_daily": "asymmetry",
    "v_gdelt_events_features_daily": "features", "v_gkg_tone_daily": "vector",
    "v_gdelt_gkg_themes_daily": "themes", "v_gdelt_gkg_hormuz_daily": "places",
    "v_gdelt_gkg_gcam_daily": "keyed", "v_lng_vs_oil_signal_daily": "dual",
    "v_finbert_daily": "score_days",
}


def gold_study(s: SampleStudy) -> Study:
    """The study on tables written once: daily series, and states the news views are merged from."""
    root, cfg, spark = run_dir(s.spark, "gold"), s.cfg, s.spark

    def kept(name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{root}/{name}")

    tables = {n: kept(n, s.get(n)) for n in ("timeline", *DAILY_SOURCES, "finbert_scores")}
    tables |= {n: s.get(n) for n in ("gdelt", "gdelt_gkg")}  # their rows are counted from footers
    events, articles = (tables[n].withColumn("date", F.col("event_date")) for n in ("gdelt", "gdelt_gkg"))
    states = kept("event_states", gold.event_states(events, cfg))
    tables |= gold.event_views(states, cfg)
    states = kept("article_states", gold.article_states(articles, cfg, TONE_PARTS))
    tables |= gold.article_views(states, cfg, TONE_PARTS, TONE_DISPERSIONS)
    return Study(spark, tables, cfg)


register(
    "sanity_sweep",
    lambda s: gold_study(s).sweep(),
    " UNION ALL ".join(
        f"SELECT '{n}' AS object, COUNT(*) AS n_rows, COUNT(*) = 0 AS is_empty FROM {t}"
        for n, t in SWEEP.items()
    ),
)

def refreshed_states(s: SampleStudy) -> str:
    """Event files by landing day and their states; then rows of some days land late, and only
    the states of these days are worked out again. The folder of the states comes back."""
    raw, path = run_dir(s.spark, "raw-events"), run_dir(s.spark, "event-states")
    rows = bindings.event_rows(s.raw("events")).withColumn("date", F.to_date("ts")).drop("ts")
    late = (F.dayofmonth("date") > 27) & F.coalesce(F.col("quad_class") == "3", F.lit(False))
    ddl = rows.drop("date").schema.toDDL()
    for part in (rows.filter(~late), rows.filter(late)):
        part.write.mode("append").partitionBy("date").parquet(raw)
        gold.refresh(s.spark, raw, path, ddl, lambda r: gold.event_states(r, s.cfg))
    return path


def gold_view(name: str):
    return lambda s: gold.event_views(gold.read_states(s.spark, refreshed_states(s)), s.cfg)[name]


register(
    "gold_event_features",
    gold_view("v_gdelt_events_features_daily"),
    "SELECT * FROM features",
    "mean_tone",
    "mentions_weighted_tone",
    "mean_goldstein",
    "mentions_weighted_goldstein",
    "total_weighted_goldstein",
)


def state_days(s: SampleStudy) -> DataFrame:
    """Rows of each landing day's states, and how often they were worked out."""
    path = refreshed_states(s)
    versions = gold.known_prints(s.spark, path).groupBy("date").agg(F.max("version").alias("n_builds"))
    states = gold.read_states(s.spark, path).groupBy("date").agg(F.sum("n_rows").alias("n_rows"))
    return states.join(versions, "date", "left")


register(
    "gold_state_days",
    state_days,
    """SELECT CAST(ts AS DATE) AS date, CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(CASE WHEN day(CAST(ts AS DATE)) > 27 AND COUNT(*) FILTER (WHERE quad_class = '3') > 0
           THEN 2 ELSE 1 END AS BIGINT) AS n_builds FROM gdelt GROUP BY 1""",
)

# ---- predicates, joins ----

register(
    "predicate_mix",
    lambda s: s.get("gdelt_gkg")
    .filter(
        (F.col("themes") != "")
        & F.col("event_date").between("1998-01-15", "1998-03-15")
        & sinks.contains_any("locations", ("Hormuz", "Kharg"))
    )
    .groupBy("event_date")
    .agg(F.count(F.lit(1)).alias("n_articles")),
    """SELECT event_date, COUNT(*) AS n_articles FROM articles
       WHERE themes <> '' AND event_date BETWEEN DATE '1998-01-15' AND DATE '1998-03-15'
       AND (contains(locations, 'Hormuz') OR contains(locations, 'Kharg')) GROUP BY 1""",
)
register(
    "having_min_count",
    analyses.having_min_count,
    "SELECT * FROM geo WHERE event_count >= 5",
    "lat",
    "lon",
    "avg_tone",
)
register(
    "forward_snap",
    lambda s: fwd_snap(
        s.get("timeline").select("event_date", "label"),
        s.get("brent").select(F.col("price_date").alias("d")),
        "event_date",
        "t3_date",
        window=s.series_window(),
        plus_days=3,
    ),
    "SELECT event_date, label, day AS t3_date FROM targets WHERE k = 3",
)
register(
    "scalar_lookup",
    lambda s: views.events_with_impacts(s, (3,)).select(
        "event_date",
        "t0_date",
        F.col("brent_close_t").alias("brent_t"),
        F.col("ttf_close_t").alias("ttf_t"),
        F.col("gb_power_avg_t").alias("power_t"),
    ),
    """SELECT event_date, day AS t0_date,
       (SELECT brent_close FROM brent WHERE price_date = day) AS brent_t,
       (SELECT ttf_close FROM ttf WHERE price_date = day) AS ttf_t,
       (SELECT gb_power_avg FROM gb_power WHERE price_date = day) AS power_t
       FROM targets WHERE k = 0""",
    "brent_t",
    "ttf_t",
    "power_t",
)
register(
    "range_window_join",
    lambda s: windows.within_windows(
        s.get("gdelt").select("event_id", "event_date", "country"),
        s.get("timeline"),
        "event_date",
        1,
        "event_date",
        (s.cfg.window_start, s.cfg.window_end),
    ),
    """SELECT event_id, event_date, country FROM gdelt WHERE EXISTS (SELECT 1 FROM timeline t
       WHERE gdelt.event_date BETWEEN t.event_date - 1 AND t.event_date + 1)""",
)
register(
    "all_day_impacts",
    analyses.all_day_impacts,
    "SELECT * FROM day_moves",
    *MOVES,
)
register("real_event_impacts", analyses.real_event_impacts, "SELECT * FROM real_moves", *MOVES)
register(
    "on_event_days",
    analyses.on_event_days,
    "SELECT * FROM theme_place WHERE event_date IN (SELECT event_date FROM timeline)",
)
register(
    "non_event_days",
    analyses.non_event_days,
    "SELECT * FROM theme_place WHERE event_date NOT IN (SELECT event_date FROM timeline)",
)
register("theme_place_daily", analyses.theme_place_daily, "SELECT * FROM theme_place")
register(
    "impact_with_news",
    analyses.impact_with_news,
    "SELECT * FROM with_news",
    *MOVES,
    "avg_tone",
    "avg_goldstein",
)

# ---- aggregations ----



def payloads(s: SampleStudy, lines: DataFrame) -> str:
    path = run_dir(s.spark, "payloads")
    lines.select("value").write.text(path)
    return path


register(
    "halfhour_to_daily",
    lambda s: series.half_hour_mean(
        readers.half_hour_prices(
            s.spark, payloads(s, bindings.price_payloads(s.raw("lineitem"))), bindings.PROVIDER, True
        ),
        "gb_power_avg",
    ),
    """SELECT day AS price_date, AVG(price) AS gb_power_avg FROM half_hours
       WHERE NOT other AND price > 0 AND NOT (day(day) = 5 AND period = 47)
           AND NOT (day(day) = 9 AND period = 46) GROUP BY 1""",
    "gb_power_avg",
)
register(
    "halfhour_mix",
    lambda s: series.half_hour_shares(
        readers.half_hour_generation(
            s.spark, payloads(s, bindings.generation_payloads(s.raw("lineitem"))), True
        ),
        FUEL_CATEGORIES,
        bindings.MIX_CATEGORIES,
    ),
    f"""SELECT price_date, total_mwh, {", ".join(
            f"round_even({c} / NULLIF(total_mwh, 0) * 100, 1) AS {c}_share_pct" for c in bindings.MIX_CATEGORIES)}
        FROM (SELECT *, round_even({" + ".join(bindings.MIX_CATEGORIES)}, 0) AS total_mwh
            FROM (SELECT price_date, {", ".join(
                f"COALESCE(SUM(amount) FILTER (WHERE c = '{c}'), 0) AS {c}" for c in bindings.MIX_CATEGORIES)}
                FROM fuel_days GROUP BY 1))""",
    "total_mwh",
    *SHARES,
)
NAMES = ("brent", "ttf", "power")
MEAN_MEDIAN = [f"{n}_{k}" for n in NAMES for k in ("mean", "median")]
register(
    "regime_summary",
    analyses.regime_summary,
    f"""SELECT regime, COUNT(*) AS n, {o.rnd("AVG(gas_share_pct)", 1)} AS gas_share_mean,
        {", ".join(f"{o.rnd(f'AVG({n}_pct_3d)', 1)} AS {n}_mean,"
                   f" {o.rnd(f'MEDIAN({n}_pct_3d)', 1)} AS {n}_median" for n in NAMES)}
        FROM regime_clean GROUP BY 1""",
    "gas_share_mean",
    *MEAN_MEDIAN,
)
register(
    "horizon_summary",
    analyses.horizon_summary,
    " UNION ALL ".join(
        f"SELECT {k} AS horizon_days, COUNT(*) AS n, "
        + ", ".join(
            f"{o.rnd(f'AVG({n}_pct_{k}d)', 1)} AS {n}_mean,"
            f" {o.rnd(f'MEDIAN({n}_pct_{k}d)', 1)} AS {n}_median"
            for n in NAMES
        )
        + " FROM multi WHERE brent_pct_10d IS NOT NULL"
        for k in (1, 3, 5, 10)
    ),
    *MEAN_MEDIAN,
)
SPREAD_MEANS = {
    "mean_power_obs": "AVG(power_observed_gbp_mwh)",
    "mean_theoretical": "AVG(theoretical_css_gbp_mwh)",
    "mean_residual": "AVG(residual_gbp_mwh)",
    "mean_abs_residual": "AVG(ABS(residual_gbp_mwh))",
    "std_residual": "STDDEV_SAMP(residual_gbp_mwh)",
}
register(
    "spread_regime_summary",
    analyses.spread_regime_summary,
    f"""SELECT regime, COUNT(*) AS n,
        {", ".join(f"{o.rnd(e, 1)} AS {n}" for n, e in SPREAD_MEANS.items())}
        FROM spread WHERE regime <> 'unknown' GROUP BY 1""",
    *SPREAD_MEANS,
)
IMPLIED_MEANS = {
    "mean_observed_ttf": "AVG(observed_ttf_eur_mwh)",
    "mean_implied_ttf": "AVG(implied_ttf_eur_mwh)",
    "mean_basis": "AVG(basis_eur_mwh)",
    "std_basis": "STDDEV_SAMP(basis_eur_mwh)",
}
register(
    "implied_regime_summary",
    analyses.implied_regime_summary,
    f"""SELECT regime, COUNT(*) AS n,
        {", ".join(f"{o.rnd(e, 1)} AS {n}" for n, e in IMPLIED_MEANS.items())}
        FROM implied WHERE regime <> 'unknown' GROUP BY 1""",
    *IMPLIED_MEANS,
)
register(
    "decoupled_share",
    analyses.decoupled_share,
    """SELECT regime, COUNT(*) AS n_days,
       COUNT(*) FILTER (WHERE basis_regime = 'decoupled') AS n_decoupled,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE basis_regime = 'decoupled') / COUNT(*) AS decoupled_pct
       FROM implied GROUP BY 1""",
    "decoupled_pct",
)
register(
    "implied_roundtrip",
    analyses.implied_roundtrip,
    """SELECT COUNT(*) AS n_days, MAX(ABS(power_observed_gbp_mwh - (implied_ttf_eur_mwh
       * 1.85::DOUBLE * 0.85::DOUBLE + uka_proxy_gbp_per_tco2 * 0.36::DOUBLE))) < 0.05
       AS within_rounding FROM implied""",
)
register(
    "series_range",
    analyses.series_range,
    """SELECT MIN(uka_proxy_gbp) AS low, MAX(uka_proxy_gbp) AS high, AVG(uka_proxy_gbp) AS mean
       FROM uka_proxy""",
    "low",
    "high",
    "mean",
)


def describe_sql(frame: str, cols) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, COUNT({c}) AS count, AVG({c}) AS mean,
            STDDEV_SAMP({c}) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
            quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
            quantile_cont({c}, 0.75) AS q75, CAST(MAX({c}) AS DOUBLE) AS max FROM {frame}"""
        for c in cols
    )


DESCRIBED = ("mean", "std", "min", "q25", "q50", "q75", "max")
register(
    "describe_shares",
    analyses.describe_shares,
    describe_sql("gb_gen_mix", MIX3[:3]),
    *DESCRIBED,
)
register(
    "describe_events",
    lambda s: ranking.describe(s.get("gdelt"), ["tone", "goldstein", "mentions"], buckets=32),
    describe_sql("gdelt", ("tone", "goldstein", "CAST(mentions AS DOUBLE)")).replace(
        "'CAST(mentions AS DOUBLE)'", "'mentions'"
    ),
    *DESCRIBED,
)
register(
    "value_counts",
    lambda s: rollups.value_counts(s.get("gdelt"), "country", 10),
    """SELECT country, COUNT(*) AS n_rows FROM gdelt GROUP BY 1
       ORDER BY n_rows DESC, country LIMIT 10""",
)
register(
    "top_mentions",
    lambda s: ranking.top_k(
        s.get("gdelt").select("event_id", "event_date", "country", "mentions", "tone"),
        [F.col("mentions").desc_nulls_last(), F.col("tone").asc_nulls_last()],
        25,
        "event_id",
    ),
    """SELECT event_id, event_date, country, mentions, tone FROM gdelt
       ORDER BY mentions DESC NULLS LAST, tone NULLS LAST, event_id LIMIT 25""",
    "tone",
)
register(
    "spike_days",
    analyses.spike_days,
    """SELECT event_date, n_econ_oil, median_day FROM themes
       CROSS JOIN (SELECT MEDIAN(n_econ_oil) AS median_day FROM themes)
       WHERE n_econ_oil > 1.5 * median_day""",
    "median_day",
)

# ---- windows, top-k ----

VOLATILITY = [f"{n}_{k}" for n in NAMES for k in ("ret", "vol7")]
SERIES = {"brent": "brent_close", "ttf": "ttf_close", "power": "gb_power_avg"}
register(
    "lagged_pct_change",
    analyses.lagged_pct_change,
    "SELECT d, brent_close, ttf_close, gb_power_avg, "
    + ", ".join(
        f"({c} / NULLIF(LAG({c}, 3) OVER (ORDER BY d), 0) - 1) * 100 AS {n}_pct_3d"
        for n, c in SERIES.items()
    )
    + " FROM combined",
    *SERIES.values(),
    *MOVES,
)
register("rolling_volatility", analyses.rolling_volatility, "SELECT * FROM volatility", *VOLATILITY)
PERIOD = """CASE WHEN d < DATE '1997-01-01' THEN 'pre' WHEN d > DATE '1999-12-31' THEN 'post'
    ELSE 'during' END"""
register(
    "volatility_by_period",
    analyses.volatility_by_period,
    f"""SELECT {PERIOD} AS period, {", ".join(f"AVG({n}_vol7) AS {n}_vol_mean" for n in NAMES)}
        FROM volatility GROUP BY 1""",
    *[f"{n}_vol_mean" for n in NAMES],
)
register(
    "period_buckets",
    analyses.period_buckets,
    f"""SELECT {PERIOD} AS period, COUNT(*) AS n_days, MIN(d) AS first_day, MAX(d) AS last_day
        FROM combined GROUP BY 1""",
)
register(
    "normalised_index",
    analyses.normalised_index,
    "SELECT d, brent_close, ttf_close, gb_power_avg, "
    + ", ".join(
        f"({c} / (SELECT {c} FROM combined WHERE {c} IS NOT NULL ORDER BY d LIMIT 1) - 1) * 100"
        f" AS {c}_pct"
        for c in SERIES.values()
    )
    + " FROM combined",
    *SERIES.values(),
    *[f"{c}_pct" for c in SERIES.values()],
)
register(
    "top_bursts",
    analyses.top_bursts,
    "SELECT * FROM burst ORDER BY burst_score DESC NULLS LAST, event_date LIMIT 5",
    "rolling_30d_mean",
    "burst_score",
)
register(
    "top_signal_days",
    analyses.top_signal_days,
    """SELECT event_date, oil_signal, lng_signal, ttf_pct_3d, power_pct_3d FROM dual_moves
       ORDER BY lng_signal DESC, event_date LIMIT 8""",
    "ttf_pct_3d",
    "power_pct_3d",
)
register(
    "dominance_label",
    analyses.dominance_label,
    """SELECT event_date, oil_signal, lng_signal, ttf_pct_3d,
       CASE WHEN lng_signal >= 5 AND lng_signal > 0.05 * oil_signal THEN 'LNG-dominant'
            WHEN oil_signal >= 50 AND oil_signal > 5 * lng_signal THEN 'Oil-dominant'
            ELSE 'mixed/low' END AS dominant FROM dual_moves""",
    "ttf_pct_3d",
)
register(
    "top_urls_per_day",
    lambda s: scoring.top_urls(
        rollups.conflict_rows(
            bindings.url_rows(s.raw("documents")), s.cfg.countries, s.cfg.conflict_classes
        ),
        s.cfg.top_urls_per_day,
    ),
    f"""SELECT * FROM url_days QUALIFY ROW_NUMBER() OVER (PARTITION BY day
       ORDER BY nummentions DESC NULLS LAST, source_url)
       <= {bindings.SAMPLE_CONFIG.top_urls_per_day}""",
)

# ---- statistics ----

STAT_COLUMNS = [*MOVES, *analyses.NEWS]
register(
    "pearson_matrix",
    lambda s: analyses.move_correlations(s, "pearson"),
    o.pearson_of_long(o.long_pairs("with_news", o.matrix_pairs(STAT_COLUMNS)), "x, y"),
    "r",
)
register(
    "spearman_matrix",
    lambda s: analyses.move_correlations(s, "spearman"),
    o.spearman_of_long(o.long_pairs("with_news", o.matrix_pairs(STAT_COLUMNS)), "x, y"),
    "r",
)
BOTH = ("pearson", "spearman", "r_squared")
register(
    "regime_corr",
    analyses.regime_corr,
    o.both_of_long(
        o.long_pairs("regime_clean", analyses.MOVE_PAIRS, "regime"), "regime, x, y"
    ),
    *BOTH,
)
register(
    "share_vs_move_corr",
    analyses.share_vs_move_corr,
    o.both_of_long(o.long_pairs("regime_clean", [("gas_share_pct", m) for m in MOVES]), "x, y"),
    *BOTH,
)
register(
    "spread_regime_corr",
    analyses.spread_regime_corr,
    o.both_of_long(
        o.long_pairs(
            "spread", [("power_observed_gbp_mwh", "theoretical_css_gbp_mwh")], "regime"
        )
        + " AND regime <> 'unknown'",
        "regime, x, y",
    ),
    *BOTH,
)
register(
    "implied_regime_corr",
    analyses.implied_regime_corr,
    o.both_of_long(
        o.long_pairs("implied", [("observed_ttf_eur_mwh", "implied_ttf_eur_mwh")], "regime")
        + " AND regime <> 'unknown'",
        "regime, x, y",
    ),
    *BOTH,
)


def signal_pairs(signals) -> list[tuple[str, str]]:
    return [(x, m) for x in signals for m in MOVES]


ALL_THERE = " AND ".join(f"{m} IS NOT NULL" for m in MOVES)
register(
    "tone_move_corr",
    analyses.tone_move_corr,
    o.pearson_of_long(
        o.long_pairs(
            f"(SELECT * FROM asym_moves WHERE negative_tone IS NOT NULL AND {ALL_THERE})",
            signal_pairs(["negative_tone", "positive_tone", "overall_tone"]),
        ),
        "x, y",
    ),
    "r",
)
register(
    "signal_move_corr",
    analyses.signal_move_corr,
    o.pearson_of_long(
        o.long_pairs(
            f"(SELECT * FROM feature_moves WHERE mean_goldstein IS NOT NULL AND {ALL_THERE})",
            signal_pairs(
                [
                    "mean_tone",
                    "mentions_weighted_tone",
                    "mean_goldstein",
                    "mentions_weighted_goldstein",
                ]
            ),
        ),
        "x, y",
    ),
    "r",
)
register(
    "signal_r2",
    analyses.signal_r2,
    o.both_of_long(o.long_pairs("dual_moves", signal_pairs(["oil_signal", "lng_signal"])), "x, y"),
    *BOTH,
)
SCORE_TONE = [
    f"{c}_{k}" for c in ("avg_tone", "mean_finbert_signed") for k in ("min", "max", "mean")
]
register(
    "score_vs_tone_corr",
    analyses.score_vs_tone_corr,
    f"""SELECT COUNT(*) AS n_days, {", ".join(
        f"{f}({c}) AS {c}_{k}" for c in ("avg_tone", "mean_finbert_signed")
        for k, f in (("min", "MIN"), ("max", "MAX"), ("mean", "AVG")))},
        {o.pearson("avg_tone", "mean_finbert_signed")} AS r
        FROM (SELECT avg_tone, mean_finbert_signed FROM score_days
              JOIN news ON news.event_date = score_days.event_date)""",
    *SCORE_TONE,
    "r",
)
register(
    "leave_one_out_corr",
    analyses.leave_one_out,
    f"""SELECT x, y, ANY_VALUE(n) AS n, ANY_VALUE(full_r) AS full_r, MIN(loo) AS min_loo,
        MAX(loo) AS max_loo,
        SIGN(MIN(loo)) <> SIGN(ANY_VALUE(full_r)) OR SIGN(MAX(loo)) <> SIGN(ANY_VALUE(full_r))
        AS sign_flip
        FROM (SELECT a.x, a.y, ANY_VALUE(f.n) AS n, ANY_VALUE(f.r) AS full_r,
                     {o.pearson("b.vx", "b.vy")} AS loo
              FROM loo_rows a JOIN loo_rows b ON a.x = b.x AND a.y = b.y AND a.i <> b.i
              JOIN ({o.pearson_of_long("SELECT * FROM loo_rows", "x, y")}) f
                ON f.x = a.x AND f.y = a.y
              GROUP BY a.x, a.y, a.i) GROUP BY x, y""",
    "full_r",
    "min_loo",
    "max_loo",
)
BOOT = ("r_observed", "ci_low", "ci_high", "p_gt_0", "p_gt_half")
register(
    "bootstrap_ci",
    analyses.bootstrap_ci,
    """SELECT (SELECT CORR(ttf_pct_3d, brent_pct_3d) FROM boot_rows) AS r_observed,
       COUNT(*) AS n_draws, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high,
       AVG(CAST(r > 0 AS DOUBLE)) AS p_gt_0, AVG(CAST(r > 0.5 AS DOUBLE)) AS p_gt_half
       FROM boot_draws WHERE r IS NOT NULL""",
    *BOOT,
)
PLACEBO = [f"{m}_mean" for m in MOVES]
register(
    "placebo_distribution", analyses.placebo_distribution, "SELECT * FROM placebo", *PLACEBO
)
register(
    "empirical_rank",
    analyses.empirical_rank,
    " UNION ALL ".join(
        f"""SELECT '{m}' AS series, real_mean, COUNT({m}_mean) AS n_draws,
            AVG(CAST({m}_mean < real_mean AS DOUBLE)) AS rank
            FROM placebo CROSS JOIN (SELECT AVG({m}) AS real_mean FROM real_moves) GROUP BY 2"""
        for m in MOVES
    ),
    "real_mean",
    "rank",
)

# ---- text, scoring ----

register(
    "url_slugs",
    lambda s: bindings.url_rows(s.raw("documents")).select("source_url", slug("source_url").alias("slug")),
    f"SELECT source_url, {o.slug_sql('source_url')} AS slug FROM url_rows",
)
register(
    "page_slugs",
    lambda s: s.raw("pages").select(
        "page_id", "url", slug("url").alias("slug")
    ),
    f"SELECT page_id, url, {o.slug_sql('url')} AS slug FROM pages",
)


def window_urls(
    s: SampleStudy, urls: DataFrame, events: DataFrame, long_urls: bool = False
) -> DataFrame:
    rows = rollups.conflict_rows(urls, s.cfg.countries, s.cfg.conflict_classes)
    return scoring.event_window_urls(
        rows,
        events,
        (s.cfg.window_start, s.cfg.window_end),
        s.cfg.url_window_days,
        s.cfg.top_urls_per_day,
        s.cfg.slug_min_length,
        long_urls,
    )


def sample_window_urls(s: SampleStudy) -> DataFrame:
    return window_urls(s, bindings.url_rows(s.raw("documents")), s.get("timeline"))


def text_window_urls(s: SampleStudy) -> DataFrame:
    """URLs of whole texts around every order of a month-end day."""
    urls = bindings.url_rows(s.raw("documents"), bindings.text_url())
    return window_urls(s, urls, bindings.month_ends(s.raw("orders")))


def text_scores(s: SampleStudy) -> DataFrame:
    """The earlier scores under URLs of whole texts."""
    return bindings.earlier_scores(s.raw("documents"), s.raw("labels"), bindings.text_url())


register("event_window_urls", sample_window_urls, "SELECT * FROM window_slugs")


def lexicon_scores(rows: str, lexicon: scoring.LexiconScorer = bindings.LEXICON) -> str:
    return f"""SELECT * EXCLUDE (slug_words, ep, em, en), ep / (ep + em + en) AS finbert_positive,
    em / (ep + em + en) AS finbert_neutral, en / (ep + em + en) AS finbert_negative,
    (ep - en) / (ep + em + en) AS finbert_signed
    FROM (SELECT *, EXP(8.0::DOUBLE * {o.words_share(lexicon.positive)}) AS ep,
                 EXP(0.5::DOUBLE) AS em,
                 EXP(8.0::DOUBLE * {o.words_share(lexicon.negative)}) AS en
          FROM (SELECT *, string_split(lower(slug), ' ') AS slug_words FROM {rows}))"""


SCORE_COLUMNS = scoring.SCORE_FIELDS
register(
    "batch_score",
    lambda s: scoring.score_batches(text_window_urls(s), "slug", bindings.make_lexicon_scorer),
    lexicon_scores("text_slugs"),
    *SCORE_COLUMNS,
)
register(
    "incremental_append",
    lambda s: sinks.appended(
        text_scores(s).select("source_url", "day", "nummentions"),
        sinks.unseen(text_window_urls(s), text_scores(s), "source_url"),
    ),
    """SELECT source_url, day, nummentions, CAST(NULL AS VARCHAR) AS slug FROM text_scores
       UNION ALL SELECT source_url, day, nummentions, slug FROM text_slugs
       WHERE source_url NOT IN (SELECT source_url FROM text_scores)""",
)


def score_pipeline(s: SampleStudy) -> DataFrame:
    """Scores whole texts around every order, all documents spread evenly."""
    # URLs are built before the join with the labels: digests then go there without texts
    documents = s.raw("documents").withColumn("source_url", bindings.text_url())
    url, day = F.col("source_url"), bindings.even_day()
    urls = window_urls(
        s, bindings.url_rows(documents, url, day), bindings.order_days(s.raw("orders")), True
    )
    keyed = documents.select("doc_id", scoring.url_digest("source_url").alias("url_digest"))
    return scoring.score_new(
        urls,
        bindings.earlier_scores(documents, s.raw("labels"), url, day),
        bindings.make_text_scorer,
        digests=keyed.join(s.raw("labels").select("doc_id"), "doc_id"),
    )


register(
    "score_pipeline",
    score_pipeline,
    f"""SELECT source_url, day, nummentions, slug, finbert_positive, finbert_neutral,
        finbert_negative, finbert_signed FROM even_scores
        UNION ALL BY NAME SELECT * FROM ({lexicon_scores("even_slugs", bindings.TEXT_LEXICON)})
        WHERE source_url NOT IN (SELECT source_url FROM even_scores)""",
    *SCORE_COLUMNS,
)


def appended_scores(s: SampleStudy) -> DataFrame:
    """An earlier run's scores, a run that adds the unscored URLs, and one that finds nothing."""
    urls = sample_window_urls(s)
    table = scoring.score_table(s.spark, run_dir(s.spark, "scores"), urls.schema)
    first = s.spark.createDataFrame([("1",)], "unit string")
    table.add(s.get("finbert_scores").withColumn("unit", F.lit("1")), first)
    for run in ("2", "3"):
        scoring.append_scores(urls, table, run, bindings.make_lexicon_scorer)
    log = table.log().select(F.col("unit").alias("_u"), F.col("n_rows").alias("run_rows"))
    names = ("source_url", "day", "nummentions", "slug", *SCORE_COLUMNS)
    return table.rows().join(log, F.col("unit") == F.col("_u")).select(*names, F.col("unit").alias("run"), "run_rows")


register(
    "appended_scores",
    appended_scores,
    f"""WITH old AS (SELECT source_url, day, nummentions, slug, finbert_positive, finbert_neutral,
            finbert_negative, finbert_signed FROM scores),
        fresh AS (SELECT * FROM ({lexicon_scores("window_slugs")})
            WHERE source_url NOT IN (SELECT source_url FROM old))
        SELECT *, '1' AS run, COUNT(*) OVER () AS run_rows FROM old
        UNION ALL BY NAME SELECT *, '2' AS run, COUNT(*) OVER () AS run_rows FROM fresh""",
    *SCORE_COLUMNS,
)

# ---- streams over the event and document files ----


def event_stream(s: SampleStudy) -> DataFrame:
    raw = jobs.file_stream(s.spark, bindings.path_of(s.sf_dir, "events"), s.raw("events").schema)
    return bindings.event_rows(raw)


def sample_conflict_stream(s: SampleStudy) -> DataFrame:
    return jobs.conflict_stream(event_stream(s), s.cfg.countries, s.cfg.conflict_classes)


def in_run_dir(s: SampleStudy, purpose: str) -> tuple[str, str]:
    base = run_dir(s.spark, purpose)
    return f"{base}/out", f"{base}/progress"


CLOSED = """(SELECT CAST(ts AS DATE) AS event_date, COUNT(*) AS event_count, AVG(tone) AS avg_tone,
    AVG(goldstein) AS avg_goldstein, CAST(SUM(mentions) AS BIGINT) AS total_mentions
    FROM conflict GROUP BY 1
    HAVING CAST(ts AS DATE) + 1 <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM conflict))"""


def event_waves(s: SampleStudy, repeats: bool = False) -> list[DataFrame]:
    """The event rows in three waves of files, one file a six-hour slot.

    The last slot of a wave lands with the next one, after rows that are newer. With ``repeats``
    a wave brings the last day of the one before once more.
    """
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600)
    rows = bindings.event_rows(s.raw("events")).withColumn("_slot", slot)
    first, last = rows.agg(F.min("_slot"), F.max("_slot")).first() or (0, 0)
    first, last = first or 0, last or 0
    cuts = [first + (last - first) * k // 3 for k in (1, 2)]
    wave = F.when(F.col("_slot") <= cuts[0], 0).when(F.col("_slot") <= cuts[1], 1).otherwise(2)
    held = rows.withColumn("_wave", wave + F.col("_slot").isin(cuts).cast("int"))

    def part(k: int) -> DataFrame:
        mine = F.col("_wave") == k
        if repeats and k:
            mine = mine | F.col("_slot").between(cuts[k - 1] - 3, cuts[k - 1] - 1)
        return held.filter(mine).repartition("_slot").drop("_slot", "_wave")

    return [part(k) for k in range(3)]


def streamed(s: SampleStudy, purpose: str, job, conflict: bool = True, repeats: bool = False) -> DataFrame:
    """Run ``job(stream, out, checkpoint)`` after each wave, from its own checkpoint."""
    base = run_dir(s.spark, purpose)
    out, progress, files = f"{base}/out", f"{base}/progress", f"{base}/files"
    waves = event_waves(s, repeats)

    def run() -> DataFrame:
        stream = jobs.file_stream(s.spark, files, waves[0].schema)
        if conflict:
            stream = jobs.conflict_stream(stream, s.cfg.countries, s.cfg.conflict_classes)
        return job(stream, out, progress)

    return jobs.in_waves(waves, files, run)


CLOSED = """(SELECT CAST(ts AS DATE) AS event_date, COUNT(*) AS event_count, AVG(tone) AS avg_tone,
    AVG(goldstein) AS avg_goldstein, CAST(SUM(mentions) AS BIGINT) AS total_mentions
    FROM conflict GROUP BY 1
    HAVING CAST(ts AS DATE) + 1 <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM conflict))"""
register(
    "stream_daily_rollup",
    lambda s: streamed(s, "daily", lambda x, out, at: jobs.run_to_files(jobs.daily_rollup(x), out, at)),
    f"SELECT * FROM {CLOSED}",
    "avg_tone",
    "avg_goldstein",
)
register(
    "stream_open_days",
    lambda s: streamed(s, "open-days", jobs.upsert_days).drop("n_versions"),
    """SELECT CAST(ts AS DATE) AS event_date, COUNT(*) AS event_count, AVG(tone) AS avg_tone,
       CAST(SUM(mentions) AS BIGINT) AS total_mentions,
       CAST(ts AS DATE) + 1 > (SELECT MAX(ts) - INTERVAL 1 DAY FROM conflict) AS open
       FROM conflict GROUP BY 1""",
    "avg_tone",
)
register(
    "stream_late_rows",
    lambda s: jobs.count_late(
        event_stream(s).select(
            F.to_date("ts").alias("file_date"),
            F.when(
                F.col("mentions").isNotNull(),
                F.date_sub(F.to_date("ts"), F.when(F.col("mentions") < 5, 2).otherwise(0)),
            ).alias("event_date"),
        ),
        *in_run_dir(s, "late"),
    ),
    """SELECT CAST(ts AS DATE) AS file_date,
       COUNT(*) FILTER (WHERE mentions >= 5) AS on_time,
       COUNT(*) FILTER (WHERE mentions < 5) AS late,
       COUNT(*) FILTER (WHERE mentions IS NULL) AS undated FROM gdelt GROUP BY 1""",
)
register(
    "stream_once_per_id",
    lambda s: streamed(
        s,
        "once",
        lambda x, out, at: jobs.run_to_files(jobs.once_per_id(x.select("event_id", "ts"), "event_id"), out, at),
        conflict=False,
        repeats=True,
    )
    .groupBy(F.to_date("ts").alias("day"))
    .agg(F.count(F.lit(1)).alias("n_rows")),
    "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n_rows FROM events GROUP BY 1",
)
register(
    "stream_ingest_filter",
    lambda s: jobs.run_to_files(
        jobs.ingest_filter(
            bindings.article_rows(
                jobs.file_stream(
                    s.spark, bindings.path_of(s.sf_dir, "documents"), s.raw("documents").schema
                )
            ).select("article_id", "event_date", "themes"),
            "themes",
            INGEST,
        ),
        *in_run_dir(s, "ingest"),
        partition_by=["event_date"],
    ),
    f"""SELECT article_id, event_date, themes FROM articles
        WHERE {" OR ".join(f"contains(themes, '{t}')" for t in INGEST)}""",
)
register(
    "stream_burst",
    lambda s: jobs.burst_on_closed_days(sample_conflict_stream(s), *in_run_dir(s, "burst")),
    f"""SELECT event_date, event_count, rolling_30d_mean,
        event_count / NULLIF(rolling_30d_mean, 0) AS burst_score
        FROM (SELECT event_date, event_count, AVG(event_count) OVER (ORDER BY event_date
            ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS rolling_30d_mean FROM {CLOSED})""",
    "rolling_30d_mean",
    "burst_score",
)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: moves around each event, snapped to the trading calendar."""
    return fix(QUERIES["event_impact"](study_of(spark, SMOKE_DIR)))


try:
    import tidemark.llm.queries as llm
except ModuleNotFoundError as missing:
    # without the training-text package, or a third-party package that only it needs, the other
    # queries work as before
    if (missing.name or "").startswith("tidemark") and not missing.name.startswith("tidemark.llm"):
        raise
    print(f"no training-text queries: {missing}", file=sys.stderr)
    llm = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build: Callable[[SampleStudy], DataFrame]):
        return lambda spark, sf_dir: fix(build(study_of(spark, sf_dir)))

    own = {name: runner(build) for name, build in QUERIES.items()}
    return own | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return ORACLES | (llm.oracle_sql() if llm else {})
