"""Readers, late casts, sinks and quality checks on small synthetic files."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import views  # noqa: F401
from tidemark.plans.registry import VIEWS, Study, build_order
from tidemark.sources import bronze, quality, readers, schemas, sinks, typed


def event_line(**values):
    row = dict.fromkeys(schemas.EVENT_COLUMNS, "")
    row.update(values)
    return "\t".join(row[c] for c in schemas.EVENT_COLUMNS)


def article_line(**values):
    row = dict.fromkeys(schemas.ARTICLE_COLUMNS, "")
    row.update(values)
    return "\t".join(row[c] for c in schemas.ARTICLE_COLUMNS)


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    day = root / "gdelt" / "date=2026-03-02"
    day.mkdir(parents=True)
    common = dict(actiongeo_countrycode="IR", quadclass="4", eventrootcode="019")
    (day / "20260302000000.export.CSV").write_text(
        "\n".join(
            [
                event_line(globaleventid="1", day="20260302", avgtone="-2.5", nummentions="12.7", **common),
                event_line(globaleventid="2", day="20260302", avgtone="", nummentions="3", **common),
                event_line(globaleventid="3", day="20260132", avgtone="x", nummentions="3", **common),
                event_line(globaleventid="4", day="20260301", avgtone="1", nummentions="0",
                           actiongeo_fullname='stray " quote', sourceurl="u", **common),
                event_line(globaleventid="5", day="20250101", avgtone="1", nummentions="1", **common),
            ]
        )
        + "\n"
    )
    late = root / "gdelt" / "date=2026-03-03"
    late.mkdir()
    (late / "20260303000000.export.CSV").write_text(
        event_line(globaleventid="6", day="20260302", avgtone="4", nummentions="7", **common) + "\n"
        + "7\t20260303\n"
    )
    articles = root / "gdelt_gkg" / "date=2026-03-02"
    articles.mkdir(parents=True)
    (articles / "20260302000000.gkg.csv").write_text(
        article_line(gkgrecordid="a", gkg_datestamp="20260302001500", v1themes="ECON_OILEXPORT;X",
                     v2tone="-1.5,2,3.5,5,20,0.5,100", v21gcam="wc:9,c2.21:4,c2.1:7,c2.21:9") + "\n"
        + article_line(gkgrecordid="b", gkg_datestamp="20260302003000", v1themes="TERROR",
                       v2tone="n/a,1,1,1,1", v21gcam="c2.21:-2.5") + "\n"
        + "short\trow\n"
    )
    (root / "timeline.csv").write_text(
        "event_date,label,description,source_url,phase\n"
        '2026-03-02,first,"one, two ""three""",http://x,de-escalation\n'
        "2026-03-07,weekend,d,http://y,\n"
    )
    (root / "brent.csv").write_text(
        "price_date,brent_close\n2026-03-02,100\n2026-03-03,110\n2026-03-05,0\n2026-03-09,99\n"
    )
    return root


def test_events_tsv_keeps_quotes_codes_and_short_rows(spark, landed):
    rows = {r.globaleventid: r for r in readers.events_tsv(spark, f"{landed}/gdelt").collect()}
    assert len(rows) == 7
    assert rows["4"].actiongeo_fullname == 'stray " quote' and rows["4"].sourceurl == "u"
    assert rows["1"].eventrootcode == "019"
    assert rows["7"].quadclass is None
    assert rows["6"].date == date(2026, 3, 3)


def test_late_casts_turn_bad_values_into_null(spark, landed):
    raw = readers.events_tsv(spark, f"{landed}/gdelt")
    rows = {r.event_id: r for r in typed.typed_events(raw).collect()}
    assert rows["1"].mentions == 13 and rows["1"].tone == -2.5
    assert rows["2"].tone is None and rows["3"].tone is None and rows["3"].event_date is None
    rejects = {r.field: r.rejected_rows for r in typed.cast_rejects(raw).collect()}
    assert rejects["day"] == 1 and rejects["avgtone"] == 1 and rejects["nummentions"] == 0


def test_articles_tsv_skips_and_counts_malformed_rows(spark, landed):
    articles = readers.articles_tsv(spark, f"{landed}/gdelt_gkg")
    assert articles.count() == 2
    assert sorted(r.gkgrecordid for r in articles.select("gkgrecordid").collect()) == ["a", "b"]
    rejects = readers.article_rejects(spark, f"{landed}/gdelt_gkg").first()
    assert (rejects.rejected_rows, rejects.read_rows) == (1, 3)


def test_headed_csv_reads_quoted_commas(spark, landed):
    frame = readers.headed_csv(spark, f"{landed}/timeline.csv", schemas.TIMELINE)
    row = frame.orderBy("event_date").first()
    assert row.description == 'one, two "three"' and row.event_date == date(2026, 3, 2)


def test_json_payload_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"startTime": "2026-03-02T00:00:00Z", "price": 5.0}]}')
    (tmp_path / "b.json").write_text('{"data": [{"startTime": "2026-03-02T00:30:00Z", "price": 0.0}]}')
    rows = readers.json_rows(spark, str(tmp_path), schemas.HALF_HOUR_PRICES)
    assert sorted(r.price for r in rows.collect()) == [0.0, 5.0]


def test_study_from_files_builds_what_it_can(spark, landed):
    study = Study.from_files(spark, str(landed))
    skipped = study.create_views()
    assert "v_ttf_daily" in skipped and "v_finbert_daily" in skipped
    assert "v_middle_east_events" in study.available()
    daily = {str(r.event_date): r for r in spark.sql("SELECT * FROM v_middle_east_events").collect()}
    # the bad day, the day outside the window and the short row are gone; the late row counts
    assert set(daily) == {"2026-03-01", "2026-03-02"}
    assert daily["2026-03-02"].event_count == 3 and daily["2026-03-02"].total_mentions == 23
    assert daily["2026-03-02"].avg_tone == pytest.approx(0.75)
    features = {str(r.event_date): r for r in study.get("v_gdelt_events_features_daily").collect()}
    # weights sum to 0 on the first day
    assert features["2026-03-01"].mentions_weighted_tone is None
    # the row without a tone keeps its weight in the denominator
    assert features["2026-03-02"].mentions_weighted_tone == pytest.approx((-2.5 * 13 + 4 * 7) / 23)
    asym = {str(r.event_date): r for r in study.get("v_gdelt_tone_asymmetry_daily").collect()}
    assert asym["2026-03-02"].negative_tone == pytest.approx(-2.5 / 3)
    themes = study.get("v_gdelt_gkg_themes_daily").first()
    # a token also counts inside a longer one
    assert (themes.n_econ_oil, themes.n_econ_oilexport, themes.n_oil_total) == (1, 1, 1)
    tone = study.get("v_gkg_tone_daily").first()
    assert tone.n_articles == 2 and tone.mean_tone == -1.5 and tone.mean_self_reference == 0.5
    scores = study.get("v_gdelt_gkg_gcam_daily").first()
    # c2.21 does not feed c2.1, and its first hit counts
    assert scores.mean_liwc_anger == 7.0 and scores.mean_liwc_anxiety == pytest.approx((4 - 2.5) / 2)
    # no row has a place list or coordinates: empty fields are NULL, and the sweep says so
    empty = {r.object for r in study.sweep().filter("is_empty").collect()}
    assert empty == {"v_event_geo", "v_gdelt_gkg_hormuz_daily"}
    assert ("v_brent_daily", "brent_close", "double") in study.columns()


def test_build_order_respects_requirements():
    order = build_order()
    assert len(order) == 24
    for name in order:
        for required in VIEWS[name].requires:
            if required in VIEWS:
                assert order.index(required) < order.index(name)


def test_ingest_filter_drops_short_and_unmatched_lines(spark):
    lines = ["\t".join(["f"] * 7 + [themes]) for themes in ("A;TERROR", "B", "XTERRORX")]
    frame = spark.createDataFrame([(x,) for x in [*lines, "TERROR", ""]], "value string")
    kept = sinks.ingest_filter(frame, ["TERROR"]).collect()
    assert sorted(r.value for r in kept) == sorted([lines[0], lines[2]])


def test_partitioned_sink_replaces_only_its_days(spark, tmp_path):
    out = str(tmp_path / "bronze")
    stamps = spark.createDataFrame([("20260301000000", 1), ("20260302000000", 2)], "stamp string, v int")
    sinks.write_partitioned(stamps.withColumn("date", sinks.stamp_day("stamp")), out)
    again = spark.createDataFrame([("20260302001500", 3)], "stamp string, v int")
    sinks.write_partitioned(again.withColumn("date", sinks.stamp_day("stamp")), out)
    back = spark.read.parquet(out)
    assert sorted((str(r.date), r.v) for r in back.collect()) == [("2026-03-01", 1), ("2026-03-02", 3)]
    sinks.write_csv(back.drop("date"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2


def test_slot_grid_and_gaps(spark):
    grid = quality.slot_grid(spark, "2026-03-01 00:00:00", "2026-03-01 01:00:00", 15)
    assert [r.stamp for r in grid.orderBy("slot").collect()] == [
        "20260301000000", "20260301001500", "20260301003000", "20260301004500", "20260301010000",
    ]
    present = spark.createDataFrame(
        [(datetime(2026, 3, 1, 0, 20),), (datetime(2026, 3, 1, 0, 21),)], "ts timestamp_ntz"
    ).select(quality.slot_of("ts", 15).alias("slot"))
    assert quality.missing_slots(grid, present).count() == 4


def test_file_metrics_and_duplicate_keys(spark, landed):
    rows = readers.events_tsv(spark, f"{landed}/gdelt").withColumn("file", F.input_file_name())
    metrics = {str(r.date): (r.file_count, r.event_count) for r in quality.file_metrics(rows, "date", "file").collect()}
    assert metrics == {"2026-03-02": (1, 5), "2026-03-03": (1, 2)}
    double = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "series string, d int")
    assert quality.duplicate_keys(double, "series", "d").collect()[0].n_rows == 2


def test_landed_files_give_gaps_and_metrics(spark, landed):
    files = quality.landed_files(spark, f"{landed}/gdelt")
    assert {r.stamp for r in files.filter("size > 0").collect()} == {"20260302000000", "20260303000000"}
    grid = quality.slot_grid(spark, "2026-03-02 00:00:00", "2026-03-03 00:00:00", 360)
    wanted = quality.expected_files(grid)
    assert "date=2026-03-02/20260302060000.export.CSV" in {r.file for r in wanted.collect()}
    gaps = quality.missing_slots(wanted, files.filter("size > 0"), "stamp")
    assert sorted(r.stamp for r in gaps.collect()) == ["20260302060000", "20260302120000", "20260302180000"]
    metrics = quality.landed_metrics(files, readers.events_tsv(spark, f"{landed}/gdelt"), "date")
    assert {(str(r.date), r.file_count, r.event_count) for r in metrics.collect()} == {
        ("2026-03-02", 1, 5),
        ("2026-03-03", 1, 2),
    }


def test_columnar_copy_gives_the_same_views_and_prunes(spark, landed, tmp_path):
    events, articles = str(tmp_path / "events"), str(tmp_path / "articles")
    bronze.copy_events(spark, f"{landed}/gdelt", events)
    bronze.copy_articles(spark, f"{landed}/gdelt_gkg", articles, ("TERROR",))
    copied = Study(spark, {"gdelt": bronze.read_copy(spark, events), "gdelt_gkg": bronze.read_copy(spark, articles)})
    raw = Study.from_files(spark, str(landed))
    for name in ("v_middle_east_events", "v_gdelt_events_features_daily", "v_gdelt_tone_asymmetry_daily"):
        assert sorted(copied.get(name).collect()) == sorted(raw.get(name).collect())
    assert copied.get("v_gdelt_gkg_themes_daily").first().n_terror == 1
    assert copied.get("gdelt_gkg").count() == 1
    daily = copied.get("v_middle_east_events")
    plan = spark._jvm.PythonSQLUtils.explainString(daily._jdf.queryExecution(), "formatted")
    # late rows precede their partition day, so only the lower bound may prune partitions
    assert "PartitionFilters: [isnotnull(date" in plan and ">= 2026-01-01" in plan
    assert "In(country" in plan and "GreaterThanOrEqual(event_date,2026-01-01)" in plan
    assert "source_url" not in plan
