"""Raw drops, resumable loads, daily states, payloads, and streams over restarts."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.config import FUEL_CATEGORIES, MIX_CATEGORIES, StudyConfig
from tidemark.operators import correlation, numbering, ranking, scoring, series
from tidemark.plans import gold
from tidemark.plans.bindings import make_lexicon_scorer
from tidemark.sources import bronze, landing, quality, readers, schemas, typed
from tidemark.sources.units import UnitTable
from tidemark.streaming import jobs


def line(columns, n=None, **values):
    row = dict.fromkeys(columns, "") | values
    fields = [row[c] for c in columns]
    return "\t".join(fields[:n] if n and n <= len(fields) else fields + ["x"] * ((n or 0) - len(fields)))


def drop(root, day, slot, lines):
    folder = root / f"date={day}" / f"slot={slot}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.txt").write_text("\n".join(lines) + "\n")


def article(i, n=None, themes="TERROR"):
    return line(schemas.ARTICLE_COLUMNS, n, gkgrecordid=str(i), gkg_datestamp="20260302001500", v1themes=themes)


def test_one_parse_accepts_and_rejects(spark, tmp_path):
    events = [
        line(schemas.EVENT_COLUMNS, globaleventid="1", day="20260302", avgtone="-1.5", actiongeo_fullname='a "b'),
        line(schemas.EVENT_COLUMNS, 30, globaleventid="2", day="20260399"),
        line(schemas.EVENT_COLUMNS, 64, globaleventid="3", day="20260302", nummentions="12.7", sourceurl="u") + "\r",
        "",
        "   ",
    ]
    drop(tmp_path / "e", "2026-03-02", "000000", events)
    rows = landing.parsed(landing.lines(spark, str(tmp_path / "e")), landing.EVENT_LINES).cache()
    got = {r.globaleventid: r for r in rows.filter("problem IS NULL").collect()}
    assert set(got) == {"1", "2", "3"} and rows.count() == 5
    assert got["1"].actiongeo_fullname == 'a "b' and got["1"].slot == "000000"
    assert got["2"].sourceurl is None and got["3"].sourceurl == "u" and got["3"].n_fields == 64
    assert [r.problem for r in rows.filter("problem IS NOT NULL").collect()] == ["blank", "blank"]
    cast = {r.event_id: r for r in typed.typed_events(rows, keep=["problem"]).collect() if r.event_id}
    assert cast["2"].event_date is None and cast["3"].mentions == 13 and cast["1"].tone == -1.5
    drop(tmp_path / "a", "2026-03-02", "000000", [article(1), article(2, 5), article(3, 29), ""])
    parsed = landing.parsed(landing.lines(spark, str(tmp_path / "a")), landing.ARTICLE_LINES)
    assert sorted(str(r.problem) for r in parsed.collect()) == ["None", "blank", "long", "short"]


def test_a_dead_run_is_resumed_and_nothing_doubles(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "landed", str(tmp_path / "out")
    drop(root, "2026-03-02", "000000", [article(1), article(2, themes="OTHER"), article(3, 20)])
    table = UnitTable(spark, out, landing.ARTICLE_ROWS)
    prepare = landing.article_rows(["TERROR"])
    assert landing.ingest(spark, str(root), table, prepare) == 1
    drop(root, "2026-03-02", "001500", [article(4), article(5)])
    drop(root, "2026-03-02", "003000", [article(6, themes="OTHER")])  # nothing stays of this slot

    put = UnitTable.put

    def dies(self, rows):
        put(self, rows.limit(1))
        raise RuntimeError("lost")

    monkeypatch.setattr(UnitTable, "put", dies)
    with pytest.raises(RuntimeError):
        landing.ingest(spark, str(root), table, prepare)
    monkeypatch.undo()
    assert table.rows().count() == 2  # what the dead run wrote does not count
    assert landing.ingest(spark, str(root), table, prepare) == 2
    assert landing.ingest(spark, str(root), table, prepare) == 0
    rows = table.rows().collect()
    assert sorted((r.article_id or "", r.problem or "") for r in rows) == [("", "short"), ("1", ""), ("4", ""), ("5", "")]
    assert next(r for r in rows if r.problem).line.split("\t")[0] == "3"
    assert {(r.unit, r.n_rows) for r in table.log().collect()} == {
        ("20260302000000", 2), ("20260302001500", 2), ("20260302003000", 0),
    }
    grid = quality.slot_grid(spark, "2026-03-02 00:00:00", "2026-03-02 01:00:00", 15)
    assert sorted(r.stamp for r in landing.gaps(grid, table).collect()) == ["20260302004500", "20260302010000"]


def test_scores_are_appended_once(spark, tmp_path):
    urls = spark.createDataFrame(
        [("u1", date(2026, 3, 1), 3, "the and"), ("u2", date(2026, 3, 1), 1, "der")],
        "source_url string, day date, nummentions int, slug string",
    )
    table = scoring.score_table(spark, str(tmp_path / "scores"), urls.schema)
    assert scoring.append_scores(urls.limit(1), table, "a", make_lexicon_scorer) == 1
    assert scoring.append_scores(urls, table, "b", make_lexicon_scorer) == 1
    assert scoring.append_scores(urls, table, "b", make_lexicon_scorer) == 0
    assert scoring.append_scores(urls, table, "c", make_lexicon_scorer) == 0
    assert sorted((r.source_url, r.unit) for r in table.rows().collect()) in (
        [("u1", "a"), ("u2", "b")],
        [("u1", "b"), ("u2", "a")],
    )


EVENT = (
    "event_id long, event_date date, country string, quad_class string, root_code string, "
    "tone double, goldstein double, mentions int"
)


def test_only_changed_days_are_refreshed(spark, tmp_path):
    raw, path, cfg = str(tmp_path / "raw"), str(tmp_path / "gold"), StudyConfig()

    def land(rows):
        frame = spark.createDataFrame(rows, f"{EVENT}, date date")
        frame.write.mode("append").partitionBy("date").parquet(raw)

    def go():
        return gold.refresh(spark, raw, path, EVENT, lambda r: gold.event_states(r, cfg))

    d1, d2, d3 = date(2026, 3, 1), date(2026, 3, 2), date(2026, 3, 3)
    land([(1, d1, "IR", "4", "19", -2.0, 1.0, 3, d1), (2, d1, "IR", "4", "19", None, None, None, d1)])
    land([(3, d2, "IR", "3", "13", 4.0, 2.0, 1, d2), (4, d2, "FR", "4", "19", 9.0, 9.0, 9, d2)])
    assert go() == 2 and go() == 0
    land([(5, d1, "IR", "4", "19", 1.0, 3.0, 2, d3)])  # late: its day is that of others
    assert go() == 1
    versions = gold.known_prints(spark, path).groupBy("date").count().collect()
    assert {r["count"] for r in versions} == {1}
    views = gold.event_views(gold.read_states(spark, path), cfg)
    days = {r.event_date: r for r in views["v_gdelt_events_features_daily"].collect()}
    assert set(days) == {d1, d2} and days[d1].event_count == 3 and days[d2].event_count == 1
    assert days[d1].mean_tone == -0.5 and days[d1].mentions_weighted_tone == pytest.approx(-4 / 5)
    asym = {r.event_date: r for r in views["v_gdelt_tone_asymmetry_daily"].collect()}
    assert asym[d1].negative_tone == pytest.approx(-2 / 3) and asym[d1].positive_tone == pytest.approx(1 / 3)


def test_half_hour_payloads(spark, tmp_path):
    prices = [
        {"startTime": "2026-03-02T23:30:00Z", "dataProvider": "A", "price": 6.0},
        {"startTime": "2026-03-02T00:00:00Z", "dataProvider": "A", "price": 0.0},
        {"startTime": "2026-03-02T00:30:00Z", "dataProvider": "B", "price": 90.0},
        {"startTime": "soon", "dataProvider": "A", "price": 90.0},
        {"startTime": "2026-03-02T01:00:00Z", "dataProvider": "A", "price": 8.0},
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps({"data": prices}, indent=1))
    rows = readers.half_hour_prices(spark, str(tmp_path / "p"), "A")
    assert [tuple(r) for r in series.half_hour_mean(rows, "avg").collect()] == [(date(2026, 3, 2), 7.0)]
    fuels = [("CCGT", "30.5"), ("OCGT", "9.5"), ("WIND", "40"), ("INTFR", "500"), ("COAL", "n/a"), ("PS", None), ("NUCLEAR", "20")]
    data = [{"settlementDate": "2026-03-02", "fuelType": f, "generation": g} for f, g in fuels]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "lines.json").write_text("\n".join(json.dumps({"data": [d]}) for d in data))
    rows = readers.half_hour_generation(spark, str(tmp_path / "g"), True)
    mix = series.half_hour_shares(rows, FUEL_CATEGORIES, MIX_CATEGORIES).first()
    assert (mix.total_mwh, mix.gas_share_pct, mix.renewables_share_pct, mix.coal_oil_share_pct) == (100, 40, 40, 0)


def test_numbers_without_one_task(spark):
    frame = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"), F.lit("x").alias("_place")).repartition(7)
    got = numbering.numbered(frame, ["v"], "n")
    assert got.columns == ["v", "_place", "n"]
    assert all(r.n == r.v + 1 for r in got.collect()) and got.count() == 1000
    assert numbering.numbered(frame.limit(0), ["v"]).count() == 0


def test_top_k_keeps_heaps(spark):
    frame = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    top = ranking.top_k(frame, [F.col("v").desc()], 4, "id")
    assert [r.id for r in top.collect()] == [6, 13, 20, 27]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_split_ranks_of_groups_without_a_label(spark):
    rows = [(None if i % 3 else "g", float(i * 7 % 11), float(i * 5 % 13)) for i in range(60)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    whole = correlation.both_methods(frame, [("x", "y")], ["g"]).collect()
    split = correlation.both_methods(frame, [("x", "y")], ["g"], buckets=4).collect()
    one, two = ({r.g: (r.n, r.pearson, r.spearman) for r in x} for x in (whole, split))
    assert set(one) == {None, "g"} and set(one) == set(two)
    for g in one:
        assert one[g] == pytest.approx(two[g])


def test_external_table_finds_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, date(2026, 3, 1)), (2, date(2026, 3, 2))], "v int, date date")
    frame.write.partitionBy("date").parquet(path)
    bronze.register(spark, "tidemark_test_table", path, frame.schema, "date")
    assert spark.sql("SHOW PARTITIONS tidemark_test_table").count() == 2
    assert spark.table("tidemark_test_table").filter("date = '2026-03-02'").first().v == 2
    spark.sql("DROP TABLE tidemark_test_table")
    assert spark.read.parquet(path).count() == 2


def test_days_stay_open_over_restarts(spark, tmp_path):
    schema = "event_id long, ts timestamp, tone double, mentions int"
    at = datetime
    waves = [
        [(1, at(2026, 3, 1, 1), 2.0, 1), (2, at(2026, 3, 2, 1), None, 5)],
        [(3, at(2026, 3, 1, 23), 4.0, 1), (4, at(2026, 3, 3, 12), 1.0, 2)],  # out of order
        [(5, at(2026, 3, 5, 1), 1.0, None)],
    ]
    frames = [spark.createDataFrame(w, schema) for w in waves]
    files, out, mark = (str(tmp_path / n) for n in ("files", "out", "mark"))

    def run():
        return jobs.upsert_days(jobs.file_stream(spark, files, frames[0].schema), out, mark)

    got = {r.event_date.day: r for r in jobs.in_waves(frames, files, run).collect()}
    assert {d: (r.event_count, r.total_mentions, r.open) for d, r in got.items()} == {
        1: (2, 2, False), 2: (1, 5, False), 3: (1, 2, False), 5: (1, None, True),
    }
    assert got[1].avg_tone == 3.0 and got[2].avg_tone is None and got[1].n_versions == 2
