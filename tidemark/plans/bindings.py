"""Roles of the study tables, derived from the sample star-schema tables.

The sample tables carry no energy or news columns, so each role is computed from them: daily
series from orders and line items, event rows from the event stream, article rows and URLs
from whole documents. Every role reads its whole table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FUEL_CATEGORIES, MIX_CATEGORIES, StudyConfig
from tidemark.operators import series
from tidemark.operators.scoring import LexiconScorer
from tidemark.plans.registry import SERIES_VIEWS, Study
from tidemark.sources import schemas

FIRST_DAY, LAST_DAY = date(1995, 1, 1), date(2001, 12, 31)
COUNTRY_CODES = (
    "IR", "IS", "US", "SA", "AE", "QA", "IZ", "KU", "BA", "LE", "SY", "YM", "FR", "BR", "JP", "IN",
)
ROOT_CODES = ("13", "14", "17", "18", "19", "20", "04", "05")
CLASS_OF_TYPE = {"click": "1", "view": "2", "error": "3", "purchase": "4", "signup": "3"}
PHASE_OF_STATUS = {"F": "war-risk repricing", "O": "supply destruction", "P": "de-escalation"}
CATEGORY_OF_TYPE = {
    "ECONOMY": "gas",
    "SMALL": "gas",
    "PROMO": "renewables",
    "STANDARD": "nuclear",
    "MEDIUM": "biomass",
    "LARGE": "coal_oil",
}
COUNTRY_OF_LANG = {"en": "US", "fr": "IR", "de": "SA"}
# substring of the text and the list entry it stands for
THEME_OF_TEXT = {
    "the": "ECON_OIL",
    "der": "ECON_OILEXPORT",
    "les": "ENERGY_SECURITY",
    "que": "ENV_NATGAS",
    "con": "ENV_NUCLEARPOWER",
    "ion": "MARITIME_TRANSPORT",
    "ing": "MARITIME_INCIDENT",
    "est": "MILITARY_OPERATIONS",
    "und": "ARMEDCONFLICT",
    "ent": "TERROR",
    "th": "WB_2042_OIL_INDUSTRY",
}
PLACE_OF_TEXT = {
    "her": "4#Strait of Hormuz#IR",
    "ous": "4#Persian Gulf#IR",
    "ich": "4#Kharg Island#IR",
    "ado": "4#Ras Laffan#QA",
    "ble": "4#Bandar Abbas#IR",
}
# scales that bring the series to the size of energy prices, so thresholds split them
BRENT_SCALE, TTF_SCALE, POWER_SCALE = 2500.0, 950.0, 500.0
VALUE_OF = {
    "brent": "brent_close",
    "ttf": "ttf_close",
    "power": "gb_power_avg",
    "carbon": "uka_close_gbp_per_tco2",
}
# 18 minutes of the event stream are one study day: 30 days become 2,400
SECONDS_PER_DAY = 1080
NO_PLACES = date(1998, 3, 21)
PROVIDER, OTHER_PROVIDER = "APXMIDP", "N2EXMIDP"
FUELS = (*FUEL_CATEGORIES, "INTFR", "OTHER")
LEXICON = LexiconScorer(
    positive=("the", "les", "und", "ing"),
    negative=("der", "que", "con", "ent", "est"),
)
# for slugs of whole texts: these words beside the syllables of the short URLs
TEXT_LEXICON = LexiconScorer(
    positive=(*LEXICON.positive, "with", "that", "una"),
    negative=(*LEXICON.negative, "not", "this", "was", "worthless"),
)

SAMPLE_CONFIG = StudyConfig(
    window_start=FIRST_DAY,
    window_end=LAST_DAY,
    series_start=FIRST_DAY,
    series_end=LAST_DAY,
    carbon_base_date=date(1995, 1, 2),
    during_start=date(1997, 1, 1),
    during_end=date(1999, 12, 31),
)


def make_lexicon_scorer() -> LexiconScorer:
    return LEXICON


def make_text_scorer() -> LexiconScorer:
    return TEXT_LEXICON


def path_of(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, name))


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def mapped(col: str, mapping: dict[str, str]) -> Column:
    out = None
    for key, value in mapping.items():
        cond = F.col(col) == key
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def brent(orders: DataFrame) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (
        orders.filter(is_weekday(day))
        .groupBy(day.alias("price_date"))
        .agg((F.avg("o_totalprice") / BRENT_SCALE).alias("brent_close"))
    )


def linked_price() -> Column:
    # another column than the target's, so that the two series can part
    return F.col("l_tax") * TTF_SCALE


def net_price() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount")) / POWER_SCALE


def ttf(lineitem: DataFrame) -> DataFrame:
    day = F.to_date("l_shipdate")
    return (
        lineitem.filter(is_weekday(day))
        .groupBy(day.alias("price_date"))
        .agg(F.avg(linked_price()).alias("ttf_close"))
    )


def gb_power(lineitem: DataFrame) -> DataFrame:
    return series.daily_mean(lineitem, F.to_date("l_shipdate"), net_price(), "gb_power_avg")


def linked_and_target(lineitem: DataFrame) -> DataFrame:
    """Both line-item series from one scan and one aggregation."""
    rows = lineitem.select(
        F.to_date("l_shipdate").alias("price_date"),
        linked_price().alias("_linked"),
        net_price().alias("_net"),
    )
    weekday = is_weekday(F.col("price_date"))
    return rows.groupBy("price_date").agg(
        F.avg(F.when(weekday, F.col("_linked"))).alias("ttf_close"),
        F.avg(F.when(F.col("_net") > 0, F.col("_net"))).alias("gb_power_avg"),
    )


def gb_gen_mix(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    # the feed is unreadable on the 31st: such days have no shares. Both sides of the join grow
    # with the data: its strategy is left to Spark
    broken = F.dayofmonth("l_shipdate") == 31
    amount = F.when(broken, "n/a").otherwise(F.col("l_quantity").cast("string"))
    typed = lineitem.select("l_partkey", "l_shipdate", amount.alias("amount")).join(
        part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    return series.mix_shares(
        typed,
        F.to_date("l_shipdate"),
        series.category_of("p_type", CATEGORY_OF_TYPE),
        "amount",
        MIX_CATEGORIES,
    )


def uka_proxy(orders: DataFrame, cfg: StudyConfig) -> DataFrame:
    daily = (
        orders.filter(F.col("o_orderpriority") == "5-LOW")
        .groupBy(F.to_date("o_orderdate").alias("price_date"))
        .agg(F.avg("o_totalprice").alias("krbn_close"))
    )
    rebased = series.rebase(
        daily,
        "price_date",
        "krbn_close",
        cfg.carbon_base_price,
        cfg.carbon_base_date,
        "uka_proxy_gbp",
    )
    return rebased.withColumn("source", F.lit(cfg.carbon_source))


def anchor_and_carbon(orders: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Both order series from one scan and one aggregation."""
    day = F.col("price_date")
    low = F.col("o_orderpriority") == "5-LOW"
    daily = (
        orders.select(F.to_date("o_orderdate").alias("price_date"), "o_totalprice", "o_orderpriority")
        .groupBy("price_date")
        .agg(
            (F.avg(F.when(is_weekday(day), F.col("o_totalprice"))) / BRENT_SCALE).alias("brent_close"),
            F.avg(F.when(low, F.col("o_totalprice"))).alias("krbn_close"),
        )
    )
    rebased = series.rebase(
        daily,
        "price_date",
        "krbn_close",
        cfg.carbon_base_price,
        cfg.carbon_base_date,
        "uka_close_gbp_per_tco2",
    )
    return rebased.drop("krbn_close")


def timeline(orders: DataFrame) -> DataFrame:
    """Every urgent order of a month-end day is an event; several may fall on one day."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    urgent = orders.filter((day == F.last_day(day)) & (F.col("o_orderpriority") == "1-URGENT"))
    return urgent.select(
        day.alias("event_date"),
        F.concat(F.lit("order-"), key.cast("string")).alias("label"),
        # some events have no phase; a closed status with an odd key counts as de-escalation
        F.when(key % 5 == 0, None)
        .when((F.col("o_orderstatus") == "F") & (key % 2 == 1), PHASE_OF_STATUS["P"])
        .otherwise(mapped("o_orderstatus", PHASE_OF_STATUS))
        .alias("phase"),
    )


def month_ends(orders: DataFrame) -> DataFrame:
    """Every order of a month-end day is an event, urgent or not."""
    day = F.to_date("o_orderdate")
    return orders.filter(day == F.last_day(day)).select(day.alias("event_date"))


def order_days(orders: DataFrame) -> DataFrame:
    """Every order is an event; a day with several is listed once."""
    return orders.select(F.to_date("o_orderdate").alias("event_date")).distinct()


def study_day() -> Column:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return F.date_add(F.lit(FIRST_DAY), F.floor(seconds / SECONDS_PER_DAY).cast("int"))


def event_rows(events: DataFrame) -> DataFrame:
    # one flat number: a pattern reads it about four times as fast as a JSON parser
    k = F.regexp_extract("props", r'"k"\s*:\s*(-?\d+)', 1).try_cast("int")
    base = events.withColumn("_k", k)
    k = F.col("_k")
    return base.select(
        "event_id",
        "ts",
        study_day().alias("event_date"),
        pick(COUNTRY_CODES, F.col("user_id") % len(COUNTRY_CODES)).alias("country"),
        mapped("event_type", CLASS_OF_TYPE).alias("quad_class"),
        pick(ROOT_CODES, F.col("event_id") % len(ROOT_CODES)).alias("root_code"),
        (F.col("event_id") % 4 + 1).cast("string").alias("geo_type"),
        F.concat(F.lit("place-"), F.col("user_id").cast("string")).alias("place"),
        F.when(k != 5, 20 + F.col("user_id") % 30 + (F.col("event_id") % 7) * 0.013).alias("lat"),
        (40 + F.col("user_id") % 25 + (F.col("event_id") % 5) * 0.017).alias("lon"),
        F.when(k != 13, (F.col("value") - 50) / 10).alias("tone"),
        F.when(k != 77, (k - 50) / 5.0).alias("goldstein"),
        F.when(k != 99, k).alias("mentions"),
    )


def document_day() -> Column:
    """A third of the documents on four busy Mondays, three of one language, so that days
    stand out from the rest; the others spread over 120 days."""
    i = F.col("doc_id")
    busy = i % 3 == 0
    offset = (
        F.when(busy & (F.col("lang") == "en"), 4 + 7 * (F.floor(i / 3) % 3))
        .when(busy, 32)
        .otherwise(i % 120)
    )
    return F.date_add(F.lit(date(1998, 1, 1)), offset.cast("int"))


def even_day() -> Column:
    """All documents spread evenly over 120 days."""
    return F.date_add(F.lit(date(1998, 1, 1)), (F.col("doc_id") % 120).cast("int"))


def listed(text: Column, mapping: dict[str, str]) -> Column:
    """``;``-separated entries of every substring the text holds."""
    return F.concat_ws(";", *[F.when(text.contains(s), v) for s, v in mapping.items()])


def article_rows(documents: DataFrame) -> DataFrame:
    text, n, i = F.col("text"), F.col("n_chars"), F.col("doc_id")

    def number(whole: Column, tenth: Column) -> Column:
        return F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"))

    tone = F.when(F.col("source") == "src6", "n/a").otherwise(number(n % 21 - 10, i % 10))
    head = [tone, number(n % 11, i % 7), number(n % 13, i % 9), number(n % 23, i % 3)]
    head.append(number(n % 31, i % 5))
    tail = [number(n % 3, i % 4), n.cast("string")]
    short = F.concat_ws(",", *head)

    def score(key: str, whole: Column, when: Column | None = None) -> Column:
        pair = F.concat(F.lit(f"{key}:"), number(whole, i % 10))
        return pair if when is None else F.when(when, pair)

    return documents.select(
        F.col("doc_id").alias("article_id"),
        document_day().alias("event_date"),
        F.when(i % 100 != 3, listed(text, THEME_OF_TEXT)).alias("themes"),
        # one day has no place list at all
        F.when((i % 100 != 7) & (document_day() != F.lit(NO_PLACES)), listed(text, PLACE_OF_TEXT)).alias(
            "locations"
        ),
        F.when(F.col("source") == "src5", short)
        .otherwise(F.concat_ws(",", short, *tail))
        .alias("tone"),
        F.concat_ws(
            ",",
            F.concat(F.lit("wc:"), n.cast("string")),
            score("c2.21", n % 17),
            score("c2.1", n % 19, i % 5 != 0),
            score("c2.34", n % 9),
            score("c2.6", n % 8 - 4),
            score("c3.2", n % 15),
            score("c3.3", n % 14, i % 3 != 0),
            score("c2.21", n % 16),
            score("v10.1.1", n % 12 - 6),
            score("v10.1.5", n % 10),
        ).alias("scores"),
    )


def document_url() -> Column:
    """A short headline-like URL: the syllables the whole text holds, and its digest."""
    words = [F.when(F.col("text").contains(w), w) for w in THEME_OF_TEXT]
    headline = F.concat_ws("-", *words, F.md5("text"), F.lit("2024-01-05.html"))
    return F.concat(F.lit("https://e.com/"), F.col("source"), F.lit("/"), headline)


def text_url() -> Column:
    """A URL that holds every word of the whole text, and its digest."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{Alnum}+", "-")
    headline = F.concat_ws("-", words, F.md5("text"), F.lit("2024-01-05.html"))
    return F.concat(F.lit("https://e.com/"), F.coalesce("source", F.lit("")), F.lit("/"), headline)


def url_rows(
    documents: DataFrame, url: Column | None = None, day: Column | None = None
) -> DataFrame:
    return documents.select(
        (document_url() if url is None else url).alias("source_url"),
        (document_day() if day is None else day).alias("event_date"),
        F.coalesce(mapped("lang", COUNTRY_OF_LANG), F.lit("FR")).alias("country"),
        F.lit("4").alias("quad_class"),
        F.col("n_chars").cast("int").alias("mentions"),
    )


def earlier_scores(
    documents: DataFrame, labels: DataFrame, url: Column | None = None, day: Column | None = None
) -> DataFrame:
    """Scores of the labelled documents, as an earlier scoring run would have left them."""
    rows = documents.join(labels, "doc_id").select(
        (document_url() if url is None else url).alias("source_url"),
        (document_day() if day is None else day).alias("day"),
        F.col("n_chars").cast("int").alias("nummentions"),
        F.lit("labelled").alias("slug"),
        ((1 + F.col("quality") + (F.col("doc_id") % 7) / 10) / 4).alias("finbert_positive"),
        ((1 + F.col("toxic") + (F.col("doc_id") % 3) / 10) / 5).alias("finbert_negative"),
    )
    positive, negative = F.col("finbert_positive"), F.col("finbert_negative")
    return rows.select(
        "source_url",
        "day",
        "nummentions",
        "slug",
        "finbert_positive",
        (1 - positive - negative).alias("finbert_neutral"),
        "finbert_negative",
        (positive - negative).alias("finbert_signed"),
    )


def raw_lines(columns: tuple[str, ...], values: dict[str, Column], width: Column) -> Column:
    """The named fields as a tab-separated line, cut or filled up to ``width`` fields."""
    fields = [F.coalesce(values.get(c, F.lit("")).cast("string"), F.lit("")) for c in columns]
    return F.array_join(F.slice(F.array(*fields, F.lit("surplus")), F.lit(1), width), "\t")


def with_blanks(lines: DataFrame, blank: Column) -> DataFrame:
    """Some lines are followed by an empty one."""
    both = F.when(blank, F.array(F.col("value"), F.lit(""))).otherwise(F.array("value"))
    return lines.select("date", "slot", F.explode(both).alias("value"))


def event_lines(events: DataFrame) -> DataFrame:
    """The event rows as a raw 61-field drop: date and slot (six hours) of landing, and the line.

    Some lines are short, some have a field too many, some days and numbers are broken, some
    places hold a double quote, and some lines are blank.
    """
    i = F.col("event_id")
    number = F.col("mentions").cast("string")
    values = {
        "globaleventid": i,
        "day": F.when(i % 89 == 3, "20241345").otherwise(F.date_format("event_date", "yyyyMMdd")),
        "actiongeo_countrycode": F.col("country"),
        "quadclass": F.col("quad_class"),
        "eventrootcode": F.col("root_code"),
        "actiongeo_type": F.col("geo_type"),
        "actiongeo_fullname": F.when(i % 83 == 7, F.concat(F.lit('stray " '), F.col("place"))).otherwise(F.col("place")),
        "actiongeo_lat": F.col("lat"),
        "actiongeo_long": F.col("lon"),
        "avgtone": F.col("tone"),
        "goldsteinscale": F.col("goldstein"),
        "nummentions": F.when(i % 79 == 1, "many").when(i % 5 == 0, F.concat(number, F.lit(".4"))).otherwise(number),
    }
    full = len(schemas.EVENT_COLUMNS)
    width = F.when(i % 97 == 5, 30).when(i % 101 == 7, full + 1).otherwise(full)
    rows = event_rows(events)
    lines = rows.select(
        i,
        F.to_date("ts").alias("date"),
        slot_text(F.hour("ts")).alias("slot"),
        raw_lines(schemas.EVENT_COLUMNS, values, width).alias("value"),
    )
    return with_blanks(lines, i % 103 == 0)


def slot_text(hour: Column) -> Column:
    """The six-hour slot of an hour as ``HHMMSS``."""
    return F.concat(F.lpad((F.floor(hour / 6) * 6).cast("string"), 2, "0"), F.lit("0000"))


def article_lines(documents: DataFrame) -> DataFrame:
    """The article rows as a raw 27-field drop with two slots a day; some lines are broken."""
    i = F.col("article_id")
    rows = article_rows(documents)
    slot = F.when(i % 2 == 0, "000000").otherwise("120000")
    values = {
        "gkgrecordid": i,
        "gkg_datestamp": F.concat(F.date_format("event_date", "yyyyMMdd"), slot),
        "v1themes": F.col("themes"),
        "v2enhancedlocations": F.col("locations"),
        "v2tone": F.col("tone"),
        "v21gcam": F.col("scores"),
    }
    full = len(schemas.ARTICLE_COLUMNS)
    width = F.when(i % 41 == 3, 5).when(i % 43 == 5, 20).when(i % 47 == 7, full + 1).otherwise(full)
    lines = rows.select(
        i,
        F.col("event_date").alias("date"),
        slot.alias("slot"),
        raw_lines(schemas.ARTICLE_COLUMNS, values, width).alias("value"),
    )
    return with_blanks(lines, i % 53 == 0)


def half_hour() -> Column:
    return (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 48


def price_payloads(lineitem: DataFrame) -> DataFrame:
    """One payload a day: half-hour prices of two providers, 96 entries at most.

    The second provider reports nothing but zeros, one period a month is empty and one has an
    unreadable start.
    """
    day, period = F.to_date("l_shipdate"), half_hour()
    provider = F.when(F.col("l_suppkey") % 4 == 0, OTHER_PROVIDER).otherwise(PROVIDER)
    rows = lineitem.groupBy(day.alias("day"), provider.alias("provider"), period.alias("period")).agg(
        F.avg(net_price()).alias("price")
    )
    number = F.dayofmonth("day")
    minute = F.when(F.col("period") % 2 == 0, "00").otherwise("30")
    hour = F.lpad(F.floor(F.col("period") / 2).cast("string"), 2, "0")
    start = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T"), hour, F.lit(":"), minute, F.lit(":00Z"))
    empty = (F.col("provider") == OTHER_PROVIDER) | ((number == 5) & (F.col("period") == 47))
    entry = F.struct(
        F.when((number == 9) & (F.col("period") == 46), "n/a").otherwise(start).alias("startTime"),
        F.col("provider").alias("dataProvider"),
        F.when(empty, 0.0).otherwise(F.col("price")).alias("price"),
    )
    return rows.groupBy("day").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("value"))


def generation_payloads(lineitem: DataFrame) -> DataFrame:
    """One payload a day: half-hour generation by fuel as text, 528 entries at most.

    One fuel is unreadable on the 7th and missing on the 8th of a month.
    """
    rows = lineitem.groupBy(
        F.to_date("l_shipdate").alias("day"),
        pick(FUELS, F.col("l_partkey") % len(FUELS)).alias("fuel"),
        half_hour().alias("period"),
    ).agg(F.sum("l_quantity").alias("amount"))
    oil, number = F.col("fuel") == "OIL", F.dayofmonth("day")
    text = F.when(oil & (number == 7), "n/a").when(~(oil & (number == 8)), F.col("amount").cast("string"))
    entry = F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("settlementDate"),
        F.col("fuel").alias("fuelType"),
        text.alias("generation"),
    )
    return rows.groupBy("day").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("value"))


class SampleStudy(Study):
    """A study over the sample tables in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: StudyConfig = SAMPLE_CONFIG):
        table = self.raw
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}
        super().__init__(
            spark,
            {
                "timeline": lambda: timeline(table("orders")),
                "brent": lambda: brent(table("orders")),
                "ttf": lambda: ttf(table("lineitem")),
                "gb_power": lambda: gb_power(table("lineitem")),
                "gb_gen_mix": lambda: gb_gen_mix(table("lineitem"), table("part")),
                "uka_proxy": lambda: uka_proxy(table("orders"), cfg),
                "gdelt": lambda: event_rows(table("events")).drop("ts"),
                "gdelt_gkg": lambda: article_rows(table("documents")),
                "finbert_scores": lambda: earlier_scores(table("documents"), table("labels")),
            },
            cfg,
        )

    def raw(self, name: str) -> DataFrame:
        """A sample table as it is."""
        if name not in self._raw:
            self._raw[name] = read(self.spark, self.sf_dir, name)
        return self._raw[name]

    def panel(self, *names: str) -> DataFrame:
        """Aligned series; two series of one table share its scan when both are wanted."""
        pairs = {
            ("ttf", "power"): lambda: linked_and_target(self.raw("lineitem")),
            ("brent", "carbon"): lambda: anchor_and_carbon(self.raw("orders"), self.cfg),
        }
        frames, fused = {}, {}
        for pair, build in pairs.items():
            if set(pair) <= set(names):
                frames["_".join(pair)] = build()
                fused.update({name: "_".join(pair) for name in pair})
        for name in names:
            if name not in fused:
                frames[name] = self.get(SERIES_VIEWS[name])
        aligned = series.align(frames, "price_date")
        for name in fused:
            aligned = aligned.withColumn(f"has_{name}", F.col(VALUE_OF[name]).isNotNull())
        return aligned.drop(*[f"has_{frame}" for frame in set(fused.values())])
