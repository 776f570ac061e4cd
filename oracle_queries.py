"""ANSI-style SQL for each registered query, run by DuckDB on the same tables.

The statements are written from the definition of each result, mostly along another path
than the Spark code takes: as-of joins instead of a day grid, recomputed subsets instead of
closed forms, ordered windows instead of histograms.
"""

from __future__ import annotations

import re

from tidemark.plans import bindings as b


def rnd(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def case_of(col: str, mapping: dict[str, str], other: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {other} END"


def listed(text: str, mapping: dict[str, str]) -> str:
    arms = ", ".join(f"CASE WHEN contains({text}, '{k}') THEN '{v}' END" for k, v in mapping.items())
    return f"concat_ws(';', {arms})"


def array_of(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def num(whole: str, tenth: str) -> str:
    return f"CAST({whole} AS VARCHAR) || '.' || CAST({tenth} AS VARCHAR)"


CFG = b.SAMPLE_CONFIG
PARTS = "'IR','IS','US','SA','AE','QA','IZ','KU','BA','LE','SY','YM'"
MOVES = ("brent_pct_3d", "ttf_pct_3d", "power_pct_3d")
LOO_PAIRS = (
    ("brent_pct_3d", "ttf_pct_3d"),
    ("ttf_pct_3d", "power_pct_3d"),
    ("brent_pct_3d", "power_pct_3d"),
    ("avg_tone", "brent_pct_3d"),
    ("avg_tone", "ttf_pct_3d"),
    ("avg_tone", "power_pct_3d"),
    ("avg_goldstein", "power_pct_3d"),
    ("event_count", "ttf_pct_3d"),
)
WORDS = ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in b.THEME_OF_TEXT)
DOC_URL = (
    f"'https://e.com/' || source || '/' || concat_ws('-', {WORDS}, md5(text), '2024-01-05.html')"
)
# every word of the text, and its digest
TEXT_URL = (
    "'https://e.com/' || coalesce(source, '') || '/' || concat_ws('-',"
    " regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '-', 'g'), md5(text), '2024-01-05.html')"
)
DOC_DAY = """DATE '1998-01-01' + CAST(CASE WHEN doc_id % 3 = 0 AND lang = 'en'
    THEN 4 + 7 * ((doc_id // 3) % 3) WHEN doc_id % 3 = 0 THEN 32 ELSE doc_id % 120 END AS INT)"""
EVEN_DAY = "DATE '1998-01-01' + CAST(doc_id % 120 AS INT)"


def slug_sql(url: str) -> str:
    """For URLs without escapes or path parameters."""
    last = f"coalesce(regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '')"
    last = f"list_last([x FOR x IN string_split({last}, '/') IF x <> ''])"
    last = f"regexp_replace(coalesce({last}, ''), '\\.(html?|php|aspx)$', '', 'i')"
    last = f"regexp_replace({last}, '[-_]+', ' ', 'g')"
    last = (
        f"regexp_replace({last}, '\\b(20\\d{{2}}|0?[1-9]|1[0-2]|[12]\\d|3[01])\\b', ' ', 'g')"
    )
    return f"trim(regexp_replace({last}, '\\s+', ' ', 'g'))"


def words_share(words, col: str = "slug_words") -> str:
    inside = ", ".join(f"'{w}'" for w in sorted(words))
    return f"len([x FOR x IN {col} IF x IN ({inside})]) / len({col})"


def earlier_scores(url: str, day: str = DOC_DAY) -> str:
    return f"""SELECT source_url, day, nummentions, 'labelled' AS slug, pos AS finbert_positive,
            1 - pos - neg AS finbert_neutral, neg AS finbert_negative, pos - neg AS finbert_signed
        FROM (SELECT {url} AS source_url, {day} AS day, CAST(n_chars AS INT) AS nummentions,
            (1 + quality + (doc_id % 7) / 10) / 4 AS pos, (1 + toxic + (doc_id % 3) / 10) / 5 AS neg
            FROM documents JOIN labels USING (doc_id))"""


def text_url_days(day: str) -> str:
    return f"""SELECT {TEXT_URL} AS source_url, {day} AS day,
            CAST(MAX(n_chars) AS INT) AS nummentions
        FROM documents WHERE {case_of("lang", b.COUNTRY_OF_LANG, "'FR'")} IN ({PARTS}) GROUP BY 1, 2"""


def text_window_urls(url_days: str, orders: str = "CAST(o_orderdate AS DATE) = last_day(o_orderdate)") -> str:
    return f"""SELECT *, {slug_sql("source_url")} AS slug FROM (
            SELECT source_url, day, nummentions FROM {url_days}
            WHERE EXISTS (SELECT 1 FROM orders WHERE {orders}
                AND ABS(date_diff('day', CAST(o_orderdate AS DATE), day)) <= 7)
            QUALIFY ROW_NUMBER() OVER (PARTITION BY day
                ORDER BY nummentions DESC NULLS LAST, source_url) <= {b.SAMPLE_CONFIG.top_urls_per_day})"""


N, I = "n_chars", "doc_id"
TONE_HEAD = " || ',' || ".join(
    [
        f"(CASE WHEN source = 'src6' THEN 'n/a' ELSE {num(f'{N} % 21 - 10', f'{I} % 10')} END)",
        f"({num(f'{N} % 11', f'{I} % 7')})",
        f"({num(f'{N} % 13', f'{I} % 9')})",
        f"({num(f'{N} % 23', f'{I} % 3')})",
        f"({num(f'{N} % 31', f'{I} % 5')})",
    ]
)


def keyed(key: str, whole: str, when: str | None = None) -> str:
    pair = f"'{key}:' || {num(whole, f'{I} % 10')}"
    return pair if when is None else f"CASE WHEN {when} THEN {pair} END"


SCORES = ", ".join(
    [
        f"'wc:' || CAST({N} AS VARCHAR)",
        keyed("c2.21", f"{N} % 17"),
        keyed("c2.1", f"{N} % 19", f"{I} % 5 <> 0"),
        keyed("c2.34", f"{N} % 9"),
        keyed("c2.6", f"{N} % 8 - 4"),
        keyed("c3.2", f"{N} % 15"),
        keyed("c3.3", f"{N} % 14", f"{I} % 3 <> 0"),
        keyed("c2.21", f"{N} % 16"),
        keyed("v10.1.1", f"{N} % 12 - 6"),
        keyed("v10.1.5", f"{N} % 10"),
    ]
)


def shares() -> str:
    sums = ", ".join(
        f"SUM(CASE WHEN c = '{c}' AND day(l_shipdate) <> 31 THEN l_quantity ELSE 0 END) AS {c}"
        for c in b.MIX_CATEGORIES
    )
    total = " + ".join(b.MIX_CATEGORIES)
    cols = ", ".join(
        f"round_even({c} / NULLIF(total_mwh, 0) * 100, 1) AS {c}_share_pct"
        for c in b.MIX_CATEGORIES
    )
    return f"""SELECT price_date, total_mwh, {cols} FROM (
        SELECT *, round_even({total}, 0) AS total_mwh FROM (
            SELECT CAST(l_shipdate AS DATE) AS price_date, {sums}
            FROM (SELECT l_shipdate, l_quantity,
                         {case_of("p_type", b.CATEGORY_OF_TYPE, "'other'")} AS c
                  FROM lineitem JOIN part ON l_partkey = p_partkey)
            GROUP BY 1))"""


def pct(end: str, start: str) -> str:
    return f"100.0 * ({end} - {start}) / NULLIF({start}, 0)"


def horizon_columns(digits: int | None = 1, horizons=(1, 3, 5, 10)) -> str:
    out = []
    for name in ("brent", "ttf", "power"):
        for k in horizons:
            value = f"MAX(CASE WHEN k = {k} THEN {name} END)"
            base = f"MAX(CASE WHEN k = 0 THEN {name} END)"
            move = pct(value, base)
            out.append(f"{move if digits is None else rnd(move, digits)} AS {name}_pct_{k}d")
    return ", ".join(out)


def in_any(col: str, names, tokens) -> str:
    return " OR ".join(f"contains({col}, '{tokens[n]}')" for n in names)


def token_counts(col: str, tokens, composites) -> str:
    out = [f"COUNT(*) FILTER (WHERE contains({col}, '{t}')) AS {n}" for n, t in tokens.items()]
    out += [
        f"COUNT(*) FILTER (WHERE {in_any(col, names, tokens)}) AS {n}"
        for n, names in composites.items()
    ]
    return ", ".join(out)


def score_means() -> str:
    out = [f"AVG({n}) AS mean_{n}" for n in CFG.score_keys]
    out += [f"STDDEV_SAMP({n}) AS dispersion_{n}" for n in CFG.score_dispersions]
    return ", ".join(out)


def score_parse() -> str:
    return ", ".join(
        f"TRY_CAST(regexp_extract(scores, '{re.escape(k)}:(-?[\\d.]+)', 1) AS DOUBLE) AS {n}"
        for n, k in CFG.score_keys.items()
    )


def tone_parse() -> str:
    return ", ".join(
        f"TRY_CAST(split_part(tone, ',', {i}) AS DOUBLE) AS {n}" for n, i in b_parts().items()
    )


def b_parts() -> dict[str, int]:
    from tidemark.config import TONE_PARTS

    return TONE_PARTS


def trailing(frame: str, columns: str) -> str:
    """A daily frame with the series of its days and their trailing 3-row moves."""
    moves = ", ".join(
        f"({c} / NULLIF(LAG({c}, 3) OVER (ORDER BY event_date), 0) - 1) * 100 AS {n}_pct_3d"
        for n, c in (("brent", "brent_close"), ("ttf", "ttf_close"), ("power", "gb_power_avg"))
    )
    return f"""SELECT {columns}, {moves} FROM (
        SELECT f.*, brent_close, ttf_close, gb_power_avg FROM {frame} f
        LEFT JOIN brent ON brent.price_date = f.event_date
        LEFT JOIN ttf ON ttf.price_date = f.event_date
        LEFT JOIN gb_power ON gb_power.price_date = f.event_date)"""


def pearson(x: str, y: str) -> str:
    """NULL instead of NaN where one side has no spread."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (
        f"CASE WHEN STDDEV_POP(CASE WHEN {both} THEN {x} END) > 0"
        f" AND STDDEV_POP(CASE WHEN {both} THEN {y} END) > 0 THEN CORR({y}, {x}) END"
    )


def long_pairs(frame: str, pairs, keep: str = "") -> str:
    keep = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{x}' AS x, '{y}' AS y, CAST({x} AS DOUBLE) AS vx, CAST({y} AS DOUBLE) AS vy"
        f" FROM {frame} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for x, y in pairs
    )


def spearman_of_long(rows: str, group: str) -> str:
    def avg_rank(v: str) -> str:
        return (
            f"RANK() OVER (PARTITION BY {group} ORDER BY {v})"
            f" + (COUNT(*) OVER (PARTITION BY {group}, {v}) - 1) / 2.0"
        )

    ranked = f"SELECT {group}, {avg_rank('vx')} AS ra, {avg_rank('vy')} AS rb FROM ({rows})"
    return f"SELECT {group}, COUNT(*) AS n, {pearson('ra', 'rb')} AS r FROM ({ranked}) GROUP BY {group}"


def pearson_of_long(rows: str, group: str) -> str:
    return f"SELECT {group}, COUNT(*) AS n, {pearson('vx', 'vy')} AS r FROM ({rows}) GROUP BY {group}"


def both_of_long(rows: str, group: str) -> str:
    keys = [g.strip() for g in group.split(",")]
    return f"""SELECT {", ".join("p." + k for k in keys)}, p.n, p.r AS pearson, s.r AS spearman,
               p.r * p.r AS r_squared
        FROM ({pearson_of_long(rows, group)}) p JOIN ({spearman_of_long(rows, group)}) s
        USING ({group})"""


def matrix_pairs(cols) -> list[tuple[str, str]]:
    return [(x, y) for x in cols for y in cols]


def md5_number(*parts: str) -> str:
    text = " || '-' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


# ---- named building blocks, put in front of a query as needed ----

CTES: dict[str, str] = {
    "brent": f"""SELECT CAST(o_orderdate AS DATE) AS price_date,
            AVG(o_totalprice) / {b.BRENT_SCALE} AS brent_close
        FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1""",
    "ttf": f"""SELECT CAST(l_shipdate AS DATE) AS price_date,
            AVG(l_tax * {b.TTF_SCALE}) AS ttf_close
        FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1""",
    "gb_power": f"""SELECT CAST(l_shipdate AS DATE) AS price_date,
            AVG(l_extendedprice * (1 - l_discount) / {b.POWER_SCALE}) AS gb_power_avg
        FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 0 GROUP BY 1""",
    "gb_gen_mix": shares(),
    "carbon_raw": """SELECT CAST(o_orderdate AS DATE) AS price_date, AVG(o_totalprice) AS krbn_close
        FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1""",
    "uka_proxy": f"""SELECT price_date, krbn_close,
            {rnd("72.0 * (krbn_close / base)", 3)} AS uka_proxy_gbp, 'KRBN' AS source
        FROM carbon_raw CROSS JOIN (SELECT krbn_close AS base FROM carbon_raw
            WHERE price_date >= DATE '1995-01-02' ORDER BY price_date LIMIT 1)""",
    "timeline": f"""SELECT CAST(o_orderdate AS DATE) AS event_date,
            'order-' || CAST(o_orderkey AS VARCHAR) AS label,
            CASE WHEN o_orderkey % 5 = 0 THEN NULL
                WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 1 THEN 'de-escalation'
                ELSE {case_of("o_orderstatus", b.PHASE_OF_STATUS)} END AS phase
        FROM orders WHERE CAST(o_orderdate AS DATE) = last_day(o_orderdate)
            AND o_orderpriority = '1-URGENT'""",
    "gdelt_k": """SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "gdelt": f"""SELECT event_id, ts,
            DATE '1995-01-01'
                + CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) // {b.SECONDS_PER_DAY} AS INT)
                AS event_date,
            {array_of(b.COUNTRY_CODES)}[user_id % 16 + 1] AS country,
            {case_of("event_type", b.CLASS_OF_TYPE)} AS quad_class,
            {array_of(b.ROOT_CODES)}[event_id % 8 + 1] AS root_code,
            CAST(event_id % 4 + 1 AS VARCHAR) AS geo_type,
            'place-' || CAST(user_id AS VARCHAR) AS place,
            CASE WHEN k <> 5 THEN 20 + user_id % 30 + CAST(event_id % 7 AS DOUBLE) * 0.013::DOUBLE END AS lat,
            40 + user_id % 25 + CAST(event_id % 5 AS DOUBLE) * 0.017::DOUBLE AS lon,
            CASE WHEN k <> 13 THEN (value - 50) / 10 END AS tone,
            CASE WHEN k <> 77 THEN (k - 50) / 5.0::DOUBLE END AS goldstein,
            CASE WHEN k <> 99 THEN k END AS mentions
        FROM gdelt_k""",
    "conflict": f"""SELECT * FROM gdelt WHERE country IN ({PARTS}) AND quad_class IN ('3','4')
        AND event_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""",
    "news": """SELECT event_date, COUNT(*) AS event_count, AVG(tone) AS avg_tone,
            AVG(goldstein) AS avg_goldstein, CAST(SUM(mentions) AS BIGINT) AS total_mentions
        FROM conflict GROUP BY 1""",
    "geo": """SELECT place, country AS fips_country, ROUND(lat, 1) AS lat, ROUND(lon, 1) AS lon,
            COUNT(*) AS event_count, AVG(tone) AS avg_tone,
            CAST(SUM(mentions) AS BIGINT) AS total_mentions
        FROM gdelt WHERE quad_class IN ('3','4') AND geo_type IN ('3','4')
            AND lat IS NOT NULL AND lon IS NOT NULL
        GROUP BY 1, 2, 3, 4""",
    "combined": """SELECT brent.price_date AS d, brent_close, ttf_close, gb_power_avg,
            event_count, avg_tone
        FROM brent LEFT JOIN ttf ON ttf.price_date = brent.price_date
        LEFT JOIN gb_power ON gb_power.price_date = brent.price_date
        LEFT JOIN news ON news.event_date = brent.price_date""",
    "targets": """SELECT event_date, label, phase, k, brent.price_date AS day
        FROM (SELECT *, event_date + k AS target
            FROM timeline CROSS JOIN (VALUES (0), (1), (3), (5), (10)) h(k))
        ASOF LEFT JOIN brent ON target <= brent.price_date""",
    "priced": """SELECT targets.*, brent_close AS brent, ttf_close AS ttf, gb_power_avg AS power
        FROM targets LEFT JOIN brent ON brent.price_date = day
        LEFT JOIN ttf ON ttf.price_date = day
        LEFT JOIN gb_power ON gb_power.price_date = day""",
    "impact": f"""SELECT event_date, label, MAX(CASE WHEN k = 0 THEN day END) AS t0_date,
            {", ".join(f"MAX(CASE WHEN k = {k} THEN {n} END) AS {n}_t{s}"
                for n in ("brent", "ttf", "power") for k, s in ((0, ""), (3, "3")))},
            {horizon_columns(1, (3,))}
        FROM priced GROUP BY 1, 2""",
    "multi": f"""SELECT event_date, label, phase, {horizon_columns()}
        FROM priced GROUP BY 1, 2, 3""",
    "regime": """SELECT event_date, label, t0_date, brent_pct_3d, ttf_pct_3d, power_pct_3d,
            gas_share_pct, renewables_share_pct, nuclear_share_pct, total_mwh,
            CASE WHEN gas_share_pct >= 30 THEN 'high_gas' WHEN gas_share_pct < 30 THEN 'low_gas'
                ELSE 'unknown' END AS regime
        FROM impact LEFT JOIN gb_gen_mix ON price_date = t0_date""",
    "regime_clean": """SELECT * FROM regime WHERE brent_pct_3d IS NOT NULL
        AND ttf_pct_3d IS NOT NULL AND power_pct_3d IS NOT NULL""",
    "spread_raw": """SELECT brent.price_date, brent_close, ttf_close, gb_power_avg AS power,
            uka_proxy_gbp AS carbon, gas_share_pct,
            ttf_close * 1.85::DOUBLE * 0.85::DOUBLE AS fuel_cost,
            uka_proxy_gbp * 0.36::DOUBLE AS carbon_cost
        FROM brent JOIN ttf ON ttf.price_date = brent.price_date
        JOIN gb_power ON gb_power.price_date = brent.price_date
        LEFT JOIN uka_proxy ON uka_proxy.price_date = brent.price_date
        LEFT JOIN gb_gen_mix ON gb_gen_mix.price_date = brent.price_date""",
    "spread": f"""SELECT price_date, brent_close, ttf_close, power AS power_observed_gbp_mwh,
            carbon AS uka_proxy_gbp_per_tco2, gas_share_pct,
            {rnd("fuel_cost", 2)} AS fuel_cost_gbp_mwh,
            {rnd("carbon_cost", 2)} AS carbon_cost_gbp_mwh,
            {rnd("fuel_cost + carbon_cost", 2)} AS theoretical_css_gbp_mwh,
            {rnd("power - (fuel_cost + carbon_cost)", 2)} AS residual_gbp_mwh,
            CASE WHEN gas_share_pct >= 30 THEN 'high_gas' WHEN gas_share_pct < 30 THEN 'low_gas'
                ELSE 'unknown' END AS regime
        FROM spread_raw""",
    # what is left of the power price after carbon, in units of fuel, from the raw series
    "implied": f"""SELECT s.price_date, s.ttf_close AS observed_ttf_eur_mwh,
            s.power AS power_observed_gbp_mwh, s.carbon AS uka_proxy_gbp_per_tco2,
            s.gas_share_pct, m.regime, {rnd("left_over", 2)} AS implied_ttf_eur_mwh,
            {rnd("s.ttf_close - left_over", 2)} AS basis_eur_mwh,
            CASE WHEN left_over BETWEEN s.ttf_close - 15 AND s.ttf_close + 15
                THEN 'plausibly_marginal' ELSE 'decoupled' END AS basis_regime
        FROM (SELECT *, power / 1.5725::DOUBLE - carbon * (0.36::DOUBLE / 1.5725::DOUBLE) AS left_over
            FROM spread_raw) s
        JOIN (SELECT price_date, CASE WHEN MAX(gas_share_pct) IS NULL THEN 'unknown'
                WHEN MAX(gas_share_pct) < 30 THEN 'low_gas' ELSE 'high_gas' END AS regime
            FROM spread_raw GROUP BY 1) m ON m.price_date = s.price_date
        WHERE s.carbon IS NOT NULL""",
    "news_no": "SELECT *, ROW_NUMBER() OVER (ORDER BY event_date) AS i FROM news",
    # each day beside the 30 rows before it
    "burst": """SELECT a.event_date, a.event_count, AVG(b.event_count) AS rolling_30d_mean,
            a.event_count / NULLIF(AVG(b.event_count), 0) AS burst_score
        FROM news_no a LEFT JOIN news_no b ON b.i >= a.i - 30 AND b.i < a.i GROUP BY 1, 2""",
    "asymmetry": """SELECT event_date,
            AVG(CASE WHEN tone < 0 THEN tone ELSE 0 END) AS negative_tone,
            AVG(CASE WHEN tone > 0 THEN tone ELSE 0 END) AS positive_tone,
            AVG(tone) AS overall_tone, COUNT(*) AS event_count
        FROM conflict GROUP BY 1""",
    "features": f"""SELECT event_date, COUNT(*) AS event_count,
            CAST(SUM(mentions) AS BIGINT) AS total_mentions, AVG(tone) AS mean_tone,
            SUM(tone * mentions) / NULLIF(SUM(mentions), 0) AS mentions_weighted_tone,
            AVG(goldstein) AS mean_goldstein,
            SUM(goldstein * mentions) / NULLIF(SUM(mentions), 0) AS mentions_weighted_goldstein,
            SUM(goldstein * mentions) AS total_weighted_goldstein,
            {", ".join(f"COUNT(*) FILTER (WHERE quad_class = '{v}') AS {k}" for k, v in CFG.class_counts.items())},
            {", ".join(f"COUNT(*) FILTER (WHERE root_code = '{v}') AS {k}" for k, v in CFG.root_counts.items())}
        FROM conflict GROUP BY 1""",
    "articles": f"""SELECT doc_id AS article_id, {DOC_DAY} AS event_date,
            CASE WHEN doc_id % 100 <> 3 THEN {listed("text", b.THEME_OF_TEXT)} END AS themes,
            CASE WHEN doc_id % 100 <> 7 AND {DOC_DAY} <> DATE '{b.NO_PLACES}'
                THEN {listed("text", b.PLACE_OF_TEXT)} END AS locations,
            CASE WHEN source = 'src5' THEN {TONE_HEAD} ELSE {TONE_HEAD} || ',' ||
                ({num("n_chars % 3", "doc_id % 4")}) || ',' || CAST(n_chars AS VARCHAR) END AS tone,
            concat_ws(',', {SCORES}) AS scores
        FROM documents""",
    "vector": f"""SELECT event_date, COUNT(*) AS n_articles,
            {", ".join(f"AVG({n}) AS mean_{n}" for n in b_parts())},
            {", ".join(f"STDDEV_SAMP({n}) AS {n}_dispersion" for n in ("tone", "positive", "negative"))}
        FROM (SELECT event_date, {tone_parse()} FROM articles) GROUP BY 1""",
    "themes": f"""SELECT event_date, COUNT(*) AS n_articles,
            {token_counts("themes", CFG.theme_tokens, CFG.theme_composites)}
        FROM articles WHERE themes IS NOT NULL GROUP BY 1""",
    "places": f"""SELECT event_date, COUNT(*) AS n_articles,
            {token_counts("locations", CFG.place_tokens, CFG.place_composites)}
        FROM articles WHERE locations IS NOT NULL GROUP BY 1""",
    "keyed": f"""SELECT event_date, COUNT(*) AS n_articles, {score_means()}
        FROM (SELECT event_date, {score_parse()} FROM articles
            WHERE scores IS NOT NULL AND scores <> '') GROUP BY 1""",
    # counted from the articles at once; a day without any place list has no place counts
    "dual": """SELECT event_date, n_econ_oil + COALESCE(n_kharg, 0) AS oil_signal,
            COALESCE(n_ras_laffan, 0) AS lng_signal, n_maritime_total AS maritime_signal,
            n_econ_oil, n_econ_oilexport, n_kharg, n_ras_laffan, n_persian_gulf,
            n_chokepoint_total, n_maritime_total, n_armedconflict
        FROM (SELECT event_date,
            COUNT(*) FILTER (WHERE themes LIKE '%ECON_OIL%') AS n_econ_oil,
            COUNT(*) FILTER (WHERE themes LIKE '%ECON_OILEXPORT%') AS n_econ_oilexport,
            COUNT(*) FILTER (WHERE themes LIKE '%MARITIME_TRANSPORT%'
                OR themes LIKE '%MARITIME_INCIDENT%') AS n_maritime_total,
            COUNT(*) FILTER (WHERE themes LIKE '%ARMEDCONFLICT%') AS n_armedconflict,
            COUNT(*) FILTER (WHERE locations LIKE '%Kharg%') + any_place AS n_kharg,
            COUNT(*) FILTER (WHERE locations LIKE '%Ras Laffan%') + any_place AS n_ras_laffan,
            COUNT(*) FILTER (WHERE locations LIKE '%Persian Gulf%') + any_place AS n_persian_gulf,
            COUNT(*) FILTER (WHERE regexp_matches(locations, 'Hormuz|Persian Gulf|Kharg|Ras Laffan'))
                + any_place AS n_chokepoint_total
            FROM (SELECT *, CASE WHEN COUNT(locations) OVER (PARTITION BY event_date) > 0
                THEN 0 END AS any_place FROM articles)
            GROUP BY event_date, any_place HAVING COUNT(themes) > 0)""",
    "theme_place": """SELECT themes.event_date, themes.n_articles, n_econ_oil, n_energy_security,
            n_maritime_total, n_conflict_total, n_chokepoint_total, n_kharg, n_ras_laffan,
            n_persian_gulf
        FROM themes LEFT JOIN places ON places.event_date = themes.event_date""",
    "scores": earlier_scores(DOC_URL),
    "score_days": """SELECT day AS event_date, COUNT(*) AS n_articles,
            AVG(finbert_signed) AS mean_finbert_signed,
            AVG(finbert_positive) AS mean_finbert_positive,
            AVG(finbert_negative) AS mean_finbert_negative,
            AVG(finbert_neutral) AS mean_finbert_neutral,
            SUM(finbert_signed * nummentions) / NULLIF(SUM(CAST(nummentions AS DOUBLE)), 0)
                AS mentions_weighted_finbert_signed,
            STDDEV_SAMP(finbert_signed) AS finbert_dispersion
        FROM scores WHERE day IS NOT NULL GROUP BY 1""",
    "with_news": """SELECT impact.event_date, label, brent_pct_3d, ttf_pct_3d, power_pct_3d,
            event_count, avg_tone, avg_goldstein
        FROM impact LEFT JOIN news ON news.event_date = impact.event_date
        WHERE brent_pct_3d IS NOT NULL AND ttf_pct_3d IS NOT NULL AND power_pct_3d IS NOT NULL""",
    "day_t3": """SELECT a.price_date, c.price_date AS t3_date
        FROM (SELECT price_date, price_date + 3 AS target FROM brent) a
        ASOF JOIN brent c ON a.target <= c.price_date""",
    "day_moves": f"""SELECT day_t3.price_date, t3_date,
            {pct("b3.brent_close", "b0.brent_close")} AS brent_pct_3d,
            {pct("t3.ttf_close", "t0.ttf_close")} AS ttf_pct_3d,
            {pct("p3.gb_power_avg", "p0.gb_power_avg")} AS power_pct_3d
        FROM day_t3 JOIN brent b0 ON b0.price_date = day_t3.price_date
        JOIN brent b3 ON b3.price_date = t3_date
        LEFT JOIN ttf t0 ON t0.price_date = day_t3.price_date
        LEFT JOIN ttf t3 ON t3.price_date = t3_date
        LEFT JOIN gb_power p0 ON p0.price_date = day_t3.price_date
        LEFT JOIN gb_power p3 ON p3.price_date = t3_date""",
    "real_moves": """SELECT event_date, day AS t0_date, brent_pct_3d, ttf_pct_3d, power_pct_3d
        FROM (SELECT event_date, day FROM targets WHERE k = 0) e
        JOIN day_moves ON day_moves.price_date = e.day""",
    "pool": """SELECT *, ROW_NUMBER() OVER (ORDER BY price_date) - 1 AS i FROM day_moves
        WHERE price_date NOT IN (SELECT event_date FROM timeline)""",
    "pool_size": "SELECT COUNT(*) AS n FROM pool",
    # one row per (iteration, step): a taken position is replaced by the step number
    "placebo_steps": f"""SELECT g.i AS iter, n - 14 AS j, CAST([] AS BIGINT[]) AS taken
            FROM (SELECT UNNEST(range(1000)) AS i) g CROSS JOIN pool_size
        UNION ALL
        SELECT iter, j + 1, list_append(taken, CASE WHEN list_contains(taken, pick) THEN j ELSE pick END)
        FROM (SELECT *, {md5_number("42", "iter", "j")} % (j + 1) AS pick FROM placebo_steps) CROSS JOIN pool_size
        WHERE j < n""",
    "placebo": """SELECT iter, AVG(brent_pct_3d) AS brent_pct_3d_mean,
            AVG(ttf_pct_3d) AS ttf_pct_3d_mean, AVG(power_pct_3d) AS power_pct_3d_mean
        FROM (SELECT iter, UNNEST(taken) AS i FROM placebo_steps WHERE len(taken) = 14) s
        JOIN pool ON pool.i = s.i GROUP BY 1""",
    "loo_rows": "SELECT *, ROW_NUMBER() OVER (PARTITION BY x, y ORDER BY vx, vy) AS i FROM ("
    + long_pairs("with_news", LOO_PAIRS)
    + ")",
    "boot_rows": """SELECT ROW_NUMBER() OVER (ORDER BY event_date, label) - 1 AS i, COUNT(*) OVER () AS n,
            brent_pct_3d, ttf_pct_3d
        FROM impact WHERE brent_pct_3d IS NOT NULL AND ttf_pct_3d IS NOT NULL
            AND power_pct_3d IS NOT NULL""",
    "boot_picks": f"""SELECT iter, {md5_number("42", "iter", "i")} % n AS i
        FROM (SELECT UNNEST(range(5000)) AS iter) CROSS JOIN (SELECT i, n FROM boot_rows)""",
    "boot_draws": f"""SELECT iter, {pearson("brent_pct_3d", "ttf_pct_3d")} AS r
        FROM boot_picks JOIN boot_rows ON boot_rows.i = boot_picks.i GROUP BY 1""",
    "asym_moves": trailing("asymmetry", "event_date, negative_tone, positive_tone, overall_tone"),
    "feature_moves": trailing(
        "features",
        "event_date, mean_tone, mentions_weighted_tone, mean_goldstein, mentions_weighted_goldstein",
    ),
    "dual_moves_all": trailing("dual", "event_date, oil_signal, lng_signal"),
    "dual_moves": """SELECT * FROM dual_moves_all WHERE brent_pct_3d IS NOT NULL
        AND ttf_pct_3d IS NOT NULL AND power_pct_3d IS NOT NULL""",
    "volatility": f"""SELECT d, brent_ret, ttf_ret, power_ret, {", ".join(
            f"CASE WHEN COUNT({n}_ret) OVER w = 7 THEN STDDEV_SAMP({n}_ret) OVER w END AS {n}_vol7"
            for n in ("brent", "ttf", "power"))}
        FROM (SELECT d, {", ".join(
            f"({c} / NULLIF(LAG({c}) OVER (ORDER BY d), 0) - 1) * 100 AS {n}_ret"
            for n, c in (("brent", "brent_close"), ("ttf", "ttf_close"), ("power", "gb_power_avg")))}
            FROM combined)
        WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "url_rows": f"""SELECT {DOC_URL} AS source_url, {DOC_DAY} AS event_date,
            CAST(n_chars AS INT) AS mentions,
            {case_of("lang", b.COUNTRY_OF_LANG, "'FR'")} AS country
        FROM documents""",
    "url_days": f"""SELECT source_url, event_date AS day, MAX(mentions) AS nummentions
        FROM url_rows WHERE country IN ({PARTS}) GROUP BY 1, 2""",
    "window_urls": f"""SELECT *, {slug_sql("source_url")} AS slug FROM (
            SELECT source_url, day, nummentions FROM url_days u
            WHERE EXISTS (SELECT 1 FROM timeline t WHERE ABS(date_diff('day', t.event_date, u.day)) <= 7)
            QUALIFY ROW_NUMBER() OVER (PARTITION BY day
                ORDER BY nummentions DESC NULLS LAST, source_url) <= {b.SAMPLE_CONFIG.top_urls_per_day})""",
    "window_slugs": "SELECT * FROM window_urls WHERE length(slug) >= 6",
    # the same for every order of a month-end day and for URLs that hold the whole text
    "text_url_days": text_url_days(DOC_DAY),
    "text_window_urls": text_window_urls("text_url_days"),
    "text_scores": earlier_scores(TEXT_URL),
    "text_slugs": "SELECT * FROM text_window_urls WHERE length(slug) >= 6",
    # and for every order, and documents spread evenly
    "even_url_days": text_url_days(EVEN_DAY),
    "even_window_urls": text_window_urls("even_url_days", "TRUE"),
    "even_scores": earlier_scores(TEXT_URL, EVEN_DAY),
    "even_slugs": "SELECT * FROM even_window_urls WHERE length(slug) >= 6",
    # raw drops: which fault a line has follows from its id
    "event_drop": """SELECT *, CAST(ts AS DATE) AS date, hour(ts) // 6 AS slot,
            event_id % 97 = 5 AS short FROM gdelt""",
    "article_drop": f"""SELECT *, article_id % 2 AS slot,
            CASE WHEN article_id % 41 = 3 THEN 'tiny' WHEN article_id % 43 = 5 THEN 'short'
                WHEN article_id % 47 = 7 THEN 'long' END AS fault FROM articles""",
    "half_hours": f"""SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey % 4 = 0 AS other,
            (l_orderkey * 7 + l_linenumber) % 48 AS period,
            AVG(l_extendedprice * (1 - l_discount) / {b.POWER_SCALE}) AS price
        FROM lineitem GROUP BY 1, 2, 3""",
    "fuel_days": f"""SELECT CAST(l_shipdate AS DATE) AS price_date,
            {case_of("fuel", b.FUEL_CATEGORIES, "'other'")} AS c,
            SUM(CASE WHEN fuel = 'OIL' AND day(l_shipdate) IN (7, 8) THEN 0 ELSE l_quantity END)
                AS amount
        FROM (SELECT *, {array_of(b.FUELS)}[l_partkey % {len(b.FUELS)} + 1] AS fuel FROM lineitem)
        GROUP BY 1, 2""",
}

RECURSIVE = {"placebo_steps"}


def with_ctes(body: str) -> str:
    """Put the building blocks a query names, and theirs, in front of it."""
    order: list[str] = []

    def need(text: str, inside: str | None = None) -> None:
        for name in CTES:
            if name != inside and name not in order and re.search(
                rf"(?:FROM|JOIN)\s+{name}\b", text
            ):
                need(CTES[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    word = "WITH RECURSIVE" if RECURSIVE & set(order) else "WITH"
    return f"{word} {head}\n{body}"


def fixed(body: str, *doubles: str) -> str:
    """The query with its floating-point columns fixed to 6 places."""
    if not doubles:
        return with_ctes(body)
    replaced = ", ".join(f"{rnd(c, 6)} AS {c}" for c in doubles)
    return with_ctes(f"SELECT * REPLACE ({replaced}) FROM ({body})")
