"""Column lists of the raw inputs.

The tab-separated drops carry no header, so these lists are the schema. Every field is read
as text and cast late, so one bad value cannot poison a column, and codes keep leading zeros.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field order of the public event file format (61 fields), lower-cased.
EVENT_COLUMNS = (
    "globaleventid", "day", "monthyear", "year", "fractiondate",
    "actor1code", "actor1name", "actor1countrycode", "actor1knowngroupcode",
    "actor1ethniccode", "actor1religion1code", "actor1religion2code",
    "actor1type1code", "actor1type2code", "actor1type3code",
    "actor2code", "actor2name", "actor2countrycode", "actor2knowngroupcode",
    "actor2ethniccode", "actor2religion1code", "actor2religion2code",
    "actor2type1code", "actor2type2code", "actor2type3code",
    "isrootevent", "eventcode", "eventbasecode", "eventrootcode", "quadclass",
    "goldsteinscale", "nummentions", "numsources", "numarticles", "avgtone",
    "actor1geo_type", "actor1geo_fullname", "actor1geo_countrycode",
    "actor1geo_adm1code", "actor1geo_adm2code", "actor1geo_lat", "actor1geo_long",
    "actor1geo_featureid",
    "actor2geo_type", "actor2geo_fullname", "actor2geo_countrycode",
    "actor2geo_adm1code", "actor2geo_adm2code", "actor2geo_lat", "actor2geo_long",
    "actor2geo_featureid",
    "actiongeo_type", "actiongeo_fullname", "actiongeo_countrycode",
    "actiongeo_adm1code", "actiongeo_adm2code", "actiongeo_lat", "actiongeo_long",
    "actiongeo_featureid",
    "dateadded", "sourceurl",
)

# Field order of the public article file format (27 fields), lower-cased.
ARTICLE_COLUMNS = (
    "gkgrecordid", "gkg_datestamp", "sourcecollectionidentifier", "sourcecommonname",
    "documentidentifier", "v1counts", "v21counts", "v1themes", "v2enhancedthemes",
    "v1locations", "v2enhancedlocations", "v1persons", "v2enhancedpersons",
    "v1organizations", "v2enhancedorganizations", "v2tone", "v2enhanceddates",
    "v21gcam", "v21sharingimage", "v21relatedimages", "v21socialimageembeds",
    "v21socialvideoembeds", "v21quotations", "v21allnames", "v21amounts",
    "v21translationinfo", "v2extrasxml",
)


def text_schema(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


EVENTS = text_schema(EVENT_COLUMNS)
ARTICLES = text_schema(ARTICLE_COLUMNS)

TIMELINE = "event_date date, label string, description string, source_url string, phase string"
BRENT = "price_date date, brent_close double"
TTF = "price_date date, ttf_close double"
GB_POWER = "price_date date, gb_power_avg double"
GB_GEN_MIX = (
    "price_date date, total_mwh double, gas_share_pct double, renewables_share_pct double, "
    "nuclear_share_pct double, biomass_share_pct double, coal_oil_share_pct double, "
    "pumped_storage_share_pct double"
)
UKA_PROXY = "price_date date, krbn_close double, uka_proxy_gbp double, source string"
SCORES = (
    "source_url string, day date, nummentions int, slug string, finbert_positive double, "
    "finbert_neutral double, finbert_negative double, finbert_signed double"
)
SCORE_DIMENSIONS = "code string, name string, dictionary string, polarity string, note string"

# API payloads landed as JSON: {"data": [...]}
HALF_HOUR_PRICES = "data array<struct<startTime: string, dataProvider: string, price: double>>"
HALF_HOUR_GENERATION = (
    "data array<struct<settlementDate: string, fuelType: string, generation: string>>"
)

HEADED_TABLES = {
    "timeline": TIMELINE,
    "brent": BRENT,
    "ttf": TTF,
    "gb_power": GB_POWER,
    "gb_gen_mix": GB_GEN_MIX,
    "uka_proxy": UKA_PROXY,
    "finbert_scores": SCORES,
    "gcam_dimensions": SCORE_DIMENSIONS,
}
