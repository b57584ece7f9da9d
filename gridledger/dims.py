"""Reference dimensions as small DataFrames.

Built from Arrow tables so the optimizer knows their exact size: joins against
them are broadcast because the size is proven, not because a hint says so.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridledger.functions import fixed_values as fv

# ---- fixed values: enumerations --------------------------------------------
COMMODITIES = ("electricity natural_gas crude_oil refined_products coal nuclear renewables storage"
               " carbon hydrogen multi_energy unknown").split()
TOPICS = ("price settlement generation asset_status outage congestion transmission fundamentals"
          " supply demand storage inventory import_export capacity reserves weather regulatory"
          " policy company project emissions news general").split()
GEOGRAPHIES = ("united_states canada mexico europe asia global western_us texas northeast_us"
               " midwest_us southeast_us california unknown").split()
MARKETS = "CAISO ERCOT PJM MISO SPP NYISO ISO-NE WEST GENERAL".split()
INTENTS = ("price generation outage congestion fundamentals gas weather regulatory news"
           " general").split()

# ---- fixed values: provider catalogue (rank, primary, access, then lists) ---
_GRID = "electricity renewables storage"
PROVIDERS = (
    ("caiso_oasis", "CAISO OASIS", 1, True, "public", "oasis.caiso.com oasis-bulk.caiso.com", _GRID,
     "price settlement congestion transmission generation demand supply import_export reserves outage",
     "california western_us", "structured_market_data historical_analysis",
     "structured_api structured_download"),
    ("nrc_reactor_status", "U.S. Nuclear Regulatory Commission", 1, True, "public", "nrc.gov",
     "nuclear", "asset_status outage generation capacity news",
     "united_states california texas northeast_us midwest_us southeast_us",
     "asset_status general_web_research", "structured_download web_research"),
    ("eia_api", "U.S. Energy Information Administration", 2, True, "public_api_key", "eia.gov",
     "electricity natural_gas crude_oil refined_products coal renewables nuclear storage multi_energy",
     "price generation fundamentals supply demand storage inventory import_export capacity emissions news",
     "*", "structured_market_data historical_analysis general_web_research",
     "structured_api structured_download web_research"),
    ("ferc_elibrary", "Federal Energy Regulatory Commission", 1, True, "public",
     "ferc.gov elibrary.ferc.gov", "*", "regulatory policy transmission capacity project news",
     "united_states california texas western_us northeast_us midwest_us southeast_us",
     "regulatory_documents general_web_research", "document_search web_research"),
    ("noaa_nws", "NOAA and National Weather Service", 1, True, "public", "noaa.gov weather.gov", "*",
     "weather demand supply generation news", "*", "weather_data general_web_research",
     "structured_api web_research"),
    ("ercot", "Electric Reliability Council of Texas", 1, True, "public", "ercot.com", _GRID,
     "price settlement generation demand reserves congestion outage transmission", "texas",
     "structured_market_data asset_status general_web_research",
     "structured_api structured_download web_research"),
    ("pjm", "PJM Interconnection", 1, True, "public", "pjm.com", _GRID,
     "price settlement generation demand capacity reserves congestion outage transmission",
     "northeast_us", "structured_market_data asset_status general_web_research",
     "structured_api structured_download web_research"),
    ("miso", "Midcontinent Independent System Operator", 1, True, "public", "misoenergy.org", _GRID,
     "price settlement generation demand congestion reserves outage transmission", "midwest_us",
     "structured_market_data general_web_research", "structured_download web_research"),
    ("spp", "Southwest Power Pool", 1, True, "public", "spp.org", _GRID,
     "price settlement generation demand congestion reserves outage transmission", "midwest_us",
     "structured_market_data general_web_research",
     "structured_api structured_download web_research"),
    ("reuters", "Reuters", 10, False, "public", "reuters.com", "*", "*", "*",
     "company_news general_web_research", "web_research"),
    ("woodmac_optional", "Wood Mackenzie", 11, False, "optional_licensed", "woodmac.com", "*", "*",
     "*", "company_news general_web_research historical_analysis", "web_research"),
)

# ---- fixed values: authority registry (listing order decides) ---------------
AUTHORITIES = (
    ("eia.gov", "controlling", "U.S. Energy Information Administration"),
    ("ferc.gov", "controlling", "Federal Energy Regulatory Commission"),
    ("energy.gov", "controlling", "U.S. Department of Energy"),
    ("nrc.gov", "controlling", "U.S. Nuclear Regulatory Commission"),
    ("noaa.gov", "controlling", "National Oceanic and Atmospheric Administration"),
    ("weather.gov", "controlling", "National Weather Service"),
    ("caiso.com", "controlling", "California Independent System Operator"),
    ("ercot.com", "controlling", "Electric Reliability Council of Texas"),
    ("pjm.com", "controlling", "PJM Interconnection"),
    ("misoenergy.org", "controlling", "MISO"),
    ("spp.org", "controlling", "Southwest Power Pool"),
    ("nyiso.com", "controlling", "New York Independent System Operator"),
    ("iso-ne.com", "controlling", "ISO New England"),
    ("nerc.com", "controlling", "North American Electric Reliability Corporation"),
    ("energy.ca.gov", "controlling", "California Energy Commission"),
    ("cpuc.ca.gov", "controlling", "California Public Utilities Commission"),
    ("sdge.com", "primary", "San Diego Gas & Electric"),
    ("sec.gov", "controlling", "U.S. Securities and Exchange Commission"),
)

# ---- fixed values: source policy -------------------------------------------
SOURCE_POLICY = (
    ("caiso_oasis", "CAISO OASIS", 1, True, "oasis.caiso.com oasis-bulk.caiso.com", "CAISO",
     "price congestion fundamentals outage"),
    ("caiso", "California ISO", 2, True, "caiso.com", "CAISO WEST",
     "price generation outage congestion fundamentals news"),
    ("nrc", "U.S. Nuclear Regulatory Commission", 1, True, "nrc.gov", "CAISO WEST GENERAL",
     "generation outage news"),
    ("eia", "U.S. Energy Information Administration", 2, True, "eia.gov", "*",
     "generation fundamentals gas news"),
    ("ferc", "Federal Energy Regulatory Commission", 1, True, "ferc.gov", "*",
     "regulatory news congestion"),
    ("noaa_nws", "NOAA and National Weather Service", 1, True, "noaa.gov weather.gov", "*",
     "weather fundamentals news"),
    ("cpuc", "California Public Utilities Commission", 2, True, "cpuc.ca.gov", "CAISO WEST",
     "regulatory gas news"),
    ("cec", "California Energy Commission", 2, True, "energy.ca.gov", "CAISO WEST",
     "generation fundamentals regulatory news"),
    ("bpa", "Bonneville Power Administration", 2, True, "bpa.gov", "WEST",
     "generation fundamentals outage news"),
    ("reuters", "Reuters", 10, False, "reuters.com", "*", "*"),
    ("wood_mackenzie_public", "Wood Mackenzie Public Research", 11, False, "woodmac.com", "*", "*"),
    ("sp_global_public", "S&P Global Public Content", 11, False, "spglobal.com", "*", "*"),
)

# ---- fixed values: claim requirements ---------------------------------------
CLAIM_REQUIREMENTS = (  # type, primary, cross-check, time, unit, market, zone, max age, records
    ("observed_fact", True, False, False, False, False, False, None, 1),
    ("numeric_fact", True, False, True, True, True, True, None, 1),
    ("calculation", True, False, True, True, True, True, None, 1),
    ("explanation", True, True, False, False, False, False, None, 2),
    ("analyst_inference", True, True, False, False, False, False, None, 2),
    ("forecast", True, True, True, False, False, False, None, 2),
)


def small_table(spark: SparkSession, rows, schema: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Arrow-backed local relation, so its size is known to the optimizer."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(values), type=kind) for values, (_, kind) in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in schema]))


_S, _L, _B, _I = pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int32()


def _list(text: str, everything: list[str]) -> list[str]:
    return list(everything) if text == "*" else text.split()


def provider_rows() -> list[tuple]:
    return [
        (pid, name, rank, primary, access, domains.split(), _list(commodities, COMMODITIES),
         _list(topics, TOPICS), _list(places, GEOGRAPHIES), capabilities.split(), kinds.split())
        for pid, name, rank, primary, access, domains, commodities, topics, places, capabilities,
        kinds in PROVIDERS
    ]


def providers(spark: SparkSession) -> DataFrame:
    return small_table(spark, provider_rows(), [
        ("provider_id", _S), ("provider_name", _S), ("authority_rank", _I), ("is_primary", _B),
        ("access", _S), ("domains", _L), ("commodities", _L), ("topics", _L), ("geographies", _L),
        ("capabilities", _L), ("connector_kinds", _L)])


def authorities(spark: SparkSession) -> DataFrame:
    rows = [(domain, i, tier, org) for i, (domain, tier, org) in enumerate(AUTHORITIES)]
    return small_table(spark, rows, [("domain", _S), ("ord", _I), ("tier", _S),
                                     ("organization", _S)])


def source_policy(spark: SparkSession) -> DataFrame:
    rows = [(sid, name, rank, primary, domains.split(), _list(markets, MARKETS),
             _list(intents, INTENTS))
            for sid, name, rank, primary, domains, markets, intents in SOURCE_POLICY]
    return small_table(spark, rows, [
        ("source_id", _S), ("source_name", _S), ("authority_rank", _I), ("is_primary", _B),
        ("domains", _L), ("markets", _L), ("intents", _L)])


def claim_requirements(spark: SparkSession) -> DataFrame:
    return small_table(spark, CLAIM_REQUIREMENTS, [
        ("claim_type", _S), ("needs_primary", _B), ("needs_cross_check", _B), ("needs_time", _B),
        ("needs_unit", _B), ("needs_market", _B), ("needs_zone", _B),
        ("max_age_seconds", pa.int64()), ("min_records", _I)])


def authority_spellings(spark: SparkSession) -> DataFrame:
    return small_table(spark, fv.AUTHORITY_SPELLINGS, [("spelling", _S), ("code", _S)])


def hub_spellings(spark: SparkSession) -> DataFrame:
    """One row per accepted spelling of a hub, already normalised."""
    rows = sorted({(norm(word), canonical, display)
                   for canonical, display, words in fv.HUBS
                   for word in (canonical, display, *words)})
    return small_table(spark, rows, [("spelling", _S), ("location", _S), ("display_name", _S)])


def norm(text: str) -> str:
    """Driver-side twin of ``functions.text.norm_text`` for vocabulary words."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()
