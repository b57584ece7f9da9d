"""Vocabulary and lookup values.

Everything in this module is a fixed value: results depend on these exact
words, spellings, orders and numbers, so they are stated as plain text.
"""
from __future__ import annotations


def _labels(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Lines ``label: term, term`` in listing order."""
    rows = []
    for line in text.strip().splitlines():
        label, terms = line.split(":", 1)
        rows.append((label.strip(), tuple(t.strip() for t in terms.split(",") if t.strip())))
    return tuple(rows)


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _lines(text: str) -> tuple[str, ...]:
    return tuple(line.strip() for line in text.strip().splitlines())


# ---- fixed values: question classification -------------------------------
COMMODITY_TERMS = _labels("""
storage: battery, bess, energy storage, state of charge, charging, discharging
nuclear: nuclear, reactor, diablo canyon
natural_gas: natural gas, henry hub, citygate, pipeline, lng, gas storage, bcf, mmbtu, freeport lng
crude_oil: brent, wti, crude oil, crude, oil price, opec, barrel
refined_products: gasoline, diesel, jet fuel, heating oil, refinery, crack spread
coal: thermal coal, met coal, coal
renewables: solar, wind generation, hydro, renewable, curtailment
carbon: carbon, emissions allowance, cap-and-trade, rggi, cca price
hydrogen: green hydrogen, blue hydrogen, hydrogen
electricity: electricity, power price, np-15, np15, sp-15, sp15, lmp, day-ahead, day ahead, real-time, real time, megawatt, mwh, transmission, congestion, load, grid, ercot, caiso, pjm, miso, spp, nyiso, iso-ne
""")

TOPIC_TERMS = _labels("""
settlement: settle, settlement, cleared at
asset_status: running, operating, online, offline, full capacity, derated, status
outage: forced outage, planned outage, outage, trip
congestion: binding constraint, shadow price, congestion, flowgate
transmission: transfer capability, transmission, line rating, intertie
generation: capacity factor, generation, output, producing
storage: storage level, inventory, injection, withdrawal, state of charge
demand: load forecast, consumption, demand
supply: availability, production, supply
import_export: interchange, imports, exports, flows
capacity: capacity market, installed capacity, nameplate capacity, battery capacity
reserves: reserve margin, operating reserves, ancillary services
weather: weather, temperature, heat wave, cold snap, wind forecast
regulatory: commission order, regulatory, ferc, tariff, filing
policy: legislation, tax credit, subsidy, policy
company: acquisition, earnings, company, merger
project: commercial operation, construction, project, permit
emissions: carbon intensity, emissions, co2
news: what happened, latest, update, news
price: price, lmp, cost, spread, basis
""")

GEOGRAPHY_TERMS = _labels("""
california: diablo canyon, california, caiso, np-15, np15, sp-15, sp15
texas: houston hub, north hub, texas, ercot
western_us: western interconnection, western us, palo verde, mid-c, bpa
northeast_us: new england, new york, iso-ne, nyiso, pjm
midwest_us: midwest, miso, spp
europe: european, europe, germany, france, ttf
canada: alberta, ontario, canada, aeso, ieso
global: worldwide, international, global, opec
""")

# Mentions searched in this order; the second word is the canonical spelling.
ENTITY_MENTIONS = (
    (r"NP-?15", "NP-15"),
    (r"SP-?15", "SP-15"),
    (r"Henry Hub", "Henry Hub"),
    (r"Brent", "Brent"),
    (r"WTI", "WTI"),
    (r"Diablo Canyon", "Diablo Canyon"),
    (r"Freeport LNG", "Freeport LNG"),
    (r"ERCOT", "ERCOT"),
    (r"CAISO", "CAISO"),
    (r"PJM", "PJM"),
    (r"MISO", "MISO"),
    (r"SPP", "SPP"),
    (r"NYISO", "NYISO"),
    (r"ISO-NE", "ISO-NE"),
)
NODE_PATTERN = r"(?i)\b(?:NP-?15|SP-?15|ZP26|TH_[A-Z0-9_]+)\b"

# ---- fixed values: question routing (whole-word matches) ------------------
DOMAIN_TERMS = _labels("""
nuclear: nuclear, reactor, diablo canyon, palo verde, nrc, refueling outage, unit power
natural_gas: natural gas, henry hub, gas storage, pipeline, lng, bcf, mmbtu, gas production, gas price
petroleum: crude oil, brent, wti, petroleum, gasoline, diesel, refinery, oil inventory, opec
coal: coal, coal generation, coal production, coal stockpile
energy_storage: battery, bess, energy storage, storage capacity, battery charging, battery discharge
renewables: solar, wind, renewable, curtailment, hydro, geothermal, renewable generation
weather: weather, temperature, heat, heat wave, extreme heat, cold, cold snap, hurricane, storm, wind forecast, solar irradiance, degree days
transmission_regulation: ferc, nerc, transmission planning, tariff, order 1920, rulemaking, rate case, interconnection queue, reliability standard
grid_reliability: reserve margin, operating reserve, grid emergency, energy emergency, load shed, reliability, outage, forced outage, transmission constraint
emissions_carbon: carbon, co2, emissions, allowance price, cap and trade, rggi
company_asset: earnings, company, acquisition, merger, project status, commercial operation, construction, investor, asset sale
electricity_markets: lmp, electricity price, power price, day ahead, real time, fifteen minute, settlement, np15, np 15, sp15, sp 15, ercot, caiso, pjm, miso, spp, nyiso, iso ne, congestion, load, generation mix
""")  # listing order is the tie priority
GENERAL_ENERGY_WORDS = _words("energy power fuel generation")

ROUTE_GEOGRAPHY_TERMS = _labels("""
california: california, caiso, np15, np 15, sp15, sp 15
texas: texas, ercot
pjm: pjm
midcontinent: miso, midcontinent
southwest_power_pool: spp, southwest power pool
new_york: nyiso, new york
new_england: iso ne, iso-ne, new england
united_states: united states, u s, us energy, national
""")

ROUTE_ENTITIES = (
    "diablo canyon", "henry hub", "brent", "wti", "np-15", "sp-15", "zp-26", "caiso", "ercot",
    "pjm", "miso", "spp", "nyiso", "iso-ne", "ferc", "nerc", "nrc", "eia",
)

LIVE_TERMS = ("right now", "currently", "today", "live", "this hour", "latest status")
CURRENT_TERMS = ("latest", "recent", "yesterday", "this week", "this month", "new ", "news")
EXPLAIN_TERMS = (
    "news", "latest development", "what happened", "why did", "why does", "why do", "why is",
    "why are", "why was", "why were", "what caused", "what is causing", "reason for", "outlook",
    "impact", "affect", "effect",
)
DOCUMENT_DOMAINS = ("transmission_regulation", "company_asset")
CROSS_SOURCE_DOMAINS = ("grid_reliability", "transmission_regulation", "company_asset")

# domain, provider, role, retrieval modes; in priority order within a domain
ROUTE_PROVIDERS = (
    ("electricity_markets", "iso_rto_structured_data", "controlling", ("api", "bulk_download")),
    ("electricity_markets", "eia_api", "corroborating", ("api",)),
    ("electricity_markets", "reliable_energy_news", "context", ("news_search",)),
    ("grid_reliability", "iso_rto_operational_data", "controlling", ("api", "official_web")),
    ("grid_reliability", "nerc", "controlling", ("official_document", "official_web")),
    ("grid_reliability", "noaa_nws", "causal_context", ("api", "official_web")),
    ("nuclear", "nrc_reactor_status", "controlling", ("official_web", "structured_report")),
    ("nuclear", "nrc_documents", "controlling", ("official_document",)),
    ("nuclear", "operator_primary_source", "corroborating", ("official_web", "company_release")),
    ("natural_gas", "eia_api", "controlling", ("api",)),
    ("natural_gas", "ferc_elibrary", "regulatory", ("official_document",)),
    ("natural_gas", "pipeline_primary_source", "operational", ("official_web",)),
    ("natural_gas", "reliable_energy_news", "context", ("news_search",)),
    ("petroleum", "eia_api", "controlling", ("api",)),
    ("petroleum", "government_statistics", "corroborating", ("api", "official_document")),
    ("petroleum", "reliable_energy_news", "context", ("news_search",)),
    ("coal", "eia_api", "controlling", ("api",)),
    ("coal", "government_statistics", "corroborating", ("official_document",)),
    ("renewables", "iso_rto_structured_data", "operational", ("api", "bulk_download")),
    ("renewables", "eia_api", "controlling", ("api",)),
    ("renewables", "noaa_nws", "weather_context", ("api",)),
    ("renewables", "operator_primary_source", "asset_context", ("official_web",)),
    ("energy_storage", "iso_rto_structured_data", "operational", ("api", "bulk_download")),
    ("energy_storage", "eia_api", "capacity", ("api",)),
    ("energy_storage", "operator_primary_source", "asset_context", ("official_web",)),
    ("weather", "noaa_nws", "controlling", ("api", "official_web")),
    ("weather", "iso_rto_operational_data", "market_impact", ("api",)),
    ("transmission_regulation", "ferc_elibrary", "controlling", ("official_document",)),
    ("transmission_regulation", "iso_rto_documents", "implementation", ("official_document", "official_web")),
    ("transmission_regulation", "nerc", "reliability", ("official_document",)),
    ("transmission_regulation", "reliable_energy_news", "context", ("news_search",)),
    ("company_asset", "company_primary_source", "controlling", ("company_release", "investor_relations")),
    ("company_asset", "sec_filings", "controlling", ("official_document",)),
    ("company_asset", "regulator_primary_source", "corroborating", ("official_document",)),
    ("company_asset", "reliable_energy_news", "context", ("news_search",)),
    ("emissions_carbon", "government_environment_data", "controlling", ("api", "official_document")),
    ("emissions_carbon", "market_operator_data", "market_data", ("api",)),
    ("emissions_carbon", "reliable_energy_news", "context", ("news_search",)),
    ("general_energy", "universal_energy_research", "discovery", ("official_web", "news_search")),
)

# ---- fixed values: market questions (substring rules, first hit wins) -----
MARKET_RULES = _labels("""
CAISO: caiso, np15, np-15, sp15, sp-15, diablo canyon
ERCOT: ercot, north hub, houston hub
PJM: pjm, western hub
MISO: miso
SPP: spp, south hub, north hub
NYISO: nyiso
ISO-NE: iso-ne, isone, new england
WEST: bpa, mid-c, palo verde, western
""")
INTENT_RULES = _labels("""
price: price, lmp, settle, settlement, day-ahead, day ahead, real-time, real time
generation: generation, capacity, running, output, diablo, nuclear, unit
outage: outage, offline, derate, trip
congestion: constraint, congestion, binding, shadow price, flowgate
gas: gas, pipeline, citygate, storage
weather: weather, temperature, heat, wind forecast
regulatory: ferc, cpuc, tariff, filing, rule
news: news, latest, what happened
""")
SOURCE_INTENT_RULES = (
    ("price", ("np15", "np-15", "sp15", "sp-15", "lmp", "price", "settle", "settlement",
               "day-ahead", "day ahead", "real-time", "real time")),
    ("generation", ("diablo", "generator", "unit ", "ramp down", "ramp up", "offline", "derate",
                    "nuclear", "plant output")),
    ("gas", ("socalgas", "so cal gas", "pg&e citygate", "pge citygate", "natural gas", "gas price",
             "henry hub", "citygate", "pipeline", "freeport lng", "lng", "ofo", "storage gas")),
    ("grid", ("constraint", "congestion", "transmission", "outage", "transmission line",
              "power line", "line outage", "transformer", "path 26", "path 15", "flowgate")),
    ("west", ("bpa", "pacw", "pace", "mid-c", "mid c", "malin", "palo verde", "northwest", "pnw",
              "western", "edam transfer")),
    ("weather", ("weather", "temperature", "heat", "cloud", "irradiance", "wind forecast")),
    ("regulatory", ("ferc", "cpuc", "cec", "tariff", "filing", "regulatory", "rule")),
)
INTENT_DOMAINS = _labels("""
price: caiso.com, ferc.gov, reuters.com, bloomberg.com, spglobal.com
generation: caiso.com, nrc.gov, pge.com, sce.com, sdge.com, reuters.com, bloomberg.com
grid: caiso.com, bpa.gov, ferc.gov, pge.com, sce.com, sdge.com, pacificorp.com
west: caiso.com, bpa.gov, pacificorp.com, ferc.gov, eia.gov, reuters.com, bloomberg.com
gas: socalgas.com, pge.com, eia.gov, caiso.com, spglobal.com, naturalgasintel.com, reuters.com, bloomberg.com
weather: noaa.gov, weather.gov, caiso.com, bpa.gov
regulatory: ferc.gov, cpuc.ca.gov, energy.ca.gov, caiso.com, eia.gov
general: caiso.com, ferc.gov, eia.gov, energy.ca.gov, cpuc.ca.gov, noaa.gov, weather.gov, bpa.gov, nrc.gov, pge.com, sce.com, sdge.com, socalgas.com, pacificorp.com, ladwp.com, smud.org, reuters.com, bloomberg.com, spglobal.com, woodmac.com, argusmedia.com, naturalgasintel.com
""")

# ---- fixed values: hub prices ---------------------------------------------
HUBS = (  # canonical name, display name, spellings
    ("TH_NP15_GEN-APND", "NP-15",
     ("np15", "np-15", "np 15", "north path 15", "northern california trading hub")),
    ("TH_SP15_GEN-APND", "SP-15",
     ("sp15", "sp-15", "sp 15", "south path 15", "southern california trading hub")),
    ("TH_ZP26_GEN-APND", "ZP-26", ("zp26", "zp-26", "zp 26", "zone path 26")),
)
PRICE_MARKETS = (  # market code, minutes, report, label, interval, question terms
    ("DAM", 60, "PRC_LMP", "day-ahead", "hourly",
     ("day ahead", "dayahead", "dam", "da price", "da prices", "da lmp")),
    ("FMM", 15, "PRC_FMM_LMP", "fifteen-minute", "15-minute",
     ("fifteen minute", "15 minute", "15 min", "fmm", "rt15")),
    ("RTM", 5, "PRC_INTVL_LMP", "real-time five-minute", "5-minute",
     ("real time", "realtime", "rtm", "5 minute", "5 min", "rt5")),
)
PRICE_ZONE = "America/Los_Angeles"
PRICE_COLUMNS = (  # logical field: accepted headers, first non-empty wins
    ("interval_start", _words("INTERVALSTARTTIME_GMT INTERVAL_START_GMT INTERVALSTARTTIME STARTTIME_GMT")),
    ("interval_end", _words("INTERVALENDTIME_GMT INTERVAL_END_GMT INTERVALENDTIME ENDTIME_GMT")),
    ("market", _words("MARKET_RUN_ID MARKET")),
    ("location", _words("NODE_ID_XML NODE_ID PNODE_RESMRID NODE LOCATION")),
    ("component", _words("LMP_TYPE XML_DATA_ITEM DATA_ITEM COMPONENT")),
    ("price", _words("MW VALUE LMP PRICE")),
    ("operating_date", _words("OPR_DT OPERATING_DATE")),
    ("operating_hour", _words("OPR_HR OPERATING_HOUR")),
    ("operating_interval", _words("OPR_INTERVAL OPERATING_INTERVAL INTERVAL")),
)
LMP_COMPONENTS = _words("LMP LMP_PRC LMP_PRICE LMP_CONG_ENE_LOSS")
ARCHIVE_MAX_BYTES = 25_000_000
ARCHIVE_MAX_MEMBERS = 20
ARCHIVE_MAX_MEMBER_BYTES = 50_000_000
CSV_ENCODINGS = _words("utf-8-sig utf-8 windows-1252")

# ---- fixed values: hourly operating series ---------------------------------
AUTHORITY_SPELLINGS = (
    ("CAISO", "CISO"), ("CISO", "CISO"), ("CALIFORNIA ISO", "CISO"), ("ERCOT", "ERCO"),
    ("ERCO", "ERCO"), ("PJM", "PJM"), ("MISO", "MISO"), ("SPP", "SWPP"), ("SWPP", "SWPP"),
    ("NYISO", "NYIS"), ("NYIS", "NYIS"), ("ISO-NE", "ISNE"), ("ISO NE", "ISNE"),
    ("ISONE", "ISNE"), ("ISNE", "ISNE"),
)
AUTHORITY_PATTERNS = (  # name, question pattern; listing order wins
    ("CAISO", r"\bcaiso\b|\bcalifornia iso\b"),
    ("ERCOT", r"\bercot\b|\btexas grid\b"),
    ("PJM", r"\bpjm\b"),
    ("MISO", r"\bmiso\b|\bmidcontinent\b"),
    ("SPP", r"\bspp\b|\bsouthwest power pool\b"),
    ("NYISO", r"\bnyiso\b|\bnew york iso\b"),
    ("ISO-NE", r"\biso[ -]?ne\b|\bnew england iso\b"),
)
METRIC_PATTERNS = (  # metric, label, question pattern; listing order wins
    ("DF", "day-ahead demand forecast", r"\bdemand forecast\b|\bload forecast\b|\bforecast demand\b"),
    ("NG", "net generation", r"\bnet generation\b|\bgeneration\b"),
    ("TI", "total interchange",
     r"\btotal interchange\b|\binterchange\b|\bnet imports?\b|\bnet exports?\b"),
    ("D", "demand", r"\bdemand\b|\bload\b"),
)
HOURLY_ENERGY_UNITS = _words("mwh megawatthours megawatthour")
NULL_TOKENS = _words("null none na n/a --")
STALE_AFTER_HOURS = 72

# ---- fixed values: bulk manifests and API pages ----------------------------
MANIFEST_CONTAINERS = _words(
    "files file data manifest manifests dataset datasets bulk bulk_files bulkfiles response results items")
MANIFEST_ID_KEYS = _words("identifier id")
MANIFEST_SET_KEYS = _words("data_set dataset datasetid name")
MANIFEST_TITLE_KEYS = _words("title description")
MANIFEST_URL_KEYS = _words("accessurl access_url downloadurl download_url file_url url link")
BULK_ROOT = "https://api.eia.gov/bulk/"
BULK_DOMAINS = ("eia.gov",)
PRICE_DOMAINS = ("oasis.caiso.com", "oasis.prod.caiso.com")
API_HOST = "api.eia.gov"
API_MAX_PAGE = 5000
API_MAX_ROWS = 100_000

# ---- fixed values: reactor reports -----------------------------------------
PLANTS = (("diablo canyon", "Diablo Canyon"), ("palo verde", "Palo Verde"))
MAX_POWER_PERCENT = 110

# ---- fixed values: evidence text -------------------------------------------
SEARCH_STOPWORDS = _words(
    "about after also are been before being can could data does for from have how into latest most"
    " new that the their there these this today what when where which will with would")
ANSWER_STOPWORDS = _words(
    "about after are can data does for from how in is latest of the their this to what when where"
    " which with")
TRACKING_PARAMETERS = _words(
    "fbclid gclid mc_cid mc_eid ref ref_src source utm_campaign utm_content utm_medium utm_source utm_term")
LOW_VALUE_PATTERN = (
    r"\blogin\b|\bregister\b|\bsign in\b|\baccount portal\b|\bprivacy policy\b|\bterms of use\b"
    r"|\bcontact us\b")
GENERIC_TITLES = ("homepage", "home", "welcome", "what's new")
ENERGY_TERMS = (
    "energy", "electricity", "power", "grid", "generator", "generation", "hydro", "solar", "wind",
    "natural gas", "oil", "lng", "transmission", "curtailment", "outage", "capacity", "demand",
    "load", "price",
)
CONTROLLING_DOMAINS = _words(
    "caiso.com ercot.com pjm.com misoenergy.org spp.org nyiso.com iso-ne.com eia.gov ferc.gov nrc.gov"
    " noaa.gov weather.gov nerc.com energy.gov epa.gov ca.gov")
AUTHORITATIVE_DOMAINS = _words("reuters.com sec.gov nasdaq.com nyse.com")
BLOCKED_TAGS = _words("script style noscript svg canvas template")
BREAK_TAGS = _words(
    "article aside blockquote br div footer h1 h2 h3 h4 h5 h6 header li main nav p section table td th tr")
BLOCK_TEXT_TAGS = _words(
    "p h1 h2 h3 h4 h5 h6 li td th caption article section main time title")
FINGERPRINT_CHARS = 12_000
PAGE_CHARS = 30_000
