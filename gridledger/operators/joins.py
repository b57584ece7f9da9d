"""Look-ups against dimensions.

No join carries a broadcast hint: dimensions are Arrow-backed local relations
of known size, so Catalyst broadcasts them itself and falls back to a shuffle
join (with runtime skew splitting) when a caller supplies a large table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger import dims
from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.text import display_name, norm_text, squeeze


def join_alias(df: DataFrame, dim: DataFrame, on: Column, alias: str, value: str) -> DataFrame:
    """Look up ``on`` among ``dim[alias]``; unmatched rows get a reject reason."""
    lookup = dim.select(F.col(alias).alias("_alias"), F.col(value).alias(value)).distinct()
    out = df.withColumn("_key", on).join(lookup, F.col("_key") == F.col("_alias"), "left")
    reason = F.when(F.col(value).isNull(), "unknown_alias")
    return out.withColumn("reject_reason", reason).drop("_key", "_alias")


def authority_key(c: Column) -> Column:
    """Spelling key of a grid authority: upper case, underscores as spaces."""
    return squeeze(F.replace(F.upper(c), F.lit("_"), F.lit(" ")))


def join_domain_dim(df: DataFrame, host: str, dim: DataFrame, fields: Sequence[str],
                    order: Sequence[str] = ("ord",), domain: str = "domain") -> DataFrame:
    """Attach the first dimension row whose domain equals the host or is a suffix.

    A suffix test is a theta join; cutting the host to the label counts that
    occur in the dimension turns it into one equi join per count and needs no
    regrouping of ``df``.
    """
    payload = F.struct(*order, *[f for f in fields if f not in order])
    best = (dim.groupBy(F.col(domain).alias("_domain"))
            .agg(F.min(payload).alias("_row"))
            .withColumn("_labels", F.size(F.split("_domain", r"\."))))
    counts = sorted(r[0] for r in best.select("_labels").distinct().collect())
    hits = []
    for n in counts:
        part = best.where(F.col("_labels") == n).select(
            F.col("_domain").alias(f"_key{n}"), F.col("_row").alias(f"_row{n}"))
        df = df.join(part, F.substring_index(host, ".", -n) == F.col(f"_key{n}"), "left").drop(f"_key{n}")
        hits.append(f"_row{n}")
    chosen = F.least(*hits) if len(hits) > 1 else F.col(hits[0])
    df = df.withColumn("_row", chosen)
    return df.withColumns({f: F.col(f"_row.{f}") for f in fields}).drop("_row", *hits)


def join_authority(df: DataFrame, host: str, authorities: DataFrame) -> DataFrame:
    """Authority tier and organisation of a host; listing order decides."""
    return join_domain_dim(df, host, authorities, ("tier", "organization"))


def join_provider(df: DataFrame, host: str, providers: DataFrame) -> DataFrame:
    """Provider of a host; the lowest (rank, name) wins."""
    flat = providers.select("*", F.explode("domains").alias("domain"))
    return join_domain_dim(df, host, flat, ("authority_rank", "provider_name", "provider_id"),
                           order=("authority_rank", "provider_name"))


def match_word_terms(texts: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """Whole-word matches of a vocabulary table (label, term) in texts.

    A term of n words matches when it equals one of the text's n-word runs, so
    the theta join becomes an equi join on the run.
    """
    terms = vocab.select("label", norm_text(F.col("term")).alias("term")).where("term <> ''").distinct()
    sizes = sorted(r[0] for r in terms.select(F.size(F.split("term", " "))).distinct().collect())
    words = F.col("_words")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(
            starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
                F.array().cast("array<string>"))

    split = compute_once(texts.select(key, text), {"_words": F.split(norm_text(F.col(text)), " ")})
    grams = split.select(key, F.explode(F.array_distinct(F.flatten(
        F.array(*[runs(n) for n in sizes])))).alias("term"))
    return grams.join(terms, "term").select(key, "label", "term")


def join_price_window(intervals: DataFrame, queries: DataFrame) -> DataFrame:
    """Intervals of each query's hub, market and local day.

    The window of a market day is exactly the intervals whose local date is that
    day, so the range join is an equi join on (location, market, market_date).
    """
    return queries.join(intervals, ["location", "market", "market_date"])


def join_latest_series(questions: DataFrame, latest: DataFrame, key: str = "series_id") -> DataFrame:
    """Latest observation of each question's series; a missing one is a reject."""
    out = questions.join(latest.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumn("reject_reason", F.when(F.col("_found").isNull(), "series_not_found")).drop("_found")


#: Letters of the pieces that index names.
GRAM = 3


def _grams(text: str, size: Column) -> Column:
    """Distinct pieces of ``size`` letters of a text at least that long."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, size)))


def match_plants(questions: DataFrame, units: DataFrame, query: str = "plant_query") -> DataFrame:
    """Units of each asked plant: exact normalised name, else names containing it.

    "Contains" is solved on the distinct names by an inverted index of their pieces of up to ``GRAM``
    letters, so index rows are linear in a name's length. A query looks up its rarest
    piece, and each name found there is compared with the whole query. Only the better
    tier of a query is kept.
    """
    asked = questions.select(norm_text(F.col(query)).alias("_query")).distinct().where("_query <> ''")
    names = units.select(norm_text(F.col("unit_name")).alias("_name")).distinct()
    sizes = F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("_name"))), lambda n: _grams("_name", n))
    index = names.where("_name <> ''").select("_name", F.explode(F.flatten(sizes)).alias("_gram"))
    pieces = asked.select("_query", F.explode(_grams("_query", F.least(F.lit(GRAM), F.length("_query")))).alias("_gram"))
    counts = index.groupBy("_gram").agg(F.count("*").alias("_names"))
    # A query with a piece that no name has matches nothing.
    rarest = (pieces.join(counts, "_gram", "left").groupBy("_query")
              .agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_gram")).alias("_least"))
              .where("_least.n > 0").select("_query", F.col("_least._gram").alias("_gram")))
    pairs = rarest.join(index, "_gram").where(F.contains("_name", "_query")).select("_query", "_name").withColumn(
        "tier", F.when(F.col("_name") == F.col("_query"), 1).otherwise(2))
    best = pairs.groupBy("_query").agg(F.min("tier").alias("tier"))
    pairs = pairs.join(best, ["_query", "tier"])
    found = units.withColumn("_name", norm_text(F.col("unit_name"))).join(pairs, "_name").drop("_name")
    return questions.withColumn("_query", norm_text(F.col(query))).join(found, "_query").drop("_query")


def provider_matches(include_licensed: Column | bool = False) -> Column:
    """Ids of the providers serving a classified question, best first.

    Needs ``commodity, topic, geography, capabilities``. Eleven providers against
    one row is a projection, so no join and no shuffle.
    """
    licensed = include_licensed if isinstance(include_licensed, Column) else F.lit(include_licensed)
    rows = sorted(dims.provider_rows(), key=lambda p: (p[2], not p[3], p[1]))
    hits = []
    for pid, _, _, _, access, _, commodities, topics, places, capabilities, _ in rows:
        ok = (
            (F.col("commodity").isin(*commodities) | (F.col("commodity") == "unknown"))
            & (F.col("topic").isin(*topics) | (F.col("topic") == "general"))
            & (F.col("geography").isin(*places) | (F.col("geography") == "unknown")
               | F.lit("global" in places))
            & F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in capabilities])))
        if access == "optional_licensed":
            ok = ok & licensed
        hits.append(F.when(ok, F.lit(pid)))
    return F.array_compact(F.array(*hits))


def match_providers(questions: DataFrame, include_licensed: bool = False) -> DataFrame:
    return questions.withColumn("providers", provider_matches(include_licensed))


def match_sources(questions: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy sources for (market, intent), ordered by (rank, name), as an array.

    The policy is expanded to its market-intent pairs and folded per pair first,
    so each question meets one row.
    """
    pairs = policy.select("source_id", "source_name", "authority_rank",
                          F.explode("markets").alias("market"), "intents").withColumn(
                              "intent", F.explode("intents"))
    folded = pairs.groupBy("market", "intent").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("authority_rank", "source_name", "source_id"))), lambda s: s["source_id"]).alias("sources"))
    out = questions.join(folded, ["market", "intent"], "left")
    return out.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def missing_sources(claim_sources: DataFrame, sources: DataFrame,
                    key: str = "answer_id") -> DataFrame:
    """Cited ids that are not among the answer's sources."""
    return claim_sources.join(sources.select(key, "source_id").distinct(), [key, "source_id"], "left_anti")


def validate_requests(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Check API requests against their route's metadata; ``errors`` is empty when valid."""
    ids = lambda c: F.transform(c, lambda s: s["id"])
    routes = catalog.select("route", ids("frequencies").alias("_freqs"), ids("facets").alias("_facets"),
                            ids("data_columns").alias("_cols"))
    joined = requests.join(routes, "route", "left")

    def unknown(asked: str, known: str, text: str) -> Column:
        extra = F.array_sort(F.array_except(asked, known))
        return F.when(F.size(extra) > 0, F.concat(F.lit(f"{text}: "), F.array_join(extra, ", ")))

    errors = F.array(
        F.when(F.col("_cols").isNull(), "unknown route"),
        F.when((F.size("_freqs") > 0) & ~F.array_contains("_freqs", F.col("frequency")),
               "unsupported frequency"),
        unknown("data_columns", "_cols", "unsupported columns"),
        unknown("facets", "_facets", "unsupported facets"),
        F.when(F.col("offset") < 0, "negative offset"),
        F.when(~F.col("length").between(1, fv.API_MAX_PAGE), "page length out of range"),
        F.when(F.exists("sort_directions", lambda d: ~F.lower(d).isin("asc", "desc")),
               "unsupported sort direction"))
    return joined.withColumn("errors", F.array_compact(errors)).drop("_freqs", "_facets", "_cols")


def restrict_domains(questions: DataFrame, intent: str = "source_intent") -> DataFrame:
    """Allowed domains of an intent; unknown intents use the general list."""
    def listed(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in dict.fromkeys(names)])

    table = dict(fv.INTENT_DOMAINS)
    out = listed(table["general"])
    for name, names in table.items():
        if name != "general":
            out = F.when(F.col(intent) == name, listed(names)).otherwise(out)
    return questions.withColumn("allowed_domains", out)


def plant_display(query: Column) -> Column:
    return display_name(query)
