"""Reactor-status questions end to end."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.text import has_word, norm_text
from gridledger.operators.joins import match_plants
from gridledger.operators.reactors import plant_status
from gridledger.session import cut_lineage
from gridledger.sources.reactors import parse_reactor_tables


def plant_query(question: Column) -> Column:
    """Plant a question names: a routed entity first, then any listed plant."""
    entity = F.lit(None).cast("string")
    mention = F.lit(None).cast("string")
    for name, display in reversed(fv.PLANTS):
        if name in fv.ROUTE_ENTITIES:
            entity = F.when(has_word(norm_text(question), name), display).otherwise(entity)
        mention = F.when(F.lower(question).contains(name), display).otherwise(mention)
    return F.coalesce(entity, mention)


def latest_report(units: DataFrame) -> DataFrame:
    """Unit rows of the newest dated report; of several with one date, the highest id. The units are parsed once: a task
    lets none but those of its own newest report go."""
    place = F.rank().over(Window.orderBy(F.desc("report_date"), F.desc("page_id")))
    dated = units.where("report_date is not null and page_id is not null")
    return dated.withColumn("_place", place).where("_place = 1").drop("_place")


def newest_units(reports: DataFrame) -> DataFrame:
    """Units of the newest report: its page is chosen by date before any page is parsed."""
    newest = reports.where("report_date is not null").agg(F.max_by("page_id", F.struct("report_date", "page_id")).alias("page_id"))
    page = reports.join(newest, "page_id")
    return parse_reactor_tables(page).join(page.select("page_id", "report_date"), "page_id")


def answer_reactors(questions: DataFrame, reports: DataFrame) -> DataFrame:
    """Status of the asked plant in the latest of the landed ``reports`` (page_id, html, report_date).

    The report is one page of units; it is checkpointed because matching reads it
    several times. Questions without a plant take no part in the join.
    """
    asked = compute_once(questions, {"plant_query": plant_query(F.col("question"))})
    known = asked.where("plant_query is not null")
    matches = match_plants(known.select("plant_query").distinct(), cut_lineage(newest_units(reports)))
    status = plant_status(matches, ("report_date",)).drop("unit_count")
    out = known.join(status, "plant_query", "left").unionByName(
        asked.where("plant_query is null"), allowMissingColumns=True)
    clarify, found = F.col("plant_query").isNull(), F.col("plant_state").isNotNull()
    return out.withColumns({
        "status": F.when(clarify, "needs_clarification").when(found, "answered").otherwise("held"),
        "confidence": F.when(found, "high").otherwise("insufficient"),
        "direct_answer": F.when(clarify, "Please specify the nuclear plant or reactor unit.").when(
            found, F.col("direct_answer")).otherwise("No reactor-status rows matched the plant.")})
