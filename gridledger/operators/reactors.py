"""Plant status from unit rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.operators.joins import plant_display


def plant_status(matches: DataFrame, keys: tuple[str, ...] = ("question_id",),
                 query: str = "plant_query") -> DataFrame:
    """full, offline or reduced per question, with the ordered unit list.

    A plant has a handful of units per report, which bounds the collected list.
    """
    units = F.array_sort(F.collect_list(F.struct("pos", "unit_name", "power_percent")))
    out = matches.groupBy(*keys, query).agg(
        F.bool_and(F.col("power_percent") >= 100).alias("_full"),
        F.bool_and(F.col("power_percent") == 0).alias("_off"),
        F.count("*").alias("unit_count"), units.alias("_units"))
    out = out.withColumns({
        "plant_state": F.when(F.col("_full"), "full").when(F.col("_off"), "offline").otherwise("reduced"),
        "unit_summary": F.array_join(F.transform("_units", lambda u: F.concat(
            u["unit_name"], F.lit(": "), u["power_percent"], F.lit("%"))), ", "),
        "plant_name": plant_display(F.col(query))})
    state = F.col("plant_state")
    direct = F.concat(
        F.when(state == "full", "Yes. ").otherwise("No. "), F.col("plant_name"),
        F.when(state == "full", " was reported at full power in the latest NRC status report.")
        .when(state == "offline", " was reported offline in the latest NRC status report.")
        .otherwise(" was not operating at full power in the latest NRC status report."))
    explain = F.concat(
        F.lit("The NRC listed "), F.col("unit_summary"),
        F.lit(". These values represent reported reactor power as a percentage of rated power."))
    return out.withColumns({"direct_answer": direct, "simple_explanation": explain}).drop(
        "_full", "_off", "_units")
