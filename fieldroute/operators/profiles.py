"""The coverage profile brought up to date: engineers by postal code and their slots, after the work that was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.functions.text import postal_padded
from fieldroute.operators.relational import keep_first

#: Slots of an engineer without an entry, and centers that count as active.
DEFAULT_SLOT, ACTIVE_CENTERS = 7, ("DMS", "DMS2")
PLACE = ["postal_code", "city", "center_type"]
AREA = ["area_code", "area_name", "ship_to", "department"]


def _trimmed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in columns if c in df.columns})


def primary_areas(coverage: DataFrame) -> DataFrame:
    """The area of each postal code, city and type of center with the most coverage rows; of equals the first by name, code and the rest."""
    counts = coverage.groupBy(*PLACE, *AREA).agg(F.count(F.lit(1)).alias("_rows"))
    return keep_first(counts, PLACE, [F.col("_rows").desc(), F.col("area_name"), F.col("area_code"), F.col("ship_to"), F.col("department")]).drop("_rows")


def synced_profile(coverage: DataFrame, slots: DataFrame, services: DataFrame) -> dict[str, DataFrame]:
    """New coverage, slots, unmatched engineers and a summary (metric, value) from a profile and service rows.

    ``coverage`` has postal code, city, type of center, area columns and engineer_code; ``slots`` ship_to, engineer_code,
    engineer_name, slot and city; ``services`` engineer_code, engineer_name, postal code, city and type of center. An engineer
    is active by a service row of an active center with a code and a postal code; their name, city and center are the
    first by city, name and center. Coverage is the primary area of every place where an active engineer worked. Slots
    keep the active engineers' rows, the first by ship_to, slot, name and city of several, and add the default for the rest. Null text is blank.
    """
    coverage = _trimmed(coverage, [*AREA, "city", "center_type", "postal_code", "engineer_code"])
    coverage = coverage.withColumn("postal_code", postal_padded(F.col("postal_code")))
    slots = _trimmed(slots, ["ship_to", "engineer_code", "engineer_name", "city"]).select("ship_to", "engineer_code", "engineer_name", "slot", "city")
    services = _trimmed(services, ["engineer_code", "engineer_name", "city", "center_type", "postal_code"]).where(F.col("center_type").isin(*ACTIVE_CENTERS) & (F.col("engineer_code") != "") & (F.col("postal_code") != ""))
    # One row for each engineer and place: all that follows works on these.
    worked = services.withColumn("postal_code", postal_padded(F.col("postal_code"))).select(*PLACE, "engineer_code", "engineer_name").distinct()
    areas = primary_areas(coverage)
    new = areas.join(worked.drop("engineer_name").distinct(), PLACE)
    active = worked.select("engineer_code", "city", "engineer_name", "center_type").distinct()
    active = keep_first(active, ["engineer_code"], [F.col("city"), F.col("engineer_name"), F.col("center_type")])
    codes = active.select("engineer_code")
    kept = keep_first(slots.join(codes, "engineer_code", "left_semi"), ["engineer_code"], [F.col(c).asc_nulls_last() for c in ("ship_to", "slot", "engineer_name", "city")])
    added = active.join(slots.select("engineer_code").distinct(), "engineer_code", "left_anti")
    added = added.select(F.lit("").alias("ship_to"), "engineer_code", "engineer_name", F.lit(DEFAULT_SLOT).alias("slot"), "city")
    unmatched = active.join(new.select("engineer_code").distinct(), "engineer_code", "left_anti")
    updated = kept.select(*added.columns).unionByName(added)

    def row(name: str, df: DataFrame, count) -> DataFrame:
        return df.agg(count.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    rows, heads = F.count(F.lit(1)), F.countDistinct("engineer_code")
    gone = lambda df: df.join(codes, "engineer_code", "left_anti")
    parts = [
        row("active_engineers", active, rows), row("coverage_rows", new, rows), row("coverage_engineers", new, heads), row("primary_area_postals", areas, F.countDistinct("postal_code")), row("slot_rows", updated, rows),
        row("slots_added", added, rows), row("coverage_engineers_removed", gone(coverage), heads), row("slot_engineers_removed", gone(slots), heads), row("engineers_unmatched", unmatched, rows),
    ]
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.unionByName(p)
    return {"coverage": new, "slots": updated, "unmatched": unmatched, "summary": summary}
