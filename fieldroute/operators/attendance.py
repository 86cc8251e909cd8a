"""Attendance: who of the roster works a day, with replacements for those who worked and are not on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldroute.session import ship, shuffle_width


def attended(visits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key and engineer: most frequent center type and region of the day's work (the smaller of equals), and the turn of the first line in ``order``."""
    out = visits.groupBy(*keys, "engineer_code").agg(F.mode("center_type", True).alias("want_center"), F.mode("region_seq", True).alias("want_region"), F.min(F.struct(*order)).alias("first"))
    return out.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("first", "engineer_code"))).drop("first")


def replacements(actual: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """The keys (city and date), engineer_code, role and stands_for: as many of the roster as were at work.

    Who is on the roster and was at work is ``present``. Each of the others, in the order of their first line, is
    replaced by the best of those not chosen yet: same center, same region, same anchor region, most postal
    codes, largest share, code. Where the roster is too short, all of it works.
    """
    ship(actual.sparkSession)
    city, day = keys
    number = lambda x: 0 if pd.isna(x) else x
    width = shuffle_width(actual.sparkSession)
    rows = actual.withColumn("_month", F.trunc(day, "month"))
    staff = rows.select(city, "_month").distinct().join(roster, city).withColumnsRenamed({city: "at_city", "_month": "at_month"})

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {r.engineer_code: r for r in right.drop_duplicates("engineer_code").itertuples(index=False)}
        out, ranked = [], {}
        for date, df in left.sort_values([day, "turn"]).groupby(day, sort=False):
            codes = df["engineer_code"].tolist()
            taken, turn = set(codes), {}
            out += [(date, c, "present", None) for c in codes if c in known]
            for code, center, region in df[["engineer_code", "want_center", "want_region"]].itertuples(index=False):
                if code in known:
                    continue
                # Who stands in best does not depend on the day: the next of the order who is neither at work nor chosen.
                if (center, region) not in ranked:
                    ranked[center, region] = [r.engineer_code for r in sorted(known.values(), key=lambda r: (r.center_type != center, r.region_seq != region, r.anchor_region != region, -number(r.overlap), -number(r.ratio), r.engineer_code))]  # noqa: B023
                order, at = ranked[center, region], turn.get((center, region), 0)
                while at < len(order) and order[at] in taken:
                    at += 1
                turn[center, region] = at
                if at < len(order):
                    taken.add(order[at])
                    out.append((date, order[at], "replacement", code))
        return pd.DataFrame(out, columns=[day, "engineer_code", "role", "stands_for"]).assign(**{city: key[0]})[[city, day, "engineer_code", "role", "stands_for"]]

    left = rows.repartition(width, city, "_month").groupBy(city, "_month")
    right = staff.repartition(width, "at_city", "at_month").groupBy("at_city", "at_month")
    return left.cogroup(right).applyInPandas(run, f"{city} string, {day} date, engineer_code string, role string, stands_for string")
