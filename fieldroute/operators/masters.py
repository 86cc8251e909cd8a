"""Master tables: their columns and keys, upserts that keep what a table fixes once, checks of their rules, and how they are filled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.functions.text import blank_null_words, collapse, postal_key, postal_padded
from fieldroute.operators.relational import keep_first


@dataclass(frozen=True)
class Master:
    """Columns as a schema (``not null`` where a value must be there), the primary key, another unique key, and defaults as SQL."""

    columns: str
    key: tuple[str, ...]
    unique: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    #: Whether a row tells when it was first and last written.
    stamped: bool = True


#: The context that every city's rows share, and the tables with their keys.
CONTEXT = ("subsidiary_name", "strategic_city_name")
_CONTEXT = "subsidiary_name string not null, strategic_city_name string not null"
MASTERS = {
    "routing_config": Master(
        f"{_CONTEXT}, distance_backend string, service_time_per_job_min int, max_work_min_per_sm_day int, max_travel_min_per_sm_day int, max_travel_km_per_sm_day int, effective_service_per_sm int, target_sm_per_region int, timezone_offset string",
        CONTEXT, defaults={"timezone_offset": "'-04:00'"},
    ),
    "region": Master(f"{_CONTEXT}, postal_code string not null, region_seq int not null, region_name string not null, region_center_latitude double, region_center_longitude double", (*CONTEXT, "postal_code")),
    "technician": Master(
        f"{_CONTEXT}, employee_code string not null, employee_name string not null, center_type string, home_address string, home_city string, home_state string, home_country string, home_postal_code string, home_latitude double, home_longitude double, active_flag boolean not null",
        (*CONTEXT, "employee_code"), defaults={"active_flag": "true"},
    ),
    "capability": Master(
        f"{_CONTEXT}, employee_code string not null, product_group_code string not null, product_code string not null, repair_allowed boolean not null, heavy_repair_allowed boolean not null, priority_score int, effective_start_date date, effective_end_date date",
        (*CONTEXT, "employee_code", "product_group_code", "product_code"), defaults={"repair_allowed": "true", "heavy_repair_allowed": "true"},
    ),
    "heavy_rule": Master("product_group_code string not null, product_code string not null, detailed_symptom_code string not null", ("product_group_code", "product_code", "detailed_symptom_code"), stamped=False),
    "job": Master(
        f"record_id string not null, {_CONTEXT}, svc_engineer_code string, service_product_group_code string, service_product_code string, receipt_detail_symptom_code string, gsfs_receipt_no string not null, promise_date string not null, postal_code string, latitude double, longitude double, source string",
        ("record_id",), (*CONTEXT, "gsfs_receipt_no"),
    ),
    "request": Master(f"request_id string not null, {_CONTEXT}, promise_date string not null, routing_job_id string, routing_status string, payload_json string, status_json string", ("request_id",)),
    "result": Master("request_id string not null, routing_job_id string, result_json string", ("request_id",)),
}
PRIORITY = 100
STAMPS = ("created_at", "updated_at")


def _fields(df: DataFrame, master: Master):
    return df.sparkSession.createDataFrame([], master.columns).schema.fields


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a master table in their order and types: defaults where ``df`` lacks one or is null, other columns go.

    A value that is no number or date where one is wanted is null. Stamps are kept where they are there.
    """
    master = MASTERS[name]

    def column(f):
        value = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return F.coalesce(value, F.expr(master.defaults[f.name])) if f.name in master.defaults else value

    stamps = [F.col(c).cast("timestamp") if c in df.columns else F.lit(None).cast("timestamp").alias(c) for c in STAMPS] if master.stamped else []
    return df.select(*[column(f).alias(f.name) for f in _fields(df, master)], *stamps)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a rule of the table, counted: (rule, broken), all rules included.

    A rule is ``not null COLUMN``, ``key`` or ``unique``; of a repeated key every row counts.
    """
    master = MASTERS[name]
    rows = conform(df, name)
    needed = [f.name for f in _fields(df, master) if not f.nullable]
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed])
    out = nulls.select(F.explode(F.create_map(*[x for c in needed for x in (F.lit(f"not null {c}"), F.col(c))])).alias("rule", "broken"))
    for rule, key in (("key", master.key), ("unique", master.unique)):
        if key:
            repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            out = out.unionByName(repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken")).select(F.lit(rule).alias("rule"), "broken"))
    return out


def put(existing: DataFrame | None, new: DataFrame, name: str, now=None) -> DataFrame:
    """A master table with new rows in place of those that share their key: one exchange, by the key.

    ``created_at`` stays that of the row replaced, ``updated_at`` is ``now``, and what the table held under
    its unique key goes with the new row that has it (its record id is then the older one). Of several new
    rows with one key the first by all columns stays. A null where the table wants a value fails the job.
    """
    master = MASTERS[name]
    now = F.current_timestamp() if now is None else now
    named = [f.name for f in _fields(new, master)]
    strict = {f.name: F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{name}: {f.name} is null")).cast(f.dataType)) for f in _fields(new, master) if not f.nullable}
    both = conform(new, name).withColumns(strict).withColumn("_old", F.lit(0))
    if master.stamped:
        both = both.withColumns({"created_at": now, "updated_at": now})
    if existing is not None:
        both = both.unionByName(conform(existing, name).withColumn("_old", F.lit(1)))
    key = list(master.unique or master.key)
    rest = [c for c in both.columns if c not in key]
    # The smallest is a new row where there is one; the largest is an old row where there is one.
    picked = both.groupBy(*key).agg(F.min(F.struct("_old", *[c for c in rest if c != "_old"])).alias("row"), F.max(F.struct("_old", *[c for c in rest if c != "_old"])).alias("was"))
    kept = {c for c in (*(master.key if master.unique else ()), *(("created_at",) if master.stamped else ())) if c not in key}
    value = {c: F.when(F.col("was._old") == 1, F.col(f"was.{c}")).otherwise(F.col(f"row.{c}")) if c in kept else F.col(f"row.{c}") for c in rest}
    return picked.select(*[(F.col(c) if c in key else value[c]).alias(c) for c in (*named, *(STAMPS if master.stamped else ()))])


def in_context(df: DataFrame, subsidiary: str, city: str) -> DataFrame:
    """The rows of one city."""
    return df.where((F.col(CONTEXT[0]) == subsidiary) & (F.col(CONTEXT[1]) == city))


def _clean(c: str):
    return blank_null_words(collapse(F.col(c).cast("string")))


def technicians(slots: DataFrame, addresses: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows of the technician table from slots with their context, addresses by code and name, and home coordinates by code.

    Blank or missing text is blank, the type of center upper-cased, the postal code without zeros in front. Of several
    addresses or homes of one technician the first by all columns counts.
    """
    who, text = ["employee_code", "employee_name"], ["home_address", "home_city", "home_state"]
    slots = slots.withColumns({c: _clean(c) for c in (*who, *CONTEXT, "center_type")}).withColumn("center_type", F.upper("center_type"))
    addresses = addresses.withColumns({c: _clean(c) for c in (*who, *text)}).withColumn("home_postal_code", postal_key(F.col("home_postal_code").cast("string"))).select(*who, *text, "home_postal_code")
    addresses = addresses.groupBy(*who).agg(F.min(F.struct(*text, "home_postal_code")).alias("a")).select(*who, "a.*")
    homes = homes.groupBy(_clean("employee_code").alias("employee_code")).agg(F.min(F.struct("home_latitude", "home_longitude")).alias("h")).select("employee_code", "h.*")
    rows = slots.select(*CONTEXT, *who, "center_type").join(addresses, who, "left").join(homes, "employee_code", "left")
    return conform(rows.fillna("", [*text, "home_postal_code"]).withColumn("home_country", F.lit("USA")), "technician").drop(*STAMPS)


def capabilities(products: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of the capability table: repair where the flag is T; heavy repair unless the group is REF and the area's flag N.

    Of several rows with one key the first by repair flag and area flag stays (nulls first). Rows are dealt
    once, by employee and product, over ``tasks`` (the session's width if none are given).
    """
    key = list(MASTERS["capability"].key)
    # Equal rows go first, by a hash: a key has few pairs of flags, so that the sort meets few rows however often a job recurs.
    rows = products.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in key], "repair_flag", "area_product_flag")
    rows = keep_first(rows.repartition(*([tasks] if tasks else []), "employee_code", "product_group_code", "product_code").distinct(), key, [F.col("repair_flag"), F.col("area_product_flag")])
    is_flag = lambda c, flag: F.coalesce(F.upper(c) == flag, F.lit(False))
    heavy = ~((F.col("product_group_code") == "REF") & is_flag(F.col("area_product_flag"), "N"))
    return rows.select(*key, is_flag(F.col("repair_flag"), "T").alias("repair_allowed"), heavy.alias("heavy_repair_allowed"), F.lit(PRIORITY).alias("priority_score"))


def region_rows(regions: DataFrame, services: DataFrame) -> DataFrame:
    """Rows of the region table, the first of each postal code, with the mean place of the region's located services.

    ``regions`` has the context, postal code, region_seq and region_name; a service counts for every region that
    has its postal code. Regions without a located service have no centre.
    """
    regions = regions.withColumn("postal_code", postal_padded(F.col("postal_code")))
    placed = services.where("latitude is not null and longitude is not null").withColumn("postal_code", postal_padded(F.regexp_replace("postal_code", r"\.0+$", "")))
    # Sums by postal code first: the join then meets a row a code.
    sums = placed.groupBy("postal_code").agg(F.sum("latitude").alias("lat"), F.sum("longitude").alias("lon"), F.count(F.lit(1)).alias("n"))
    centre = regions.select(*CONTEXT, "postal_code", "region_seq").distinct().join(sums, "postal_code").groupBy(*CONTEXT, "region_seq")
    centre = centre.agg((F.sum("lat") / F.sum("n")).alias("region_center_latitude"), (F.sum("lon") / F.sum("n")).alias("region_center_longitude"))
    first = keep_first(regions, [*CONTEXT, "postal_code"], [F.col("region_seq"), F.col("region_name")])
    return first.select(*CONTEXT, "postal_code", "region_seq", "region_name").join(centre, [*CONTEXT, "region_seq"], "left")


def heavy_rules(lookup: DataFrame) -> DataFrame:
    """Rows of the rule table: distinct trimmed codes whose symptom is neither null nor blank."""
    key = MASTERS["heavy_rule"].key
    return lookup.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in key]).where("detailed_symptom_code <> ''").distinct()


def config_row(spark, config: dict) -> DataFrame:
    """The row of the routing configuration from a parsed file: ``defaults`` names the context, ``routing_seed`` holds the values."""
    columns = [f.name for f in spark.createDataFrame([], MASTERS["routing_config"].columns).schema.fields]
    values = {**config.get("routing_seed", {}), **{c: config.get("defaults", {}).get(c) for c in CONTEXT}}
    text = [None if values.get(c) is None else str(values[c]) for c in columns]
    return conform(spark.createDataFrame([tuple(text)], ", ".join(f"{c} string" for c in columns)), "routing_config").drop(*STAMPS)


#: The columns of the product master, and those that must hold a code.
PRODUCT_COLUMNS = ("product_group_name", "product_group_code", "product_name", "product_code", "symptom_name", "symptom_code", "symptom_type_name", "symptom_type_code", "detailed_symptom_name", "detailed_symptom_code")
PRODUCT_CODES = ("product_group_code", "product_code", "detailed_symptom_code")


def product_master(df: DataFrame) -> DataFrame:
    """Distinct trimmed rows with all three codes; null names are blank, other columns go."""
    return df.dropna(subset=list(PRODUCT_CODES)).select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in PRODUCT_COLUMNS]).distinct()


def with_product_names(jobs: DataFrame, master: DataFrame) -> DataFrame:
    """Jobs with the names of product and symptom, null where the master has none; a job stays one row.

    Both are looked up by key: the names of a product by group and product code, those of a symptom by all
    three codes, each the first by its names where a code has several.
    """
    product, symptom = ["product_group_name", "product_name"], ["detailed_symptom_name", "symptom_name", "symptom_type_name"]
    for key, names in ((PRODUCT_CODES[:2], product), (PRODUCT_CODES, symptom)):
        lookup = master.groupBy(*key).agg(F.min(F.struct(*names)).alias("_names"))
        jobs = jobs.join(lookup, list(key), "left").select(*jobs.columns, *[F.col(f"_names.{c}").alias(c) for c in names])
    return jobs


#: Slots of an engineer without a number, the flag of one without a flag, and the center that is always in.
ENGINEER_SLOTS, ENGINEER_FLAG, OWN_CENTER = 8, "Y", "DMS"


def engineer_master(assigned: DataFrame, homes: DataFrame, contractors: bool = True) -> DataFrame:
    """Engineers with their region, slots, heavy-repair flag and first home (by latitude, longitude); only own ones without ``contractors``.

    Text that is no number is null, a region too; every row of ``assigned`` stays.
    """
    first = homes.groupBy("engineer_code").agg(F.min(F.struct("home_lat", "home_lon")).alias("h")).select("engineer_code", "h.*")
    numbers = {c: F.col(c).try_cast("double").cast("int") for c in ("region_seq", "anchor_region_seq") if c in assigned.columns}
    rows = assigned.withColumns(numbers | {"slot": F.coalesce(F.col("slot").try_cast("double"), F.lit(ENGINEER_SLOTS)).cast("int"), "ref_heavy": F.upper(F.coalesce(F.col("ref_heavy"), F.lit(ENGINEER_FLAG))), "center_type": F.upper("center_type")})
    rows = rows if contractors else rows.where(F.col("center_type") == OWN_CENTER)
    return rows.join(first, "engineer_code", "left")
