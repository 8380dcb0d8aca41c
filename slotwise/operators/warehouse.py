"""The order-level KPI table: geo zones, order KPIs, revenue and profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.config import OrderScope
from slotwise.functions.geo import geo_point, zone_contains, zone_index
from slotwise.functions.scalars import day_number, weekday_name
from slotwise.operators.joins import join_dimension

ZONE_KEYS = ["entity_id", "country_code", "zone_id"]


def scan_nested(countries: DataFrame) -> DataFrame:
    """Every platform, city and zone of every country; missing or empty arrays give NULLs.

    Platforms and zones are two independent arrays, so their pairs come out per country.
    """
    return (
        countries.select("country_code", F.explode_outer("platforms").alias("p"), "cities")
        .select("country_code", "p", F.explode_outer("cities").alias("ci"))
        .select("country_code", "p", "ci", F.explode_outer("ci.zones").alias("zo"))
        .select(
            F.col("p.entity_id").alias("entity_id"), "country_code",
            F.col("ci.name").alias("city_name"), F.col("ci.id").alias("city_id"),
            F.col("ci.is_active").alias("city_is_active"),
            F.col("zo.shape").alias("zone_shape"), F.col("zo.name").alias("zone_name"),
            F.col("zo.id").alias("zone_id"), F.col("zo.is_active").alias("zone_is_active"),
        )
    )


def geo_zones(countries: DataFrame, scope: OrderScope) -> DataFrame:
    """Active zones of active cities of the scope's entities."""
    return (
        scan_nested(countries)
        .where(
            F.col("entity_id").isin(*scope.entity_ids)
            & (F.col("country_code") != scope.excluded_country)
            & F.col("zone_is_active") & F.col("city_is_active"))
        .drop("zone_is_active", "city_is_active")
    )


def entity_platforms(entities: DataFrame, scope: OrderScope) -> DataFrame:
    """Region and country of the scope's entities; an entity listed twice comes out twice."""
    return (
        entities.select("region", "country_iso", "country_name", F.explode_outer("platforms").alias("p"))
        .select("region", F.col("p.entity_id").alias("entity_id"), "country_iso", "country_name")
        .where(F.col("entity_id").isin(*scope.entity_ids))
    )


def entity_region(entities: DataFrame, sessions: DataFrame, scope: OrderScope) -> DataFrame:
    """entity_platforms, only for entities that have sessions."""
    # The scope's filter reaches the scan before the distinct; one entity in many rows combines there.
    seen = sessions.where(F.col("entity_id").isin(*scope.entity_ids)).select("entity_id").distinct()
    return entity_platforms(entities, scope).join(seen, "entity_id")


def semi_join_entities(sessions: DataFrame, zones: DataFrame) -> DataFrame:
    """Sessions of entities that have a geo zone."""
    ids = zones.select("entity_id").distinct()
    return join_dimension(sessions, ids, ["entity_id"], "left_semi")


def small_order_fee(gfv: Column, minimum: Column, fee: Column) -> Column:
    """Nothing at or above the minimum order value; else the fee, or what is missing to the minimum.

    An unknown comparison goes to the fee.
    """
    return F.when(gfv - minimum >= 0, F.lit(0.0)).otherwise(F.coalesce(fee, minimum - gfv))


def delivery_fee_paid(
    region: Column, table_fee: Column, by_discount: Column, by_voucher: Column, fee: Column, table_regions: tuple[str, ...]
) -> Column:
    """Delivery fee that the customer paid; NULL where the region is unknown."""
    own = F.when(by_discount | by_voucher, F.lit(0.0)).otherwise(fee)
    in_table = region.isin(*table_regions)
    return F.when(in_table, F.coalesce(table_fee, own)).when(~in_table, own)


def sessions_in_scope(sessions: DataFrame, scope: OrderScope) -> DataFrame:
    """Sent orders of the scope. Dates, scheme and flag reach the scan as pushed filters."""
    return sessions.where(
        F.col("created_date").between(F.lit(scope.start_date), F.lit(scope.end_date))
        & (F.col("vendor_price_scheme_type") == scope.price_scheme)
        & F.col("is_sent")
        & F.col("assignment_id").cast("bigint").isin(*scope.asa_ids)
        & F.col("entity_id").isin(*scope.entity_ids))


def points_in_zones(points: DataFrame, zones: DataFrame, point: str) -> DataFrame:
    """Rows whose point (a STRUCT<lon, lat> column) lies inside the zone they name, with the zone's shape.

    Equi-join on the zone first, then the box, then the edges near the point. A zone listed
    twice gives a row twice. Pass a stored or staged zone table: its size is then known, so that
    Spark can broadcast it, and its shapes are not put together again.
    """
    indexed = zones.select(*ZONE_KEYS, "zone_shape", zone_index("zone_shape").alias("_zone_index"))
    joined = join_dimension(points, indexed, ZONE_KEYS)
    return joined.where(zone_contains("_zone_index", f"{point}.lon", f"{point}.lat")).drop("_zone_index")


def order_kpis(
    sessions: DataFrame, locations: DataFrame, paid_fees: DataFrame, zones: DataFrame, entities: DataFrame,
    scope: OrderScope,
) -> DataFrame:
    """Orders delivered inside the zones of the scope, with all KPI components.

    Every big table is filtered before it is shuffled, and shapes join last, so that they
    never travel with the orders. Locations, zones and entities must match; a paid fee may
    be missing. Duplicate matches multiply. `region` is the session's, the fee rule
    uses the entity's. `zones` is read twice, so pass a stored or staged table. Building the frame runs no job. Sessions,
    locations and fees from tables.write_bucketed, by entity and order code, are joined without a shuffle.
    """
    a = join_dimension(sessions_in_scope(sessions, scope), zones.select(*ZONE_KEYS).distinct(), ZONE_KEYS, "left_semi")
    located = a.join(
        locations.select(
            F.col("global_entity_id").alias("entity_id"), F.col("order_id").alias("platform_order_code"),
            geo_point(F.col("delivery_location.longitude"), F.col("delivery_location.latitude")).alias("customer_location"),
        ).where(F.col("customer_location").isNotNull()),
        ["entity_id", "platform_order_code"])
    fees = paid_fees.select(
        F.col("global_entity_id").alias("_fee_entity"), F.col("code").alias("_fee_code"),
        F.col("created_date_utc").alias("_fee_date"), F.col("delivery_fee_local").alias("_table_fee"))
    # Entity and code are the join's keys, the date is a condition: the orders stay where the join before put them.
    priced = located.join(
        fees, (F.col("entity_id") == F.col("_fee_entity")) & (F.col("platform_order_code") == F.col("_fee_code"))
        & (F.datediff("created_date", "_fee_date") == 0), "left").drop("_fee_entity", "_fee_code", "_fee_date")
    # An order proves by itself that its entity has sessions, so the plain entity list is enough.
    ent = entity_platforms(entities, scope).select("entity_id", F.col("region").alias("_entity_region"))
    priced = join_dimension(priced, ent, ["entity_id"])
    inside = points_in_zones(priced, zones, "customer_location")
    start = F.lit(scope.start_date)
    # Fixed names: the schema of the KPI table.
    return inside.select(
        F.col("created_date").alias("created_date_utc"),
        F.col("order_placed_at").alias("order_placed_at_utc"),
        "order_placed_at_local",
        weekday_name(F.col("order_placed_at_local")).alias("dow_local"),
        F.col("dps_sessionid_created_at").alias("dps_sessionid_created_at_utc"),
        day_number(F.col("order_placed_at_local"), start).cast("bigint").alias("day_num"),
        "region", "entity_id", "country_code", "city_name", "city_id", "zone_name", "zone_id", "zone_shape",
        "customer_location",
        start.alias("start_date_var"),
        "order_id", "platform_order_code", "vendor_price_scheme_type",
        F.col("assignment_id").cast("bigint").alias("asa_id"),
        "vendor_id", "vertical_type", "exchange_rate",
        "dps_delivery_fee_local", "dps_surge_fee_local", "dps_travel_time_fee_local", "delivery_fee_local",
        "commission_local", "joker_vendor_fee_local",
        F.coalesce("service_fee_local", F.lit(0.0)).alias("service_fee_local"),
        small_order_fee(
            F.col("gfv_local"), F.col("dps_minimum_order_value_local"), F.col("mov_customer_fee_local")).alias("sof_local"),
        "delivery_costs_local",
        delivery_fee_paid(
            F.col("_entity_region"), F.col("_table_fee"), F.col("is_delivery_fee_covered_by_discount"),
            F.col("is_delivery_fee_covered_by_voucher"), F.col("delivery_fee_local"), scope.fee_table_regions,
        ).alias("actual_df_paid_by_customer"),
        "gfv_local", "gmv_local",
        "mean_delay", "dps_mean_delay", "travel_time", "dps_travel_time", "delivery_distance_m", "actual_DT",
    )


def revenue_profit(orders: DataFrame) -> DataFrame:
    """Add revenue and gross profit; an unknown part makes the result unknown."""
    revenue = (
        F.col("actual_df_paid_by_customer") + F.col("commission_local") + F.col("joker_vendor_fee_local")
        + F.col("service_fee_local") + F.col("sof_local"))
    return orders.withColumns({
        "revenue_local": revenue,
        "gross_profit_local": revenue - F.col("delivery_costs_local"),
    })
