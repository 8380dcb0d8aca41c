"""Small hand-made order frames."""

import datetime as dt

import pyarrow as pa

from slotwise.config import ALL_KPIS, CUSTOMER_KPIS, ZoneGroup

START = dt.datetime(2023, 1, 1, 0, 48, 4)
GROUPS = (
    ZoneGroup("E0", 1, ("a", "b"), "zg_1"),
    ZoneGroup("E0", 2, ("c",), "zg_2"),
)


def order(code, minutes, zone="a", zone_id=1, asa=1, entity="E0", day=None, **kpis):
    ts = START + dt.timedelta(minutes=minutes)
    row = {
        "platform_order_code": code, "entity_id": entity, "asa_id": asa, "zone_name": zone, "zone_id": zone_id,
        "dps_sessionid_created_at_utc": ts,
        "day_num": day if day is not None else (ts.date() - START.date()).days + 1,
    }
    for i, k in enumerate(ALL_KPIS):
        row[k] = kpis.get(k, float(i + 1) if k in CUSTOMER_KPIS else 0.5)
    return row


def orders(spark, rows):
    fields = [
        ("platform_order_code", pa.string()), ("entity_id", pa.string()), ("asa_id", pa.int64()),
        ("zone_name", pa.string()), ("zone_id", pa.int64()), ("dps_sessionid_created_at_utc", pa.timestamp("us")),
        ("day_num", pa.int64()), *[(k, pa.float64()) for k in ALL_KPIS],
    ]
    return spark.createDataFrame(pa.table({n: pa.array([r[n] for r in rows], t) for n, t in fields}))


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
