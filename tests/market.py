"""Tiny marketplaces from literals."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from types import SimpleNamespace

from bazaarlens.schemas import COLUMN_TYPES


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _value(kind: str, value):
    if value is None or not isinstance(value, (str, int, float)):
        return value
    if kind == "timestamp_ntz":
        return at(value)
    if kind.startswith("decimal"):
        return Decimal(str(value))
    return float(value) if kind == "double" else value


def table(spark, name: str, rows: list[dict]):
    types = COLUMN_TYPES[name]
    schema = ", ".join(f"{column} {kind}" for column, kind in types.items())
    data = [tuple(_value(kind, row.get(column)) for column, kind in types.items()) for row in rows]
    return spark.createDataFrame(data, schema)


def market(spark, **tables: list[dict]):
    """A marketplace with the given rows; tables not named are empty."""
    names = [name for name in COLUMN_TYPES if name != "geolocation"]
    return SimpleNamespace(
        geolocation=None, **{name: table(spark, name, tables.get(name, [])) for name in names}
    )


def order(order_id: str, purchase: str = "2018-02-10 10:00:00", **changes) -> dict:
    """A delivered, punctual order; every date can be changed."""
    return {
        "order_id": order_id,
        "customer_id": f"c-{order_id}",
        "order_status": "delivered",
        "order_purchase_timestamp": purchase,
        "order_approved_at": "2018-02-10 12:00:00",
        "order_delivered_carrier_date": "2018-02-12 09:00:00",
        "order_delivered_customer_date": "2018-02-20 15:00:00",
        "order_estimated_delivery_date": "2018-02-28 00:00:00",
        **changes,
    }


def item(order_id: str, number: int = 1, **changes) -> dict:
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": "p1",
        "seller_id": "s1",
        "shipping_limit_date": "2018-02-15 00:00:00",
        "price": "100.00",
        "freight_value": "10.00",
        **changes,
    }


def rows(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
