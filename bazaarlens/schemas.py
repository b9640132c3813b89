"""Declared column types of the nine marketplace tables.

Types are declared, never inferred: a value of another kind in a raw file then fails the load instead of
silently turning a date column into text. Money is DECIMAL so that sums are exact and do not depend on how
rows were partitioned; times have no zone, as in the raw files. ``COLUMN_TYPES`` lists the columns that jobs read,
which a file must have; ``OTHER_TYPES`` types further ones where a file has them. Zip prefixes are text, as they
have leading zeros, and any column in neither list is loaded as text.
"""

from __future__ import annotations

# The columns' names in the raw files.
COLUMN_TYPES: dict[str, dict[str, str]] = {
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_state": "string",
    },
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": "decimal(12,2)",
        "freight_value": "decimal(12,2)",
    },
    "order_payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_value": "decimal(12,2)",
    },
    "order_reviews": {
        "order_id": "string",
        "review_score": "int",
        "review_creation_date": "timestamp_ntz",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_weight_g": "double",
        "product_length_cm": "double",
        "product_height_cm": "double",
        "product_width_cm": "double",
    },
    "sellers": {
        "seller_id": "string",
        "seller_state": "string",
    },
    "geolocation": {},
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

# Columns that files may have besides and that are not text.
OTHER_TYPES: dict[str, str] = {
    "payment_sequential": "int",
    "payment_installments": "int",
    "review_answer_timestamp": "timestamp_ntz",
    "product_name_lenght": "int",
    "product_name_length": "int",
    "product_description_lenght": "int",
    "product_description_length": "int",
    "product_photos_qty": "int",
    "geolocation_lat": "double",
    "geolocation_lng": "double",
}

# Directory keys of the stored tables, derived at load time: the month an order was bought in, for orders
# and for the tables with several rows per order.
ORDERS_PARTITION = "purchase_month"
FACTS_PARTITION = "order_month"
FACT_TABLES = ("order_items", "order_payments", "order_reviews")
# Tables that may be stored a second time, by the month of a date of their own: folder, that date, directory key.
DATED_TABLES = {
    "orders": ("orders_by_delivery", "order_delivered_customer_date", "delivery_month"),
    "order_reviews": ("reviews_by_creation", "review_creation_date", "creation_month"),
}

# The number that stands for a text order id, in orders and these tables: a fixed-width key that sorts like the id.
ORDER_KEY = "order_key"
