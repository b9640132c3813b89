"""Published results that follow from other published results; a few of their rows."""

from __future__ import annotations

from decimal import Decimal

import pytest

from bazaarlens.operators.ranking import share_of_total
from bazaarlens.params import Params
from bazaarlens.plans.categories import rank_category_sales
from bazaarlens.plans.sellers import add_seller_segment

# Items and breaches of sellers in the first quarter, then the second, and the published segment.
SEGMENTS = [
    (411, 172, 227, 66, 9, "chronic"),
    (125, 19, 361, 65, 14, "chronic"),
    (65, 25, 194, 49, 27, "chronic"),
    (274, 32, 450, 45, 5, "chronic"),
    (21, 9, 94, 35, 3, "chronic"),
    (15, 8, 121, 44, 13, "not_enough_data"),
]


def test_published_segments(spark):
    names = "q1_total_items q1_breaches q2_total_items q2_breaches q2_direct_customer_delays expected".split()
    quarters = spark.createDataFrame(SEGMENTS, ", ".join(f"{n} bigint" for n in names[:-1]) + ", expected string")
    for row in add_seller_segment(quarters, Params()).collect():
        assert row["seller_segment"] == row["expected"]


@pytest.mark.parametrize(
    ("q1", "b1", "q2", "b2", "expected"),
    [
        (20, 2, 4, 4, "exited"),
        (20, 2, 5, 5, "not_enough_data"),
        (20, 2, 20, 2, "chronic"),
        (20, 2, 20, 1, "reformed"),
        (30, 3, 30, 2, "reformed"),
        (20, 1, 20, 2, "got_worse"),
        (20, 1, 20, 1, "compliant"),
    ],
)
def test_segment_limits_are_inclusive(spark, q1, b1, q2, b2, expected):
    df = spark.createDataFrame(
        [(q1, b1, q2, b2)], "q1_total_items bigint, q1_breaches bigint, q2_total_items bigint, q2_breaches bigint"
    )
    (row,) = add_seller_segment(df, Params()).collect()
    assert row["seller_segment"] == expected


def test_published_bucket_shares(spark):
    buckets = [("01", 20513, "90.59"), ("02", 1236, "5.46"), ("03", 675, "2.98"), ("04", 220, "0.97")]
    df = spark.createDataFrame([b[:2] for b in buckets], "bucket string, items bigint")
    for many_rows in (False, True):
        shares = {r["bucket"]: r["pct"] for r in share_of_total(df, "items", "pct", many_rows).collect()}
        assert shares == {name: Decimal(share) for name, _, share in buckets}


def test_published_revenue_shares(spark):
    segments = [("1x", "14558104.56", "94.40"), ("2x", "748808.38", "4.86"), ("3x+", "115548.83", "0.75")]
    df = spark.createDataFrame([(n, Decimal(v)) for n, v, _ in segments], "segment string, paid decimal(20,2)")
    shares = {r["segment"]: r["pct"] for r in share_of_total(df, "paid", "pct").collect()}
    assert shares == {name: Decimal(share) for name, _, share in segments}


def test_published_category_ranking(spark):
    """The five largest categories, the rest of the published total as one."""
    top = [
        ("health_beauty", 4236, "532809.27", "125.78", "9.67", "9.67"),
        ("watches_gifts", 2696, "522923.35", "193.96", "9.49", "19.15"),
        ("bed_bath_table", 4538, "417062.53", "91.90", "7.57", "26.72"),
        ("computers_accessories", 3789, "415153.35", "109.57", "7.53", "34.25"),
        ("sports_leisure", 3505, "412290.19", "117.63", "7.48", "41.73"),
    ]
    total, items = 551159502, 46219
    rest = total - sum(int(c[2].replace(".", "")) for c in top)
    # Split so that no part outranks the five.
    parts = [rest // 10] * 9 + [rest - rest // 10 * 9]
    left = items - sum(c[1] for c in top)
    data = [(c[0], c[1], int(c[2].replace(".", ""))) for c in top]
    data += [(f"rest{i}", left if i == 0 else 0, part) for i, part in enumerate(parts)]
    sales = spark.createDataFrame(data, "category_name string, items bigint, price_cents bigint")
    sales = sales.withColumn("priced", sales["items"])
    ranked = {r["category_name"]: r for r in rank_category_sales(sales).collect()}
    for place, (name, count, gmv, mean, share, running) in enumerate(top, 1):
        row = ranked[name]
        assert row["revenue_rank"] == place
        assert (row["total_item_sold"], row["total_GMV"]) == (count, Decimal(gmv))
        assert row["avg_item_price"] == Decimal(mean)
        assert row["overall_avg_item_price"] == Decimal("119.25")
        assert row["GMV_share_pct"] == Decimal(share)
        assert row["cumulative_top_GMV_Share_pct"] == Decimal(running)


def test_equal_sales_share_rank_and_running_share(spark):
    sales = spark.createDataFrame(
        [("a", 1, 1, 500), ("b", 1, 1, 250), ("c", 1, 1, 250)],
        "category_name string, items bigint, priced bigint, price_cents bigint",
    )
    ranked = {r["category_name"]: r for r in rank_category_sales(sales).collect()}
    assert [ranked[n]["revenue_rank"] for n in "abc"] == [1, 2, 2]
    assert [ranked[n]["cumulative_top_GMV_Share_pct"] for n in "abc"] == [Decimal(50), Decimal(100), Decimal(100)]
