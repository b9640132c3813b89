"""Cases that change an answer when a metric rule is missed, one small table each."""

from __future__ import annotations

from decimal import Decimal

import pytest
from market import item, market, order, rows

from bazaarlens.params import Params
from bazaarlens.plans import categories, delivery, freight, payments, sellers
from bazaarlens.plans.datasets import Datasets


def test_delivery_on_the_estimated_day_is_not_late(spark):
    orders = [
        order("same-day", order_delivered_customer_date="2018-02-28 15:00:00"),
        order("next-day", order_delivered_customer_date="2018-03-01 00:00:00"),
        order("undated", order_delivered_customer_date=None),
    ]
    (q1,) = rows(delivery.late_rate_by_quarter(Datasets(market(spark, orders=orders))))
    assert q1 == {
        "purchase_quarter": "2018-Q1",
        "total_delivered_orders": 2,
        "late_order_pct": Decimal("50.00"),
    }


def test_period_bounds_are_half_open(spark):
    orders = [
        order("first", "2018-01-01 00:00:00"),
        order("before", "2017-12-31 23:59:59"),
        order("boundary", "2018-04-01 00:00:00"),
        order("after", "2018-07-01 00:00:00"),
    ]
    result = rows(delivery.late_rate_by_quarter(Datasets(market(spark, orders=orders))))
    counts = {r["purchase_quarter"]: r["total_delivered_orders"] for r in result}
    assert counts == {"2018-Q1": 1, "2018-Q2": 1}


def test_days_are_calendar_days(spark):
    orders = [
        order(
            "a",
            order_approved_at="2018-02-10 23:59:59",
            order_delivered_carrier_date="2018-02-11 00:00:01",
            order_delivered_customer_date="2018-02-13 00:00:00",
        )
    ]
    (q1,) = rows(delivery.leg_durations(Datasets(market(spark, orders=orders))))
    assert (q1["avg_seller_days"], q1["avg_carrier_days"]) == (Decimal("1.00"), Decimal("2.00"))


def test_handover_on_a_day_before_approval_is_left_out_of_timing(spark):
    orders = [
        order("ok"),
        order("impossible", order_delivered_carrier_date="2018-02-09 10:00:00"),
        order("same-day", order_delivered_carrier_date="2018-02-10 11:00:00"),
    ]
    d = Datasets(market(spark, orders=orders, order_items=[item(o["order_id"]) for o in orders]))
    (q1,) = rows(delivery.leg_durations(d))
    assert q1["total_delivered_orders"] == 2
    (dq,) = rows(sellers.dq_carrier_before_approval(d))
    assert dq == {"total_items": 3, "carrier_before_approval": 2}


def test_two_reviews_count_as_one_order(spark):
    reviews = [
        {"order_id": "a", "review_score": 1, "review_creation_date": "2018-03-01 00:00:00"},
        {"order_id": "a", "review_score": 2, "review_creation_date": "2018-03-02 00:00:00"},
        {"order_id": "b", "review_score": 5, "review_creation_date": "2018-03-02 00:00:00"},
    ]
    d = Datasets(market(spark, orders=[order("a"), order("b"), order("unreviewed")], order_reviews=reviews))
    (status,) = rows(delivery.review_by_lateness(d))
    assert (status["total_orders"], status["avg_review_score"]) == (2, Decimal("3.25"))
    (intake,) = rows(delivery.review_intake_by_month(d))
    assert (intake["total_reviews"], intake["one_star_reviews"]) == (3, 1)
    (drag,) = rows(delivery.non_delivered_drag(d))
    assert drag["reviewed_orders"] == 2


def test_score_drag_is_rounded_once(spark):
    scores = {"delivered": [5, 4, 4], "canceled": [3, 3, 3]}
    orders, reviews = [], []
    for state, given in scores.items():
        for number, score in enumerate(given):
            orders.append(order(f"{state}{number}", order_status=state))
            reviews.append({"order_id": f"{state}{number}", "review_score": score})
    (drag,) = rows(delivery.non_delivered_drag(Datasets(market(spark, orders=orders, order_reviews=reviews))))
    assert (drag["avg_score_all_orders"], drag["avg_score_delivered_only"]) == (Decimal("3.67"), Decimal("4.33"))
    assert drag["score_drag"] == Decimal("-0.67")


def test_mean_score_between_one_and_two_is_low_for_sellers_only(spark):
    reviews = [{"order_id": "a", "review_score": s} for s in (1, 2)]
    tables = market(
        spark,
        orders=[order("a", "2018-05-01 10:00:00")],
        order_items=[item("a"), item("a", 2)],
        order_reviews=reviews,
        products=[{"product_id": "p1", "product_category_name": "toys"}],
    )
    d = Datasets(tables, Params(min_category_rows=1))
    (bucket,) = rows(sellers.review_by_bucket(d))
    assert (bucket["reviewed_items"], bucket["one_star_pct"]) == (2, Decimal("100.00"))
    (category,) = rows(categories.one_star_on_time(d))
    assert (category["total_reviews"], category["one_star_count"]) == (1, 0)


def test_breach_compares_times_and_undelivered_items_do_not_harm(spark):
    orders = [
        order("minute", order_delivered_carrier_date="2018-02-15 00:01:00"),
        order("exact", order_delivered_carrier_date="2018-02-15 00:00:00"),
        order("undelivered", order_delivered_carrier_date="2018-02-16 00:00:00", order_delivered_customer_date=None),
    ]
    d = Datasets(market(spark, orders=orders, order_items=[item(o["order_id"]) for o in orders]))
    (q1,) = rows(sellers.dispatch_baseline(d))
    assert (q1["on_time_dispatches"], q1["breached_dispatches"]) == (1, 2)
    (seller,) = rows(d.seller_quarters)
    assert (seller["q1_breaches"], seller["q2_direct_customer_delays"]) == (2, 0)


def test_vouchers_of_one_order_count_once(spark):
    pays = [
        {"order_id": "a", "payment_type": "voucher", "payment_value": v} for v in ("30.00", "40.00", "40.00")
    ] + [
        {"order_id": "b", "payment_type": "credit_card", "payment_value": "110.00"},
        {"order_id": "b", "payment_type": "not_defined", "payment_value": "0.00"},
    ]
    orders = [order("a"), order("b", order_status="delivered")]
    d = Datasets(market(spark, orders=orders, order_payments=pays, order_items=[item("a"), item("b")]))
    types = {r["payment_type"]: r for r in rows(payments.payment_breakdown(d))}
    assert set(types) == {"voucher", "credit_card"}
    assert types["voucher"]["total_orders"] == 1
    assert types["voucher"]["avg_paid_per_order"] == Decimal("110.00")
    assert types["voucher"]["paid_share_pct"] == Decimal("50.00")
    latency = {r["payment_type"]: r["total_orders"] for r in rows(payments.approval_latency(d))}
    assert latency == {"voucher": 1, "credit_card": 1, "not_defined": 1}
    (match,) = rows(freight.who_pays_freight(d))
    assert (match["total_orders"], match["matched_orders"]) == (2, 2)
    assert match["total_paid"] == Decimal("220.00")


def test_match_tolerance_is_exclusive(spark):
    pays = [
        {"order_id": "four", "payment_type": "boleto", "payment_value": "110.04"},
        {"order_id": "five", "payment_type": "boleto", "payment_value": "110.05"},
    ]
    d = Datasets(
        market(
            spark,
            orders=[order("four"), order("five"), order("unpaid")],
            order_items=[item("four"), item("five"), item("unpaid")],
            order_payments=pays,
        )
    )
    (match,) = rows(freight.who_pays_freight(d))
    assert (match["total_orders"], match["matched_orders"], match["matched_pct"]) == (2, 1, Decimal("50.00"))


def test_approval_counts_whole_minutes(spark):
    orders = [
        order("day", "2018-02-10 00:00:00", order_approved_at="2018-02-11 00:00:59"),
        order("longer", "2018-02-10 00:00:30", order_approved_at="2018-02-11 00:01:30"),
    ]
    pays = [{"order_id": o["order_id"], "payment_type": "boleto", "payment_value": "1.00"} for o in orders]
    (boleto,) = rows(payments.approval_latency(Datasets(market(spark, orders=orders, order_payments=pays))))
    assert boleto["over_24h_pct"] == Decimal("50.00")
    assert boleto["avg_approval_hours"] == Decimal("24.01")


def test_only_canceled_and_unavailable_are_lost(spark):
    states = ["delivered", "shipped", "canceled", "unavailable", "processing"]
    orders = [order(state, order_status=state) for state in states]
    pays = [{"order_id": s, "payment_type": "boleto", "payment_value": "1.00"} for s in states]
    (boleto,) = rows(payments.order_loss(Datasets(market(spark, orders=orders, order_payments=pays))))
    assert (boleto["total_orders"], boleto["lost_orders"], boleto["lost_pct"]) == (5, 2, Decimal("40.00"))


@pytest.fixture(scope="module")
def returning(spark):
    """One person under two customer ids, tied in time, and one who never paid."""
    orders = [
        order("b", "2018-02-01 10:00:00"),
        order("a", "2018-02-01 10:00:00"),
        order("c", "2018-05-01 10:00:00"),
        order("lone", "2018-05-01 10:00:00"),
        order("lost", "2017-01-01 10:00:00", order_status="canceled"),
    ]
    people = {"a": "ann", "b": "ann", "c": "ann", "lost": "ann", "lone": "leo"}
    customers = [{"customer_id": f"c-{o}", "customer_unique_id": who} for o, who in people.items()]
    items = [
        item("a", 1, product_id="cheap", price="5.00"),
        item("a", 2, product_id="dear", price="50.00"),
        item("b", 1, product_id="cheap"),
        item("lone", 1, product_id="bare"),
    ]
    pays = [
        {"order_id": "a", "payment_type": "voucher", "payment_value": "20.00"},
        {"order_id": "a", "payment_type": "credit_card", "payment_value": "35.00"},
        {"order_id": "b", "payment_type": "boleto", "payment_value": "100.00"},
    ]
    products = [
        {"product_id": "cheap", "product_category_name": "brinquedos"},
        {"product_id": "dear", "product_category_name": "sem_traducao"},
        {"product_id": "bare", "product_category_name": None},
    ]
    words = [{"product_category_name": "brinquedos", "product_category_name_english": "toys"}]
    return Datasets(
        market(
            spark,
            orders=orders,
            customers=customers,
            order_items=items,
            order_payments=pays,
            products=products,
            category_translation=words,
        )
    )


def test_people_are_unique_ids_and_ties_go_to_the_lower_order(returning):
    first = {r["customer_unique_id"]: r for r in rows(returning.first_orders)}
    assert (first["ann"]["order_id"], first["ann"]["total_orders"]) == ("a", 3)
    assert (first["leo"]["order_id"], first["leo"]["total_orders"]) == ("lone", 1)
    numbers = {r["order_id"]: r["order_no"] for r in rows(returning.customer_orders)}
    assert numbers == {"a": 1, "b": 2, "c": 3, "lone": 1}
    segments = {
        r["customer_loyalty_segment"]: r["total_unique_customers"]
        for r in rows(payments.customer_frequency(returning))
    }
    assert segments == {"01_Single_Purchase_Buyer (1x)": 1, "03_Loyal_Customer (3x+)": 1}


def test_people_without_payment_leave_the_revenue_split(returning):
    (segment,) = rows(payments.cohort_revenue(returning))
    assert segment["customer_loyalty_segment"] == "02_Repeat_Purchase_Buyer (2x)"
    assert (segment["total_customers"], segment["total_paid"]) == (1, Decimal("155.00"))
    assert segment["avg_paid_per_order"] == Decimal("77.50")


def test_first_order_takes_its_main_payment_and_category(returning):
    (payment,) = rows(payments.repeat_by_first_payment(returning))
    assert (payment["first_order_payment"], payment["came_back"]) == ("credit_card", 1)
    categories_of = {r["order_id"]: r["category_name"] for r in rows(returning.main_category)}
    assert categories_of == {"a": "sem_traducao", "b": "toys", "lone": "unlabeled"}


def test_orders_with_several_categories(returning):
    (share,) = rows(categories.multi_category_orders(returning))
    assert share == {
        "total_orders": 3,
        "multi_category_orders": 1,
        "multi_category_pct": Decimal("33.33"),
    }


def test_free_goods_give_no_rate_instead_of_an_error(spark):
    d = Datasets(
        market(spark, orders=[order("a")], order_items=[item("a", price="0.00", freight_value="3.00")])
    )
    (q1,) = rows(freight.freight_vs_gmv(d))
    assert q1["freight_to_gmv_pct"] is None
    (toxic,) = rows(freight.freight_ge_price(d))
    assert toxic["toxic_freight_items"] == 1


def test_no_freight_heavy_items_add_to_zero_but_have_no_mean(spark):
    tables = market(
        spark,
        orders=[order("a")],
        order_items=[item("a")],
        customers=[{"customer_id": "c-a", "customer_unique_id": "ann", "customer_state": "RJ"}],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}],
    )
    (split,) = rows(freight.toxic_freight_split(Datasets(tables)))
    assert split["shipping_type"] == "Interstate"
    assert (split["total_toxic_freight_value"], split["avg_toxic_freight"]) == (Decimal("0.00"), None)


def test_keyless_results_over_nothing(spark):
    d = Datasets(market(spark))
    (dq,) = rows(sellers.dq_carrier_before_approval(d))
    assert dq == {"total_items": 0, "carrier_before_approval": None}
    (match,) = rows(freight.who_pays_freight(d))
    assert (match["total_orders"], match["matched_orders"], match["matched_pct"]) == (0, None, None)
    (share,) = rows(categories.multi_category_orders(d))
    assert (share["total_orders"], share["multi_category_orders"]) == (0, None)
