"""Which sellers break the delivery promise? One row per item unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import count_where, mean_of_scaled, pct, scaled, sum_where
from bazaarlens.functions.rules import at_least_share
from bazaarlens.operators.grain import conditional_metrics, min_support
from bazaarlens.operators.quality import dq_count
from bazaarlens.operators.ranking import dense_rank_desc, in_order, share_of_total, top_n
from bazaarlens.operators.segments import segment_by_rules
from bazaarlens.params import Params, Period
from bazaarlens.plans.datasets import Datasets


def _items() -> Column:
    return F.count("order_item_id")


def dispatch_baseline(d: Datasets) -> DataFrame:
    breached = count_where(rules.is_breach())
    return conditional_metrics(
        d.dispatched_items(),
        [d.purchase_quarter],
        {
            "total_dispatched_items": _items(),
            "on_time_dispatches": count_where(rules.is_dispatched_on_time()),
            "breached_dispatches": breached,
            "dispatch_breach_pct": pct(breached, _items()),
        },
    ).transform(in_order, "purchase_quarter")


def fulfillment_matrix(d: Datasets) -> DataFrame:
    arrived = d.dispatched_items(d.params.later).filter(F.col("order_delivered_customer_date").isNotNull())
    buckets = conditional_metrics(
        arrived,
        [rules.fulfillment_bucket().alias("fulfillment_attribution")],
        {"total_items": _items()},
    )
    return share_of_total(buckets, "total_items", "pct_of_total").transform(in_order, "fulfillment_attribution")


def _seller_record(d: Datasets, period: Period) -> DataFrame:
    """Items, breaches and harm per seller with enough items in the period."""
    totals = conditional_metrics(
        d.dispatched_items(period),
        ["seller_id"],
        {
            "total_items": _items(),
            "breached_items": count_where(rules.is_breach()),
            "direct_customer_delays": count_where(rules.is_breach() & rules.is_late()),
        },
    )
    return min_support(totals, "total_items", d.params.min_items)


def _with_breach_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("breach_items_pct", pct(F.col("breached_items"), F.col("total_items")))


_RECORD = ("seller_id", "total_items", "breached_items", "direct_customer_delays", "breach_items_pct")


def top_offenders(d: Datasets) -> DataFrame:
    """Sellers ranked by late doorsteps they caused. The ranks are those of the distinct counts, and both sides
    read the one shuffle of the items by seller."""
    harmful = min_support(_seller_record(d, d.params.later), "direct_customer_delays", 1)
    ranked = dense_rank_desc(harmful, "direct_customer_delays", "harm_rank", many_rows=True)
    return (
        _with_breach_pct(ranked)
        .select("harm_rank", *_RECORD)
        .orderBy(F.desc("direct_customer_delays"), F.desc("breached_items"), "seller_id")
    )


def top_breachers(d: Datasets) -> DataFrame:
    """The ten sellers with most breaches. Ranks among them equal ranks among all, as they are the first."""
    breachers = min_support(_seller_record(d, d.params.earlier), "breached_items", 1)
    leading = top_n(breachers, [F.desc("breached_items"), F.asc("seller_id")], d.params.top_n)
    ranked = dense_rank_desc(leading, "breached_items", "breached_ranks")
    listed = _with_breach_pct(ranked).select("breached_ranks", *_RECORD)
    return listed.transform(in_order, "breached_ranks", "seller_id")


def _with_history(d: Datasets) -> DataFrame:
    """Sellers with enough items and any breach in at least one quarter."""

    def active(quarter: str) -> Column:
        return (F.col(f"{quarter}_total_items") >= d.params.min_items) & (F.col(f"{quarter}_breaches") > 0)

    return d.seller_quarters.filter(active("q1") | active("q2"))


def seller_quarters_filtered(d: Datasets) -> DataFrame:
    return _with_history(d).orderBy(F.desc("q2_breaches"), "seller_id")


def add_seller_segment(quarters: DataFrame, p: Params) -> DataFrame:
    """Name each seller's course between the quarters. The first rule that holds decides."""
    q1, q2 = F.col("q1_total_items"), F.col("q2_total_items")
    breached_q1 = at_least_share(F.col("q1_breaches"), q1, p.breach_limit)
    breached_q2 = at_least_share(F.col("q2_breaches"), q2, p.breach_limit)
    return segment_by_rules(
        quarters,
        "seller_segment",
        [  # Fixed values: segment labels.
            ("exited", (q1 >= p.min_items) & (q2 < p.exit_items)),
            ("not_enough_data", (q1 < p.min_items) | (q2 < p.min_items)),
            ("chronic", breached_q1 & breached_q2),
            ("reformed", breached_q1),
            ("got_worse", breached_q2),
        ],
        "compliant",
    )


def seller_segments(d: Datasets) -> DataFrame:
    return add_seller_segment(_with_history(d), d.params).orderBy(
        "seller_segment", F.desc("q2_breaches"), "seller_id"
    )


def _score_below_two() -> Column:
    """The low-score rule of the seller analyses: a mean of 1.5 counts."""
    return F.col("review_score") < 2


def _reviewed(items: DataFrame, keys: Sequence[str | Column], more: Mapping[str, Column]) -> DataFrame:
    """Scores over items: sums over the rows each row stands for."""
    score, rows = F.col("review_score"), F.col("n_rows")
    sums = {
        "score_sum": F.sum(scaled(score) * rows),
        "scores": sum_where(score.isNotNull(), rows),
        "low_scores": sum_where(_score_below_two(), rows),
    }
    return conditional_metrics(items, keys, {**more, **sums})


def review_by_bucket(d: Datasets) -> DataFrame:
    """Scores per fulfillment bucket; a review counts once per item of its order."""
    reviewed = d.reviewed_items(["shipping_limit_date"], d.params.later).filter(
        F.col("order_delivered_carrier_date").isNotNull() & F.col("order_delivered_customer_date").isNotNull()
    )
    bucket = rules.fulfillment_bucket().alias("fulfillment_attribution")
    return (
        _reviewed(reviewed, [bucket], {"reviewed_items": F.sum("n_items")})
        .select(
            "fulfillment_attribution",
            "reviewed_items",
            mean_of_scaled(F.col("score_sum"), F.col("scores")).alias("avg_review_score"),
            pct(F.col("low_scores"), F.col("reviewed_items")).alias("one_star_pct"),
        )
        .transform(in_order, "fulfillment_attribution")
    )


def review_by_seller_group(d: Datasets) -> DataFrame:
    """Scores of sellers with many breaches against the rest.

    One pass gives a seller's items and breaches (all items) and scores (reviewed items), so sellers are
    counted as rows rather than as distinct ids, and items are joined once.
    """
    p = d.params
    items = d.reviewed_items(["seller_id", "shipping_limit_date"], p.later, "left")
    sellers = _reviewed(
        items.filter(F.col("order_delivered_carrier_date").isNotNull()),
        ["seller_id"],
        {
            "total_items": F.sum("n_items"),
            "breaches": sum_where(rules.is_breach(), F.col("n_rows")),
            "reviewed_items": sum_where(F.col("reviewed"), F.col("n_items")),
        },
    ).filter(F.col("seller_id").isNotNull() & (F.col("reviewed_items") > 0))
    small = F.col("total_items") < p.min_items
    careless = at_least_share(F.col("breaches"), F.col("total_items"), p.breach_limit)
    grouped = segment_by_rules(
        sellers,
        "seller_group",
        [("03_small_seller", small), ("01_high_breach_seller", careless)],  # Fixed values: labels.
        "02_normal_seller",
    )
    return conditional_metrics(
        grouped,
        ["seller_group"],
        {
            "sellers": F.count("seller_id"),
            "reviewed_items": F.sum("reviewed_items"),
            "avg_review_score": mean_of_scaled(F.sum("score_sum"), F.sum("scores")),
            "one_star_pct": pct(F.sum("low_scores"), F.sum("reviewed_items")),
        },
    ).transform(in_order, "seller_group")


def dq_carrier_before_approval(d: Datasets) -> DataFrame:
    """Items handed over before their order was approved, counted on per-order item numbers."""
    handed_over = d.delivered_totals().filter(F.col("order_delivered_carrier_date").isNotNull())
    early = F.col("order_delivered_carrier_date") < F.col("order_approved_at")
    return dq_count(handed_over, {"carrier_before_approval": early}, "total_items", F.col("items"))


def action_list(d: Datasets) -> DataFrame:
    """Sellers with enough items and repeated harm in the later quarter."""
    return (
        d.seller_quarters.filter(
            (F.col("q2_total_items") >= d.params.min_items)
            & (F.col("q2_direct_customer_delays") >= d.params.harm_items)
        )
        .select("seller_id", "q2_total_items", "q2_breaches", "q2_direct_customer_delays")
        .orderBy(F.desc("q2_direct_customer_delays"), "seller_id")
    )
