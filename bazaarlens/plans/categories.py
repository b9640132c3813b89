"""Which categories sell, please, ship cheaply and bring customers back?"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import amount, cents, count_where, mean, mean_amount, pct, per_100, total_where
from bazaarlens.operators.cohort import cohort_repeat, started_with
from bazaarlens.operators.grain import conditional_metrics, distinct_pairs, min_support
from bazaarlens.operators.ranking import cumulative_share, dense_rank_desc, in_order, share_of_total
from bazaarlens.operators.scorecard import rollup_metric, scorecard
from bazaarlens.plans.datasets import Datasets


def rank_category_sales(sales: DataFrame) -> DataFrame:
    """Rank, average price, share and running share from items and price per category."""
    everything = W.partitionBy()
    price, items = F.col("price_cents"), F.col("items")
    ranked = dense_rank_desc(sales, "price_cents", "revenue_rank")
    shared = cumulative_share(
        share_of_total(ranked, "price_cents", "GMV_share_pct"), "price_cents", "cumulative_top_GMV_Share_pct"
    )
    return shared.select(
        "revenue_rank",
        "category_name",
        items.alias("total_item_sold"),
        amount(price).alias("total_GMV"),
        mean_amount(price, F.col("priced")).alias("avg_item_price"),
        mean_amount(F.sum(price).over(everything), F.sum(items).over(everything)).alias(
            "overall_avg_item_price"
        ),
        "GMV_share_pct",
        "cumulative_top_GMV_Share_pct",
    )


def category_sales(d: Datasets) -> DataFrame:
    return rank_category_sales(d.category_sales).transform(in_order, F.desc("total_GMV"), "category_name")


def _repeat(d: Datasets, before: datetime | None = None) -> DataFrame:
    started = started_with(d.first_orders, d.main_category_by_key, before, key=d.order_ref)
    return cohort_repeat(
        started, "category_name", "first_order_category", d.params.min_category_rows
    ).transform(in_order, F.desc("came_back_pct"), "first_order_category")


def repeat_by_first_category(d: Datasets) -> DataFrame:
    return _repeat(d)


def repeat_six_months(d: Datasets) -> DataFrame:
    """Only customers who had half a year to return."""
    return _repeat(d, d.params.follow_up_before)


def _punctual_reviews(d: Datasets) -> DataFrame:
    """One row per order and category of reviewed orders that arrived on time."""
    punctual = d.reviewed_items([d.category_key]).filter(rules.is_punctual())
    labeled = d.with_category(punctual.select("order_id", d.category_key, "review_score"))
    return distinct_pairs(labeled, "order_id", "category_name", "review_score")


def _one_star() -> Column:
    """The low-score rule of the category analyses: a mean of 1.5 does not count."""
    return F.col("review_score") == 1


def one_star_on_time(d: Datasets) -> DataFrame:
    reviews, one_star = F.count("order_id"), count_where(_one_star())
    rates = conditional_metrics(
        _punctual_reviews(d),
        ["category_name"],
        {
            "total_reviews": reviews,
            "avg_review": mean(F.col("review_score")),
            "one_star_count": one_star,
            "one_star_pct": pct(one_star, reviews),
        },
    )
    return min_support(rates, "total_reviews", d.params.min_category_rows).transform(
        in_order, F.desc("one_star_pct"), "category_name"
    )


def multi_category_orders(d: Datasets) -> DataFrame:
    """Orders with items of more than one category. Pairs are made distinct first: both steps then hash, where a
    minimum over text would sort."""
    pairs = distinct_pairs(d.clean_delivered_items(), "order_id", "category_name")
    per_order = conditional_metrics(pairs, ["order_id"], {"categories": F.count("category_name")})
    several, total = total_where(F.col("categories") > 1), F.count(F.lit(1))
    return per_order.agg(
        total.alias("total_orders"),
        several.alias("multi_category_orders"),
        pct(several, total).alias("multi_category_pct"),
    )


def _mean_in_thousands(total: str, n: str) -> Column:
    return F.round(F.try_divide(F.col(total), F.col(n)) / 1000, 2).cast("decimal(20,2)")


def freight_by_category(d: Datasets) -> DataFrame:
    items, price, freight = F.col("items"), F.col("price_cents"), F.col("freight_cents")
    sales = min_support(d.category_sales, "items", d.params.min_category_rows)
    return sales.select(
        "category_name",
        items.alias("total_items_sold"),
        amount(price).alias("total_price"),
        amount(freight).alias("total_freight_value"),
        mean_amount(price, F.col("priced")).alias("avg_price"),
        mean_amount(freight, F.col("freighted")).alias("avg_freight_value"),
        _mean_in_thousands("weight_g", "weighed").alias("avg_weight_kg"),
        _mean_in_thousands("volume_cm3", "measured").alias("avg_vol_liters"),
        per_100(freight, price).alias("freight_to_gmv_pct"),
    ).transform(in_order, F.desc("freight_to_gmv_pct"), "category_name")


def _sales_and_reviews(d: Datasets) -> DataFrame:
    """One row per order and category: money of the items sold, and whether a review counts that arrived on time."""
    money = {
        "priced": F.count("price"),
        "price_cents": F.sum(cents(F.col("price"))),
        "freight_cents": F.sum(cents(F.col("freight_value"))),
    }
    labeled = d.with_category(d.reviewed_items([d.category_key], how="left", totals=money))
    counted = F.col("reviewed") & rules.is_punctual()
    per_order = conditional_metrics(
        labeled,
        ["order_id", "category_name"],
        {
            **{name: F.sum(name) for name in money},
            "reviews": F.max(F.when(counted, 1).otherwise(0)),
            "review_score": F.max("review_score"),
        },
    )
    one_star = F.when((F.col("reviews") == 1) & _one_star(), 1).otherwise(0)
    return per_order.select("category_name", *money, "reviews", one_star.alias("one_star"), F.lit(1).alias("sold"))


def _customers(d: Datasets) -> DataFrame:
    """One row per customer with the category of the first order, and whether there was another one."""
    started = started_with(d.first_orders, d.main_category_by_key, key=d.order_ref)
    again = F.when(F.col("total_orders") > 1, 1).otherwise(0)
    return started.select("category_name", F.lit(1).alias("customers"), again.alias("returned"))


def category_scorecard(d: Datasets) -> DataFrame:
    """Sales, repeat buying, scores and freight of chosen categories against all categories.

    Sales and customers are rows of one long table with the numbers of the other kind left empty, which is added up per
    category and rolled up once: no rollups are joined. The total row is the ratio of the totals over every
    category, also those not shown or too small for the other lists; a category without sales is not shown.
    """
    key = "category_name"
    rows = _sales_and_reviews(d).unionByName(_customers(d), allowMissingColumns=True)
    numbers = [name for name in rows.columns if name != key]
    sums = conditional_metrics(rows, [key], {name: F.sum(name) for name in numbers})
    sums = sums.withColumn("all_cents", F.sum("price_cents").over(W.partitionBy()))
    price = F.col("price_cents")
    everything = F.when(F.col("is_total") == 1, price).otherwise(F.col("all_cents"))
    metrics = rollup_metric(
        sums,
        key,
        [*numbers, "all_cents"],
        {
            "gmv_share_pct": per_100(price, everything),
            "avg_item_price": mean_amount(price, F.col("priced")),
            "freight_to_gmv_pct": per_100(F.col("freight_cents"), price),
            "one_star_pct": pct(F.col("one_star"), F.col("reviews")),
            "came_back_pct": pct(F.col("returned"), F.col("customers")),
            "sold": F.col("sold"),
        },
    )
    shown = metrics.filter(F.col("sold").isNotNull() | (F.col("is_total") == 1))
    card = scorecard(shown, [], key, d.params.scorecard_categories, "ALL CATEGORIES")
    return (
        card.transform(in_order, "is_total", F.desc("gmv_share_pct"), key)
        .select(key, "gmv_share_pct", "avg_item_price", "came_back_pct", "one_star_pct", "freight_to_gmv_pct")
    )
