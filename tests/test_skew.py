"""Hot keys: one seller / one order holding a third of all rows. Results stay
exact, and the plans reduce the hot key before it is shuffled."""

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from helpers import item, marketplace, order, review
from tianguis.params import Params
from tianguis.plans import geo, sellers

P = Params(scorecard_min_orders=1)


def _hot_marketplace(spark):
    orders, items, reviews = [], [], []
    n = 0
    for i in range(60):
        oid = f"o{i}"
        orders.append(order(oid, pts="2017-03-01 10:00:00", delivered=f"2017-03-{2 + i % 20:02d} 10:00:00",
                            estimated="2017-03-12 00:00:00"))
        reviews.append(review(oid, 1 + i % 5, f"r{i}"))
        if i % 7 == 0:
            reviews.append(review(oid, 5, f"r{i}b"))           # some orders have two reviews
        for k in range(3):
            n += 1
            seller = "hot" if k == 0 else f"s{i % 9}"          # 'hot' sells a third of all items
            items.append(item(oid, k + 1, price=10 + (n % 13), seller=seller, product=f"p{n % 5}"))
    # one order with as many items as all the others together
    orders.append(order("big", pts="2017-03-01 10:00:00", delivered="2017-03-20 10:00:00",
                        estimated="2017-03-12 00:00:00"))
    for k in range(len(items) // 2):
        items.append(item("big", k + 1, price=5, seller="hot", product="p1"))
    sellers_dim = [{"seller_id": s, "seller_state": "SP" if s == "hot" else "RJ"}
                   for s in ["hot"] + [f"s{j}" for j in range(9)]]
    products = [{"product_id": f"p{j}", "product_category_name": f"c{j}"} for j in range(5)]
    return marketplace(spark, orders=orders, items=items, reviews=reviews, sellers=sellers_dim,
                       products=products)


def _half_up(x, digits):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def _brute_scorecard(mk):
    """Row-level join and aggregate, exactly as the statement is written."""
    rows = (mk.items.join(mk.orders, "order_id").join(mk.sellers, "seller_id")
            .join(mk.reviews, "order_id", "left")
            .where((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()))
    late = F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), 1).otherwise(0)
    g = rows.groupBy("seller_id", "seller_state").agg(
        F.countDistinct("order_id").alias("pedidos"), F.sum("price").alias("rev"),
        F.avg("review_score").alias("score"), F.sum(late).alias("late"), F.count(F.lit(1)).alias("n"))
    return {r["seller_id"]: (r["pedidos"], float(r["rev"]), _half_up(r["score"], 2),
                             _half_up(r["late"] * 100 / r["n"], 1))
            for r in g.collect()}


def test_hot_seller_and_hot_order_scorecard_is_exact(spark):
    mk = _hot_marketplace(spark)
    got = {r["seller_id"]: (r["pedidos"], r["revenue"], r["score_prom"], r["pct_tardias"])
           for r in sellers.seller_scorecard(mk, P).collect()}
    assert got == _brute_scorecard(mk)


def test_hot_seller_is_pre_aggregated_before_its_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mk = _hot_marketplace(spark)
        plan = sellers.seller_scorecard(mk, P)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    idx = [i for i, l in enumerate(lines) if re.search(r"Exchange hashpartitioning\(seller_id", l)]
    assert idx, plan
    # directly below the first seller_id exchange of the fact side: a partial aggregate
    fact_side = [i for i in idx if "HashAggregate" in lines[i + 1]]
    assert fact_side, plan
    assert "partial_" in lines[fact_side[0] + 1]


def test_hot_product_category_totals_are_exact(spark):
    mk = _hot_marketplace(spark)
    got = {r["categoria"]: (r["unidades"], r["revenue"]) for r in geo.category_mart(mk, P).collect()}
    brute = (mk.items.join(mk.orders.where("order_status = 'delivered'"), "order_id")
             .join(mk.products, "product_id")
             .groupBy(F.col("product_category_name").alias("c"))
             .agg(F.count("order_item_id").alias("u"), F.sum("price").alias("r")).collect())
    assert got == {"Sin categoría": (sum(r["u"] for r in brute), float(sum(r["r"] for r in brute)))}


def _products_of_many_kinds(spark):
    """A category with most products, products of two categories, repeated products, labels shared and repeated."""
    products = [{"product_id": f"p{j:02d}", "product_category_name": "big"} for j in range(30)]
    products += [{"product_id": "p40", "product_category_name": c} for c in ("big", "big", "none")]
    products += [{"product_id": "p41", "product_category_name": c} for c in (None, "none")]
    products += [{"product_id": f"p5{j}", "product_category_name": c} for j, c in enumerate((None, "none", "two", "two", "same"))]
    translation = [{"product_category_name": a, "product_category_name_english": b}
                   for a, b in (("big", "Big"), ("two", "T1"), ("two", "T2"), ("two", "T2"), ("same", "Big"))]
    items = [item("o", n, price=1 + (7 * n) % 11, product=q["product_id"]) for n, q in enumerate(products)]
    items += [item("o", 90, product="p55") | {"price": None}, item("o", 91, price=500, product="unknown")]
    return marketplace(spark, orders=[order("o")], items=items, products=products + [{"product_id": "p55"}],
                       translation=translation)


def test_top_products_equal_the_row_level_statement(spark):
    mk = _products_of_many_kinds(spark)
    rows = (mk.items.join(mk.orders, "order_id").join(mk.products, "product_id").join(mk.translation, "product_category_name", "left")
            .groupBy("product_id", F.coalesce("product_category_name_english", F.lit("Sin categoría")).alias("c"))
            .agg(F.count("order_item_id").alias("u"), F.sum("price").alias("r")).collect())
    rows = sorted(rows, key=lambda r: (r["r"] is None, -(r["r"] or 0), r["product_id"], r["c"]))
    want = [(r["product_id"], r["c"], r["u"], None if r["r"] is None else float(r["r"])) for r in rows]
    assert len({r[:2] for r in want}) == len(want) > 40 and want[-1][3] is None
    for k in (1, 2, 3, 5, 10, 100):
        got = geo.top_products(mk, P.with_(top_products=k)).drop("precio_promedio").collect()
        assert [tuple(r) for r in got] == want[:k], k


def test_few_products_of_a_category_meet_its_label(spark):
    mk = _products_of_many_kinds(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = geo.top_products(mk, P)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_kind = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(_kind", line)]
    assert len(by_kind) == 1 and "WindowGroupLimit" in lines[by_kind[0] + 1] and "Partial" in lines[by_kind[0] + 1]


def test_hot_order_groups_form_where_the_join_left_the_rows(spark):
    """Items cross one exchange by order id; (order, seller) groups need no further one, and the
    rows are summed per seller before the exchange by seller."""
    mk = _hot_marketplace(spark)
    for plan in (sellers.seller_scorecard, sellers.seller_segments):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            text = plan(mk, P)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert not re.search(r"Exchange hashpartitioning\(order_id#\d+, seller_id", text), text
        lines = text.splitlines()
        below = [lines[i + 1] for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(seller_id", line)]
        assert any("partial_" in line for line in below), text
    pairs = sellers._sold(mk, sellers._scope_ids(mk, P), "price").groupBy("order_id", "seller_id").count()
    assert pairs.where("order_id = 'big'").collect()[0]["count"] == mk.items.where("order_id = 'big'").count()
