"""Hand-made edge rows with expected values worked out from the original SQL."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import item, marketplace, order, payment, review
from tianguis.functions import labels as L
from tianguis.functions.dates import week_monday_first
from tianguis.functions.rules import bucketize
from tianguis.params import Params
from tianguis.plans import core, extras, geo, quality, sellers, temporal

P = Params()


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_same_day_late_delivery_counts_as_late_with_null_band(spark):
    mk = marketplace(spark, orders=[
        order("a", delivered="2017-05-10 15:00:00", estimated="2017-05-10 00:00:00"),
        order("b", pts="2017-05-01 09:00:00", delivered="2017-05-20 10:00:00", estimated="2017-05-15 00:00:00"),
    ])
    s = rows(quality.late_delivery_summary(mk, P))[0]
    assert s["entregas_tardias"] == 2 and s["total_entregados"] == 2
    b = rows(quality.late_delay_buckets(mk, P))
    assert b == [{"rango_retraso": None, "cantidad": 1}, {"rango_retraso": "4-7 días", "cantidad": 1}]


def test_delivery_band_edges_and_negative_days(spark):
    days = [0, 7, 8, 14, 15, 21, 22, 30, 31, -1]
    orders = [order(f"o{i}", pts="2017-05-10 10:00:00",
                    delivered=f"{dt.date(2017, 5, 10) + dt.timedelta(days=d)} 11:00:00",
                    estimated="2017-07-01 00:00:00") for i, d in enumerate(days)]
    mk = marketplace(spark, orders=orders)
    got = {r["rango_entrega"]: r["pedidos"] for r in rows(sellers.delivery_histogram(mk, P))}
    assert got == {"1. 1-7 días": 2, "2. 8-14 días": 2, "3. 15-21 días": 2, "4. 22-30 días": 2, "5. 30+ días": 2}


def test_payment_distribution_counts_orders_per_type(spark):
    mk = marketplace(spark, payments=[payment("A", 80), payment("A", 20, "voucher", 2), payment("B", 100)])
    got = {r["payment_type"]: (r["pedidos"], r["porcentaje"], r["ticket_promedio"])
           for r in rows(quality.payment_distribution(mk, P))}
    assert got == {"credit_card": (2, 66.67, 90.0), "voucher": (1, 33.33, 20.0)}


def test_median_even_and_odd(spark):
    for totals, expected in (([10, 20, 30, 100], 25.0), ([10, 20, 30], 20.0)):
        orders = [order(f"o{i}") for i in range(len(totals))]
        pays = [payment(f"o{i}", v) for i, v in enumerate(totals)]
        mk = marketplace(spark, orders=orders, payments=pays)
        assert rows(core.ticket_stats(mk, P))[0]["ticket_mediana"] == expected
        assert rows(core.ticket_median_by_rank(mk, P))[0]["ticket_mediana"] == expected


def test_items_per_order_histogram(spark):
    mk = marketplace(spark, orders=[order("a"), order("b"), order("c")],
                     items=[item("a", 1), item("a", 2), item("b", 1), item("c", 1)])
    got = [(r["cantidad_items"], r["pedidos"], r["porcentaje"]) for r in rows(core.items_per_order_histogram(mk, P))]
    assert got == [(1, 2, 66.67), (2, 1, 33.33)]


def test_kpi_freight_ratio_skips_zero_revenue(spark):
    mk = marketplace(spark, orders=[order("a"), order("b")],
                     items=[item("a", 1, price=10, freight=5), item("b", 1, price=0, freight=3)])
    got = {r["kpi"]: r["valor"] for r in rows(core.kpi_summary(mk, P))}
    assert got["Flete como % del precio"] == 50.0


def test_month_over_month_zero_and_growth(spark):
    p = P.with_(analysis_start="2017-01-01")
    mk = marketplace(spark, orders=[order("a", pts="2017-01-05 10:00:00"), order("b", pts="2017-02-05 10:00:00"),
                                    order("c", pts="2017-03-05 10:00:00")],
                     payments=[payment("a", 0), payment("b", 50), payment("c", 76.8)])
    got = [(r["mes"], r["crecimiento_pct"]) for r in rows(temporal.month_over_month(mk, p))]
    assert got == [("2017-01", None), ("2017-02", None), ("2017-03", 53.6)]


def test_week_numbers_monday_first(spark):
    df = spark.createDataFrame([(d,) for d in ["2017-01-01", "2017-01-02", "2017-11-24", "2018-12-31"]], "d string")
    got = [r[0] for r in df.select(week_monday_first(F.to_timestamp("d"))).collect()]
    assert got == [0, 1, 47, 53]


def test_hour_parts(spark):
    hours = [0, 5, 6, 11, 12, 17, 18, 23]
    mk = marketplace(spark, orders=[order(f"o{h}", pts=f"2017-05-01 {h:02d}:30:00") for h in hours])
    got = {r["hora"]: r["franja_horaria"] for r in rows(temporal.hour_profile(mk, P))}
    assert [got[h] for h in hours] == ["Madrugada"] * 2 + ["Mañana"] * 2 + ["Tarde"] * 2 + ["Noche"] * 2
    parts = {r["franja"]: r["pedidos"] for r in rows(temporal.daypart_profile(mk, P))}
    assert set(parts.values()) == {2} and len(parts) == 4


def test_pareto_ties_share_cumulative_value(spark):
    orders = [order(x, customer=f"c{x}") for x in "abc"]
    customers = [{"customer_id": f"c{x}", "customer_unique_id": f"u{x}", "customer_state": s}
                 for x, s in zip("abc", "ABC")]
    pays = [payment("a", 50), payment("b", 25), payment("c", 25)]
    mk = marketplace(spark, orders=orders, customers=customers, payments=pays)
    got = {r["estado"]: r["pct_acumulado"] for r in rows(geo.pareto_states(mk, P))}
    assert got == {"A": 50.0, "B": 100.0, "C": 100.0}


def test_state_balance_keeps_buyer_states_only(spark):
    orders = [order("a", customer="cx"), order("b", customer="cy")]
    customers = [{"customer_id": "cx", "customer_unique_id": "ux", "customer_state": "X"},
                 {"customer_id": "cy", "customer_unique_id": "uy", "customer_state": "Y"}]
    pays = [payment("a", 100), payment("b", 10)]
    its = [item("a", 1, price=130, seller="sx"), item("b", 1, price=5, seller="sz")]
    sel = [{"seller_id": "sx", "seller_state": "X"}, {"seller_id": "sz", "seller_state": "Z"}]
    mk = marketplace(spark, orders=orders, customers=customers, payments=pays, items=its, sellers=sel)
    got = {r["estado"]: r["balance"] for r in rows(geo.state_balance(mk, P))}
    assert got == {"X": -30.0, "Y": 10.0}
    full = {r["estado"]: r["balance"] for r in rows(geo.state_balance(mk, P.with_(balance_join="full")))}
    assert full == {"X": -30.0, "Y": 10.0, "Z": -5.0}


def test_missing_and_untranslated_category_share_one_label(spark):
    mk = marketplace(spark, orders=[order("a")],
                     items=[item("a", 1, product="p1"), item("a", 2, product="p2"), item("a", 3, product="p3")],
                     products=[{"product_id": "p1", "product_category_name": None},
                               {"product_id": "p2", "product_category_name": "xx"},
                               {"product_id": "p3", "product_category_name": "yy"}],
                     translation=[{"product_category_name": "yy", "product_category_name_english": "yy_en"}])
    got = {r["categoria"]: r["unidades"] for r in rows(geo.category_mart(mk, P))}
    assert got == {L.NO_CATEGORY: 2, "yy_en": 1}


def test_percentages_are_taken_before_the_limit(spark):
    prods = [{"product_id": f"p{i}", "product_category_name": f"c{i:02d}"} for i in range(16)]
    tr = [{"product_category_name": f"c{i:02d}", "product_category_name_english": f"c{i:02d}"} for i in range(16)]
    its = [item("a", i + 1, product=f"p{i}", price=10) for i in range(16)]
    mk = marketplace(spark, orders=[order("a")], items=its, products=prods, translation=tr)
    got = rows(geo.top_categories_by_revenue(mk, P))
    assert len(got) == 15 and {r["pct_revenue"] for r in got} == {6.3}


def test_quadrant_edges(spark):
    p = P.with_(quadrant_units=4, quadrant_min_units=1, quadrant_price=130)
    spec = [("A", 130, 4), ("B", 130, 3), ("C", 129.99, 4), ("D", 129.99, 3), ("E", 200, 1)]
    its, prods, tr, n = [], [], [], 0
    for cat, price, units in spec:
        prods.append({"product_id": f"p{cat}", "product_category_name": cat})
        tr.append({"product_category_name": cat, "product_category_name_english": cat})
        for _ in range(units):
            n += 1
            its.append(item("a", n, price=price, product=f"p{cat}"))
    mk = marketplace(spark, orders=[order("a")], items=its, products=prods, translation=tr)
    got = {r["categoria"]: r["segmento"] for r in rows(geo.category_quadrants(mk, p))}
    assert got == {"A": L.QUADRANT_STAR, "B": L.QUADRANT_PREMIUM, "C": L.QUADRANT_COMMODITY,
                   "D": L.QUADRANT_LONG_TAIL}


def test_segment_edges(spark):
    df = spark.createDataFrame([(n,) for n in [10, 11, 50, 51, 200, 201]], "n long")
    got = [r[0][0] for r in df.select(bucketize("n", L.SELLER_SEGMENTS, L.SELLER_SEGMENT_OTHER)).collect()]
    assert got == ["1", "2", "2", "3", "3", "4"]


def test_review_fan_out_is_kept(spark):
    p = P.with_(scorecard_min_orders=1, scorecard_mart_min_orders=1)
    mk = marketplace(spark, orders=[order("a", delivered="2017-05-05 10:00:00", estimated="2017-05-20 00:00:00")],
                     items=[item("a", 1, price=10)], sellers=[{"seller_id": "s1", "seller_state": "SP"}],
                     reviews=[review("a", 5, "r1"), review("a", 1, "r2")])
    sc = rows(sellers.seller_scorecard(mk, p))[0]
    assert (sc["pedidos"], sc["revenue"], sc["score_prom"], sc["precio_prom"]) == (1, 20.0, 3.0, 10.0)
    mart = rows(sellers.seller_scorecard_mart(mk, p))[0]
    assert mart["revenue"] == 20.0


def test_seller_class_rules(spark):
    pairs = [(4.0, 5.0), (3.5, 15.0), (2.99, 0.0), (3.2, 20.0), (4.5, 30.0), (4.5, 31.0), (None, 40.0), (None, 10.0)]
    df = spark.createDataFrame(pairs, "score_prom double, pct_tardias double")
    got = [r[0] for r in df.select(sellers.seller_class(P.seller_cuts)).collect()]
    assert got == [L.SELLER_CLASS_TOP, L.SELLER_CLASS_GOOD, L.SELLER_CLASS_ATTENTION, L.SELLER_CLASS_MEDIUM,
                   L.SELLER_CLASS_MEDIUM, L.SELLER_CLASS_ATTENTION, L.SELLER_CLASS_ATTENTION,
                   L.SELLER_CLASS_MEDIUM]


def test_seller_without_reviews_is_kept_with_null_score(spark):
    p = P.with_(scorecard_min_orders=1)
    mk = marketplace(spark, orders=[order("a", delivered="2017-05-05 10:00:00", estimated="2017-05-20 00:00:00")],
                     items=[item("a", 1, price=10)], sellers=[{"seller_id": "s1", "seller_state": "SP"}])
    sc = rows(sellers.seller_scorecard(mk, p))
    assert len(sc) == 1 and sc[0]["score_prom"] is None
    bottom = rows(sellers.bottom_sellers(mk, p))
    assert bottom[0]["seller_id"] == "s1"


def test_empty_input_null_profile(spark):
    mk = marketplace(spark)
    got = rows(quality.order_nulls(mk, P))[0]
    assert got == {"total": 0, "nulos_aprobacion": None, "nulos_fecha_carrier": None, "nulos_fecha_entrega": None}
    assert rows(quality.quality_summary(mk, P))[0]["valor"] == 0


def test_orphans_and_missing_children(spark):
    mk = marketplace(spark, orders=[order("a"), order("b")],
                     items=[item("a"), item("x"), item("x", 2), item(None)],
                     payments=[payment("a", 10)])
    assert rows(quality.orphan_items(mk, P))[0]["items_sin_orden"] == 1
    assert rows(quality.orders_without_payment(mk, P))[0]["pedidos_sin_pago"] == 1
    assert rows(quality.orders_without_items(mk, P))[0]["pedidos_sin_items"] == 1


def test_duplicate_keys(spark):
    mk = marketplace(spark, orders=[order("a"), order("a"), order("b")])
    assert rows(quality.duplicate_orders(mk, P)) == [{"order_id": "a", "cant": 2}]


def test_top_decile_share_and_delivery_median(spark):
    orders = [order(f"o{i}", delivered=f"2017-05-{1 + i:02d} 12:00:00", estimated="2017-06-30 00:00:00",
                    pts="2017-05-01 10:00:00") for i in range(12)]
    its = [item(f"o{i}", 1, price=10 * (i + 1), seller=f"s{i}") for i in range(12)]
    mk = marketplace(spark, orders=orders, items=its)
    t = rows(extras.top_seller_share(mk, P))[0]
    # 12 sellers -> k = 2: 120 + 110 of 780
    assert (t["sellers_total"], t["sellers_top"], t["revenue_top"]) == (12, 2, 230.0)
    assert t["pct_revenue_top"] == 29.5
    assert rows(extras.delivery_median(mk, P))[0]["dias_entrega_mediana"] == 5.5
