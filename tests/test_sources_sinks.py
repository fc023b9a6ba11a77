"""File loader with explicit schemas (CSV and Parquet) and mart sinks."""

import os
import tempfile

import pytest

from tianguis.params import FIXTURE_PARAMS, Params
from tianguis.plans import marts, quality, sellers, temporal
from tianguis.plans.registry import fixture_marketplace
from tianguis.sources.files import load_tables
from tianguis.sources.schema import SCHEMAS


def _write_csv(path, header, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for line in lines:
            f.write(",".join(line) + "\n")


def test_csv_loader_reads_declared_types_and_empty_as_null(spark):
    d = tempfile.mkdtemp(prefix="tianguis-csv-", dir="/tmp")
    _write_csv(f"{d}/orders.csv", ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                                   "order_approved_at", "order_delivered_carrier_date",
                                   "order_delivered_customer_date", "order_estimated_delivery_date"],
               [["o1", "c1", "delivered", "2017-01-05 10:00:00", "", "2017-01-06 10:00:00",
                 "2017-01-09 10:00:00", "2017-01-20 00:00:00"],
                ["o2", "c1", "canceled", "2017-02-05 10:00:00", "", "", "", "2017-02-20 00:00:00"]])
    _write_csv(f"{d}/order_payments.csv", ["order_id", "payment_sequential", "payment_type",
                                           "payment_installments", "payment_value"],
               [["o1", "1", "credit_card", "3", "100.50"], ["o1", "2", "voucher", "1", "20.25"]])
    empty = {"order_items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
                             "price", "freight_value"],
             "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                           "customer_state"],
             "order_reviews": ["review_id", "order_id", "review_score", "review_comment_title",
                               "review_comment_message", "review_creation_date", "review_answer_timestamp"],
             "products": ["product_id", "product_category_name", "product_weight_g"],
             "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
             "category_translation": ["product_category_name", "product_category_name_english"]}
    for name, header in empty.items():
        _write_csv(f"{d}/{name}.csv", header, [])
    names = ["orders", "order_items", "order_payments", "customers", "order_reviews", "products", "sellers",
             "category_translation"]
    mk = load_tables(spark, {n: f"{d}/{n}.csv" for n in names}, fmt="csv")
    assert dict(mk.payments.dtypes)["payment_value"] == "decimal(18,2)"
    assert dict(mk.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert mk.orders.where("order_approved_at IS NULL").count() == 2
    p = Params(analysis_start="2017-01-01")
    got = temporal.monthly(mk, p).collect()
    assert [(r.mes, r.pedidos, r.revenue, r.ticket_promedio) for r in got] == [("2017-01", 1, 120.75, 60.38)]


def _load(spark, d):
    return load_tables(spark, {n: f"{d}/{n}.csv" for n in SCHEMAS}, fmt="csv")


def _csv_folder():
    d = tempfile.mkdtemp(prefix="tianguis-csv-", dir="/tmp")
    for name, schema in SCHEMAS.items():
        _write_csv(f"{d}/{name}.csv", [f.name for f in schema.fields], [])
    return d


def test_csv_quoted_line_breaks_and_doubled_quotes(spark):
    d = _csv_folder()
    with open(f"{d}/order_reviews.csv", "w") as f:
        f.write("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp\n"
                'r1,o1,5,"good ""very""","first line\nsecond, line",2017-01-05 00:00:00,2017-01-06 10:00:00\n'
                "r2,o2,1,,,2017-01-05 00:00:00,\n")
    mk = _load(spark, d)
    assert mk.reviews.count() == 2
    r = mk.reviews.orderBy("review_id").first()
    assert (r.review_comment_title, r.review_comment_message) == ('good "very"', "first line\nsecond, line")
    nulls = quality.review_nulls(mk, Params()).first()
    assert (nulls.total, nulls.sin_titulo, nulls.sin_mensaje) == (2, 1, 1)
    counts = {x.tabla: x.total_filas for x in quality.row_count_report(mk, Params()).collect()}
    assert counts["order_reviews"] == 2
    # the same rows as Parquet give the same results
    mk.reviews.write.parquet(f"{d}/parquet")
    back = load_tables(spark, {**{n: f"{d}/{n}.csv" for n in SCHEMAS}}, fmt="csv")
    assert spark.read.parquet(f"{d}/parquet").exceptAll(back.reviews).count() == 0


def test_csv_columns_are_found_by_name(spark):
    d = _csv_folder()
    _write_csv(f"{d}/category_translation.csv", ["product_category_name_english", "product_category_name"],
               [["toys", "brinquedos"]])
    t = _load(spark, d).translation.first()
    assert (t.product_category_name, t.product_category_name_english) == ("brinquedos", "toys")


def test_fold_case(spark):
    d = _csv_folder()
    _write_csv(f"{d}/category_translation.csv", ["product_category_name", "product_category_name_english"],
               [[" Brinquedos", "Toys"]])
    paths = {n: f"{d}/{n}.csv" for n in SCHEMAS}
    t = load_tables(spark, paths, "csv", fold_case=("product_category_name",)).translation.first()
    assert tuple(t) == ("brinquedos", "Toys")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_missing_columns_are_named(spark, fmt):
    d = _csv_folder()
    if fmt == "csv":
        _write_csv(f"{d}/orders.csv", ["order_id"], [["o1"]])
        paths = {n: f"{d}/{n}.csv" for n in SCHEMAS}
    else:
        paths = {}
        for n, schema in SCHEMAS.items():
            df = spark.createDataFrame([], schema)
            (df.select("order_id") if n == "orders" else df).write.parquet(f"{d}/{n}")
            paths[n] = f"{d}/{n}"
    with pytest.raises(ValueError, match="orders: columns missing.*customer_id"):
        load_tables(spark, paths, fmt=fmt)


def test_export_marts_parquet_and_csv(spark):
    mk = fixture_marketplace(spark, "/root/testdata/sf0.001")
    d = tempfile.mkdtemp(prefix="tianguis-marts-", dir="/tmp")
    paths = marts.export_marts(mk, FIXTURE_PARAMS, f"{d}/pq")
    assert len(paths) == 5
    back = spark.read.parquet(f"{d}/pq/monthly")
    assert back.count() == temporal.monthly_mart(mk, FIXTURE_PARAMS).count()
    marts.export_marts(mk, FIXTURE_PARAMS, f"{d}/csv", fmt="csv", names=["states"])
    csv = spark.read.option("header", True).csv(f"{d}/csv/states")
    assert set(csv.columns) == {"estado", "pedidos", "clientes", "revenue", "ticket_promedio"}


def test_seller_report_shares_one_checkpointed_base(spark):
    mk = fixture_marketplace(spark, "/root/testdata/sf0.001")
    p = FIXTURE_PARAMS.with_(scorecard_min_orders=5)
    rep = marts.seller_report(mk, p)
    direct = sorted(map(tuple, sellers.seller_scorecard(mk, p).collect()))
    assert sorted(map(tuple, rep["scorecard"].collect())) == direct
    assert rep["top"].count() == min(10, len(direct))
