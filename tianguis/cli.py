"""Run analyses over stored marketplace tables and write each result.

    python -m tianguis.cli --tables DIR --out DIR [--format parquet|csv]
        [--output-format parquet|csv] [--queries f1_status_dist,f3_monthly ...]
        [--param analysis_start=2017-01-01 --param scorecard_min_orders=20 ...]
        [--param 'seller_segments=Micro:1..10;Mediano:11..200;Grande:201..']
        [--param seller_cuts=top_score:4.5,top_late:3]
        [--collate customer_state,seller_state,product_category_name]

``--tables`` holds one folder or file per table, named as in
``sources/schema.SCHEMAS`` (``orders``, ``order_items``, ``order_payments``,
``customers``, ``order_reviews``, ``products``, ``sellers``,
``category_translation``; a ``.csv``/``.parquet`` suffix is accepted). Every
result is written by the executors under ``--out/<query>``; nothing is
collected to the driver. The Spark session comes from the environment
(``spark-submit`` settings or defaults).
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession

from tianguis.functions.rules import Band
from tianguis.params import BAND_TABLES, Params, SellerCuts
from tianguis.plans.registry import PLANS
from tianguis.sources.files import load_tables
from tianguis.sources.schema import SCHEMAS
from tianguis.sources.sinks import write_mart


def _table_paths(spark: SparkSession, base: str, fmt: str) -> dict[str, str]:
    """The folder or file of each table, looked up in whatever file system ``base`` is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    out = {}
    for name in SCHEMAS:
        for cand in (f"{base}/{name}", f"{base}/{name}.{fmt}"):
            path = hadoop(cand)
            if path.getFileSystem(conf).exists(path):
                out[name] = cand
                break
    return out


def _bands(raw: str) -> tuple[Band, ...]:
    """``label:low..high`` joined by ``;``; an edge may be missing (``label:201..``)."""
    out = []
    for part in raw.split(";"):
        label, colon, span = part.rpartition(":")
        low, dots, high = span.partition("..")
        if not colon or not dots:
            raise ValueError(f"a band is label:low..high, not {part!r}")
        out.append(Band(label, int(low) if low.strip() else None, int(high) if high.strip() else None))
    return tuple(out)


def _truth(raw: str) -> bool:
    words = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
    if raw.lower() not in words:
        raise ValueError(f"expected true or false, not {raw!r}")
    return words[raw.lower()]


def _cuts(raw: str) -> SellerCuts:
    """``name:value`` joined by commas; cuts not named keep their value."""
    return SellerCuts(**{k.strip(): float(v) for k, v in (x.split(":") for x in raw.split(","))})


def _params(pairs: list[str]) -> Params:
    p = Params()
    fields = {f.name: f for f in dataclasses.fields(Params)}
    updates = {}
    for pair in pairs:
        key, _, raw = pair.partition("=")
        if key not in fields:
            raise SystemExit(f"unknown parameter {key!r}")
        current = getattr(p, key)
        try:
            if key in BAND_TABLES:
                updates[key] = _bands(raw)
            elif isinstance(current, SellerCuts):
                updates[key] = _cuts(raw)
            elif isinstance(current, tuple):
                updates[key] = tuple(int(x) for x in raw.split(","))
            elif isinstance(current, bool):
                updates[key] = _truth(raw)
            else:
                updates[key] = (float if fields[key].type == "float" else type(current))(raw)
        except (ValueError, TypeError) as e:
            raise SystemExit(f"parameter {key}: {e}") from e
    try:
        return p.with_(**updates)
    except ValueError as e:
        raise SystemExit(str(e)) from e


def run(spark: SparkSession, tables: str, out: str, fmt: str = "parquet", output_format: str = "parquet",
        queries: list[str] | None = None, params: Params | None = None, collate: tuple[str, ...] = ()) -> list[str]:
    mk = load_tables(spark, _table_paths(spark, tables, fmt), fmt=fmt, collate=collate)
    p = params or Params()
    written = []
    for name in queries or list(PLANS):
        write_mart(PLANS[name](mk, p), f"{out}/{name}", output_format)
        written.append(name)
    return written


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tianguis", description=__doc__.splitlines()[0])
    ap.add_argument("--tables", required=True, help="folder with one folder/file per table")
    ap.add_argument("--out", required=True, help="folder for the results (one per analysis)")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"], help="format of the tables")
    ap.add_argument("--output-format", default="parquet", choices=["parquet", "csv"],
                    help="format of the results")
    ap.add_argument("--queries", default="", help="comma-separated keys (default: all)")
    ap.add_argument("--param", action="append", default=[], help="name=value override of Params")
    ap.add_argument("--collate", default="", help="comma-separated text columns compared without case and accents")
    a = ap.parse_args(argv)
    names = [q for q in a.queries.split(",") if q] or None
    unknown = [q for q in names or [] if q not in PLANS]
    if unknown:
        ap.error(f"unknown queries: {unknown}")
    spark = SparkSession.builder.appName("tianguis").getOrCreate()
    done = run(spark, a.tables, a.out, a.format, a.output_format, names, _params(a.param),
               tuple(c for c in a.collate.split(",") if c))
    print(f"wrote {len(done)} results under {a.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
