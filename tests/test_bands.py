"""Band tables and class cuts are parameters: checked, read by the plans, settable from the command line."""

import pytest

from helpers import item, marketplace, order, review
from tianguis.cli import _params
from tianguis.functions import labels as L
from tianguis.functions.rules import Band
from tianguis.params import BAND_TABLES, FIXTURE_PARAMS, Params, SellerCuts
from tianguis.plans import quality, sellers, temporal


def _mk(spark):
    orders = [order("a", pts="2017-05-01 05:00:00", delivered="2017-05-04 10:00:00", estimated="2017-05-02 00:00:00"),
              order("b", pts="2017-05-01 13:00:00", delivered="2017-05-21 10:00:00", estimated="2017-05-02 00:00:00")]
    return marketplace(spark, orders=orders, items=[item("a", seller="s1"), item("b", seller="s1"), item("b", 2, seller="s2")],
                       reviews=[review("a", 4), review("b", 4)],
                       sellers=[{"seller_id": s, "seller_state": "SP"} for s in ("s1", "s2")])


def _labels(df, col):
    return sorted((r[col] for r in df.collect()), key=str)


def test_each_band_table_can_be_overridden(spark):
    mk = _mk(spark)
    p = Params()
    late = p.with_(late_delay_bands=(Band("short", 1, 2), Band("long", 3, None)))
    assert _labels(quality.late_delay_buckets(mk, late), "rango_retraso") == ["long", "short"]
    days = p.with_(delivery_bands=(Band("fast", 0, 3),), delivery_band_other="slow")
    assert _labels(sellers.delivery_histogram(mk, days), "rango_entrega") == ["fast", "slow"]
    assert _labels(sellers.score_by_delivery_band(mk, days), "rango_entrega") == ["fast", "slow"]
    hours = p.with_(hour_parts=(Band("early", 0, 11),), hour_part_other="later")
    assert {r.hora: r.franja_horaria for r in temporal.hour_profile(mk, hours).collect()} == {5: "early", 13: "later"}
    parts = p.with_(numbered_hour_parts=(Band("1 early", 0, 11),), numbered_hour_part_other="2 later")
    assert _labels(temporal.daypart_profile(mk, parts), "franja") == ["1 early", "2 later"]
    sizes = p.with_(seller_segments=(Band("one", 1, 1),), seller_segment_other="more")
    assert _labels(sellers.seller_segments(mk, sizes), "segmento") == ["more", "one"]


def test_class_cuts_can_be_overridden(spark):
    mk = _mk(spark)
    p = Params(scorecard_min_orders=1)
    strict = {r.clasificacion for r in sellers.seller_scorecard(mk, p).collect()}
    mild = {r.clasificacion for r in sellers.seller_scorecard(mk, p.with_(seller_cuts=SellerCuts(
        top_late=100, good_late=100, bad_late=100))).collect()}
    assert strict == {L.SELLER_CLASS_ATTENTION} and mild == {L.SELLER_CLASS_TOP}


@pytest.mark.parametrize("bands, said", [
    ((), "no band"),
    ((Band("a", 0, 5), Band("b", 5, 9)), "overlap"),
    ((Band("a", 0, 5), Band("b", 7, 9)), "gap"),
    ((Band("a", 0, 5), Band("b", above=6)), "gap"),
    ((Band("a", 0, None), Band("b", 7, 9)), "no edge"),
    ((Band("a", 0, 5), Band("b", None, 9)), "no edge"),
    ((Band("a", 0, 5), Band("a", 6, 9)), "differ"),
    ((Band("", 0, 5),), "labels"),
    ((Band("a", 5, 4),), "empty"),
    ((Band("a", 5, 9, above=3),), "two lower edges"),
])
def test_gaps_and_overlaps_are_refused(bands, said):
    for name in BAND_TABLES:
        with pytest.raises(ValueError, match=f"{name}: .*{said}"):
            Params(**{name: bands})


def test_cuts_out_of_order_are_refused():
    with pytest.raises(ValueError, match="out of order"):
        SellerCuts(top_score=3.0)


def test_command_line():
    p = _params(["seller_segments=Micro:1..10;Mediano:11..200;Grande:201..", "seller_cuts=top_score:4.5,top_late:3",
                 "approximate_distinct=false", "approximate_quantiles=true"])
    assert p.seller_segments == (Band("Micro", 1, 10), Band("Mediano", 11, 200), Band("Grande", 201))
    assert p.seller_cuts == SellerCuts(top_score=4.5, top_late=3.0)
    assert (p.approximate_distinct, p.approximate_quantiles) == (False, True)
    for wrong in ("hour_parts=a:1..5;b:7..9", "hour_parts=a", "seller_cuts=nothing:1", "approximate_distinct=maybe", "no_such=1"):
        with pytest.raises(SystemExit):
            _params([wrong])


def test_defaults_are_the_fixed_values():
    assert FIXTURE_PARAMS.late_delay_bands == L.LATE_DELAY_BANDS and FIXTURE_PARAMS.seller_segments == L.SELLER_SEGMENTS
