"""Analysis parameters.

The defaults are the literals of the original analyses (scope status, date
windows, cut-offs, top-k sizes). ``FIXTURE_PARAMS`` moves the date windows and
quadrant cuts onto the synthetic test data, whose orders span 1995-2001 and whose
prices are TPC-H sized; every other value keeps its default.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from tianguis.functions import labels as L
from tianguis.functions.rules import Band, check_bands


#: Parameters that are tables of bands.
BAND_TABLES = ("late_delay_bands", "delivery_bands", "hour_parts", "numbered_hour_parts", "seller_segments")


@dataclass(frozen=True)
class SellerCuts:
    """Cuts of the seller classes: top and good need a score of at least, and a late share of at
    most, theirs; a score below, or a late share above, the bad ones needs attention."""

    top_score: float = 4.0
    top_late: float = 5.0
    good_score: float = 3.5
    good_late: float = 15.0
    bad_score: float = 3.0
    bad_late: float = 30.0

    def __post_init__(self) -> None:
        if not (self.top_score >= self.good_score >= self.bad_score and self.top_late <= self.good_late <= self.bad_late):
            raise ValueError(f"seller cuts out of order: {self}")


@dataclass(frozen=True)
class Params:
    # scope rules
    scope_status: str = "delivered"
    canceled_status: str = "canceled"
    excluded_payment_type: str = "not_defined"
    # time windows (half-open ranges, local timestamps without zone)
    analysis_start: str = "2017-01-01"
    compare_years: tuple[int, ...] = (2017, 2018)
    compare_months: tuple[int, int] = (1, 8)
    peak_start: str = "2017-11-01"
    peak_end: str = "2017-12-01"
    # category price x volume quadrants
    quadrant_price: float = 130.0
    quadrant_units: int = 4000
    quadrant_min_units: int = 100
    # top-k sizes
    top_categories_by_revenue: int = 15
    top_categories_by_units: int = 10
    top_categories_quadrants: int = 20
    top_products: int = 10
    top_sellers: int = 10
    bottom_sellers: int = 10
    top_n_share: int = 5
    top_seller_fraction: float = 0.1
    # seller scorecards
    scorecard_min_orders: int = 20
    scorecard_mart_min_orders: int = 10
    # state balance: "left" lists buyer states only (as written); "full" also
    # lists states that only sell
    balance_join: str = "left"
    # seller scorecards: False repeats an item for each review of its order (as
    # written); True counts prices, delivery days and late items once per item
    one_review_row_per_item: bool = False
    # distinct orders and buyers per state or month, and overall: exact, or by sketch
    approximate_distinct: bool = False
    # medians: exact, or from mergeable quantile sketches of this size (rank error about 2 / size)
    approximate_quantiles: bool = False
    quantile_sketch_size: int = 2048
    # payments are reduced to a narrow time slice by a filter of 2**bits bits (0: not)
    slice_filter_bits: int = 27
    # items of the seller reports that one task joins and groups, about (0: as many as Spark deals it)
    items_per_task: int = 500_000
    # bands: whole days late, whole days to deliver, hour of the day, delivered orders of a seller.
    # A number that no band holds gets the "other" label (late days: NULL)
    late_delay_bands: tuple[Band, ...] = L.LATE_DELAY_BANDS
    delivery_bands: tuple[Band, ...] = L.DELIVERY_BANDS
    delivery_band_other: str = L.DELIVERY_BAND_OTHER
    hour_parts: tuple[Band, ...] = L.HOUR_PARTS
    hour_part_other: str = L.HOUR_PART_OTHER
    numbered_hour_parts: tuple[Band, ...] = L.HOUR_PARTS_NUMBERED
    numbered_hour_part_other: str = L.HOUR_PART_NUMBERED_OTHER
    seller_segments: tuple[Band, ...] = L.SELLER_SEGMENTS
    seller_segment_other: str = L.SELLER_SEGMENT_OTHER
    seller_cuts: SellerCuts = SellerCuts()

    def __post_init__(self) -> None:
        for name in BAND_TABLES:
            check_bands(name, getattr(self, name))

    @property
    def quantile_k(self) -> int:
        """Size of the quantile sketches; 0 for exact medians."""
        return self.quantile_sketch_size if self.approximate_quantiles else 0

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT_PARAMS = Params()

FIXTURE_PARAMS = Params(
    analysis_start="1996-01-01",
    compare_years=(1999, 2000),
    peak_start="1997-11-01",
    peak_end="1997-12-01",
    quadrant_price=53000.0,
    quadrant_units=2200,
    quadrant_min_units=100,
)
