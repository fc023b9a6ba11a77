"""The marketplace: eight DataFrames, one per table, plus helpers the plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Source = DataFrame | Callable[[], DataFrame]

#: Field -> table name.
TABLES = {
    "orders": "orders",
    "items": "order_items",
    "payments": "order_payments",
    "customers": "customers",
    "reviews": "order_reviews",
    "products": "products",
    "sellers": "sellers",
    "translation": "category_translation",
}


class Marketplace:
    """Handles of the eight tables. A table given as a function is built when a plan
    first asks for it, so a plan analyses only the tables it reads."""

    def __init__(self, *, orders: Source, items: Source, payments: Source, customers: Source, reviews: Source,
                 products: Source, sellers: Source, translation: Source):
        self._sources: dict[str, Source] = {
            "orders": orders, "items": items, "payments": payments, "customers": customers,
            "reviews": reviews, "products": products, "sellers": sellers, "translation": translation}
        self._built: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}
        self._before: Marketplace | None = None
        #: True if the fact tables lie bucketed by order_id, which their joins should keep.
        self.bucketed = False

    def table(self, field: str) -> DataFrame:
        if field not in self._built:
            source = self._sources[field]
            self._built[field] = source if isinstance(source, DataFrame) else source()
        return self._built[field]

    @property
    def built(self) -> frozenset[str]:
        """Fields of the tables that some plan has asked for."""
        return frozenset(self._built)

    def rows(self, field: str) -> int:
        """Rows of a table, counted once: a size to deal partitions by, not a result. Exchanged tables
        count as those before them, so that a slice is not computed twice."""
        if self._before:
            return self._before.rows(field)
        if field not in self._rows:
            self._rows[field] = self.table(field).count()
        return self._rows[field]

    def replace(self, **tables: Source) -> Marketplace:
        """The same marketplace with some tables exchanged; the others stay unbuilt."""
        rest = {f: (lambda f=f: self.table(f)) for f in TABLES}
        made = Marketplace(**{**rest, **tables})
        made._before, made.bucketed = self, self.bucketed
        return made

    orders = property(lambda self: self.table("orders"))
    items = property(lambda self: self.table("items"))
    payments = property(lambda self: self.table("payments"))
    customers = property(lambda self: self.table("customers"))
    reviews = property(lambda self: self.table("reviews"))
    products = property(lambda self: self.table("products"))
    sellers = property(lambda self: self.table("sellers"))
    translation = property(lambda self: self.table("translation"))

    def tables(self) -> dict[str, DataFrame]:
        """All tables by name; builds those that are not yet built."""
        return {name: self.table(field) for field, name in TABLES.items()}
