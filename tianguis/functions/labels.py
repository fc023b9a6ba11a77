"""Output labels and band edges that must equal the original analyses.

They are part of the output surface (BI dashboards filter on them), so they are
kept verbatim, including the labels that do not describe their predicate
(the first delivery band holds 0..7 days, the last one everything else,
negative values included).
"""

from tianguis.functions.rules import Band

# ---- fixed values -------------------------------------------------------
# Lateness of late deliveries, in days past the estimate (no ELSE: other -> NULL)
LATE_DELAY_BANDS = (
    Band("1-3 días", 1, 3),
    Band("4-7 días", 4, 7),
    Band("8-15 días", 8, 15),
    Band("más de 15 días", above=15),
)

# Days from purchase to delivery
DELIVERY_BANDS = (
    Band("1. 1-7 días", 0, 7),
    Band("2. 8-14 días", 8, 14),
    Band("3. 15-21 días", 15, 21),
    Band("4. 22-30 días", 22, 30),
)
DELIVERY_BAND_OTHER = "5. 30+ días"

# Hour of purchase -> part of the day
HOUR_PARTS = (
    Band("Mañana", 6, 11),
    Band("Tarde", 12, 17),
    Band("Noche", 18, 23),
)
HOUR_PART_OTHER = "Madrugada"

HOUR_PARTS_NUMBERED = (
    Band("1. Mañana (6-11hs)", 6, 11),
    Band("2. Tarde (12-17hs)", 12, 17),
    Band("3. Noche (18-23hs)", 18, 23),
)
HOUR_PART_NUMBERED_OTHER = "4. Madrugada (0-5hs)"

# Sellers by number of distinct delivered orders
SELLER_SEGMENTS = (
    Band("1. Micro  (1-10 pedidos)", 1, 10),
    Band("2. Pequeño (11-50 pedidos)", 11, 50),
    Band("3. Mediano (51-200 pedidos)", 51, 200),
)
SELLER_SEGMENT_OTHER = "4. Grande (200+ pedidos)"

# Category price x volume quadrants
QUADRANT_STAR = "Estrella (precio alto + volumen alto)"
QUADRANT_PREMIUM = "Nicho premium (precio alto + volumen bajo)"
QUADRANT_COMMODITY = "Commodity (precio bajo + volumen alto)"
QUADRANT_LONG_TAIL = "Larga cola (precio bajo + volumen bajo)"

# Seller classes (their cuts: params.SellerCuts)
SELLER_CLASS_TOP = "Top performer"
SELLER_CLASS_GOOD = "Buen performance"
SELLER_CLASS_ATTENTION = "Requiere atención"
SELLER_CLASS_MEDIUM = "Performance medio"

ON_TIME = "A tiempo"
LATE = "Tardía"
NO_CATEGORY = "Sin categoría"
TOP_RANKING = "Top 10 por score"
BOTTOM_RANKING = "Bottom 10 por score"

# Row-count report: table labels
ROW_COUNT_TABLES = ["orders", "order_items", "order_payments", "customers",
                    "order_reviews", "products", "sellers"]

# Quality summary: metric labels and their fixed remarks (text, not computed)
QUALITY_SUMMARY = [
    ("Total pedidos", ""),
    ("Pedidos entregados", "97.0% del total"),
    ("Pedidos cancelados", "0.6% — impacto bajo"),
    ("Pedidos sin pago", "Anomalía puntual"),
    ("Pedidos sin review", "0.8% — aceptable"),
    ("Productos sin categoría", "1.9% — excluir en análisis de categorías"),
    ("Entregas tardías", "8.1% de los entregados"),
]

# KPI summary labels
KPI_LABELS = [
    "Revenue total (R$)",
    "Total pedidos entregados",
    "Ticket promedio por pedido (R$)",
    "Precio promedio por ítem (R$)",
    "Flete promedio por pedido (R$)",
    "Flete como % del precio",
    "Ítems promedio por pedido",
]
# ---- end of fixed values ------------------------------------------------
