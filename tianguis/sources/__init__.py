"""Sources and sinks: explicit schemas, parquet/CSV loaders, the fixture mapping, mart writers."""

from tianguis.sources.files import load_tables
from tianguis.sources.fixture import from_tpch
from tianguis.sources.model import Marketplace
from tianguis.sources.sinks import write_mart

__all__ = ["Marketplace", "from_tpch", "load_tables", "write_mart"]
