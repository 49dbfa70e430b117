"""Reading tables: driver Parquet tables and the domain tables derived from them."""

from .shared import follow_sources, forget, shared_view, write_bucketed
from .tables import DRIVER_TABLES, Tables, load_tables

__all__ = ["DRIVER_TABLES", "Tables", "follow_sources", "forget", "load_tables", "shared_view", "write_bucketed"]
