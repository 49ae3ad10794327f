"""All registered queries over the driver's tables, with their SQL."""

from . import audits, forms, joins, jsondocs, pictures, records, rollups, streams, texts, textual, workflow
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "forms", "joins", "jsondocs", "pictures", "records", "rollups", "streams", "texts", "textual", "workflow"]
