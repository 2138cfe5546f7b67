"""Keyed-table analytics on Spark DataFrames: counts and skew, vector search, keyed writes, typed
import, audited export, table jobs and their streaming forms."""

from keyspan.model import Codec, KeyspanError, MissingKeyError, TableSpec

__all__ = ["Codec", "KeyspanError", "MissingKeyError", "TableSpec"]
