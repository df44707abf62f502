"""logspark: structured event-log analytics expressed as Spark DataFrame plans.

Every operator takes and returns DataFrames (or Columns) so that Catalyst can prune,
push down and fuse the whole chain; see README.md for the operator map.
"""

from logspark.schema import EVENT_COLUMNS, LEVELS, PRIMARY_FACETS

__all__ = ["EVENT_COLUMNS", "LEVELS", "PRIMARY_FACETS"]
