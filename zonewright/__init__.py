"""Zone-to-zone data preparation on Spark: ingest, mask, cast, look up, reconcile.

Every operator takes and returns a DataFrame and is built from Spark's own
column functions and joins; sinks and whole jobs live in ``sources`` and
``plans``.
"""

from zonewright.operators.casting import cast_columns
from zonewright.operators.dictionary import (
    lookup_bootstrap,
    lookup_first_run,
    lookup_projection,
    lookup_upsert,
)
from zonewright.operators.masking import mask_columns, pii_swap
from zonewright.operators.heavy import heavy_keys, spread_join
from zonewright.operators.quality import (
    assert_passed,
    check_text_types,
    check_types,
    non_null_counts,
    reconcile,
    reconcile_values,
)
from zonewright.operators.scd2 import (
    detect_changes,
    scd2_changes,
    scd2_merge,
    scd2_open,
    stage_updates,
)
from zonewright.plans.spec import CastRule, JobSpec, Zone
from zonewright.sources.zones import read_zone, write_zone

__all__ = [
    "CastRule",
    "JobSpec",
    "Zone",
    "assert_passed",
    "cast_columns",
    "check_text_types",
    "check_types",
    "detect_changes",
    "heavy_keys",
    "lookup_bootstrap",
    "lookup_first_run",
    "lookup_projection",
    "lookup_upsert",
    "mask_columns",
    "non_null_counts",
    "pii_swap",
    "read_zone",
    "reconcile",
    "reconcile_values",
    "scd2_changes",
    "scd2_merge",
    "scd2_open",
    "spread_join",
    "stage_updates",
    "write_zone",
]
