"""What a job needs to know: zones, columns to mask, cast rules, lookup table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

# The file formats and the type names of cast rules in a configuration.
FORMATS = ("parquet", "csv")
DECIMAL, STRING, ARRAY = "DecimalType", "StringType", "ArrayType"


@dataclass(frozen=True)
class Zone:
    """A root directory and the file format of the datasets below it.

    ``multi_line`` lets CSV values hold line breaks, in files whose lines end in a line feed.
    Such files cannot be split, so a task reads a whole one; without it a line break is refused
    when writing. ``null_text`` stands
    for NULL in CSV files and cannot be a value; without it NULL is an empty field, and an
    empty text is read back as NULL.
    """

    root: str
    fmt: str = "parquet"
    multi_line: bool = False
    null_text: str | None = None

    def __post_init__(self) -> None:
        if self.fmt not in FORMATS:
            raise ValueError(f"unknown format {self.fmt!r}, expected one of {FORMATS}")


@dataclass(frozen=True)
class CastRule:
    """One column conversion.

    ``kind`` is ``decimal`` (to ``decimal(precision, scale)``), ``string``, or
    ``array`` (an array flattened to comma-separated text).
    """

    column: str
    kind: str
    scale: int | None = None
    precision: int = 10

    def __post_init__(self) -> None:
        if self.kind not in ("decimal", "string", "array"):
            raise ValueError(f"unknown cast kind {self.kind!r} for column {self.column!r}")
        if self.kind == "decimal":
            if self.scale is None or not 0 <= self.scale <= self.precision <= 38:
                raise ValueError(
                    f"bad decimal({self.precision},{self.scale}) for column {self.column!r}"
                )

    @classmethod
    def parse(cls, text: str) -> CastRule:
        """Read ``col:DecimalType:<any>:<scale>``, ``col:StringType:ArrayType`` or
        ``col:StringType:<any>``; fields after these mean nothing."""
        parts = text.split(":")
        if len(parts) >= 4 and parts[1] == DECIMAL:
            try:
                scale = int(parts[3])
            except ValueError:
                raise ValueError(f"bad scale in cast rule {text!r}") from None
            return cls(parts[0], "decimal", scale)
        if len(parts) >= 3 and parts[1] == STRING:
            return cls(parts[0], "array" if parts[2] == ARRAY else "string")
        raise ValueError(f"cannot read cast rule {text!r}")


def as_rules(rules: Sequence[str | CastRule]) -> list[CastRule]:
    return [r if isinstance(r, CastRule) else CastRule.parse(r) for r in rules]


@dataclass(frozen=True)
class JobSpec:
    """Everything the landing -> raw -> staging jobs need for one dataset.

    ``lookup_keys`` picks the lookup table's meaning: empty keeps an insert-if-absent
    dictionary of the PII values, a business key keeps a type-2 history of them.
    """

    dataset: str
    landing: Zone
    raw: Zone
    staging: Zone
    masking_cols: Sequence[str]
    cast_rules: Sequence[CastRule] = ()
    partition_cols: Sequence[str] = ()
    pii_cols: Sequence[str] = ()
    lookup_path: str | None = None
    lookup_keys: Sequence[str] = ()
    mask_source: Zone | None = None  # where staging reads from; the raw zone unless set
    lookup_distinct: bool = False  # dictionary: drop repeated PII values of a batch
    lookup_order_by: Sequence[str] = ()  # history: columns telling the last row of a key
    lookup_buckets: int | None = None  # history: folders of a new one, else by its size

    def __post_init__(self) -> None:
        # Names that only differ in case are told apart, if at all, by the session's analysis.
        masked = {c.lower() for c in self.masking_cols}
        unmasked = [c for c in self.pii_cols if c.lower() not in masked]
        if unmasked:
            raise ValueError(f"PII columns not in masking-cols: {unmasked}")
        if self.pii_cols and not self.lookup_path:
            raise ValueError("PII columns need a lookup path")
        if self.lookup_keys and not self.pii_cols:
            raise ValueError("a lookup history needs PII columns to follow")
        object.__setattr__(self, "cast_rules", tuple(as_rules(self.cast_rules)))

    @property
    def staging_source(self) -> Zone:
        return self.mask_source or self.raw

    @classmethod
    def from_config(cls, config: Mapping, dataset: str, **extra) -> JobSpec:
        """Build a spec from the parsed JSON job configuration."""
        # The key names of the configuration file.
        ingest, mask = config[f"ingest-{dataset}"], config[f"mask-{dataset}"]

        def zone(part: Mapping, fmt: str | None = None) -> Zone:
            return Zone(part["data-location"], part.get("file-format") or fmt or "parquet")

        landing = zone(ingest["source"])
        return cls(
            dataset=dataset,
            landing=landing,
            raw=zone(ingest["destination"], landing.fmt),
            mask_source=zone(mask["source"]),
            staging=zone(mask["destination"]),
            masking_cols=tuple(mask["masking-cols"]),
            cast_rules=tuple(mask["datatype-update-cols"]),
            partition_cols=tuple(mask.get("partition-cols") or ()),
            pii_cols=tuple(config[f"{dataset}-pii-cols"]),
            lookup_path=config[f"{dataset}-lookup_dataset"],
            **extra,
        )


def load_config(spark: SparkSession, path: str) -> dict:
    """Read a JSON job configuration from any file system Spark can reach."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one configuration file at {path}")
    return json.loads(rows[0][0])
