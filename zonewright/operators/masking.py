"""Masking: hash columns beside the originals, then swap PII for its hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from zonewright.functions.columns import col, masked_name, name_folding, sha256_hex


def mask_columns(df: DataFrame, columns: Sequence[str], salt: str | None = None) -> DataFrame:
    """Add ``masked_<c>``, the SHA-256 hex of ``c``, for every listed column."""
    fields = df.select(*[col(c) for c in columns]).schema.fields if columns else []
    return df.withColumns(
        {
            masked_name(c): sha256_hex(col(c), f.dataType, salt)
            for c, f in zip(columns, fields, strict=True)
        }
    )


def pii_swap(
    df: DataFrame,
    masking_cols: Sequence[str],
    pii_cols: Sequence[str],
    drop_raw: bool = False,
) -> DataFrame:
    """Replace each PII column by its mask, which takes over the column's name.

    Columns that are masked but not PII keep both forms unless ``drop_raw``. The masked
    columns come last, in ``masking_cols`` order.
    """
    fold = name_folding(df)
    pii = {fold(c) for c in pii_cols}
    masking = {fold(c): c for c in masking_cols}
    if not pii <= masking.keys():
        raise ValueError(f"PII columns without a mask: {sorted(pii - masking.keys())}")
    gone = set(masking if drop_raw else pii) | {fold(masked_name(c)) for c in masking.values()}
    kept = [col(c) for c in df.columns if fold(c) not in gone]
    masks = [
        col(masked_name(c)).alias(c if key in pii else masked_name(c))
        for key, c in masking.items()
    ]
    return df.select(*kept, *masks)
