"""Late fetch: the wide rows of a few keys, found by what Parquet's files know of themselves.

Wide rows are written sorted by key within ranges, in small row groups, with a Bloom filter of the key.  The few keys that are
wanted are known before the wide table is read, and reach its scan as literals: row groups and pages without any of
them are not read, which a join could not say in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch

ROW_GROUP_BYTES = 8 << 20
#: Rows of a page, the least that is read.
PAGE_ROWS = 256
#: Keys that may be asked for at once.
MOST_KEYS = 10_000


def write_clustered(rows: DataFrame, path: str, key: str, *then: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Writes ``rows`` sorted by ``key`` and ``then``; one key's rows may be in several ranges, so none grows without bound.

    ``rows`` are computed once for the bounds of the ranges and once to be written, so they had better be written already.
    """
    sorted_ = rows.repartitionByRange(key, *then).sortWithinPartitions(key, *then)
    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(PAGE_ROWS), f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    sorted_.write.mode("overwrite").options(**options).parquet(path)


def written(rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` as they are written once to a scratch folder, and that folder, for the caller to delete."""
    path = scratch.shared_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def few(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of a few keys, which reach the scan as literals."""
    if len(values) > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} keys are fetched at once")
    return rows.where(F.col(key).isin(list(values)) if values else F.lit(False))


def local(rows: DataFrame) -> DataFrame:
    """A result of a few rows, which a limit has bounded, computed once and held by the plan."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
