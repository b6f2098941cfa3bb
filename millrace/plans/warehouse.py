"""The dimension snapshot flow: stage, dimension, fact, snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from millrace.operators.schema import normalize_column_names
from millrace.sources.tables import Warehouse


def dimension_snapshot(
    warehouse: Warehouse,
    rows: DataFrame,
    *,
    natural: Sequence[str],
    key_column: str,
    stage: str = "stage.rows",
    dimension: str = "mart.dimension",
    fact: str = "mart.fact",
) -> DataFrame:
    """Stage the distinct rows, extend the dimension, key the fact table and read it back.

    The stage table is the materialised input of the later steps, so the sources are read
    and de-duplicated once.
    """
    cleaned = normalize_column_names(rows).distinct()
    warehouse.replace_table(stage, cleaned)
    staged = warehouse.frame(stage)
    keys = staged.select(*natural)
    warehouse.build_dimension(dimension, keys, key_column=key_column)
    keyed = warehouse.attach_dimension(dimension, staged, on=list(natural), key_column=key_column)
    warehouse.replace_table(fact, keyed)
    return warehouse.read_table(fact)
