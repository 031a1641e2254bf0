"""User functions over batches of rows, and plug-in scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(
    df: DataFrame,
    fn: Callable[..., pd.DataFrame],
    schema: str | T.StructType,
    fn_kwargs: dict | None = None,
    remove_columns: Sequence[str] = (),
) -> DataFrame:
    """Run ``fn(batch, **fn_kwargs)`` on Arrow batches; its columns are added to the
    row, or replace it, and ``remove_columns`` are dropped. ``fn`` must keep the rows."""
    kwargs = dict(fn_kwargs or {})
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    new = set(added.names)
    kept = [f for f in df.schema if f.name not in remove_columns and f.name not in new]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = fn(batch, **kwargs)
            yield pd.concat(
                [batch[[f.name for f in kept]], made[added.names].set_index(batch.index)], axis=1
            )

    return df.mapInPandas(run, T.StructType(kept + added.fields))


def map_row_batches(
    df: DataFrame,
    fn: Callable[..., pa.Table],
    schema: str | T.StructType,
    keys: Sequence[str],
    order: Sequence[str],
    fn_kwargs: dict | None = None,
) -> DataFrame:
    """Run ``fn(batch, **fn_kwargs)`` on batches with fixed borders: the rows of equal ``keys``, in
    ``order``, as one Arrow table. ``fn`` returns a table of any number of rows; the keys are put
    before its columns. The result does not depend on partitions or workers. A batch is held in
    memory, so keys should number rows in bounded batches (``packing.batch_ids``)."""
    kwargs = dict(fn_kwargs or {})
    made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in df.schema if f.name in keys]
    typed = to_arrow_schema(made)
    by = [(c, "ascending") for c in order]

    def run(batch: pa.Table) -> pa.Table:
        out = fn(batch.sort_by(by), **kwargs).select(typed.names).cast(typed)
        heads = [pa.chunked_array([pa.repeat(batch.column(f.name)[0], out.num_rows)]) for f in kept]
        return pa.Table.from_arrays([*heads, *out.columns], names=[f.name for f in kept] + typed.names)

    return df.groupBy(*[f.name for f in kept]).applyInArrow(run, T.StructType(kept + made.fields))


def scorer(
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch_size: int = 1024
) -> Callable[[Column], Column]:
    """A black-box model as a column function. ``make_predict`` loads the model once per
    worker and returns a function from (rows, width) to (rows, answers)."""
    return predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
