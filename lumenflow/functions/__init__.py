"""The operators as plain functions: `apply(type_id, *inputs, **params)`."""

from __future__ import annotations

from pyspark.sql import DataFrame


def apply(type_id: str, *inputs: DataFrame, **params) -> DataFrame:
    from ..spec import FlowError, find

    op = find(type_id)
    if op.inputs and len(inputs) != len(op.inputs):
        raise FlowError(f"{type_id} reads {', '.join(op.inputs)}")
    return op.plan(*inputs, **op.bind(params))
