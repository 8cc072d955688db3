"""Batch inference with models that are loaded once in each worker; tensors are flat data with a shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Column type of a tensor, and element types of models with their columns'.
TENSOR = "struct<data:array<double>,shape:array<bigint>>"
ELEMENT_TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(),
}


def element_type(name: str) -> T.DataType:
    """The column type of a model's element type."""
    if name not in ELEMENT_TYPES:
        raise TypeError(f"no such element type: {name}")
    return ELEMENT_TYPES[name]


@lru_cache(4)
def load_graph(model: str | bytes) -> Callable[..., Sequence[np.ndarray]]:
    """A model, by its path or as bytes, as a function of arrays: ONNX by onnxruntime, in each worker once."""
    import onnxruntime

    session = onnxruntime.InferenceSession(model)
    names = [x.name for x in session.get_inputs()]
    return lambda *arrays: session.run(None, dict(zip(names, arrays, strict=True)))


def run_graph(model: Callable[..., Any], data: Sequence[Sequence[float]], shapes: Sequence[Sequence[int]], dtype: str = "float64") -> tuple[list[list], list[list[int]]]:
    """Flat inputs with shapes to flat outputs with shapes, on the host."""
    if len(data) != len(shapes):
        raise ValueError("each input needs a shape")
    out = model(*(np.asarray(d, dtype).reshape(s) for d, s in zip(data, shapes, strict=True)))
    out = [np.asarray(x) for x in (out if isinstance(out, (list, tuple)) else [out])]
    return [x.reshape(-1).tolist() for x in out], [list(x.shape) for x in out]


def infer(df: DataFrame, model: Callable[[], Callable[..., Any]], inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Adds tensors ``outputs``, which the model makes of the tensor columns ``inputs`` row by row; ``model`` is called once in each task and gives the function."""
    columns = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, T._parse_datatype_string(TENSOR)) for o in outputs)])

    def run(frames: Iterator) -> Iterator:
        f = model()
        for pdf in frames:
            rows = []
            for values in zip(*(pdf[c] for c in inputs), strict=True):
                data, shapes = run_graph(f, [v["data"] for v in values], [v["shape"] for v in values])
                rows.append([{"data": d, "shape": s} for d, s in zip(data, shapes, strict=True)])
            for k, o in enumerate(outputs):
                pdf[o] = [r[k] for r in rows]
            yield pdf[[*columns, *outputs]]

    return df.mapInPandas(run, schema)


def infer_batches(df: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str, output: str) -> DataFrame:
    """Adds a double for each row: the model gets the arrays of many rows (all of one size) as a matrix at once."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])

    def run(frames: Iterator) -> Iterator:
        f = model()
        for pdf in frames:
            pdf[output] = np.asarray(f(np.stack(pdf[features].to_list())), np.float64) if len(pdf) else np.zeros(0)
            yield pdf

    return df.mapInPandas(run, schema)
