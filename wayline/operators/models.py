"""Where models plug in: batch functions registered by kind and name.

A function takes one list per input column and returns one list. It is shipped to the
workers, called once per Arrow batch, and a factory (`load=True`) is run once per
Python worker and registration.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MODELS: dict[tuple[str, str], tuple[Callable[..., Any], bool]] = {}
_VERSIONS: dict[tuple[str, str], int] = {}
# in a worker: what the factories made, by (kind, name, version)
_LOADED: dict[tuple[str, str, int], Callable[..., Any]] = {}


def register(kind: str, name: str, fn: Callable[..., Any], load: bool = False) -> None:
    """Register `fn`; with `load`, `fn()` returns the batch function."""
    _MODELS[(kind, name)] = (fn, load)
    _VERSIONS[(kind, name)] = _VERSIONS.get((kind, name), 0) + 1


def _loaded(key: tuple[str, str, int], factory: Callable[..., Any]) -> Callable[..., Any]:
    """The worker's model. Found by import, so that all tasks of a worker share the module's table."""
    if key not in _LOADED:
        for old in [k for k in _LOADED if k[:2] == key[:2]]:
            del _LOADED[old]
        _LOADED[key] = factory()
    return _LOADED[key]


def registered(kind: str | None = None) -> list[tuple[str, str]]:
    return sorted(k for k in _MODELS if kind is None or k[0] == kind)


def _find(kind: str, name: str, default: str) -> tuple[Callable[..., Any], bool] | None:
    if (kind, name) not in _MODELS:
        warnings.warn(f"{name} is not a registered {kind} function; using {default}", stacklevel=3)
        return None
    return _MODELS[(kind, name)]


def _batches(kind: str, name: str, fn: Callable[..., Any], load: bool, inputs: Sequence[str], out: str, batch: int):
    key = (kind, name, _VERSIONS[(kind, name)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _loaded(key, fn) if load else fn
        for pdf in parts:
            values: list[Any] = []
            for at in range(0, len(pdf), batch):
                piece = pdf.iloc[at:at + batch]
                got = list(call(*[piece[c].tolist() for c in inputs]))
                if len(got) != len(piece):
                    raise ValueError(f"{len(got)} results for {len(piece)} rows")
                values.extend(got)
            yield pdf.assign(**{out: pd.Series(values, index=pdf.index, dtype=object)})

    return run


def annotate(df: DataFrame, kind: str, name: str, inputs: Sequence[str], out: str | None = None, batch: int = 500,
             dtype: str = "string") -> DataFrame:
    """Add the function's result per row; an unknown name gives a null column and a warning."""
    out = out or kind
    found = _find(kind, name, "null")
    if found is None:
        return df.withColumn(out, F.lit(None).cast(dtype))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(out).schema.fields) + f", `{out}` {dtype}"
    return df.drop(out).mapInPandas(_batches(kind, name, *found, inputs, out, batch), schema)


def identity_summary(text: Column | str) -> Column:
    return F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\n"), F.lit(" "))


def summarise(df: DataFrame, name: str = "", text: str = "summary", out: str = "instruction", reasoning: str | None = None,
              batch: int = 500) -> DataFrame:
    """Text to instruction. Without a registered summariser, newlines become blanks and no Python runs.

    A summariser may return (instruction, reasoning) pairs; name the second column with `reasoning`.
    """
    found = _find("summary", name, "the text on one line") if name else None
    if found is None:
        done = df.withColumn(out, identity_summary(text))
        return done.withColumn(reasoning, F.lit("")) if reasoning else done
    fn, load = found
    pair = "struct<answer:string,reasoning:string>"
    _pairs = lambda f: (lambda texts: [{"answer": r[0], "reasoning": r[1]} if isinstance(r, tuple) else
                                       {"answer": r, "reasoning": ""} for r in f(texts)])
    wrapped = (lambda: _pairs(fn())) if load else _pairs(fn)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = df.mapInPandas(_batches("summary", name, wrapped, load, [text], "_s", batch), f"{fields}, `_s` {pair}")
    rows = rows.withColumn(out, F.col("_s.answer"))
    return (rows.withColumn(reasoning, F.col("_s.reasoning")) if reasoning else rows).drop("_s")


def embed(df: DataFrame, name: str, text: str = "text", out: str = "vec", batch: int = 500) -> DataFrame:
    """Add a vector per row with a registered `embed` function."""
    return annotate(df, "embed", name, [text], out, batch, "array<float>")
