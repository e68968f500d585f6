"""Action codes and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP, FORWARD, LEFT, RIGHT = 0, 1, 2, 3

# Action codes and their phrases.
ACTION_NAMES = {0: "stop", 1: "move forward", 2: "turn left", 3: "turn right"}


def action_phrase(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = F.lit(None).cast("string")
    for k, v in ACTION_NAMES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def action_code(phrase: Column | str) -> Column:
    phrase = F.col(phrase) if isinstance(phrase, str) else phrase
    out = F.lit(None).cast("int")
    for k, v in ACTION_NAMES.items():
        out = F.when(phrase == v, k).otherwise(out)
    return out


def training_class(code: Column | str) -> Column:
    """Move codes 1..3 to classes 0..2; a stop label is an error."""
    code = F.col(code) if isinstance(code, str) else code
    checked = F.when(code >= 1, code).otherwise(F.raise_error(F.lit("stop is not a training label")).cast("int"))
    return checked - 1


def action_from_class(cls: Column | str) -> Column:
    return (F.col(cls) if isinstance(cls, str) else cls) + 1
