"""Unified line diffs of text pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StructType


@pandas_udf(ArrayType(StructType().add("tag", "string").add("line", "string")))
def diff_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines of a unified diff with their tag: removed (-), added (+) or context (space)."""

    def one(a: str | None, b: str | None) -> list[dict]:
        lines = list(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="", n=3))[2:]
        return [{"tag": x[:1], "line": x[1:]} for x in lines if not x.startswith("@@")]

    return pd.Series([one(a, b) for a, b in zip(old, new)])
