"""Functions over code texts that need Python, in Arrow batches."""

from __future__ import annotations

import ast
import difflib
import re
import warnings

import pandas as pd
from figmill.functions.udfs import vectorized


def _bare(code: str) -> str:
    """Code without comments and with white space runs as one space."""
    return re.sub(r"\s+", " ", re.sub(r"#.*", "", code)).strip()


@vectorized("double")
def code_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching share of two codes of 100; null where either is null or empty."""
    return pd.Series([100.0 * difflib.SequenceMatcher(None, _bare(x), _bare(y)).ratio() if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")


@vectorized("error string, line int")
def syntax_error(code: pd.Series) -> pd.DataFrame:
    """What keeps a text from being Python, and where; nulls for code that parses. Nothing is run."""

    def check(text: str | None):
        if not text or not text.strip():
            return "empty", None
        try:
            ast.parse(text)
        except SyntaxError as e:
            return e.msg, e.lineno
        except (ValueError, RecursionError, MemoryError) as e:
            return type(e).__name__, None
        return None, None

    with warnings.catch_warnings():  # prose that is no Python warns as well
        warnings.simplefilter("ignore")
        return pd.DataFrame([check(t) for t in code], columns=["error", "line"])
