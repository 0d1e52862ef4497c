"""Whether a suggested patch parses: Python by its own parser, other languages by balanced brackets outside strings."""

from __future__ import annotations

import ast
import functools
import re
import textwrap
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


@functools.lru_cache(20_000)
def parses(language: str | None, text: str | None) -> bool | None:
    """Null for a language that is not known; blank text does not parse; fragments may be indented or end at a colon."""
    if language not in ("python", "typescript"):
        return None
    if not text or not text.strip():
        return False
    if language == "python":
        body = textwrap.dedent(text.replace("\r\n", "\n"))
        for form in (body, f"{body.rstrip()}\n    pass\n", "def _():\n" + textwrap.indent(body, "    ")):
            try:
                ast.parse(form)
                return True
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
        return False
    stack = []
    for c in _SKIP.sub(" ", text):
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[c]):
            return False
    return not stack


@F.pandas_udf(BooleanType())
def _run(language: pd.Series, text: pd.Series) -> pd.Series:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pd.Series([parses(a, b) for a, b in zip(language, text)], dtype=object)


def patch_parses(language, text):
    return _run(F.col(language) if isinstance(language, str) else language, F.col(text) if isinstance(text, str) else text)
