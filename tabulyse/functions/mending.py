"""Broken JSON text to JSON text, as an Arrow-batched function."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CLOSER = {"[": "]", "{": "}"}
# What matters between two tokens of interest: strings, comments, brackets, commas, white space.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\\?\Z|//[^\n]*|/\*.*?(?:\*/|\Z)|[\[\]{},]|\s+|[^"\[\]{},\s/]+|/', re.S)


def mend_json(raw: str | None) -> str | None:
    """Text that holds an array of records, with the usual damage undone.

    Cuts what comes before the first bracket and after the last closing one, drops comments and trailing
    commas, and closes what was cut off: with a closing bracket present the incomplete rest is dropped,
    without one an open string is closed too. A lone object, or several in a row, become an array.
    Strings are left alone throughout.
    """
    if raw is None:
        return None
    start = min((i for i in (raw.find("["), raw.find("{")) if i >= 0), default=-1)
    if start < 0:
        return raw.strip() or "[]"
    out: list[str] = []
    open_brackets: list[str] = []
    comma = False
    last_close: tuple[int, list[str]] | None = None
    between: list[str] = []
    for token in (t.group() for t in _TOKEN.finditer(raw, start)):
        if token.isspace() or token.startswith(("//", "/*")):
            if open_brackets:
                out.append(" ")
            continue
        if not open_brackets and last_close:
            if token not in _CLOSER:
                between.append(token)
                continue
            out.extend([","] if between in ([], [","]) else between)
            between, comma = [], False
        if token == ",":
            comma = True
            continue
        if token in ("]", "}"):
            if open_brackets:
                open_brackets.pop()
            out.append(token)
            last_close = (len(out), list(open_brackets))
            comma = False
            continue
        if comma:
            out.append(",")
            comma = False
        if token in _CLOSER:
            open_brackets.append(token)
        elif token[0] == '"' and (len(token) == 1 or not _closed(token)):
            token = re.sub(r'(?<!\\)((?:\\\\)*)\\\Z', r"\1", token) + '"'
        out.append(token)
    if open_brackets and last_close:
        size, open_brackets = last_close
        out = out[:size]
    out.extend(_CLOSER[b] for b in reversed(open_brackets))
    text = "".join(out)
    return f"[{text}]" if text.startswith("{") else text


def _closed(token: str) -> bool:
    return re.fullmatch(r'"(?:[^"\\]|\\.)*"', token, re.S) is not None


@F.pandas_udf(T.StringType())
def mended(raw: pd.Series) -> pd.Series:
    return raw.map(mend_json, na_action="ignore")
