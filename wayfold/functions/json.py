"""JSON text: canonical form, equality, summaries, hidden keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters and items that a summary keeps, and a hidden key in canonical JSON.
TEXT_LIMIT, LIST_LIMIT = 400, 5
HIDDEN_KEY = r'[{,]"_(?:[^"\\]|\\.)*":'
#: What may be one in a text that has no canonical form.
MAY_HIDE = r'[{,]\s*"(?:_|\\u005[fF])(?:[^"\\]|\\.)*"\s*:'


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold one value; two nulls are equal. ``1`` and ``1.0`` are, ``1`` and ``true`` are not.

    Null where a text that is not null has no canonical form: what it holds is not known."""
    one = F.when(canonical(F.coalesce(a, b)).isNotNull(), False)
    return F.when(a.isNotNull() & b.isNotNull(), canonical(a) == canonical(b)).when(a.isNull() & b.isNull(), True).otherwise(one)


def summary_text(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """A long string cut to its first ``limit`` characters with a note of its length."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("...["), F.length(text).cast("string"), F.lit(" chars]"))).otherwise(text)


def summary_list(items: Column, limit: int = LIST_LIMIT) -> Column:
    """The first ``limit`` strings of a list with a note of how many more there are."""
    return F.when(F.size(items) > limit, F.concat(F.slice(items, 1, limit), F.array(F.concat(F.lit("..."), (F.size(items) - limit).cast("string"), F.lit(" more"))))).otherwise(items)


def has_hidden_key(text: Column) -> Column:
    """Whether some key, at any depth, begins with an underscore. Of a text without a canonical form (nested deeper than Spark's
    parser takes, repeated keys, no JSON) whether it may: what cannot be told is not let pass."""
    return F.coalesce(canonical(text).rlike(HIDDEN_KEY), text.rlike(MAY_HIDE))


def _hidden_in(text: str | None) -> str | None:
    try:
        return None if text is None else hidden_path(json.loads(text))
    except ValueError:
        return None
    except RecursionError:
        # Deeper than Python's parser takes: where the key is cannot be told, that there may be one can.
        return "observation" if re.search(MAY_HIDE, text) else None


def hidden_path(value: object) -> str | None:
    """The first path, in order of the text, to a key with an underscore; a stack in place of recursion, since depth is unbounded."""
    todo: list[tuple[object, str, bool]] = [(value, "observation", False)]
    while todo:
        at, path, hidden = todo.pop()
        if hidden:
            return path
        if isinstance(at, dict):
            todo.extend((v, f"{path}.{k}", k.startswith("_")) for k, v in reversed(at.items()))
        elif isinstance(at, list):
            todo.extend((at[i], f"{path}[{i}]", False) for i in range(len(at) - 1, -1, -1))
    return None


@F.pandas_udf(T.StringType())
def hidden_key_path(texts: pd.Series) -> pd.Series:
    """The path of the first hidden key, as ``observation.a[2]._k``; null if there is none, or no JSON. Of JSON nested deeper than
    Python's parser takes ``observation`` alone, if it may hold one. Depth is unbounded, so no built-in fits."""
    return texts.map(_hidden_in)


def _shortened(value: object) -> object:
    if isinstance(value, dict):
        return {k: _shortened(v) for k, v in value.items()}
    if isinstance(value, list):
        more = [f"...{len(value) - LIST_LIMIT} more"] if len(value) > LIST_LIMIT else []
        return [_shortened(v) for v in value[:LIST_LIMIT]] + more
    return value if not isinstance(value, str) or len(value) <= TEXT_LIMIT else f"{value[:TEXT_LIMIT]}...[{len(value)} chars]"


def _summary(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(_shortened(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def summary_json(texts: pd.Series) -> pd.Series:
    """The summary of a whole JSON value, at any depth that Python's parser takes; null for what is no JSON."""
    return texts.map(_summary)
