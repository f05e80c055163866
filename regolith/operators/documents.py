"""Objects found at any depth of JSON documents, as a table function for lateral joins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class ObjectsWith:
    """eval(text, keys): a row for each object that has all of the comma-separated keys, outer ones before inner ones.

    path leads to the object from the root ($, .name, [index]), body is its JSON. A text that is not JSON gives one
    row with the error and neither path nor body; an empty or null text gives none. Objects are met by a stack, so
    depth is bounded by the parser alone.
    """

    def eval(self, text: str, keys: str):
        if not text or not text.strip():
            return
        try:
            whole = json.loads(text)
        except (ValueError, RecursionError) as e:
            yield None, None, f"{type(e).__name__}: {e}"
            return
        wanted, waiting = set(keys.split(",")), [("$", whole)] if isinstance(whole, dict | list) else []
        while waiting:
            path, here = waiting.pop()
            is_object = isinstance(here, dict)
            if is_object and wanted <= here.keys():
                yield path, json.dumps(here, ensure_ascii=False), None
            inner = [(f"{path}.{k}", x) for k, x in here.items()] if is_object else [(f"{path}[{k}]", x) for k, x in enumerate(here)]
            waiting.extend((p, x) for p, x in reversed(inner) if isinstance(x, dict | list))


def pattern_counts(texts: DataFrame, text: str, **patterns: str) -> DataFrame:
    """texts with the number of matches of each pattern in its text column; (?m) makes ^ and $ those of lines. None in a null text."""
    return texts.withColumns({name: F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)) for name, p in patterns.items()})


objects_with = udtf(ObjectsWith, returnType="path string, body string, error string")


def json_objects(documents: DataFrame, text: str, *keys: str) -> DataFrame:
    """documents with path, body and error of each object of their JSON column that has the keys; documents without one have no row."""
    return documents.lateralJoin(objects_with(F.col(text).outer(), F.lit(",".join(keys))))
