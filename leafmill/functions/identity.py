"""Content-addressed identities: digests of fields, cut to the lengths at which they are stored, and stable JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Column = F.Column
#: hex digits kept of each kind of identity; fixed values
LENGTHS = {"content": 31, "script": 31, "rev": 31, "endpoint": 16, "text": 12}


def identity(kind: str, *parts: Column) -> Column:
    """The digest of the parts as a JSON array, nulls as null, cut to the kind's length. Engine-local: JSON is Spark's own."""
    packed = F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(packed, 256), 1, LENGTHS[kind])


def script_id(content_revision: Column, version: int, target: int, most: int) -> Column:
    return identity("script", content_revision, F.lit(version), F.lit(target), F.lit(most))


def narration_rev(script: Column, voice: Column, config: Column) -> Column:
    return identity("rev", script, voice, config)


def legacy_hash(title: Column, byline: Column, html: Column) -> Column:
    return F.sha1(F.concat_ws(" ", F.lit("2"), *[F.coalesce(c, F.lit("")) for c in (title, byline, html)]))


@F.pandas_udf(T.StringType())
def stable_json(text: pd.Series) -> pd.Series:
    """JSON with the keys of every object in order; null for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)
