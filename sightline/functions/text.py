"""Text normal forms and similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal_text(c: Column, compatible: bool = True) -> Column:
    """Compatibility form, lower case, without urls, letters and digits only, single spaces.

    Only the compatibility form needs Python; texts known to be ASCII can do without.
    """
    text = F.lower(_compatible(c) if compatible else c)
    text = F.regexp_replace(text, r"https?://\S+", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_tokens(normal: Column) -> Column:
    """Distinct tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def fnv1a(normal: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-16 units, in hex."""
    points = F.transform(F.filter(F.split(normal, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    above = lambda x: x - F.lit(0x10000)
    pair = lambda x: F.array(F.lit(0xD800) + F.floor(above(x) / 1024), F.lit(0xDC00) + above(x) % 1024)
    codes = F.flatten(F.transform(points, lambda x: F.when(x > 0xFFFF, pair(x)).otherwise(F.array(x))))
    mixed = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(0x01000193), F.lit(1 << 32)))
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")
