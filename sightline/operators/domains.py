"""Registrable domains by a table of public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast at most; the public list has about ten thousand.
MAX_RULES = 200_000


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host", rule: str = "rule", domain: str = "domain") -> DataFrame:
    """Add the registrable domain of every host: its public suffix and one label more; null if it has none.

    Rules are suffixes (``co.uk``), ``*.`` and a suffix (any label before it belongs to the public suffix) or ``!`` and a
    name (an exception: its own suffix is one label shorter). Exceptions win, then the longest rule; where none
    fits, the last label is the suffix. Hosts are compared in lower case, without a dot at the end; null and
    empty ones, and those that are a public suffix themselves, have no domain.

    Every distinct host is resolved once: its suffixes are looked up in the rules as in a trie of labels.
    """
    name = F.lower(F.regexp_replace(F.col(host), r"\.$", ""))
    labels = F.split("__name", r"\.")
    distinct = hosts.select(name.alias("__name")).where("__name <> ''").distinct()
    suffixes = distinct.select("__name", F.size(labels).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("suffix")))).alias("s"))
    text = F.lower(F.trim(F.col(rule)))
    listed = rules.select(F.when(text.startswith("!"), "exception").when(text.startswith("*."), "wildcard").otherwise("plain").alias("kind"), F.regexp_replace(text, r"^(!|\*\.)", "").alias("suffix")).where("suffix IS NOT NULL").distinct()
    listed = F.broadcast(listed) if listed.count() <= MAX_RULES else listed
    fit = suffixes.select("__name", "n", "s.k", "s.suffix").join(listed, "suffix")
    size = F.when(F.col("kind") == "wildcard", F.col("k") + 1).when(F.col("kind") == "exception", F.col("k") - 1).otherwise(F.col("k"))
    fit = fit.withColumn("size", size).where("size <= n").groupBy("__name").agg(F.max(F.struct((F.col("kind") == "exception").alias("first"), "size")).alias("best"))
    resolved = distinct.join(fit, "__name", "left").withColumn("size", F.coalesce("best.size", F.lit(1)))
    found = resolved.select("__name", F.when(F.size(labels) > F.col("size"), F.array_join(F.slice(labels, F.size(labels) - F.col("size"), F.col("size") + 1), ".")).alias("__domain"))
    columns = [c for c in hosts.columns if c != domain]
    return hosts.withColumn("__name", name).join(found, "__name", "left").select(*(F.col(f"`{c}`") for c in columns), F.col("__domain").alias(domain))
