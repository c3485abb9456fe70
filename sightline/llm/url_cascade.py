"""Operator 3: URL filter by Bloom filter cascades.

A url's candidate keys are its host's suffixes joined to prefixes of its path, of the shapes that
the rules have. The keys of all urls form the complete universe. A cascade's first filter encodes
the listed keys; each further filter encodes the keys that the one before wrongly lets pass, taken
in turns from the universe and from the list, until none is left over. Membership is then exact for
every key of the universe, and urls are judged in one narrow pass, without a join.

The first filter's false-positive rate is set to listed / universe, so that the false positives
that reach the driver number about as many as the listed keys, whatever the corpus holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, ALLOW = "block", "allow"
#: Listed keys a cascade may hold; its filters are broadcast and take a few bytes a key.
MAX_LISTED = 20_000_000


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path up to ``?``, ``#`` or end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(_LOWER), path[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class BloomFilter:
    """Bits with ``hashes`` probes by double hashing; ``level`` seeds them."""

    level: int
    size: int
    hashes: int
    bits: bytearray = field(repr=False)

    @staticmethod
    def of(keys, rate: float, level: int) -> BloomFilter:
        keys = list(keys)
        rate = min(max(rate, 1e-12), 0.5)
        size = max(64, math.ceil(-max(len(keys), 1) * math.log(rate) / math.log(2) ** 2))
        out = BloomFilter(level, size, max(1, round(-math.log2(rate))), bytearray(-(-size // 8)))
        for key in keys:
            for i in out._probes(key):
                out.bits[i >> 3] |= 1 << (i & 7)
        return out

    def _probes(self, key: str):
        h = xxhash.xxh3_128_intdigest(key, self.level)
        a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
        return ((a + i * b) % (1 << 64) % self.size for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        bits = self.bits
        return all(bits[i >> 3] >> (i & 7) & 1 for i in self._probes(key))


@dataclass
class Cascade:
    """Filters in turn: even levels hold listed keys, odd ones keys of the universe that are not listed."""

    filters: list[BloomFilter] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        """Whether a key of the universe is listed."""
        for i, f in enumerate(self.filters):
            if key not in f:
                return i % 2 == 1
        return len(self.filters) % 2 == 1

    @staticmethod
    def build(listed: set[str], universe: int, passing) -> Cascade:
        """``passing(filter)`` returns the universe's unlisted keys that pass a filter; ``universe`` is about its size."""
        if len(listed) > MAX_LISTED:
            raise ValueError(f"{len(listed)} listed keys; one cascade holds {MAX_LISTED} (deal the rules into several)")
        out = Cascade()
        if not listed:
            return out
        out.filters.append(BloomFilter.of(listed, len(listed) / max(universe, 2 * len(listed)), 0))
        inside, outside = set(listed), set(passing(out.filters[0]))
        while outside:
            level = len(out.filters)
            out.filters.append(BloomFilter.of(outside, 0.5, level))
            # What the new filter wrongly lets pass on the other side goes into the next one.
            inside, outside = outside, {k for k in inside if k in out.filters[level]}
        return out


@dataclass(frozen=True)
class RuleShapes:
    """Which keys a url can have: host suffixes of so many labels with path prefixes of so many characters."""

    shapes: tuple[tuple[int, int], ...]

    @staticmethod
    def of(rules) -> RuleShapes:
        return RuleShapes(tuple(sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})))

    def keys(self, host: str, path: str) -> list[str]:
        """Candidate rules of a url, as host + path, longest first, then by text."""
        labels = host.split(".")
        out = {".".join(labels[-n:]) + path[:size] for n, size in self.shapes if host and len(labels) >= n and len(path) >= size}
        return sorted(out, key=lambda k: (-len(k), k))


def _rules(rules) -> list[tuple[str, str, str]]:
    """(verdict, host, path) of rules like ``("block", "com/en/")``."""
    out = []
    for verdict, rule in rules:
        if verdict not in (BLOCK, ALLOW):
            raise ValueError(f"verdict: block or allow, not {verdict!r}")
        host, slash, path = rule.partition("/")
        out.append((verdict, host.translate(_LOWER), slash + path))
    return out


def _candidates(df: DataFrame, url: str, shapes: RuleShapes) -> DataFrame:
    def expand(batches):
        for batch in batches:
            seen = {k for x in set(batch.column("url").to_pylist()) for k in shapes.keys(*split_url(x))}
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(seen), pa.string())})

    return df.select(F.col(url).cast("string").alias("url")).mapInArrow(expand, "key string")


def build_cascades(df: DataFrame, rules, url: str = "url") -> dict[str, Cascade]:
    """A cascade of the keys that block and one of those that allow, exact for all keys of the urls of ``df``."""
    parsed = _rules(rules)
    shapes = RuleShapes.of(parsed)
    keys = _candidates(df, url, shapes)
    universe = keys.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    out = {}
    for verdict in (BLOCK, ALLOW):
        listed = {h + p for v, h, p in parsed if v == verdict}

        def passing(first: BloomFilter, listed=listed):
            shared = df.sparkSession.sparkContext.broadcast((first, listed))

            def probe(batches):
                f, own = shared.value
                for batch in batches:
                    found = [k for k in batch.column("key").to_pylist() if k in f and k not in own]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.string())})

            return [r["key"] for r in keys.mapInArrow(probe, "key string").distinct().collect()]

        out[verdict] = Cascade.build(listed, universe, passing)
    return out


def judge_urls(df: DataFrame, rules, url: str = "url", default: str = ALLOW, host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the
    longest fitting rule (characters of host and path; equal ones are the same text, and block
    outweighs allow) gives the verdict. A url that no rule fits is not listed and gets ``default``
    with a null rule; so do null urls and those without ``://``, whose host and path are empty.
    Rows are kept as they are; columns of ``df`` named like the new ones are replaced.
    """
    rules = list(rules)
    shapes = RuleShapes.of(_rules(rules))
    shared = df.sparkSession.sparkContext.broadcast(build_cascades(df, rules, url))
    added = (host, path, rule, verdict)
    df = df.drop(*added)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in added)])

    def judge(batches):
        cascades = shared.value
        memo: dict[str, str | None] = {}

        def listed(key: str) -> str | None:
            if key not in memo:
                if len(memo) > 500_000:
                    memo.clear()
                memo[key] = next((v for v in (BLOCK, ALLOW) if cascades[v].filters and key in cascades[v]), None)
            return memo[key]

        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for x in batch.column(url).cast(pa.string()).to_pylist():
                h, p = split_url(x)
                found = next(((k, v) for k in shapes.keys(h, p) if (v := listed(k))), (None, default))
                for c, value in zip(columns, (h, p, *found), strict=True):
                    c.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=[*batch.schema.names, *added])

    return df.mapInArrow(judge, schema)


def oracle_sql(rules, default: str = ALLOW) -> str:
    """DuckDB SQL for the rows of the registered query."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in _rules(rules))
    lower = f"translate(regexp_extract(rest, '^[^/?#]*'), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    return f"""
WITH rules(v, h, p) AS (VALUES {listed}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (SELECT page_id, host, path, h || p AS rule, v FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, v DESC) AS k FROM fits)
SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM best WHERE k = 1"""
