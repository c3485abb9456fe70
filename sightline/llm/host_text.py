"""Operator 4: main text of web pages, by structure and a suffix array per host.

A page is read into blocks of text (``page_blocks``), leaving out what its markup declares to be no
article (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts). If the page
has article or main elements, only their blocks count. The token streams of a host's pages are then
concatenated and all their suffixes sorted whole, with the lengths of their common prefixes; stretches
of the suffix array whose prefixes agree on ``RUN`` tokens or more are the long substrings, and those
that recur on many distinct pages are boilerplate: they are cut, and the unique runs stay. Text inside a
declared article must recur on more than ``declared_share`` of the host's pages to be cut, so passages
and articles that some pages share are kept; text of a page without such declaration on more than
``share``. Pages of equal tokens count as one page, so copies don't make boilerplate of their own
article.

The distinct pages of a host are dealt by content into shards, so that no task holds an unbounded host.
A run on more than a share of the host's pages is on more than that share in one of its shards at least:
the runs found so are the candidates, whose distinct pages are then counted over the whole host, and
every page is cut by these counts. Hosts of every size go this way, and the number of shards and the
layout of the files change no result. Pages are read for the shards, which alone shuffle texts, for the
counts (hosts with candidates only) and for the cut: a table of texts in between would cost more disk
than reading again costs time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bound_batches, drop_stage, split_batch, stage_table
from sightline.llm.page_blocks import blocks_of

#: Pages, and characters of text, that a shard has at most on average.
SHARD, SHARD_CHARS = 128, 2_000_000
#: Hosts whose shard numbers may be broadcast.
MAX_HOSTS = 500_000
#: Runs in the lists of all hosts that may be broadcast, 16 bytes each.
MAX_RUNS = 2_000_000
#: Least length, in tokens, of a recurring run.
RUN = 8


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all suffixes in order, common prefix of each with the one before), by prefix doubling.

    Each round sorts only the suffixes that are not told apart yet, by what follows their known part.
    """
    n = len(stream)
    order = np.argsort(stream, kind="stable")
    ordered = stream[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, depth = [], 1
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        levels.append((depth, rank.astype(np.int32)))
        if not len(tied):
            break
        suffix = order[tied]
        after = np.where(suffix + depth < n, rank[np.minimum(suffix + depth, n - 1)], -1)
        sort = np.lexsort((after, rank[suffix]))
        suffix, after = suffix[sort], after[sort]
        first = rank[suffix]
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        order[tied], head[tied] = suffix, new
        rank[suffix] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        depth *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for depth, equal in reversed(levels):
        both = np.flatnonzero((a < n) & (b < n))
        same = both[equal[a[both]] == equal[b[both]]]
        common[1:][same] += depth
        a[same] += depth
        b[same] += depth
    return order, common


def run_holders(pages: list[list[int]], run: int = RUN) -> list[np.ndarray]:
    """For each token of each page, how many distinct pages have the run of ``run`` tokens that starts there."""
    sizes = np.array([len(p) for p in pages], np.int64)
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1]) if len(ends) else 0
    stream = np.empty(n, np.int64)
    owner = np.repeat(np.arange(len(pages)), sizes + 1)
    for i, (p, e) in enumerate(zip(pages, ends.tolist(), strict=True)):
        stream[e - 1 - len(p) : e - 1] = p
        stream[e - 1] = -1 - i  # a different end for each page: no substring crosses it
    holders = np.zeros(n, np.int64)
    if n:
        order, common = suffix_array(stream)
        group = np.cumsum(common < run) - 1  # stretches of suffixes that share a substring of that length
        shared = np.flatnonzero(np.bincount(group)[group] > 1)
        g, page = group[shared], owner[order[shared]]
        sort = np.lexsort((page, g))
        g, page, at = g[sort], page[sort], order[shared][sort]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (page[1:] != page[:-1])
        long = sizes[owner] - (np.arange(n) - (ends - 1 - sizes)[owner]) >= run
        holders[long] = 1
        holders[at] = np.bincount(g, new)[g] if len(g) else 0
    return [holders[e - 1 - s : e - 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def covered(hit: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens of a page lie in a run whose start is hit."""
    marks = np.zeros(len(hit) + run + 1, np.int64)
    starts = np.flatnonzero(hit)
    marks[starts] += 1
    np.add.at(marks, starts + run, -1)
    return np.cumsum(marks)[: len(hit)] > 0


def numbered(pages: list[str]) -> list[list[int]]:
    """Token streams of pages, words as numbers."""
    number: dict[str, int] = {}
    put = number.setdefault
    return [[put(w, len(number)) for w in page.split()] for page in pages]


def without(text: str, cut: np.ndarray) -> str:
    """A page's text without the tokens that are cut."""
    return " ".join(w for w, c in zip(text.split(), cut.tolist(), strict=True) if not c)


def word_codes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``memo`` is the caller's."""
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    return np.array([memo[w] for w in words], np.uint64)


def run_codes(codes: np.ndarray, host: str, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of host and run for each start of a run of words."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = np.full(n, xxhash.xxh64_intdigest(host), np.uint64)
    for k in range(run):
        x = (x ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def content_code(text: str) -> int:
    """A 64-bit hash of a page's tokens, wherever its blocks end."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def sliced(batches, column: str, memo_words: int = 200_000):
    """(slice of a batch, a memo of words) with bounded bytes of ``column``."""
    memo: dict[str, int] = {}
    for whole in batches:
        for batch in split_batch(whole, column):
            if len(memo) > memo_words:
                memo.clear()
            yield batch, memo


def lists_of(batch: pa.RecordBatch, name: str):
    """A column of lists of longs as arrays, nulls as empty ones."""
    return [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in batch.column(name)]


def host_counts(rows: DataFrame, share: float, declared_share: float, min_pages: int) -> DataFrame:
    """(__host, __total, __runs, __pages) of hosts with runs on enough distinct pages.

    ``rows`` have __host and __html. Runs are hashes in ascending order.
    """
    least = min(share, declared_share)
    shards = F.ceil(F.greatest(F.count(F.lit(1)) / SHARD, F.sum(F.coalesce(F.length("__html"), F.lit(0))) / SHARD_CHARS)).cast("long")
    # Hosts of fewer rows than the pages that a run must be on have no such run.
    hosts = stage_table(rows.groupBy("__host").agg(shards.alias("__shards"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_pages).drop("__n"), "host-shards")
    # A few bytes a host: broadcast up to a counted number, so that pages are not shuffled for it.
    dealt = rows.select("__host", "__html").join(F.broadcast(hosts) if hosts.count() <= MAX_HOSTS else hosts, "__host")

    def contents(batches):
        seen: set[tuple[str, int]] = set()  # copies leave a task once, while they fit
        for batch, _ in sliced(batches, "__html"):
            out = []
            for host, n, (blocks, _) in zip(batch.column("__host").to_pylist(), batch.column("__shards").to_pylist(), map(blocks_of, batch.column("__html").to_pylist()), strict=True):
                text = " ".join(blocks)
                code = content_code(text)
                if (host, code) not in seen:
                    if len(seen) < 200_000:
                        seen.add((host, code))
                    out.append((host, n, code % n, code, text))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else [()] * 5, arrow, strict=True)], schema=arrow)

    arrow = pa.schema([("__host", pa.string()), ("__shards", pa.int64()), ("__shard", pa.int64()), ("__code", pa.int64()), ("__text", pa.string())])

    def candidates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        host, n_shards, _ = (k.as_py() for k in key)
        texts = list(dict(zip(table.column("__code").to_pylist(), table.column("__text").to_pylist(), strict=True)).values())
        runs, memo = [np.zeros(0, np.int64)], {}
        enough = least * len(texts) if n_shards > 1 else max(least * len(texts), min_pages - 1)  # one shard is the whole host
        for text, n in zip(texts, run_holders(numbered(texts)), strict=True):
            starts = np.flatnonzero(n[: max(len(n) - RUN + 1, 0)] > enough)
            if len(starts):
                runs.append(run_codes(word_codes(text.split(), memo), host)[starts])
        found = np.unique(np.concatenate(runs))
        return pa.table({"__host": pa.array([host] * (len(found) + 1), pa.string()), "__run": pa.array([None, *found.tolist()], pa.int64()), "__n": pa.array([len(texts), *[0] * len(found)], pa.int64())})

    distinct = dealt.mapInArrow(contents, "__host string, __shards long, __shard long, __code long, __text string")
    noted = stage_table(distinct.groupBy("__host", "__shards", "__shard").applyInArrow(candidates, "__host string, __run long, __n long"), "host-runs")
    found, few = listed(noted.groupBy("__host").agg(F.sum("__n").alias("__total"), F.sort_array(F.collect_set("__run")).alias("__runs")).where(F.size("__runs") > 0))

    def holders(batches):
        for batch, memo in sliced(batches, "__html"):
            runs, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for host, html, known in zip(batch.column("__host").to_pylist(), batch.column("__html").to_pylist(), lists_of(batch, "__runs"), strict=True):
                text = " ".join(blocks_of(html)[0])
                own = np.unique(run_codes(word_codes(text.split(), memo), host))
                own = own[np.isin(own, known, assume_unique=True)]
                runs.append(own)
                codes.append(np.full(len(own), content_code(text), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs)), pa.array(np.concatenate(codes))], names=["__run", "__content"])

    held = rows.select("__host", "__html").join((F.broadcast(found) if few else found).select("__host", "__runs"), "__host").mapInArrow(holders, "__run long, __content long")
    counts = held.distinct().groupBy("__run").agg(F.count(F.lit(1)).alias("__pages"))
    runs = found.select("__host", "__total", F.explode("__runs").alias("__run")).join(counts, "__run")
    enough = (F.col("__pages") >= min_pages) & (F.col("__pages") > F.lit(least) * F.col("__total"))
    ordered = runs.where(enough).groupBy("__host").agg(F.first("__total").alias("__total"), F.sort_array(F.collect_list(F.struct("__run", "__pages"))).alias("__x"))
    out, few = listed(ordered.select("__host", "__total", F.col("__x.__run").alias("__runs"), F.col("__x.__pages").alias("__pages")))
    for done in (hosts, noted, found):
        drop_stage(done)
    return F.broadcast(out) if few else out


def listed(lists: DataFrame) -> tuple[DataFrame, bool]:
    """The hosts' lists of runs, written, and whether they are measured small enough for a broadcast."""
    lists = stage_table(lists, "host-lists")
    size = lists.agg(F.coalesce(F.sum(F.size("__runs") + 4), F.lit(0)).alias("n")).first()["n"]
    return lists, size <= MAX_RUNS


def extract_text(df: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), share: float = 0.1, declared_share: float = 0.5, min_pages: int = 5) -> DataFrame:
    """``keep`` columns and ``text`` (empty if there is none) of every row, repeated rows included.

    Null html is empty; null urls, and those without ``://``, form the host "". Runs on fewer than
    ``min_pages`` pages are never cut. Blocks are trimmed, their white space is one space, and they
    are joined by one space in page order. Other columns are not read, whatever their names; a kept
    column may have any name but ``text``. html of any length is parsed whole.
    """
    if "text" in keep:
        raise ValueError("a kept column can't be called text")
    bound_batches(df.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)), F.lit(""))
    kept = [f"__keep{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), host.alias("__host"), F.col(html).cast("string").alias("__html"))

    def cut(batches):
        for batch, memo in sliced(batches, "__html"):
            texts = []
            facts = zip(*(batch.column(c).to_pylist() for c in ("__host", "__total", "__html")), lists_of(batch, "__runs"), lists_of(batch, "__pages"), strict=True)
            for host, total, html, runs, pages in facts:
                blocks, declared = blocks_of(html)
                text = " ".join(blocks)
                own = run_codes(word_codes(text.split(), memo), host) if len(runs) else runs
                if len(own):
                    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
                    holders = np.where(runs[at] == own, pages[at], 0)
                    hit = np.zeros(len(own) + RUN - 1, bool)
                    hit[: len(own)] = holders > max(min_pages - 1, (declared_share if declared else share) * total)
                    text = without(text, covered(hit)) if hit.any() else text
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    counted = rows.join(host_counts(rows, share, declared_share, min_pages), "__host", "left")
    out = counted.mapInArrow(cut, T.StructType([*(rows.schema[k] for k in kept), T.StructField("text", T.StringType())]))
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "text")
