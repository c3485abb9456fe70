"""Operator 8: benchmark decontamination by a broadcast hash set of n-gram windows.

Words are 64-bit hashes. Every window of ``n`` consecutive item words (an item of fewer words is one
window) goes into a sorted set of window hashes that is broadcast, together with the items' words. A
document is scanned as an array of word hashes: windows without foreign words are hashed, looked up,
and every hit is verified word by word. One narrow pass, no shuffle.

The broadcast is bounded: numpy arrays of about 30 bytes a benchmark word. A benchmark of more than
``max_words`` words is dealt into parts of about that size, and the documents are scanned part by part,
in passes of their own whose results are written in between, so that driver and workers hold one part
at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import ALNUM_TABLE, bound_batches, byte_values, drop_stage, give_back, split_batch, stage_table

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normalised_words(data: bytes) -> list[bytes]:
    """Lower-case words: runs of digits, letters and bytes above ASCII."""
    return data.translate(ALNUM_TABLE).split()


def word_hashes(words) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


class Windows:
    """Windows of one length: their sorted distinct hashes, a place of each in the items' words, their items."""

    def __init__(self, stream: np.ndarray, starts: np.ndarray, owners: np.ndarray, size: int):
        for salt in range(1, 100):
            found = window_hashes(stream, starts, size, salt)
            order = np.lexsort((owners, found))
            ordered = found[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = ordered[1:] != ordered[:-1]
            group, first = np.cumsum(fresh) - 1, starts[order][fresh]
            # One hash, one window: another salt if two windows meet.
            if all((stream[starts[order] + k] == stream[first[group] + k]).all() for k in range(size)):
                break
        else:
            raise RuntimeError("windows of one hash under every salt")
        self.size, self.salt, self.hashes, self.first = size, salt, ordered[fresh], first.astype(np.int32)
        distinct = fresh.copy()
        distinct[1:] |= owners[order][1:] != owners[order][:-1]
        self.items = owners[order][distinct].astype(np.int32)
        self.ends = np.searchsorted(group[distinct], np.arange(len(first)), "right").astype(np.int32)

    def at(self, stream: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the window) of the starts in a document at which a window begins."""
        found = window_hashes(codes, starts, self.size, self.salt)
        number = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[number] == found)
        starts, number = starts[hit], number[hit]
        same = np.ones(len(hit), bool)
        for k in range(self.size):
            same &= codes[starts + k] == stream[self.first[number] + k]
        return starts[same], number[same]


class WindowSet:
    """The windows of benchmark items by length, the items' words one after the other, and their ids."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.names = [item for item, _ in items]
        index: dict[bytes, int] = {}
        texts = [[index.setdefault(w, len(index)) for w in normalised_words(text)] for _, text in items]
        hashes = word_hashes(index)
        self.vocabulary = np.unique(hashes)
        sizes = np.array([len(x) for x in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.stream = hashes[np.fromiter((w for x in texts for w in x), np.int64, int(sizes.sum()))]
        self.windows = []
        for size in sorted({min(n, x) for x in sizes.tolist() if x}):
            own = np.flatnonzero(sizes >= n) if size == n else np.flatnonzero(sizes == size)
            counts = sizes[own] - size + 1
            owners = np.repeat(own, counts)
            starts = begins[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
            self.windows.append(Windows(self.stream, starts, owners, size))

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), bool)
        return self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)] == hashes

    def scan(self, codes: np.ndarray, known: np.ndarray):
        """(start, size, item numbers) of every verified window in an array of word hashes; ``known``: words of the benchmark."""
        foreign = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(~known, out=foreign[1:])
        for windows in self.windows:
            size = windows.size
            if len(codes) < size:
                continue
            starts = np.flatnonzero(foreign[size:] == foreign[:-size])
            if not len(starts):
                continue
            for i, w in zip(*(x.tolist() for x in windows.at(self.stream, codes, starts)), strict=True):
                yield i, size, windows.items[windows.ends[w - 1] if w else 0 : windows.ends[w]].tolist()


def window_hashes(codes: np.ndarray, starts: np.ndarray, size: int, salt: int = 1) -> np.ndarray:
    total = np.full(len(starts), salt, np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(32))) * _BASE + codes[starts + k]
    return total


def _parts(benchmark: DataFrame, item_id: str, item_text: str, max_words: int):
    """The benchmark's items on the driver, part by part; a part holds about ``max_words`` words."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    # Characters bound words from above, so nothing is collected to count them.
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // (4 * max_words)))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield [(r["item"], r["text"].encode()) for r in part.distinct().collect()], k + 1 < parts


def scan_documents(df: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_words: int = 4_000_000) -> DataFrame:
    """Add n_words, n_hit, n_items, items, spans and contaminated to every document.

    ``items`` are the ids, as sorted strings, of the items with a window in the document; ``spans``
    are the hit runs as [start, end) word positions; ``n_hit`` counts the words inside them. Null or
    wordless texts have no words and no hits, whatever the benchmark holds; a null or wordless item
    has no window; an item without id marks words but is not listed. Repeated items count once.
    Rows are kept as they are; columns of ``df`` named like the new ones are replaced. An item of
    more than ``max_words`` words makes a larger part by itself.
    """
    bound_batches(df.sparkSession)
    df, last = df.drop(*ADDED), None
    for part, more in _parts(benchmark, item_id, item_text, max_words):
        scanned = _scan_part(df, WindowSet(part, n), text)
        if not more:
            return scanned
        df = stage_table(scanned, "scan-part")
        if last is not None:
            drop_stage(last)
        last = df


ADDED = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def _scan_part(df: DataFrame, windows: WindowSet, text: str) -> DataFrame:
    """The columns of ``scan_documents`` for a part of the benchmark, united with those of the parts before."""
    shared = df.sparkSession.sparkContext.broadcast(windows)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), SPAN, T.BooleanType())
    kept = [c for c in df.columns if c not in ADDED]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True))])
    further = "spans" in df.columns

    def scan(batches):
        part = shared.value
        for whole in batches:
            for batch in split_batch(whole, text):
                index: dict[bytes, int] = {}
                docs = [[index.setdefault(w, len(index)) for w in normalised_words(x)] for x in byte_values(batch.column(text))]
                hashes = np.concatenate([word_hashes(index), np.zeros(1, np.uint64)])
                known = part.knows(hashes)
                known[-1] = False  # the foreign word between documents
                sizes = np.array([len(x) for x in docs], np.int64)
                begins = np.concatenate([[0], np.cumsum(sizes + 1)])
                words = np.full(begins[-1], len(index), np.int64)
                for doc, b in zip(docs, begins.tolist(), strict=False):
                    words[b : b + len(doc)] = doc
                marks = np.zeros(begins[-1] + 1, np.int32)
                items: list[set] = [set() for _ in docs]
                if further:
                    for d, (spans, found) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                        items[d].update(found)
                        for s in spans:
                            marks[begins[d] + s["start"]] += 1
                            marks[begins[d] + s["end"]] -= 1
                for i, size, found in part.scan(hashes[words], known[words]):
                    marks[i] += 1
                    marks[i + size] -= 1
                    items[int(np.searchsorted(begins, i, "right")) - 1].update(part.names[x] for x in found)
                hit = np.cumsum(marks)[:-1] > 0
                edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                owner = np.searchsorted(begins, opens, "right") - 1
                spans: list[list] = [[] for _ in docs]
                for d, a, b in zip(owner.tolist(), opens.tolist(), closes.tolist(), strict=True):
                    spans[d].append({"start": a - int(begins[d]), "end": b - int(begins[d])})
                n_hit = np.bincount(owner, closes - opens, len(docs)).astype(np.int64)
                listed = [sorted(x for x in found if x is not None) for found in items]
                new = [
                    pa.array(sizes), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()),
                    pa.array(listed, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(n_hit > 0),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *ADDED])

    return df.mapInArrow(lambda b: give_back(scan(b)), schema)


def cut_spans(data: bytes, spans) -> bytes:
    """The text without its hit runs of words; what stands between words stays."""
    words = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for s in spans:
        out.append(data[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return b"".join([*out, data[at:]])


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, text: str = "text", **options) -> DataFrame:
    """Documents without benchmark passages: hit documents go, or (``remove="spans"``) only the hit runs.

    Clean rows are returned unchanged, null texts among them.
    """
    columns = df.columns
    scanned = scan_documents(df, benchmark, n, text, **options)
    if remove == "documents":
        return scanned.where(~F.col("contaminated")).select(columns)
    if remove != "spans":
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    schema = scanned.schema

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
            new = [cut_spans(t.encode(), s).decode("utf-8", "replace") if s else t for t, s in zip(texts, spans, strict=True)]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(new, pa.string()))

    return scanned.mapInArrow(cut, schema).select(columns)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of ``scan_documents``' result."""
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def oracle_sql(docs: str = "documents", benchmark: str = "benchmark", n: int = 10) -> str:
    """DuckDB SQL for the rows of the registered query."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    cut = "array_to_string(w[i:i + n - 1], ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {docs}),
b AS (SELECT item_id, w, least({n}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM {benchmark}) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, {cut} AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, n, i, {cut} AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, t)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""
