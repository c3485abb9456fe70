"""Operator 9: document quality by votes of labelled neighbours in a latent-semantic space.

A document is a bag of terms: its words, hashed into a table of fixed size, and its shape: trigrams of
its characters' classes (letter runs count once, so they are the same in every language), words that
repeat their predecessor, and words seen before. Square-rooted frequencies times inverse document
frequencies are projected on the leading singular vectors of the labelled sample, found by subspace
iteration. The labelled vectors and the projection have a fixed maximal size
(``max_labelled`` x ``dimensions`` and terms x ``dimensions``) and are broadcast; every document's
cosines with all labelled vectors are computed exactly, in blocks, and its ``neighbours`` nearest
vote with their similarity as weight.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bound_batches, byte_values, give_back, split_batch

#: Character classes: code, and the ASCII characters that have it; bytes above ASCII count as letters.
CLASSES = (
    (1, bytes(range(65, 91))), (2, bytes(range(97, 123)) + bytes(range(128, 256))), (3, b"0123456789"), (4, b" "), (5, b"\n"),
    (6, bytes(b for b in range(32) if b != 10) + b"\x7f"), (7, b"."), (8, b",;:"), (9, b"!?"), (10, b"|"), (11, b"#$%&*@"), (12, b"()[]{}<>"), (13, b"-_=+~^/\\"), (14, b"\"'`"),
)
_TABLE = bytes(next((code for code, chars in CLASSES if bytes([b]) in chars), 15) for b in range(256))
LETTER = 2
REPEATED, SEEN = 16**3, 16**3 + 1
#: Buckets of words, behind the terms of shape; the share of a document's weight that words have.
WORDS, WORD_SHARE = 1 << 12, 0.25
SHAPE = 16**3 + 2
TERMS = SHAPE + WORDS
#: Documents measured together: the terms and the cosines of a block take about 10 MB.
BLOCK = 64


def term_frequencies(data: bytes) -> np.ndarray:
    """Square roots of relative term frequencies of one text; zeros for an empty one."""
    out = np.zeros(TERMS, np.float32)
    codes = np.frombuffer(data.translate(_TABLE), np.uint8)
    if len(codes) > 1:
        run = (codes[1:] == LETTER) & (codes[:-1] == LETTER)
        codes = np.concatenate([codes[:1], codes[1:][~run]])
    if len(codes) > 2:
        c = codes.astype(np.int32)
        out[: 16**3] = np.sqrt(np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=16**3) / len(c))
    words = data.lower().split()
    if words:
        out[REPEATED] = np.sqrt(sum(map(operator.eq, words, words[1:])) / len(words))
        counts = Counter(words)
        out[SEEN] = np.sqrt(1 - len(counts) / len(words))
        at = SHAPE + np.array([xxhash.xxh3_64_intdigest(w) % WORDS for w in counts])
        out += np.sqrt(WORD_SHARE * np.bincount(at, list(counts.values()), TERMS) / len(words)).astype(np.float32)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class NeighbourModel:
    """idf-weighted projection, unit vectors and labels of the labelled sample by id, and their mean label.

    Similarities count to nine decimals; of labelled rows equally near, those of smaller ids vote.
    """

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return _unit(terms @ self.projection)

    def votes(self, terms: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Scores of documents given as rows of term frequencies; the prior where no neighbour has a say."""
        out = np.full(len(terms), self.prior)
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(terms) if k else 0, block):
            rows = terms[i : i + block]
            cosines = np.rint(self.latent(rows) @ self.vectors.T * 1e9).astype(np.int64)
            # Unequal keys, so the block that a document is in doesn't matter: similarity, then the order of ids.
            keys = cosines * len(self.labels) - np.arange(len(self.labels))
            at = np.sort(np.argpartition(-keys, k - 1, axis=1)[:, :k], axis=1)
            weights = np.maximum(np.take_along_axis(cosines, at, 1), 0) / 1e9
            total = weights.sum(1)
            voted = (weights * self.labels[at]).sum(1) / np.maximum(total, 1e-12)
            out[i : i + block] = np.where((total > 1e-9) & rows.any(1), voted, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 4000, dimensions: int = 24, neighbours: int = 15) -> NeighbourModel:
    """Fit on at most ``max_labelled`` labelled rows, chosen by a hash of their id.

    The bound keeps what reaches the driver and the executors the same at every input size. Labels
    that are null, or whose document is missing, are left out; several labels of an id count as
    their mean. Without labels the model scores every document 0.5.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.avg("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def measure(batches):
        for whole in batches:
            for batch in split_batch(whole, "text"):
                rows = [term_frequencies(x) for x in byte_values(batch.column("text"))]
                at = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column("id"), "label": batch.column("label"), "terms": [a.astype(np.int16) for a in at], "values": [r[a] for r, a in zip(rows, at, strict=True)]},
                    schema=pa.schema([("id", batch.schema.field("id").type), ("label", pa.float64()), ("terms", pa.list_(pa.int16())), ("values", pa.list_(pa.float32()))]),
                )

    schema = T.StructType([texts.schema["id"], T.StructField("label", T.DoubleType()), T.StructField("terms", T.ArrayType(T.ShortType())), T.StructField("values", T.ArrayType(T.FloatType()))])
    # Copies of a row with one id: the first by content, so the sample keeps its bound.
    found = texts.mapInArrow(measure, schema).groupBy("id").agg(F.min(F.struct("label", "terms", "values")).alias("row")).select("id", "row.*").toPandas()
    found = found.sort_values("id", kind="stable")
    rows = [(np.asarray(at, np.int64), np.asarray(values, np.float32)) for at, values in zip(found["terms"], found["values"], strict=True)]
    y = found["label"].to_numpy(np.float64)
    df = np.zeros(TERMS)
    for at, _ in rows:
        df[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)

    def dense(block: int = 256):
        """The rows as matrices of a few rows each: the whole one would take the driver's memory."""
        for i in range(0, len(rows), block):
            out = np.zeros((min(block, len(rows) - i), TERMS), np.float32)
            for k, (at, values) in enumerate(rows[i : i + block]):
                out[k, at] = values
            yield out

    projection = leading(lambda: (_unit(x * idf) for x in dense()), TERMS, dimensions) * idf[:, None].astype(np.float64)
    vectors = np.concatenate([np.zeros((0, dimensions)), *(_unit(x @ projection) for x in dense())])
    return NeighbourModel(projection, vectors, y, float(y.mean()) if len(y) else 0.5, neighbours)


def leading(blocks, terms: int, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors, as columns, of the matrix whose blocks of rows a call of ``blocks`` gives.

    Subspace iteration from fixed numbers; zeros beyond the matrix's rank.
    """
    out = np.zeros((terms, dimensions))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((terms, min(2 * dimensions, terms))))[0].astype(np.float32)
    n = sum(len(x) for x in blocks())
    if not n:
        return out
    for _ in range(rounds):
        basis = np.linalg.qr(sum(x.T @ (x @ basis) for x in blocks()))[0]
    _, values, turn = np.linalg.svd(np.concatenate([x @ basis for x in blocks()]), full_matrices=False)
    kept = min(dimensions, int((values > 1e-6 * max(values[0], 1e-30)).sum()))
    out[:, :kept] = basis @ turn[:kept].T
    return out


def score_documents(df: DataFrame, model: NeighbourModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) to every row, in one narrow pass.

    The whole text is used. Null and empty texts have no terms and get the labelled rows' mean.
    Rows are kept as they are; a column of ``df`` named like the new one is replaced.
    """
    bound_batches(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(score)
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])

    def measure(batches):
        fitted = known.value
        for whole in batches:
            for batch in split_batch(whole, text):
                texts = byte_values(batch.column(text))
                found = [fitted.votes(np.stack([term_frequencies(x) for x in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], names=[*batch.schema.names, score])

    return df.mapInArrow(lambda b: give_back(measure(b)), schema)
