"""Operator 5: language spans by per-word scores and Viterbi with a switching penalty.

Words are runs of letters and their marks; in scripts that are written without spaces each character
is one, so that spans can end anywhere. A word's score for a language is the log-likelihood of its byte
trigrams (hashed into a table of fixed size, so the model is bounded whatever the corpus holds). The
script of most of its characters, told by Unicode ranges, narrows the candidates to the languages that
were seen in that script. Viterbi then labels
each word of a text; changing the language costs ``penalty``. The recursion runs over all texts of
a slice at once, one word position at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bound_batches, split_batch

BUCKETS = 1 << 14
#: First code points of script ranges, in order, and the script from there on.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "han", "kana", "other", "han", "other", "hangul", "other", "han", "other", "han")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_STARTS = np.array(SCRIPT_STARTS)
_SCRIPT = np.array([SCRIPTS.index(x) for x in SCRIPT_NAMES])
#: Scripts without spaces between words: each character is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: ASCII bytes that are no letters become spaces; of higher characters, those that are neither letters nor marks.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: A script counts for a language from this share of its words on.
SCRIPT_SHARE = 0.01
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


@lru_cache(1)
def _separators() -> re.Pattern:
    """Characters above ASCII that are neither letters nor marks."""
    ranges, begun = [], None
    for c in range(0x80, 0x20001):
        apart = c < 0x20000 and unicodedata.category(chr(c))[0] not in "LM"
        if apart and begun is None:
            begun = c
        elif not apart and begun is not None:
            ranges.append(f"\\U{begun:08x}-\\U{c - 1:08x}")
            begun = None
    return re.compile(f"[{''.join(ranges)}]")


def words_of(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "replace").translate(_TABLE).split()
    if text.isascii():
        return words
    odd = {w for w in set(words) if not w.isascii() and _parts(w) != (w,)}
    return [p for w in words for p in (_parts(w) if w in odd else (w,))] if odd else words


@lru_cache(1 << 15)
def _parts(word: bytes) -> tuple[bytes, ...]:
    """A word between ASCII separators, split at other ones and at each character of an unspaced script."""
    return tuple(_UNSPACED.sub(r" \1 ", _separators().sub(" ", word.decode())).encode().split())


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of each byte trigram; a word is set between spaces."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    inside = np.flatnonzero(data[1:-1] != 32)
    owner = np.cumsum(data[:-2] == 32)[inside] - 1
    key = (data[inside] << 16) | (data[inside + 1] << 8) | data[inside + 2]
    return ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), owner


def code_points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code point, index of the word) of each character."""
    texts = [w.decode() for w in words]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.repeat(np.arange(len(words)), [len(t) for t in texts])


def scripts_of(words: list[bytes]) -> np.ndarray:
    """Number of each word's script, that of most of its characters; the first named one on ties."""
    out = np.zeros(len(words), np.int64)  # ASCII words are of the first script
    at = [i for i, w in enumerate(words) if not w.isascii()]
    points, owner = code_points([words[i] for i in at])
    script = _SCRIPT[np.searchsorted(_STARTS, points, "right") - 1]
    out[at] = np.bincount(owner * len(SCRIPTS) + script, minlength=len(at) * len(SCRIPTS)).reshape(len(at), -1).argmax(1) if at else 0
    return out


@dataclass
class LanguageModel:
    """log-likelihoods of trigram buckets, and the scripts each language is seen in."""

    languages: list[str]
    log_likelihood: np.ndarray  # languages x buckets
    scripts: np.ndarray  # languages x scripts, bool

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        bucket, owner = trigrams(words)
        out = np.stack([np.bincount(owner, row[bucket], len(words)) for row in self.log_likelihood], 1)
        allowed = self.scripts[:, scripts_of(words)].T
        allowed |= ~allowed.any(1, keepdims=True)  # a script no language has: all stay candidates
        return np.where(allowed, out, out.min() - 1e3).astype(np.float32)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count trigrams and scripts per language over every row whose text and language are not null.

    What is shuffled and collected is a count per language and bucket (partial sums per task), a
    size that does not depend on the number of rows. Without rows no language is known.
    """

    def count(batches):
        for whole in batches:
            for batch in split_batch(whole, "text"):
                by_lang: dict[str, Counter] = {}
                for t, g in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    by_lang.setdefault(g, Counter()).update(words_of(t))
                for g, words in by_lang.items():
                    known, weight = list(words), np.array(list(words.values()), np.float64)
                    if not known:
                        continue
                    bucket, owner = trigrams(known)
                    sums = np.concatenate([np.bincount(bucket, weight[owner], BUCKETS), np.bincount(scripts_of(known), weight, len(SCRIPTS))]).astype(np.int64)
                    at = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([g] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(sums[at])})

    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    table[[languages.index(g) for g in counts["lang"]], counts["bucket"]] = counts["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    likelihood = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return LanguageModel(languages, likelihood, scripts > SCRIPT_SHARE * scripts.sum(1, keepdims=True))


def viterbi(scores: np.ndarray, ids: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of every word: ``ids`` holds the words (rows of ``scores``) of texts of ``sizes`` words, end to end."""
    states = np.zeros(len(ids), np.int16)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    starts = (np.cumsum(np.concatenate([[0], sizes[np.argsort(order)]]))[:-1])[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    best = np.zeros((len(sizes), scores.shape[1]), np.float64)
    back = np.zeros((len(ids), scores.shape[1]), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        n = active[t]
        at, b = starts[:n] + t, best[:n]
        if t:
            top = b.argmax(1)
            other = b[np.arange(n), top] - penalty
            switch = b < other[:, None]
            back[at] = np.where(switch, top[:, None].astype(np.int16), own)
            b = np.maximum(b, other[:, None])
        best[:n] = b + scores[ids[at]]
    state = best.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        states[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return states


def label_spans(df: DataFrame, model: LanguageModel, text: str = "text", penalty: float = 12.0, lang_pred: str = "lang_pred", score: str = "score", spans: str = "spans") -> DataFrame:
    """Add the language of most letters, its share of them, and the language spans of every text.

    ``spans`` are [start, end) word positions with their language. A null text, or one without
    letters, is ``und`` with score 0 and no spans; so is every text if no language was learned.
    Ties go to the alphabetically first language. Whole texts are used, in one narrow pass; the
    memory of a slice is bounded by about 8 MB of text or one text. Columns of ``df`` named like
    the new ones are replaced.
    """
    bound_batches(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(lang_pred, score, spans)
    schema = T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(spans, SPANS)])

    def label(batches):
        fitted = known.value
        names = fitted.languages
        for whole in batches:
            for batch in split_batch(whole, text, 8 << 20):
                texts = [x if x and _LETTER.search(x) else "" for x in batch.column(text).to_pylist()]
                docs = [words_of(x) if names else [] for x in texts]
                index: dict[bytes, int] = {}
                put = index.setdefault
                sizes = np.array([len(x) for x in docs], np.int64)
                ids = np.array([put(w, len(index)) for d in docs for w in d], np.int64)
                preds, shares, found = [UNKNOWN] * len(docs), [0.0] * len(docs), [[] for _ in docs]
                if len(ids):
                    words = list(index)
                    states = viterbi(fitted.word_scores(words), ids, sizes, penalty)
                    letters = np.array([len(w) if w.isascii() else len(w.decode()) for w in words])[ids]
                    owner = np.repeat(np.arange(len(docs)), sizes)
                    mass = np.bincount(owner * len(names) + states, letters, len(docs) * len(names)).reshape(len(docs), -1)
                    total, top = mass.sum(1), mass.argmax(1)
                    opens = np.flatnonzero(np.concatenate([[True], (states[1:] != states[:-1]) | (owner[1:] != owner[:-1])]))
                    closes, first = np.append(opens[1:], len(states)), np.cumsum(sizes) - sizes
                    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
                        d = owner[a]
                        found[d].append({"start": a - int(first[d]), "end": b - int(first[d]), "lang": names[states[a]]})
                    for d in np.flatnonzero(total).tolist():
                        preds[d], shares[d] = names[top[d]], float(mass[d, top[d]] / total[d])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, lang_pred, score, spans])

    return df.mapInArrow(label, schema)
