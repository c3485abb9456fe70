"""Operator 1: document likelihood by a subword lattice.

The vocabulary of an existing tokenizer gives the pieces; a unigram distribution over them weights
every segmentation of a word, and a forward recursion in log space sums over all of them. Pieces
that begin a word carry the white-space mark and none crosses a word start, so a document's
marginal probability is the product of its words' and of the end token's. A character outside the
vocabulary is spelt by the 256 byte pieces. Beside the vocabulary's pieces a word's lattice has one
arc over the whole word if it was seen in training: its count less a discount (from the counts of
counts); the mass so freed weights the segmentations into pieces.

Training documents may be of several groups (languages, say). Each group has its own piece scores
and counts, and a text's probability is the mixture over the groups, so the group of a scored text
is never an input.

The vocabulary's own scores are the base: a unigram vocabulary's are log probabilities and are taken
as they are; a merge-type vocabulary's are ranks r, which stand for weights 1 / (r + 2.7) (Zipf). They
are refined by expectation maximisation, in which they stay the prior: expected piece counts over all
segmentations, summed over the distinct training words, are added to pseudo-counts in proportion to
them. With no iterations the vocabulary's scores are used alone. Only word counts, which grow with the corpus, are shuffled; only piece counts, bounded by
the vocabulary, reach the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bound_batches, byte_values, drop_stage, rebatch, split_batch, stage_table

MARK = "▁"
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
SLOTS = 1 << 20
#: Words whose probabilities travel by broadcast, at most; the others are joined by shuffle.
HEAD_WORDS = 100_000
#: Words whose lattices are worked off together; numpy's cost is per call.
WORDS_AT_ONCE = 200_000
#: Different words that a task counts before it passes their counts on (and those of one more text slice).
WORDS_HELD = 300_000
LOG10 = np.log(10.0)


def pieces_of(model_path: str) -> dict[str, float]:
    """The ordinary pieces of a SentencePiece model with their log weights; a mark stands first in a piece or nowhere.

    Scores that are all whole numbers are negated ranks of merges, others log probabilities.
    """
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    scores = {p: lib.get_score(i) for i in ids if MARK not in (p := lib.id_to_piece(i))[1:]}
    ranks = all(x == round(x) for x in scores.values())
    return {p: -float(np.log(2.7 - x)) if ranks else x for p, x in scores.items()}


@dataclass
class PieceLattice:
    """Pieces with log probabilities, groups x indices; len(pieces) + b is byte b, the last index the end of a text."""

    pieces: list[str]
    log_p: np.ndarray
    longest: int = 0
    _keys: np.ndarray = field(default=None, repr=False)
    _index: np.ndarray = field(default=None, repr=False)

    @staticmethod
    def start(pieces: dict[str, float] | list[str], groups: int = 1) -> PieceLattice:
        """The pieces' own log weights (Zipf by order, if they have none); a thousandth of the mass for bytes and end."""
        own = np.exp(list(pieces.values())) if isinstance(pieces, dict) else 1 / (np.arange(len(pieces)) + 2.7)
        weights = np.concatenate([own, np.zeros(257)])
        weights /= weights.sum()
        weights[len(pieces) :] = 1e-3 / 257
        return PieceLattice(list(pieces), np.tile(np.log(weights / weights.sum()), (groups, 1)))

    @property
    def end(self) -> int:
        return len(self.pieces) + 256

    def table(self) -> None:
        """An open hash table from the polynomial hash of a piece's characters to its index."""
        if self._keys is not None:
            return
        self.longest = max((len(p) for p in self.pieces), default=1)
        keys, index = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        for i, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = (h * BASE + ord(c)) % (1 << 64)
            s = (h * MIX) % (1 << 64) >> 44
            while index[s] >= 0:
                s = (s + 1) % SLOTS
            keys[s], index[s] = h, i
        self._keys, self._index = keys, index

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece indices of substring hashes, -1 where none."""
        slot = ((hashes * np.uint64(MIX)) >> np.uint64(44)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.flatnonzero(self._index[slot] >= 0)
        while len(open_):
            s = slot[open_]
            same = self._keys[s] == hashes[open_]
            out[open_[same]] = self._index[s[same]]
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) % SLOTS
            open_ = open_[self._index[slot[open_]] >= 0]
        return out

    def arcs(self, codes: np.ndarray):
        """For words of one length (rows of code points, the mark first): arcs[(begin, end)] = piece indices.

        The second result holds, per position, the rows whose character has no piece of its own.
        """
        rows, n = codes.shape
        base = np.uint64(BASE)
        prefix = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * base + codes[:, i].astype(np.uint64)
        powers = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(self.longest + 1)]
        found = {}
        for e in range(1, n + 1):
            for b in range(max(0, e - self.longest), e):
                ids = self.find(prefix[e] - prefix[b] * powers[e - b])
                if b == e - 1 or (ids >= 0).any():
                    found[b, e] = ids
        return found, {i: np.flatnonzero(found[i, i + 1] < 0) for i in range(n)}

    def spell(self, codes: np.ndarray) -> list[list[int]]:
        """Indices of the byte pieces of characters."""
        return [[len(self.pieces) + b for b in chr(c).encode("utf-8", "replace")] for c in codes.tolist()]

    def forward(self, codes: np.ndarray, found: dict, odd: dict, log_p: np.ndarray) -> np.ndarray:
        """alpha[position, word]: log of the summed probability of all segmentations up to there."""
        rows, n = codes.shape
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        score = np.append(log_p, -np.inf)  # index -1: no piece
        for e in range(1, n + 1):
            terms = [alpha[b] + score[found[b, e]] for b in range(max(0, e - self.longest), e) if (b, e) in found]
            if len(odd[e - 1]):
                at = odd[e - 1]
                terms[-1] = terms[-1].copy()
                terms[-1][at] = alpha[e - 1][at] + [sum(log_p[k] for k in s) for s in self.spell(codes[at, e - 1])]
            top = np.maximum.reduce(terms)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[e] = safe + np.log(sum(np.exp(t - safe) for t in terms))
        return alpha

    def word_log_p(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability, groups x words."""
        self.table()
        out = np.zeros((len(self.log_p), len(words)))
        for at, codes in same_length(words):
            found, odd = self.arcs(codes)
            for g, log_p in enumerate(self.log_p):
                out[g, at] = self.forward(codes, found, odd, log_p)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, group: int = 0) -> np.ndarray:
        """Expected piece counts over all segmentations of the words, each weighted by its count."""
        self.table()
        log_p = self.log_p[group]
        total = np.zeros(len(log_p))
        score = np.append(log_p, -np.inf)
        for at, codes in same_length(words):
            found, odd = self.arcs(codes)
            rows, n = codes.shape
            alpha = self.forward(codes, found, odd, log_p)
            beta = np.full((n + 1, rows), -np.inf)
            beta[n] = 0
            weight, whole = counts[at], alpha[n]
            for b in range(n - 1, -1, -1):
                terms = []
                for e in range(b + 1, min(n, b + self.longest) + 1):
                    if (b, e) not in found:
                        continue
                    ids = found[b, e]
                    step = score[ids] + beta[e]
                    if e == b + 1 and len(odd[b]):
                        rest = odd[b]
                        spelt = self.spell(codes[rest, b])
                        step[rest] = [sum(log_p[k] for k in s) for s in spelt] + beta[e][rest]
                        share = np.exp(alpha[b][rest] + step[rest] - whole[rest]) * weight[rest]
                        for s, x in zip(spelt, share.tolist(), strict=True):
                            for k in s:
                                total[k] += x
                    has = np.flatnonzero(ids >= 0)
                    share = np.exp(alpha[b][has] + step[has] - whole[has]) * weight[has]
                    total += np.bincount(ids[has], share, len(total))
                    terms.append(step)
                top = np.maximum.reduce(terms)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    beta[b] = safe + np.log(sum(np.exp(t - safe) for t in terms))
        return total


def same_length(words: list[str], block: int = 40_000):
    """(positions, code points with the mark first) of words of one length; a block holds at most ``block`` characters, or one word."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        size = int(sizes[order[i]])
        j = min(int(np.searchsorted(sizes[order], size, "right")), i + max(1, block // (size + 1)))
        at = order[i:j]
        data = "".join(words[k] for k in at.tolist()).encode("utf-32-le", "surrogatepass")
        codes = np.empty((len(at), size + 1), np.uint32)
        codes[:, 0] = ord(MARK)
        codes[:, 1:] = np.frombuffer(data, np.uint32).reshape(len(at), size)
        codes[:, 1:][codes[:, 1:] == ord(MARK)] = 0  # a mark inside the text is a character without a piece
        yield at, codes
        i = j


def tokens(data: bytes) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D, A-Z lower-cased."""
    return data.lower().split()


@dataclass
class WordModel:
    """Per group: training tokens, discounts of counts 1, 2 and more, freed mass, and prior; ends of texts count as tokens."""

    tokens: np.ndarray
    discounts: np.ndarray
    freed: np.ndarray
    ends: np.ndarray

    def discount(self, counts: np.ndarray, group: int) -> np.ndarray:
        return np.append(0.0, self.discounts[group])[np.minimum(counts, 3)]

    def log10_p(self, counts: np.ndarray, spelt: np.ndarray, group: int) -> np.ndarray:
        """Whole-word arc and all segmentations (natural logs ``spelt``) together."""
        p = (counts - self.discount(counts, group)) / max(self.tokens[group], 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(p), np.log(self.freed[group]) + spelt) / LOG10


def count_words(rows: DataFrame, groups: int) -> DataFrame:
    """(word, c0 .. , whole): occurrences by group of the training texts, and in all texts; partial counts per task.

    ``rows`` holds ``text`` and ``part``, the group's number or null outside the training set.
    """
    names = [f"c{g}" for g in range(groups)]

    def columns(found):
        words = list(set().union(*found))
        counts = [np.array([f[w] for w in words], np.int64) for f in found]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), **dict(zip(names, counts, strict=False)), "whole": sum(counts)})

    def count(batches):
        found = [Counter() for _ in range(groups + 1)]
        for whole in batches:
            for batch in split_batch(whole, "text", 8 << 20):
                for data, part in zip(byte_values(batch.column("text")), batch.column("part").to_pylist(), strict=True):
                    found[groups if part is None else part].update(tokens(data))
                if sum(map(len, found)) > WORDS_HELD:
                    yield columns(found)
                    found = [Counter() for _ in range(groups + 1)]
        yield columns(found)

    schema = "word string, " + ", ".join(f"{n} long" for n in names) + ", whole long"
    return rows.mapInArrow(count, schema).groupBy("word").agg(*(F.sum(n).alias(n) for n in (*names, "whole")))


def fit_words(counts: DataFrame, ends: list[int]) -> WordModel:
    """Discounts from the counts of counts (one aggregation), tokens and freed mass."""
    names = [f"c{g}" for g in range(len(ends))]
    sums = [F.coalesce(F.sum(F.col(n)), F.lit(0)).alias(f"{n}_n") for n in names]
    sums += [F.count(F.when((F.col(n) == k) if k < 5 else (F.col(n) >= 5), True)).alias(f"{n}_{k}") for n in names for k in range(1, 6)]
    row = counts.agg(*sums).first()
    tokens_, discounts, freed = [], [], []
    for n, e in zip(names, ends, strict=True):
        n1, n2, n3, n4, more = (row[f"{n}_{k}"] for k in range(1, 6))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [min(max(k - (k + 1) * y * b / a if a else 0.5 * k, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total = row[f"{n}_n"] + e
        tokens_.append(total)
        discounts.append(d)
        freed.append(max((d[0] * n1 + d[1] * n2 + d[2] * (n3 + n4 + more)) / max(total, 1), 1e-9) if n1 + n2 + n3 + n4 + more else 1.0)
    return WordModel(np.array(tokens_, float), np.array(discounts), np.array(freed), np.array(ends, float))


def estimate(counts: DataFrame, pieces: dict[str, float] | list[str], model: WordModel, iterations: int = 4, smoothing: float = 0.1) -> PieceLattice:
    """Piece scores of every group by expectation maximisation on the words' discounts, the mass that segmentations carry.

    The vocabulary's own scores are the prior, with ``smoothing`` pseudo-counts a piece on average.
    """
    groups = len(model.tokens)
    lattice = PieceLattice.start(pieces, groups)
    prior = smoothing * lattice.log_p.shape[1] * np.exp(lattice.log_p)
    spark = counts.sparkSession
    learned = counts.where(" OR ".join(f"c{g} > 0" for g in range(groups)))
    for _ in range(iterations):
        current = spark.sparkContext.broadcast(lattice)

        def expect(batches, current=current):
            total = np.zeros(current.value.log_p.shape)
            for batch in rebatch(batches, WORDS_AT_ONCE):
                words = batch.column("word").to_pylist()
                for g in range(groups):
                    c = batch.column(f"c{g}").to_numpy()
                    at = np.flatnonzero(c)
                    if len(at):
                        total[g] += current.value.expected([words[i] for i in at.tolist()], model.discount(c[at], g), g)
            for g in range(groups):
                at = np.flatnonzero(total[g])
                yield pa.RecordBatch.from_pydict({"part": pa.array([g] * len(at), pa.int32()), "piece": at.astype(np.int32), "n": total[g][at]})

        sums = learned.mapInArrow(expect, "part int, piece int, n double").groupBy("part", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = prior.copy()
        n[sums["part"].to_numpy(), sums["piece"].to_numpy()] += sums["n"].to_numpy()
        # A word is over when the next begins or the text ends: the end's share is that among tokens.
        n[:, lattice.end] += n.sum(1) * model.ends / np.maximum(model.tokens, 1)
        lattice = PieceLattice(list(pieces), np.log(n / n.sum(1, keepdims=True)))
    return lattice


def word_scores(counts: DataFrame, lattice: PieceLattice, model: WordModel) -> DataFrame:
    """(word, train, whole, p0 ..): training count of all groups, and log10 of the word's probability by group."""
    current = counts.sparkSession.sparkContext.broadcast(lattice)
    groups = len(model.tokens)

    def score(batches):
        for batch in rebatch(batches, WORDS_AT_ONCE):
            words = batch.column("word").to_pylist()
            spelt = current.value.word_log_p(words)
            c = [batch.column(f"c{g}").to_numpy() for g in range(groups)]
            found = {f"p{g}": model.log10_p(c[g], spelt[g], g) for g in range(groups)}
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "train": sum(c), "whole": batch.column("whole"), **found})

    return counts.mapInArrow(score, "word string, train long, whole long, " + ", ".join(f"p{g} double" for g in range(groups)))


def score_documents(df: DataFrame, pieces: dict[str, float] | list[str], train: Column, group: Column | None = None, doc_id: str = "doc_id", text: str = "text", iterations: int = 4, head_words: int = HEAD_WORDS, max_groups: int = 16) -> DataFrame:
    """Score every row's whole text by the lattice, and by an additively smoothed word model beside it.

    Returns doc_id, is_train, n_tokens, n_known, train_tokens, base_score and score (log10), one row
    per row of ``df``, repeated rows and null ids included. ``train`` marks the rows to learn from
    (null: not); ``group`` deals them into groups (null is one of them), of which the ``max_groups``
    - 1 largest count by themselves and the rest together. Null and empty texts consist of the end
    token. Other columns are not read. A word of any length is scored whole, in linear time.

    Word probabilities reach the texts in two ways: the most frequent words, ``head_words`` at most,
    by broadcast; each text's other words, once per text, by a join on the word. Tables in between
    are written to the shared folder, so a lost executor costs no recomputation from the texts.
    """
    bound_batches(df.sparkSession)
    spark = df.sparkSession
    group = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("is_train"), group.alias("group"))
    sizes = rows.where("is_train").groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    largest = [(r["group"], r["n"]) for r in sizes.orderBy(F.desc("n"), "group").limit(max_groups - 1).collect()]
    rest = (sizes.agg(F.sum("n").alias("n")).first()["n"] or 0) - sum(n for _, n in largest)
    ends = [n for _, n in largest] + ([rest] if rest or not largest else [])
    part = F.lit(len(largest))
    for g, (name, _) in enumerate(largest):
        part = F.when(F.col("group") == name, g).otherwise(part)
    rows = rows.withColumn("part", F.when(F.col("is_train"), part))
    groups, all_ends = len(ends), sum(ends)

    counts = stage_table(count_words(rows.select("text", "part"), groups), "lm-counts")
    model = fit_words(counts, ends)
    v = counts.where(" + ".join(f"c{g}" for g in range(groups)) + " > 0").count() + (all_ends > 0)
    n = int(model.tokens.sum())
    lattice = estimate(counts, pieces, model, iterations)
    scored = stage_table(word_scores(counts, lattice, model), "lm-words")
    drop_stage(counts)

    spread = n + 0.1 * (v + 1)
    shared = spark.sparkContext.broadcast(_head(scored, head_words, spread, groups))
    safe = np.maximum(model.tokens, 1)
    with np.errstate(divide="ignore"):
        end_scores = np.log10(np.where(model.ends > 0, model.ends / safe, 0.1 / spread))
    end_base, prior = float(np.log10((all_ends + 0.1) / spread)), np.array(ends) / max(all_ends, 1) if all_ends else np.ones(groups) / groups
    names = [f"s{g}" for g in range(groups)]
    word = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def measure(batches):
        index, rows_ = shared.value
        get = index.get
        for whole in batches:
            for batch in split_batch(whole, "text"):
                totals, known, tails, sums = [], [], [], []
                for data in byte_values(batch.column("text")):
                    words = tokens(data)
                    at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    totals.append(len(words) + 1)
                    found = rows_[at[at >= 0]].sum(0)
                    known.append(int(found[0]) + (all_ends > 0))
                    sums.append(found[1:])
                    tails.append([{"word": w.decode(), "n": c} for w, c in Counter([words[i] for i in np.flatnonzero(at < 0).tolist()]).items()])
                table = np.array(sums).reshape(len(totals), groups + 1) + np.append(end_base, end_scores)
                arrays = [pa.array(totals, pa.int64()), pa.array(known, pa.int64()), *(pa.array(x) for x in table.T.copy()), pa.array(tails, pa.list_(word))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("is_train"), *arrays], names=["doc_id", "is_train", "n_tokens", "n_known", "base_score", *names, "tail"])

    kinds = [("n_tokens", T.LongType()), ("n_known", T.LongType()), *((x, T.DoubleType()) for x in ("base_score", *names))]
    tail = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("is_train", T.BooleanType()), *(T.StructField(*x) for x in kinds), T.StructField("tail", tail)])
    measured = rows.select("doc_id", "is_train", "text").mapInArrow(measure, schema)
    heads = stage_table(measured.withColumn("row", F.monotonically_increasing_id()), "lm-heads")
    tails = heads.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    weighted = lambda x: F.sum(F.col("n") * x)
    tails = tails.join(scored.drop("whole"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("t_known"),
        weighted(F.log10((F.col("train") + 0.1) / F.lit(float(spread)))).alias("t_base"),
        *(weighted(F.col(f"p{g}")).alias(f"t{g}") for g in range(groups)),
    )
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    mixed = [add(f"s{g}", f"t{g}") + float(np.log10(prior[g])) for g in range(groups)]
    best = F.greatest(*mixed) if groups > 1 else mixed[0]
    total = sum((F.pow(F.lit(10.0), x - F.col("best")) for x in mixed), F.lit(0.0))
    return (
        heads.join(tails, "row", "left")
        .withColumn("best", best)
        .select("doc_id", "is_train", "n_tokens", add("n_known", "t_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("base_score", "t_base").alias("base_score"), (F.col("best") + F.log10(total)).alias("score"))
    )


def _head(scored: DataFrame, most: int, spread: float, groups: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The most frequent words, ``most`` at most: word -> row of (known, base, log10 probabilities by group).

    Frequencies' own counts tell from which frequency on there are few enough words.
    """
    ranks = scored.where("whole > 1").groupBy("whole").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("whole", ascending=False)
    fits = ranks["whole"][ranks["words"].cumsum() <= most]
    if not len(fits):
        return {}, np.zeros((0, groups + 2))
    top = scored.where(F.col("whole") >= int(fits.min())).toPandas()
    base = np.log10((top["train"] + 0.1) / spread)
    table = np.column_stack([(top["train"] > 0).astype(float), base, *(top[f"p{g}"] for g in range(groups))])
    return {w.encode(): i for i, w in enumerate(top["word"])}, table
