"""Operator 10: encoding and decoding with merge-type SentencePiece vocabularies.

The encoder keeps an agenda (a heap) of adjacent symbol pairs whose concatenation is a piece,
ordered by piece score, then by position, and merges the best pair until none is left. Symbols
outside the vocabulary become byte pieces.

No piece of such a vocabulary has a white-space mark after another character and none holds a
newline (checked when the vocabulary is loaded), so no merge crosses a word start or a newline.
The text is encoded word by word with a bounded memo of words; every word that enters the memo is
compared with the sentencepiece library, a whole Arrow batch of new words at a time, and so is the
first text of each batch, encoded and decoded whole. A difference raises an error.
Chunks of texts with odd spaces (``_ODD``) enter the memo without this comparison.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bound_batches, give_back, keep, split_batch

MARK = "▁"
#: Words kept by a Python worker, about 250 bytes each; beyond that the memo starts afresh.
MEMO_WORDS = 600_000
#: Up to so many symbols the agenda is a flat list, whose minimum is faster to find than a heap is to keep.
FLAT_AGENDA = 32

_CHUNKS = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_ODD = re.compile(rf"  | \n|\n |^ | $|{MARK}")
_LOADED: dict[bytes, "MergeVocabulary"] = {}


class MergeVocabulary:
    """A merge-type vocabulary: pieces, scores and the agenda encoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.cost = {p: -lib.get_score(i) for i, p in enumerate(names) if not special[i]}
        # The values are shared integers, so that memoised words hold no copies.
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.byte_fallback = all(lib.is_byte(i) for i in self.bytes)
        self.eos = lib.eos_id()
        byte_of = {i: bytes([b]) for b, i in enumerate(self.bytes)} if self.byte_fallback else {}
        self.surface = [
            byte_of[i] if i in byte_of else b"" if special[i] else p.replace(MARK, " ").encode()
            for i, p in enumerate(names)
        ]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.cost):
            raise ValueError("the vocabulary has pieces that cross a word start or a newline")
        self.memo_words = MEMO_WORDS
        self.marked: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of an escaped string, by the agenda of adjacent pairs."""
        symbols = list(text)
        if len(symbols) > 1:
            symbols = self._flat(symbols) if len(symbols) <= FLAT_AGENDA else self._heap(symbols)
        ids = self.ids
        try:
            return tuple([ids[s] for s in symbols])
        except KeyError:
            return tuple(chain.from_iterable([(ids[s],) if s in ids else self._outside(s) for s in symbols]))

    def _outside(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode("utf-8")] if self.byte_fallback else [self.unknown]

    def _flat(self, symbols: list[str]) -> list[str]:
        """Merge by a list of the pairs' costs; the first of equal costs is the leftmost."""
        cost, none = self.cost.get, float("inf")
        agenda = [cost(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], none)
        return symbols

    def _heap(self, symbols: list[str]) -> list[str]:
        """Merge by a heap of pairs; entries whose symbols have changed since are passed over."""
        cost, n = self.cost.get, len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            nxt, prev = after[right], before[left]
            after[left] = nxt
            for a, b in ((left, nxt), (prev, left)):
                if a >= 0 and b >= 0 and (c := cost(symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (c, a, b, len(symbols[a]) + len(symbols[b])))
            if nxt >= 0:
                before[nxt] = left
        return [s for s in symbols if s]

    def learn(self, words: set[str], memo: dict[str, tuple[int, ...]], marked: bool) -> None:
        """Encode words new to a memo and hold them against the library."""
        new = [w for w in words if w not in memo]
        if not new:
            return
        ours = [self.merge(MARK + w if marked else w) for w in new]
        # The library puts a mark before each text; for a bare word a newline comes between.
        theirs = self.library.encode(new if marked else ["\n" + w for w in new], num_threads=1)
        skip = 0 if marked else len(self.library.encode("\n"))
        for w, mine, other in zip(new, ours, theirs, strict=True):
            if w and list(mine) != other[skip:]:
                raise ValueError(f"agenda and library differ on {w[:80]!r}: {mine[:20]} {other[skip:][:20]}")
            memo[w] = mine

    def forget(self) -> None:
        """Give the memo's memory back."""
        self.marked.clear()
        self.bare.clear()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts without special ids."""
        if len(self.marked) + len(self.bare) > self.memo_words:
            self.forget()
        parsed: list[list[list[str]]] = []
        marked, bare = set(), set()
        for text in texts:
            if _ODD.search(text):  # runs of spaces and the like: chunks of one "line" each
                chunks = _CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []
                parsed.append([[], chunks])
                self.bare.update((c, self.merge(c)) for c in set(chunks) if c not in self.bare)
                continue
            lines = [line.split(" ") for line in text.split("\n")] if text else []
            parsed.append([lines])
            for k, words in enumerate(lines):
                if k:
                    bare.add(words[0])
                    marked.update(words[1:])
                else:
                    marked.update(words)
        self.learn(marked, self.marked, True)
        self.learn(bare, self.bare, False)
        newline, spaced, single = self.merge("\n"), self.marked.__getitem__, self.bare.__getitem__
        flat = chain.from_iterable
        out = []
        for parts in parsed:
            ids: list[int] = []
            if len(parts) == 2:
                ids.extend(flat(map(single, parts[1])))
            else:
                for k, words in enumerate(parts[0]):
                    if k:
                        ids.extend(newline)
                        ids.extend(single(words[0]))
                        words = words[1:]
                    ids.extend(flat(map(spaced, words)))
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, marks as spaces, one leading space removed, bytes as UTF-8."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", errors="replace")
        return text[1:] if text[:1] == " " else text


def _loaded(model) -> MergeVocabulary:
    """The vocabulary of a broadcast model and its memo, kept from task to task until another operator runs in the worker."""
    key = model.value
    keep("sentencepiece", _LOADED.clear)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeVocabulary(key)
    return _LOADED[key]


def check_batch(vocab: MergeVocabulary, text: str, ids: list[int], decoded: str) -> None:
    """Hold one whole text against the library, encoded and decoded."""
    if vocab.library.encode(text) != ids or vocab.library.decode(ids) != decoded:
        raise ValueError(f"encoding differs from the library on a text of {len(text)} characters")


def encode_documents(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", end_id: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Add ``ids`` (array<int>, the end id last if ``end_id``) and ``decoded`` (string) to every row.

    One narrow pass, no shuffle; the model file (a few hundred kB, read on the driver) is broadcast.
    A null text counts as empty: no ids but the end id, and an empty decoded text. Rows are kept as
    they are, repeated ones too; columns of ``df`` named like the two new ones are replaced. Words
    without spaces cost O(n log n) in the agenda, and a batch is worked off in slices of about 2 MB
    of text, so very long texts are held one at a time.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    bound_batches(df.sparkSession)
    df = df.drop(ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def encode(batches):
        vocab = _loaded(model)
        vocab.memo_words = memo_words
        end = [vocab.eos] if end_id else []
        for whole in batches:
            first = True
            for batch in split_batch(whole, text):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                found = vocab.encode_all(texts)
                back = [vocab.decode(x) for x in found]
                if first and texts:
                    check_batch(vocab, texts[0], found[0], back[0])
                    first = False
                rows = [np.array(x + end, np.int32) for x in found]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(x) for x in rows], out=offsets[1:])
                values = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(back, pa.string())],
                    names=[*batch.schema.names, ids, decoded],
                )

    return df.mapInArrow(lambda b: give_back(encode(b), "sentencepiece"), schema)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text of each row's ids. Null ids give an empty text; null members are left out."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop(decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def decode(batches):
        vocab = _loaded(model)
        for batch in batches:
            out = [vocab.decode([i for i in x or () if i is not None]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, decoded])

    return df.mapInArrow(decode, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_documents``' result."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
