"""First match among many definitions, each a list of texts that a title must contain."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the words of the definitions that are broadcast at once.
MAX_CHARACTERS = 10_000_000


def first_match(rows: DataFrame, definitions: DataFrame, title: str = "title", found: str = "definition", max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """Add the name of the first definition (by ``rank``) whose every word is contained in the title; null if there is none.

    ``definitions``: rank (long, distinct), name (string), words (array of strings). Empty and null words are ignored; a definition
    without words matches nothing, and so do null titles. Of definitions of the same words only the first is kept. All words are found in one pass over a title by an
    automaton, whatever their number. Definitions of more than ``max_characters`` are taken part by part in
    the order of rank; a title that has its first match is not looked at again.
    """
    rows = rows.drop(found).withColumn(found, F.lit(None).cast("string"))
    known = definitions.select("rank", "name", F.filter("words", lambda w: w.isNotNull() & (w != "")).alias("words")).where("size(words) > 0")
    known = known.withColumn("words", F.array_sort(F.array_distinct("words"))).groupBy("words").agg(F.min(F.struct("rank", "name")).alias("d")).select("d.rank", "d.name", "words")
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    total = known.agg(F.sum(size).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // max_characters))
    cuts = known.agg(F.percentile_approx("rank", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = known if low is None else known.where(F.col("rank") > low)
        part = part if high is None else part.where(F.col("rank") <= high)
        rows = _match(rows, [(r["name"], tuple(r["words"])) for r in part.orderBy("rank").collect()], title, found)
    return rows


def _match(rows: DataFrame, listed: list[tuple[str, tuple[str, ...]]], title: str, found: str) -> DataFrame:
    uses: dict[str, int] = {}
    for _, words in listed:
        for w in words:
            uses[w] = uses.get(w, 0) + 1
    # Each definition waits for its rarest word, and behind it for the next one, so that a title looks up pairs of its words.
    waiting: dict[str, dict[str | None, list[int]]] = {}
    for i, (_, words) in enumerate(listed):
        rare = sorted(words, key=lambda w: (uses[w], w))[:2]
        waiting.setdefault(rare[0], {}).setdefault(rare[1] if len(rare) > 1 else None, []).append(i)
    shared = rows.sparkSession.sparkContext.broadcast((listed, waiting, list(uses)))

    def match(batches):
        definitions, first, words = shared.value
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()
        for batch in batches:
            out = []
            for text, before in zip(batch.column(title).to_pylist(), batch.column(found).to_pylist(), strict=True):
                if before is not None or not text or not words:
                    out.append(before)
                    continue
                held = {w for _, w in automaton.iter(text)}
                best = len(definitions)
                for behind in (first[w] for w in held if w in first):
                    for second in behind.keys() & held if len(held) < len(behind) else (x for x in behind if x in held):
                        best = _first(behind[second], definitions, held, best)
                    best = _first(behind.get(None, ()), definitions, held, best)
                out.append(None if best == len(definitions) else definitions[best][0])
            yield batch.set_column(batch.schema.get_field_index(found), found, pa.array(out, pa.string()))

    return rows.mapInArrow(match, T.StructType(rows.schema.fields))


def _first(numbers, definitions, held: set[str], best: int) -> int:
    """The first of ascending numbers below ``best`` whose definition's words are all held; ``best`` if there is none."""
    for i in numbers:
        if i >= best:
            break
        if all(x in held for x in definitions[i][1]):
            return i
    return best
