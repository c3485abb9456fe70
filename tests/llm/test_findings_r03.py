"""Cases of the third round's findings on the training-data operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm import ngram_join, quality_neighbours, sentencepiece_bpe
from sightline.llm.common import give_back
from sightline.llm.queries import piece_model


def test_prefixes_of_later_orders_are_of_busy_classes_only(spark, monkeypatch):
    """Prefixes of all three orders were written for every text: most of the join's disk."""
    stored, stage = {}, ngram_join.stage_table

    def watched(df, label):
        out = stage(df, label)
        stored.setdefault(label, []).append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stage_table", watched)
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [words(k, 30) for k in range(40)] + [words(0, 30) + " more", words(1, 30)]
    found = ngram_join.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["id"]: r["component"] for r in found.collect()} == {k: k for k in range(40)} | {40: 0, 41: 1}
    (columns, rows), (others, few) = stored["join-signed"][0], stored["join-others"][0]
    assert rows == 42 and "p0" in columns and not columns & {"p1", "p2"} and {"p1", "p2"} <= others and few <= 4


def test_bitmap_holds_all_its_members(spark):
    ids = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    bloom = ngram_join.bloom_of(ids, "k")
    assert ngram_join.passing(ids, "k", bloom).count() == 5000 and ngram_join.passing(ids.select((-F.col("k") - 1).alias("k")), "k", bloom).count() < 50


def test_workers_drop_what_another_operator_kept(spark):
    """The encoder noted its memo in a copy of the table of kept things, so no worker ever dropped it."""

    def held(batches):
        for _ in batches:
            pass
        words = sum(len(v.marked) for v in sentencepiece_bpe._LOADED.values())
        yield pa.RecordBatch.from_pydict({"words": [words], "bits": [len(ngram_join._BITS)]})

    def after(df, wrapped):
        df.write.format("noop").mode("overwrite").save()
        # As many tasks that every idle worker gets one.
        rows = spark.range(640).repartition(64).mapInArrow(wrapped, "words long, bits long").collect()
        return sum(r["words"] for r in rows), sum(r["bits"] for r in rows)

    encoded = sentencepiece_bpe.encode_documents(spark.range(64).selectExpr("concat('word', id) AS text").repartition(8), piece_model())
    ids = spark.range(64).selectExpr("id AS k").repartition(8)
    probed = ngram_join.passing(ids, "k", ngram_join.bloom_of(ids, "k"))
    assert after(encoded, held)[0] > 0 and after(probed, held)[1] > 0  # kept from task to task
    assert after(encoded, lambda b: give_back(held(b))) == (0, 0)
    assert after(probed, lambda b: give_back(held(b))) == (0, 0)


def test_quality_votes_take_little_memory():
    """256 documents a block took 33 MB in every worker."""
    rng = np.random.default_rng(1)
    vectors, labels = rng.standard_normal((4000, 24)), rng.integers(0, 2, 4000).astype(float)
    model = quality_neighbours.NeighbourModel(rng.standard_normal((quality_neighbours.TERMS, 24)), vectors / np.linalg.norm(vectors, axis=1, keepdims=True), labels, 0.5, 15)
    terms = rng.random((256, quality_neighbours.TERMS)).astype(np.float32)
    tracemalloc.start()
    found = model.votes(terms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    assert np.array_equal(found, model.votes(terms, block=256))
