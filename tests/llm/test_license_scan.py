"""Operator 11 against brute force over words."""

import random
import re

import pytest

from sightline.llm import license_scan as L
from sightline.llm import queries

SCHEMA = "doc_id long, text string, labels string, score int, key string"


def words_of(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(text, templates=L.TEMPLATES, phrases=L.PHRASES, k=L.K, cover=L.COVER):
    w = words_of(text)
    places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, best = {x for _, x in places}, 0.5 if places else 0.0
    base = sorted(labels)
    for label, template in templates:
        t = words_of(template)
        diagonals = sorted({i - j for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]})
        groups = []
        for d in diagonals:
            if groups and d - groups[-1][-1] <= L.DRIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            held = {j + x for d in g for j in range(len(t) - k + 1) if j + d >= 0 and w[j + d : j + d + k] == t[j : j + k] for x in range(k)}
            if len(held) / len(t) >= cover:
                labels.add(label)
                best = max(best, len(held) / len(t))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(labels)), best)


def texts():
    rnd = random.Random(4)
    fill = lambda n: " ".join(rnd.choice(["alpha", "beta", "mit", "license", "the", "of", "general", "public", "ä", "4"]) for _ in range(n))
    out = [None, "", "...", "MIT-License", "mit license mit license", "apache\nLICENSE general public license", "under the mit license " * 40, "x " * 500]
    for _, t in L.TEMPLATES:
        w = t.split()
        cut = len(w) // 2
        out += [t, f"{fill(9)} {t.upper()} {fill(5)} {t}", " ".join(w[:cut] + ["odd", "words"] + w[cut:]), " ".join(w[: cut + 1]), " ".join(w[: max(4, int(len(w) * 0.8))]), " ".join(w[::-1])]
        out.append(" ".join(x if rnd.random() < 0.9 else "other" for x in w))
    return out + [fill(300) for _ in range(5)]


@pytest.mark.parametrize("shared", [True, False])
def test_scan_equals_brute_force(spark, tmp_path, monkeypatch, shared):
    monkeypatch.setattr(L, "ROW_GRAMS", 16)
    if not shared:
        monkeypatch.setattr(L, "MAX_GRAMS", 0)
        monkeypatch.setattr(L, "MAX_SPAN_BYTES", 0)
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts())] * 2
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_license_scan(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    want = {i: brute(t) for i, t, *_ in rows}
    assert any("bsd" in x[5] for x in want.values()) and any(0 < x[6] < 1 for x in want.values())
    for r in found:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id]) if r.first_word is not None else tuple(r)[1:] == want[r.doc_id]


def test_spans_and_columns_of_the_input(spark):
    text = "some words " + L.TEMPLATES[8][1] + " end"
    df = spark.createDataFrame([(1, text, "old", 1, "kept")], SCHEMA)
    row = L.scan_documents(df).first()
    assert row.key == "kept" and row.labels == "bsd" and [(s.template, s.start, s.end, s.cover) for s in row.spans] == [(8, 2, 2 + len(words_of(L.TEMPLATES[8][1])), 1.0)]


def test_empty_table_and_short_templates(spark):
    assert L.scan_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        L.scan_documents(spark.createDataFrame([], SCHEMA), templates=(("x", "too short"),))
