"""Operators on single texts (1, 3, 4, 5, 8, 9, 10), against libraries, brute force and held-out rows."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sightline.llm import decontaminate, host_text, language_spans, lattice_lm, quality_neighbours, sentencepiece_bpe, url_cascade

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\rreturn\n\nlines", "▁mark ▁", "é漢😀\x00", "x" * 5000, "the the the", "the the the"]
SCHEMA = "doc_id long, text string, ids string, score string, lang string"


def frame(spark, texts, lang="en"):
    """Rows of texts with nulls in other columns and columns that clash with the operators' own."""
    rows = [(i if i != 2 else None, t, "clash", None, lang) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# 10


def test_agenda_equals_library():
    vocab = sentencepiece_bpe.MergeVocabulary(open(MODEL, "rb").read())
    rnd = random.Random(3)
    parts = [*"abct he▁ \n\t012éß漢😀.,()<>/", "  ", "tion", "the ", "\n\n", " \n", "</s>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(3000)] + [x or "" for x in ODD] + ["ab" * 20000]
    ids = vocab.encode_all(texts)
    assert ids == vocab.library.encode(texts)
    assert [vocab.decode(x) for x in ids] == vocab.library.decode(ids)


def test_flat_and_heap_agendas_agree():
    vocab = sentencepiece_bpe.MergeVocabulary(open(MODEL, "rb").read())
    rnd = random.Random(5)
    for _ in range(500):
        symbols = [rnd.choice("▁theinagro") for _ in range(rnd.randrange(2, 30))]
        assert vocab._flat(list(symbols)) == vocab._heap(list(symbols))


def test_encode_documents(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = sentencepiece_bpe.encode_documents(frame(spark, ODD), MODEL)
    rows = df.collect()
    assert len(rows) == len(ODD) and df.columns.count("ids") == 1
    assert Counter(tuple(r["ids"]) for r in rows) == Counter(tuple(lib.encode(t or "", add_eos=True)) for t in ODD)
    assert all(r["decoded"] == lib.decode(r["ids"]) for r in rows)
    back = sentencepiece_bpe.decode_ids(df.select("doc_id", "ids"), MODEL).collect()
    assert {(r["doc_id"], r["decoded"]) for r in back} == {(r["doc_id"], r["decoded"]) for r in rows}
    assert sentencepiece_bpe.encode_documents(frame(spark, []), MODEL).count() == 0


# 8


def brute_hits(text, items, n):
    words = decontaminate.normalised_words((text or "").encode())
    hit, found = [False] * len(words), set()
    for item, t in items:
        own = decontaminate.normalised_words((t or "").encode())
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
                found.add(item)
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("max_words", [1_000_000, 12])
def test_decontamination_equals_brute_force(spark, max_words):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["a", "B", "c1", "é", "d-d", "e"])
    items = [(str(i), " ".join(word() for _ in range(rnd.randrange(9)))) for i in range(12)] + [("x", None), ("0", "a B c1 a B c1")]
    texts = [" ".join(word() for _ in range(rnd.randrange(60))) for _ in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan_documents(frame(spark, texts), bench, 4, max_words=max_words).collect()}
    for i, t in enumerate(texts):
        r = got[i if i != 2 else None]
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(t, items, 4)
        assert r["contaminated"] == (r["n_hit"] > 0) and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]


def test_windows_take_bounded_memory():
    import pickle

    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    items = [(str(i), " ".join(rnd.choice(words) for _ in range(100)).encode()) for i in range(2000)]
    assert len(pickle.dumps(decontaminate.WindowSet(items, 10))) < 40 * 200_000


def test_decontaminate_documents_and_spans(spark):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = frame(spark, [f"Before, {passage.upper()}, after.", "clean text", None, passage[:-4]])
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {1, None, 3}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut == {0: "Before, , after.", 1: "clean text", None: None, 3: passage[:-4]}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 4


# 1


def test_lattice_sums_over_all_segmentations():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "é"]
    lattice = lattice_lm.PieceLattice.start(pieces, 2)
    p = dict(zip(pieces, np.exp(lattice.log_p[1]), strict=False))

    def brute(s):
        return 1.0 if not s else sum(p[s[:k]] * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    words = ["a", "ab", "abab", "baab", "é", "ab", "bbbb"]
    got = lattice.word_log_p(words)[1]
    assert np.allclose(got, [math.log(brute("▁" + w)) for w in words])
    one = lattice.word_log_p(["漢"])[0][0]
    start, bytes_ = lattice.log_p[0][0], [lattice.log_p[0][len(pieces) + b] for b in "漢".encode()]
    assert math.isclose(one, start + sum(bytes_))


def test_expected_counts_are_posteriors():
    lattice = lattice_lm.PieceLattice.start(["▁", "▁a", "a", "aa", "▁aa"])
    total = lattice.expected(["aa"], np.array([3.0]))
    p = np.exp(lattice.log_p[0])
    ways = {(0, 2, 2): p[0] * p[2] ** 2, (0, 3): p[0] * p[3], (1, 2): p[1] * p[2], (4,): p[4]}
    z = sum(ways.values())
    want = np.zeros(len(p))
    for path, w in ways.items():
        for k in path:
            want[k] += 3 * w / z
    assert np.allclose(total, want)


@pytest.mark.parametrize("head_words", [0, 50, 100_000])
def test_language_model(spark, head_words):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang").unionByName(frame(spark, ODD).select("doc_id", "text", "lang"))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    got = lattice_lm.score_documents(docs, lattice_lm.pieces_of(MODEL), train, F.col("lang"), head_words=head_words).toPandas()
    rows = docs.collect()
    is_train = lambda r: zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 != 0
    counts = Counter(w for r in rows if is_train(r) for w in [*lattice_lm.tokens((r["text"] or "").encode()), None])
    n, v = sum(counts.values()), len(counts)
    base = Counter()
    for r in rows:
        words = [*lattice_lm.tokens((r["text"] or "").encode()), None]
        base[len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 4)] += 1
    assert len(got) == len(rows) and (got["train_tokens"] == n).all()
    assert Counter(zip(got["n_tokens"], got["n_known"], got["base_score"].round(4), strict=True)) == base
    assert np.isfinite(got["score"]).all() and (got["score"] < 0).all()
    held = got[~got["is_train"]]
    assert held["score"].sum() > held["base_score"].sum() - 0.6 * held["n_tokens"].sum()


def brute_language_model(rows, pieces):
    """Score of each (text, group, is_train) by the definition, the vocabulary's scores as they are; no character lacks a piece."""
    weights = {p: math.exp(x) for p, x in pieces.items()}
    z = sum(weights.values())
    # A thousandth of the mass goes to the 257 bytes and the end.
    p = {k: x / z / 1.001 for k, x in weights.items()}

    def spelt(s):
        return 1.0 if not s else sum(p[s[:k]] * spelt(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    groups = sorted({g for _, g, t in rows if t})
    ends = {g: sum(1 for _, x, t in rows if t and x == g) for g in groups}
    likely = {}
    for g in groups:
        counts = Counter(w for text, x, t in rows if t and x == g for w in text.lower().split())
        of = Counter(min(c, 5) for c in counts.values())
        exact = Counter(counts.values())
        y = exact[1] / (exact[1] + 2 * exact[2]) if exact[1] else 0.5
        cut = {}
        for k in (1, 2, 3):
            d = k - (k + 1) * y * exact[k + 1] / exact[k] if exact[k] else 0.5 * k
            cut[k] = min(max(d, 0.05 * k), 0.95 * k)
        total = sum(counts.values()) + ends[g]
        free = sum(cut[min(k, 3)] * n for k, n in of.items()) / total
        likely[g] = lambda w, counts=counts, cut=cut, total=total, free=free: ((counts[w] - cut[min(counts[w], 3)] if counts[w] else 0) / total) + free * spelt("▁" + w)
    n = sum(ends.values())
    return [math.log10(sum(ends[g] / n * math.prod(map(likely[g], text.lower().split())) * ends[g] / (sum(len(x.split()) for x, h, t in rows if t and h == g) + ends[g]) for g in groups)) for text, _, _ in rows]


@pytest.mark.parametrize("head_words", [0, 3, 100])
def test_score_equals_brute_force(spark, head_words):
    rnd = random.Random(4)
    pieces = {"▁": -1.0, "▁a": -1.5, "▁ab": -2.5, "a": -2.0, "b": -1.2, "ab": -3.0, "ba": -2.2}
    word = lambda: "".join(rnd.choice("aAbB") for _ in range(rnd.randrange(1, 4)))
    rows = [(" ".join(word() for _ in range(rnd.randrange(12))), rnd.choice("xyy"), rnd.random() < 0.7) for _ in range(40)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, g string, t boolean")
    got = lattice_lm.score_documents(docs, pieces, F.col("t"), F.col("g"), iterations=0, head_words=head_words).collect()
    want = brute_language_model(rows, pieces)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_of_the_vocabulary():
    pieces = lattice_lm.pieces_of(MODEL)
    log_p = lattice_lm.PieceLattice.start(pieces).log_p[0]
    assert math.isclose(np.exp(log_p).sum(), 1) and np.allclose(np.diff(log_p[: len(pieces)]), np.diff(list(pieces.values())))
    assert pieces["▁t"] > pieces["in"] > pieces["er"]


def test_language_model_of_nothing(spark):
    empty = lattice_lm.score_documents(frame(spark, []), ["▁", "a"], F.lit(True))
    assert empty.count() == 0
    alone = lattice_lm.score_documents(frame(spark, ["a"]), ["▁", "a"], F.lit(None).cast("boolean")).collect()
    assert alone[0]["train_tokens"] == 0 and math.isfinite(alone[0]["score"])


# 3


def test_cascade_is_exact_on_its_universe():
    rnd = random.Random(2)
    universe = {f"k{i}" for i in range(20000)}
    listed = set(rnd.sample(sorted(universe), 300))
    cascade = url_cascade.Cascade.build(listed, len(universe), lambda f: [k for k in universe - listed if k in f])
    assert len(cascade.filters) > 1 and all((k in cascade) == (k in listed) for k in universe)
    assert not url_cascade.Cascade.build(set(), 10, lambda f: []).filters


def test_urls(spark):
    rules = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/"))
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/71?q", "https://a.example.com/en/8#x", "http://com/en/", "http://notcom/en/", "http://a.net", "http://a.net/x", "://b.com/en/?/en/7", "http://example.com/EN/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(df, rules).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("example.com", "/en/71", "example.com/en/7", "allow"), 4: ("a.example.com", "/en/8", "com/en/", "block"),
        5: ("com", "/en/", "com/en/", "block"), 6: ("notcom", "/en/", None, "allow"), 7: ("a.net", "", None, "allow"),
        8: ("a.net", "/x", "net/", "block"), 9: ("b.com", "/en/", "com/en/", "block"), 10: ("example.com", "/EN/7", None, "allow"),
    }
    assert url_cascade.judge_urls(df.limit(0), rules).count() == 0


# 4


def test_blocks():
    page = "<html><head><title>T</title></head><body class=home><header>Site</header><nav>menu</nav><div id=cookie-notice>c</div><main><article class=post><h1>Ti&amp;tle</h1><script>'</p>'</script><p>Hello <b>wor</b>ld<br>next<p>a &lt;p&gt; 1 < 2<div class=ad>buy</div><form>f</form></article><aside>s</aside></main><section id=comments><article class=comment>no</article></section><footer>foot"
    blocks, declared = host_text.blocks_of(page)
    assert declared and " ".join(blocks) == "Ti&tle Hello world next a <p> 1 < 2"
    assert host_text.blocks_of("just text") == (["just text"], False)
    assert host_text.blocks_of(None) == ([], False) and host_text.blocks_of("<!-- open") == ([], False)
    assert host_text.blocks_of('<div class="page has-sidebar">kept<div class="left sidebar">gone</div></div>')[0] == ["kept"]
    assert host_text.blocks_of("<p>" * 3000 + "deep")[0] == ["deep"]


def test_scripts_and_open_heads_end():
    for page in (
        "<script>for(i=0;i<n;i++){}</script><article>kept text</article>",
        "<style>a<b</STYLE ><article>kept text</article>",
        "<script>x = '<!--'</script><article>kept text</article>",
        "<html><head><title>T</title><meta charset=utf-8><body><article>kept text</article>",
        "<head><title>T</title><link rel=x><article>kept text</article>",
        "<head><title>T</title><script>a<b</script></head><main>kept text</main>",
        "<head><title>T</title>kept text",
    ):
        assert host_text.blocks_of(page)[0] == ["kept text"], page


def test_no_text_is_lost():
    article = lambda x: " ".join(host_text.blocks_of(f"<article>{x}</article>")[0])
    assert article("<p>Intro.</p><script>if (i<n) y=1;</script><p>Rest after.</p><p>More.</p>") == "Intro. Rest after. More."
    assert article("<p title=x don't>one</p><p>two</p><p>it's three</p>") == "one two it's three"
    assert article("<p>a<b and c</p><p>1 < 2, 3<4 </3 x</p>") == "a<b and c 1 < 2, 3<4 </3 x"
    assert article("<p class=search-results>x</p><p class='navigation-systems'>y</p><h2 class=section-header>z</h2>") == "x y z"
    assert article('<a title="x > y">z</a> <p>x <span class=comment>c</span></p>') == "z x c"
    assert article("<b><div></b>q</div> <table><tr><td>a<td>b<tr><td>c</table>d") == "q a b c d"
    assert article("<p hidden>a</p><p style='Display : none'>b</p><div class='ad-box'>c</div><p>d") == "d"
    assert host_text.blocks_of("<nav>menu<main>kept</main>") == (["kept"], True)
    assert host_text.blocks_of("<p>kept<p class='cut") == (["kept"], False)


@pytest.mark.parametrize("part", ["<a ", "<a x=", '<a x="', '<a x="<a" ', "<p>", "<a><p></p>", "<td><a>", "<!", "</", "<title>", "<div></script ", "<script></script ", "<li><p><b>", "<a ==", "<x/>"])
def test_malformed_pages_take_linear_time(part):
    began = time.process_time()
    host_text.blocks_of(part * (300_000 // len(part)))
    assert time.process_time() - began < 10  # seconds here; minutes to hours if it were quadratic


def test_suffix_array_equals_brute_force():
    rnd = random.Random(8)
    for size in (1, 2, 3, 50, 300):
        for letters in (1, 2, 5):
            stream = [rnd.randrange(letters) for _ in range(size)]
            order, common = host_text.suffix_array(np.array(stream))
            want = sorted(range(size), key=lambda i: stream[i:])
            assert order.tolist() == want
            for k in range(1, size):
                a, b = stream[want[k - 1] :], stream[want[k] :]
                assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_recurring_runs_equal_brute_force():
    rnd = random.Random(4)
    pages = [[rnd.randrange(3) for _ in range(rnd.randrange(30))] for _ in range(40)]
    holders = Counter()
    for p in pages:
        holders.update({tuple(p[i : i + 4]) for i in range(len(p) - 3)})
    for p, got in zip(pages, host_text.run_holders(pages, 4), strict=True):
        assert got.tolist() == [holders[tuple(p[i : i + 4])] for i in range(len(p))]
        hit = np.zeros(len(p), bool)
        for i in range(len(p) - 3):
            if holders[tuple(p[i : i + 4])] > 6:
                hit[i : i + 4] = True
        assert host_text.covered(got > 6, 4).tolist() == hit.tolist()
    assert host_text.run_holders([], 4) == [] and host_text.run_holders([[], [1]], 4)[1].tolist() == [0]


def test_boilerplate_of_a_host_is_cut(spark):
    menu = "<div>Home News Sport Weather Travel Culture Shop Contact About</div>"
    word = lambda i, k: f"w{i * 31 % 97}x{k * i % 89}y{k}"
    pages = [(i, "http://a.com/x", f"{menu}<div>{' '.join(word(i, k) for k in range(20))}</div>") for i in range(30)]
    pages += [(99, None, None), (100, "http://b.org", menu), (100, "http://b.org", menu)]
    got = host_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 33
    for r in got:
        if r["page_id"] < 30:
            assert r["text"] == " ".join(word(r["page_id"], k) for k in range(20))
    assert [r["text"] for r in got if r["page_id"] == 99] == [""]
    assert {r["text"] for r in got if r["page_id"] == 100} == {"Home News Sport Weather Travel Culture Shop Contact About"}


def test_large_hosts_are_counted_whole(spark, monkeypatch):
    words = lambda name, n=10: " ".join(f"{name}{k}" for k in range(n))
    pages, want = [], {}
    for i in range(200):
        # On 21 (more than a tenth) and 20 of 200 pages; in shards of about 16 some would tell otherwise.
        parts = [words(f"own{i}x"), words("often") if i % 9 == 0 and i < 189 else "", words("rare") if i % 10 == 1 else ""]
        want[i] = " ".join(x for x in (parts[0], parts[2]) if x)
        pages.append((i, "http://a.com/x", " ".join(f"<p>{x}</p>" for x in parts)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for shard in (16, 50, 1000):
        monkeypatch.setattr(host_text, "SHARD", shard)
        for copies in (df, df.unionByName(df.where("page_id % 10 = 1")).repartition(5)):
            got = host_text.extract_text(copies).collect()
            assert len(got) == copies.count() and {(r["page_id"], r["text"]) for r in got} == set(want.items())


def test_pages_of_other_columns_and_none(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>x", "t", 7)], "page_id long, url string, html string, text string, __host long")
    assert host_text.extract_text(df, keep=("page_id", "__host")).collect() == [(1, 7, "x")]
    assert host_text.extract_text(df, html="text", keep=("html",)).collect() == [("<p>x", "t")]
    assert host_text.extract_text(df.limit(0)).collect() == []


def test_copied_articles_stay(spark):
    article = " ".join(f"word{k}" for k in range(30))
    pages = [(i, "http://a.com/x", f"<article>{article}</article>") for i in range(9)] + [(20 + i, "http://b.com/x", article) for i in range(6)]
    got = host_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 15 and {r["text"] for r in got} == {article}


# 5


def test_language_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_spans.learn(docs.where(~held))
    got = language_spans.label_spans(docs.where(held), model)
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0
    odd = language_spans.label_spans(frame(spark, ODD), model)
    rows = {r["doc_id"]: r for r in odd.collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == "und" and rows[0]["spans"] == [] and rows[4]["lang_pred"] in model.languages
    none = language_spans.learn(frame(spark, ["a"], None))
    assert {r["lang_pred"] for r in language_spans.label_spans(frame(spark, ["a", None]), none).collect()} == {"und"}
    mixed = "the and that with this from are was " * 3 + "les dans pour avec une est que des " * 3
    spans = language_spans.label_spans(frame(spark, [mixed]), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and abs(spans[0]["end"] - 24) <= 2


def test_words_and_scripts():
    name = lambda t: [language_spans.SCRIPTS[i] for i in language_spans.scripts_of(language_spans.words_of(t))]
    assert [w.decode() for w in language_spans.words_of("«привет», слово” текст… hello—мир ¿qué? l’eau 12")] == ["привет", "слово", "текст", "hello", "мир", "qué", "l", "eau"]
    assert name("«привет» слово” текст… hello—мир naïve") == ["cyrillic", "cyrillic", "cyrillic", "latin", "cyrillic", "latin"]
    assert name("abcж жабаa") == ["latin", "cyrillic"]
    assert [w.decode() for w in language_spans.words_of("abc世界です")] == ["abc", "世", "界", "で", "す"] and name("世で") == ["han", "kana"]
    assert language_spans.words_of("… «» 12 😀") == []
    assert language_spans.words_of("हिन्दी भाषा") == ["हिन्दी".encode(), "भाषा".encode()]


def test_letters_count_by_character(spark):
    rows = [("the and that with from are was", "en"), ("это как так его только было", "ru"), ("的是不了人在有我他这", "zh")] * 5
    model = language_spans.learn(spark.createDataFrame(rows, "text string, lang string"))
    mixed = "the and that with from " + "«это» как… 的是不了人在有我他这的是不了"
    got = language_spans.label_spans(frame(spark, [mixed]), model, penalty=3.0).first()
    assert [(s["start"], s["end"], s["lang"]) for s in got["spans"]] == [(0, 5, "en"), (5, 7, "ru"), (7, 21, "zh")]
    assert got["lang_pred"] == "en" and math.isclose(got["score"], 18 / (18 + 6 + 14))
    assert language_spans.label_spans(frame(spark, []), model).collect() == []


def test_viterbi_equals_brute_force():
    from itertools import product

    rnd = np.random.default_rng(1)
    scores, sizes = rnd.normal(size=(6, 3)).astype(np.float32), np.array([3, 0, 5, 1])
    ids = rnd.integers(0, 6, 9)
    got = language_spans.viterbi(scores, ids, sizes, 0.7)
    at = 0
    for n in sizes.tolist():
        own = ids[at : at + n]
        value = lambda path, own=own: sum(scores[i, s] for i, s in zip(own, path, strict=True)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            assert math.isclose(value(got[at : at + n].tolist()), max(value(x) for x in product(range(3), repeat=n)), rel_tol=1e-5)
        at += n


# 9


def test_ties_and_blocks_do_not_matter():
    rnd = np.random.default_rng(3)
    vectors = quality_neighbours._unit(rnd.normal(size=(3, 4))).repeat(10, 0)
    model = quality_neighbours.NeighbourModel(np.eye(4), vectors, rnd.integers(0, 2, 30).astype(float), 0.5, 5)
    asked = rnd.normal(size=(40, 4))
    got = model.votes(asked)
    for block in (1, 7, 40):
        assert (model.votes(asked, block) == got).all()
    for row, score in zip(asked, got, strict=True):
        near = np.round(quality_neighbours._unit(row[None]) @ vectors.T, 9)[0]
        best = sorted(range(30), key=lambda i: (-near[i], i))[:5]
        weights = np.maximum(near[best], 0)
        assert math.isclose(score, (weights * model.labels[best]).sum() / weights.sum() if weights.sum() else 0.5, abs_tol=1e-6)


def test_leading_vectors_equal_those_of_svd():
    rows = np.random.default_rng(2).normal(size=(60, 30)).astype(np.float32) * np.geomspace(8, 0.5, 30).astype(np.float32)
    _, _, want = np.linalg.svd(rows, full_matrices=False)
    got = quality_neighbours.leading(lambda: iter([rows[:25], rows[25:]]), 30, 4, rounds=30)
    assert np.allclose(np.abs(np.sum(got * want[:4].T, 0)), 1, atol=1e-3)
    assert not quality_neighbours.leading(lambda: iter([]), 30, 4).any() and not quality_neighbours.leading(lambda: iter([rows * 0]), 30, 4).any()


def test_quality_of_no_documents(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    model = quality_neighbours.fit(frame(spark, ["good text", "b@d"]), labels)
    assert quality_neighbours.score_documents(frame(spark, []), model).collect() == []
    assert len(quality_neighbours.score_documents(frame(spark, ODD), model).where("score between 0 and 1").collect()) == len(ODD)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = quality_neighbours.fit(docs, labels.where(bucket != 2))
    got = quality_neighbours.score_documents(docs, model).join(labels, "doc_id").where(bucket == 2)
    right = got.where((F.col("score") >= 0.7).cast("int") == F.col("quality")).count()
    assert right >= 0.97 * got.count()
    odd = quality_neighbours.score_documents(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert next(r["score"] for r in odd if r["doc_id"] == 0) == model.prior
    blank = quality_neighbours.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_neighbours.score_documents(frame(spark, ["a", None]), blank).collect()} == {0.5}


def test_votes_equal_brute_force():
    rnd = np.random.default_rng(0)
    terms = np.abs(rnd.normal(size=(40, quality_neighbours.TERMS))).astype(np.float32)
    projection = rnd.normal(size=(quality_neighbours.TERMS, 4)).astype(np.float32)
    vectors = quality_neighbours._unit(terms[:30] @ projection)
    labels = rnd.integers(0, 2, 30).astype(float)
    got = quality_neighbours.NeighbourModel(projection, vectors, labels, 0.5, 7).votes(terms[30:], block=3)
    for row, score in zip(quality_neighbours._unit(terms[30:] @ projection), got, strict=True):
        cosines = vectors @ row
        at = np.argsort(-cosines)[:7]
        w = np.maximum(cosines[at], 0)
        assert math.isclose(score, (w * labels[at]).sum() / w.sum() if w.sum() > 1e-9 else 0.5, rel_tol=1e-4, abs_tol=1e-6)
