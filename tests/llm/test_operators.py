"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from stratalog.llm import decontaminate, hnsw, html_text, language, neardup, packing, quality, sstable, tokens, url_rules
from stratalog.llm.common import shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   ", "Hello, World! <|endoftext|>x don't", "é" * 30 + " İΣ ﬁ 日本 🙂\x1c\x85a\xa0b", "the cat sat on the mat " * 40, "the cat sat on the mat " * 40, "a", "word " * 6000]
SCHEMA = "doc_id long, text string, score int, k0 string, doc long, gone string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(VOCABULARY)
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_prefix_counts(docs, library):
    for r in tokens.prefix_token_counts(docs, VOCABULARY, keep=["doc_id", "text"]).collect():
        text = r["text"] or ""
        assert r["n_tokens"] == len(library(text))
        for k in [*range(0, min(len(text), 60) + 1), len(text)]:
            assert tokens.tokens_at(r["prefix_steps"], r["step_bytes"], k) == len(library(text[:k])), (text[:k], k)
        if text:
            k = tokens.longest_prefix(r["prefix_steps"], r["step_bytes"], 3)
            assert len(library(text[:k])) <= 3


def test_packing(docs, library):
    limits = packing.Limits(tokens=256, segments=3, loss=200)
    pieces = packing.packed_documents(docs, VOCABULARY, 2, limits).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for r in docs.collect():
        mine = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in mine) == np.asarray([*library(r["text"]), 2], "<u4").tobytes()
    for group in by_sequence.values():
        group.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in group] == list(np.cumsum([0, *(p["length"] for p in group)]))[:-1]
        assert sum(p["length"] for p in group) <= 256 and len(group) <= 3 and sum(p["loss_tokens"] for p in group) <= 200
    assert packing.packed_documents(docs.where("false"), VOCABULARY, 2).count() == 0


def test_sstable(spark, docs, library):
    shards = sstable.write_shards(docs, shared_dir(spark), VOCABULARY, 1, 3)
    rows = sorted(sstable.read_shards(spark, shards, True).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(rows) == docs.count()
    texts, at = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for r in rows:
        want = np.asarray([*library(texts[r["doc_id"]]), 1], "<u4").tobytes()
        assert r["ids"] == want and r["start"] == at and r["ids_crc32"] == zlib.crc32(want)
        at += r["n_tokens"]
    found = [ids for s in shards for ids in sstable.ShardReader(s["path"]).lookup(sstable.key_of(3))]
    assert len(found) == 1 and not any(sstable.ShardReader(s["path"]).lookup(sstable.key_of(10**9)) for s in shards)
    assert sstable.write_shards(docs.where("false"), shared_dir(spark), VOCABULARY, 1, 2) == []


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies on this site, please accept them all now.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph of the text<br>goes on &eacute;.<p>Second, with <b>bold</b> words and some length to it.<div class="ad">Buy this great product now and save a lot of money</div><p>End.</p>
<section class="comments"><p>A reader says something rather long about all of this here.</p></section></article><aside>Related things</aside><footer>Copyright of us</footer></body>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph of the text goes on é.\n\nSecond, with bold words and some length to it.\n\nEnd."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>plain words only")], "page_id long, url string, html string")
    assert [r["text"] != "" for r in html_text.extracted_pages(pages).collect()] == [True, False, False, True]


def test_url_rules(spark, monkeypatch):
    urls = ["http://EXAMPLE.org/en/1x?q", "https://a.example.org/es/", "http://x.com/de/1", "http://x.com/fr/", "http://b.org", "http://b.org/", "no scheme", None, "http://com/de/#f", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    wanted = ["example.org/en/1", "example.org/es/", "com/de/", "com/fr/", None, "org/", None, None, "com/de/", "org/"]
    for limit in (url_rules.INDEX_BYTES, 0):
        monkeypatch.setattr(url_rules, "INDEX_BYTES", limit)
        got = {r["page_id"]: r for r in url_rules.judged(pages, url_rules.RULES).collect()}
        assert [got[i]["rule"] for i in range(len(urls))] == wanted
        assert [got[i]["verdict"] for i in range(3)] == ["block"] * 3 and got[0]["host"] == "example.org" and got[5]["path"] == "/"


def test_language(spark):
    rows = [(i, ("der hund und die katze sind im haus " if i % 2 else "the dog and the cat are in the house ") * 4, "de" if i % 2 else "en") for i in range(40)]
    model = language.learned_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    judged = language.identified(spark.createDataFrame([(1, "the cat is in the house", "q"), (2, "die katze ist im haus", "q"), (3, None, "q"), (4, "12 34 !!", "q")], "doc_id long, text string, lang_pred string"), model, keep=[])
    assert [r["lang_pred"] for r in judged.collect()] == ["en", "de", "und", "und"]
    assert language.learned_dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_quality(spark):
    good, bad = "A plain sentence of some words, and then number {} follows it.", "BUY!! NOW!! {} $$$ ### %%% BUY!! NOW!!"
    docs = spark.createDataFrame([(i, (bad if i % 5 == 0 else good).format(i)) for i in range(200)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 200, 3)], "doc_id long, quality int")
    model = quality.learned_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert min(got[i] for i in range(200) if i % 5) > max(got[i] for i in range(0, 200, 5)) and 0 <= got[None] <= 1
    assert quality.learned_quality(docs, labels.where("false")) is None


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "of the of the of the of the of the")], "item_id long, text string")
    texts = [item, "x " + item.upper() + " y one two three", "a Short-item here, short item", None, "", "of the " * 30, "nothing", item, "ONE two three four five six seven EIGHT", "É ne two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, item)], "doc_id long, text string")
    windows = {}
    for i, t in ((1, item), (2, "short item"), (4, "of the of the of the of the of the")):
        w = _words(t)
        for k in range(max(1, len(w) - 7)):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    index = decontaminate.build_index(docs, items, shared_dir(spark))
    got = {(r["doc"], r["th"]): r for r in decontaminate.contamination(index).collect()}
    keys = {(r["doc"], r["th"]): r["text"] for r in docs.selectExpr("coalesce(doc_id, -9223372036854775808) doc", "xxhash64(text) th", "text").collect()}
    assert got.keys() == keys.keys()
    for k, text in keys.items():
        w, hit, found = _words(text), set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.proximity_matches(index, 12).where("doc = 0").count() >= 1
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.5, 2)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (None, rows[1][1]), rows[0]]
    got = collections.defaultdict(list)
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shared_dir(spark), k=10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    kept = {i: np.array(v) for i, v in rows[:460]}
    assert set(got) == {i for i in kept if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        best = sorted((-(v * kept[q]).sum(), i) for i, v in kept.items() if i != q)[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs((kept[i] * kept[q]).sum() - s) < 1e-12 for _, i, s in found)
        hit += len({i for _, i in best} & {i for _, i, _ in found})
    assert hit >= 0.9 * 10 * len(got)


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    texts = [None, "", "  ", "a b", "A  b", "a b c"]
    for _ in range(25):  # a chain that drifts
        base = list(base)
        base[int(rng.integers(0, 120))] = f"n{int(rng.integers(0, 10**6))}"
        texts.append(" ".join(base))
    texts += [" ".join(f"v{i}" for i in rng.integers(0, 10**6, 60)) for _ in range(20)] + [texts[8]] * 10
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, rep string")
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[j] > label[i]:
                    label[j], moved = label[i], True
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, neardup.Shingling(words=4)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == label[i]) for i, r in got.items())
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kept = {p["doc_id"] for p in pieces}
    assert 0 < len(kept) < len(docs) and all(sum(p["length"] for p in pieces if p["doc_id"] == i) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == i) for i in list(kept)[:20])
    sets = {i: set(zip(*[docs[i]["text"].lower().split()[k:] for k in range(5)])) for i in kept}
    ids = sorted(kept)
    assert not any(len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] and sets[b])
