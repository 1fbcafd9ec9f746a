"""Edge cases of URL rules, quality and language: odd hosts, empty tables, labels of one class, a known share of positives."""

import random

import numpy as np
import pytest

from stratalog.llm import language, quality, url_rules
from stratalog.llm.url_rules import RULES, Rule, judged


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("limit", [url_rules.INDEX_BYTES, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "INDEX_BYTES", limit)
    rng = random.Random(2)
    urls = [None, "", "nothing", "http://a\nb.org/x", "http://\n.com/fr/\nx", "http://ORG/", "x://org", "x://org?/", "http://b.example.org/es/1", "http://example.org/en/1?q", "http://example.org/en/2#/", "http://xexample.org/es/", "http://É.com/de/", "http://com/fr/x\r\ny"]
    urls += ["http://" + rng.choice(["", "www.", "a.b."]) + rng.choice(["example.org", "com", "x.com", "org", "comx"]) + rng.choice(["", "/", "/es/x", "/en/1", "/en/12", "/fr/", "/de/q?x", "/de"]) for _ in range(80)]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    for rules in (RULES, [*RULES, Rule("", "/", "block"), Rule("x.com", "/de", "allow")], RULES[:1], []):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(pages, rules).collect()}
        rules = [r for r in rules if r.host] + [Rule("", r.path, r.verdict) for r in rules if not r.host]
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert judged(pages.where("false"), RULES).collect() == []


def samples(share, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    good, bad = (lambda k: rng.normal(1.5, 1, (k, quality.N_FEATURES))), (lambda k: rng.normal(-1.5, 1, (k, quality.N_FEATURES)))
    m = int(n * share)
    return good(n), np.vstack([good(m), bad(n - m)])[rng.permutation(n)]


@pytest.mark.parametrize("share", [0.15, 0.5, 0.85])
def test_prior_is_estimated_from_positives_and_unlabelled(share):
    assert abs(quality.estimated_prior(*samples(share)) - share) < 0.06


def text_of(rng, good):
    words = [rng.choice("stone river over walking near green slowly house".split()) for _ in range(40)]
    return " ".join(words).capitalize() + "." if good else " ".join(w + "#$%" * 2 for w in words[:5] * 8)


def table(spark, tmp_path, labels):
    rng = random.Random(3)
    docs = [(i, text_of(rng, i % 3 != 0), "en", "s", 1) for i in range(240)] + [(240, None, None, None, None), (241, "", "en", "s", 0), (None, text_of(rng, True), "en", "s", 1), (7, text_of(rng, True), "en", "s", 1), (242, text_of(rng, True) * 3000, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_quality_query_tells_held_out_rows_apart(spark, tmp_path):
    docs = table(spark, tmp_path, [(i, int(i % 3 != 0), 0) for i in range(0, 240, 2)])
    got = quality.op8_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] is not None for r in got)
    judged_ = [(r["predicted"], int(r["doc_id"] % 3 != 0)) for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] != 7 and r["held_out"]]
    assert len(judged_) > 20 and sum(a == b for a, b in judged_) / len(judged_) > 0.95
    kept = quality.quality_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sum(r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 3 != 0 for r in kept.collect()) >= 155


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)], 0.0)])
def test_quality_without_positives(spark, tmp_path, labels, score):
    table(spark, tmp_path, labels)
    assert {r["score"] for r in quality.op8_quality(spark, str(tmp_path)).collect()} == {score}
    assert quality.quality_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 245


def test_quality_with_positives_alone(spark, tmp_path):
    table(spark, tmp_path, [(i, 1, 0) for i in range(240) if i % 3])
    got = quality.op8_quality(spark, str(tmp_path)).collect()
    rows = [(r["score"], r["doc_id"] % 3 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] != 7]
    assert np.mean([s for s, good in rows if good]) > np.mean([s for s, good in rows if not good]) + 0.3


def test_language_query(spark, tmp_path):
    rng = random.Random(5)
    words = {"en": "the and house stone over walking with from".split(), "de": "der und das haus über stein mit nicht".split(), "xx": "zuk valo mirte quon drasi pelku".split()}
    docs = [(i, " ".join(rng.choice(words[l]) for _ in range(rng.choice([20, 60]))), l) for i, l in enumerate(rng.choice(sorted(words)) for _ in range(150))]
    docs += [(200, None, "en"), (201, "", "de"), (202, "12 !!", "en"), (None, "the house and the stone", "en"), (3, "das haus und der stein", "de"), (3, "das haus und der stein", "de"), (204, "the stone and house " * 40000, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op5_language(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
    truth = {i: l for i, _, l in docs[:150]}
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (200, 201, 202, 204)} == {200: "und", 201: "und", 202: "und", 204: "en"}
    empty = language.identified(spark.createDataFrame([], "doc_id long, text string"), language.Dictionaries(), keep=[])
    assert empty.collect() == []
