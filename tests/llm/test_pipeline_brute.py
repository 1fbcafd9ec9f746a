"""The pipeline on a small corpus with planted cases against a plain version of what its stages decide."""

import collections
import random
import re

import numpy as np
import public_tokenizers
from test_neardup import brute

import corpus_pipeline
from stratalog.llm.common import shared_dir

WORDS = {
    "en": "the of and to in stone river over walking near green slowly house with from garden winter light before morning".split(),
    "de": "der die und das ist über stein fluss gehen nahe grün langsam haus mit von garten winter licht bevor morgen".split(),
}
LETTERS = re.compile(r"[^\W\d_]")


def corpus(rng):
    """Documents with what becomes of them, benchmark items."""
    prose = lambda lang, n=60: " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(10**4)) * (rng.random() < 0.3) for _ in range(n)).capitalize() + "."
    docs, fate = [], {}

    def put(text, said):
        docs.append((len(docs), text))
        fate[len(docs) - 1] = said

    for k in range(120):
        put(prose(rng.choice(["en", "de"]), rng.randint(40, 120)), "clean")
    for k in range(60):
        put(" ".join(rng.choice(["BUY!!!", "$$$", "###", "WIN&&&", "NOW***"]) for _ in range(50)), "junk")
    for k in range(0, 20, 4):
        put(docs[k][1], "copy")
        words = docs[k + 1][1].split()
        words[len(words) // 2] = "elsewhere"
        put(" ".join(words), "copy")
    items = [prose("en", 12) for _ in range(4)]
    for item in items[:3]:
        put(prose("en", 40) + " " + item.upper() + " " + prose("en", 30), "leak")
    put(docs[30][1].replace(" ", "  "), "copy")
    return docs, fate, [(f"i{k}", t) for k, t in enumerate(items)]


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return words, {tuple(words[i : i + 8]) for i in range(max(1, len(words) - 7))} if words else set()


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    docs, fate, items = corpus(rng)
    lang = lambda t: "de" if len(set(t.lower().split()) & set(WORDS["de"])) > len(set(t.lower().split()) & set(WORDS["en"])) else "en"
    spark.createDataFrame([(i, t, lang(t), "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(fate[i] != "junk"), 0) for i, _ in docs if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(i, t) for i, t in docs if fate[i] != "junk" and LETTERS.search(t)]
    said, _, _ = brute(left, 5)
    left = [row for row, (_, _, kept) in zip(left, said) if kept]
    leaks = set().union(*(windows(t)[1] for _, t in items))
    left = [(i, t) for i, t in left if not leaks & windows(t)[1]]
    assert {p["doc_id"] for p in pieces} == {i for i, _ in left}
    assert {i for i, _ in left} == {i for i, f in fate.items() if f == "clean"}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        mine[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for i, t in left:
        got = b"".join(p["ids"] for p in sorted(mine[i], key=lambda p: p["start"]))
        assert got == np.asarray([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0, *(p["length"] for p in s)])[:-1].tolist() and sum(p["length"] for p in s) <= 4096


def test_stages_with_null_ids_and_empty_tables(spark, tmp_path):
    rng = random.Random(9)
    docs, _, items = corpus(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", 1) for i, t in docs[:40]] + [(None, docs[41][1], "en", "s", 1), (None, None, None, None, None), (5, docs[42][1], "en", "s", 1), (50, "", "en", "s", 0)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, table in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        now = table
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, now, str(tmp_path))
            path = f"{shared_dir(spark)}/{name}-{stage}"
            out.write.parquet(path)
            now = spark.read.schema(out.schema).parquet(path)
            if stage != "packing":
                assert now.columns == [c.split()[0] for c in schema.split(", ")]
        assert (now.count() == 0) == (name == "none")
        if name == "some":
            ids = [r["doc_id"] for r in now.collect()]
            # both texts of the repeated id stay, as does the one without an id
            assert ids.count(5) == 2 and None in ids
