"""Near-duplicates against brute force: repeated and null ids, drifting copies, sizes near the bounds, empty tables."""

import random

import pytest

from stratalog.llm import neardup
from stratalog.llm.neardup import Shingling, near_duplicates, neardup_stage, shingle_set

SCHEMA = "doc_id long, text string, label string, th string, rep int"


def brute(rows, width):
    """Per row: n_shingles, component_id, whether it is kept; and groups of row numbers."""
    sets = [frozenset(shingle_set(t, width).tolist()) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            out[i] = (len(sets[i]), least, least is None or rows[i][0] == least)
    return [out[i] for i in range(len(rows))], groups, sets


def texts(seed, n=60):
    """Drifting copies of a few texts: words changed, left out or added, tails cut."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    made = []
    for _ in range(3):
        now = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(n // 3):
            now = now if rng.random() < 0.6 else rng.choice(made).split() if made else now
            now = list(now)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(now))
                now[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2) or [word()]
            if rng.random() < 0.15 and len(now) > 12:
                now = now[: -len(now) // 6]
            made.append(" ".join(now))
    return made


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hubs", [neardup.HUBS, 1])
def test_against_brute_force(spark, monkeypatch, seed, hubs):
    if hubs == 1 and seed > 1:
        pytest.skip("one run without the hubs' help is enough")
    monkeypatch.setattr(neardup, "HUBS", hubs)
    monkeypatch.setattr(neardup, "_XORS", neardup._XORS[:hubs])
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), t) for t in texts(seed)] + [(7, None), (8, ""), (8, " \n"), (None, "x"), (3, "one two"), (4, "one two"), (4, "ONE  two"), (5, "two one")]
    wanted, groups, sets = brute(rows, 4)
    df = spark.createDataFrame([(i, t, "l", "t", 1) for i, t in rows], SCHEMA)
    got = near_duplicates(df, Shingling(words=4))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((rows[k][0], *wanted[k])) for k in range(len(rows)))


def test_second_join_is_needed_and_exact(spark):
    """Many copies that lie below the similarity to the hubs, but in pairs above it to each other."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        mine = list(base)
        for at in rng.sample(range(120), 9):
            mine[at] = f"x{k}y{at}"
        rows.append((2 * k, " ".join(mine)))
        again = list(mine)
        again[rng.randrange(120)] = "other"
        rows.append((2 * k + 1, " ".join(again)))
    wanted, groups, _ = brute(rows, 4)
    assert len(groups) > 10
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Shingling(words=4))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {rows[i][0]: wanted[i][1] for i in range(len(rows))}


def test_few_pairs_of_one_large_group_are_listed(spark, monkeypatch, tmp_path):
    """Copies of one text with changes of their own, most pairs just below the similarity: the second join rules most out unlisted."""
    monkeypatch.setattr(neardup, "only_kept", lambda *a: None)
    rng = random.Random(3)
    rows = []
    for k in range(300):
        mine = [f"w{i}" for i in range(150)]
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 3, 4, 4])):
            mine[at] = f"x{k}y{at}"
        rows.append((k, " ".join(mine)))
    wanted, _, _ = brute(rows, 4)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Shingling(words=4), str(tmp_path))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {k: w[1] for k, w in enumerate(wanted)}
    assert spark.read.parquet(f"{tmp_path}/second").count() * 20 <= 300 * 299 // 2


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(25)]), t) for t in texts(4)]
    rows += [(1, "five quite unrelated words stand here alone"), (1, "and another text that nobody else has"), (30, None), (30, None), (31, ""), rows[0], rows[0]]
    _, groups, sets = brute(rows, 5)
    got = [(r["doc_id"], r["text"]) for r in neardup_stage(spark, spark.createDataFrame([(i, t, "l", "t", 1) for i, t in rows], SCHEMA), "").collect()]
    bare = [r for r, s in zip(rows, sets) if not s]
    left = list(got)
    for r in bare:
        left.remove(r)
    worded = [g for g in groups.values() if sets[g[0]]]
    assert len(left) == len(worded)
    for members in worded:
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        assert sum(r in left for r in {rows[i] for i in members}) == 1
        assert any(rows[i] in left and rows[i][0] == least for i in members)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and neardup_stage(spark, empty, "").collect() == []
