import itertools
import random

import numpy as np
import pytest

from arborq.llm import jaccard
from arborq.llm import components as parts
from arborq.llm.components import components


def sets(rows):
    out = []
    for d, text in rows:
        words = jaccard.words_of(text)
        n = min(5, len(words))
        out.append((d, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()))
    return out


def brute(rows):
    s = sets(rows)
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(s), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(s):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(a), least[find(i)]) for i, (d, a) in enumerate(s))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows, texts = [], []
    for d in range(n):
        if texts and r.random() < 0.6:
            words = list(r.choice(texts[-40:]))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                k = r.randrange(len(words) + 1)
                words[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 9, 30, 60, 120]))]
            if r.random() < 0.4:
                words += passage
        texts.append(words)
        rows.append((d, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    r.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(map(tuple, jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()))
        assert got == brute(rows)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    words = [f"v{k}" for k in range(120)]
    rows = [(0, " ".join(words))]
    for d in range(1, 150):
        own = list(words)
        for _ in range(r.randrange(1, 5)):
            own[r.randrange(len(own))] = f"x{r.randrange(400)}"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(rows)


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(odd).collect()}
    assert got[(1, 20)] == 1 and got[(2, 20)] == 1 and got[(7, 1)] == 7 and got[(8, 1)] == 7
    assert got[(3, 0)] == 3 and got[(4, 0)] == 4 and got[(5, 0)] == 5
    assert jaccard.jaccard_components(odd).count() == odd.count()
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 9, 10]


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    least = {}
    for a, b in edges * 300:
        m = min(least.get(a, a), least.get(b, b), a, b)
        least[a] = least[b] = m
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in least.items() if n != c}


def test_filters_keep_every_link():
    r = random.Random(7)
    for _ in range(3000):
        x = set(r.sample(range(60), r.randrange(1, 40)))
        y = set(x) if r.random() < 0.8 else set(r.sample(range(60), 20))
        for _ in range(r.randrange(5)):
            y.symmetric_difference_update({r.randrange(60)})
        if not y:
            continue
        overlap = len(x & y)
        if jaccard.alike(overlap, len(x), len(y)):
            assert overlap >= jaccard.least_overlap(len(x), len(y))
            a, b = sorted(x), sorted(y)
            common = [t for t in a[: jaccard.prefix_length(len(a))] if t in b[: jaccard.prefix_length(len(b))]]
            assert common and jaccard.can_link(len(a), a.index(common[0]), len(b), b.index(common[0]))


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}
    monkeypatch.setattr("arborq.llm.components.MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components(path)


def test_copies_without_their_original(spark, monkeypatch):
    """Most of these pairs share prefix shingles and few link: rows of pairs stay near the number of documents."""
    r = random.Random(5)
    words = [f"v{k}" for k in range(200)]
    rows = []
    for d in range(500):
        own = list(words)
        for k in r.sample(range(200), 3):
            own[k] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    made = []
    monkeypatch.setattr(jaccard, "likeliest", lambda *a, f=jaccard.likeliest: made.append(f(*a)) or made[-1])
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(rows)
    pairs = [(r.a, r.b) for df in made for r in df.where("a IS NOT NULL").select("a", "b").distinct().collect()]
    assert made and len(pairs) < 20 * len(rows)


def test_blocks_and_rounds_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    monkeypatch.setattr(jaccard, "LIKELIEST", 1)
    monkeypatch.setattr(jaccard, "GROWTH", 2)
    rows = corpus(3, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)


def test_sketches_bound_the_difference():
    r = random.Random(3)
    for _ in range(300):
        pool = np.array([r.getrandbits(64) for _ in range(r.choice([5, 100, 1500]))], np.uint64)
        x, y = (np.unique(pool[np.array([r.random() < 0.8 for _ in pool])]) for _ in range(2))
        if len(x) and len(y):
            a, b = (np.frombuffer(jaccard.sketch(z), "<u8") for z in (x, y))
            assert jaccard.differing(a, b) <= len(np.setxor1d(x, y)) and jaccard.differing(a, a) == 0


def test_repeated_rows_and_two_texts_of_one_doc_id(spark):
    words = [f"v{k}" for k in range(60)]
    near = " ".join([*words[:-1], "z"])
    rows = [(5, " ".join(words))] * 40 + [(9, near)] * 40 + [(5, "another text of the same number here"), (11, "another text of the same number here")]
    got = {tuple(x) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(5, 56, 5), (9, 56, 5), (5, 3, 5), (11, 3, 5)}
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in kept) == [(5, 7), (5, 60)]


def test_hashes_of_words_do_not_depend_on_how_texts_are_cut(monkeypatch):
    r = random.Random(9)
    texts = [None, "", " ", "A", "a  B\tc\x0bd\x0ce\rf\ng", "é" * 40, "x" * 70 + " y", "ab", " lead and trail ", "\x00 \x85 \xa0", "w " * 30]
    texts += ["".join(r.choice("ab cdé\n\t0") for _ in range(r.randrange(80))) for _ in range(200)] + ["y" * 500 + " z z z z z"]
    import pyarrow as pa

    want = list(jaccard.hashed_texts(pa.array(texts)))
    for text, (sig, s) in zip(texts, want, strict=True):
        words = jaccard.words_of(text)
        n = min(5, len(words))
        assert len(s) == (len({tuple(words[k : k + n]) for k in range(len(words) - n + 1)}) if words else 0) and (sig is None) == (not words)
    by_words = {}
    for text, (sig, _) in zip(texts, want, strict=True):
        assert by_words.setdefault(tuple(jaccard.words_of(text)), sig) == sig
    assert len(set(by_words.values())) == len(by_words)
    for size in (3, 20, 100):
        monkeypatch.setattr(jaccard, "AT_ONCE", size)
        got = list(jaccard.hashed_texts(pa.array(["skipped", *texts])[1:]))
        assert all(a[0] == b[0] and (a[1] == b[1]).all() for a, b in zip(got, want, strict=True))


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """One task and a look at its file, however many shuffle partitions there are; more edges than that go to the stars."""
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(900, 1000)] + [(1, 1), (None, 2), (5, None)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(40).localCheckpoint()
    want = sorted(map(tuple, components(table).collect()))
    spark.sparkContext.setJobGroup("few", "")
    got = parts.settled(table)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    spark.sparkContext.setJobGroup("", "")
    tasks = sum(spark.sparkContext.statusTracker().getStageInfo(s).numTasks for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds)
    assert sorted(map(tuple, got.collect())) == want and tasks <= 4
    monkeypatch.setattr(parts, "FEW", 100)
    assert sorted(map(tuple, parts.settled(table).collect())) == want
    assert parts.settled(table.where("a < 0")).count() == 0


def test_components_of_many_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parts, "FEW", 0)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 4 : 40 + k % 4 * 5])) for k in range(24)]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(rows)
