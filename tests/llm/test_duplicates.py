"""Near-duplicates, neighbours and repeated passages against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiset.llm import chained_substrings, posting_ann, tensored_minhash
from lumiset.llm.common import words_of
from lumiset.llm.components import components


def classes(texts, width=4, percent=80):
    """Component of each id by comparing all pairs that share a shingle."""
    sets, where, root = {}, defaultdict(list), {}
    for i, t in texts.items():
        w = words_of(t or "")
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        root[i] = i
        for s in sets[i]:
            where[s].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def copies(seed=1, groups=12, size=9):
    rng = random.Random(seed)
    texts, k = {}, 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, size)):
            words = list(base)
            for _ in range(rng.randrange(0, 8)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9000)}"
            texts[k], k = " ".join(words), k + 1
    return texts


@pytest.mark.parametrize("block", [128, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(tensored_minhash, "BLOCK", block)
    texts = copies() | {900: None, 901: "", 902: " ", 903: "one two", 904: "ONE two", 905: "one two three"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in tensored_minhash.near_duplicates(df, 4, 80).collect()}
    group, n = classes(texts)
    assert {i: r.component_id for i, r in rows.items()} == group
    assert {i: r.n_shingles for i, r in rows.items()} == n
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())
    kept = tensored_minhash.drop_near_duplicates(df, 4, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, g in group.items() if i == g}


def test_near_duplicate_edges(hard_docs, no_docs):
    rows = tensored_minhash.near_duplicates(hard_docs, 4, 80).collect()
    assert len(rows) == hard_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 5 and by[None].component_id is None and by[None].kept and by[2].kept
    assert tensored_minhash.near_duplicates(no_docs).count() == 0
    assert tensored_minhash.drop_near_duplicates(hard_docs, 4, 80).columns == hard_docs.columns


def template(n, seed=4):
    """Texts that lie about the threshold from each other: all have a part of one template, and are in one cluster."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(90)]
    heads = [[f"h{g}-{k}" for k in range(rng.randrange(8, 16))] for g in range(n // 12)]
    texts = {}
    for i in range(n):
        words = base + rng.choice(heads)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("n", [100, 1000])
def test_clusters_of_any_size(spark, n):
    """A cluster under and one over BLOCK give the links of brute force alike."""
    texts = template(n) | {n + i: t for i, t in copies(seed=5, groups=4).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group, _ = classes(texts)
    assert {r.doc_id: r.component_id for r in tensored_minhash.near_duplicates(df, 4, 80).collect()} == group
    assert 1 < len({group[i] for i in range(n)}) < n


@pytest.mark.parametrize("block", [128, 1])
def test_links_of_each_text_under_one_id(spark, monkeypatch, block):
    monkeypatch.setattr(tensored_minhash, "BLOCK", block)
    rng = random.Random(7)
    a, b = ([f"{s}{rng.randrange(9000)}" for _ in range(80)] for s in "ab")
    change = lambda words: " ".join([*words[:40], "other", *words[41:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, change(a)), (8, change(b)), (8, change(b)), (None, " ".join(a)), (9, " ".join(b[:30]))]
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in tensored_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect())
    assert found == [(0, 0), (5, 5), (5, 5), (7, 5), (8, 5), (8, 5), (9, 9)]


@pytest.mark.parametrize("few", [50_000, 0])
def test_components_of_a_path_and_a_star(spark, few):
    path = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long"), few).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(100, 140)} == {100}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[1200:1260] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [float("nan")] * 16), (2040, [0.0] * 16), (2060, []), (2080, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in posting_ann.neighbours(df, lambda i: i % 20 == 0, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        hit += len({i for _, i, _ in found} & set(order))
        assert [k for k, *_ in found] == list(range(1, 21))
        assert all(s == pytest.approx(scores[i]) for _, i, s in found)
    assert hit / 20 / len(got) >= 0.9


def test_lists_act_on_many_vectors(spark):
    """With two lists for each root of the table's size, boundary vectors have copies, a query scores a part of the table that
    gets smaller as the table grows, and it finds 0.9 of its neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 24))
    x = centres[rng.integers(0, 300, 6000)] + rng.normal(0, 0.8, (6000, 24))
    index, share = None, {}
    for n in (1500, 6000):
        index = posting_ann.fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "key long, v array<double>"))
        posts, routes = index.post(x[:n]), index.route(x[:n:20])
        held = np.bincount([p for ps in posts for p in ps], minlength=len(index.c))
        share[n] = np.mean([held[r].sum() for r in routes]) / n
    assert len(index.c) == round(2 * 6000**0.5) and 1.1 < np.mean([len(p) for p in posts]) <= posting_ann.COPIES
    assert share[6000] < share[1500] and share[6000] < 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in posting_ann.neighbours(df, lambda i: i % 20 == 0, 20).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hit / 20 / 300 >= 0.9


def test_rows_that_repeat_vectors_and_ids(spark):
    """Null ids and vectors of a rarer length take no part; an id with several vectors is a candidate with its best."""
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (1, [0.5, 0.0], 3), (1, [0.9, 0.1], 4), (2, [0.9, 0.1], 5), (None, [9.0, 9.0], 6), (20, [9.0, 9.0, 9.0], 7), (40, [0.0, 1.0], 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key long").withColumns({c: F.lit(1) for c in ("id", "v", "q", "score", "rank", "list")})
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in posting_ann.neighbours(df, lambda i: i % 20 == 0, 20).collect())
    assert found == [(0, 1, 1, 0.9), (0, 2, 2, 0.9), (0, 3, 40, 0.0), (40, 1, 1, 0.1), (40, 2, 2, 0.1), (40, 3, 0, 0.0)]


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in posting_ann.neighbours(df, lambda i: i % 20 == 0, 20).collect())
    assert rows == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]
    assert posting_ann.neighbours(df.where("false"), lambda i: i % 20 == 0).count() == 0


def passages(seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    shared = [word() for _ in range(80)]
    fuzzy = list(shared)
    for k in (15, 37, 60):
        fuzzy[k] = word()
    fuzzy.insert(45, word())
    own = lambda n: [word() for _ in range(n)]
    line = own(12)
    return {
        1: own(40) + shared + own(30), 2: own(10) + shared + own(5), 3: own(100), 4: fuzzy + own(60), 5: shared[:40] + own(60),
        6: line * 8, 7: own(9) + line * 8, 8: ["from"] * 90, 9: own(4) + ["from"] * 120, 10: [], 11: own(200) + shared[10:70],
    }


def test_repeated_passages(spark):
    words = passages()
    texts = [(i, " ".join(w)) for i, w in words.items()] + [(12, None), (None, " ".join(words[2]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = chained_substrings.repeated_passages(df).collect()
    covered = defaultdict(set)
    for r in rows:
        covered[r.doc_id] |= set(range(r.start, r.end))
        assert r.source_id < r.doc_id and r.end - r.start >= 50 and r.n_same * 100 >= 80 * (r.end - r.start)
    assert set(covered) == {2, 4, 7, 9, 11}
    assert covered[2] == set(range(10, 90)) and covered[11] == set(range(200, 260))
    assert covered[4] >= set(range(0, 81)) and len(covered[4]) <= 82
    assert covered[7] == set(range(9, 105)) and len(covered[9]) >= 90
    left = {r.doc_id: r.text for r in chained_substrings.without_passages(df).collect()}
    assert left[2].split() == words[2][:10] + words[2][90:] and left[1] == texts[0][1] and left[12] is None and left[3] == texts[2][1]


def test_passage_edges(hard_docs, no_docs):
    assert {(r.doc_id, r.source_id) for r in chained_substrings.repeated_passages(hard_docs).collect()} == {(6, 5)}
    assert chained_substrings.repeated_passages(no_docs).count() == 0
    assert chained_substrings.without_passages(hard_docs).columns == hard_docs.columns


def test_chain_is_the_best_of_all_orders():
    rng = random.Random(6)
    for _ in range(300):
        runs = sorted((s := rng.randrange(60), s + rng.randrange(1, 8), rng.randrange(60)) for _ in range(rng.randrange(1, 8)))

        def best(i, runs=runs):
            s, e, r = runs[i]
            options = [best(j) - 0.2 * (s - b + r - (c + b - a)) for j, (a, b, c) in enumerate(runs) if b <= s and c + b - a <= r]
            return e - s + max([0.0, *options])

        chain = chained_substrings.chains(runs, 0.2, 10**6)[0]
        weight = sum(e - s for s, e, _ in chain) - 0.2 * sum(s2 - e1 + r2 - (r1 + e1 - s1) for (s1, e1, r1), (s2, _, r2) in zip(chain, chain[1:]))
        assert weight == pytest.approx(max(best(i) for i in range(len(runs))))


def test_passages_behind_long_differences(spark):
    """A chain goes on behind a difference that no alignment crosses: each stretch is a passage of its own."""
    rng = random.Random(8)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    few, passage, left, right = own(20), own(60), own(300), own(300)
    one, two = own(12), own(15)
    words = {1: few + own(15) + passage, 2: few + own(15) + passage, 3: left + own(18) + right, 4: own(7) + left + own(14) + right, 5: one + own(11) + two + own(30) + passage, 6: one + own(16) + two + own(30) + passage}
    words[5][-60:] = words[6][-60:] = own(60)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.end, r.source_id, r.source_start, r.source_end, r.n_same) for r in chained_substrings.repeated_passages(df).collect())
    assert found == [(2, 35, 95, 1, 35, 95, 60), (4, 7, 307, 3, 0, 300, 300), (4, 321, 621, 3, 318, 618, 300), (6, 73, 133, 5, 68, 128, 60)]
    left_over = {r.doc_id: r.text.split() for r in chained_substrings.without_passages(df).collect()}
    assert left_over[2] == words[2][:35] and left_over[4] == words[4][:7] + words[4][307:321]


def test_passage_in_a_stretch_that_agrees_too_little():
    runs = [(0, 0, 20), (28, 28, 3), (39, 39, 3), (50, 50, 3), (61, 61, 3), (72, 72, 60), (140, 140, 3)]
    assert list(chained_substrings.passing(runs, 50, 80)) == [(50, 132, 50, 132, 66)]
    assert list(chained_substrings.passing(runs[:5], 50, 80)) == [] == list(chained_substrings.passing([], 50, 80))


def test_passages_of_which_earlier_texts_hold_pieces(spark):
    """Texts 4 and 5 of each group share 60 words whose first and last 30 come first in two other texts, 6 and 7 a part of them."""
    rng = random.Random(9)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    words = {}
    for g in range(0, 300, 10):
        both = own(60)
        words |= {g: both[:30] + own(30), g + 1: own(30) + both[30:], g + 2: own(30) + both[15:45] + own(30), g + 4: own(9) + both + own(40), g + 5: own(70) + both + own(3), g + 6: own(30) + both[5:55] + own(4), g + 7: both[:49] + own(30)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    covered = defaultdict(set)
    for r in chained_substrings.repeated_passages(df).collect():
        assert r.source_id < r.doc_id and r.end - r.start >= 50 and words[r.doc_id][r.start : r.end] == words[r.source_id][r.source_start : r.source_end]
        covered[r.doc_id] |= set(range(r.start, r.end))
    assert covered == {g + i: set(range(a, b)) for g in range(0, 300, 10) for i, a, b in ((5, 70, 130), (6, 30, 80))}


def repeats(words, n=50):
    """Of each text the places of words in windows of n words that an earlier text has too, by comparing all windows."""
    seen, covered = set(), {}
    for i in sorted(words):
        own = [tuple(words[i][k : k + n]) for k in range(len(words[i]) - n + 1)]
        covered[i] = {x for k, w in enumerate(own) if w in seen for x in range(k, k + n)}
        seen.update(own)
    return covered


@pytest.mark.parametrize("seed", [1, 2])
def test_every_exact_repeat_is_covered(spark, seed):
    """Texts put together from pieces of each other, with quoters of parts before and between, and texts of few words."""
    rng = random.Random(seed)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(120)
    words = {i: own(20) + passage[9 * (i - 900) : 9 * (i - 900) + 39 + i % 12] + own(20) for i in range(900, 910)}
    words |= {1000: own(30) + passage, 2000: own(5) + passage + own(9)}
    words |= {i: own(20) + passage[7 * (i - 1500) : 7 * (i - 1500) + 49] + own(20) for i in range(1500, 1510)}
    for i in range(3000, 3060):
        text = []
        while len(text) < 200:
            source = words[rng.choice(list(words))]
            a = rng.randrange(len(source))
            text += rng.choice([source[a : a + rng.randrange(20, 90)], own(rng.randrange(1, 30)), [rng.choice("xyz")] * rng.randrange(5, 120), own(7) * rng.randrange(1, 9)])
        words[i] = text
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    covered, expected = defaultdict(set), repeats(words)
    for r in chained_substrings.repeated_passages(df).collect():
        a, b = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
        assert r.source_id < r.doc_id and len(a) >= 50 and len(b) >= 50 and r.n_same * 100 >= 80 * max(len(a), len(b))
        assert sum((Counter(a) & Counter(b)).values()) >= r.n_same
        covered[r.doc_id] |= set(range(r.start, r.end))
    assert expected[2000] == set(range(5, 125)) and all(expected[i] <= covered[i] for i in words)
    assert covered[2000] == expected[2000] and not any(covered[i] for i in range(900, 910))


def test_few_ranges_cover_all():
    rng = np.random.default_rng(1)
    for _ in range(300):
        starts = np.sort(rng.integers(0, 400, rng.integers(1, 60)))
        ends = starts + rng.integers(50, 90, len(starts))
        kept = chained_substrings.cover(starts, ends)
        words = lambda at: {x for i in at for x in range(starts[i], ends[i])}
        assert words(kept) == words(range(len(starts))) and all(starts[c] > ends[a] for a, c in zip(kept, kept[2:], strict=False))


def test_hot_seeds_give_the_same(spark, monkeypatch):
    words = passages() | {i: passages()[1] for i in range(20, 40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    found = []
    for hot in (0.001, 0.9):
        monkeypatch.setattr(chained_substrings, "HOT", hot)
        found.append(sorted(tuple(r) for r in chained_substrings.repeated_passages(df).collect()))
    assert found[0] == found[1] and {r[0] for r in found[0]} >= set(range(20, 40))


def test_texts_under_one_id_are_cut_by_themselves(spark):
    """Rows with one id and different texts keep what is their own."""
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, q = word(60), word(55)
    a, b, c = word(30) + p + word(40), word(200), word(20) + q + word(10)
    rows = [(1, word(20) + p + word(20)), (5, a), (5, b), (5, a), (7, word(5) + q), (5, c), (None, p)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    left = sorted(r.text for r in chained_substrings.without_passages(df).where("doc_id = 5").collect())
    assert left == sorted(" ".join(t) for t in (a[:30] + a[90:], b, a[:30] + a[90:], c[:20] + c[75:])) or left == sorted(" ".join(t) for t in (a[:30] + a[90:], b, a[:30] + a[90:], c))
    found = {(r.doc_id, r.source_id, r.end - r.start) for r in chained_substrings.repeated_passages(df).collect()}
    assert (5, 1, 60) in found and len(found) == 2 and {d for d, *_ in found} <= {5, 7}
