"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from lumiset.llm import spelling_variants as sv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return n


def brute_variants(n):
    out, form = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(others), form[w], n[form[w]] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def found(spark, n, **more):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = sv.variants(words, **more).collect()
    assert len(rows) == len(n)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def dense(k, seed, letters="abcà", lengths=(5, 6, 7, 8, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([1, 2, 3, 5, 10, 20, 40]) for _ in range(k)}


def test_paths_of_the_composition():
    """Every pair once, for all sets of words; of those at the end only if it is open."""
    rng = random.Random(1)
    for letters, m in (("ab", 1), ("ab", 3), ("abc", 4), ("aé", 5)):
        for _ in range(40):
            draw = lambda k: sorted({"".join(rng.choice(letters) for _ in range(k)) for _ in range(rng.randrange(1, 20))})  # noqa: B023, E731
            a, b = draw(m), draw(m + 1) if rng.random() < 0.8 else []
            want = sorted([(x, y) for x in a for y in a if x < y and near(x, y)] + [(x, y) for x in a for y in b if near(x, y)])
            got = sorted((min(p), max(p)) if len(p[0]) == len(p[1]) else p for p in sv.one_edit(a, b, True))
            assert got == want
            assert sorted(p for p in sv.one_edit(a, b, False) if len(p[0]) < len(p[1])) == [p for p in want if len(p[0]) < len(p[1]) and p[1][:m] != p[0]]


def test_acceptor_is_minimal():
    words = sorted({a + b + c for a in "abc" for b in "xy" for c in "12"})
    states = sv.acceptor(words)
    assert len(states) == 4  # one state for each place in a word: all words of a place go on alike
    assert sorted(w for w in sv.common_rests(states, 3, states, 3)) == words


@pytest.mark.parametrize("most", [20_000, 3])
def test_variants_are_those_of_all_pairs(spark, most):
    """With ``most`` 3 nearly all groups are dealt again, down to rests of one letter."""
    n = dense(500, 4) | {"colour": 50, "color": 20, "colr": 5, "colou": 10, "aaaaa": 4, "aaaaaa": 8, "aaaaaaa": 16, "ÿæçèé": 3, "ÿæçèê": 6}
    assert found(spark, n, most=most) == brute_variants({w: c for w, c in n.items() if len(w) >= 5}) | {w: (c, 0, None, None, w) for w, c in n.items() if len(w) < 5}


def test_chains_of_forms(spark):
    n = {"abcdefgh"[: k + 5].ljust(k + 5, "z"): 2**k for k in range(12)}
    got = found(spark, n)
    assert got == brute_variants(n) and len({r[4] for r in got.values()}) == 1


def test_counts_of_runs(spark, hard_docs, no_docs, documents, monkeypatch):
    for held, together in ((300_000, 200_000), (5, 3)):
        monkeypatch.setattr(sv, "HELD", held)
        monkeypatch.setattr(sv, "TOGETHER", together)
        docs = hard_docs.select("doc_id", "text")
        assert {r.word: r.n for r in sv.word_counts(hard_docs).collect()} == brute_counts(docs.collect())
    assert {r.word: r.n for r in sv.word_counts(documents).collect()} == brute_counts(documents.select("doc_id", "text").collect())
    odd = spark.createDataFrame([(None, "Straße ÀÉÎ×÷ÿ ÀÉÎ×÷ÿ naïve"), (2, "x" * 30_000 + "Ā" + "ȦBCDEF"), (2, "")], "doc_id long, text string")
    assert {r.word: r.n for r in sv.word_counts(odd).collect()} == brute_counts(odd.collect())
    assert sv.variants(sv.word_counts(no_docs)).count() == 0


def test_long_words(spark):
    long_word = "".join(random.Random(2).choice("abcdef") for _ in range(20_000))
    n = {long_word: 9, long_word[:7000] + long_word[7001:]: 3, long_word + "q": 4, "q" + long_word: 4, "hello": 3}
    assert found(spark, n) == brute_variants(n)
