"""Held-out accuracy of language, toxicity and personal-data models, and brute-force checks of their parts."""

import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiset.llm import cnn_toxicity, license_dice, ppm_language, weak_pii


def test_language_held_out(spark, documents):
    trees = ppm_language.fit(documents.where(~ppm_language.held_out()))
    rows = ppm_language.identify(documents.where(ppm_language.held_out()), trees, keep=("lang",)).collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows if r.lang_pred != "und"]) > 0.95


def test_language_codes_are_a_distribution():
    tree = ppm_language.Tree({b"": {97: 3, 98: 1}, b"a": {98: 2}})
    for context in (b"", b"a", b"xa", b"zz"):
        assert sum(2 ** -tree.cost(context, s) for s in range(256)) == pytest.approx(1)


def test_code_lengths_against_the_tree():
    """Lengths of whole texts are the tree's costs of each byte after the four before it, one after the other."""
    rng = random.Random(8)
    texts = ["the cat sat on the mat, and 12 more!", "Le chat est là. \u00e9t\u00e9", "", "a", "\ud800 x", "z" * 40]
    trees = {}
    for name, text in zip("ab", texts, strict=False):
        counts = {}
        for context, byte, n in ppm_language.grams(ppm_language.raw(text * 3)):
            for i in range(len(context) + 1):
                counts.setdefault(context[i:], {}).setdefault(byte, 0)
                counts[context[i:]][byte] += n
        trees[name] = counts
    texts += ["".join(rng.choice("the cat\u00e9 \n.1") for _ in range(rng.randrange(300))) for _ in range(40)]
    for limit in (1_000_000, 50):
        identifier = ppm_language.Identifier(trees, limit=limit)
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            expected = [sum(ppm_language.Tree(trees[t]).cost(data[max(0, i - 4) : i], data[i]) for i in range(len(data))) for t in "ab"]
            assert identifier.lengths(text) == pytest.approx(expected, abs=1e-3)
    whole = identifier.lengths(texts[0] * 9)
    step, ppm_language.STEP = ppm_language.STEP, 7
    try:
        assert identifier.lengths(texts[0] * 9) == pytest.approx(whole)
    finally:
        ppm_language.STEP = step


def test_training_sample_counts_rows(spark):
    """Rows that repeat an id do not enlarge the sample, and a language of long texts only has a tree."""
    rows = [(1, f"text number {k} in english", "en") for k in range(50)] + [(2, "long " * 9000, "de"), (None, "no id", "fr"), (3, None, "es"), (4, "no language", None)]
    trees = ppm_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_texts=2)
    assert set(trees) == {"en", "de"} and trees["en"][b""][ord("x")] == 2


def test_language_edges(spark, hard_docs, no_docs):
    trees = ppm_language.fit(hard_docs)
    rows = {r.doc_id: r for r in ppm_language.identify(hard_docs, trees).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == "und" and rows[2].score == 0
    assert rows[5].lang_pred in ("en", "fr", "es", "de") and all(0 <= r.score <= 1 for r in rows.values())
    assert ppm_language.fit(no_docs) == {} and ppm_language.identify(no_docs, {}).count() == 0
    assert ppm_language.identify(hard_docs, {}).where("lang_pred != 'und'").count() == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    labels = labels.where("doc_id < 4000")
    model = cnn_toxicity.fit(docs.where(~cnn_toxicity.train_held_out()), labels)
    rows = cnn_toxicity.score(docs.where(cnn_toxicity.train_held_out()).join(labels, "doc_id"), model, keep=("toxic",)).collect()
    hit = np.array([r.predicted for r in rows])
    truth = np.array([r.toxic for r in rows])
    assert (hit & truth).sum() > 0.6 * truth.sum() and (hit & (1 - truth)).sum() < 0.03 * (1 - truth).sum()


def test_toxicity_edges(spark, hard_docs, no_docs, labels):
    none = labels.where("false")
    assert cnn_toxicity.fit(hard_docs, none) is None
    assert cnn_toxicity.score(hard_docs, None).where("score != 0").count() == 0
    assert cnn_toxicity.drop_toxic(no_docs, none, None).count() == 0
    shape = cnn_toxicity.Shape(buckets=1 << 10)
    text = lambda bad: np.array([cnn_toxicity.features(w, shape.buckets) for w in (["fine", "words"] * 5 + (["idiot"] if bad else []))])
    y = np.array([0, 1] * 30)
    model = cnn_toxicity.train([text(v) for v in y], y, np.zeros(60, int), shape)
    scorer = cnn_toxicity.Scorer(model)
    assert 0 <= scorer.score("") <= 1
    kept = cnn_toxicity.drop_toxic(hard_docs, labels, model)
    assert kept.columns == hard_docs.columns


def test_every_labelled_text_trains(spark):
    """Long texts, copies, many of one class, several texts under an id: all are in the shards, whole, and are learnt from."""
    shape, long_text = cnn_toxicity.Shape(buckets=1 << 10), "fine words " * 4000
    rows = [*((i, long_text + f"idiot number{'x' * (i % 5)}") for i in range(5000, 5040)), (6000, "one"), (6000, "another text"), (6001, "twice"), (6001, "twice"), (6002, None), (None, "no id"), (7000, "no label")]
    docs = spark.range(3100).selectExpr("id AS doc_id", "'fine words here' AS text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = docs.select("doc_id", F.col("doc_id").between(5000, 5999).cast("int").alias("toxic")).where("doc_id != 7000")
    shards = [cnn_toxicity._unpack(r.asDict(), shape.buckets) for r in cnn_toxicity._shards(docs, labels, shape, 500, "doc_id", "text", "toxic").collect()]
    assert len(shards) > 4 and sum(len(t) for t, _, _ in shards) == 3100 + 40 + 2 + 1 + 1
    assert sum(int(y.sum()) for _, y, _ in shards) == 40 and sorted(len(x) for t, _, _ in shards for x in t)[-40:] == [8002] * 40
    models = [cnn_toxicity.fit(df, labels, shape, per_shard=500) for df in (docs.repartition(5), docs.coalesce(1))]
    assert all((a == b).all() for a, b in zip(*([m.embedding, m.thresholds, cnn_toxicity._flat(m)] for m in models), strict=True))
    scorer = cnn_toxicity.Scorer(models[0])
    assert scorer.score(long_text + "idiot number") >= 0.7 > scorer.score("fine words here")


def test_one_shard_is_plain_descent(spark):
    rng = random.Random(6)
    shape = cnn_toxicity.Shape(buckets=1 << 10)
    rows = [(i, " ".join(rng.choice("fine words and texts of the day".split()) for _ in range(rng.randrange(12))) + (" idiot" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = cnn_toxicity.fit(df, df, shape)
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    texts = [np.array([cnn_toxicity.features(w, shape.buckets) for w in cnn_toxicity.words_of(t)], np.int32).reshape(-1, 3) for _, t, _ in rows]
    plain = cnn_toxicity.train(texts, np.array([y for _, _, y in rows]), np.array([cnn_toxicity.guess(cnn_toxicity.words_of(t)) for _, t, _ in rows]), shape)
    assert np.allclose(model.embedding, plain.embedding, atol=1e-4) and np.allclose(cnn_toxicity._flat(model), cnn_toxicity._flat(plain), atol=1e-4)
    assert np.allclose(model.thresholds, plain.thresholds, atol=1e-2)


def test_long_texts_train_in_pieces():
    """Maxima and their places are those of the text as a whole, and no text's maximum takes in words of the next one."""
    r = np.random.default_rng(3)
    shape = cnn_toxicity.Shape(buckets=1 << 8)
    model = cnn_toxicity.Model(shape, r.normal(size=(256, shape.dims)).astype(np.float32), [r.normal(size=(w, shape.wide, 8)).astype(np.float32) for w in shape.widths], r.normal(size=24).astype(np.float32), r.normal(size=24).astype(np.float32), 0.1)
    texts = [r.integers(0, 256, (n, 3)) for n in (0, 1, 2, 20, 21, 22, 100, 3)]
    values, places = cnn_toxicity._best(model, texts)
    for t, v in zip(texts, values, strict=True):
        assert np.allclose(v, cnn_toxicity._best(model, [t])[0][0], atol=1e-5)
    piece, cnn_toxicity.PIECE = cnn_toxicity.PIECE, 10
    try:
        again, there = cnn_toxicity._best(model, texts)
    finally:
        cnn_toxicity.PIECE = piece
    assert np.allclose(values, again, atol=1e-5) and all(((a == b) | (v == 0)).all() for a, b, v in zip(places, there, np.split(values, 3, 1), strict=True))


def test_scores_in_blocks_are_those_of_the_whole():
    rng = random.Random(1)
    shape = cnn_toxicity.Shape(buckets=1 << 8)
    r = np.random.default_rng(0)
    model = cnn_toxicity.Model(shape, r.normal(size=(256, shape.dims)).astype(np.float32), [r.normal(size=(w, shape.wide, 8)).astype(np.float32) for w in shape.widths], r.normal(size=24).astype(np.float32), r.normal(size=24).astype(np.float32), 0.1)
    words = [f"w{rng.randrange(50)}" for _ in range(200)]
    scorer = cnn_toxicity.Scorer(model)
    a, b = scorer.pooled(words, 20_000), scorer.pooled(words, 7)
    assert np.allclose(a[0], b[0], atol=1e-4) and a[1] == b[1]
    x, starts = cnn_toxicity._spread([np.array([cnn_toxicity.features(w, 256) for w in words])], model)
    assert np.allclose(cnn_toxicity._pool(model, x, starts)[0][0], a[0], atol=1e-3)


def plain_base(t):
    out = [("email", *x.span()) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *x.span()) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x.group().split("."))]
    for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", x.group())
        out += [("card", *x.span())] if 14 <= len(g) <= 19 and weak_pii.luhn(g) else []
    out += [("phone", *x.span()) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", x.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], weak_pii.ORDER[s[0]]))


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    for k in range(20_000):
        t = "".join(rng.choice("ab@..--_%+0019  (){é" if k % 2 else "0123456789 -.+") for _ in range(rng.randrange(60)))
        assert weak_pii.base_spans(t) == plain_base(t)


def test_pii_edges(hard_docs, no_docs, documents):
    model = weak_pii.fit(documents)
    rows = {r.doc_id: r for r in weak_pii.find_pii(hard_docs, model).collect()}
    assert rows[2].spans == "" and rows[3].n_email == 0
    assert weak_pii.find_pii(no_docs, weak_pii.fit(no_docs)).count() == 0
    masked = {r.doc_id: r.text for r in weak_pii.mask_pii(hard_docs, model).collect()}
    assert masked[2] is None and masked[3] == ""
    text = "x token = \"0fa07e990a1b2c3d4e5f60718293a4b5c6d7e8f9\" mail a@b.com, 10.0.0.1 +1 (017) 555-7713"
    base, spans = weak_pii.find(text, model)
    assert [k for k, *_ in base] == ["email", "ip", "phone"] and spans[0][0] == "secret"
    assert weak_pii.mask(text, spans) == "x token = \"[SECRET]\" mail [EMAIL], [IP] [PHONE]"


def test_added_spans_against_all_candidates():
    """Of all candidates by plain patterns those are added, from left to right in each kind, that the model takes and no base span meets."""
    rng = random.Random(11)
    bits = ["a.b@c.com", "x [at] y [dot] org", "10.0.0.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "017-555-7713", "123-45-6789", "000-12-3456", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "Dr. Anna Smith", "Mr Foo", "token = 0fa07e990a1b2c3d4e5f60718293a4b5c6d7e8f9", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "ssn", "the", "account", "é\n", "Mrs Maria Mr Lee"]
    patterns = {
        "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])", "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "email": r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]+)+",
    }
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    counts = Counter((k, weak_pii.votes(t, k, a, b, base), weak_pii.shape(t, a, b)) for t in texts for k, a, b, base in weak_pii.candidates(t))
    model = weak_pii.aggregate(sorted((*key, n) for key, n in counts.items()))
    added = 0
    for text in texts:
        base = weak_pii.base_spans(text)
        expected = list(base)
        for kind, pattern in patterns.items():
            end = 0
            for m in re.finditer(pattern, text):
                a, b = m.span()
                if kind == "secret" and not any(c.isdigit() for c in m.group()) or a < end or any(a < d and c < b for _, c, d in base):
                    continue
                if model.probability(kind, weak_pii.votes(text, kind, a, b, False), weak_pii.shape(text, a, b)) >= model.cut:
                    expected.append((kind, a, b))
                    end = b
        found = weak_pii.find(text, model)
        assert found[0] == base and found[1] == sorted(expected, key=lambda s: (s[1], weak_pii.ORDER[s[0]]))
        added += len(expected) - len(base)
    assert added > 100


def test_votes_see_whole_spans():
    long = "a1" * 400
    assert weak_pii.shape(long + "b" * 4000, 0, 4800) != weak_pii.shape(long, 0, 800)
    assert weak_pii.votes("Mr Foo", "name", 0, 6, False)[3] == "0" and weak_pii.votes("contact Mr Foo", "name", 8, 14, False)[3] == "+"
    assert weak_pii.votes("Dr Anna Foo", "name", 0, 11, False)[2] == "+"


def test_reliabilities_order_votes():
    model = weak_pii.aggregate([("ip", "++00+", "11", 60), ("ip", "0-00-", "11", 40), ("ip", "0+000", "11", 10)])
    assert (model.reliability[1, :2, 2] > model.reliability[0, :2, 2]).all()
    assert model.probability("ip", "++00+", "11") > 0.8 > 0.3 > model.probability("ip", "0-00-", "11")


#: Texts with one candidate each, and whether it is personal data.
LABELLED = [
    ("SSN 000-12-3456 is on file", False), ("his social security 123-45-6789 is on file", True), ("see my-long-url-slug-about-2024-elections now", False), ("part 555-123-4567 in stock", False),
    ("call 555-123-4567 now", True), ("about Mr Green Tea and more", False), ("contact Mr Anna Smith today", True), ("Dear Dr. Paul Foo,", True), ('key = "0fa07e990a1b2c3d4e5f60718293a4b5c6d7e8f9"', True),
    ("iban GB82 WEST 1234 5698 7654 32 please", True), ("type GB82 WEST 1234 5698 7654 33 please", False), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 here", False), ("mail: jane [at] mail [dot] org", True), ("we met Prof Early Morning there", False), ("id 666-12-3456 x", False), ("tel (555) 123-4567", True),
]


@pytest.mark.parametrize("corpus", ["given", "none"])
def test_added_spans_are_personal_data(documents, corpus):
    """With a model from the test documents and with one from hardly any span, false candidates are left out and true ones found."""
    texts = [r.text or "" for r in documents.collect()] if corpus == "given" else ["a@b.com 1.2.3.4"]
    counts = Counter(x for t in texts for x in weak_pii.seen(t))
    model = weak_pii.aggregate(sorted((*key, n) for key, n in counts.items()))
    for text, true in LABELLED:
        base, spans = weak_pii.find(text, model)
        assert not base and len(spans) == true, text
        assert not true or weak_pii.mask(text, spans) != text
    voters = [0, 1, 2, 4]  # cue words never vote against
    assert (model.reliability[0, voters, 0] >= model.reliability[1, voters, 0]).all()
    if corpus == "given":
        false = sum(n for (_, v, _), n in counts.items() if v[0] == "-")
        assert false > 10 and model.reliability[0, 0, 0] > 0.6 and weak_pii.aggregate([]).probability("ssn", "0000-", "00") < 0.5


def test_lookalikes_are_not_candidates():
    text = "on 2024-01-02 id 12345678 at user@host, New York from 4111 1111 1111 1112 or 1.2.3.999 some-joined-words-in-a-slug"
    assert not weak_pii.candidates(text) and {k for k, *_ in weak_pii.lookalikes(text)} == {"ssn", "phone", "email", "name", "card", "ip", "secret"}


def test_licenses_against_all_windows(documents):
    """Notices in texts, altered and wrapped, against the best of all runs of words that hold a template's size bounds."""
    scanner = license_dice.Scanner()

    def apart(runs, ends):
        taken, out = [], []
        for run in runs:
            x, y = ends(run)
            if all(y <= c or e <= x for c, e in taken):
                taken.append((x, y))
                out.append(run)
        return out

    def brute(text):
        every, words = [], license_dice.words_of(text.lower())
        grams = list(zip(words, words[1:], strict=False))
        for t in scanner.templates:
            runs = []
            for i in range(len(grams)):
                same, left = 0, Counter(t.grams)
                for j in range(i, min(len(grams), i + t.most)):
                    if left[grams[j]] > 0:
                        left[grams[j]] -= 1
                        same += 1
                        if (d := 2 * same / (j - i + 1 + t.grams.total())) >= scanner.threshold and grams[i] in t.grams:
                            runs.append((-d, i, j + 2, same))
            every += [(-same, d, x, y, t.name) for d, x, y, same in apart(sorted(runs), lambda r: r[1:3])]
        best = {}
        for _, d, _, _, name in apart(sorted(every), lambda r: r[2:4]):
            n, high = best.get(name, (0, 0))
            best[name] = (n + 1, max(high, round(-d, 9)))
        return sorted((name, n, d) for name, (n, d) in best.items())

    rng = random.Random(4)
    texts = [r.text[:3000] for r in documents.limit(30).collect() if r.text]
    notices = [x for xs in license_dice.TEMPLATES.values() for x in xs]
    for k, notice in enumerate(notices * 2):
        words = notice.split()
        for _ in range(k % 3):
            del words[rng.randrange(len(words))]
        words = ["blah"] * rng.randrange(30) + words + ["foo"] * rng.randrange(30)
        texts.append("".join(w + ("\n * " if i % 11 == 10 else " ") for i, w in enumerate(words)))
    for _ in range(25):  # notices one after the other, whole and in pieces
        words = [w for _ in range(rng.randrange(2, 6)) for w in rng.choice(notices).split()[rng.choice([0, 0, 5]) : rng.choice([None, None, 40])]]
        texts.append(" ".join(words))
    for text in texts:
        assert scanner.scan(text) == brute(text)


def test_many_licences_in_one_file():
    """A file of notices takes time and memory by its length."""
    import time
    import tracemalloc

    scanner, took, peak = license_dice.Scanner(), {}, {}
    for n in (75, 300):
        text = "\n\n".join([license_dice.MIT] * n)
        start = time.perf_counter()
        assert scanner.scan(text) == [("mit", n, 1.0)]
        took[n] = time.perf_counter() - start
        tracemalloc.start()
        scanner.scan(text)
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert took[300] < 10 * took[75] + 0.5 and peak[300] < 60e6
    assert scanner.scan(" ".join(f"{license_dice.BSD_HEAD} {license_dice.BSD_NAME} {license_dice.BSD_TAIL}".split())) == [("bsd-3-clause", 1, 1.0)]
    assert scanner.scan(license_dice.APACHE_NOTICE) == [("apache-2.0", 1, 1.0)]


@pytest.mark.parametrize("name, text", [("mit", "MIT"), ("isc", "ISC"), ("apache-2.0", "APACHE_NOTICE"), ("gpl-3.0", "GPL_NOTICE"), ("unlicense", "UNLICENSE")])
def test_whole_licences_in_files(name, text):
    lines = textwrap.wrap(" ".join(getattr(license_dice, text).split()), 70)
    file = "Copyright (c) 2020 Some Body\n\n" + "\n".join(f"# {x}" for x in lines) + "\n\nimport os\n"
    found = {n: d for n, _, d in license_dice.Scanner().scan(file)}
    assert found[name] == 1.0
    for clauses, parts in (("bsd-2-clause", (license_dice.BSD_HEAD, license_dice.BSD_TAIL)), ("bsd-3-clause", (license_dice.BSD_HEAD, license_dice.BSD_NAME, license_dice.BSD_TAIL))):
        found = {n: d for n, _, d in license_dice.Scanner().scan("\n".join(textwrap.wrap(" ".join(" ".join(parts).split()), 70)))}
        assert found == {clauses: 1.0}


def test_license_edges(hard_docs, no_docs):
    assert license_dice.scan_licenses(hard_docs).count() == 0 and license_dice.scan_licenses(no_docs).count() == 0


def test_wrapped_and_altered_notices(spark):
    scanner = license_dice.Scanner()
    for name, notices in license_dice.TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            for width in (2, 5, 9):
                lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
                assert (name, 1.0) in {(n, d) for n, _, d in scanner.scan("some code\n# " + "\n# ".join(lines) + "\nmore code")}
    altered = "Licensed under the Apache Software License, Version 2.0"
    for text in (altered, f"this file is {altered} and comes with no promise of any kind at all", altered.replace("Software ", "Software\n * ")):
        assert scanner.scan(text) == [("apache-2.0", 1, 0.8)]
        rows = license_dice.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert [tuple(r) for r in rows] == [(1, "apache-2.0", 1, 0.8)]


def test_runs_against_all_of_any_length():
    rng = random.Random(5)
    for name, template in (("x", "a b c a b d e"), ("y", "b c d e f")):
        scanner = license_dice.Scanner({name: [template]}, 0.8)
        for _ in range(300):
            words = [rng.choice("abcdefg") if rng.random() < 0.4 else "abcabde"[k % 7] for k in range(rng.randrange(30))]
            every = [license_dice.dice(license_dice.bigrams(words[i:j]), scanner.templates[0].grams) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
            expected = {name: round(max(every), 9)} if max(every, default=0) >= 0.8 else {}
            assert {n: d for n, _, d in scanner.scan(" ".join(words))} == expected


def test_what_a_worker_has_learnt_is_kept_for_the_same_trees():
    counts = {b"": {97: 3, 98: 1}, b"a": {98: 2}}
    trees, other = {"x": counts}, {"x": dict(counts), "y": {b"": {98: 1}}}
    one = ppm_language.identifier(trees, 4)
    assert one.predict("abab") == ppm_language.Identifier(trees, 4).predict("abab") and one.known
    assert ppm_language.identifier(trees, 4) is one and ppm_language.identifier(other, 4) is not one
    assert ppm_language.identifier(other, 4).languages == ["x", "y"] and ppm_language.identifier(trees, 4).languages == ["x"]
