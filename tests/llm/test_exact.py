"""Exact duplicates against a dictionary."""

import hashlib
import string
from collections import defaultdict

import pytest

from lumiset.llm import digest_merge

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(docs, **more):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in digest_merge.groups(docs, **more).collect()), key=repr)


@pytest.mark.parametrize(("bits", "round_bits"), [(1, 3), (4, 1), (5, 3)])
def test_groups_are_those_of_a_dictionary(spark, documents, bits, round_bits):
    docs = documents.select("doc_id", "text").repartition(7)
    assert found(docs, bits=bits, round_bits=round_bits) == brute(docs.collect())


def test_copies_that_fill_the_table(spark, monkeypatch):
    monkeypatch.setattr(digest_merge, "RUN_BITS", 3)  # runs of eight rows: copies lie in all cells
    rows = [(i, ("Same Text" if i % 3 else "SAME tEXT") if i % 10 else f"text {i}") for i in range(900)] + [(None, "same text"), (None, "lone"), (None, "lone"), (1005, "Ä"), (1006, "ä"), (1007, "ÄA"), (1008, "Äa"), (1009, None), (1010, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = found(docs)
    assert got == brute(docs.collect())
    assert sum(r[3] for r in got if r[2] > 100) == 1 and {r[:4] for r in got if (r[0] or 0) in (1005, 1006, 1007, 1008)} == {(1005, 1005, 1, True), (1006, 1006, 1, True), (1007, 1008, 2, False), (1008, 1008, 2, True)}


def test_hard_rows(spark, hard_docs, no_docs):
    assert found(hard_docs) == brute(hard_docs.collect())
    assert digest_merge.groups(no_docs).count() == 0 and digest_merge.drop_copies(no_docs).count() == 0
    stay = digest_merge.drop_copies(hard_docs)
    assert stay.columns == hard_docs.columns
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == sorted([1, 1, None, 3, 4, 6, 7], key=repr)


def test_main_path_has_no_python(spark):
    plan = digest_merge.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
