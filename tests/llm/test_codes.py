"""Vector codes against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiset.llm import orchard_codes as oc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """(vec_id, code, error, label_error, digest) of all rows by the rule, every distance computed."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = sorted(((i, v + [0] * (8 * size - len(v)), y) for i, v, y in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(8)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))
    for _ in range(6):
        codes = [[near(p, c[p])[1] for p in range(8)] for c in cut]
        new = [list(b) for b in books]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if mine:
                    new[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
        books = new
    found = [[near(p, c[p]) for p in range(8)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {y: sum(e for e, r in zip(errors, kept, strict=True) if r[2] == y) for y in {r[2] for r in kept}}
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, bytes(e for _, e in f).hex(), d, of_label[y], digest) for (i, _, y), f, d in zip(kept, found, errors, strict=True)), key=repr)


def found(df):
    rows = oc.quantised(df)
    books = oc.fit(rows)
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error, oc.books_digest(books)) for r in oc.with_label_errors(oc.encode(rows, books)).collect()), key=repr)


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 5), (3, 2), (16, 2), (16, 40)):
        books = rng.integers(-spread, spread + 1, (8, k, 3))
        x = rng.integers(-spread - 2, spread + 3, (500, 8, 3))
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        codes, best = oc.Search(books).nearest(x)
        assert (codes == d.argmin(2)).all() and (best == d.min(2)).all()


def test_search_passes_over_far_entries(monkeypatch):
    """With entries in clusters the walk computes a part of all distances only."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-30_000, 30_000, (8, 16, 8))
    x = (centres[np.arange(8), rng.integers(0, 16, (400, 8))] + rng.integers(-500, 500, (400, 8, 8)))
    computed = []
    class Books(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and len(key) == 2 and isinstance(key[1], np.ndarray):
                computed.append(len(key[1]))
            return np.asarray(self).__getitem__(key)
    search = oc.Search(centres)
    search.books = centres.view(Books)
    codes, _ = search.nearest(x)
    assert (codes == ((x[:, :, None] - centres[None]) ** 2).sum(3).argmin(2)).all()
    assert sum(computed) < 0.75 * 400 * 8 * 15


def test_codes_are_those_of_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=16), 2)], int(i) % 3 if i % 5 else None) for i in rng.permutation(120)]
    rows += [(7, rows[0][1], 1), (None, rows[1][1], None), (500, None, 1), (501, [float("nan")] * 16, 1), (502, [None] + [0.0] * 15, 1), (503, [float("inf")] * 16, 2), (504, [1.0], 2), (505, [], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(df)
    assert got == brute(rows) and len(got) == 124
    assert found(df.withColumns({c: F.lit("x") for c in ("code", "q", "error", "slot", "a b")})) == got


def test_few_and_no_vectors(spark, monkeypatch):
    rows = [(3, [0.5] * 8, None), (1, [-0.25] * 8, 2), (2, [0.5] * 8, 2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)) == brute([(1, [], 1), (2, [], None)])
    assert found(spark.createDataFrame([], SCHEMA)) == [] == found(spark.createDataFrame([(1, None, 1)], SCHEMA))
    with pytest.raises(Exception, match="in size"):
        found(spark.createDataFrame([(1, [9000.0] * 8, 1)], SCHEMA))
    monkeypatch.setattr(oc, "FEW_LABELS", 0)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_codes_decode_to_near_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = oc.quantised(e)
    books = oc.fit(rows)
    coded = {r.vec_id: r for r in oc.encode(rows, books).collect()}
    for r in e.collect():
        back = oc.decode(np.frombuffer(coded[r.vec_id].code, np.uint8)[None], books)[0]
        whole = np.floor(4096 * np.array(r.embedding, float))
        assert ((whole - back * 4096) ** 2).sum() == coded[r.vec_id].error
