"""Every light-curve query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from lumiset.plans import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def tidy(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: ("nan" if math.isnan(x) else round(x, 6) + 0.0) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    result = db.execute(Q.SQL[name])
    expected = tidy(result.fetchall(), [c[0] for c in result.description])
    assert tidy([tuple(r) for r in df.collect()], df.columns) == expected


#: What each result without SQL must be, besides what test_operators.py shows on small tables.
MODELS = {
    "m4_train_window_classifier": lambda x: x.score.between(0, 1).all() and x.groupby("star_id").split.nunique().max() == 1 and set(x.split) == {"train", "val", "test"} and x.test_auc.nunique(dropna=False) == 1 and x.score[(x.label == 1) & (x.split != "train")].mean() > x.score[(x.label == 0) & (x.split != "train")].mean(),
    "m8_pca2d": lambda x: len(x) and (x[["x", "y"]] >= 0).all().all() and x.x.std() > 0,
    "m10_smooth_scores": lambda x: x.r2.nunique() == 1 and x.r2.between(-1, 1).all() and abs((x.split == "test").mean() - 0.2) < 0.01 and 0 < x.above_cut.sum() <= 0.02 * len(x) + 1 and x.smooth[x.above_cut == 1].min() >= x.smooth[x.above_cut == 0].max(),
    "m11_binary_embedding_classifier": lambda x: x.probability.between(0, 1).all() and set(x.split) == {"train", "val", "test"} and abs((x.split == "test").mean() - 0.15) < 0.02,
    "m12_anomaly_scores": lambda x: x.outlier_score.between(0, 1).all() and 0 < x.flag.sum() <= 0.02 * len(x) + 1 and x.outlier_score[x.flag == 1].min() >= x.outlier_score[x.flag == 0].max(),
    "m13_weird_stars": lambda x: len(x) == 20 and x.vec_id.is_unique and x.outlier_score.between(0, 1).all(),
    "m14_star_anomalies": lambda x: len(x) and x.star_id.is_unique and x.outlier_score.between(0, 1).all(),
    "m14_star_anomalies_on_self": lambda x: len(x) and x.star_id.is_unique and x.outlier_score.between(0, 1).all(),
    "p9_embedding_report": lambda x: set(x.part) == {"health", "pooled", "loose_scores", "smooth", "classifier", "components", "weird", "nearest"} and len(x[x.part == "nearest"]) == 15 and len(x[x.part == "weird"]) == 20 and x.value.notna().all(),
}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_models(spark, name):
    assert MODELS[name](Q.QUERIES[name](spark, DATA).toPandas())
