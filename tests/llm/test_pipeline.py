"""The pipeline's stages, each on what the one before kept, against brute force."""

import corpus_pipeline
import pytest

from lumiset.llm import chained_substrings, packing, weak_pii
from test_duplicates import classes
from test_tokens import check_packed

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_toxic_documents_go(stages, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = lambda df: df.join(labels.where("toxic = 1"), "doc_id").count()
    assert toxic(stages[1]) <= 0.5 * toxic(stages[0])
    assert stages[1].count() >= 0.7 * stages[0].count()


def test_one_of_each_group_stays(stages):
    group, _ = classes({r.doc_id: r.text for r in stages[1].collect()}, 5, 80)
    assert {r.doc_id for r in stages[2].collect()} == {i for i, g in group.items() if i == g}


def test_no_passage_is_left_twice(stages):
    assert stages[3].count() == stages[2].count()
    seen = {}
    for r in sorted(stages[3].collect(), key=lambda r: r.doc_id):
        words = chained_substrings.words_of(r.text or "")
        for k in range(len(words) - 60):
            assert seen.setdefault(tuple(words[k : k + 60]), r.doc_id) == r.doc_id


def test_personal_data_is_masked(stages):
    assert all(not weak_pii.base_spans(r.text or "") for r in stages[4].collect())


def test_packed(stages):
    check_packed(stages[5].collect(), stages[4].select("doc_id", "text").collect(), packing.WINDOW)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[5].count()


def test_edges(spark, hard_docs, no_docs, tmp_path):
    """Nulls, empty texts, rows that repeat an id and a copy: only the copy goes, and every row that stays is packed."""
    for name, start in (("hard", hard_docs), ("none", no_docs)):
        docs, ids = start, []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
            ids.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
            assert docs.columns == start.columns or k == 4
        if name == "none":
            assert ids == [[]] * 5
            continue
        assert ids[0] == [1, 1, 2, 3, 4, 5, 6, 7, None]
        assert ids[1] == ids[2] == ids[3] == [1, 1, 2, 3, 4, 5, 7, None] and set(ids[4]) == {1, 2, 3, 4, 5, 7, None}
        left = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "hard-3")).collect()}
        assert left[2].text is None and left[3].text == "" and left[5].text == hard_docs.where("doc_id = 5").first().text
        assert left[1].score == left[1].key == "other"
