import os
import sys

import pytest
from llm_fixtures import documents, empty, sentence
from pyspark.sql import functions as F

from test_decontaminate import brute as brute_hits
from test_packing import check_plan
from test_simhash import brute_components, brute_fingerprint
from test_suffix_dedup import brute as brute_repeats

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = spark.conf.get("spark.checkpoint.dir") + f"/pipeline-test-{name}-{os.getpid()}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(folder)
        before, docs = docs, spark.read.parquet(folder)
        out.append((name, before, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_dedup", "suffix_dedup", "decontaminate", "pack"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    labels = rows(spark.read.parquet(f"{SF}/labels.parquet"))
    kept, given = rows(after), rows(before)
    assert all(kept[i] == given[i] for i in kept)
    good = [i for i in labels if labels[i].quality == 1]
    bad = [i for i in labels if labels[i].quality == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i not in kept for i in bad) >= 0.7 * len(bad)


def test_one_of_each_near_duplicate_group_stays(stages):
    _, before, after = stages[1]
    given = [(r.doc_id, brute_fingerprint(r.text)) for r in before.collect()]
    assert sorted(rows(after)) == sorted(set(brute_components(given)))


def test_repeated_passages_are_cut_to_whole_characters(stages):
    _, before, after = stages[2]
    given, got = [(r.doc_id, r.text) for r in before.collect()], rows(after)
    for (i, text), (_, removed, _, kept) in zip(given, brute_repeats(given)):
        assert got[i].n_chars == len(got[i].text)
        if kept.decode(errors="ignore").encode() == kept:
            assert len(got[i].text.encode()) >= len(kept)
        if not removed:
            assert got[i].text == text


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[3]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(rows(after)) == sorted(r.doc_id for r in before.collect() if not brute_hits(r.text, items)[3])


def test_packing_holds_every_document(stages):
    _, before, after = stages[4]
    packed = after.collect()
    check_plan(packed, 1024)
    assert {r.doc_id for r in packed} == set(rows(before))


def test_awkward_and_empty_tables_pass_every_stage(spark):
    plain = [(i, sentence(i, 50)) for i in range(20)]
    texts = [*plain, (20, plain[0][1]), (21, None), (22, ""), (None, sentence(99, 30)), (5, plain[5][1])]
    for docs in (documents(spark, texts), empty(spark)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "_row", "rank", "hash", "score")
        docs = docs.withColumns({c: F.lit("x") for c in ("_key", "_hash", "_id", "_n", "row", "key")}).withColumns({
            "whole": F.lit(1), "list": F.array(F.lit("a")), "map": F.create_map(F.lit("k"), F.lit(2)), "at": F.current_timestamp(),
        })
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES:
            folder = spark.conf.get("spark.checkpoint.dir") + f"/awkward-{os.urandom(4).hex()}"
            stage(spark, docs, SF).write.parquet(folder)
            given, docs = docs, spark.read.parquet(folder)
        assert given.columns == names and dict(given.dtypes)["map"] == "map<string,int>"
        docs.count()
