import os
import re
import subprocess
import sys

import pytest

import corpus_pipeline
from quire.llm import jaccard_join, packing, quality_classifier, quality_rules, secrets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "secret_scans", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_rules_and_classifier_reject_what_they_judge_bad(spark, stages):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    for (before, after), module in zip(stages, (quality_rules, quality_classifier), strict=False):
        model = module.train(docs, labels)
        judged = {r["doc_id"]: r["keep"] for r in module.judged(before, model).collect()}
        assert set(rows(after)) == {k for k, keep in judged.items() if keep}
        assert all(after_row == rows(before)[k] for k, after_row in rows(after).items())


def test_one_document_of_each_near_group_stays(stages):
    from test_jaccard_join import brute

    before, after = stages[2]
    kept = sorted((r["doc_id"], r["text"]) for r in before.collect())
    gone = {kept[i][0] for v in brute(kept).values() for i in v[1:]}
    assert rows(after) == {k: r for k, r in rows(before).items() if k not in gone}
    assert not brute(sorted((r["doc_id"], r["text"]) for r in after.collect()))


def test_secrets_are_gone(stages):
    before, after = stages[3]
    for k, r in rows(before).items():
        want = re.sub(r"\b[0-9a-f]{40}\b", secrets.REDACTED, r["text"])
        assert rows(after)[k]["text"] == want and rows(after)[k]["n_chars"] == len(want)


def test_packs_hold_every_document(stages):
    from test_packing import brute

    before, after = stages[4]
    got = [(r["pack_id"], r["pack_offset"], r["doc_id"], r["doc_offset"], r["n_tokens"]) for r in after.collect()]
    assert sorted(got) == sorted(brute(packing.placed(before).collect(), packing.CAPACITY))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0, name
        got = stage(spark, odd, SMALL)
        assert got.count() >= 0 and (name == "packing" or got.columns == odd.columns)


def test_nothing_else_needs_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", root, str(copy)], check=True)
    subprocess.run(["rm", "-r", str(copy / "quire/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_no_import_error_is_swallowed(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", root, str(copy)], check=True)
    (copy / "quire/llm/packing.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr


def test_jaccard_parameters_are_those_of_the_query():
    assert (jaccard_join.N, jaccard_join.THRESHOLD) == (3, 0.6)
