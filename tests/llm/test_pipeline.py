"""The pipeline stage by stage against plain versions, and the registration."""

import hashlib
import subprocess
import sys

import numpy as np
import pytest

import brute
import corpus_pipeline
import __spark_entry__ as E
from imunis.llm import bpe, decontaminate, exact_dedup, language_id, url_filter

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "12 !?", "en", "s", 5),
                                   (10_004, docs.filter("doc_id = 1").first()["text"].upper(), "en", "s", 9)], docs.schema)
    now = docs.union(extra)
    out = [now.cache()]
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        out.append(now)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontaminate", "bpe"]


def test_columns_are_kept_until_the_last_stage(stages):
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_language_stage_drops_what_has_no_language(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert {10_001, 10_002, 10_003}.isdisjoint(after) and len(after) >= len(before) - 5


def test_exact_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for doc, text in before.items():
        key = text.translate(brute.FOLD)
        best[key] = max(best.get(key, doc), doc)
    assert set(after) == set(best.values()) and 10_004 in after and 1 not in after


def test_near_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(after) == {c for _, _, c in brute.near_groups(before.items(), 5, 80)}


def test_decontamination_stage(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [brute.tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for doc, text in before.items():
        t = brute.tokens(text)
        seeds = {tuple(t[j:j + 5]) for j in range(len(t) - 4)}
        for item in items:
            if 5 * sum(tuple(item[j:j + 5]) in seeds for j in range(len(item) - 4)) >= 0.6 * len(item) and \
                    brute.tiled(item, t, 5) >= 0.6 * len(item):
                bad.add(doc)
    assert set(after) == set(before) - bad


def test_encoding_stage(stages):
    own = bpe.load(bpe.default_vocabulary())
    texts = rows(stages[4])
    got = {r["doc_id"]: r for r in stages[5].collect()}
    assert set(got) == set(texts)
    for doc, r in got.items():
        ids = np.array(r["ids"], "<u4").tobytes()
        assert own.decode(ids) == texts[doc] and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()


def test_run_and_an_empty_table(spark):
    whole = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids"} <= set(whole.columns) and 0 < whole.count() < 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registration():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert E.oracle_sql()["op1_url_filter"] == url_filter.SQL and E.oracle_sql()["op9_exact_dedup"] == exact_dedup.SQL
    assert callable(decontaminate.query) and callable(language_id.query)


def test_the_rest_does_without(tmp_path):
    """Without this subpackage and the pipeline the entry still imports and has the other queries."""
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('imunis.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as E\n"
            "assert 'vacinacoes' in E.queries() and not any(n.startswith('op') and n[2].isdigit() for n in E.queries())\n"
            "assert 'vacinacoes' in E.oracle_sql()\n")
    root = E.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
