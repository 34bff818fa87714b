"""Language ID: held-out accuracy, what may be learnt from, odd input."""

import random
import zlib

import numpy as np
import pytest

from imunis.llm import language_id as li

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs)


def test_held_out_accuracy_and_calibration(docs, model):
    rows = li.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert np.mean([r["accepted"] for r in rows]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Calibrated: the mean score is close to the share of right answers.
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang"] == r["lang_pred"] for r in held])) < 0.05


def test_held_out_labels_are_not_learnt_from(spark, docs, model):
    spoilt = docs.selectExpr("doc_id", "text", "source", "n_chars",
                             "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    other = li.fit(spoilt)
    assert other.langs == model.langs and np.array_equal(other.table, model.table)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (None, "the and of this is with"), (5, "the and of this is with"),
            (5, "the and of this is with"), (6, "½ ²"), (7, "ﬁ"), (8, "die und der ist " * 200_000)]
    df = spark.createDataFrame([(d, t, "en", 0.0) for d, t in rows], "doc_id long, text string, lang string, score double")
    got = li.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and not by[i]["accepted"] for i in (1, 2, 3, 6))
    assert by[7]["lang_pred"] != "und"  # a letter, if a rare one
    assert by[None]["held_out"] is False and by[None]["lang_pred"] == "en"
    assert by[8]["lang_pred"] == "de"
    assert li.predict(df.limit(0), model).count() == 0
    kept = li.identified(df, model)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect() if r["doc_id"] not in (7,)) == \
        sorted(["None", "5", "5", "8"])


def test_long_texts_are_counted_like_short_ones():
    rng = random.Random(3)
    text = "".join(rng.choice("abc éΣσ ß.1日") for _ in range(5000))
    whole = li.subword_counts([text])
    for size in (1, 2, 3, 7, 1000, 4999, 5000, 10_000):
        assert np.array_equal(li.long_counts([text], size), whole)
    assert np.array_equal(li.long_counts([text, "x"], 10), li.subword_counts([text, "x"]))


def test_rejects_gibberish_and_other_scripts_and_keeps_the_corpus(spark, docs, model):
    rng = random.Random(1)
    bad = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(40)]
    bad += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(60))
            for letters in ("αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшыэюя", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "あいうえおかきくけこさしすせそ") for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")
    assert sum(r.accepted for r in li.predict(df, model).collect()) <= 1
    assert li.identified(docs, model).count() >= 0.999 * docs.count()


def test_any_number_of_languages(spark):
    """400 labels; each keeps rows in the sample, and the sample its bound."""
    df = spark.createDataFrame([(i, f"w{i % 400} text", f"l{i % 400}") for i in range(8000)], "doc_id long, text string, lang string")
    assert len(li.fit(df, rows=1200).langs) >= 380
    assert len(li.fit(df, rows=50).langs) <= 50


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(2, "the", None), (None, "the", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    assert li.fit(df) is None
    assert {r["lang_pred"] for r in li.predict(df, None).collect()} == {"und"}
    assert li.identified(df, None).count() == 0
    one = spark.createDataFrame([(i, "the and of", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.predict(one, li.fit(one)).collect()} == {"en"}


def test_sample_keeps_rare_languages(spark, monkeypatch):
    """Eleven languages of 600 rows and one of 60, all of them more than a language's share."""
    langs = [f"l{k:02}" for k in range(11) for _ in range(600)] + ["rare"] * 60
    df = spark.createDataFrame([(i, f"{x} word text", x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    seen = []
    real = li.train
    monkeypatch.setattr(li, "train", lambda x, labels, names, use: seen.append((labels, names)) or real(x, labels, names, use, epochs=1))
    li.fit(df, rows=300)
    (labels, names), = seen
    counts = dict(zip(names, np.bincount(labels, minlength=len(names)).tolist()))
    assert sum(counts.values()) == 900 and len(counts) == 12
    assert counts["rare"] > 0.6 * 900 / 12


def test_rejection_threshold_keeps_right_answers():
    rng = np.random.default_rng(1)
    m = li.Model(["a", "b"], rng.normal(0, 4, (li.BUCKETS, 2)), np.zeros(2))
    counts = rng.poisson(0.05, (400, li.BUCKETS)).astype(float)
    labels = m.scores(counts).argmax(1)
    li.calibrate(m, counts, labels, rejected=0.01)
    p = m.scores(counts)
    assert 0 < np.mean(p.max(1) < m.threshold) <= 0.011  # all are right, and a hundredth goes
