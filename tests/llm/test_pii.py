"""PII surrogates: kinds, format, coreference, distinctness, clean texts, odd input."""

import re

import pytest

from imunis.llm import pii

KEY = "test key"


def put(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, kinds string, draw int")
    rows = sorted(pii.replace(df, key).collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], rows


def luhn(number):
    digits = [int(d) for d in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def shape(s):
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s)


@pytest.mark.parametrize("value, kind", [
    ("und.34@mail7.example.com", "email"), ("+1 (017) 555-7713", "phone"), ("(487) 555-7209", "phone"), ("555-123-4567", "phone"),
    ("4111 1111 1111 1111", "card"), ("9807915762804490", "card"), ("123-45-6789", "ssn"), ("GB82 WEST 1234 5698 7654 32", "iban"),
    ("97.51.17.173", "ip"), ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"), ("Mrs. Maria Lopez", "name"),
    ("Herr Klaus Weber", "name"), ("Госпожа Анна Иванова", "name"), ("James Cook", "name"), ("Dr. Lopez", "name"),
])
def test_each_kind_is_replaced_in_its_format(spark, value, kind):
    (text,), (row,) = put(spark, [f"before {value} after"])
    new = re.fullmatch("before (.*) after", text)[1]
    assert row["kinds"] == [kind] and row["n_entities"] == 1 and new != value
    if kind in ("phone", "card", "ssn", "iban", "email"):
        assert shape(new) == shape(value)
    if kind == "card":
        assert luhn(new) == luhn(value)
    if kind == "phone" and value.startswith("+"):
        assert new.startswith("+1 ")
    if kind == "ip":
        assert all(0 <= int(x) < 256 for x in new.split(".")) and new.count(".") == 3
    if kind == "secret":
        assert re.fullmatch("[0-9a-f]{40}", new)
    if kind == "iban":
        assert new[:2] == "GB"
    assert put(spark, [f"before {value} after"], "another key")[0][0] != text


def test_names_keep_title_gender_and_script(spark):
    (a, b, c, d), _ = put(spark, ["Mrs. Maria Lopez", "Herr Peter Lopez", "Госпожа Анна Иванова", "Господин Иван Иванов"])
    assert a.startswith("Mrs. ") and a.split()[1] in pii.SURROGATE_GIVEN["latin", "f"]
    assert b.startswith("Herr ") and b.split()[1] in pii.SURROGATE_GIVEN["latin", "m"]
    assert a.split()[2] == b.split()[2]  # one surname, one surrogate
    assert c.split()[1] in pii.SURROGATE_GIVEN["cyrillic", "f"] and c.endswith("ва")
    assert d.split()[1] in pii.SURROGATE_GIVEN["cyrillic", "m"] and d.endswith("в")


def test_coreference_over_spellings_and_documents(spark):
    (a, b, c), _ = put(spark, ["Maria.Lopez@Mail7.example.com and 4111 1111 1111 1111", "MARIA.LOPEZ@MAIL7.EXAMPLE.COM, 4111111111111111",
                               "Dr. Lopez met Mrs. Lopez. DR. LOPEZ"])
    assert a.split()[0].lower() == b.split(",")[0].lower() and b.isupper()
    assert a.split(" and ")[1].replace(" ", "") == b.split(", ")[1]
    assert c.split()[1] == c.split()[4].strip(".")


def test_spellings_of_a_number_and_of_a_surname_share_a_surrogate(spark):
    (a, b, c, d, e, f), _ = put(spark, ["+49 30 1234567", "+49301234567", "+49 (301) 234-567", "Dr Иванова, Госпожа Иванова",
                                        "Анна Smith, Mr Smith", "493-012-3456 or +4930123456"])
    digits = [re.sub(r"\D", "", x) for x in (a, b, c)]
    assert len(set(digits)) == 1 and digits[0].startswith("49") and a.startswith("+49 ") and digits[0] != "49301234567"
    assert [shape(x) for x in (a, b, c)] == ["+99 99 9999999", "+99999999999", "+99 (999) 999-999"]
    assert d.split(", ")[0].split()[-1] == d.split()[-1] and d.endswith("ва")
    assert e.split(", ")[0].split()[-1] == e.split()[-1]
    national, international = f.split(" or ")  # two numbers, though of the same digits
    assert international.startswith("+49") and re.sub(r"\D", "", national) != international[1:]


def test_names_are_found_by_context_and_shape(spark):
    texts = ["a letter from Max Weber to all", "we met Robin Smith and Mr Robin Smith", "JAMES COOK sailed", "call 030 1234567 now",
             "then Mr. James  Cook came", "Uta Maier said so", "Ich bin Uwe Kranz, hallo", "Dr Robin Smith or Mr Robin Smith"]
    new, rows = put(spark, texts)
    left = [w for w, t in (("Weber", new[0]), ("Smith", new[1]), ("Robin", new[1]), ("COOK", new[2]), ("1234567", new[3]), ("Cook", new[4]),
                           ("Maier", new[5]), ("Kranz", new[6]), ("Smith", new[7])) if w in t]
    assert not left, new
    assert [r["n_entities"] for r in rows] == [1, 2, 1, 1, 1, 1, 1, 2]
    assert new[2].split()[0].isupper() and shape(new[3]) == shape(texts[3])
    met = new[1].removeprefix("we met ").split(" and Mr ")
    assert met[0] == met[1]
    by_title = re.fullmatch("Dr (.*) or Mr (.*)", new[7]).groups()
    assert by_title[0] == by_title[1] == met[0]


def test_clean_texts_are_left_alone(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3.", "Chapter 12, 1998-06-01, 3.14 and 1.2.3",
             "1 234 567", "a@b", "@ home", "user@", "Erbeer. Dem Kurt", "12:30:45", "v1.2.3.4.5", "Mr", "0123456789ab", "", " ",
             "This work is licensed under the GNU General Public License, version 3.", "All Rights Reserved by the Author",
             "Onthre | Inthe Ofre | Thand", "Er ist. Dem Kurt Haus ist alt", "from Monday to Friday", "Version 020 of 12-34567"]
    assert put(spark, texts)[0] == texts


def test_distinct_entities_stay_distinct(spark):
    """Addresses are the smallest space: with 30,000 of them surrogates do clash, and are drawn again."""
    ips = [f"{i % 200 + 1}.{i // 200}.7.9" for i in range(30_000)]
    texts = [" ".join(ips[i:i + 100]) for i in range(0, len(ips), 100)]
    mentions = pii.entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert pii.draws(mentions, KEY).count() >= 0
    new = [x for t in put(spark, texts)[0] for x in t.split()]
    assert len(new) == len(set(new)) == 30_000 and not set(new) & set(ips)


def test_given_names_under_one_surname_stay_distinct(spark):
    """More given names of a gender than there are surrogates of one part."""
    men, women = ([n for n in pii.GIVEN[g] if n.isascii()] for g in "mf")
    people = [f"{n} Smith" for n in men + women] + [f"Mr {n} Smith" for n in ("Xaver", "Yorick", "Zeno")] + ["Mr James Jones"]
    texts = [f"{p} met {q}" for p, q in zip(people, people[1:] + people[:1])] + ["Mr James Smith"]
    new, _ = put(spark, texts)
    of = dict(zip(people, (t.split(" met ")[0] for t in new)))
    assert len(set(of.values())) == len(people)
    assert all(t.split(" met ")[1] == of[q] for t, q in zip(new, people[1:] + people[:1]))
    assert new[-1] == f"Mr {of['James Smith']}" and of["James Smith"].split()[0] == of["Mr James Jones"].split()[1]
    for g, names in (("m", men), ("f", women)):
        assert all(set(of[f"{n} Smith"].split()[0].split("-")) <= set(pii.SURROGATE_GIVEN["latin", g]) for n in names)


def test_a_surrogate_is_no_given_name_of_the_corpus(spark):
    people = [f"Mr {n} Adler" for n in pii.SURROGATE_GIVEN["latin", "m"]]
    new, _ = put(spark, people)
    given = [t.split()[1].lower() for t in new]
    assert len(set(given)) == len(people) and not {p.split()[1].lower() for p in people} & set(given)


def test_clashes_are_drawn_again(spark, monkeypatch):
    real = pii.surrogate

    def narrow(m, key, draw):  # two values for the first draw
        from pyspark.sql import functions as F
        return F.when(draw == 0, F.concat(F.lit("1.1.1."), F.pmod(F.xxhash64(m), F.lit(2)).cast("string"))).otherwise(real(m, key, draw))

    monkeypatch.setattr(pii, "surrogate", narrow)
    ips = [f"9.9.9.{i}" for i in range(40)] + ["1.1.1.0"]
    texts = [f"{a} and {b}" for a in ips[:6] for b in ips] + ["nothing"]
    new, _ = put(spark, texts)
    pairs = {}
    for old, text in zip(texts, new):
        for x, y in zip(old.split(" and "), text.split(" and ")):
            assert pairs.setdefault(x, y) == y
    pairs.pop("nothing", None)
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


def test_odd_rows_and_plan(spark):
    df = spark.createDataFrame([(1, None), (None, "+1 (017) 555-7713"), (2, "+1 (017) 555-7713"), (2, "+1 (017) 555-7713"),
                                (3, "w" * 1_000_000 + " a.b@c.de " + "9" * 200_000 + "." * 100_000)], "doc_id long, text string")
    rows = pii.replace(df, KEY).collect()
    assert len(rows) == 5 and {r["n_entities"] for r in rows if r["doc_id"] == 1} == {0}
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert len({r["text"] for r in rows if r["doc_id"] in (2, None)}) == 1
    assert "a.b@c.de" not in next(r["text"] for r in rows if r["doc_id"] == 3)
    assert pii.replace(df.limit(0), KEY).count() == 0
    plan = pii.replace(df, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_whole_table_keeps_no_original(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{40}\b")
    seen = 0
    for r in pii.query(spark, sf).collect():
        found = plain.findall(docs[r["doc_id"]])
        seen += len(found)
        assert not any(x in r["text"] for x in found)
        assert r["n_entities"] >= len(found) and (r["n_entities"] or r["text"] == docs[r["doc_id"]])
    assert seen > 50
