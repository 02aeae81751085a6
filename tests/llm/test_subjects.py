"""Subjects of documents on made-up pages whose words tell their subject."""

import random

import numpy as np
from pyspark.sql import SparkSession

from meshloom.llm import subjects

WORDS = {"law": "judge court lease bail notary".split(), "music": "flute opera chord libretto violin".split(), "food": "soup bread oven spice dough".split()}


def sentence(rng, subject):
    a, b = rng.choice(WORDS[subject]), rng.choice(WORDS[subject])
    return rng.choice([f"Unlike the {a}, the {b} remains plain.", f"In 1900 each {a} needed a {b}."])


def test_units_are_sentences_and_table_rows():
    text = "== Head ==\nOne line\nwrapped here. Two <ref>Not this. Nor this.</ref> words!\r\n\r\n{| class=\"x\"\n! Name !! Kind\n|-\n| A || oven || 3\n|}\n[[Category:Law]]"
    assert [" ".join(u.split()) for u in subjects.units(text)] == ["One line wrapped here.", "Two words!", "! Name !! Kind", "| A || oven || 3"]
    assert subjects.units(None) == subjects.units("") == subjects.units("#REDIRECT [[Oven]]") == subjects.units("#Redirect: [[Oven]]") == []


def test_subjects_of_whole_documents():
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    rng = random.Random(1)
    names = sorted(WORDS)
    rows, labels = [], []
    for k in range(120):
        s = names[k % 3]
        rows.append((k, " ".join(sentence(rng, s) for _ in range(8)) + f" Opinions differ.\n[[Category:{s.title()} pages]]"))
        if k % 10 == 0:
            labels.append((k, s))
    say = lambda s, n: " ".join(sentence(rng, s) for _ in range(n))
    rows += [
        (1000, say("law", 300) + "\n\n" + say("food", 200)),  # the second subject starts beyond what a fit reads
        (1001, say("law", 30) + " " + say("music", 3) + "\n[[Category:Music pages]]"),  # less than a fifth
        (1002, "#REDIRECT [[Court]]"),
        (1003, None),
        (1004, "  "),
        (1005, "Opinions differ. Nothing is said."),
        (1006, "{|\n| A || flute || 1\n|-\n| B || opera || 2\n|}"),
    ]
    assert len(say("law", 300)) > subjects.FIT_CHARS
    got = subjects.dealt_with(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(s, "") for s in names], "subject string, about string"),
        spark.createDataFrame(labels, "doc_id long, subject string"),
    ).collect()
    assert {tuple(r) for r in got if r.doc_id >= 1000} == {(1000, "law"), (1000, "food"), (1001, "law"), (1006, "music")}
    assert {tuple(r) for r in got if r.doc_id < 1000} == {(k, names[k % 3]) for k in range(120)}
    assert len(got) == len(set(got))


def test_fit_reads_whole_texts():
    """Words, categories and marks that stand beyond the first characters of long texts, and a long run of blanks."""
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    rng = random.Random(2)
    names = sorted(WORDS)
    preface = "Opinions differ here. " * 400
    assert len(preface) > subjects.FIT_CHARS
    tell = lambda s: " ".join(sentence(rng, s) for _ in range(8))
    rows = [(k, f"{preface}{tell(names[k % 3])}\n[[Category:{names[k % 3].title()} pages]]") for k in range(60)]
    rows += [(100 + k, preface + tell(names[k % 3])) for k in range(9)]
    rows += [(200, "{{" + " " * 200_000 + "\n" + tell("food")), (201, tell("law")), (202, tell("music"))]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(100 + k, names[k % 3]) for k in range(9)], "doc_id long, subject string")
    got = subjects.dealt_with(documents, spark.createDataFrame([(s, "") for s in names], "subject string, about string"), labels).collect()
    assert sorted(map(tuple, got)) == [*((k, names[k % 3]) for k in range(60)), *((100 + k, names[k % 3]) for k in range(9)), (200, "food"), (201, "law"), (202, "music")]
    picked = subjects.sample(documents, labels, names)
    assert picked == {**{k: (frozenset([k % 3]), False) for k in range(60)}, **{100 + k: (frozenset([k % 3]), True) for k in range(9)}}
    read = list(subjects.sampled(documents, picked))
    texts = dict(rows)
    assert [(of, by, chars, len(sizes), len(buckets)) for of, by, chars, sizes, buckets in read] == [
        (*picked[k], len(texts[k]), len(subjects.units(texts[k])), len(subjects.features(subjects.units(texts[k]))[0])) for k in sorted(picked)
    ]


def test_fit_in_parts(monkeypatch):
    """The same model where features wait in files and are read in many parts."""
    rng = random.Random(3)
    docs = []
    for k in range(90):
        found = [sentence(rng, sorted(WORDS)[k % 3]) for _ in range(k % 7)] + ["Opinions differ."] * (k % 2)
        bucket, row = subjects.features(found)
        docs.append((frozenset([k % 3]), k % 5 == 0, 100 * k, np.bincount(row, minlength=len(found)), bucket[np.argsort(row, kind="stable")]))
    whole = subjects.fit(docs, 3)
    monkeypatch.setattr(subjects, "PART_FEATURES", 50)
    monkeypatch.setattr(subjects, "SPOOL_BYTES", 100)
    parts = subjects.fit(iter(docs), 3)
    assert len(whole.weights) > 10 and abs(whole.weights).max() > 1
    assert (whole.slot == parts.slot).all() and (whole.thresholds == parts.thresholds).all()
    np.testing.assert_allclose(parts.weights, whole.weights, rtol=1e-3, atol=1e-3)
    np.testing.assert_allclose(parts.bias, whole.bias, rtol=1e-3, atol=1e-3)
