"""Leaked passages: the readers' text, and the automaton against comparing every window."""

import pytest
from pyspark.sql import SparkSession

from meshloom.llm import leaks, wikitext

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
ITEMS = ((1, " ".join(WORDS)), (2, "Zero " + " ".join(WORDS[:13]) + "."), (3, "too short " * 3))


@pytest.mark.parametrize(
    ("text", "seen"),
    [
        ("a<!-- x -->b <ref name=q>hidden {{cite|x}}</ref>c<ref name=q />d", "ab c d"),
        ("{{Infobox|a={{b|c}}|d}}after {{unclosed thing", "after unclosed thing"),
        ("[[Target page|the label]]s [[plain]]s [[File:A.png|thumb|cap [[x|y]]]] [[Category:Q]]", "the labels plains cap y"),
        ("'''Bo'''ld wo­rd z​ero&nbsp;x &amp; café [https://a.b/c shown]", "bold word zero x café shown"),
        ('{| class="wikitable"\n|-\n| align="left" | one || two\n|}', "one two"),
        ("so â\u0080\u0093 only snake_case <br/>x", "so only snake case x"),
    ],
)
def test_words_are_what_a_reader_sees(text, seen):
    assert " ".join(wikitext.words(text)) == seen


@pytest.mark.parametrize("text", ["", "İstanbul &amp;&nbsp;caf&eacute; ﬁne ½ e\u0301te\u0301", "[[A|b]] {{x}}c &lt;d&gt; ''e'' so â\u0080\u0093 f", "a<ref>z</ref>b<br/>c", "{| class=x\n| width=3 | one || two\n|}"])
def test_placed_words_are_the_words(text):
    placed = wikitext.placed_words(text)
    assert [w for w, _, _ in placed] == wikitext.words(text)
    assert all(0 <= a < b <= len(text) for _, a, b in placed) and [a for _, a, _ in placed] == sorted(a for _, a, _ in placed)


def test_found_in_agrees_with_every_window():
    for a in range(4):
        for b in range(10, 15):
            text = "zero " + " ".join(WORDS[a:b]) + " end " + " ".join(WORDS[5:])
            w = wikitext.words(text)
            windows = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
            want = {i for i, t in ITEMS if any(tuple(x[k : k + 13]) in windows for x in [wikitext.words(t)] for k in range(len(x) - 12))}
            assert set(leaks.found_in(text, ITEMS)) == want


def test_leaked_reads_whole_texts_and_skips_nulls():
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    long = "filler " * 50_000 + " ".join(WORDS[:6]) + "<ref>zzz</ref> [[T|" + WORDS[6] + "]] " + " ".join(WORDS[7:])
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, " ".join(WORDS[:12])), (5, " ".join(WORDS[:13]))], "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, (9, None)], "item_id long, text string")
    got = leaks.leaked(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.word_no) for r in got) == [(1, 1, 50_000), (1, 2, 50_000), (5, 1, 0), (5, 2, 0)]
    texts = {1: long, 5: " ".join(WORDS[:13])}
    # The places lie in the text as given, with its markup.
    assert all(texts[r.doc_id][r.start_at : r.end_at].startswith("alpha") and texts[r.doc_id][r.start_at : r.end_at].endswith("nu") for r in got)
    assert leaks.leaked(docs, items.limit(0)).count() == 0
