"""Token ids by recursive merges, against the library's own encoder."""

import public_tokenizers
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from meshloom.llm import tokens

TEXTS = [
    "Hello world, it's 1234 o'clock.  \n\n\tx",
    "<|endoftext|> is text",
    "aaaa aaaaa " + "a" * 301 + "=" * 77,
    "日本語のテキスト é Straße \U0001f468‍\U0001f469  　 \x1c\x1d\x85 x",
    "",
    None,
    "   ",
    "\r\n\r\n",
]


def encoder():
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    t.encode_special_tokens = True
    return t


def test_ids_agree_with_the_library():
    t = encoder()
    want = [t.encode(x, add_special_tokens=False).ids if x else [] for x in TEXTS]
    assert [list(x) for x in tokens.Merger().encode(TEXTS)] == want


def test_every_document_has_a_row():
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    t = encoder()
    got = dict(map(tuple, tokens.token_ids(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()))
    assert got == {k: t.encode(x, add_special_tokens=False).ids if x else [] for k, x in enumerate(TEXTS)}
