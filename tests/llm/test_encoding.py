import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm import encoding as E

PATH = f"{E.FOLDER}/{E.NAME}.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
ALPHABET = "ab é\n\n  '​1 2.,<|endoftext|>'s'll\t日本🙂'reve"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=80), st.text(max_size=60)), st.integers(1, 12))
def test_tree_equals_whole(text, leaf):
    enc = E.tokenizer(PATH)
    want = enc.encode_ordinary(text)
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    assert E.encode_tree(text, enc, leaf) == want
    assert E.encode_tree(text, enc, leaf, 4) == want
    assert E.decode_tree(want, enc).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst日本é", min_size=40, max_size=400), st.integers(8, 40), st.integers(8, 40))
def test_joins_inside_one_piece(text, leaf, long):
    enc = E.tokenizer(PATH)
    assert E.encode_tree(text, enc, leaf, long) == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1 '\n\t.,;sreé_", min_size=1, max_size=200), st.data())
def test_certain_cuts_are_cuts(text, data):
    enc = E.tokenizer(PATH)
    for m in E._CUT.finditer(text):
        assert enc.encode_ordinary(text[: m.start()]) + enc.encode_ordinary(text[m.start() :]) == enc.encode_ordinary(text)


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.FOLDER}/{E.NAME}.json")
    t.encode_special_tokens = True
    for x in ("don't we'll <|endoftext|> x", "  a\n\n\n b 12345 ½", "naïve 日本🙂", "\r\n\t"):
        assert E.encode(x, E.tokenizer(PATH)) == t.encode(x, add_special_tokens=False).ids


def test_long_runs():
    enc = E.tokenizer(PATH)
    for x in ("a" * 100_000, " " * 70_000 + "x", "\n" * 50_000, "ab'll " * 20_000):
        assert E.decode_tree(E.encode(x, enc), enc).decode() == x
        assert E.encode(x, enc) == enc.encode_ordinary(x)
    x = "word's 12 — " * 9_000
    assert E.encode(x, enc) == enc.encode_ordinary(x)


def test_rows(spark):
    df = spark.createDataFrame([(1, "hi there"), (2, ""), (3, None), (1, "hi there"), (4, "<|endoftext|>")], "doc_id bigint, text string").selectExpr("*", "'z' as ids", "1 as k", "'q' as t")
    got = sorted((r["doc_id"], list(r["ids"])) for r in E.encoded(df).collect())
    assert got[2:4] == [(2, []), (3, [])] and got[0] == got[1] and 50256 not in got[4][1]
    assert E.encoded(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in E.decoded(E.encoded(df)).collect()}
    assert back == {1: "hi there", 2: "", 3: "", 4: "<|endoftext|>"}
