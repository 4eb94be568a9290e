import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SMALL = bpe.Codec(PATH, leaf=24, long_pretoken=8)
NORMAL = bpe.Codec(PATH)


def want(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def same(text):
    ids = want(text)
    for codec in (SMALL, NORMAL):
        assert codec.encode(text) == ids
        assert codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab 'slltrevmd1,.!\n\t  éß漢😀"), max_size=160))
def test_any_cut_gives_the_librarys_ids(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text.encode("utf-8", "ignore").decode())


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + " " + "xyz" * 900, " " * 3000 + "x", "don't we'll " * 400, "\n" * 77, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "՘x", "漢字" * 900])
def test_long_unsplit_texts(text):
    same(text)


def test_random_words_at_every_cut():
    rng = random.Random(2)
    for _ in range(300):
        same("".join(rng.choice(["they'll", " ", "  ", "'", "'l", "l", "re", "\n ", "12", ".", "…", "hello"]) for _ in range(rng.randint(0, 60))))


def test_table(odd, none):
    df, rows = odd
    got = bpe.encode(df, PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(i), want(t or ""), t or "") for i, t in rows)
    assert bpe.encode(none, PATH).count() == 0
