import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bandstream.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.vocabulary(path), Tokenizer.from_file(path)


def same(both, text):
    ours, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    packed = ours.encode(text)
    assert np.frombuffer(packed, dtype="<u4").tolist() == ids
    assert ours.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(both, text):
    same(both, text)


@pytest.mark.parametrize(
    "text",
    [
        "", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext", "don't we'll  they've\n\n x",
        "a" * 1000, "ab" * 900 + " tail", "é" * 700, "\x1c\x1d a\x85b c　", "1234567890" * 60,
        "  lead and trail  ", "\U0001f600‍\U0001f600", "﻿ İstanbul",
    ],
)
def test_chosen_texts(both, text):
    same(both, text)


def test_long_words_merge_alike(both):
    ours, _ = both
    word = ("thequickbrownfox" * 15).encode()
    assert ours._merge_long([ours.byte_id[b] for b in word]) == ours.merge(word)


def test_cut_ids_decode_with_replacements(both):
    ours, theirs = both
    ids = theirs.encode("中文", add_special_tokens=False).ids
    cut = np.array(ids[:1], dtype="<u4").tobytes()
    assert ours.decode(cut) == theirs.decode(ids[:1], skip_special_tokens=False)


def test_query(spark, folder):
    texts = ["Some text.\nMore", None, "", "<|endoftext|>z", "café " * 50]
    folder.docs([(i, t, None, None, None) for i, t in enumerate(texts)])
    tokenizer = Tokenizer.from_file(bpe.default_path())
    for row in bpe.op9_bpe(spark, folder.path).collect():
        ids = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
