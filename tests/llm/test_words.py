"""Ids of words against the tokenizers library, over all of Unicode."""

import sys
import unicodedata

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tierscope.llm import words
from tierscope.llm.queries import WORD_BPE

LETTERS = [
    c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LN"
]
CHANGED = [c for c in LETTERS if unicodedata.normalize("NFC", c).lower() != c]
MARKS = list(words.TRAILING.decode()) + ['."', "),", "...", "!?"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def same_ids(library, found):
    """Whether each word's ids are the library's; words that hold white space are no words."""
    want = library.encode_batch([" ".join(found[i : i + 1000]) for i in range(0, len(found), 1000)],
                                add_special_tokens=False)
    ends, ids = words.WordEncoder(WORD_BPE).encode(
        pa.array([" ".join(found[i : i + 1000]) for i in range(0, len(found), 1000)], pa.large_string())
    )
    for i, one in enumerate(want):
        if one.ids != ids[ends[i] : ends[i + 1]].tolist():
            return found[1000 * i]
    return None


def test_every_letter_and_number_before_a_mark(library):
    assert len(LETTERS) > 130_000
    assert same_ids(library, [c + "." for c in LETTERS]) is None
    assert same_ids(library, ["a" + c + "," for c in LETTERS]) is None


@pytest.mark.parametrize("mark", MARKS)
def test_letters_that_change_before_each_mark(library, mark):
    assert len(CHANGED) > 2_000
    assert same_ids(library, [c + mark for c in CHANGED]) is None


def test_ordinary_words_of_three_scripts(library):
    found = ["İstanbul.", "İ.", "Hindī", "लड़.", "लड़,", "पढ़।", "पढ़!", "বাড়.", "ਸ਼.", "שׁ.", "é.", "É,"]
    assert same_ids(library, found) is None


class Bounded(dict):
    """A memory that notes the most entries it ever held."""

    most = 0

    def update(self, *args):
        super().update(*args)
        self.most = max(self.most, len(self))


def test_a_full_memory_is_left_as_it_is(library, monkeypatch):
    monkeypatch.setattr(words, "MEMORY_WORDS", 3)
    encoder = words.WordEncoder(WORD_BPE)
    encoder.words, encoder.cores = Bounded(), Bounded()
    texts = ["plan Plan, plan. drug", "drug... list (tier) é. " + "x" * 60, "list <|endoftext|> list;", ""]
    for _ in range(2):
        ends, ids = encoder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[ends[i] : ends[i + 1]].tolist() == want
    assert 0 < encoder.words.most <= 3 and 0 < encoder.cores.most <= 3
