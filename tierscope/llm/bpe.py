"""Byte-level byte-pair encoding by dynamic programming over prefixes.

The encoding of a text's prefix ends with one token, and dropping that token leaves the
encoding of the shorter prefix. So for each prefix its last token is enough. A token is the
last one if it is a suffix of the prefix (an automaton finds all that are), and if it may
follow the last token of what is before it: merging the two from scratch must never merge
across their border. Exactly one token passes. Pointers back from the end give the ids.

Texts are first cut into words by the vocabulary's pattern; merges don't cross words. Words
repeat, so a bounded memory keeps their ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import per_text, struct_array
from tierscope.llm.words import remembered

#: Fixed value: the pattern that byte-level vocabularies of this family cut texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY_PAIRS = 200_000  # pairs of tokens whose test is remembered


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 stands for itself; the rest, in order, for characters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        model, alphabet = described["model"], byte_alphabet()

        def data(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        ids = model["vocab"]
        self.bytes_of = {i: data(token) for token, i in ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, made)
        self.made_of: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = ids[left + right]
            self.merge[ids[left], ids[right]] = (rank, made)
            self.made_of.setdefault(made, (rank, ids[left], ids[right]))
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.cut = regex.compile(PATTERN)
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.at_special = regex.compile(f"({marks})") if marks else None
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, token in self.bytes_of.items():
            if i not in self.special.values() and self._whole(i):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.text_of = {i: str(i).encode() for i in self.bytes_of}
        self.words: dict[str, tuple[int, ...]] = {}

    def _whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if token not in self.made_of:
            return True
        rank, left, right = self.made_of[token]
        return self._whole(left) and self._whole(right) and self._apart(left, right, rank)

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether merges of a rank below `limit` leave the border of two tokens alone.

        The merges that made the two tokens are undone, the last first: the one of higher
        rank, on a tie the right one, as the left is merged before. Whenever the pieces at
        the border have a merge of their own, it must come after the merge undone before,
        else it would have been taken first.
        """
        while True:
            joint = self.merge.get((left, right))
            if joint is not None and joint[0] < limit:
                return False
            of_left, of_right = self.made_of.get(left), self.made_of.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and of_left[0] > of_right[0]):
                limit, left = of_left[0], of_left[2]
            else:
                limit, right = of_right[0] + 1, of_right[1]

    def follows(self, left: int, right: int) -> bool:
        pair = left, right
        known = self.may_follow.get(pair)
        if known is None:
            if len(self.may_follow) >= MEMORY_PAIRS:
                self.may_follow.clear()
            known = self.may_follow[pair] = self._apart(left, right, len(self.merge))
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode().decode("latin-1")
        last = [-1] * (len(data) + 1)  # of each prefix the last token
        follows, width = self.follows, [0] * (len(data) + 1)
        for at, (token, length) in self.automaton.iter(data):
            end = at + 1
            if last[end] < 0:
                begin = end - length
                if not begin or follows(last[begin], token):
                    last[end], width[end] = token, length
        ids, end = [], len(data)
        while end:
            if last[end] < 0:
                raise ValueError(f"the vocabulary can't encode {word!r}")
            ids.append(last[end])
            end -= width[end]
        return tuple(reversed(ids))

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; a control token's string is that token."""
        parts = [self.at_special.split(text) if self.at_special else [text] for text in texts]
        lists = [
            [
                word for i, part in enumerate(split)
                for word in ([part] if i % 2 else self.cut.findall(part))
            ] if len(split) > 1 else self.cut.findall(split[0])
            for split in parts
        ]
        new = list(set().union(*lists) - self.words.keys())
        with remembered(self.words, new, self._encode_words):
            get = self.words.__getitem__
            return [list(chain.from_iterable(map(get, words))) for words in lists]

    def _encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        special = self.special
        return [
            (special[word],) if word in special else self.encode_word(word) for word in words
        ]

    def decode(self, ids: list[int]) -> bytes:
        """The text's UTF-8; bytes that are none become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode("utf-8", "replace").encode()


@functools.lru_cache(2)
def coder(vocabulary: str) -> ByteBpe:
    """One coder in each Python worker."""
    return ByteBpe(vocabulary)


def encode(text: Column, vocabulary: str) -> Column:
    """A text's ids as array<int>; of a null or empty text, an empty array."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(coder(vocabulary).encode_texts(texts.to_pylist()), pa.list_(pa.int32()))

    return per_text(run, "array<int>")(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """The text of an array of ids, control tokens included; of null, null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [
                None if ids is None else coder(vocabulary).decode(ids).decode()
                for ids in batch.to_pylist()
            ]
            yield pa.array(texts, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Needs doc_id and text; other columns are ignored. A null text counts as empty, which has
    no ids. ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the UTF-8 of
    what the ids decode to. Rows that repeat get equal results. No documents give no rows.
    """

    def run(texts: pa.Array) -> pa.Array:
        bpe = coder(vocabulary)
        rows = bpe.encode_texts(texts.to_pylist())
        listed = [b",".join(map(bpe.text_of.__getitem__, ids)) for ids in rows]
        return struct_array(
            n_tokens=pa.array(list(map(len, rows)), pa.int64()),
            ids_sha256=[hashlib.sha256(ids).hexdigest() for ids in listed],
            decoded_sha256=[hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in rows],
        )

    kind = "struct<n_tokens:bigint, ids_sha256:string, decoded_sha256:string>"
    column = per_text(run, kind)(F.col("text"))
    return docs.select("doc_id", column.alias("r_")).select("doc_id", "r_.*")
