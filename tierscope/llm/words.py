"""Token ids of whole texts by the tokenizers library, word by word.

The vocabulary with word ends drops white space and never merges across it, so the ids of a
text are those of its words in order. Words repeat; a bounded memory of their ids saves
most of the encoding. Rare words are encoded in bulk.
"""

from __future__ import annotations

import contextlib
import functools
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MEMORY_WORDS = 200_000  # words whose ids one worker remembers, and as many word cores
ENCODE_BYTES = 4 << 20  # text encoded at a time
LONGEST_KEPT = 48  # bytes; longer words are encoded each time
TRAILING = b".,!?;:#*$%&|)\"'"  # ASCII marks that are tokens of their own at a word's end
CORE_ENDS = frozenset(string.ascii_letters.encode() + string.digits.encode())
BULK = 400  # words encoded by one call


def _ends_piece(core: bytes) -> bool:
    """Whether a core that ends in no ASCII character ends in a letter or digit.

    As the vocabulary sees it: composed and in lower case, where some letters end in a mark.
    """
    last = unicodedata.normalize("NFC", core.decode()).lower()[-1]
    return unicodedata.category(last)[0] in "LN"


class WordEncoder:
    """Encodes texts; each word's ids are kept as little-endian unsigned 32-bit, as bytes."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large strings), and where each text's ids begin, and the end."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        values = recalled(self.words, _listed(coded.dictionary), self._words)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts[which] - ends[:-1], counts) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(values), "<u4")[at]
        return ends[words.offsets.to_numpy() - words.offsets[0].as_py()], ids

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words: of their core in lower case, then of the trailing marks.

        Marks side by side are one piece, so a core that ends in a further mark takes all.
        """
        cores = [word.rstrip(TRAILING) for word in words]
        cores = [
            core if core is word or not core or core[-1] in CORE_ENDS
            or core[-1] > 127 and _ends_piece(core) else word
            for word, core in zip(words, cores)
        ]
        marked = [i for i, (word, core) in enumerate(zip(words, cores)) if core is not word]
        marks = [words[i][len(cores[i]):] for i in marked]
        out = recalled(self.cores, list(map(bytes.lower, cores)), self._bulk)
        for i, ids in zip(marked, recalled(self.cores, marks, self._bulk)):
            out[i] += ids
        for i, word in enumerate(words):
            if b"<|" in word:  # may hold a control string
                out[i] = self._alone(word)
        return out

    def _alone(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _bulk(self, words: list[bytes]) -> list[bytes]:
        """Words of letters only are one piece each: their ids end with a word end."""
        out: dict[bytes, bytes] = {}
        letters = [word for word in words if word.isalpha() or not word.isascii() and _letters(word)]
        parts = [letters[i : i + BULK] for i in range(0, len(letters), BULK)]
        joined = self.tokenizer.encode_batch_fast(
            [b" ".join(part).decode() for part in parts], add_special_tokens=False
        )
        for part, encoding in zip(parts, joined):
            ids = np.array(encoding.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                out.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts))))
        return [out[word] if word in out else self._alone(word) for word in words]


def _letters(word: bytes) -> bool:
    """Whether a word is letters only, also in lower case."""
    text = word.decode()
    return text.isalpha() and text.lower().isalpha()


def _listed(values: pa.Array) -> list[bytes]:
    """A large binary array without nulls as a list; `to_pylist` makes a scalar of each first."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    held = data.to_pybytes() if data else b""
    return list(map(held.__getitem__, map(slice, at[:-1], at[1:])))


def recalled(memory: dict, keys: list[bytes], encode) -> list[bytes]:
    """The value of each key, new ones encoded; short ones are remembered, up to the limit.

    The memory fills with what comes first, among it the frequent words, and then stays.
    """
    values = list(map(memory.get, keys))
    new = list(dict.fromkeys(key for key, value in zip(keys, values) if value is None))
    if not new:
        return values
    found = dict(zip(new, encode(new)))
    room = max(MEMORY_WORDS - len(memory), 0)
    memory.update((key, found[key]) for key in new[:room] if len(key) <= LONGEST_KEPT)
    return [found[key] if value is None else value for key, value in zip(keys, values)]


@contextlib.contextmanager
def remembered(memory: dict, new: list[bytes], encode) -> Iterator[None]:
    """Adds the values of new keys; afterwards only short keys stay, up to the limit.

    The memory fills with what comes first, among it the frequent words, and then stays.
    """
    room = MEMORY_WORDS - len(memory)
    memory.update(zip(new, encode(new)))
    yield
    room = max(room, 0)
    for key in new[room:]:
        del memory[key]
    for key in new[:room]:
        if len(key) > LONGEST_KEPT:
            del memory[key]


@functools.lru_cache(2)
def encoder(vocabulary: str) -> WordEncoder:
    """One encoder in each Python worker."""
    return WordEncoder(vocabulary)
