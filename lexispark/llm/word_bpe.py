"""Whole texts to ids of a word-end BPE vocabulary of the tokenizers library, one cached word at a time.

For vocabularies that drop blanks, as word-end BPE does, the ids of a text are
those of its blank-separated words one after another: normalisation and word
splitting never look across a blank. Arrow splits some MB of texts at once, so
each different word in them is looked up once, in a bounded cache. Those that
are not there go to the library: to its BPE model alone where a word is Latin
letters with punctuation behind, for which lower-casing is all the
normalisation there is, and else through its whole chain.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexispark.llm.common import forgets

#: Words kept in each half of a worker's cache.
CACHE_WORDS = 250_000
#: Runs of punctuation kept likewise.
CACHE_MARKS = 20_000
#: Bytes of one text that are split at once.
STEP = 4 << 20
#: Bytes of texts that are split at once.
GROUP = 8 << 20

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(rb"([a-z\x80-\xff]*)([!-/:-@\[-`{-~]*)")
#: Latin letters that lower-casing alone normalises; others take the library's whole chain.
_LATIN = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "İ") + "]+")


def _byte_letters() -> str:
    """The letters that byte-level vocabularies write bytes with, by byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return "".join(out[b] for b in range(256))


def _values(words: pa.BinaryArray) -> Iterator[bytes]:
    """The values of an array without nulls, some times faster than to_pylist()."""
    data, ends = (words.buffers()[2] or b""), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    data = bytes(data)
    return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


class Cache(dict):
    """What learn(key) gave, by key, in bounded memory: a full young half becomes the old half, whose entries are used again or lost.

    learn(key) gives the value and whether to keep it.
    """

    def __init__(self, learn, size: int):
        self.learn, self.size, self.old = learn, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found, keep = self.learn(key)
            if not keep:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """encode(text) gives the ids as little-endian uint32 bytes, equal to the library's for the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words, self.marks = Cache(self._word, CACHE_WORDS), Cache(lambda marks: (self._whole(marks), True), CACHE_MARKS)
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        # blanks have to go without a trace, else words can't be encoded one by one
        for text in ("a b", " a\tb\n ", "a  b"):
            if [*self._whole(text.encode())] != [*self._whole(b"a"), *self._whole(b"b")]:
                raise ValueError(f"{path} keeps blanks")
        # the short way is open only for the normaliser and splitter it was made for
        probe = "Éa'b c.d"
        self.short = [*self._whole(probe.encode())] == [*b"".join(self._whole(w) for w in ("éa".encode(), b"'", b"b", b"c", b".", b"d"))]

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, low: str) -> bytes:
        """Ids of lower-case letters, each byte of them written as the vocabulary writes it, by the BPE model alone."""
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(low)])

    def _word(self, word: bytes) -> tuple[bytes, bool]:
        if self.short:
            if word.isalpha():  # of bytes, ASCII letters only
                return self._letters(word.lower().decode()), True
            if (ascii_stem := word.rstrip(_MARKS)).isalpha():
                return self.words[ascii_stem] + self.marks[word[len(ascii_stem) :]], False
            if plain := _PLAIN.fullmatch(word):
                stem, marks = plain.groups()
                if not stem:
                    return self.marks[marks], False
                if stem.isascii() or _LATIN.fullmatch(s := stem.decode("utf-8", "surrogatepass")):
                    if marks:
                        return self.words[stem] + self.marks[marks], False
                    return self._letters(codecs.charmap_decode(s.lower().encode(), "strict", self.letters)[0]), True
        return self._whole(word), True

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" not in data:  # a special token's text is matched before anything is lower-cased
            data = data.lower()
        ids_of = self.words.__getitem__
        if len(data) <= STEP:
            return b"".join(map(ids_of, data.split()))
        parts, at = [], 0
        while at < len(data):
            end = min(at + STEP, len(data))
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            parts.append(b"".join(map(ids_of, data[at:end].split())))
            at = end
        return b"".join(parts)

    def encode_all(self, texts: pa.Array) -> Iterator[memoryview | bytes]:
        """encode(text) for every value of a column of texts, in order."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(texts):
            if sizes[at] > STEP:
                yield self.encode(texts[at].as_py())
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + GROUP, "right")))
            long = np.flatnonzero(sizes[at:stop] > STEP)
            stop = at + int(long[0]) if len(long) else stop
            yield from self._group(texts[at:stop])
            at = stop

    def _group(self, texts: pa.Array) -> Iterator[memoryview]:
        """encode(text) for each of a few MB of texts: each different word of theirs is looked up once."""
        texts = pc.fill_null(texts, "")
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(low)
        offsets = words.offsets.to_numpy()
        # blanks at the ends give empty words, which have no ids
        found = words.flatten().cast(pa.binary()).dictionary_encode()
        ids_of = self.words.__getitem__
        ids = pa.array([ids_of(w) if w else b"" for w in _values(found.dictionary)], pa.binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1][offsets - offsets[0]].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        for a, b in zip(ends, ends[1:], strict=False):
            yield data[a:b]


@forgets
@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """This worker process's encoder for a vocabulary."""
    return WordEncoder(path)
