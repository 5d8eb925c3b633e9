"""Byte-level BPE by prefix dynamic programming.

For a given vocabulary with merge ranks, the BPE encoding of a string is the
only sequence of tokens in which each neighbouring pair is compatible, and the
encoding of a prefix is found by cutting at its last token. So it is enough to
store, for each byte prefix, the one valid last token: of the tokens that end
the prefix, the one that is compatible with the last token of what stands
before it. Reading last tokens backwards gives the encoding. More bytes at the
end only add entries (exact appends), and after an edit entries are made anew
only until they fall in with the old ones (`Prefixes.edit`).

Two tokens are compatible when encoding their concatenation gives just them;
that is decided once a pair, by undoing and redoing merges at their border,
and kept.

Text is first cut by the vocabulary's pattern. A word that begins at a single
blank is cut the same way wherever it stands, so whole words come from a
bounded cache, and only words that are not there are cut and encoded.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, each, forgets, lean, table

#: Words kept in each half of a worker's cache, and prefixes and pairs of tokens kept before a worker begins anew.
CACHE_WORDS = 300_000
CACHE_PREFIXES = 400_000
CACHE_PAIRS = 400_000
#: Longer pieces of the pattern have a table of their own instead of sharing prefixes with others.
SHARED_BYTES = 48
_NONE = 1 << 62
#: Lengths of tokens where none of three bytes or more ends alike.
_SHORT = (2, 1)


class Vocabulary:
    """Tokens by rank: {bytes: id}; ids are ranks. Every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int] | None] = {}
        #: tokens that merging can make; only they occur beside others
        self.made = {t: i for t, i in ranks.items() if len(t) == 1 or self._split(i) is not None}
        self.longest = max(map(len, self.made))
        #: by three bytes: the lengths of the tokens that end in them, longest first
        self.lengths = self._lengths()
        self.agree: dict[int, bool] = {}  # by pair, as one number
        #: of each prefix met of short pieces: its last token
        self.known: dict[bytes, int] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}, pattern)

    def _lengths(self) -> dict[bytes, tuple[int, ...]]:
        found: dict[bytes, set[int]] = {}
        for token in self.made:
            if len(token) > 2:
                found.setdefault(token[-3:], {1, 2}).add(len(token))
        return {end: tuple(sorted(sizes, reverse=True)) for end, sizes in found.items()}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for tokens no merge makes."""
        if token not in self.parts:
            data = self.tokens[token]
            self.parts[token] = None
            if len(data) > 1:
                pieces = self.by_merges(data, below=token)
                if len(pieces) == 2:
                    self.parts[token] = (pieces[0], pieces[1])
        return self.parts[token]

    def by_merges(self, data: bytes, below: int = _NONE) -> list[int]:
        """The encoding by merging the lowest rank first, of ranks under `below`: the definition, used for single tokens."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Does the encoding of both tokens' bytes together consist of just these two?"""
        pair = a << 32 | b
        known = self.agree.get(pair)
        if known is None:
            if len(self.agree) >= CACHE_PAIRS:
                self.agree.clear()
            known = self.agree[pair] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        ranks, tokens = self.ranks, self.tokens
        left, right, limit = a, b, _NONE
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False  # the border would have been merged before either side was complete
            # undo the later of the two sides' last merges, or the other's, and look at the border as it was then
            for side in (0, 1) if left > right else (1, 0):
                limit = right + 1 if side else left
                if (pair := self._split(right if side else left)) is not None:
                    left, right = (left, pair[0]) if side else (pair[1], right)
                    break
            else:
                return True

    def last_token(self, data: bytes, end: int, last: Callable[[int], int]) -> int:
        """The one valid last token of data[:end]; last(k) is that of data[:k], 0 < k < end."""
        made, agree = self.made, self.agree
        for size in self.lengths.get(data[max(0, end - 3) : end], _SHORT):  # longest first: it mostly is the one
            begin = end - size
            if begin < 0:
                continue
            token = made.get(data[begin:end])
            if token is None:
                continue
            if not begin:
                return token
            before = last(begin)
            fits = agree.get(before << 32 | token)
            if fits or fits is None and self.compatible(before, token):
                return token
        raise ValueError("a byte is missing from the vocabulary")

    def encode_piece(self, data: bytes) -> str:
        """Ids of one match of the pattern, as decimal numbers joined by commas."""
        whole = self.ranks.get(data)
        if whole is not None:
            return str(whole)
        if len(data) > SHARED_BYTES:
            return ",".join(map(str, Prefixes(self, data).ids()))
        known = self.known
        if data not in known:
            self._learn(data)
        out, end, tokens = "", len(data), self.tokens
        while end:
            token = known[data[:end]]
            out = f"{token},{out}" if out else str(token)
            end -= len(tokens[token])
        return out

    def _learn(self, data: bytes) -> None:
        """The last tokens of all prefixes of a short piece; those that another piece shares are known."""
        known, made, agree, lengths = self.known, self.made, self.agree, self.lengths
        if len(known) >= CACHE_PREFIXES:
            known.clear()
        have = len(data) - 1
        while have and data[:have] not in known:
            have -= 1
        for end in range(have + 1, len(data) + 1):
            prefix = data[:end]
            last = made.get(prefix)
            if last is None:
                for size in lengths.get(prefix[-3:], _SHORT):
                    if size < end and (token := made.get(prefix[-size:])) is not None:
                        before = known[prefix[:-size]]
                        fits = agree.get(before << 32 | token)
                        if fits or fits is None and self.compatible(before, token):
                            last = token
                            break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
            known[prefix] = last


class Prefixes:
    """The last tokens of all prefixes of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]  # of the prefix of each length; the empty one has none
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: entries of earlier prefixes stay as they are."""
        first = len(self.data)
        self.data += data
        for end in range(first + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last.__getitem__))

    def edit(self, begin: int, end: int, data: bytes) -> int:
        """Replace bytes begin..end; the number of prefixes that were encoded again.

        Prefixes up to begin keep their entries. Behind the edit an entry depends on the `longest` entries
        before it and on bytes that haven't changed, so once so many in a row are what they were before,
        all that follow are, and keep their old entries.
        """
        old, longest = self.last, self.vocabulary.longest
        changed, moved = begin + len(data), begin + len(data) - end
        self.data = self.data[:begin] + data + self.data[end:]
        self.last = old[: begin + 1]
        alike = 0
        for at in range(begin + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, at, self.last.__getitem__))
            if at >= changed:
                alike = alike + 1 if self.last[at] == old[at - moved] else 0
                if alike >= longest:
                    self.last += old[at - moved + 1 :]
                    return at - begin
        return len(self.data) - begin

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class _Words(dict):
    """Decimal ids, joined by commas, by word; None where a word can't be cut out of its text."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> str | None:
        found = self.old.get(word, self)
        if found is self:
            # blanks at a word's edge, or none between two words, go together with the blank before
            found = None if not word or word[0].isspace() or word[-1].isspace() else self.encoder.word(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = _Words(self)
        probe = [[" été"], [" ab", "."], [" ab", "!"]]
        self.plain = [vocabulary.pattern.findall("".join(p)) for p in probe] == probe
        ids = range(max(vocabulary.tokens) + 1)
        tokens = [vocabulary.tokens.get(i, b"") for i in ids]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens])
        self.at = np.cumsum(self.size) - self.size

    def line(self, text: str) -> str:
        piece = self.vocabulary.encode_piece
        return ",".join([piece(p.encode("utf-8", "replace")) for p in self.vocabulary.pattern.findall(text)])

    def word(self, word: str) -> str:
        """The ids of a word behind one blank. Letters alone, or with a mark behind, are cut without the pattern."""
        if self.plain:
            if word.isalpha():
                return self.vocabulary.encode_piece(b" " + word.encode())
            if word[-1] in ".,!?;:" and word[:-1].isalpha():
                return f"{self.vocabulary.encode_piece(b' ' + word[:-1].encode())},{self.vocabulary.encode_piece(word[-1].encode())}"
        return self.line(" " + word)

    def encode(self, text: str | None) -> str:
        """The ids as decimal numbers joined by commas; empty for null and empty texts."""
        if not text:
            return ""
        words = text.split(" ")
        first = words.pop(0)
        if not first or first[-1].isspace():
            return self.line(text)
        try:
            return ",".join([self.line(first), *map(self.words.__getitem__, words)])
        except TypeError:  # a None: blanks next to blanks
            return self.line(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens one after another, by one gather."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        place = np.arange(ends[-1])
        place += np.repeat(self.at[ids] - (ends - size), size)
        return self.flat[place].tobytes()


@forgets
@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """This worker process's encoder for a vocabulary."""
    return Encoder(Vocabulary.load(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every whole text of docs (doc_id, text; others are ignored) and decode the ids again; no shuffle.

    Null text counts as empty: no ids, and the digests of the empty string.
    Rows that repeat an id are rows like any other. Columns: doc_id, n_tokens,
    ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and with_ids
    ids (array of int) and decoded (binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            rows = []
            for text in each(batch.column(1)):
                line = bpe.encode(text)
                ids = np.fromstring(line, np.int64, sep=",")
                back = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), *((ids, back) if with_ids else ())))
            out = {"doc_id": batch.column(0)}
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.binary()} if with_ids else {})
            out |= {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())}
            yield pa.RecordBatch.from_pydict(out)

    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "byte_bpe"), ddl)


def op2_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return round_trip(table(spark, sf_dir, "documents"), vocabulary, pattern, with_ids=False)
