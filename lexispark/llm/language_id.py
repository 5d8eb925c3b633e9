"""Language identification by prediction by partial matching (PPM).

Every language has a context tree over bytes, of variable order: of all
contexts of up to `ORDER` bytes in its training texts the `CONTEXTS` most
frequent, each with how often each byte followed it. Coding a byte starts at
the longest context in the tree; a byte that was never seen there costs an
escape and is looked for in the next shorter one, without the bytes that were
seen before (escape method C with exclusion: with n occurrences of d different
bytes that aren't excluded, a byte of count k has probability k / (n + d), an
escape d / (n + d)), down to order -1, where the bytes that are left are alike.
The probabilities after a context sum to 1, so code lengths are those of a code.

After training the statistics are frozen, so the code length of a byte after a
context is a constant; a tree is two tables, and scoring a text is a walk down
the tree, one gather a byte of context, for all places of a text at once. The
language with the shortest code length wins.

Texts are normalised before they are coded: ASCII letters to lower case, runs
of other ASCII to one separator; every byte beyond ASCII stands for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, each, held_out, lean, table

#: Longest context, in bytes.
ORDER = 4
#: Contexts of a language's tree at most; a power of two.
CONTEXTS = 2048
#: A separator, 26 letters, 128 bytes beyond ASCII.
SYMBOLS = 155
#: Training reads about this many labelled documents at most, an equal share of each language, dealt out by a hash of the id.
TRAIN_DOCS = 20_000
#: Values of lang that are learned at most, those of most documents first.
LANGUAGES = 128
#: Values of that hash.
DEALT = 1 << 40
#: The filter rejects a text whose best language has less posterior probability than this,
MIN_SCORE = 0.5
#: or needs more nats a symbol than this, over a text of at least so many symbols. On the test tables a language's own
#: texts need about 1.5, short ones with keys or addresses up to 4, letters at random and languages not learned 7 or more.
MAX_NATS, MIN_SYMBOLS = 5.5, 40
#: Bytes coded at once, and grams that a task counts at once in learning.
STEP, COUNTED = 1 << 16, 1 << 21

_LETTER = regex.compile(r"\p{L}")


def _symbols() -> np.ndarray:
    """Byte to symbol: 0 for ASCII that is no letter, 1 to 26 for letters, and one each for other bytes."""
    out = np.zeros(256, np.int32)
    out[128:] = np.arange(27, SYMBOLS)
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    return out


SYMBOL = _symbols()


def lines(text: str, order: int) -> Iterator[np.ndarray]:
    """A text's symbols in steps, each behind the `order` symbols before it; a text starts after separators."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    before = np.zeros(order, np.int32)
    last = 0
    for at in range(0, len(data), STEP):
        syms = SYMBOL[data[at : at + STEP]]
        keep = syms != 0
        keep[1:] |= syms[:-1] != 0
        keep[0] |= last != 0
        last = int(syms[-1])
        line = np.concatenate([before, syms[keep]])
        yield line
        before = line[len(line) - order :]


def grams(text: str, order: int) -> Iterator[np.ndarray]:
    """The (order + 1)-grams of a text's symbols as numbers, in steps."""
    for line in lines(text, order):
        n = len(line) - order
        index = line[:n].astype(np.int64)
        for k in range(1, order + 1):
            index *= SYMBOLS
            index += line[k : n + k]
        yield index


def grown(gram: np.ndarray, n: np.ndarray, order: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, context, counts of each symbol after it) of the `most` most frequent contexts, from counts of (order + 1)-grams.

    A context is at least as frequent as any longer one that ends in it, so with a context all its ends are kept. The empty one is always there.
    """
    symbol, before = gram % SYMBOLS, gram // SYMBOLS
    found = []
    for depth in range(order + 1):
        codes, own = np.unique(before % SYMBOLS**depth, return_inverse=True)
        found.append((codes, np.bincount(own, n, len(codes)).astype(np.int64)))
    depth = np.repeat(np.arange(order + 1), [len(c) for c, _ in found])
    code, total = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    kept = np.sort(np.lexsort((code, depth, -total))[:most])  # by depth, then code
    depth, code = depth[kept], code[kept]
    counts = np.zeros((len(kept), SYMBOLS), np.int64)
    for k in range(order + 1):
        rows = np.flatnonzero(depth == k)
        if not len(rows):
            break
        own = before % SYMBOLS**k
        place = np.minimum(np.searchsorted(code[rows], own), len(rows) - 1)
        there = code[rows][place] == own
        np.add.at(counts, (rows[place[there]], symbol[there]), n[there])
    if not len(depth):
        depth, code, counts = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, SYMBOLS), np.int64)
    return depth, code, counts


def freeze(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The probability of each symbol after each context, by PPM with escape method C and exclusion.

    Row 0 is the empty context; ends[k] is the row of the next shorter context, before k.
    """
    prob, tail = np.zeros(counts.shape), np.zeros(counts.shape)  # tail: of the symbols that were not seen, once it is known that it is one of them
    for k, own in enumerate(counts):
        seen = own > 0
        n, d = own.sum(), seen.sum()
        if k == 0:
            tail[k] = 1 / max(1, SYMBOLS - d)
        else:
            q = ends[k]
            new = (counts[q] > 0) & ~seen
            more, kinds = counts[q][new].sum(), new.sum()
            open_ = (counts[q] == 0).any()
            # where nothing is left to escape to, or nothing but escapes, one of the two parts is empty
            stay = 0.0 if not kinds else 1.0 if not open_ else more / (more + kinds)
            tail[k] = np.where(new, counts[q] / max(1, more) * stay, tail[q] * (1 - stay))
        stay = 0.0 if not d else 1.0 if seen.all() else n / (n + d)
        prob[k] = np.where(seen, own / max(1, n) * stay, tail[k] * (1 - stay))
    return prob


class Tree:
    """A language's frozen tree: where a context goes on by one byte before it, and nats of each symbol after it.

    A state under `size` is a context that may still go on, one from `size` on is the same context where it ended.
    """

    def __init__(self, depth: np.ndarray, code: np.ndarray, counts: np.ndarray):
        self.size = size = 1 << max(1, int(len(depth) - 1).bit_length())
        place = {(int(d), int(c)): k for k, (d, c) in enumerate(zip(depth, code, strict=True))}
        ends = np.array([place[d - 1, c % SYMBOLS ** (d - 1)] if d else 0 for d, c in place])
        self.child = np.repeat(np.arange(2 * size, dtype=np.uint16) | size, SYMBOLS).reshape(2 * size, SYMBOLS)
        for k, (d, c) in enumerate(place):
            if d:
                self.child[ends[k], c // SYMBOLS ** (d - 1)] = k
        self.nats = np.zeros((size, SYMBOLS), np.float32)
        self.nats[: len(depth)] = -np.log(freeze(ends, counts))
        self.child, self.nats = self.child.reshape(-1), self.nats.reshape(-1)

    def code_length(self, line: np.ndarray, order: int) -> float:
        """Nats of a line's symbols behind the first `order`."""
        n = len(line) - order
        state = self.child[line[order - 1 : order - 1 + n]]
        for k in range(2, order + 1):
            at = np.multiply(state, SYMBOLS, dtype=np.int32)
            at += line[order - k : order - k + n]
            state = self.child.take(at)
        state &= np.uint16(self.size - 1)
        at = np.multiply(state, SYMBOLS, dtype=np.int32)
        at += line[order:]
        return float(self.nats.take(at).sum(dtype=np.float64))


@dataclass
class Model:
    """Frozen statistics: languages and their trees."""

    languages: list[str]
    trees: list[Tree]
    order: int = ORDER

    def code_lengths(self, text: str) -> tuple[np.ndarray, int]:
        """Nats that each language's tree needs for the whole text, and how many symbols it has."""
        total, n = np.zeros(len(self.trees)), 0
        for line in lines(text, self.order):
            total += [t.code_length(line, self.order) for t in self.trees]
            n += len(line) - self.order
        return total, n

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its posterior probability under equal priors, and its nats a symbol, 0 for short texts.

        ("und", 0.0, 0.0) for null and letterless texts.
        """
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0, 0.0
        nats, n = self.code_lengths(text)
        best = int(np.argmin(nats))  # ties: the language that sorts first
        return self.languages[best], float(1.0 / np.exp(np.clip(nats[best] - nats, -700, 0)).sum()), float(nats[best] / n) if n >= MIN_SYMBOLS else 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def train(docs: DataFrame, order: int = ORDER, limit: int = TRAIN_DOCS, languages: int = LANGUAGES, contexts: int = CONTEXTS) -> Model:
    """Learn from text and lang of rows that are not held out; nulls in either are skipped.

    Of the values of lang the `languages` that most documents have are learned
    (ties: those that sort first). At most about `limit` documents are used:
    where there are more, each is taken with probability limit / languages /
    rows of its language by a hash of its id, and of each language at least the
    one with the smallest hash. Counts are summed and trees grown on the
    executors; the driver gets a tree of at most `contexts` contexts a language.
    """
    usable = columns(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(DEALT))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(dealt).alias("least")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return Model([], [], order)
    fits = sum(r.n for r in sizes) <= limit
    upto = [(r.lang, DEALT if fits else max(r.least, int(DEALT * min(1.0, limit / len(sizes) / r.n)) - 1)) for r in sizes]
    usable = usable.join(F.broadcast(docs.sparkSession.createDataFrame(upto, "lang string, upto bigint")), "lang").where(dealt <= F.col("upto")).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in met.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(*map(each, batch.columns), strict=True):
                for part in grams(text, order):
                    met.setdefault(lang, []).append(part)
                    held += len(part)
                    if held >= COUNTED:
                        yield from flush()
                        met, held = {}, 0
        yield from flush()

    def tree(own: pa.Table) -> pa.Table:
        depth, code, counts = grown(np.asarray(own["gram"]), np.asarray(own["n"]), order, contexts)
        return pa.table({"lang": own["lang"].slice(0, 1), "depth": [depth.astype("<i8").tobytes()], "code": [code.astype("<i8").tobytes()], "counts": [counts.astype("<i8").tobytes()]})

    found = usable.mapInArrow(lean(counted, "language_id"), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    trees = found.groupBy("lang").applyInArrow(tree, "lang string, depth binary, code binary, counts binary").collect()
    trees = sorted(trees, key=lambda r: r.lang)
    return Model([r.lang for r in trees], [Tree(np.frombuffer(r.depth, "<i8"), np.frombuffer(r.code, "<i8"), np.frombuffer(r.counts, "<i8").reshape(-1, SYMBOLS)) for r in trees], order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text; no shuffle."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = frozen.value
        for batch in batches:
            found = [ppm.predict(t) for t in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "language_id"), "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang; other columns are ignored).

    Null texts and texts without a letter get ("und", 0.0), as do all texts
    where no labelled row can be learned from (an empty table gives an empty
    result). Rows with a null id count as held out.
    """
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, max_nats: float = MAX_NATS) -> DataFrame:
    """docs without the rows whose language can't be told: no letter at all, a best score under min_score, or over max_nats nats a symbol in the best language.

    All columns stay as they are, and rows that repeat are judged alike. Where
    nothing can be learned from, no row stays; an empty table gives an empty result.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = frozen.value
        for batch in batches:
            found = (ppm.judge(t) for t in each(batch.column(at)))
            yield batch.filter(pa.array([lang != "und" and score >= min_score and nats <= max_nats for lang, score, nats in found], pa.bool_()))

    return docs.mapInArrow(lean(run, "language_id"), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
