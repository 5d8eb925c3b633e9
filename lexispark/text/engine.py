"""A registry of text indexes, and the commands of a search shell."""

from __future__ import annotations

import json
import sys
import time
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from lexispark.text import search as searching
from lexispark.text.query import Predicate, QueryError, Term, parse
from lexispark.text.segments import SegmentedIndex
from lexispark.text.tokenize import postings


class TextEngine:
    """Indexes by name. An index is a postings table (doc_id, term, tf), or a SegmentedIndex."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.indexes: dict[str, DataFrame | SegmentedIndex] = {}

    def register_index(self, name: str, index: DataFrame | SegmentedIndex):
        """Bind an index to a name; returns what the name stood for before."""
        before = self.indexes.get(name)
        self.indexes[name] = index
        return before

    def register_documents(self, name: str, docs: DataFrame):
        return self.register_index(name, postings(docs))

    def index_provider(self, name: str) -> DataFrame | SegmentedIndex:
        if name not in self.indexes:
            raise KeyError(f"no index {name!r}")
        return self.indexes[name]

    def index(self, name: str) -> DataFrame:
        """All postings of an index."""
        return self._postings(self.index_provider(name))

    @staticmethod
    def _postings(index: DataFrame | SegmentedIndex) -> DataFrame:
        return index.live_postings() if isinstance(index, SegmentedIndex) else index

    def boolean(self, name: str, query: str | Predicate, is_score: bool = False, strict: bool = False) -> DataFrame:
        """Matching doc_ids, with is_score also tfs and score."""
        return self.boolean_with_provider(self.index_provider(name), query, is_score, strict)

    def boolean_with_provider(self, index: DataFrame | SegmentedIndex, query: str | Predicate, is_score: bool = False, strict: bool = False) -> DataFrame:
        """The same for an index at hand; strict refuses a predicate that is one bare term."""
        p = parse(query) if isinstance(query, str) else query.build()
        if strict and isinstance(p, Term):
            raise QueryError("a single term is no boolean predicate")
        found = self._postings(index)
        if is_score:
            return searching.scored(found, p)
        return searching.search(found, p, index.live_docs() if isinstance(index, SegmentedIndex) else found)

    def count_agg(self, name: str, query: str | Predicate) -> int:
        return self.boolean(name, query).count()


def shell(engine: TextEngine, name: str, lines: Iterable[str], scored: bool = False) -> Iterator[str]:
    """Answers to lines `tag<TAB>query`: `tag<TAB>count`, or the best document's score."""
    for line in lines:
        tag, _, query = line.rstrip("\n").partition("\t")
        if not query:
            continue
        try:
            if scored:
                best = engine.boolean(name, query, True).agg({"score": "max"}).first()[0]
                yield f"{tag}\t{best or 0}"
            else:
                yield f"{tag}\t{engine.count_agg(name, query)}"
        except QueryError as error:
            yield f"{tag}\terror: {error}"


def offline(engine: TextEngine, name: str, path: str, rounds: int = 1) -> dict[str, float]:
    """Ask the queries of a text file, a line each, `rounds` times over: how many were asked, how many found anything, how many failed, and queries a second."""
    lines = [r.value for r in engine.spark.read.text(path).collect() if r.value.strip()]
    done = {"queries": 0, "found": 0, "errors": 0}
    began = time.perf_counter()
    for query in lines * rounds:
        done["queries"] += 1
        try:
            done["found"] += not engine.boolean(name, query).isEmpty()
        except QueryError:
            done["errors"] += 1
    return done | {"per_second": done["queries"] / max(1e-9, time.perf_counter() - began)}


def concurrent(engine: TextEngine, name: str, lines: Iterable[str], workers: int = 32) -> Iterator[str]:
    """Answers to lines `searches<TAB>query`, in their order: `query<TAB>count`. As many searches as the last line said run at once, `workers` at most.

    They share the session's executors by Spark's fair scheduler where the session has it.
    """

    def ask(query: str) -> str:
        try:
            return f"{query}\t{engine.count_agg(name, query)}"
        except QueryError as error:
            return f"{query}\terror: {error}"

    running: deque = deque()
    with ThreadPoolExecutor(workers) as pool:
        for line in lines:
            hint, _, query = line.rstrip("\n").partition("\t")
            if not query:
                continue
            while len(running) >= min(workers, max(1, int(hint))):
                yield running.popleft().result()
            running.append(pool.submit(ask, query))
        while running:
            yield running.popleft().result()


def commands(index: SegmentedIndex, lines: Iterable[str]) -> Iterator[str]:
    """Answers to JSON lines {cmd, text, meta}: SEARCH, INSERT, DELETE, UPDATE, MERGE, SEGLEN; meta is a document's id."""
    for line in lines:
        c = json.loads(line)
        cmd, text, doc_id = c["cmd"].upper(), c.get("text", ""), c.get("meta")
        if cmd == "SEARCH":
            yield str(index.count(text))
            continue
        if cmd == "INSERT":
            index.add_document(int(doc_id), text)
            index.commit()
        elif cmd == "DELETE":
            index.delete_document(int(doc_id))
        elif cmd == "UPDATE":
            index.update_documents(index.spark.createDataFrame([(int(doc_id), text)], "doc_id bigint, text string"))
            index.commit()
        elif cmd == "MERGE":
            index.flush()
            index.merge()
        elif cmd == "SEGLEN":
            yield str(index.segment_num())
            continue
        else:
            yield f"error: {cmd}"
            continue
        yield "ok"


if __name__ == "__main__":
    session = SparkSession.builder.appName("search").getOrCreate()
    shell_engine = TextEngine(session)
    shell_engine.register_documents("docs", session.read.parquet(sys.argv[1]))
    for answer in shell(shell_engine, "docs", sys.stdin, "--scored" in sys.argv):
        print(answer, flush=True)
