"""Boolean and scored search over postings.

One pass answers a predicate of any nesting: postings of its terms are
gathered by document and the predicate is a column over the gathered terms.
Terms are filtered in the scan; one shuffle moves (document, term) pairs of
matching terms only, already combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.text.index import BLOCK
from lexispark.text.query import Predicate, array_has, normalise, parse
from lexispark.text.tokenize import MAX_TF, query_terms


def _predicate(query: str | Predicate) -> Predicate:
    return parse(query) if isinstance(query, str) else normalise(query)


def search(postings: DataFrame, query: str | Predicate, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The keys of documents that match.

    postings: (key, term, …). A predicate that a document without any of the
    terms can match (a bare NOT) needs docs, all keys there are.
    """
    p = _predicate(query)
    some = postings.where(F.col("term").isin(sorted(p.terms())))
    if p.positive():
        return some.groupBy(key).agg(F.collect_set("term").alias("terms")).where(p.column(array_has())).select(key)
    if docs is None:
        raise ValueError("this predicate also matches documents without any of its terms: pass docs")
    wrong = some.groupBy(key).agg(F.collect_set("term").alias("terms")).where(~p.column(array_has())).select(key)
    return docs.select(key).distinct().join(wrong, key, "left_anti")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once a row however often `use` names it: the optimiser can't copy it into each place."""
    return F.transform(F.array(value), use)[0]


def _alone(term: str) -> str:
    """A pattern for a term with no letter or digit on either side. The term comes first, so that a plain scan finds it."""
    return rf"{term}(?![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]{term})"


def _found(low: Column, term: str) -> Column:
    """Whether a lower-case text has a term; what is no term of the tokeniser is in no text."""
    return low.rlike(_alone(term)) if query_terms(term) == [term] else F.lit(False)


def search_documents(docs: DataFrame, query: str | Predicate, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of rows whose text matches, from the texts alone: no index, no tokens, no shuffle. For corpora that are searched once.

    Each row is a document; null texts have no terms, so only a NOT finds them.
    """
    p = _predicate(query)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.where(_once(low, lambda x: p.column(lambda t: _found(x, t)))).select(key)


def scored_documents(docs: DataFrame, query: str | Predicate, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tfs, score) of matching rows, likewise."""
    p = _predicate(query)
    if not p.positive():
        raise ValueError("a score needs a predicate that asks for a term")

    def times(x: Column, term: str) -> Column:
        found = F.regexp_count(x, F.lit(_alone(term))) if query_terms(term) == [term] else F.lit(0)
        return F.struct(F.lit(term).alias("key"), F.least(found, F.lit(MAX_TF)).cast("smallint").alias("value"))

    low = F.lower(F.col(text))
    hits = docs.where(_once(F.coalesce(low, F.lit("")), lambda x: p.column(lambda t: _found(x, t))))
    counted = _once(low, lambda x: F.array(*[times(x, t) for t in sorted(p.terms())]))
    found = hits.select(key, F.map_from_entries(F.filter(counted, lambda e: e["value"] > 0)).alias("tfs"))
    return found.select(key, "tfs", F.aggregate(F.map_values("tfs"), F.lit(0).cast("long"), lambda a, x: a + x).alias("score"))


def count(postings: DataFrame, query: str | Predicate, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row: how many documents match."""
    return search(postings, query, docs, key).agg(F.count("*").alias("n_docs"))


def scored(postings: DataFrame, query: str | Predicate, key: str = "doc_id") -> DataFrame:
    """(key, tfs, score) of matching documents: frequencies of the query's terms in each, and their sum."""
    p = _predicate(query)
    if not p.positive():
        raise ValueError("a score needs a predicate that asks for a term")
    some = postings.where(F.col("term").isin(sorted(p.terms())))
    held = some.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "tf")))).alias("tfs"), F.sum(F.col("tf").cast("long")).alias("score"))
    return held.where(p.column(lambda t: F.map_contains_key("tfs", t)))


#: Predicates answered by one array expression; more take several arrays, joined to one.
BATCH = 64


def search_many(postings: DataFrame, queries: dict[str, str | Predicate], key: str = "doc_id") -> DataFrame:
    """(tag, key): the matches of many queries by their tags, from one scan and one shuffle.

    The terms of all queries are filtered in the scan and gathered by document
    once; each query is then a column over the gathered terms. Every query has
    to ask for a term.
    """
    parsed = {tag: _predicate(q) for tag, q in queries.items()}
    if open_ := [tag for tag, p in parsed.items() if not p.positive()]:
        raise ValueError(f"these also match documents without any of their terms: {open_}")
    asked = sorted(set().union(*(p.terms() for p in parsed.values())))
    held = postings.where(F.col("term").isin(asked)).groupBy(key).agg(F.collect_set("term").alias("terms"))
    tags, found = list(parsed), []
    for at in range(0, len(tags), BATCH):
        hits = [F.when(parsed[tag].column(array_has()), F.lit(tag)) for tag in tags[at : at + BATCH]]
        found.append(F.array_compact(F.array(*hits)))
    return held.select(key, F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("tag")).select("tag", key)


def count_many(postings: DataFrame, queries: dict[str, str | Predicate], key: str = "doc_id") -> DataFrame:
    """(tag, n_docs) of every query, those without a match too."""
    counted = search_many(postings, queries, key).groupBy("tag").agg(F.count("*").alias("n"))
    asked = postings.sparkSession.createDataFrame([(tag,) for tag in queries], "tag string")
    return asked.join(counted, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"))


def surviving_blocks(index: DataFrame, query: str | Predicate) -> DataFrame:
    """The blocks that can hold a match: the predicate over block sets, NOT left open."""
    p = _positive_part(_predicate(query))
    some = index.where(F.col("term").isin(sorted(p.terms()))).select("term", "block")
    return some.groupBy("block").agg(F.collect_set("term").alias("terms")).where(p.column(array_has())).select("block")


def _positive_part(p: Predicate) -> Predicate:
    """What every match has to fulfil, without negations (a block with a term also holds documents without it)."""
    from lexispark.text.query import And, Not, Or, Term, Xor

    if isinstance(p, And):
        parts = tuple(_positive_part(x) for x in p.parts if not isinstance(x, Not) and x.positive())
        return parts[0] if len(parts) == 1 else And(parts)
    if isinstance(p, Or):
        return Or(tuple(_positive_part(x) for x in p.parts))
    if isinstance(p, Xor):
        return Or(tuple(map(Term, sorted(p.terms()))))  # that a block has a term says nothing about a document's parity
    if isinstance(p, Term):
        return p
    raise ValueError("a bare NOT leaves every block open")


def search_blocks(index: DataFrame, query: str | Predicate) -> DataFrame:
    """(doc_ord) by the block index: blocks are pruned first, and only chunks of surviving blocks are unfolded."""
    p = _predicate(query)
    if not p.positive():
        raise ValueError("a predicate that matches documents without any of its terms needs all documents: use search()")
    some = index.where(F.col("term").isin(sorted(p.terms()))).select("term", "block", "offs")
    kept = some.join(surviving_blocks(index, p), "block", "left_semi")
    unfolded = kept.select("term", "block", F.explode("offs").alias("off"))
    held = unfolded.groupBy("block", "off").agg(F.collect_set("term").alias("terms"))
    return held.where(p.column(array_has())).select((F.col("block").cast("long") * BLOCK + F.col("off")).alias("doc_ord"))


def count_bitmaps(bits: DataFrame, query: str | Predicate) -> DataFrame:
    """One row: matches by bitmap algebra, for a flat AND or OR of terms."""
    from lexispark.text.query import And, Or, Term

    p = _predicate(query)
    if isinstance(p, Term):
        p = And((p,))
    if not isinstance(p, And | Or) or not all(isinstance(x, Term) for x in p.parts):
        raise ValueError("bitmaps answer a flat AND or OR of terms")
    some = bits.where(F.col("term").isin(sorted(p.terms())))
    if isinstance(p, Or):
        joined = some.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    else:
        joined = some.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(p.parts))
    return joined.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_docs"))
