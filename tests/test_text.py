from __future__ import annotations

import random

import pytest

from lexispark.shared import spread
from lexispark.text import index as indexing
from lexispark.text import search as searching
from lexispark.text.engine import TextEngine, commands, shell
from lexispark.text.query import And, Not, Or, QueryError, Term, must, must_not, normalise, parse, parse_infix, parse_prefix, should, xor
from lexispark.text.segments import MergePolicy, SegmentedIndex
from lexispark.text.store import IndexStore
from lexispark.text.tokenize import postings

WORDS = ["ash", "birch", "cedar", "elm", "fir", "ñandú"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(1500)] + [(5000, None), (5001, "Ash, BIRCH! x" + " elm" * 300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache(), {i: set((t or "").lower().replace(",", "").replace("!", "").split()) for i, t in rows}


@pytest.fixture(scope="module")
def flat(corpus):
    return postings(corpus[0]).cache()


def holds(p, words):
    match p:
        case Term(term):
            return term in words
        case And(parts):
            return all(holds(x, words) for x in parts)
        case Or(parts):
            return any(holds(x, words) for x in parts)
        case Not(part):
            return not holds(part, words)
        case _:
            return sum(holds(x, words) for x in p.parts) % 2 == 1


QUERIES = ["ash AND birch", "ash OR birch AND cedar", "ash AND (birch OR (cedar AND elm))", "NOT ash AND birch", "NOT (ash OR elm)", "+ash birch", "ash +birch +cedar", "+ash +(birch cedar)", "nowhere OR ash", "nowhere AND ash", "ash", "ñandú OR fir"]


@pytest.mark.parametrize("text", QUERIES)
def test_search_is_set_algebra(corpus, flat, text):
    docs, words = corpus
    p = parse(text) if "ñ" not in text else Or((Term("ñandú"), Term("fir")))
    want = {i for i, w in words.items() if holds(p, w)}
    assert {r.doc_id for r in searching.search(flat, p, docs).collect()} == want


@pytest.mark.parametrize("text", QUERIES)
def test_search_of_texts_needs_no_index(corpus, text):
    docs, words = corpus
    p = parse(text) if "ñ" not in text else Or((Term("ñandú"), Term("fir")))
    found = searching.search_documents(docs, p)
    assert {r.doc_id for r in found.collect()} == {i for i, w in words.items() if holds(p, w)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_scores_of_texts_are_those_of_the_index(corpus, flat):
    for text in ("elm AND x", "ash OR nowhere", "ash AND (birch OR elm)"):
        want = sorted((r.doc_id, r.score, sorted(r.tfs.items())) for r in searching.scored(flat, text).collect())
        assert sorted((r.doc_id, r.score, sorted(r.tfs.items())) for r in searching.scored_documents(corpus[0], text).collect()) == want
    with pytest.raises(ValueError):
        searching.scored_documents(corpus[0], "NOT elm")


def test_many_queries_in_one_pass(corpus, flat):
    _, words = corpus
    queries = {f"q{k}": q for k, q in enumerate(["ash AND birch", "elm OR x", "nowhere", "ash AND NOT elm"] + ["fir"] * searching.BATCH)}
    got = {r.tag: r.n_docs for r in searching.count_many(flat, queries).collect()}
    assert got == {tag: sum(holds(parse(q), w) for w in words.values()) for tag, q in queries.items()}
    with pytest.raises(ValueError):
        searching.search_many(flat, {"a": "ash", "b": "NOT ash"})


def test_laws(flat):
    n = lambda q: searching.count(flat, q).first()[0]
    assert n("ash AND elm") + n("ash OR elm") == n("ash") + n("elm")
    assert searching.count(flat, xor(Term("ash"), Term("elm"))).first()[0] == n("ash OR elm") - n("ash AND elm")


def test_infix_groups_to_the_left_and_words_are_greedy():
    assert str(parse_infix("a OR b AND c")) == "((a | b) & c)"
    assert str(parse("oak AND (oak OR oak)")) == "oak"
    assert str(parse_infix("aANDb")) == "aandb"
    assert str(normalise(parse_infix("a AND b AND (c OR d OR (e AND f))"))) == "(a & b & (c | d | (e & f)))"
    assert str(parse("v2.17-rc AND x")) == "(v2 & 17 & rc & x)"
    for bad in ("", "( a)", "a AND", " a", "a b", "''"):
        with pytest.raises(QueryError):
            parse_infix(bad)


def test_prefix_joins_to_the_right():
    assert str(parse_prefix("+a +b")) == "(a & b)"
    assert str(parse_prefix("a b")) == "(a | b)"
    assert str(parse_prefix("+a b")) == "(a & b)"
    assert str(parse_prefix("a +b +c")) == "(a | (b & c))"
    assert str(parse_prefix("+a +(b c)")) == "(a & (b | c))"
    for bad in ("(a b) c", "+", "a (b"):
        with pytest.raises(QueryError):
            parse_prefix(bad)


def test_builders():
    assert str(must(["a", "b", "c"]).build()) == "(a & b & c)"
    assert str(should(["a", "b"]).with_must(Term("c")).build()) == "((a | b) & c)"
    assert str(must_not(["a"]).build()) == "!a"
    assert normalise(Not(Not(Term("a")))) == Term("a")
    for f in (must, should):
        with pytest.raises(QueryError):
            f(["one"])


def test_scores_and_saturation(flat):
    rows = {r.doc_id: r for r in searching.scored(flat, "elm AND x").collect()}
    assert rows[5001].score == 256 and rows[5001].tfs == {"elm": 255, "x": 1}
    with pytest.raises(ValueError):
        searching.scored(flat, "NOT elm")


def test_blocks_and_bitmaps_agree_with_search(corpus, flat):
    docs, _ = corpus
    built = indexing.build(docs).cache()
    ords = indexing.with_ordinals(docs)
    assert sorted(r.doc_ord for r in ords.select("doc_ord").collect()) == list(range(1502))
    for text in ("ash AND birch", "ash AND (birch OR cedar)", "x OR nowhere", "ash AND NOT birch", "(ash OR x) AND NOT (birch AND elm)"):
        got = searching.search_blocks(built, text).join(ords, "doc_ord").select("doc_id")
        assert {r.doc_id for r in got.collect()} == {r.doc_id for r in searching.search(flat, text).collect()}
    both = xor(Not(Term("ash")), Not(Term("elm")))
    assert searching.search_blocks(built, both).count() == searching.search(flat, both).count()
    assert searching.surviving_blocks(built, "x AND ash").count() == 1
    bits = indexing.bitmaps(built)
    for p in (must(["ash", "elm"]), should(["ash", "elm", "x"]), Term("fir"), must(["ash", "nowhere"])):
        assert searching.count_bitmaps(bits, p).first()[0] == searching.count(flat, p).first()[0]
    assert indexing.flat(built).count() == flat.count()
    stats = {r.term: r for r in indexing.term_stats(built).collect()}
    assert stats["x"].nums == 1 and stats["x"].selectivity == 1 / 512


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert searching.search(postings(none), "a OR b").count() == 0
    assert searching.count(postings(none), "a").first()[0] == 0
    assert indexing.build(none).count() == 0


def test_segments(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/index")
    assert index.count("a OR b") == 0 and not index.commit()
    docs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    index.add_documents(docs([(1, "a b"), (2, "b c"), (3, None)]))
    assert index.count("b") == 0 and not index.commit() and index.flush()
    assert index.count("b") == 2 and index.segment_num() == 1
    index.delete_document(1)
    assert index.count("b") == 1 and index.count("a") == 0
    index.update_documents(docs([(2, "d")]))
    assert index.count("b OR d") == 0  # the old version is gone, the new one not committed
    index.flush()
    assert index.count("c") == 0 and index.count("d") == 1 and index.count("NOT d") == 1
    index.add_documents(docs([(1, "a again")]))
    index.flush()
    assert index.count("a AND again") == 1
    before = sorted(map(tuple, index.live_postings().select("doc_id", "term", "tf").collect()))
    index.compact()
    assert index.segment_num() == 1 and sorted(map(tuple, index.live_postings().select("doc_id", "term", "tf").collect())) == before
    index.add_document(50, "first version")
    index.add_document(50, "second")
    index.flush()
    assert index.count("version") == 0 and index.count("second") == 1
    again = SegmentedIndex(spark, f"file://{tmp_path}/index")
    assert again.count("a AND again") == 1
    index.add_documents(docs([(k, f"w{k} common") for k in range(100, 620)]))
    assert index.commit() and index.count("common") == 520


def test_merge_policy():
    policy = MergePolicy()
    assert policy.find({1: 10, 2: 20, 3: 30}) == []
    assert policy.find({k: 100 * k for k in range(1, 5)}) == [[1, 2, 3, 4]]
    assert policy.find({1: 5_000_000, 2: 4_900_000, 3: 10, 4: 10, 5: 10, 6: 10, 7: 99_000_000}) == [[3, 4, 5, 6]]


def test_merges_run_on_flush(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/index")
    for k in range(4):
        index.add_document(k, f"word{k} all")
        index.flush()
    assert index.segment_num() == 1 and index.count("all") == 4


def test_engine_and_shells(spark, corpus, tmp_path):
    engine = TextEngine(spark)
    assert engine.register_documents("docs", corpus[0]) is None
    assert engine.register_documents("docs", corpus[0]) is not None
    with pytest.raises(KeyError):
        engine.index("none")
    with pytest.raises(QueryError):
        engine.boolean("docs", "ash", strict=True)
    n = engine.count_agg("docs", "ash AND elm")
    assert engine.boolean("docs", must(["ash", "elm"]), is_score=True).count() == n
    assert list(shell(engine, "docs", ["q1\tash AND elm\n", "q2\t((", "nothing"])) == [f"q1\t{n}", "q2\terror: no term at ''"]
    assert list(shell(engine, "docs", ["q\telm AND x"], scored=True)) == ["q\t256"]
    index = SegmentedIndex(spark, f"file://{tmp_path}/c")
    lines = ['{"cmd": "INSERT", "text": "a b", "meta": "1"}', '{"cmd": "MERGE"}', '{"cmd": "SEARCH", "text": "a AND b"}', '{"cmd": "DELETE", "meta": "1"}', '{"cmd": "SEARCH", "text": "a"}', '{"cmd": "SEGLEN"}', '{"cmd": "X"}']
    assert list(commands(index, lines)) == ["ok", "ok", "1", "ok", "0", "1", "error: X"]


def _below_shuffles(plan: str, node: str) -> int:
    """The shuffles that stand above a node in a plan that isn't adapted yet."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if node in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), 0
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if d < depth:
            depth, above = d, above + ("Exchange" in line)
    return above


def test_postings_meet_their_ordinals_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (2, "b c"), (None, "a")], "doc_id bigint, text string")
    found = indexing.placed(docs)
    assert sorted(((r.doc_id, r.term, r.tf) for r in found.where("doc_id is not null").collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 2), (2, "c", 1)]
    assert [r.tf for r in found.where("doc_id is null and doc_ord is null").collect()] == [1]
    assert _below_shuffles(indexing.placed(docs)._jdf.queryExecution().executedPlan().toString(), "Generate") == 0
    assert _below_shuffles(indexing.build(docs)._jdf.queryExecution().executedPlan().toString(), "Generate") == 1


def test_bitmaps_are_made_for_the_terms_asked(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([(k, f"all w{k} {'even' if k % 2 == 0 else ''}") for k in range(700)], "doc_id bigint, text string")
    store = IndexStore.save(docs, path)
    assert "bitmaps" not in {p.name for p in tmp_path.joinpath("store").iterdir()}
    assert "In(term, [all,even])" in store.bitmaps.where("term in ('all', 'even')")._jdf.queryExecution().executedPlan().toString()
    assert searching.count_bitmaps(store.bitmaps, must(["all", "even"])).first()[0] == 350
    assert searching.count_bitmaps(store.bitmaps, should(["w3", "even"])).first()[0] == 351


def test_tasks_are_more_where_files_are_larger(spark, tmp_path):
    spark.range(1 << 20).selectExpr("id doc_id", "uuid() text").coalesce(1).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    assert spread(docs, 1) > 8 * spread(docs, 64)


def test_flush_counts_terms_where_documents_are(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, f"file://{tmp_path}/flush")
    plans, write = [], index._write

    def seen(seg, found, docs):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        write(seg, found, docs)

    monkeypatch.setattr(index, "_write", seen)
    index.add_documents(spark.createDataFrame([(1, "old"), (2, "b b"), (1, "new"), (3, None)], "doc_id bigint, text string").coalesce(1))
    assert index.flush() and not index.flush()
    assert _below_shuffles(plans[0], "Generate") == 0
    assert index.segments() == {1: 3}
    assert sorted((r.doc_id, r.term, r.tf) for r in index.live_postings().collect()) == [(1, "new", 1), (2, "b", 2)]


def test_block_stats_move_texts_once(spark, monkeypatch):
    """Blocks are counted where their texts are; repeated and null ids, null and empty texts, and many slices give what the postings say."""
    from pyspark.sql import functions as F

    rows = [(k * 7 - 3000, f"the w{k % 50} The x{k}") for k in range(1500)] + [(-3000, "again the"), (None, "lost the"), (9, None), (10**12, ""), (10**12 + 1, "last " * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = docs.where("doc_id is not null")
    want = sorted((r.term, r.block, len(r.offs), sum(r.tfs)) for r in indexing.build(kept).collect())
    found = indexing.block_stats(docs)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert {r[1] for r in want} == {0, 1, 2}
    assert _below_shuffles(found._jdf.queryExecution().executedPlan().toString(), "Generate") == 0
    monkeypatch.setattr(indexing, "BLOCK", 8)
    want = sorted((r.term, r.block, len(r.offs), sum(r.tfs)) for r in indexing.build(kept).collect())
    monkeypatch.setattr(indexing, "spread", lambda docs, mb=4: 33)
    assert sorted(tuple(r) for r in indexing.block_stats(docs).collect()) == want
    assert indexing.block_stats(docs.limit(0)).count() == 0
    assert indexing.block_stats(docs.where("doc_id is null")).select(F.count("*")).first()[0] == 0
