"""The inverted index: postings in blocks of documents, and term statistics.

Documents get ordinals; `BLOCK` ordinals make a block. For each term and block
the index holds the offsets of the documents that have the term and how often.
Everything is a table; none grows a column with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.shared import partitions, spread, stored
from lexispark.text.tokenize import MAX_TF, SEPARATOR, terms

BLOCK = 512


def ordinals(docs: DataFrame, doc_id: str = "doc_id", first: int = 0) -> DataFrame:
    """(doc_id, doc_ord): dense ordinals from `first` in order of doc_id, one for each different id; only ids move.

    Ordinals are a range partition's rank plus what the partitions before hold,
    so nothing is sorted in one task. The ranks are written down once: ranges
    are cut by sampling and need not come out alike a second time.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id")).distinct()
    ordered = ids.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id")
    numbered = ordered.select("doc_id", F.monotonically_increasing_id().alias("at"))
    numbered = stored(numbered.select("doc_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth")), "ordinals")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    # a row a partition
    return numbered.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("nth") + first).alias("doc_ord"))


def with_ordinals(docs: DataFrame, doc_id: str = "doc_id", first: int = 0) -> DataFrame:
    """docs with doc_ord; for rows that are small."""
    ords = ordinals(docs, doc_id, first)
    return docs.join(ords, docs[doc_id] == ords["doc_id"]).select(docs["*"], "doc_ord")


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: int = 0, ords: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_ord, term, tf): the postings of a corpus with their documents' ordinals; a null id has no ordinal.

    Texts move once, by document, and meet their ordinals there; they are then
    cut and counted where they are, so no posting is shuffled.
    """
    ords = ordinals(docs, doc_id, first) if ords is None else ords
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition(spread(docs), "doc_id")
    met = texts.join(ords.select("doc_id", "doc_ord").hint("shuffle_hash"), "doc_id", "left")
    counted = met.select("doc_id", "doc_ord", F.explode(terms(F.col("text"))).alias("term"))
    found = counted.groupBy("doc_id", "doc_ord", "term").agg(F.count("*").alias("tf"))
    return found.select("doc_id", "doc_ord", "term", F.least("tf", F.lit(MAX_TF)).cast("smallint").alias("tf"))


def blocks(flat: DataFrame) -> DataFrame:
    """(term, block, offs, tfs) of postings (doc_ord, term, tf), and doc_ids where they have a doc_id; offsets ascend."""
    return folded(entries(flat))


def entries(flat: DataFrame) -> DataFrame:
    """(term, block, off, tf) of postings (doc_ord, term, tf), and their doc_id if they have one."""
    block, off = F.expr(f"doc_ord div {BLOCK}").cast("int"), F.expr(f"doc_ord % {BLOCK}").cast("smallint")
    return flat.select("term", block.alias("block"), off.alias("off"), "tf", *[c for c in ("doc_id",) if c in flat.columns])


def folded(rows: DataFrame) -> DataFrame:
    """The blocks of entries; nothing moves if those of a term and block are in one partition."""
    more = [c for c in ("doc_id",) if c in rows.columns]
    held = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("off", "tf", *more))).alias("entries"))
    return held.select("term", "block", F.col("entries.off").alias("offs"), F.col("entries.tf").alias("tfs"), *[F.col(f"entries.{c}").alias(f"{c}s") for c in more])


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: int = 0) -> DataFrame:
    """The block index of a corpus. Texts are cut to terms where they are; a block's postings meet in one shuffle, in tasks of bounded size."""
    found = placed(docs, doc_id, text, first).where("doc_ord is not null")
    return folded(entries(found.drop("doc_id")).repartition(spread(docs), "term", "block"))


def block_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mb: int = 4) -> DataFrame:
    """(term, block, n_docs, sum_tf) of a corpus: what its blocks come to, without their postings. Rows of null id have no block.

    Documents are dealt by slices of whole blocks, about `mb` MB of files each, so texts move once and are cut,
    counted and summed where they are. Only the first id of each slice comes to the driver; a document finds its
    slice among those by bisection.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    n = spread(docs, mb)
    ords = stored(ordinals(rows), "ordinals")
    size = BLOCK * max(1, -(-ords.count() // (BLOCK * n)))
    firsts = [r.doc_id for r in ords.where(F.col("doc_ord") % size == 0).orderBy("doc_ord").collect()]
    slices = max(1, len(firsts))
    low, high = F.lit(0), F.lit(slices)
    starts = F.array(*map(F.lit, firsts)).cast(f"array<{dict(ords.dtypes)['doc_id']}>")

    def halved(at, _):
        middle = F.floor((at.low + at.high) / 2).cast("int")
        right = F.get(starts, middle) <= F.col("doc_id")
        return F.struct(F.when(right, middle).otherwise(at.low).alias("low"), F.when(right, at.high).otherwise(middle).alias("high"))

    if slices > 1:
        low = F.aggregate(F.sequence(F.lit(1), F.lit((slices - 1).bit_length())), F.struct(low.alias("low"), high.alias("high")), halved, lambda at: at.low)
    dealt = rows.select("doc_id", "text", low.alias("slice")).repartition(n, "slice")
    nth = F.dense_rank().over(Window.partitionBy("slice").orderBy("doc_id")) - 1
    placed = dealt.select("slice", "doc_id", (F.col("slice") * (size // BLOCK) + F.floor(nth / BLOCK)).cast("int").alias("block"), "text")
    found = placed.select("slice", "doc_id", "block", F.explode(F.split(F.lower("text"), SEPARATOR)).alias("term")).where("term <> ''")
    counted = found.groupBy("slice", "block", "doc_id", "term").agg(F.least(F.count("*"), F.lit(MAX_TF)).alias("tf"))
    summed = counted.groupBy("slice", "block", "term").agg(F.count("*").cast("int").alias("n_docs"), F.sum("tf").alias("sum_tf"))
    return summed.select("term", "block", "n_docs", "sum_tf")


def flat(index: DataFrame) -> DataFrame:
    """(doc_ord, term, tf) of a block index."""
    entry = F.explode(F.arrays_zip("offs", "tfs")).alias("e")
    return index.select("term", "block", entry).select((F.col("block").cast("long") * BLOCK + F.col("e.offs")).alias("doc_ord"), "term", F.col("e.tfs").alias("tf"))


def bitmaps(index: DataFrame) -> DataFrame:
    """(term, bucket, bits): the same postings as bitmaps of 32768 documents, the size that bitmap aggregates work on."""
    at = F.col("doc_ord") + 1
    placed = flat(index).select("term", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return placed.groupBy("term", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, nums, n_blocks, selectivity): documents with the term, blocks that have it, and how full those are."""
    found = index.groupBy("term").agg(F.sum(F.size("offs")).cast("long").alias("nums"), F.count("*").alias("n_blocks"))
    return found.withColumn("selectivity", F.col("nums") / (F.col("n_blocks") * F.lit(BLOCK).cast("double")))


def stats_of(stats: DataFrame, terms: list[str]) -> DataFrame:
    """The statistics of some terms; unknown terms give no row."""
    return stats.where(F.col("term").isin(terms))


def term_range(index: DataFrame, low: str, high: str) -> DataFrame:
    """The postings of terms from low to high, both included."""
    return index.where(F.col("term").between(low, high))
