"""Line dedup: which lines of every document stay, as compressed keep bitmaps.

Long lines that several documents share stay only in the document with the
largest doc_id.  Line hashes are range-partitioned (equal ranges of a uniform
hash, so no sampling pass) with a secondary sort by document and position; each
partition streams through its hashes and knows the first document of every one
as it comes.  Texts are read twice, to hash lines and to apply the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, partitions, strip

MIN_CHARS = 20
MIN_DOCS = 3
#: Hashes with at least 1 / (PART * partitions) of all lines are dealt over all partitions by document.
PART = 4
#: At most so many hashes are dealt that way; the number is a matter of balance, not of results.
MOST_HEAVY = 2000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def entries(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, n_lines, pos, h1, h2) of every line whose key is long enough."""
    hashed = lambda x: let(ascii_lower(strip(x)), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"))))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(lines(F.col("text")), lambda x: F.struct(F.size(x).alias("n_lines"), F.transform(x, hashed).alias("keys"))).alias("x"))
    rows = rows.select("doc_id", "text_hash", "x.n_lines", F.posexplode("x.keys").alias("pos", "key"))
    return rows.filter("key is not null").select("doc_id", "text_hash", "n_lines", "pos", "key.h1", "key.h2")


def heavy_hashes(found: DataFrame, n: int) -> list[int]:
    """Hashes frequent enough to unbalance ``n`` partitions: one sketch over all entries, a bounded list back."""
    k = min(PART * n, MOST_HEAVY)
    row = found.agg(F.expr(f"approx_top_k(h1, {k}, {max(10_000, 4 * k)})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] * PART * n >= row["n"] and x["count"] > 1]


def dropped(found: DataFrame, min_docs: int = MIN_DOCS, parts: int | None = None) -> DataFrame:
    """The (doc_id, text_hash, n_lines, pos) among ``found`` that go."""
    n = parts or partitions(found.sparkSession)
    heavy = F.col("h1").isin(heavy_hashes(found, n))
    ranged = F.shiftright((F.shiftright("h1", 32) + F.lit(1 << 31)) * F.lit(n), 32)
    rows = found.withColumn("heavy", heavy).withColumn("part", F.when(F.col("heavy"), F.pmod(F.xxhash64("h1", "doc_id"), F.lit(n))).otherwise(ranged).cast("int"))
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", "h1", "h2", F.desc_nulls_last("doc_id"), "pos")
    group = W.partitionBy("part", "h1", "h2")
    turn = group.orderBy(F.desc_nulls_last("doc_id"))
    rows = rows.withColumn("turn", F.dense_rank().over(turn)).withColumn("first", F.first("doc_id").over(turn)).withColumn("docs", F.max("turn").over(group))
    # A hash inside one range is settled here; a dealt one has a first document in each partition.
    rows = materialize(rows.filter(F.col("heavy") | ((F.col("turn") > 1) & (F.col("docs") >= min_docs))).select("doc_id", "text_hash", "n_lines", "pos", "h1", "h2", "heavy", "part", "first", "docs"), "streamed")
    firsts = rows.filter("heavy").groupBy("part", "h1", "h2").agg(F.first("first").alias("first"), F.first("docs").alias("docs"))
    firsts = firsts.groupBy("h1", "h2").agg(F.max("first").alias("first"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    dealt = rows.filter("heavy").drop("first", "docs").join(F.broadcast(firsts), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    out = ["doc_id", "text_hash", "n_lines", "pos"]
    return rows.filter("not heavy").select(*out).unionByName(dealt.select(*out))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, parts: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_lines, keep) for documents that lose a line.

    ``keep`` is the run-length form of the keep bitmap: the runs (start from 1,
    length) of lines that stay.
    """
    gone = dropped(materialize(entries(docs, min_chars), "entries"), min_docs, parts)
    gone = gone.groupBy("doc_id", "text_hash", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("a"), F.concat("gone", F.array("n_lines")).alias("b"))
    runs = F.filter(F.transform(ends, lambda e: F.struct((e["a"] + 2).alias("start"), (e["b"] - e["a"] - 1).alias("length"))), lambda r: r["length"] > 0)
    return gone.select("doc_id", "text_hash", "n_lines", runs.alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (what stays), ``_lines`` and ``_dropped``; no other column changes."""
    marks = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep").alias("_keep"))
    rows = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left")
    stays = F.when(F.col("_keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(let(lines(F.col("text")), lambda x: F.flatten(F.transform("_keep", lambda r: F.slice(x, r["start"], r["length"])))), "\n"))
    left = F.aggregate("_keep", F.lit(0), lambda a, r: a + r["length"])
    n = F.size(lines(F.col("text"))).cast("long")
    rows = rows.withColumn("_text", stays).withColumn("_lines", n).withColumn("_dropped", F.coalesce(n - left, F.lit(0)).cast("long"))
    return rows.drop("_doc", "_hash", "_keep")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line.  A null doc_id counts as one
    document, smaller than all others.  Rows that repeat a doc_id are the same
    document: lines they share with no other document stay in all of them.
    """
    rows = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.col("_text"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines gone from ``text`` and ``n_chars`` to match; a null text stays null."""
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    rows = apply_bitmaps(own, keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    text = F.when(F.col("text").isNotNull(), F.col("_text"))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return rows.select(row.alias("_row")).select("_row.*")
