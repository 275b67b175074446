"""Quality rules: base counts of a text, and cross-document line frequency per host.

One pass over the texts writes small facts: the counts of a document, and for
each of its lines a hash and a word count.  Everything else reads those facts.
Lines are counted over the distinct documents of a host, and equal texts are one
document: copies of a clean document do not make its own lines look like
boilerplate.  A line of more than ``LINE_WORDS`` words is a passage and not
boilerplate; passages that near copies share are left to line dedup and
near-dedup.  :func:`keep_good` gives the documents that pass, without those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, ascii_lower, let, lookup, materialize, strip, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is removed when more than LINE_DOCS distinct documents of its host hold it, for every started PER_DOCS documents of
#: the host.  Published rate: lines found more than six times in a bucket of thirty million documents.
LINE_DOCS, PER_DOCS = 6, 30_000_000
#: Words of the longest line that can be boilerplate.
LINE_WORDS = 40
#: A document is depleted when more than this share of its words stood in removed lines.
DEPLETED_PERCENT = 30


def repeat_words(found: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words which stands twice or more in the array ``found``.

    Linear but for a sort: windows are hashed, and only an array with a repeated
    hash is sorted by (hash, position); each repeated window then adds the words
    the one before it does not cover.
    """
    hashes = F.when(F.size(found) >= size, F.transform(F.sequence(F.lit(1), F.size(found) - (size - 1)), lambda i: F.xxhash64(F.slice(found, i, size)))).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(tagged, lambda s: let(F.array_sort(F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"])), spans))

    def spans(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size)))), F.lit(0), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def host_hash(host: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(host), F.lit("")), F.col(host).isNull())


def line_hash(host: Column, line: Column) -> Column:
    """Hash of a line of a host; case and white space at the ends do not count."""
    return F.xxhash64(host, ascii_lower(strip(line)))


def facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts, text hash, host hash and hashed lines of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), host_hash(host).alias("host"))
    dense, lines = F.translate("_text", SPACE_CHARS, ""), F.split("_text", "\n", -1)
    parts = F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.struct(line_hash(F.col("host"), x).alias("line"), F.size(F.split(strip(x), SPACE + "+")).alias("w"), F.xxhash64(x).alias("raw")))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("_text").alias("text_hash"),
        let(words(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("a"),
        let(dense, lambda d: F.struct(F.length(d).cast("long").alias("word_chars"), (F.octet_length(d) - F.octet_length(F.translate(d, SYMBOLS, ""))).cast("long").alias("n_symbols"))).alias("b"),
        let(parts, lambda p: F.struct((F.size(p) - F.size(F.array_distinct(p["raw"]))).cast("long").alias("n_dup_lines"), p["line"].alias("line"), p["w"].alias("w"))).alias("c"),
    )
    return rows.select("doc_id", "host", "text_hash", "a.*", "b.*", "c.*")


def boilerplate(found: DataFrame, line_docs: int = LINE_DOCS, line_words: int = LINE_WORDS) -> DataFrame:
    """Line hashes (host included) that stand in too many distinct documents of their host."""
    hosts = found.groupBy("host", "text_hash").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("n_docs"))
    short = F.filter(F.arrays_zip("line", "w"), lambda x: x["w"] <= line_words)["line"]
    lines = found.select("host", "text_hash", F.explode(F.array_distinct(short)).alias("line")).distinct()
    often = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("host").alias("host")).filter(F.col("n") > line_docs)
    limit = line_docs * F.ceil(F.col("n_docs") / PER_DOCS)
    return lookup(often, hosts, ["host"], F.col("line"), "inner").filter(F.col("n") > limit).select("line")


def quality(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_words: int = LINE_WORDS, depleted_percent: int = DEPLETED_PERCENT) -> DataFrame:
    """Per row: doc_id, the base counts, n_removed_words, base_failed and kept.

    Null and empty texts have no words and fail the base rule.  A null host is
    a host of its own.  Rows that repeat both doc_id and text get the same
    verdict; a repeated or null doc_id with another text is another document.
    Whole texts count, however long.  Other columns of ``docs`` are not read.
    """
    found = materialize(facts(docs, host), "facts")
    return verdicts(found, boilerplate(found, line_docs, line_words), depleted_percent)


def verdicts(found: DataFrame, bad: DataFrame, depleted_percent: int = DEPLETED_PERCENT) -> DataFrame:
    """The result of :func:`quality` from the facts and the hashes of lines to remove."""
    key = ["doc_id", "host", "text_hash"]
    hits = lookup(found.select(*key, F.posexplode(F.arrays_zip("line", "w")).alias("at", "x")).select(*key, "at", "x.line", "x.w"), bad, ["line"], F.col("text_hash"), "inner")
    lost = hits.select(*key, "at", "w").distinct().groupBy(*key).agg(F.sum("w").alias("n_removed_words"))
    lost = lost.select(*(F.col(k).alias(f"_{k}") for k in key), "n_removed_words")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = found.drop("line", "w").join(lost, same[0] & same[1] & same[2], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    rows = rows.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed_words") <= depleted_percent * F.col("n_words")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept", "text_hash", "host")


def keep_good(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_words: int = LINE_WORDS, depleted_percent: int = DEPLETED_PERCENT) -> DataFrame:
    """``docs`` without the rows that :func:`quality` rejects, and without boilerplate lines in the texts it keeps.

    ``n_chars`` follows the text; a null text stays null.  Texts without such a line stay as they are.
    """
    found = materialize(facts(docs, host), "facts")
    bad = materialize(boilerplate(found, line_docs, line_words), "boilerplate")
    good = verdicts(found, bad, depleted_percent).filter("kept").select("doc_id", "host", "text_hash").distinct()
    lines = found.select("host", "text_hash", F.explode(F.array_distinct("line")).alias("line")).distinct()
    gone = lookup(lines, bad, ["line"], F.col("text_hash"), "inner").groupBy("host", "text_hash").agg(F.collect_set("line").alias("_gone"))
    good = good.join(gone, ["host", "text_hash"], "left").select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), "_gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", host_hash(host).alias("_h"))
    same = rows["doc_id"].eqNullSafe(good["_doc"]) & (rows["_h"] == good["_host"]) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == good["_hash"])
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: (strip(x) == "") | ~F.array_contains("_gone", line_hash(F.col("_h"), x))), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast("long")))
    return rows.join(good, same).withColumn("_text", text).select(row.alias("_row")).select("_row.*")
