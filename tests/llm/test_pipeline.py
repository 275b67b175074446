"""Every stage against the brute-force version of its operator, on the rows the stage before it kept."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_linededup import brute_force as line_dedup
from test_minhash import brute_force as near_dedup
from test_packing import check as check_packing
from test_quality import brute_force as quality_rules

from plumbline.llm import mixing, queries
from plumbline.llm.common import materialize


def test_stages(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    docs, names = documents, documents.columns
    kept = [materialize(docs, "documents")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == names and out.dtypes == documents.dtypes, name
        kept.append(materialize(out, "stage"))
    rows = [x.collect() for x in kept]

    good = {r[0] for r in quality_rules([(r.doc_id, r.text, r.source) for r in rows[0]]) if r[-1]}
    assert sorted(r.doc_id for r in rows[1]) == sorted(good)

    import hashlib

    want = {r[0]: r[3] for r in line_dedup([(r.doc_id, r.text) for r in rows[1]])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows[2]} == want
    assert all(r.n_chars == len(r.text) for r in rows[2])

    alone = {d for d, _, c in near_dedup([(r.doc_id, r.text) for r in rows[2]], 5) if d == c}
    assert sorted(r.doc_id for r in rows[3]) == sorted(alone)

    copies = {r.doc_id: r.n_copies for r in mixing.mix(kept[3], mixing.by_length()).collect() if r.n_copies}
    assert {r.doc_id: r["count"] for r in kept[4].groupBy("doc_id").count().collect()} == copies

    from tokenizers import Tokenizer

    once = kept[4].dropDuplicates(["doc_id"])
    check_packing(once, Tokenizer.from_file(queries.TOKENIZER_JSON))
    final = corpus_pipeline.run(spark, sf)
    pieces = final.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n // r.t for r in pieces} == copies


def awkward(docs):
    prose = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"{prose(i)}\n{prose(-i, 25)}", f"s{i % 3}") for i in range(1, 30)]
    rows += [(None, prose(100), "s0"), (None, prose(101), None), (40, None, "s1"), (41, "", "s1"), (42, "\n\n", None), (5, rows[4][1], "s2"), (5, prose(102), "s2"), (43, rows[6][1], "s0"), (44, prose(103, 40000), "s1")]
    clash = {"size": F.lit(1), "rank": F.lit("r"), "value": F.lit("v"), "host": F.lit("h"), "line": F.lit("l"), "_row": F.lit(0), "text_hash": F.lit("t"), "class_id": F.lit(2), "key": F.lit("k"), "start": F.lit(3), "kept": F.lit(None).cast("boolean")}
    return docs(rows, clash)


def test_awkward_rows_and_clashing_columns(spark, sf, docs):
    kept = awkward(docs)
    names, kinds = kept.columns, kept.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, sf), "stage")
        assert kept.columns == names and kept.dtypes == kinds, name
        if name == "quality rules":
            assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*range(1, 30), 5, 5, 43, 44, None, None], key=repr)
        if name == "MinHash near-dedup":  # 43 copies 7, one row repeats 5 whole
            assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*range(1, 30), 5, 5, 44, None, None], key=repr)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and len({r.doc_id for r in pieces}) > 20


def test_empty_table(spark, sf, docs):
    kept = docs([])
    for _, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, kept, sf), "stage")
        assert kept.count() == 0


def test_every_operator_has_its_query():
    found = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)
