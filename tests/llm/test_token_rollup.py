import uuid
from collections import Counter

import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import common, queries, token_rollup

CHANGES = "source string, lang string, tokenizer string, op string, n_tokens long, before long"


@pytest.fixture
def rollup(spark):
    return token_rollup.Rollup(spark, common.scratch_path(spark, f"rollup-{uuid.uuid4().hex}"))


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def test_query_against_brute_force(spark, sf, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, tokens, deleted = Counter(), Counter(), 0
    for r in documents.collect():
        if len(r.text or "") < queries.SHORTEST:
            deleted += 1
            continue
        docs[r.source, r.lang] += 1
        tokens[r.source, r.lang] += len(t.encode(r.text, add_special_tokens=False).ids)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op9_token_rollup(spark, sf).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs} and deleted


def test_very_long_and_empty_texts(spark):
    rows = [("a", "en", None, 0), ("a", "en", "", 0), ("a", None, "word " * 200000, 0), (None, "en", "x" * 20000, None)]
    df = spark.createDataFrame(rows, "source string, lang string, text string, before long").withColumn("n_tokens", F.lit("clash"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_rollup.count_tokens(df, queries.TOKENIZER_JSON, queries.TOKENIZER_RANKS, public_tokenizers.PATTERN).collect()
    assert [r.n_tokens for r in got] == [len(t.encode(r[2] or "", add_special_tokens=False).ids) for r in rows]
    assert token_rollup.count_tokens(df.limit(0), queries.TOKENIZER_JSON).count() == 0


def test_a_lost_commit_leaves_nothing_behind_and_can_be_sent_again(spark, rollup, monkeypatch):
    batch = changes(spark, [("a", "en", "v1", "insert", 10, None)])
    rename = rollup.files.publish
    monkeypatch.setattr(rollup.files, "publish", lambda *x: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        rollup.commit("b", batch)  # the driver dies before its commit file is in place
    monkeypatch.setattr(rollup.files, "publish", rename)
    assert totals(rollup) == {} and rollup.committed() == []
    assert rollup.commit("b", batch) and totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_an_empty_commit_file_is_an_error_and_not_a_lost_batch(spark, rollup):
    rollup.files.publish("commits/b", "")
    with pytest.raises(OSError):
        rollup.commit("b", changes(spark, [("a", "en", "v1", "insert", 10, None)]))
    with pytest.raises(OSError):
        rollup.totals()


def test_totals_are_a_base_and_the_deltas_since(spark, rollup):
    rollup.compact_after, want = 3, 0
    for i in range(9):
        assert rollup.commit(f"b{i}", changes(spark, [("a", "en", "v1", "insert", i, None)]))
        assert not rollup.commit(f"b{i % 2}", changes(spark, [("a", "en", "v1", "insert", 100, None)]))
        want += i
        assert totals(rollup) == {("a", "en", "v1"): (i + 1, want)}
    base, since, inside, number = rollup._state()
    assert base and len(inside) == 8 and since == ["b8"] and number == 2
    # The deltas in the base are not read again.
    rollup.files.delete("deltas/b0")
    assert totals(rollup) == {("a", "en", "v1"): (9, want)} and not rollup.commit("b0", changes(spark, []))


def test_compaction_races_have_one_winner(spark, rollup, monkeypatch):
    for i in range(2):
        rollup.commit(f"b{i}", changes(spark, [("a", "en", "v1", "insert", 5, None)]))
    state = rollup._state()
    assert rollup.compact() and not rollup.compact()
    rollup.commit("b2", changes(spark, [("a", "en", "v1", "insert", 5, None)]))
    monkeypatch.setattr(rollup, "_state", lambda: state)  # another writer that looked before
    assert not rollup.compact()
    monkeypatch.undo()
    assert totals(rollup) == {("a", "en", "v1"): (3, 15)}


def test_inserts_deletes_and_revisions(spark, rollup):
    assert rollup.commit("b1", changes(spark, [("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None)]))
    assert rollup.commit("b2", changes(spark, [("a", "en", "v1", "revise", 7, 5), ("a", "en", "v1", "delete", 10, None), ("a", "en", "v2", "insert", 9, None)]))
    assert totals(rollup) == {("a", "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 9), (None, None, "v1"): (1, 0)}
    assert rollup.commit("b3", changes(spark, [("a", "en", "v1", "delete", 7, None)]))
    assert ("a", "en", "v1") not in totals(rollup)


def test_batches_count_once(spark, rollup):
    batch = changes(spark, [("a", "en", "v1", "insert", 10, None)])
    assert rollup.commit("b", batch) and not rollup.commit("b", batch)
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}
    # An attempt without a commit, as a lost driver leaves it, does not count.
    token_rollup.deltas(batch).write.parquet(f"{rollup.files.path}/deltas/lost/attempt")
    token_rollup.deltas(batch).write.parquet(f"{rollup.files.path}/deltas/b/second-attempt")
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)} and rollup.committed() == ["b"]


def test_a_race_has_one_winner(spark, rollup, monkeypatch):
    batch = changes(spark, [("a", "en", "v1", "insert", 10, None)])
    real = token_rollup.deltas

    def slow(x):
        monkeypatch.setattr(token_rollup, "deltas", real)
        assert rollup.commit("b", batch)  # another driver commits meanwhile
        return real(x)

    monkeypatch.setattr(token_rollup, "deltas", slow)
    assert not rollup.commit("b", batch)
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_bad_input(spark, rollup):
    with pytest.raises(PySparkException):
        rollup.commit("b", changes(spark, [("a", "en", "v1", "upsert", 1, None)]))
    with pytest.raises(PySparkException):
        rollup.commit("b", changes(spark, [("a", "en", "v1", None, 1, None)]))
    for name in ("", "a/b", ".hidden", "_x"):
        with pytest.raises(ValueError):
            rollup.commit(name, changes(spark, []))
    assert totals(rollup) == {}


def test_empty_batch_and_extra_columns(spark, rollup):
    assert rollup.commit("none", changes(spark, []))
    assert rollup.commit("b", changes(spark, [("a", "en", "v1", "insert", 3, 99)] * 2).withColumn("n_docs", F.lit("clash")))
    assert totals(rollup) == {("a", "en", "v1"): (2, 6)}
