import re
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.llm import quality

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def brute_force(rows, line_docs=quality.LINE_DOCS, line_words=quality.LINE_WORDS, depleted=quality.DEPLETED_PERCENT):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if 0 < len(WORD.findall(x)) <= line_words:
                holders[s, norm(x)].add(t)
    bad = {k for k, v in holders.items() if len(v) > line_docs}
    out = []
    for d, t, s in rows:
        b = base(t)
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (s, norm(x)) in bad)
        out.append((d, *b[:5], lost, b[5], not b[5] and 100 * lost <= depleted * b[0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]


def result(df, *limits):
    return sorted(map(tuple, quality.quality(df, "source", *limits).select(*COLUMNS).collect()), key=repr)


def test_against_brute_force_on_documents(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    assert result(documents) == brute_force(rows)
    assert result(documents, 1, 8, 10) == brute_force(rows, 1, 8, 10)


def test_the_rule_rejects_documents_of_the_table(spark):
    """At the limits of the query some documents go by the lines they share, and nothing else."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    want = brute_force(rows)
    assert result(documents) == want
    assert sum(not r[-1] and not r[-2] for r in want) > 0 and sum(r[6] > 0 for r in want) > 20


def test_depleted_documents_go_and_clean_ones_stay(docs):
    menu = ["home about us contact", "share this page with friends", "all rights reserved by the owner"]
    prose = lambda i, n: " ".join(f"word{i}x{j}" for j in range(n))
    depleted = [(i, "\n".join([*menu, prose(i, 8)]), "h") for i in range(8)]
    clean = [(20 + i, "\n".join([*menu, prose(20 + i, 80)]), "h") for i in range(8)] + [(40, depleted[0][1], "few"), (41, depleted[1][1], None)]
    passage = prose("p", 60)
    near = [(50 + i, f"{passage}\nown {i}", "n") for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.quality(docs(depleted + clean + near)).collect()}
    assert got == {i: i >= 20 for i in got} and len(got) == 38


def test_very_long_and_empty_texts(docs):
    long = "\n".join(f"line {i} of a very long text " + "w " * 30 for i in range(20000))
    rows = [(1, long), (2, ""), (3, "\n" * 50000), (4, "one " * 400000)]
    df = docs(rows)
    assert result(df) == brute_force([(d, t, "a") for d, t in rows])
    assert quality.quality(docs([])).count() == 0


def test_awkward_rows(docs):
    menu = "home about us contact and more of the same words here"
    prose = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, f"{menu}\n{prose(i)}", "h") for i in range(6)] + [(100 + i, f"{menu}\n{menu.upper()}\n {menu}\n{i} " + " ".join(f"v{i}{j}" for j in range(4)), "h") for i in range(6)]
    rows += [(50, None, "h"), (51, "", None), (None, prose(7), None), (0, f"{menu}\n{prose(0)}", "h"), (52, " ".join(["a b c d e f g h"] * 400), "g"), (53, "\x0b  x y", "g"), (54, "\n".join(["##"] * 3000 + [prose(9)]), "g")]
    df = docs(rows, {"line": F.lit(1), "host": F.lit("z"), "kept": F.lit(False), "text_hash": F.lit(0)})
    assert result(df, 3, 20, 50) == brute_force(rows, 3, 20, 50)
    assert result(df, 3, 5, 50) == brute_force(rows, 3, 5, 50)


def test_copies_of_a_clean_document_do_not_deplete_it(docs):
    text = "\n".join(" ".join(f"clean{i}w{j}" for j in range(12)) for i in range(5))
    df = docs([(i, text) for i in range(300)])
    assert {r.kept for r in quality.quality(df, "source", 5).collect()} == {True}


def test_repeat_words_at_overlaps(spark):
    cases = ["a " * 9, "a " * 8, "a b " * 6, " ".join("abcdefghij" * 2), ""]
    for text in cases:
        row = spark.createDataFrame([(text,)], "text string").select(quality.repeat_words(quality.words(F.col("text")))).first()
        assert row[0] == base(text)[4], text


def test_keep_good(docs):
    rows = [(1, " ".join(f"w{i}" for i in range(40))), (2, "too short"), (None, " ".join(f"v{i}" for i in range(40))), (3, None)]
    df = docs(rows)
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=repr) == [1, None]
    assert quality.keep_good(docs([])).count() == 0


def test_kept_texts_lose_their_boilerplate_lines(docs):
    prose = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, f"Share this page\n\n{prose(i)}\n  SHARE this page\t\nlast {i}", "h") for i in range(9)]
    rows += [(20, f"Share this page\n{prose(20)}", "g"), (21, f"share this page\n{prose(21)}", None), (None, f"{prose(22)}\nshare this page", "h"), (0, rows[0][1], "h"), (0, f"Share this page\n\n{prose(0)}\n  SHARE this page\t\nlast 0", "g")]
    df = docs(rows)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    want = sorted(((d, "\n".join(x for x in t.split("\n") if s != "h" or norm(x) != "share this page"), s) for d, t, s in rows), key=repr)
    out = quality.keep_good(df, "source", 5)
    found = out.collect()
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.text, r.source) for r in found), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in found)
