import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.llm import linededup

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOW)


def brute_force(rows, min_chars=20, min_docs=3):
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)], key=order)]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, linededup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_against_brute_force_on_documents(documents):
    assert result(documents) == brute_force([(r.doc_id, r.text) for r in documents.collect()])


ROWS = [
    (1, "A line that many documents share.\nown line one of document 1\n\nshort"),
    (2, "  a LINE that many documents share.\t\nA line that many documents share.\nshort"),
    (3, "short\na line that many documents share.\na line that many documents share."),
    (3, "the third again\na line that many documents share."),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (None, "a line that many documents share.\nÉ line that many documents share."),
    (7, "only two documents have this line"),
    (8, "only two documents have this line"),
    (2, "  a LINE that many documents share.\t\nA line that many documents share.\nshort"),
    (9, "\n".join(f"line number {i} of a long text" for i in range(5000))),
    (10, "\n".join(f"line number {i} of a long text" for i in range(0, 5000, 2))),
    (11, "\n".join(f"line number {i} of a long text" for i in range(0, 5000, 3))),
]


def test_awkward_rows_and_clashing_columns(docs):
    df = docs(ROWS, {"n_lines": F.lit(1), "pos": F.lit(1), "_text": F.lit("x"), "keep": F.lit(1)})
    assert result(df) == brute_force([r[:2] for r in ROWS])


def test_hot_line_is_dealt_over_partitions(docs):
    rows = [(i, f"the very same line in every document\nown text of document number {i}") for i in range(400)]
    df = docs(rows)
    found = linededup.entries(df)
    assert len(linededup.heavy_hashes(found, 8)) == 1
    assert result(df) == brute_force(rows)


def test_bitmaps_are_runs(docs):
    marks = linededup.keep_bitmaps(docs(ROWS[:3])).collect()
    assert {(m.doc_id, tuple((r.start, r.length) for r in m.keep)) for m in marks} == {(1, ((2, 3),)), (2, ((3, 1),))}


def test_drop_lines_keeps_columns_and_null_texts(docs):
    df = docs(ROWS, {"_text": F.lit("clash"), "_keep": F.lit(1)})
    out = {r.doc_id: r for r in linededup.drop_lines(df).collect()}
    assert linededup.drop_lines(df).columns == df.columns
    assert out[1].text == "own line one of document 1\n\nshort" and out[1].n_chars == len(out[1].text)
    assert out[4].text is None and out[5].text == ""


def test_very_long_texts(docs):
    rows = [(1, "\n".join(f"line {i % 30000} of a very long text" for i in range(60000))), (2, "word " * 300000), (3, "\n" * 40000 + "word " * 300000), (4, f"{'word ' * 300000}\nline 7 of a very long text"), (5, "line 7 of a very long text")]
    assert result(docs(rows)) == brute_force(rows)


def test_empty_table(docs):
    assert linededup.line_dedup(docs([])).count() == 0
