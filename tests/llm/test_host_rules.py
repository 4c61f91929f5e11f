"""Host-level quality rules against plain Python counts."""

import os
import sys
from collections import Counter

from docfathom.llm import host_rules
from docfathom.llm.queries import ORACLE
from odd_rows import ODD

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = "doc_id long, text string, source string, kept string, host string, n_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 0) for i, t, s in rows], SCHEMA).repartition(3)


def test_counts_by_hand():
    assert host_rules.counts(None) == (0, 0, 0, 0, 0, 0)
    text = "a b c a b c d\nx $y\na b c a b c d\n \n\x1c z"
    n, chars, symbols, dup, repeat, lines = host_rules.counts(text)
    assert len(text.split()) == 17  # Python's split takes \x1c for a space; the rules do not
    assert n == 18 and chars == 19 and symbols == 1
    assert (dup, lines) == (1, 4)  # the third line equals the first; '\x1c z' is a word line too
    # windows (a b c) and (b c a), (c a b), (a b c d)... cover the first 14 words
    assert repeat == 14
    assert host_rules.counts("w w w w")[4] == 4
    assert host_rules.counts("w w w")[4] == 0


def test_base_rules_and_host_verdicts(spark):
    clean = " ".join(f"word{i % 97} text" for i in range(40))
    spam = "buy now $$$ ### <<< " * 30
    rows = [(i, clean, "good") for i in range(20)] + [(100 + i, spam, "bad") for i in range(20)]
    rows += [(200, clean, "bad"), (201, clean + " #" * 10, "bad"), (202, clean + " #" * 10, "good")]
    rows += [(None if i is None else 300 + i, t, None) for i, t in ODD]
    got = {(r.doc_id, r.host): r for r in host_rules.judge(frame(spark, rows)).collect()}
    assert all(not r.kept for (i, h), r in got.items() if h == "bad" and i >= 100 and i < 120)
    assert got[(200, "bad")].kept and got[(0, "good")].kept  # clean texts stay on any host
    assert not got[(201, "bad")].kept and got[(202, "good")].kept  # a soft failure counts on a bad host only
    assert got[(0, "good")].host_bad is False and got[(100, "bad")].host_bad is True
    # every row, repeated ones and null ids too
    assert host_rules.judge(frame(spark, rows)).count() == len(rows)
    assert host_rules.judge(frame(spark, [])).count() == 0


def test_against_sql(spark, tmp_path):
    import duckdb

    texts = [t for _, t in ODD] + ["a b c " * 30, "x\nx\ny " * 40, "#&| " * 60, "long " * 20 + "words here " * 20]
    rows = [(i, t, ["h1", "h2", None][i % 3]) for i, t in enumerate(texts * 3)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in host_rules.judge(spark.read.parquet(str(tmp_path / "documents.parquet"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = sorted(con.execute(ORACLE["op13_host_rules"]).fetchall())
    assert got == want
    by_id = {r[0]: r for r in got}
    for i, t, _ in rows:
        n, chars, symbols, dup, repeat, _ = host_rules.counts(t)
        assert by_id[i][1:6] == (n, chars, symbols, dup, repeat)
