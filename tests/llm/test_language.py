"""Language identification against exact sets, and its odd cases."""

import pandas as pd

from odd_rows import ODD
from docfathom.llm import language
from docfathom.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    got = QUERIES["op1_language"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    unseen = [r for r in rows if r.held_out]
    assert unseen and sum(r.lang == r.lang_pred for r in unseen) / len(unseen) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_masks_are_the_exact_sets_but_for_chance(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.filter(language.learns()))
    counts = {}
    for r in docs.filter(language.learns()).collect():
        own = pd.Series(language.trigrams([r.text])[0]).value_counts()
        counts[r.lang] = counts[r.lang].add(own, fill_value=0) if r.lang in counts else own
    sets = {k: set(v[v >= language.MIN_SHARE * v.sum()].index) for k, v in counts.items()}
    assert model.languages == tuple(sorted(sets))
    for text in [r.text for r in docs.limit(30).collect()]:
        grams = language.trigrams([text])[0]
        at = language._places(grams, len(model.rows))
        masks = model.rows[at[0], 0] & model.rows[at[1], 0] & model.rows[at[2], 0]
        wrong = 0
        for gram, mask in zip(grams, masks):
            for i, name in enumerate(model.languages):
                known = bool(int(mask) >> i & 1)
                assert known or gram not in sets[name]
                wrong += known and gram not in sets[name]
        assert wrong <= 0.05 * len(grams) * len(model.languages)


def test_odd_rows(make, odd):
    model = language.fit(make([(i, "alpha beta gamma delta same word text") for i in range(4)]))
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if has_letter else "und")
        assert has_letter or r.score == 0
    assert language.identify(odd, model).columns == odd.columns + ["lang_pred", "score"]


def test_nothing_to_learn_from(make, odd):
    model = language.fit(make([]))
    assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}
    kept = language.keep_known(odd, model, 0.2)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 7, 7]
    assert language.identify(make([]), model).count() == 0


def test_ties_go_to_the_smaller_name(make, spark):
    both = make([(1, "abc")], "xx").union(make([(2, "abc")], "aa"))
    assert language.predict(language.fit(both), ["abc"])[0] == ["aa"]
