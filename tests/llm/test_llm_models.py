"""Quality, toxicity and language: held-out accuracy, edge rows, parts against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import edge_documents, edge_labels, no_documents
from lumenseek.llm import language, quality, toxicity
from lumenseek.llm.common import table

SF = "/root/testdata/sf0.01"


def _held(spark, result, label):
    rows = result.join(table(spark, SF, "labels"), "doc_id").where("held_out")
    return [(r.predicted, r[label]) for r in rows.collect()]


def test_quality_on_held_out_rows(spark):
    rows = _held(spark, quality.op10_quality(table(spark, SF, "documents"), table(spark, SF, "labels")), "quality")
    assert sum(a == b for a, b in rows) >= 0.98 * len(rows)
    good = [a for a, b in rows if b == 1]
    assert sum(good) >= 0.98 * len(good)


def test_trees_walk_like_a_plain_loop():
    rng = np.random.default_rng(1)
    x = rng.random((500, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.fit(x, y)
    score = trees.score(x)
    assert ((score > 0.5) == (y == 1)).mean() > 0.97
    for row in range(20):
        total = trees.prior
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[row, feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert score[row] == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Hello, World!\nagain again", None, "", "ÉÈ | a | b", "x" * 5000, "1 22 333"]
    together = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)
    assert (together[1] == together[2]).all()


def test_repetition_statistics():
    row = quality.statistics(pa.array(["a b a b a", "w w w w"]))
    assert row[:, 4].tolist() == [2 / 5, 1 / 4] and row[:, 5].tolist() == [3 / 5, 1] and row[:, 6].tolist() == [0, 3 / 4]


@pytest.mark.parametrize("module, apply", [("quality", quality.op10_quality), ("toxicity", toxicity.op2_toxicity)])
def test_edge_rows_have_scores(spark, module, apply):
    docs = edge_documents(spark)
    rows = apply(docs, edge_labels(spark)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id == 10}) == 1
    assert apply(docs, edge_labels(spark).limit(0)).where("score <> 0.5").count() == 0
    assert apply(no_documents(spark), edge_labels(spark)).count() == 0


def test_scored_keeps_columns_and_rows(spark):
    docs = edge_documents(spark)
    trees = quality.train(docs, edge_labels(spark))
    out = quality.scored(docs, trees, "mark")
    assert out.columns == [*docs.columns, "mark"]
    assert sorted(map(str, out.drop("mark").collect())) == sorted(map(str, docs.collect()))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op2_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = [(r.predicted, r.toxic) for r in out.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()]
    # A few toxic labels belong to texts that were replaced by junk, which shows no sign of them.
    assert sum(a for a, b in rows if b == 1) >= 0.9 * sum(b for _, b in rows)
    assert sum(a for a, b in rows if b == 0) <= 0.01 * sum(b == 0 for _, b in rows)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " scum": 2.0}, [" idiot proof "])
    for text in ("You IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "an-idiot.", "idi­ot"):
        assert sum(lexicon.matches(text)[1].values()) == 3.0, text
    assert lexicon.matches("idiotic")[1] == {} and lexicon.matches("the idiots")[1] == {}
    assert sum(lexicon.matches("scummy scum")[1].values()) == 4.0
    assert lexicon.matches("an idiot-proof box")[1] == {}
    assert sum(lexicon.matches("idiot proof, idiot")[1].values()) == 3.0
    short, long = lexicon.features("idiot"), lexicon.features("idiot " + "fine " * 500)
    assert short[0] == long[0] and short[1] > long[1]


def test_terms_and_exceptions_are_learned(spark):
    rows = [(1, f"you are a vilex person number{i} today") for i in range(40)]
    rows += [(0, f"they sell vilex soap in shop number{i} today") for i in range(12)]
    rows += [(0, f"a fine day number{i} with friends") for i in range(400)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "label int, text string"), 40, 412)
    assert " vilex " in lexicon.weights and " vilex soap " in lexicon.exceptions
    assert lexicon.matches("some vilex soap")[1] == {} and lexicon.matches("a vilex man")[1]


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    rows = language.op5_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_edge_rows(spark):
    rows = language.op5_language(edge_documents(spark)).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 5, 12} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.op5_language(no_documents(spark)).count() == 0
    one = edge_documents(spark).where("lang = 'en'")
    assert {r.lang_pred for r in language.op5_language(one).collect()} == {"en", "und"}


@pytest.mark.parametrize("languages", [2, 3, 4, 6, 7, 20, 60])
def test_codewords_are_apart(languages):
    code = language.codewords(languages)
    far = (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(languages, dtype=bool)]
    assert far.min() >= code.shape[1] * (0.5 if languages <= 6 else 0.15)
    assert (np.abs(code.sum(axis=0)) < languages).all()


def test_language_margins_do_not_depend_on_the_batch():
    counts = np.random.default_rng(0).integers(0, 50, (4, 1 << language.BITS))
    model = language.Model(["a", "b", "c", "d"], counts)
    texts = pa.array(["Ecole École", "", "xy", "some longer text", None, "z"], pa.string())
    together = np.concatenate([model.posterior(p) for p in language.ta.pieces(texts)])
    alone = np.concatenate([model.posterior(p) for i in range(6) for p in language.ta.pieces(texts.slice(i, 1))])
    assert np.allclose(together, alone)


def test_lexicon_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TERMS", 20)
    monkeypatch.setattr(toxicity, "MAX_EXCEPTIONS", 5)
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    one, two = (toxicity.train(d, labels) for d in (docs.repartition(3), docs.repartition(7)))
    assert one.lexicon.weights == two.lexicon.weights and len(one.lexicon.weights) == 20
    assert np.allclose(one.weights, two.weights)
