import numpy as np

from tests.llm.helpers import HARD, SF_MID, docs
from tidemark.llm import language
from tidemark.llm.queries import QUERIES
from tidemark.session import read_table

SMALL = language.LanguageRule(hidden=4, steps=40, batch=32)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in language._start(3, language.LanguageRule(hidden=3)).items()}
    x, y = rng.integers(60, 70, (6, 5)), np.array([0, 1, 2, 1, 0])
    _, grads = language.gradients(w, x, y)
    for name, value in w.items():
        at = (65, 2) if value.ndim == 2 and len(value) == 256 else tuple(0 for _ in value.shape)
        sides = []
        for step in (1e-4, -1e-4):
            moved = {**w, name: value.copy()}
            moved[name][at] += step
            sides.append(language.gradients(moved, x, y)[0])
        assert abs((sides[0] - sides[1]) / 2e-4 - grads[name][at]) < 2e-4, name


def test_training_and_prediction_run_the_same_network():
    rng = np.random.default_rng(3)
    w = language._start(3, SMALL)
    x = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    p = language.LanguageModel(["a", "b", "c"], w).positions(x)
    loss, _ = language.gradients(w, x, np.array([0, 1, 2, 1, 0]))
    assert abs(-np.log(p[:, np.arange(5), [0, 1, 2, 1, 0]]).mean() - loss) < 1e-4


def test_documents_pool_all_positions():
    model = language.LanguageModel(["a", "b"], language._start(2, SMALL))
    texts = [b"", b"abc", b"x" * 64, b"some words of a longer text " * 9]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = model.documents(data, offsets, 64)
    for k, text in enumerate(texts):
        alone = model.documents(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 64)
        assert np.allclose(alone, together[k : k + 1], atol=1e-5)
        assert abs(together[k].sum() - bool(text)) < 1e-4


def test_held_out_documents_are_recognised(spark):
    found = QUERIES["op3_language_id"](spark, SF_MID)
    table = read_table(spark, SF_MID, "documents")
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == table.count()
    rows = found.join(table, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_hard_rows(spark):
    table = docs(spark, [*HARD, (11, "12 34 !?"), (12, "é")], clash=False)
    model = language.train(table, SMALL)
    assert model.langs == ["und"]
    known = docs(spark, [(1, "the cat and the dog " * 5), (2, "der hund und die katze " * 5), (3, None), (4, "x")], clash=False)
    from pyspark.sql import functions as F

    known = known.withColumn("lang", F.expr("element_at(array('en', 'de', 'de', null), cast(doc_id as int))"))
    model = language.train(known, SMALL)
    assert model.langs == ["de", "en"]
    for rule in (SMALL, language.LanguageRule(hidden=4, slice_bytes=4096)):
        rows = {r.doc_id: r for r in language.predict(table, model, rule).collect()}
        assert {i for i, r in rows.items() if r.lang_pred == "und"} == {1, 2, 3, 4, 11}
        assert all(r.score == 0 if r.lang_pred == "und" else 0 < r.score <= 1 for r in rows.values())
        assert rows[7].lang_pred == rows[8].lang_pred
    assert language.predict(docs(spark, []), model).count() == 0
    assert language.train(docs(spark, [], clash=False), SMALL).langs == ["und"]
