import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import HARD, SF_MID, docs
from tidemark.llm import quality
from tidemark.llm.queries import QUERIES
from tidemark.session import read_table


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    rule = quality.QualityRule(hidden=5, gate=3)
    x = rng.standard_normal((9, quality.FEATURES))
    bags, y, weight = np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    w = {k: rng.standard_normal(v.shape) * 0.1 for k, v in quality.fit([], np.array([]), rule).weights.items()}

    def loss(w):
        p = quality._forward(w, x, bags)["p"]
        return float((-weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grads = quality._gradient(w, x, bags, y, weight)
    for name, value in w.items():
        at = tuple(0 for _ in value.shape)
        up, down = {**w, name: value.copy()}, {**w, name: value.copy()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grads[name][at]) < 1e-6, name


def test_passages_agree_with_counting_words():
    texts = [b"One two  two THREE!! four", b"", b" \n", b"last"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    features, first = quality.passages(data, offsets, 2)
    assert first.tolist() == [0, 3, 4, 5] and len(features) == 6
    shape = features[:, 256 + 64 :]
    assert shape[1].tolist()[:2] == [0.0, 0.5] and abs(shape[2, 5] - np.log1p(4) / 4) < 1e-6
    assert np.allclose((features[0, :256] ** 2)[[79, 110, 101, 116, 119, 111]], np.array([1, 1, 1, 1, 1, 1]) / 6)
    assert not features[3].any() and not features[4].any()


def test_passage_order_in_a_batch_does_not_matter():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 99, n)).encode() for n in (200, 1, 0, 75)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together, first = quality.passages(data, offsets, 48)
    for k, text in enumerate(texts):
        alone, _ = quality.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 48)
        assert np.array_equal(alone, together[first[k] : first[k] + len(alone)])


def test_held_out_documents_are_told_apart(spark):
    found = QUERIES["op1_quality_classifier"](spark, SF_MID)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == read_table(spark, SF_MID, "documents").count()
    rows = found.join(read_table(spark, SF_MID, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.collect())


def test_hard_rows_and_training_on_nothing(spark):
    table = docs(spark, HARD)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(table, labels)
    assert {r.score for r in quality.score(table, model).collect()} == {0.5}
    labels = spark.createDataFrame([(7, 1), (6, 1), (9, 0), (9, 0), (3, 0), (99, 1)], "doc_id bigint, quality int")
    model = quality.train(table, labels)
    scored = quality.score(table, model)
    assert scored.count() == len(HARD) and scored.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns
    expected = sorted(r.doc_id for r in scored.where("predicted = 1").collect())
    assert sorted(r.doc_id for r in kept.collect()) == expected
    empty = docs(spark, [])
    assert quality.score(empty, model).count() == 0 and quality.keep_good(empty, model).count() == 0


def test_held_out_labels_do_not_matter(spark):
    table = read_table(spark, SF_MID, "documents")
    labels = read_table(spark, SF_MID, "labels")
    from tidemark.llm.queries import fold

    rule = quality.QualityRule(epochs=1)
    turned = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.train(table, labels, rule, fold("doc_id", 5) != 0)
    b = quality.train(table, turned, rule, fold("doc_id", 5) != 0)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)
