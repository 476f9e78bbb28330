import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import HARD, SF, SF_MID
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_jaccard import brute_classes
from tests.llm.test_lines import brute_by_length
from tidemark.llm import lines, quality, unigram
from tidemark.llm.queries import fold
from tidemark.session import read_table


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_stage_does_its_work_on_what_is_left(spark, tmp_path):
    docs = read_table(spark, SF_MID, "documents")
    for (name, stage), check in zip(corpus_pipeline.STAGES, (check_quality, check_lines, check_copies, check_leaks, check_pieces), strict=True):
        stage(spark, docs, SF_MID).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert out.dtypes == docs.dtypes
        check(spark, docs, out)
        docs = out


def check_quality(spark, before, after):
    model = quality.train(before, read_table(spark, SF_MID, "labels"), learnable=fold("doc_id", 5) != 0)
    wanted = quality.score(before, model).where("predicted = 1").select("doc_id")
    assert rows_of(after) == rows_of(before.join(wanted, "doc_id", "left_semi").select(*before.columns))
    labelled = after.join(read_table(spark, SF_MID, "labels"), "doc_id")
    good = before.join(read_table(spark, SF_MID, "labels").where("quality = 1"), "doc_id").count()
    assert labelled.where("quality = 1").count() >= 0.98 * good and labelled.where("quality = 0").count() <= 5


def check_lines(spark, before, after):
    rows = [(r.doc_id, r.text) for r in before.collect()]
    expected = {i: t for i, t in brute_by_length(rows, lines.LineRule()) if t.strip(" \t\n\x0b\x0c\r") or t == dict(rows)[i]}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0


def check_copies(spark, before, after):
    classes = brute_classes({r.doc_id: r.text for r in before.collect()})
    assert rows_of(after) == rows_of(before.where(F.col("doc_id").isin(sorted(set(classes.values())))))


def check_leaks(spark, before, after):
    items = [(r.item_id, r.text) for r in read_table(spark, SF_MID, "benchmark").collect()]
    leaked = {i for i, *_ in brute_leaks([(r.doc_id, r.text) for r in before.collect()], items)}
    assert leaked and sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in leaked)


def check_pieces(spark, before, after):
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in before.collect()}
    encoder = unigram.Encoder(unigram.load_model())
    assert all(list(r.ids) == encoder.encode(r.text.encode()).tolist() and r.n_ids == len(r.ids) for r in after.collect())


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "n_ids", "ids_sha256", "ids", "text"} and out.count() > 50


def test_stages_survive_hard_rows_and_no_rows(spark, tmp_path):
    whole = spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in [*HARD, (None, "no id")]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, table in enumerate((whole, whole.limit(0))):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == (k == 0)
