"""The stages one after another on the small tables."""

import re

import duckdb

import corpus_pipeline
from ledgerloom.llm.common import documents


def test_stages(spark, data):
    docs = documents(spark, data)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall())
    seen, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    kept = corpus_pipeline.STAGES[0][1](spark, docs, data)
    assert kept.columns == columns
    good = {r.doc_id for r in kept.collect()}
    right = [(d in good) == (q == 1) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.9 and good <= set(seen)
    one = corpus_pipeline.STAGES[1][1](spark, kept, data)
    assert one.columns == columns
    rows = one.collect()
    assert len({r.text for r in rows}) == len(rows) and {r.text for r in rows} <= {seen[d] for d in good}
    clean = corpus_pipeline.STAGES[2][1](spark, one, data).collect()
    assert len(clean) == len(rows) and not any(re.search("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r.text) for r in clean)


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).toPandas()
    assert len(corpus_pipeline.STAGES) == 4 and rows.groupby("sequence_id").length.sum().max() <= 2048 and len(rows)


#: Columns that have the names of the stages' own.
NAMES = ["score", "_id", "_key", "_own", "_n", "_scan_id", "row", "own", "order", "number", "clean", "changed", "runs", "key", "digest", "c0", "k0", "spans", "s0"]
LONG = " ".join(f"word{i % 977}" for i in range(20000))
TEXTS = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (3, ""), (None, "null id token=abcdef123"), (None, None), (4, LONG), (5, LONG + " tail"), (7, " \n "), (8, "secret=abcdefgh")]


def odd_documents(spark):
    rows = [(d, t, "en", "a", None if t is None else len(t), *[f"{n}{k % 3}" for n in NAMES]) for k, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


def test_stages_on_odd_rows_and_clashing_names(spark, data, tmp_path):
    docs = odd_documents(spark)
    none = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, none)
    # no label to learn from: all rows stay as they are
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    some = corpus_pipeline.keep_quality(spark, docs, data)
    assert some.columns == docs.columns and set(map(str, some.collect())) <= set(map(str, docs.collect()))
    one = corpus_pipeline.drop_near_copies(spark, docs, data)
    rows = one.collect()
    assert one.columns == docs.columns and set(map(str, rows)) <= set(map(str, docs.collect()))
    # 2 stands for all texts without words, 4 for 5; of the rows of 1 the first by their other columns stays
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "4", "8", "None"]
    assert next(r for r in rows if r.doc_id == 1).score == "score0"
    clean = corpus_pipeline.redact_secrets(spark, docs, data)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    assert {r.text for r in clean.where("doc_id = 8 or doc_id is null").collect()} == {"[SECRET]", "null id [SECRET]", None}
    assert clean.drop("text", "n_chars").exceptAll(docs.drop("text", "n_chars")).isEmpty()
    packed = corpus_pipeline.pack(spark, docs, data).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and (packed.start == 0).sum() == len(TEXTS)


def test_stages_on_an_empty_table(spark, data):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0
