"""The stages of the pipeline on tables with nulls, repeated ids, extra columns and no rows."""

import pytest

from tabloom.llm import stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, pos int, kept boolean, toxic int"
LONG = " ".join(f"word{i}" for i in range(80))
MAIL = "please write to someone@example.org about it"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, LONG), (2, LONG), (3, LONG + " end"), (4, None), (5, ""), (6, MAIL), (6, "another text of the same id")]
    texts += [(None, None), (None, None), (None, "no id here"), (7, " \n "), (8, "x" * 30_000), (9, "a fine day"), (9, "a fine day")]
    rows = [(k, x, "en", "s", len(x) if x else None, "clash", 1, True, 0) for k, x in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def bag(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_keep_what_is_no_copy(spark, docs, folder):
    out = stages.keep_one_of_each_group(spark, docs, folder)
    assert out.columns == docs.columns
    gone = bag(docs)
    for row in bag(out):
        gone.remove(row)
    assert gone == sorted([(2, LONG), (3, LONG + " end"), (9, "a fine day")], key=str)


def test_masks_and_lines(spark, docs, folder):
    masked = stages.mask_personal_data(spark, docs, folder)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    changed = [x for x in bag(masked) if x not in bag(docs)]
    assert len(changed) == 1 and changed[0][0] == 6 and "@" not in changed[0][1]
    lines = stages.drop_common_lines(spark, docs, folder)
    assert lines.columns == docs.columns and bag(lines) == bag(docs)


def test_toxic_stage_keeps_clean_rows(spark, docs, folder):
    out = stages.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns and bag(out) == bag(docs)


@pytest.mark.parametrize("stage", [f for f in vars(stages).values() if getattr(f, "__module__", "") == stages.__name__ and not f.__name__.startswith("_")])
def test_no_rows(spark, docs, folder, stage):
    assert stage(spark, docs.limit(0), folder).count() == 0
