import corpus_pipeline
from floodsift.llm import language


def test_language_stage_sends_each_text_once_and_returns_rows_as_they_were(spark, monkeypatch):
    words = {"en": "the cat and the dog were in the house ", "de": "der hund und die katze waren im haus "}
    rows = [(k, words[lang] * (1 + k % 3), lang, k * 2) for k in range(40) for lang in [["en", "de"][k % 2]]]
    rows += [(90, None, "en", 1), (91, "12 34", "de", None), (None, words["en"], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, odd_name int")
    sent, identify = [], language.identify
    monkeypatch.setattr(language, "identify", lambda rows, *a, **k: sent.append(rows) or identify(rows, *a, **k))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] not in (90, 91)), key=str)
    assert "text" not in sent[0].schema["_row"].dataType.names


def test_long_batches_are_taken_in_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(2 * language.TEXTS_AT_ONCE + 3))})
    sizes = [s.num_rows for s in language._slices([batch])]
    assert sizes == [language.TEXTS_AT_ONCE] * 2 + [3]
