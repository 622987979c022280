"""The pipeline stage by stage on the smallest tables, against what each stage promises."""

import zlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from tidemark.llm.common import store, tables

    docs = tables(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return [frame.collect() for frame in out], [frame.columns for frame in out]


def test_stages_keep_the_columns_of_documents(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[1:5])
    assert set(columns[5]) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_filters_only_drop_rows(stages):
    rows, _ = stages
    for before, after in zip(rows[:3], rows[1:4], strict=True):
        assert set(after) <= set(before) and len(set(after)) == len(after)
    assert len(rows[1]) > 0.7 * len(rows[0])


def test_one_of_each_group_stays(stages):
    rows, _ = stages

    def sets(text):
        words = text.split()
        return {tuple(w.lower() for w in words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    kept = [(r, sets(r.text)) for r in rows[2]]
    for i, (_, a) in enumerate(kept):
        assert not any(10 * len(a & b) >= 8 * len(a | b) for _, b in kept[:i])
    gone = {r.doc_id for r in rows[1]} - {r.doc_id for r in rows[2]}
    everything = {r.doc_id: sets(r.text) for r in rows[1]}
    for i in gone:
        assert any(j != i and 10 * len(s & everything[i]) >= 8 * len(s | everything[i]) for j, s in everything.items())


def test_no_benchmark_passage_is_left(spark, stages):
    rows, _ = stages
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in r.text for r in rows[3] for item in items if len(item.split()) >= 5)


def test_token_index_covers_the_mix(stages):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, _ = stages
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows[4]:
        ids = np.array(whole.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows[5])
    ends = sorted((r.start, r.n_tokens) for r in rows[5])
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    numbers = sorted(int(n.split("_")[0][2:]) for n in names if n.startswith("op") and n.split("_")[0][2:].isdigit())
    assert "pipeline" in names and numbers == list(range(1, 14))


def test_one_row_stays_where_ids_repeat_or_are_null(spark):
    import corpus_pipeline

    def near(word):
        words = [f"word{i}" for i in range(200)]
        return " ".join([*words[:100], word, *words[101:]])

    other = " ".join(f"item{i}" for i in range(80))
    rows = [(None, near("a")), (None, near("b")), (5, other), (5, other + " x"), (5, other + " y"), (6, other), (None, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted((r.text or "")[:5] for r in left) == ["", "", "item0", "word0"]
    assert [r.doc_id for r in left if r.text and r.text.startswith("item")] == [5]
