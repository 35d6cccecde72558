import public_tokenizers
import pyarrow as pa

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.conftest import words
from tidegrid.llm import byte_bpe, pii, quality_rules, token_count
from tidegrid.llm.jaccard_join import keep_first
from tidegrid.session import materialize

SMALL = "/root/testdata/sf0.001"


def test_every_stage_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    model = token_count.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {g for item in items for g in brute.shingles(item)}
    names = pii.Pseudonyms(pii.DEMO_KEY)

    def good(rows):
        kept = quality_rules.judge(pa.array(rows.values()), model)["kept"]
        return {d: t for (d, t), k in zip(rows.items(), kept, strict=True) if k}

    def first(rows):
        return {d: rows[d] for d, (_, c) in brute.components(list(rows.items())).items() if c == d}

    def clean(rows):
        def has(text):  # only items with a common run of words need tiles
            if not brute.shingles(text) & grams:
                return False
            near = [i for i in items if brute.shingles(i) & brute.shingles(text)]
            return any(covered >= 0.5 * n for covered, n in (brute.tiling(text, i) for i in near))
        return {d: t for d, t in rows.items() if not has(t)}

    plain = [good, first, clean, lambda rows: {d: pii.replace(t, names)[0] for d, t in rows.items()}]
    for (name, stage), want in zip(pipeline.STAGES, plain):
        before = len(rows)
        docs, rows = materialize(stage(spark, docs, SMALL), name), want(rows)
        assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == rows
        assert rows and (len(rows) < before or name == "pseudonyms"), name
    got = pipeline.run(spark, SMALL).collect()
    coder = byte_bpe.ByteBPE(byte_bpe.multi_model(), public_tokenizers.PATTERN)
    ids = dict(zip(rows, coder.encode(list(rows.values()))))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == {
        d: (len(x) // 4, brute.sha(x), brute.sha(rows[d].encode())) for d, x in ids.items()}


def test_one_row_of_each_group_stays(frame):
    text = " ".join(words(1, 40))
    df = frame([(5, text), (5, text), (7, text), (None, text), (None, "other " * 9), (None, "other " * 9), (3, None), (4, None)])
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(5, text), (None, "other " * 9), (3, None), (4, None)], key=str)


def test_odd_rows(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, row_id STRING, key STRING"
    docs = spark.createDataFrame([(1, None, None, None, None, "a", "b"), (None, "", None, None, None, "a", "b")], schema)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.filter("false"), SMALL).collect() == []
