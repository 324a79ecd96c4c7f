"""Secrets of rows with a null id, and of rows that share an id, leave the pipeline before packing."""

import corpus_pipeline
from hubrisk.llm import queries
from hubrisk.llm import secrets as S

from llm_helpers import SF

TOKENS = [f"password={c}123456789abcdef0{c}" for c in "abcde"]


def test_every_row_is_cut_by_its_own_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.QUERIES["op1_quality_rules"](spark, SF).collect() if r.kept}
    first = [r for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()
             if r.doc_id in kept and 300 < len(r.text) < 5000][:5]
    put = [(None, 0, True), (None, 1, True), (900001, 2, True), (900001, 3, True), (900001, 4, False)]
    rows, clean = [], []
    for r, (i, k, dirty) in zip(first, put):
        half = r.text.index(" ", len(r.text) // (k + 2))  # other offsets in each row
        put_in = lambda x: f"{r.text[:half]} {x} {r.text[half:]}"  # noqa: B023, E731
        text = put_in(TOKENS[k]) if dirty else r.text
        rows.append((i, text, r.lang, r.source, len(text)))
        clean.append((i, put_in("<secret>") if dirty else r.text))
    out = spark.createDataFrame(rows, docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(i, t, len(t)) for i, t in clean], key=str)
    assert queries.QUERIES["op2_secret_scan"](spark, SF).columns == list(S.RESULT_NAMES)
