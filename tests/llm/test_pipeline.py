"""Each stage on its predecessor's rows, held against brute-force versions."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sumac.llm.secret_scan import KINDS
from tests.llm import test_bagminhash, test_decontaminate, test_secret_scan

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        rows.append({r["doc_id"]: r for r in docs.collect()})
        assert len(rows[-1]) == docs.count(), name
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    start, good, single, clean, safe, coded = rows

    assert all(good[d] == start[d] for d in good)
    known = [d for d in start if d in labels]
    assert sum((d in good) == (labels[d] == 1) for d in known) / len(known) > 0.95
    assert sum(d in good for d in known if labels[d] == 1) / sum(labels[d] for d in known) > 0.98

    order = sorted(good)
    top = test_bagminhash.brute([(d, good[d]["text"]) for d in order])
    assert set(single) == {d for k, d in enumerate(order) if top[k] == k}

    held = {d for d, r in single.items() if any(t in r["text"] for _, t in items)}
    gone = set(single) - set(clean)
    assert held <= gone and gone <= set(test_decontaminate.brute([(d, single[d]["text"]) for d in gone], items))

    assert set(safe) == set(clean)
    for d, r in clean.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in test_secret_scan.brute(r["text"]).split(",") if s]
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += r["text"][at:s] + "[SECRET]"
            at = max(at, e)
        assert safe[d]["text"] == out + r["text"][at:] and safe[d]["n_chars"] == len(safe[d]["text"])
    assert KINDS

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(coded) == set(safe)
    assert all(r["ids"] == exact.encode(safe[d]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for d, r in coded.items())


def test_run_is_the_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, docs.select("doc_id", "ids").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "ids").collect()))


def test_nulls_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", None, "s", 0), (2, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4
