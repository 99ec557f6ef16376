"""Every operator and stage over one table of awkward rows: columns that bear the names of new and internal ones, nulls, ties, repeats, and no rows at all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sumac.llm import bagminhash, bpe, debruijn, decontaminate, fingerprint, language_id, quality, secret_scan, toxicity, url_filter

#: Names that operators give to new columns, or might use within.
NAMES = """lang_pred score predicted class_id class_size kept contaminated item_id overlap start length items spans found n_assign base_sha256 ids n_tokens ids_sha256 decoded decoded_sha256
fingerprint host path rule verdict margin text_ __text __row __id __at __whole __meta0 metadata0 own_score row key node other number best related own_kept cleared a.b""".split()
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    texts = [(1, "token=abcdefgh1 and " + "x " * 60), (1, "token=abcdefgh1 and " + "x " * 60), (2, "x " * 60), (2, "y z"), (3, None), (None, None), (None, "password: hunter user: bob"), (4, ""), (5, " \n"), (6, "der die das")]
    rows = [(i, t, "en" if k % 2 else None, "s", len(t or "")) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.concat(F.lit(f"own {n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "der die das"), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def operators(spark, docs, labels, benchmark):
    """name: (its result over docs, the names of its new columns)."""
    language = language_id.train(docs, F.lit(True))
    return {
        "language": (language_id.identify(docs, language), ["lang_pred", "score"]),
        "quality": (quality.score(docs, quality.train(docs, labels, metadata=("n_chars", "none"))), ["score", "predicted"]),
        "near duplicates": (bagminhash.near_duplicates(docs), ["class_id", "class_size", "kept"]),
        "toxicity": (toxicity.score(docs, toxicity.train(docs, labels)), ["score", "predicted"]),
        "urls": (url_filter.judge(docs, url_filter.train(), url="text"), ["host", "path", "rule", "verdict", "margin"]),
        "benchmark": (decontaminate.matches(docs, benchmark), list(decontaminate.NEW)),
        "secrets": (secret_scan.scan(docs), list(secret_scan.NEW)),
        "redaction": (secret_scan.redacted(docs), ["text", "n_chars"]),
        "tokens": (bpe.encode(docs, PATH), ["ids", "n_tokens"]),
        "digests": (bpe.round_trip(docs, PATH), ["n_tokens", "ids_sha256", "decoded_sha256"]),
        "fingerprints": (fingerprint.fingerprints(docs), ["fingerprint"]),
    }


def plain(frame, names):
    return sorted(map(str, frame.select(*[F.col(f"`{n}`") for n in names]).collect()))


def test_operators_keep_all_rows_and_other_columns(spark, tables):
    docs, labels, benchmark = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    for name, (got, new) in operators(spark, docs, labels, benchmark).items():
        rest = [c for c in docs.columns if c not in new]
        assert plain(got, rest) == plain(docs, rest), name
        assert set(got.columns) == {*rest, *new}, name
    kept = bagminhash.deduplicated(docs)
    assert kept.columns == docs.columns and set(plain(kept, docs.columns)) <= set(plain(docs, docs.columns)) and kept.count() == 8
    assert debruijn.removed(docs).count() == fingerprint.edited_pairs(docs).count() == docs.count()


def test_operators_over_no_rows(spark, tables):
    docs, labels, benchmark = (spark.read.parquet(f"{tables}/{t}.parquet").limit(0) for t in ("documents", "labels", "benchmark"))
    for name, (got, new) in operators(spark, docs, labels, benchmark).items():
        assert got.count() == 0 and set(new) <= set(got.columns), name
    assert debruijn.removed(docs).count() == fingerprint.edited_pairs(docs).count() == bagminhash.deduplicated(docs).count() == bpe.reuse(docs).collect()[0]["total"] == 0


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, tables)
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert got.columns == docs.columns and set(plain(got, rest)) <= set(plain(docs, rest)), name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == docs.count()
    assert corpus_pipeline.run(spark, tables).count() <= docs.count()


def test_ties_in_edited_pairs(spark):
    """Equal ids with different texts: each row follows another one, and every row has its pair."""
    docs = spark.createDataFrame([(7, "a" * 40), (7, "b" * 40), (7, "b" * 40), (None, "c" * 40)], "doc_id long, text string")
    got = fingerprint.edited_pairs(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "7", "None"] and all(r["n_chars"] == 40 for r in got)
    assert got == fingerprint.edited_pairs(docs.repartition(3)).collect() or len({r["edited_sha256"] for r in got}) >= 3
