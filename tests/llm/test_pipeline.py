"""The corpus pipeline against its stages' brute-force versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_operators import WORDS, brute_hits, brute_wide, groups, secrets
from zonepulse.llm import langid, simhash
from zonepulse.llm.tokens import Encoder

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    assert {f"op{k}" for k in range(1, 14)} <= {n.split("_")[0] for n in contract.queries()} and "pipeline" in contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices(["ba", "ne", "ri", "lo"], k=2)) for _ in range(n))
    bench = [(k, words(30)) for k in range(4)]
    texts = [words(rng.randint(20, 60)) for _ in range(40)]
    texts += [bench[0][1], words(300) + " " + bench[1][1][:60], None, "123 456", texts[3], texts[4] + ' token = "abcdef123"', "жук и щука " * 6]
    spark.createDataFrame([(k, t, "xx", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rejected = {r["id"] for r in langid.identify(docs, langid.train(docs)).where("rejected").collect()}
    assert {42, 43} <= rejected and not rejected & set(range(42))
    kept = [k for k in range(len(texts)) if k not in rejected]
    prints = [brute_wide(texts[k]) for k in kept]
    root = groups(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS_WIDE])
    kept = [k for i, k in enumerate(kept) if root[i] == i]
    kept = [k for k in kept if not brute_hits(texts[k], bench)[3]]
    assert 44 not in kept and 40 not in kept
    coder = Encoder(WORDS, False)
    clean = {k: secrets.redacted(texts[k], secrets.base_spans(texts[k])) for k in kept}
    want = {k: len(coder.ids([t])[0]) // 4 + 1 for k, t in clean.items()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.secret_scan(spark, docs, SF).where(F.length("text") != F.col("n_chars")).count() == 0
