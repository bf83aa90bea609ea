import re

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import LEAST_LANGUAGE_SCORE, STAGES, run
from lexistrata.llm.langid import train_languages
from lexistrata.llm.quality import train_quality
from tests.llm.test_near_dedup import plain_components

D = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what its predecessor kept; trained models score the texts one by one, the rest is brute force."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert len(STAGES) == 5
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if k == 0:
            net = train_quality(docs, spark.read.parquet(f"{D}/labels.parquet"))
            assert kept == {i for i, t in rows.items() if net.scores([t or ""])[0] >= 0.3}
            labels = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()}
            assert len(labels - kept) <= 0.03 * len(labels)
        elif k == 1:
            model = train_languages(docs)
            got = {i: model.predict([t or ""]) for i, t in rows.items()}
            assert kept == {i for i, (lang, score) in got.items() if lang[0] != "und" and score[0] >= LEAST_LANGUAGE_SCORE}
        elif k == 2:
            best = {}
            for i, t in rows.items():
                key = re.sub(r"[\x20\x09-\x0D]+", "", t)
                best[key] = min(best.get(key, (1, 0)), (-len(t), i))
            assert kept == {i for _, i in best.values()}
        elif k == 3:
            assert kept == set(plain_components(sorted(rows.items())).values())
        else:
            tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
            sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
            found = {}
            for r in after.collect():
                found[r.doc_id] = found.get(r.doc_id, 0) + r.length
            assert found == sizes
        docs = after


def test_run_is_the_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    out = run(spark, D)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_odd_tables(spark):
    """Nulls, extra and clashing columns, repeated rows, no rows: filters keep the columns, nothing fails."""
    schema = "text string, doc_id long, lang string, source string, n_chars long, _id int, score map<string,array<int>>"
    good = spark.read.parquet(f"{D}/documents.parquet").where("lang = 'en' and n_chars > 300").orderBy("doc_id").limit(2).collect()
    rows = [(None, 1, None, None, None, None, None), ("", 2, "en", "s", 0, 1, {}), (good[0].text, 3, "en", "s", 1, 1, {"a": [1]}), (good[0].text, 3, "en", "s", 1, 1, {"a": [1]}), (good[0].text + " ", 4, "en", "s", 1, 1, {}), (good[1].text, None, "en", "s", 1, 1, {}), ("12 34", 5, "de", "s", 1, 1, {})]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, D)
            got = out.collect()
            if k < 4:
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            if k == 1:
                assert {r.doc_id for r in got} <= {3, 4, None}
            if k == 2 and data:
                assert [r.doc_id for r in got if r.text and r.text.strip() == good[0].text.strip()] == [4]
