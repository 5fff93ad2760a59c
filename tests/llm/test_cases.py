"""Defined cases: texts longer than a shard, clashing columns, empty tables, and the whole pipeline on odd tables."""

import collections

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import decontamination, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_text_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    passage = " ".join(f"p{k}" for k in range(12))
    body = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{body} {passage} {body}"), (2, passage), (3, body)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage + " x")], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontamination.mark_contamination(docs, bench).collect()}
    assert found == {1: (812, 12, ["7"]), 2: (12, 12, ["7"]), 3: (400, 0, [])}


def test_archives_of_pages_with_clashing_columns(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}.example/{k}", "same payload " * 10 if k % 2 else f"own {k}") for k in range(12)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    clash = pages.withColumns({n: F.lit("x") for n in ("bytes", "first", "n", "sha", "record", "url_key", "captured", "run", "place", "_key", "part", "position")})
    made = []
    for k, frame in enumerate((pages, clash)):
        warc.write_archives(frame, str(tmp_path / str(k)))
        history = warc.capture_history(warc.read_archives(spark, str(tmp_path / str(k))))
        made.append(sorted(map(str, history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    assert made[0] == made[1] and len(made[0]) == 13


def test_scores_of_an_empty_table(spark):
    docs = spark.createDataFrame([(k, f"some words of text number {k} stand here.") for k in range(40)], "doc_id long, text string")
    assert quality.score_texts(docs.where("false"), quality.train(docs)).count() == 0


def long_words():
    return " ".join(f"z{k * 7919 % 100_003}" for k in range(40_000))


@pytest.mark.parametrize("case", ["empty", "equal", "long"])
def test_the_whole_pipeline_on_odd_tables(spark, tmp_path, case):
    import corpus_pipeline

    plain = [(k, " ".join(f"v{(k * 31 + j * j) % 997}" for j in range(40 + k)), "en", "web", 1) for k in range(30)]
    rows = {
        "empty": [],
        "equal": [*plain, plain[3], plain[3], (None, "no id at all", None, None, None), (None, None, None, None, None), (None, None, None, None, None), (77, "", None, None, 0)],
        "long": [*plain, (None, long_words(), None, None, None), (99, long_words() + " end", None, None, None)],
    }[case]
    spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1)).withColumn("spans", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k == 29)) for k in range(30)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "not to be found " * 5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(found) == 0) == (case == "empty")
    by_id = collections.defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.piece, r.start, r.length))
    if case == "equal":
        assert by_id[3] in ([], sorted(by_id[3])) and len(by_id[3]) <= 1  # one of three equal rows, if it isn't toxic
        assert len(by_id[None]) == 2 and len(by_id[77]) == 1  # a text without an id, one of two equal empty rows, an empty text
    if case == "long":
        kept = [sorted(v) for k, v in by_id.items() if k in (None, 99)]
        assert len(kept) == 1 and len(kept[0]) > 20 and all(n == 2048 for _, _, n in kept[0][:-1])  # near copies: one stays, in pieces
