from pathlib import Path

from pyspark.sql import functions as F

from surestat.llm import media


def test_media_lie_in_the_shared_folder_once_a_digest(spark, messy):
    store = media.stored_media(media.media_pages(messy))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert all(Path(f.removeprefix("file:")).is_relative_to(folder) for f in store.inputFiles()) and store.inputFiles()
    kept = {r.digest: media.read_back(r.media)[: r.n_bytes] for r in store.collect()}
    texts = {(r.text or "").encode() for r in messy.collect()}
    assert sorted(kept.values()) == sorted(texts) and store.count() == len(texts)


def test_facts_are_of_the_stored_bytes(spark, messy, monkeypatch):
    made = media.stored_media(media.media_pages(messy))
    other = made.withColumn("media", F.lit(bytearray(media.stored(b"x" * 64)))).withColumn("n_bytes", F.lit(64).cast("long"))
    monkeypatch.setattr(media, "stored_media", lambda pages: other)
    assert {r.payload_bytes for r in media.media_store(media.media_pages(messy)).collect()} == {64}
