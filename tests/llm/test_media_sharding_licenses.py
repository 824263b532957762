import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from surestat.llm import common, licenses, media, sharding


def test_payloads_come_back(messy, empty):
    pages = media.media_pages(messy)
    out = media.resolved(media.interleaved(pages, "doc_id"), media.media_store(pages), "doc_id").where("kind = 'media'").collect()
    expected = Counter()
    for r in messy.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        expected[r.doc_id, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == expected
    assert media.read_back(media.stored(b"x" * 128)) == b"x" * 128
    none = media.media_pages(empty)
    assert media.resolved(media.interleaved(none, "doc_id"), media.media_store(none), "doc_id").count() == 0


def test_interleaving_keeps_order_positions_and_captions(spark):
    html = "<h1>T</h1><p>one <b>two</b><script>no()</script></p><figure><img src='d1' alt='old'><figcaption>a cap</figcaption></figure><p>three<img src=d2>four &amp; five"
    parts = media.parse(html)
    assert [(p["pos"], p["kind"], p["text"] or p["ref"], p["caption"]) for p in parts] == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", "d1", "a cap"), (3, "text", "three", None), (4, "media", "d2", None), (5, "text", "four & five", None)]
    assert media.parse(None) == [] and media.parse("<!-- <p>x") == []
    pages = spark.createDataFrame([(1, html), (2, None), (None, "<img src=d1>")], "page_id long, html string")
    store = spark.createDataFrame([("d1", 7)], "digest string, size int")
    rows = media.resolved(media.interleaved(pages), store).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.size) for r in rows if r.kind == "media"] == [(None, 0, 7), (1, 2, 7), (1, 4, None)]


def maps(spark):
    return common.new_folder(spark, "maps")


def placed_by_hand(docs, n_slots, n_shards):
    """The whole result in plain Python: (doc_id, size, crc, shard, slot, virtual slot)."""
    rows = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        key = str(r.doc_id) if r.doc_id is not None else hashlib.md5(raw).hexdigest()
        rows.append((int(hashlib.md5(key.encode()).hexdigest()[:7], 16) % n_slots, r.doc_id, len(raw) + 1, zlib.crc32(raw)))
    held = Counter()
    for v, _, size, _ in rows:
        held[v] += size
    loads, of = [0] * n_shards, {}
    for v in sorted(range(n_slots), key=lambda v: (-held[v], v)):
        of[v] = loads.index(min(loads))
        loads[of[v]] += held[v]
    out, next_ = [], Counter()
    for v, key, size, crc in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        out.append((key, size, crc, of[v], next_[of[v]], v))
        next_[of[v]] += 1
    return out


def test_sharding_equals_brute_force(spark, messy):
    docs = messy.select("doc_id", "text").union(spark.range(20, 700).selectExpr("id doc_id", "repeat('né ', cast(id * 7919 % 97 AS int)) text"))
    got = sharding.shard(docs, sharding.planned(docs, maps(spark), 5, 64), 64).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.vslot) for r in got) == Counter(placed_by_hand(docs, 64, 5))


def test_stored_maps_are_versions_that_stay(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('x', cast(id % 50 AS int)) text")
    folder = maps(spark)
    first = sharding.planned(docs, folder, 16, 512)
    before = {r.doc_id: r for r in sharding.shard(docs, first, 512).collect()}
    second = sharding.grown(spark, folder, 17)
    after = {r.doc_id: r for r in sharding.shard(docs, second, 512).collect()}
    assert {r.version for r in before.values()} == {1} and {r.version for r in after.values()} == {2}
    moved = [i for i in before if before[i].shard != after[i].shard]
    assert {after[i].shard for i in moved} == {16} and 0 < len(moved) < 2 * len(before) / 17
    load = Counter()
    for r in after.values():
        load[r.shard] += r["size"]
    assert len(load) == 17 and max(load.values()) < 1.25 * min(load.values())
    again = {r.doc_id: r for r in sharding.shard(docs, sharding.load_map(spark, folder, 1), 512).collect()}
    assert again == before and {r.version for r in sharding.load_map(spark, folder).collect()} == {2}
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(first, folder)


def test_shards_are_even_and_places_gapless(spark, messy, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 500).cast("int")).alias("text"))
    shard = lambda docs, n: sharding.shard(docs, sharding.planned(docs, maps(spark), n_slots=n), n)
    rows = shard(docs, 512).collect()
    size, places = Counter(), {}
    for r in rows:
        size[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(size) == 16 and max(size.values()) - min(size.values()) <= 0.01 * max(size.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    odd = shard(messy, 4096).collect()
    assert len(odd) == messy.count() and sum(r["size"] == 1 for r in odd) == 3
    assert {r.text_crc32 for r in odd if r.doc_id == 4} == {0}
    assert shard(empty, 4096).count() == 0


def test_rebalancing_moves_slots_only_into_new_shards(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    first = sharding.first_map(sharding.slot_bytes(sharding.sized(docs, 256), 256), 4)
    was = {r.vslot: r.shard for r in first.collect()}
    then = sharding.rebalanced(first, 5).collect()
    assert all(r.version == 2 for r in then) and len(then) == 256
    assert {r.shard for r in then if r.shard != was[r.vslot]} == {4}
    load = Counter()
    for r in then:
        load[r.shard] += r.bytes
    assert max(load.values()) < 1.3 * min(load.values())


def test_licenses_match_entire_texts_only(spark, messy, empty):
    mit = licenses.KNOWN["MIT"][0]
    docs = spark.createDataFrame(
        [(1, f"{mit.upper()}\nCopyright (c) 2020 Someone"), (2, f"a\n{mit}\n  released UNDER the mit licence!! \nz"), (3, f"{mit} and more"), (4, None), (5, "..."), (1, mit), (None, mit)],
        "doc_id long, text string",
    )
    known = licenses.known_licenses(spark)
    got = licenses.scan(docs, known, 30).collect()
    assert Counter((r.doc_id, r.license, r.n_notices, r.notices) for r in got) == Counter([(1, "MIT", 1, "MIT"), (2, None, 2, "MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (1, "MIT", 1, "MIT"), (None, "MIT", 1, "MIT")])
    assert [r.text_digest for r in got if r.doc_id in (4, 5)] == [None, None]
    by_shuffle = licenses.scan(docs, known, licenses.BROADCAST_ROWS + 1).collect()
    assert Counter(map(tuple, by_shuffle)) == Counter(map(tuple, got))
    assert licenses.scan(messy, known, 30).count() == messy.count() and licenses.scan(empty, known, 30).count() == 0
