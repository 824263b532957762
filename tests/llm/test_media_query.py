"""The media columns against plain Python, and the driver's pages as sequences."""

import hashlib
import re
import statistics
import zlib
from collections import Counter
from pathlib import Path

import pytest

from surestat.llm import media
from surestat.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")


def by_hand(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
    steps = [abs(payload[i + 1] - payload[i]) for i in range(len(payload) - 1) if i % 64 != 63]
    feature = f"{len(payload) // 64}x64:{statistics.fmean(payload):.6f}:{statistics.pstdev(payload):.6f}:{statistics.fmean(steps):.6f}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature


def test_the_query_equals_plain_python(spark):
    got = media.query(spark, DATA)
    rows = table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert Counter(tuple(r)[:8] for r in got.select("doc_id", *media.NAMES).collect()) == Counter((r.doc_id, *by_hand(r.text)) for r in rows)
    assert {(r.pos, r.caption == f"payload of {r.doc_id}") for r in got.collect()} == {(1, True)}


def test_the_driver_s_pages_are_sequences(spark):
    pages = table(spark, DATA, "pages")
    found = {r.page_id: r for r in media.interleaved(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        parts = found[r.page_id].parts
        assert [p.pos for p in parts] == list(range(len(parts))) and {p.kind for p in parts} <= {"text", "media"}
        assert all((p.kind == "text") == (p.text is not None) == (p.ref is None) for p in parts)
        # every visible word is there, in order, none of a script
        shown = re.sub(r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", r.html or "")
        said = " ".join(x for p in parts for x in (p.text or "", p.caption or ""))
        assert Counter(re.findall(r"[a-z]{4,}", said)) == Counter(re.findall(r"[a-z]{4,}", shown)) or "&" in (r.html or "") or "alt=" in (r.html or "")
