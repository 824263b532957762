"""Operator 4, media columns: interleaved document sequences.

interleaved() parses HTML into an ordered array of structs: text pieces and media references, each with its position, and a
reference with its caption. resolved() joins the references by digest to a store of media, one row per distinct digest,
so a payload is stored once however many documents refer to it; positions and captions stay with their reference. A
store's media are greyscale images (binary PGM, 8 bits a sample, 64 samples a row), which hold any bytes without loss.
stored_media() writes them to a table in the shared folder, and their hashes and features come from that table's bytes.

Defined results: null or empty HTML gives an empty sequence; an unclosed tag, comment or script ends with the text; a
reference without a stored payload keeps its place with null media; equal payloads give one stored medium; null texts
count as empty; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, table, written

WIDTH = 64
ROW_GROUP_BYTES = str(16 << 20)
PART = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
_SILENT = {"script", "style", "template"}
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "li", "ul", "ol", "nav", "figure", "br", "tr", "td", "table", "title", "body"}


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.caption = False
        self.figure: int | None = None  # where in parts the open figure began

    def flush(self) -> None:
        said = " ".join("".join(self.words).split())
        self.words = []
        if not said:
            return
        if self.caption and self.figure is not None:
            for part in self.parts[self.figure :]:
                if part["kind"] == "media":
                    part["caption"] = said
            return
        self.parts.append({"pos": len(self.parts), "kind": "text", "text": said, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in ("img", "audio", "video", "source"):
            self.flush()
            have = dict(attrs)
            if have.get("src"):
                self.parts.append({"pos": len(self.parts), "kind": "media", "text": None, "ref": have["src"], "caption": have.get("alt") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = True
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.parts)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.flush()
            self.caption = False
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered parts of one page."""
    reader = _Sequence()
    reader.feed(html or "")
    if reader.rawdata.startswith("<"):
        reader.rawdata = ""  # markup that doesn't end
    reader.close()
    reader.flush()
    return reader.parts


def interleaved(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, parts): parts is the ordered array of text and media-reference structs of each page."""
    kind = dict(pages.select(F.col(key).alias("key")).dtypes)["key"]
    schema = f"key {kind}, parts array<{PART}>"

    def make():
        struct = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x) for x in b.column(1).to_pylist()], struct)], ["key", "parts"])

    return by_batch(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), make, schema).withColumnRenamed("key", key)


def stored(payload: bytes) -> bytes:
    """A payload, a positive multiple of WIDTH bytes, as a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def read_back(media: bytes) -> bytes:
    """The samples of a binary PGM image, by its own header."""
    kind, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit greyscale image")
    return samples


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples and of neighbours' differences in a row: a small picture of texture."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    step = np.abs(np.diff(x.astype(np.int16), axis=1))
    return f"{len(x)}x{WIDTH}:{x.mean(dtype=np.float64):.6f}:{x.std(dtype=np.float64):.6f}:{step.mean(dtype=np.float64):.6f}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


NAMES = [x.split()[0] for x in FACTS.split(", ")]


def _facts(n: int, media: bytes) -> tuple:
    back = read_back(media)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)


def media_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as a page that refers to its payload by digest: (key, html, digest, n_bytes, packed). packed is the
    medium's PGM bytes, deflated for the way to the store."""
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def make():
        def handle(b):
            html, digest, sizes, packed = [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, payload = padded(text)
                # the unpadded length is in the key: texts that differ in trailing zero bytes share a payload
                digest.append(f"sha256:{hashlib.sha256(payload).hexdigest()}:{n}")
                html.append(f'<article><h1>{k}</h1><figure><img src="{digest[-1]}"><figcaption>payload of {k}</figcaption></figure></article>')
                sizes.append(n)
                packed.append(zlib.compress(stored(payload), 3))
            columns = [pa.array(html, pa.string()), pa.array(digest, pa.string()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays([b.column(0), *columns], ["key", "html", "digest", "n_bytes", "packed"])

        return handle

    schema = f"key {kind}, html string, digest string, n_bytes long, packed binary"
    return by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, schema).withColumnRenamed("key", key)


def stored_media(pages: DataFrame) -> DataFrame:
    """(digest, n_bytes, media): the table of media in the shared folder, one row for each digest; media are whole PGM files.
    Equal digests have equal bytes, so which copy stays doesn't matter. Partial aggregation leaves a task one row a digest
    before the shuffle, however many copies it has."""
    once = pages.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("packed").alias("packed"))

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.decompress(x) for x in b.column(2).to_pylist()], pa.binary())], ["digest", "n_bytes", "media"])

    # small row groups: a writing task holds one
    return written(by_batch(once, make, "digest string, n_bytes long, media binary"), "media-store", **{"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES})


def media_store(pages: DataFrame) -> DataFrame:
    """One row for each digest, with what its medium gives when the stored bytes are read back."""

    def make():
        def handle(b):
            facts = [_facts(n, media) for n, media in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = list(zip(*facts, strict=True)) if facts else [[]] * len(NAMES)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["digest", *NAMES])

        return handle

    return by_batch(stored_media(pages), make, f"digest string, {FACTS}")


def resolved(sequences: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, text, ref, caption, and the store's columns): every part in its place, references joined to the
    store by digest. The store has one row a digest, so the join makes no more rows than there are parts; the parts of a
    popular digest are narrow rows, which adaptive execution splits over tasks."""
    parts = sequences.select(key, F.explode("parts").alias("part")).select(key, "part.*")
    return parts.join(store.withColumnRenamed("digest", "ref"), "ref", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are written once for each digest; pages are made again for their sequences rather than stored."""
    pages = media_pages(table(spark, sf_dir, "documents"))
    found = resolved(interleaved(pages, "doc_id"), media_store(pages), "doc_id")
    return found.where("kind = 'media'").select("doc_id", *NAMES, "pos", "caption")
