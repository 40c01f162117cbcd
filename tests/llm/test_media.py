import hashlib
import zlib

from graphloom.llm.common import shared_dir
from graphloom.llm.media import from_png, media_columns, payload_of, png_header, tar_members, to_png


def test_png_is_lossless():
    for text in (None, "", "a" * 63, "b" * 64, "ü" * 1000):
        n, payload = payload_of(text)
        assert len(payload) % 64 == 0 and payload and payload[:n] == (text or "").encode()
        assert from_png(to_png(payload)) == payload
        assert png_header(to_png(payload)[:33]) == (64, len(payload) // 64, 8)


def test_rows_point_at_members_and_equal_texts_agree(spark):
    rows = [(1, "hello", 5), (2, "hello", 6), (3, None, 7), (None, "", 8), (4, "x" * 70_000, 9)]
    out = media_columns(spark.createDataFrame(rows, "doc_id long, text string, offset int")).collect()
    assert len(out) == 5
    for r in out:
        text = {i: t for i, t, _ in rows}[r.doc_id]
        n, payload = payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        path = next(iter([p for p in __import__("glob").glob(f"{shared_dir(spark).removeprefix('file://')}/media-*/{r.shard}")]))
        members = tar_members(open(path, "rb").read())
        assert hashlib.sha256(members[f"{r.digest}.png"]).hexdigest() == r.media_sha256 and r.height * 64 == r.payload_bytes
    by = {r.doc_id: r for r in out}
    assert by[1].feature == by[2].feature and by[3].media_sha256 == by[None].media_sha256


def test_empty_table(spark):
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []
