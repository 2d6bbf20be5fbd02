import hashlib
import zipfile
import zlib

import pytest

from folioframe.llm import media as M
from folioframe.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("text", [None, "", "a", "x" * 192, "é" * 500, "\x00\x1f" * 300])
def test_round_trip(text):
    n, payload = M.payload_of(text)
    assert len(payload) % 192 == 0 and payload and n == len((text or "").encode()) and M.decode_png(M.encode_png(payload)) == payload


def test_damage_is_seen_and_reads_are_repeated():
    image = bytearray(M.encode_png(M.payload_of("hello")[1]))
    image[60] ^= 1
    with pytest.raises(ValueError):
        M.decode_png(bytes(image))
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return 7

    assert M.retried(flaky) == 7 and len(tries) == 3


def test_query_matches_the_texts(spark):
    got = {r.doc_id: r for r in M.op9_media_columns(spark, "/root/testdata/sf0.001").collect()}
    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert len(got) == len(rows)
    for d in rows:
        n, payload = M.payload_of(d.text)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(M.encode_png(payload)).hexdigest()


def test_small_archives_ranges_and_awkward_rows(spark, tmp_path):
    rows = [(i % 7 if i % 9 else None, f"text {i} " * i, "en", "s", 1) for i in range(60)] + [(1, None, None, None, None), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "media").repartition(3)
    M.write_archives(M.media_rows(docs), f"file://{tmp_path}/a", archive_bytes=2000)
    (tmp_path / "a" / "part-orphan.zip").write_bytes(b"of a lost attempt")
    back = M.read_archives(spark, f"file://{tmp_path}/a", range_bytes=500)
    assert back.rdd.getNumPartitions() > 6
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, M.decode_png(r.media)) for r in back.collect())
    assert got == sorted((i is not None, i or 0, *M.payload_of(t)) for i, t, *_ in rows)
    M.write_archives(M.media_rows(docs.limit(0)), f"file://{tmp_path}/b")
    assert M.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_a_damaged_member_fails_after_its_retries(spark, tmp_path):
    M.write_archives(M.media_rows(spark.createDataFrame([(1, "x" * 999, "e", "s", 1)], DOCS)), str(tmp_path))
    path = next(tmp_path.glob("part-*.zip"))
    data = bytearray(path.read_bytes())
    info = zipfile.ZipFile(path).infolist()[0]
    data[info.header_offset + 80] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged member"):
        M.read_archives(spark, str(tmp_path)).collect()
