import hashlib
import io
import zlib

import pytest

from sealwright.llm import media as m

from .conftest import odd_texts


def test_images_are_lossless():
    for raw in (b"", b"x", bytes(range(256)) * 3, b"a" * 192, b"\xff" * 193):
        image = m.to_image(raw)
        payload, n = m.from_image(image)
        assert n == len(raw) and payload == raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        broken = bytearray(image)
        broken[-20] ^= 1
        with pytest.raises(Exception):
            m.from_image(bytes(broken))


def test_query_against_brute_force(spark, make, rng):
    rows = list(enumerate(odd_texts(rng))) + [(3, "twice"), (3, "twice"), (None, "no id")]
    got = sorted((tuple(r) for r in m.media_features(spark, make(rows)).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        image = m.to_image(raw)
        want.append((doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), len(image), hashlib.sha256(image).hexdigest(), m.feature(full)))
    assert got == sorted(want, key=repr)
    assert m.media_features(spark, make([])).collect() == []


def test_ranges_share_the_members_and_images_open_elsewhere(spark, make):
    from sealwright.llm.shared import shared_folder

    folder = shared_folder(spark, "media-test")
    m.write_archives(make([(i, f"text {i} " * 50) for i in range(200)]), folder)
    spark.dataSource.register(m.MediaArchives)
    members = spark.read.format("media_archives").option("range_bytes", 3000).load(folder)
    assert members.rdd.getNumPartitions() > 8
    assert sorted(r["doc_id"] for r in m.features(members).collect()) == list(range(200))


def test_a_member_is_tried_again_by_its_offset():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
    info = zipfile.ZipFile(out).getinfo("b")

    class Flaky(io.BytesIO):
        fails, seeks = 2, []

        def seek(self, at, *a):
            Flaky.seeks.append(at)
            return super().seek(at, *a)

        def read(self, n=-1):
            if Flaky.fails:
                Flaky.fails -= 1
                raise OSError("lost")
            return super().read(n)

    assert m.read_member(Flaky(out.getvalue()), "b", info.header_offset, info.compress_size, info.CRC) == b"second"
    assert min(Flaky.seeks) == info.header_offset
    with pytest.raises(OSError):
        m.read_member(io.BytesIO(out.getvalue()), "b", info.header_offset + 1, info.compress_size, info.CRC)
