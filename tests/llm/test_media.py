import hashlib
import struct
import zlib

import numpy as np

from strandloom.llm import media as M

from .helpers import clashing, corpus, empty, table


def test_any_bytes_round_trip():
    rng = np.random.default_rng(0)
    for payload in (bytes(192), b"\xff" * 384, bytes(rng.integers(0, 256, 192 * 30, dtype=np.uint8)), "é日本 ".encode().ljust(192)):
        video = M.parse_avi(M.store(payload))
        units = M.read_units(video)
        assert units.tobytes() == payload
        assert (M.decode_luma(video) == M.luma_of_units(units)).all()  # the general decoder sees the same pictures


def baseline_frame(levels, width, height):
    """A grey JPEG of flat blocks, coded with a table of fixed-length codes and one for the end of a block."""
    head = b"\xff\xd8" + M._segment(0xDB, bytes([0]) + bytes([8] * 64)) + M._segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    head += M._segment(0xC4, bytes([0x00, 0, 0, 0, 12, *([0] * 12)]) + bytes(range(12))) + M._segment(0xC4, bytes([0x10, 1, *([0] * 15), 0])) + M._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits, last = "", 0
    for v in levels:
        d, last = v - last, v
        size = abs(d).bit_length()
        bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_decode_shots_and_clips(spark):
    dark, bright = [-100] * 6, [90] * 6
    frames = [baseline_frame(dark, 24, 16)] * 20 + [baseline_frame(bright, 24, 16)] * 15 + [baseline_frame(dark, 24, 16)] * 5
    assert set(np.unique(M.JpegFrame(frames[0]).luma())) == {28} and M.JpegFrame(frames[0]).luma().shape == (16, 24)
    avi = M.write_avi(frames, 24, 16)
    video = M.parse_avi(avi)
    assert (video.width, video.height, len(video.sizes)) == (24, 16, 40)
    rows = M.clip_rows(spark.createDataFrame([(1, bytearray(avi)), (2, None)], "media_id long, data binary"), "media_id", "data").orderBy("clip").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 800_000, 20), (1, 1, 800_000, 1_400_000, 15), (1, 2, 1_400_000, 1_600_000, 5)]
    cut = avi[: avi.index(b"idx1")]  # without an index the frames are found by walking
    assert (M.parse_avi(cut).sizes == video.sizes).all() and (M.parse_avi(cut).offsets == video.offsets).all()


def test_shots_of_short_and_steady_videos():
    assert M.shots(np.zeros((0, 4))) == [] and M.shots(np.ones((1, 4))) == [(0, 1)] and M.shots(np.ones((9, 4)) / 4) == [(0, 9)]


def test_text_media(spark):
    rows = corpus()
    got = {r.doc_id: r for r in M.text_media(clashing(table(spark, rows))).collect()}
    same = {}
    for key, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert same.setdefault(text or "", tuple(r)[4:]) == tuple(r)[4:]
    assert M.text_media(empty(spark)).count() == 0


def test_media_bytes(spark):
    r, = M.text_media(table(spark, [(1, "abc", None, None, None)]), with_media=True).collect()
    assert hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
