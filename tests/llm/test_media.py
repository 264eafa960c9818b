"""Audio: reference values, round trips, edge cases."""

import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from tessera.llm import media


def test_companding_tables():
    assert media.MULAW_TABLE[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(media.ALAW_TABLE.tolist())) == 256


def slow_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(media.INDEX_STEPS[code & 7])))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    r = np.random.default_rng(1)
    blocks = r.integers(0, 256, (7, 36), dtype="u1")
    blocks[:, 2] %= 89
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


def test_resample():
    x = np.array([0, 100, -100], dtype="<i2")
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert media.resample(x, 8000, 8000).tolist() == x.tolist() and len(media.resample(x[:0], 8000, 16000)) == 0


def test_columns(spark):
    data = bytes(range(256))
    block = struct.pack("<hBB", 5, 10, 0) + b"\x12\x34"
    cases = [(1, media.wav(media.MULAW, data)), (2, media.wav(media.ALAW, data)), (3, media.wav(media.ADPCM, block * 2, block=6, samples=9)), (4, media.wav(media.PCM, b"\1\0\2\0")), (5, None), (6, b"junk"), (7, b"")]
    got = {r.id: r.pcm for r in media.to_pcm(spark.createDataFrame([(i, b, "x") for i, b in cases], "doc_id long, media binary, pcm string"), out_rate=8000).collect()}
    read = {i: None if p is None else np.frombuffer(media.read_wav(bytes(p)).data, dtype="<i2").tolist() for i, p in got.items()}
    assert read[1] == media.MULAW_TABLE.tolist() and read[2] == media.ALAW_TABLE.tolist()
    assert read[3] == (slow_adpcm(block) * 2)[:9] and read[4] == [1, 2] and read[5] is read[6] is read[7] is None


@pytest.mark.parametrize("text", ["", "a" * 64, "é" * 40, "x" * 100_000])
def test_payload_round_trip(spark, text):
    docs = spark.createDataFrame([(1, text, 0), (2, text, 0), (None, None, 0)], "doc_id long, text string, media int")
    rows = media.stored_digests(media.store_texts(docs)).collect()
    own = [r for r in rows if r.doc_id is not None]
    raw = text.encode()
    padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert [(r.n_bytes, r.payload_bytes, r.payload_sha256) for r in own] == [(len(raw), len(padded), hashlib.sha256(padded).hexdigest())] * 2
    assert own[0].feature == own[1].feature and own[0].media_sha256 == own[1].media_sha256 and len(rows) == 3
    assert media.stored_digests(media.store_texts(docs.limit(0))).collect() == []


def test_all_formats_hold_payloads():
    r = np.random.default_rng(2)
    own = [r.integers(0, 256, 64 * int(n), dtype="u1").tobytes() for n in r.integers(1, 40, 60)]
    audios = [media.read_wav(media.stored(p)) for p in own]
    assert {a.kind for a in audios} == {media.MULAW, media.ALAW, media.ADPCM} and [media.held(a) for a in audios] == own
    for a, samples in zip(audios, media.expanded(audios), strict=True):
        if a.kind == media.ADPCM:
            assert samples.tolist() == [x for i in range(0, len(a.data), media.BLOCK) for x in slow_adpcm(a.data[i : i + media.BLOCK])]
        else:
            assert samples.tolist() == media.expand(a).tolist() and len(samples) == len(a.data)


def slow_feature(pcm):
    wide = [int(x) for x in pcm]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
    return f"n={len(wide)};peak={max(map(abs, wide), default=0)};ms={sum(x * x for x in wide) // max(1, len(wide))};zc={crossings};crc={zlib.crc32(np.array(wide, '<i2').tobytes()):08x}"


def slow_resample(x, rate, out_rate):
    x = [int(v) for v in x]
    wide = [*x, *x[-1:]]
    return [(wide[k * rate // out_rate] * (out_rate - k * rate % out_rate) + wide[k * rate // out_rate + 1] * (k * rate % out_rate) + out_rate // 2) // out_rate for k in range(len(x) * out_rate // rate)]


@pytest.mark.parametrize("size", [68, 100, 1 << 20])
@pytest.mark.parametrize("out_rate", [8000, 16000, 11025, 5000])
def test_slices_give_what_whole_samples_give(monkeypatch, size, out_rate):
    monkeypatch.setattr(media, "SLICE", size)
    r = np.random.default_rng(out_rate)
    own = [media.stored(r.integers(0, 256, 64 * n, dtype="u1").tobytes()) for n in (1, 2, 3, 7, 13, 20)] + [media.wav(media.PCM, r.integers(0, 256, 602, dtype="u1").tobytes()), media.wav(media.MULAW, b"")]
    audios = [media.read_wav(x) for x in own]
    for a, slices in zip(audios, media.resampled_pcm(audios, out_rate), strict=True):
        parts = list(slices)
        got = np.concatenate(parts) if parts else np.empty(0, "<i2")
        assert got.tolist() == slow_resample(media.expand(a), a.rate, out_rate)
        assert media.feature(parts) == slow_feature(got)


def test_long_texts_are_held_in_slices():
    """What a long payload takes beyond its stored bytes doesn't grow with it."""
    r = np.random.default_rng(5)
    peaks = {}
    for size in (4 << 20, 16 << 20):
        own = r.integers(0, 128, size, dtype="u1").tobytes()
        blocks = np.zeros((size // media.PAD, media.BLOCK), "u1")
        blocks[:, 4:] = np.frombuffer(own, "u1").reshape(-1, media.PAD)
        for kind, raw in ((media.MULAW, media.wav(media.MULAW, own)), (media.ADPCM, media.wav(media.ADPCM, blocks.tobytes(), block=media.BLOCK))):
            audio = media.read_wav(raw)
            tracemalloc.start()
            (pcm,) = media.resampled_pcm([audio], media.OUT_RATE)
            media.feature(pcm)
            peaks[kind, size] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
    assert max(peaks.values()) < 150e6 and all(peaks[k, 16 << 20] < 1.2 * peaks[k, 4 << 20] + 1e6 for k in (media.MULAW, media.ADPCM)), peaks
