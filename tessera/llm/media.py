"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV bytes, as resampled PCM.

mu-law and A-law bytes are expanded by tables of 256 entries that are made from the companding
rules; ADPCM blocks are decoded together, sample by sample across all blocks. The PCM is
resampled by a rational factor with linear interpolation in whole numbers, so results are the
same everywhere.

Texts are stored in all three formats: the payload's CRC-32 chooses one, so equal texts are stored alike. In
ADPCM each block holds 64 bytes of the payload as its codes.

Defined results: null media gives null PCM; bytes that aren't a supported WAV give null, not an
error; null text is an empty payload, padded to 64 bytes; a text of any length is one payload, of which samples are held a slice at a time; rows are independent, so ids, ties
and repeated rows need no care; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, record, table, text_of, written

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE, OUT_RATE, PAD = 8000, 16000, 64
#: Formats that texts are stored in, and the size of an ADPCM block: its header and ``PAD`` bytes of codes.
STORED, BLOCK = (MULAW, ALAW, ADPCM), 4 + PAD
#: Blocks that are decoded together; and bytes of a long audio that are expanded, resampled and measured at a time.
TOGETHER, SLICE = 1 << 15, 1 << 18

#: IMA ADPCM's fixed step sizes and index steps.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype("<i2")


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype("<i2")


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: a row a block of bytes (4 of header) in, a row of int16 samples out."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype("i4")
    index = np.clip(blocks[:, 2].astype("i4"), 0, 88)
    codes = np.empty((len(blocks), 2 * (blocks.shape[1] - 4)), dtype="u1")
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((len(blocks), codes.shape[1] + 1), dtype="<i2")
    out[:, 0] = value
    for i in range(codes.shape[1]):
        code, step = codes[:, i], STEPS[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, 88)
        out[:, i + 1] = value
    return out


def wav(kind: int, data: bytes, rate: int = RATE, block: int = 1, samples: int | None = None) -> bytes:
    """Mono WAV bytes of format tag ``kind``; other than PCM with a fact chunk, as the format asks."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, ADPCM: 4}[kind]
    align = 2 if kind == PCM else block
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    per_s = rate * align if kind != ADPCM else rate * block // ((block - 4) * 2 + 1)
    form = struct.pack("<HHIIHH", kind, 1, rate, per_s, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form
    if kind != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@dataclass
class Audio:
    kind: int
    rate: int
    block: int
    data: bytes
    samples: int | None


def read_wav(raw: bytes) -> Audio | None:
    """The parts of mono WAV bytes; null if they aren't any."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form, samples = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"fact" and len(body) >= 4:
            samples = struct.unpack_from("<I", body)[0]
        elif name == b"data":
            if form is None or form[1] != 1:
                return None
            return Audio(form[0], form[2], form[4], body, samples)
        at += 8 + size + (size & 1)
    return None


def adpcm_samples(audios: Sequence[Audio]) -> list[np.ndarray]:
    """The samples of ADPCM audios of one block size; their blocks are decoded together."""
    block = audios[0].block
    rows = [len(a.data) // block for a in audios]
    blocks = np.frombuffer(b"".join([a.data[: n * block] for a, n in zip(audios, rows, strict=True)]), dtype="u1").reshape(-1, block)
    out = [decode_adpcm(blocks[i : i + TOGETHER]) for i in range(0, len(blocks), TOGETHER)]
    every = np.concatenate(out) if out else np.empty((0, 2 * (block - 4) + 1), dtype="<i2")
    return [every[end - n : end].ravel()[: a.samples] for a, n, end in zip(audios, rows, np.cumsum(rows).tolist(), strict=True)]


def expanded(audios: Sequence[Audio | None]) -> list[np.ndarray | None]:
    """The int16 samples of each; null for an unsupported format."""
    out = [None if a is None or a.kind == ADPCM else expand(a) for a in audios]
    for block in {a.block for a in audios if a and a.kind == ADPCM and a.block > 4}:
        of = [i for i, a in enumerate(audios) if a and a.kind == ADPCM and a.block == block]
        for i, samples in zip(of, adpcm_samples([audios[i] for i in of]), strict=True):
            out[i] = samples
    return out


def expand(audio: Audio) -> np.ndarray | None:
    """The int16 samples; null for an unsupported format."""
    if audio.kind in (MULAW, ALAW):
        return (MULAW_TABLE if audio.kind == MULAW else ALAW_TABLE)[np.frombuffer(audio.data, dtype="u1")]
    if audio.kind == PCM:
        return np.frombuffer(audio.data[: len(audio.data) // 2 * 2], dtype="<i2")
    return adpcm_samples([audio])[0] if audio.kind == ADPCM and audio.block > 4 else None


def resample(samples: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Linear interpolation at ``out_rate``, in whole numbers, rounded to the nearest."""
    if rate == out_rate or not len(samples):
        return samples.astype("<i2")
    at = np.arange(len(samples) * out_rate // rate, dtype="i8") * rate
    i, part = at // out_rate, at % out_rate
    wide = np.append(samples, samples[-1]).astype("i8")
    return ((wide[i] * (out_rate - part) + wide[i + 1] * part + out_rate // 2) // out_rate).astype("<i2")


def sample_slices(audio: Audio) -> Iterator[np.ndarray]:
    """The samples of a supported audio, some at a time."""
    if audio.kind == ADPCM:
        left, rows = audio.samples, len(audio.data) // audio.block
        for i in range(0, rows, SLICE // audio.block):
            part = decode_adpcm(np.frombuffer(audio.data, "u1", min(SLICE // audio.block, rows - i) * audio.block, i * audio.block).reshape(-1, audio.block)).ravel()[:left]
            left = None if left is None else left - len(part)
            yield part
    elif audio.kind == PCM:
        for i in range(0, len(audio.data) // 2, SLICE):
            yield np.frombuffer(audio.data, "<i2", min(SLICE, len(audio.data) // 2 - i), 2 * i)
    else:
        for i in range(0, len(audio.data), SLICE):
            yield (MULAW_TABLE if audio.kind == MULAW else ALAW_TABLE)[np.frombuffer(audio.data, "u1", min(SLICE, len(audio.data) - i), i)]


def resampled(slices: Iterable[np.ndarray], rate: int, out_rate: int) -> Iterator[np.ndarray]:
    """What ``resample`` gives for all slices together, a slice at a time: what a slice lacks of the next sample waits for it."""
    if rate == out_rate:
        yield from (x.astype("<i2") for x in slices)
        return
    done, base, waiting = 0, 0, np.empty(0, "<i2")  # results so far, and the number of the first sample that waits
    for part in chain(slices, (None,)):
        if part is None and not len(waiting):
            return
        known = base + len(waiting) + (0 if part is None else len(part))
        # a result needs the sample after its own, the last ones excepted
        end = known * out_rate // rate if part is None else -(-(known - 1) * out_rate // rate)
        waiting = np.append(waiting, waiting[-1:] if part is None else part)
        if end > done:
            at = np.arange(done, end, dtype="i8") * rate
            i, share, wide = at // out_rate - base, at % out_rate, waiting.astype("i8")
            yield ((wide[i] * (out_rate - share) + wide[i + 1] * share + out_rate // 2) // out_rate).astype("<i2")
            done = end
        gone = min(done * rate // out_rate - base, len(waiting) - 1)
        waiting, base = waiting[gone:], base + gone


def feature(slices: Iterable[np.ndarray]) -> str:
    """Samples, peak, mean square, zero crossings and CRC-32 of the PCM."""
    n = peak = square = crossings = crc = 0
    last = None
    for pcm in slices:
        if not len(pcm):
            continue
        wide, below = pcm.astype("i8"), pcm < 0
        n, peak, square = n + len(pcm), max(peak, int(np.abs(wide).max())), square + int((wide * wide).sum())
        crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (last is not None and bool(below[0]) != last)
        crc, last = zlib.crc32(pcm.tobytes(), crc), bool(below[-1])
    return f"n={n};peak={peak};ms={square // max(1, n)};zc={crossings};crc={crc:08x}"


def resampled_pcm(audios: Sequence[Audio | None], out_rate: int) -> Iterator[Iterable[np.ndarray] | None]:
    """The resampled PCM of each in slices; null for an unsupported format. Short audios are expanded together, a long one as it is read."""
    long = [a is not None and len(a.data) > SLICE and (a.kind in (PCM, MULAW, ALAW) or a.kind == ADPCM and 4 < a.block <= SLICE) for a in audios]
    short = expanded([None if x else a for a, x in zip(audios, long, strict=True)])
    for a, x, samples in zip(audios, long, short, strict=True):
        yield resampled(sample_slices(a), a.rate, out_rate) if x else None if samples is None else [resample(samples, a.rate, out_rate)]


def to_pcm(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", out_rate: int = OUT_RATE) -> DataFrame:
    """``id, pcm``: a PCM WAV at ``out_rate`` for each WAV in ``media_col``."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        audios = [None if x is None else read_wav(x) for x in b["media"].to_pylist()]
        pcm = [None if s is None else wav(PCM, b"".join(x.tobytes() for x in s), out_rate) for s in resampled_pcm(audios, out_rate)]
        return record(id=b["id"], pcm=pa.array(pcm, pa.binary()))

    return arrow_map(df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{media_col}` as binary) media"), run, "id long, pcm binary")


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes padded with bytes 0 to a positive multiple of 64, and their number without."""
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % PAD or (0 if raw else PAD)), len(raw)


def stored(own: bytes) -> bytes:
    """The WAV bytes that hold a payload."""
    kind = STORED[zlib.crc32(own) % len(STORED)]
    if kind != ADPCM:
        return wav(kind, own)
    blocks = np.zeros((len(own) // PAD, BLOCK), dtype="u1")
    blocks[:, 4:] = np.frombuffer(own, dtype="u1").reshape(-1, PAD)
    return wav(ADPCM, blocks.tobytes(), block=BLOCK, samples=len(blocks) * (2 * PAD + 1))


def held(audio: Audio) -> bytes:
    """The payload that stored audio holds."""
    return audio.data if audio.kind != ADPCM else np.frombuffer(audio.data, dtype="u1").reshape(-1, BLOCK)[:, 4:].tobytes()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table ``id, n_bytes, media``: payloads as the samples of mu-law and A-law WAVs, or the codes of ADPCM."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [payload(t) for t in b["text"].to_pylist()]
        return record(id=b["id"], n_bytes=pa.array([n for _, n in own], pa.int64()), media=pa.array([stored(p) for p, _ in own], pa.binary()))

    return written(arrow_map(text_of(docs, id_col, text_col), run, "id long, n_bytes long, media binary"), "media", "zstd")


def stored_digests(stored: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """Digests and features of stored media, all from the bytes that were read back."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, media = [], b["media"].to_pylist()
        audios = [read_wav(raw) for raw in media]
        for raw, audio, pcm in zip(media, audios, resampled_pcm(audios, out_rate), strict=True):
            own = held(audio)
            rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-PAD:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(pcm)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return record(
            doc_id=b["id"], n_bytes=b["n_bytes"], payload_bytes=pa.array(cols[0], pa.int64()), payload_sha256=pa.array(cols[1], pa.string()), tail_crc32=pa.array(cols[2], pa.int64()),
            media_bytes=pa.array(cols[3], pa.int64()), media_sha256=pa.array(cols[4], pa.string()), feature=pa.array(cols[5], pa.string()),
        )

    return arrow_map(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(store_texts(table(spark, sf_dir, "documents")))
