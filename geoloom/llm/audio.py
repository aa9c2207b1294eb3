"""Telephony audio in media columns.

A payload of bytes is telephony audio: 8-bit samples at 8 kHz in a WAV container
(``with_media``), expanded by a lookup table of 256 entries (mu-law, A-law) or decoded
as ADPCM (blocks of 64 bytes: a 4-byte head with predictor and step index, then 120
nibbles; numpy carries all blocks of a batch through the 120 steps together), and
resampled to 16-bit PCM at another rate by linear interpolation (``with_pcm``).

The report stores one form alone, the A-law payload as resampled PCM, and gets the
payload back from it: at a multiple of the rate every original sample stays in place,
and A-law gives each byte a sample of its own (mu-law has two zeros), so nothing is lost.

Null text counts as empty; an empty payload is 64 zero bytes. Each row is judged
alone: equal texts give equal values, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

RATE = 8000
PCM_RATE = 16000
BLOCK = 64
MU_LAW, A_LAW, ADPCM, PCM = 7, 6, 17, 1
# Step index moves by nibble, and step sizes by index (the standard's table: each
# about 1.1 times the one before).
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: sign, 3-bit exponent, 4-bit mantissa, all inverted, bias 132."""
    b = ~np.arange(256) & 0xFF
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted; the lowest exponent has no hidden bit."""
    b = np.arange(256) ^ 0x55
    exponent, mantissa = b >> 4 & 7, (b & 15) << 4
    size = np.where(exponent > 0, mantissa + 264 << np.maximum(exponent - 1, 0), mantissa + 8)
    return np.where(b & 128, size, -size).astype(np.int16)


def a_law_codes() -> np.ndarray:
    """The A-law byte of each 16-bit sample that A-law has, by the sample's unsigned value."""
    out = np.zeros(1 << 16, np.uint8)
    out[a_law_table().view(np.uint16)] = np.arange(256)
    return out


_A_LAW_CODES = a_law_codes()
_EXPANDED = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def wav(payload: bytes, kind: int = MU_LAW, rate: int = RATE, bits: int = 8) -> bytes:
    """A one-channel WAV container around raw samples."""
    width = bits // 8
    form = struct.pack("<HHIIHHH", kind, 1, rate, rate * width, width, bits, 0)
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(media: bytes) -> bytes:
    """The raw samples of a WAV container: its chunks are walked to the data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return b""


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (121 each) of ADPCM blocks of 64 bytes: one numpy step for each nibble, across all blocks."""
    if not len(blocks):
        return np.zeros((0, 2 * (BLOCK - 4) + 1), np.int16)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = blocks[:, 4:].T
    out = np.empty((2 * data.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k in range(data.shape[0]):
        for half, code in enumerate((data[k] & 15, data[k] >> 4)):
            code = code.astype(np.int32)
            step = STEPS[index]
            size = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
            value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
            index = np.clip(index + INDEX_MOVES[code], 0, len(STEPS) - 1)
            out[2 * k + half + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit PCM at another rate, by linear interpolation."""
    if rate == to or not len(pcm):
        return pcm
    n = len(pcm) * to // rate
    place = np.arange(n, dtype=np.int64) * rate
    left = place // to
    part = (place - left * to).astype(np.int32)
    right = np.minimum(left + 1, len(pcm) - 1)
    a, b = pcm[left].astype(np.int64), pcm[right].astype(np.int64)
    return (a + (b - a) * part // to).astype("<i2")


def payload_of(pcm: bytes, rate: int = PCM_RATE) -> bytes:
    """The A-law bytes behind a container of PCM at a multiple of RATE: every (rate / RATE)-th sample, compressed by table."""
    samples = np.frombuffer(samples_of(pcm), "<i2")[:: rate // RATE]
    return _A_LAW_CODES[samples.view(np.uint16)].tobytes()


def payload(text: str | None) -> bytes:
    """A text's bytes, zero-padded to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def pcm_container(raw: bytes, law: int, rate: int) -> bytes:
    """A container of 16-bit samples: telephony bytes expanded (or ADPCM-decoded) and resampled."""
    samples = np.frombuffer(raw, np.uint8)
    pcm = decode_adpcm(samples[: len(samples) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel() if law == ADPCM else _EXPANDED[law][samples]
    return wav(resample(pcm, RATE, rate).astype("<i2").tobytes(), PCM, rate, 16)


def with_media(docs: DataFrame, text: str = "text", law: int = MU_LAW) -> DataFrame:
    """doc_id, n_bytes and ``media``: the text's bytes, zero-padded to a multiple of 64, as 8-bit samples in a container."""

    def work(batches):
        for batch in batches:
            sizes, media = [], []
            for t in batch.column(1).to_pylist():
                sizes.append(len((t or "").encode("utf-8", "surrogatepass")))
                media.append(wav(payload(t), law))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return map_batches(docs.select("doc_id", text), work, "doc_id long, n_bytes long, media binary")


def with_pcm(media: DataFrame, law: int = MU_LAW, rate: int = PCM_RATE) -> DataFrame:
    """``media`` rows with ``pcm``: a container of 16-bit samples, expanded (or ADPCM-decoded) and resampled."""
    names = media.columns
    at = names.index("media")

    def work(batches):
        for batch in batches:
            out = [pcm_container(samples_of(m or b""), law, rate) for m in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "pcm"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return map_batches(media, work, f"{schema}, pcm binary", rows=200)


def features(payloads: list[bytes], stored: list[bytes]) -> list[str]:
    """Loudness and zero crossings of the three decodings, and checksums of the ADPCM and of the stored PCM samples."""
    mu, a = mu_law_table(), a_law_table()
    raw = [np.frombuffer(p, np.uint8) for p in payloads]
    joined = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
    adpcm = decode_adpcm(joined.reshape(-1, BLOCK))
    out, block = [], 0
    for r, pcm in zip(raw, stored, strict=True):
        n = len(r) // BLOCK
        own = np.ascontiguousarray(adpcm[block : block + n], "<i2")
        block += n
        m, x = mu[r], a[r]
        crossings = int(np.count_nonzero((m[1:] < 0) != (m[:-1] < 0)))
        out.append(
            f"mu={int(np.abs(m.astype(np.int64)).sum()) // len(r)};a={int(np.abs(x.astype(np.int64)).sum()) // len(r)};"
            f"zc={crossings};adpcm={zlib.crc32(own.tobytes()):08x};pcm={zlib.crc32(pcm):08x}"
        )
    return out


def media_report(docs: DataFrame) -> DataFrame:
    """Store every text's bytes as resampled PCM, read the stored containers back and report digests and features."""

    def store(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            media = [pcm_container(payload(t), A_LAW, PCM_RATE) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "pcm"])

    stored = staged(map_batches(docs.select("doc_id", "text"), store, "doc_id long, n_bytes long, pcm binary", rows=200), "media")

    def work(batches):
        for batch in batches:
            media = batch.column(2).to_pylist()
            payloads = [payload_of(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in payloads], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()),
                    pa.array([zlib.crc32(x[-BLOCK:]) for x in payloads], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                    pa.array(features(payloads, [samples_of(m) for m in media]), pa.string()),
                ],
                names=names,
            )

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    return map_batches(stored, work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), rows=200)


#: Everything but the features, for the text tables: what the container's bytes must be.
def brute_force(text: str | None) -> tuple:
    raw = (text or "").encode()
    payload = raw.ljust(max(64, (len(raw) + 63) // 64 * 64), b"\0")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def padded_bytes(text: str = "text"):
    """The payload's size as a column."""
    n = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    return F.greatest(F.lit(BLOCK), F.ceil(n / BLOCK) * BLOCK)
