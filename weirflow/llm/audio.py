"""Media columns: telephony audio to resampled PCM.

Codecs: 'mulaw' and 'alaw' (G.711), one byte a sample, expanded by lookup
tables; 'ima_adpcm', blocks of BLOCK bytes, each a header of 4 bytes (first
sample, step index) and two 4-bit samples a byte, low one first. The nibbles of a
block depend on each other, blocks don't: one step of numpy decodes the next
nibble of all blocks of all rows of a batch.

The samples are resampled from RATE_IN to RATE_OUT by a windowed-sinc polyphase
filter, rounded and clipped to 16 bits, and stored little-endian.

Defined results: a null payload or codec, or an unknown codec, gives null pcm and
null n_samples; an empty payload gives empty pcm; a last block shorter than its
header is dropped, one shorter than BLOCK gives the samples it has; a step index
beyond 88 counts as 88; repeated rows give repeated results; a payload of any
length is decoded whole; an empty table gives no rows. Key columns are passed
through, nulls included; one that is named like a column of the result comes as
``key_`` and its name. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.textkit import slices

BLOCK = 256
RATE_IN, RATE_OUT = 8000, 16000
REACH = 16  # input samples on either side that a resampled one is made of


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    t = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -t, t).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, t = (a & 0x70) >> 4, (a & 0x0F) << 4
    t = np.where(seg == 0, t + 8, (t + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def adpcm(payloads: list[bytes], block: int = BLOCK) -> list[np.ndarray]:
    """Samples of each payload; all blocks of all payloads are decoded side by side."""
    per = [-(-len(p) // block) - (0 < len(p) % block < 4) for p in payloads]
    n = sum(per)
    data = np.zeros((n, block), np.uint8)
    held = np.zeros(n, np.int64)
    at = 0
    for p, k in zip(payloads, per):
        flat = np.frombuffer(p, np.uint8)[: k * block]
        data[at : at + k].ravel()[: len(flat)] = flat
        held[at : at + k] = np.clip(len(p) - np.arange(k) * block, 0, block)
        at += k
    out = np.zeros((n, 1 + 2 * (block - 4)), np.int16)
    value = data[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(data[:, 2], 88).astype(np.int64)
    out[:, 0] = value
    for k in range(2 * (block - 4)):
        code = (data[:, 4 + k // 2] >> (4 * (k & 1))).astype(np.int64) & 15
        step = STEPS[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[:, k + 1] = value
    length = 1 + 2 * (held - 4)
    result, at = [], 0
    for k in per:
        rows = out[at : at + k]
        result.append(rows[np.arange(rows.shape[1]) < length[at : at + k, None]])
        at += k
    return result


def _taps(up: int, down: int) -> np.ndarray:
    """(phase, tap): weights of the 2 REACH input samples around an output sample of that phase."""
    cutoff = min(1.0, up / down)
    reach = REACH
    x = np.arange(-reach + 1, reach + 1)[None] - np.arange(up)[:, None] / up
    w = cutoff * np.sinc(cutoff * x) * np.cos(np.pi * x / (2 * (reach + 1))) ** 2
    return w / w.sum(1, keepdims=True)


def resampled(signals: list[np.ndarray], rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> list[np.ndarray]:
    """Each signal at the other rate. All lie in one array, silence between them, so a step of the filter is one step for all."""
    g = int(np.gcd(rate_in, rate_out))
    up, down = rate_out // g, rate_in // g
    taps = _taps(up, down)
    size = np.array([len(x) for x in signals], np.int64)
    begin = np.cumsum(size + 2 * REACH) - size - REACH  # of each signal in the array
    padded = np.zeros(int((size + 2 * REACH).sum()) + 2 * REACH + 1)
    for x, a in zip(signals, begin.tolist()):
        padded[a : a + len(x)] = x
    n = -(-size * up // down)
    ends = np.cumsum(n)
    if down == 1:
        # the outputs of a phase are one sliding product with its taps
        out = np.stack([np.convolve(padded, w[::-1], "valid") for w in taps], 1).ravel()
        return [_pcm(out[(a - REACH + 1) * up :][:k]) for a, k in zip(begin.tolist(), n.tolist())]
    j = np.arange(int(n.sum())) - np.repeat(ends - n, n)
    phase, base = j * down % up, j * down // up - REACH + 1 + np.repeat(begin, n)
    acc = np.zeros(len(j))
    for k in range(2 * REACH):
        acc += taps[phase, k] * padded[base + k]
    return [_pcm(acc[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]


def _pcm(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), -32768, 32767).astype("<i2")


def resample(x: np.ndarray, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> np.ndarray:
    return resampled([x], rate_in, rate_out)[0]


def out_names(keys: list[str]) -> list[str]:
    """Names of the key columns in the result."""
    out = []
    for k in keys:
        while k in (*RESULT, *out):
            k = f"key_{k}"
        out.append(k)
    return out


RESULT = ("codec", "sample_rate", "n_samples", "pcm")


def decode(df: DataFrame, keys: list[str], codec: Column, payload: Column, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> DataFrame:
    """keys, codec, sample_rate, n_samples, pcm of every row."""
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    given = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], codec.cast("string").alias("codec"), payload.cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload"):
            kind, data = b.column("codec").to_pylist(), b.column("payload").to_pylist()
            pcm: list[np.ndarray | None] = [None] * b.num_rows
            blocks = [r for r in range(b.num_rows) if kind[r] == "ima_adpcm" and data[r] is not None]
            for r, s in zip(blocks, adpcm([data[r] for r in blocks])):
                pcm[r] = s
            for r, (c, d) in enumerate(zip(kind, data)):
                if d is not None and c in ("mulaw", "alaw"):
                    pcm[r] = (MULAW if c == "mulaw" else ALAW)[np.frombuffer(d, np.uint8)]
            known = [r for r, s in enumerate(pcm) if s is not None]
            done: list[np.ndarray | None] = [None] * b.num_rows
            for r, s in zip(known, resampled([pcm[r] for r in known], rate_in, rate_out)):
                done[r] = s
            yield pa.record_batch(
                [*(b.column(n) for n in names), b.column("codec"), pa.array(np.full(b.num_rows, rate_out, np.int32)), pa.array([None if s is None else len(s) for s in done], pa.int64()), pa.array([None if s is None else s.tobytes() for s in done], pa.binary())],
                [*names, "codec", "sample_rate", "n_samples", "pcm"],
            )

    out = given.mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys)) + ", codec string, sample_rate int, n_samples long, pcm binary")
    return out.toDF(*out_names(keys), *RESULT)
