"""Token ids as raw binary shards with a minimal perfect hash index.

Payload: each input partition writes one shard, the 16-bit ids of its documents
one after another, under a name made of the partition's number; a file is
written aside and moved into place, so a task that runs again, after the loss of
an executor, replaces it by the same bytes.

Index: keys are dealt by hash into buckets of about KEYS. Each bucket has a
minimal perfect hash in levels (Limasset et al., 2017): at each level a key that
hits a place alone sets its bit, the others go on to the next; a key's slot is
the number of bits before its own. A slot holds a 32-bit fingerprint of the key,
the shard, the offset and the length, so looking up a key reads a few words and
one stretch of a shard, whatever the size of the corpus, and a foreign key is
refused by its fingerprint (but for one in 2^32).

Defined results: rows with null id aren't stored; a null or empty text is a
document of no ids; a text of more than LONG characters is encoded in stretches,
cut where a word ends, which gives the same ids, and only inside a run of LONG
characters without an end of a word anywhere; of an id given more than once,
with one text or several, the text in the least (shard, offset) is kept; an empty
table writes no shard and no bucket; other columns, whatever their names, are
ignored. A vocabulary with ids over 65535 is an error.
"""

from __future__ import annotations

import base64
import io
import math
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.labelled import keyed
from weirflow.llm.textkit import mix
from weirflow.session import shared_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = 1 << 16
GAMMA = 2
LEVELS = 48
STRETCH, LONG = 1 << 15, 1 << 17
#: No token of PATTERN goes on from a sign to a blank.
_END = re.compile(r"\S(?=[ \n])")

_SLOT = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) > 0xFFFF:
        raise ValueError("ids of this vocabulary don't fit into 16 bits")
    return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONG:
        end = _END.search(text, at + STRETCH, at + LONG)
        to = end.end() if end else at + LONG
        yield text[at:to]
        at = to
    yield text[at:]


def encoded(enc, text: str) -> np.ndarray:
    return np.concatenate([enc.encode_to_numpy(t, disallowed_special=()) for t in stretches(text)]).astype("<u2")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def put(uri: str, parts: Iterator[bytes]) -> None:
    """Writes the file aside and moves it into place."""
    system, path = place(uri)
    aside = f"{path}.{uuid.uuid4().hex}"
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(aside) as f:
        for p in parts:
            f.write(p)
    system.move(aside, path)


def shard_name(out: str, k: int) -> str:
    return f"{out}/shard-{k:08d}.bin"


def bucket_name(out: str, k: int) -> str:
    return f"{out}/index-{k:08d}.mph"


# --- minimal perfect hash --------------------------------------------------


def spread(key: np.ndarray, salt: int) -> np.ndarray:
    return mix(key.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1)))


class PerfectHash:
    """Bits of all levels in one array, with the number of bits before each 64-bit word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        sizes, bits, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys aren't distinct")
            m = 64 * math.ceil(GAMMA * len(left) / 64)
            at = (spread(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), packed)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that aren't in it, any slot for others."""
        out = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for level, m in enumerate(self.sizes.tolist()):
            at = self.begin[level] + (spread(keys[todo], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.rank[at[hit] >> 6] + below
            todo = todo[~hit]
        return out

    def parts(self) -> list[bytes]:
        return [struct.pack("<qq", len(self.sizes), len(self.words)), self.sizes.astype("<i8").tobytes(), self.words.tobytes()]


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (spread(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (spread(keys, 2000) % np.uint64(buckets)).astype(np.int64)


# --- writing ---------------------------------------------------------------


def payload(docs: DataFrame, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the shards: (doc_id, shard, offset, n_tokens), offsets in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        system, path = place(shard_name(out, shard))
        aside, f, at = f"{path}.{uuid.uuid4().hex}", None, 0
        for b in batches:
            n = []
            for t in b.column("text"):
                ids = encoded(enc, t.as_py() or "")
                if f is None:
                    system.create_dir(os.path.dirname(path), recursive=True)
                    f = system.open_output_stream(aside)
                f.write(ids.tobytes())
                n.append(len(ids))
            size = np.array(n, np.int64)
            off = at + np.cumsum(size) - size
            at += int(size.sum())
            yield pa.record_batch([b.column("doc_id"), pa.array(np.full(len(n), shard)), pa.array(off), pa.array(size)], ["doc_id", "shard", "offset", "n_tokens"])
        if f is not None:
            f.close()
            system.move(aside, path)

    return keyed(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, shard long, offset long, n_tokens long")


def write(docs: DataFrame, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes shards and index to the folder ``out``, which all executors share:
    (doc_id, bucket, slot, fingerprint, shard, offset, n_tokens) of every key."""
    rows = written(payload(docs, out, vocabulary))
    buckets = max(1, math.ceil(rows.count() / KEYS))
    put(f"{out}/buckets", iter([struct.pack("<q", buckets)]))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("bucket", pa.array(bucket_of(b.column("doc_id").to_numpy(), buckets)))

    def run(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        ids, shard, off, n = (t.column(c).to_numpy() for c in ("doc_id", "shard", "offset", "n_tokens"))
        o = np.lexsort((off, shard, ids))
        o = o[np.concatenate([[True], np.diff(ids[o]) != 0])]
        ids, shard, off, n = ids[o], shard[o], off[o], n[o]
        mph = PerfectHash.build(ids)
        slot, fp = mph.slots(ids), fingerprint(ids)
        table = np.zeros(len(ids), _SLOT)
        table["fp"][slot], table["shard"][slot], table["offset"][slot], table["n"][slot] = fp, shard, off, n
        put(bucket_name(out, k), iter([*mph.parts(), table.tobytes()]))
        return pa.table({"doc_id": ids, "bucket": np.full(len(ids), k), "slot": slot, "fingerprint": fp.astype(np.int64), "shard": shard, "offset": off, "n_tokens": n})

    full = rows.mapInArrow(dealt, "doc_id long, shard long, offset long, n_tokens long, bucket long")
    return full.groupBy("bucket").applyInArrow(run, "doc_id long, bucket long, slot long, fingerprint long, shard long, offset long, n_tokens long")


class Reader:
    """Keyed access to what ``write`` left in a folder."""

    def __init__(self, out: str):
        self.out = out
        system, path = place(f"{out}/buckets")
        self.buckets = struct.unpack("<q", system.open_input_stream(path).read())[0]
        self.held: dict[int, tuple[PerfectHash, np.ndarray] | None] = {}

    def bucket(self, k: int) -> tuple[PerfectHash, np.ndarray] | None:
        if k not in self.held:
            system, path = place(bucket_name(self.out, k))
            if system.get_file_info(path).type == fs.FileType.NotFound:
                self.held[k] = None
            else:
                f = io.BytesIO(system.open_input_stream(path).read())
                levels, words = struct.unpack("<qq", f.read(16))
                mph = PerfectHash(np.frombuffer(f.read(8 * levels), "<i8"), np.frombuffer(f.read(8 * words), "<u8"))
                self.held[k] = mph, np.frombuffer(f.read(), _SLOT)
        return self.held[k]

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, or None where the key isn't known."""
        k = np.array([key], np.int64)
        at = self.bucket(int(bucket_of(k, self.buckets)[0]))
        if at is None:
            return None
        mph, table = at
        slot = int(mph.slots(k)[0])
        if slot < 0 or table[slot]["fp"] != fingerprint(k)[0]:
            return None
        row = table[slot]
        system, path = place(shard_name(self.out, int(row["shard"])))
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read_at(2 * int(row["n"]), 2 * int(row["offset"])), "<u2")


def index(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return write(docs, f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}", vocabulary)
