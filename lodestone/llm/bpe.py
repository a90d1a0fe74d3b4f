"""Byte-level BPE over rank files, merging through a hierarchical-bitmap rank queue.

Each pre-token is a linked list of token ids. Every adjacent pair that may merge sits in the bucket of its rank (a heap of
list positions); two levels of bitmaps say which buckets hold anything, and find-first-set on them gives the least rank. A
position whose pair has changed since it was queued is stale and skipped when it comes up. A merge costs two link changes
and at most two new entries, so a pre-token of n bytes takes about n log n steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows

#: Pre-tokens kept per worker: so many young ones and as many old ones. The memory for them is bounded, some 150 MB.
CACHE_PIECES = 400_000
#: Longer pre-tokens are never cached.
CACHE_CHARS = 64
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """encode(text) gives ids as packed little-endian unsigned 32-bit integers, decode(packed) the bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.bytes_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.findall = regex.compile(pattern).findall
        self.pairs: dict[int, int] = {}
        ranks = self.ranks
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        encode_piece = self.encode_piece

        class Pieces(dict):
            """The young pieces. When they are many they take the place of the old ones, of which those that are met again become young."""

            old: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                packed = self.old.get(piece)
                if packed is None:
                    packed = array("I", encode_piece(piece.encode())).tobytes()
                if len(piece) <= CACHE_CHARS:
                    if len(self) >= CACHE_PIECES:
                        self.old = dict(self)
                        self.clear()
                    self[piece] = packed
                return packed

        self.pieces = Pieces()

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.merge([self.bytes_ids[b] for b in piece])

    def merge(self, ids: list[int]) -> list[int]:
        n, pair = len(ids), self.pairs.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # The rank with which a position is queued now (None: not queued); its other entries are stale.
        at = [pair(a << 20 | b) for a, b in zip(ids, ids[1:])]  # noqa: B905
        at.append(None)
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}  # rank >> 8 -> bitmap of the filled buckets
        top = 0  # bitmap of the filled entries of low
        for i, rank in enumerate(at):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    hi = rank >> 8
                    top |= 1 << hi
                    low[hi] = low.get(hi, 0) | 1 << (rank & 255)
        while top:
            hi = (top & -top).bit_length() - 1
            bits = low[hi]
            rank = hi << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[hi] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if at[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            ids[i] = rank
            at[j] = None
            if k < n:
                before[k] = i
                at[i] = new = pair(rank << 20 | ids[k])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        hi = new >> 8
                        top |= 1 << hi
                        low[hi] = low.get(hi, 0) | 1 << (new & 255)
            else:
                at[i] = None
            i = before[i]
            if i >= 0:
                at[i] = new = pair(ids[i] << 20 | rank)
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        hi = new >> 8
                        top |= 1 << hi
                        low[hi] = low.get(hi, 0) | 1 << (new & 255)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """The encoder of these files, made once in a worker."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Encoder(rank_file, pattern)
    return _loaded[key]


def _broadcast(df: DataFrame, rank_path: str):
    with open(rank_path, "rb") as f:  # a file of the driver, under 1 MB; executors get it by broadcast
        return df.sparkSession.sparkContext.broadcast(f.read())


def _joined(tokens: dict[int, bytes], ids) -> bytes | None:
    try:
        return b"".join(map(tokens.__getitem__, ids))
    except KeyError:
        return None


def _with_key(df: DataFrame, key: str, value: str, make, made: str, kind: pa.DataType) -> DataFrame:
    """key and what make() makes of value. Keys pass through Python as they are."""
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{value}`").alias(value))
    arrow = to_arrow_schema(rows.select("k").schema).field("k").type
    done = map_rows(rows, ["k", value], make, f"k {rows.schema['k'].dataType.simpleString()}, {made}", pa.schema([("k", arrow), (made.split()[0], kind)]))
    return done.withColumnRenamed("k", key)


def encode(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of every whole text (null: none). key may be of any type; repeated and null keys each give a row."""
    ranks = _broadcast(df, rank_path)

    def make():
        enc = encoder(ranks.value, pattern)

        def work(keys, texts):
            ids = []
            for t in texts.to_pylist():
                a = array("I")
                a.frombytes(enc.encode(t or ""))
                ids.append(a.tolist())
            return {"k": keys, "ids": ids}

        return work

    return _with_key(df, key, text, make, "ids array<int>", pa.list_(pa.int32()))


def decode(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, data binary: the bytes that ids stand for; null where an id is unknown or null, no bytes where ids is null."""
    ranks = _broadcast(df, rank_path)

    def make():
        enc = encoder(ranks.value, pattern)

        def work(keys, ids):
            return {"k": keys, "data": [_joined(enc.tokens, x or ()) for x in ids.to_pylist()]}

        return work

    return _with_key(df, key, "ids", make, "data binary", pa.binary())


def round_trip(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text (null: empty) encoded, and its ids decoded again.

    Empty texts have 0 tokens and the digests of no bytes. Rows with equal doc_id, or none, each give a row; other columns are not read."""
    ranks = _broadcast(df, rank_path)

    def make():
        enc = encoder(ranks.value, pattern)
        sha = hashlib.sha256

        def work(keys, texts):
            n, ids, decoded = [], [], []
            for t in texts.to_pylist():
                packed = enc.encode(t or "")
                n.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                decoded.append(sha(enc.decode(packed)).hexdigest())
            return {"doc_id": keys, "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return work

    return map_rows(df, ["doc_id", "text"], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))
