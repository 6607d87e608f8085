"""Byte-level BPE encoding and decoding (operator 5).

A piece of text (word, number, run of signs or of white space) is encoded with
one contiguous array of part boundaries and one of the ranks of adjacent pairs:
the least rank is searched by a scan, its right boundary deleted, and the ranks
of the two neighbouring pairs refreshed.  That is quadratic, so pieces over
``SHORT`` bytes keep the pairs in a heap; the merges and ids are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import record_batch, table, text_chunks

SHORT = 128
#: Pieces that a process keeps with their ids, in two halves: a full half becomes the old one, from which what is used again returns.
CACHE = 400_000
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule: itself where it prints, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE without normaliser or prefix space)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model["dropout"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        of = byte_chars()
        raw = lambda token: bytes(of[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {raw(a) + raw(b): i for i, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.find = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache = _Cache(self)

    def parts(self, word: bytes) -> list[bytes]:
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[bytes]:
        get, none = self.ranks.get, len(self.ranks)
        bounds = list(range(len(word) + 1))
        ranks = [get(word[i : i + 2], none) for i in range(len(word) - 1)]  # of the parts at i and i + 1
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
            if i < len(ranks):
                ranks[i] = get(word[bounds[i] : bounds[i + 2]], none)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, word: bytes) -> list[bytes]:
        get, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # next and previous part; at n it ends
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != stop:
                continue  # one of the parts has grown since
            alive[j] = False
            after[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : after[stop]])) is not None:
                    heapq.heappush(heap, (r, i, after[stop]))
            if (k := before[i]) >= 0 and (r := get(word[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : after[i]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        cache = self.cache
        if 2 * len(cache) > CACHE:
            cache.turn()
        if self.split is None or not any(a in text for a in self.added):
            return b"".join(map(cache.__getitem__, self.find(text)))
        parts = self.split.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else b"".join(map(cache.__getitem__, self.find(p))) for p in parts)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; what is not valid UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


class _Cache(dict):
    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.old = bpe, {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        if (known := self.old.get(piece)) is not None:
            self[piece] = known
            return known
        of = self.bpe.ids
        out = np.array([of[p] for p in self.bpe.parts(piece.encode())], "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder for each vocabulary and Python process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids (an array of int) and the text decoded from them, for each row of ``docs``.

    A null text is an empty one: no tokens, empty decoded text.  Repeated rows
    are encoded row by row, a null id stays null, and an empty table gives no rows;
    other columns are not read.  A task holds the ids of about a megabyte of texts, or of one
    longer text.  The vocabulary is read
    from ``path`` on the executors, where the same package is installed.
    """
    return _mapped(docs, path, id_col, text_col, digest=False)


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`bpe_round_trip`, but the number of ids and SHA-256 of ids and decoded text, made where the ids are."""
    return _mapped(docs, path, id_col, text_col, digest=True)


def _mapped(docs: DataFrame, path: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64())] + ([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch, texts in text_chunks(batches):
            ids = [bpe.encode(t.decode()) for t in texts]
            decoded = [bpe.decode(x) for x in ids]
            if digest:
                columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded]]
            else:
                columns = [[np.frombuffer(x, "<i4") for x in ids], [x.decode() for x in decoded]]
            yield record_batch(schema, batch.column(0).cast(pa.int64()), *columns)

    names = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, names)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded texts of all ``documents``; nulls and odd rows as in :func:`bpe_round_trip`."""
    return bpe_digests(table(spark, sf_dir, "documents"))
