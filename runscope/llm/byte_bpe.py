"""Byte-level BPE through a sentencepiece model written directly from a rank file (operator 10).

Each vocabulary entry becomes a piece whose characters stand for its bytes, with minus its rank as score, so that the
BPE of sentencepiece (best score first, leftmost first) takes the same merges as the ranks. The normalisation is the
identity. Pre-tokens are encoded one by one; ids are decoded by the inverse byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import map_batches, texts, worker_memo
from runscope.llm.pieces import PieceEncoder

#: Byte b stands as the character BYTE_BASE + b: letters, none of them white space.
BYTE_BASE = 0x100
#: Words remembered in a task, and characters of texts cut into words at once: less than a worker that does nothing
#: else could hold, because in the pipeline the executor's heap already holds what the stages before left behind.
MEMO_ENTRIES, GROUP_CHARS = 60_000, 1 << 20
_TO_CHAR = {b: BYTE_BASE + b for b in range(256)}


def load_ranks(data: bytes) -> list[bytes]:
    """The vocabulary of a .tiktoken file: the bytes of each id, ids from 0 without gaps."""
    ranks = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHAR)


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """The serialised model. The field and enum numbers are those of sentencepiece_model.proto (fixed values)."""
    normal, unknown, bpe, none = 1, 2, 2, -1
    pieces = [_chunk(1, to_chars(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
              + _number(3, normal) for rank, t in enumerate(vocabulary)]
    pieces.append(_chunk(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(vocabulary)) \
        + _number(41, none) + _number(42, none) + _number(43, none)
    normalizer = _chunk(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_chunk(1, p) for p in pieces) + _chunk(2, trainer) + _chunk(3, normalizer)


class ByteBpe:
    """Encode texts and decode ids as the rank file says."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = load_ranks(rank_file)
        self._ids = {t: i for i, t in enumerate(self.vocabulary)}
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.vocabulary))
        self._split = regex.compile(pattern).findall
        self._pieces = PieceEncoder(self._whole, self._spaced, MEMO_ENTRIES, GROUP_CHARS)

    def _ids_of(self, pre_tokens: list[str]) -> list:
        """Ids of each pre-token; a pre-token that is an entry of the vocabulary is that entry."""
        data = [p.encode("utf-8", "surrogatepass") for p in pre_tokens]
        known = self._ids
        todo = list({d for d in data if d not in known})
        ids = dict(zip(todo, self._sp.encode([to_chars(d) for d in todo], num_threads=1) if todo else []))
        return [(known[d],) if d in known else ids[d] for d in data]

    def _whole(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, little-endian, 4 bytes each."""
        out = []
        for part in parts:
            ids = self._ids_of(self._split(part)) if part else ()
            out.append(array("I", chain.from_iterable(ids)).tobytes())
        return out

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Words after a space, pre-tokens of all of them in one go: each word starts at the one that has a space."""
        pre_tokens = self._split(" " + " ".join(words))
        ids = self._ids_of(pre_tokens)
        at = [i for i, p in enumerate(pre_tokens) if p[0] == " "]
        if len(at) != len(words):
            raise ValueError("the pattern does not keep a space with the word after it")
        return [array("I", chain.from_iterable(ids[a:b])).tobytes() for a, b in zip(at, [*at[1:], len(ids)])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self._pieces(texts)]

    def forget(self) -> None:
        """Give the memo's memory back, for other work of the worker."""
        self._pieces.forget()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.asarray(ids).tolist()))


def _model(rank_file: bytes, pattern: str) -> ByteBpe:
    """The worker's model of a rank file."""
    key = "byte bpe " + hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    return worker_memo(key, lambda: ByteBpe(rank_file, pattern))


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
                  ("ids_sha256", pa.string()), ("decoded", pa.binary()), ("decoded_sha256", pa.string())])


def _encode_decode(rank_file: bytes, pattern: str, wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(rank_file, pattern)
        for batch in batches:
            out = {name: [] for name in wanted}
            for ids in model.encode_all(texts(batch)):
                data = model.decode(ids)
                for name, value in (("ids", ids), ("n_tokens", len(ids)),
                                    ("ids_sha256", hashlib.sha256(ids).hexdigest()), ("decoded", data),
                                    ("decoded_sha256", hashlib.sha256(data).hexdigest())):
                    if name in out:
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(out[n], _OUT.field(n).type) for n in wanted],
                names=["doc_id", *wanted])
        model.forget()
    return run


def encode_decode(docs: DataFrame, rank_file: bytes, pattern: str,
                  columns: tuple[str, ...] = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """One row per document row: doc_id and the wanted ``columns``.

    ids (array of int), n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded (the
    bytes that the ids stand for), decoded_sha256. Null and empty texts have no ids. Columns other than doc_id and
    text are not read; null ids and repeated rows stay as they are. No shuffle: each batch is done on its own.
    """
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary",
             "decoded_sha256": "string"}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _encode_decode(rank_file, pattern, tuple(columns)),
                       "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
