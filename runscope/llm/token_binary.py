"""Token ids of whole texts in one concatenated array, document boundaries as Elias-Fano codes (operator 9).

File format: a Parquet table, one row per block of consecutive documents. ``ids`` is the plain little-endian id array
of the block (2 bytes an id where the vocabulary allows, else 4), ``ends`` the Elias-Fano code of the documents' end
offsets in it, ``doc_ids`` the documents in order. ``part`` (ascending with doc_id), ``block`` and ``start`` (ids of
the part before the block) give the place of each block in the array of all ids.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import map_batches, scratch_path, texts, worker_memo
from runscope.llm.elias_fano import EliasFano
from runscope.llm.pieces import PieceEncoder

#: A block is closed when it holds this many ids (a longer document is a block of its own).
BLOCK_IDS = 1 << 19

#: Words that are encoded as one text: this library takes more time a word for longer texts.
AT_ONCE = 128
#: Characters of the text by which rows of one doc_id are ordered before its hash.
HEAD_CHARS = 64

BLOCK_SCHEMA = ("part int, block int, start long, n_docs int, n_ids long, width int, ids binary, ends binary, "
                "doc_ids array<long>")
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()),
                    ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

def _encoder(tokenizer: bytes) -> tuple[PieceEncoder, int]:
    """The encoder for a tokenizers file, and the bytes of an id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer.decode())
    tok.no_truncation()
    tok.no_padding()
    width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    kind = f"<u{width}"

    # Words after a space are encoded as one text: the token that starts a word is the one that holds its space.
    space = "\u0120"  # how the byte alphabet of these files writes a space
    starts = np.zeros(tok.get_vocab_size(with_added_tokens=True) + 1, bool)
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        starts[i] = token.startswith(space)

    def whole(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=kind).tobytes() for e in tok.encode_batch_fast(parts, add_special_tokens=False)]

    def spaced(words: list[str]) -> list[bytes]:
        ids = np.array(tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids)
        at = (np.flatnonzero(starts[ids]) * width).tolist()
        data = ids.astype(kind).tobytes()
        if len(at) != len(words):
            raise ValueError("this vocabulary does not start words with their space")
        return [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]

    return PieceEncoder(whole, spaced, at_once=AT_ONCE), width


def _blocks(tokenizer: bytes, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = "ids " + hashlib.sha256(tokenizer).hexdigest()
        encode, width = worker_memo(key, lambda: _encoder(tokenizer))
        end = end_id.to_bytes(width, "little")
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, ends = bytearray(), [], []

        def close():
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "start": start, "n_docs": len(doc_ids), "n_ids": len(ids) // width,
                "width": width, "ids": bytes(ids), "ends": EliasFano.encode(ends).to_bytes(),
                "doc_ids": doc_ids}], schema=_ARROW)

        for batch in batches:
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), encode(texts(batch))):
                ids += encoded
                ids += end
                doc_ids.append(doc_id)
                ends.append(len(ids) // width)
                if ends[-1] >= BLOCK_IDS:
                    yield close()
                    start, block = start + ends[-1], block + 1
                    ids, doc_ids, ends = bytearray(), [], []
        if doc_ids:
            yield close()
    return run


def write_token_blocks(docs: DataFrame, tokenizer: bytes, path: str, end_id: int = 2) -> None:
    """Encode (doc_id, text) rows, append ``end_id`` to each, and write the blocks in ascending doc_id order.

    The rows are dealt out by ranges of doc_id, first characters and hash of the text, and sorted inside a range
    (which spills, never gathers), so that an id that very many rows share is spread over several tasks; null ids come
    first, rows of one id are in that order, too. Null texts count as empty: they hold the end id alone.
    ``tokenizer`` is the content of a tokenizers .json file, a few MB at most, sent with the tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ``row`` parts equal rows; their order changes nothing.
    rows = rows.withColumns({"head": F.left("text", F.lit(HEAD_CHARS)), "th": F.xxhash64("text"),
                             "row": F.monotonically_increasing_id()})
    order = ["doc_id", "head", "th", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    map_batches(rows.select("doc_id", "text"), _blocks(tokenizer, end_id), BLOCK_SCHEMA).write.parquet(path)


def read_token_blocks(spark, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The block table, and for each part the number of ids in all parts before it.

    The totals of the parts (one row for each range of the writing job) are summed up on the driver.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    base, before = {}, 0
    for part, total in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        base[part] = before
        before += total
    return blocks, base


def spans(code: EliasFano, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in a block's ids at which these of its documents (ascending) start and end, by select on the block."""
    asked = np.union1d(places, np.maximum(places - 1, 0))  # neighbours share a boundary: it is selected once
    found = code.at(asked)
    starts = np.where(places > 0, found[np.searchsorted(asked, np.maximum(places - 1, 0))], 0)
    return starts, found[np.searchsorted(asked, places)]


def _wanted(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                places = np.flatnonzero(np.isin(np.array(b["doc_ids"], dtype=object), wanted))
                ids, at = np.frombuffer(b["ids"], f"<u{b['width']}"), places.tolist()
                lists = [ids[s:e].tolist() for s, e in zip(*spans(EliasFano.from_bytes(b["ends"]), places))]
                yield pa.RecordBatch.from_arrays([pa.array([b["doc_ids"][i] for i in at], pa.int64()),
                                                  pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])
    return run


def look_up(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents, by select on the blocks that hold them; nothing else is decoded."""
    held = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in doc_ids])))
    return map_batches(held, _wanted(list(doc_ids)), "doc_id long, ids array<long>")


def _documents(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                code = EliasFano.from_bytes(b["ends"])
                starts, ends = spans(code, np.arange(code.n))
                ids = np.frombuffer(b["ids"], f"<u{b['width']}")
                crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(b["doc_ids"], pa.int64()), pa.array(starts + (base[b["part"]] + b["start"])),
                    pa.array(ends - starts), pa.array(crc, pa.int64())], schema=_OUT)
    return run


def token_documents(docs: DataFrame, tokenizer: bytes, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files below ``path`` (or the shared folder), read them back, one row per document row.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (crc32 of the ids as
    little-endian unsigned 32-bit integers). Columns other than doc_id and text are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-blocks")
    write_token_blocks(docs, tokenizer, path, end_id)
    blocks, base = read_token_blocks(spark, path)
    return map_batches(blocks, _documents(base), "doc_id long, start long, n_tokens long, ids_crc32 long")
