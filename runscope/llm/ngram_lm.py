"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark (operator 6).

Tokens are words (A-Z lower-cased, cut at ASCII white space) and one end token a document; a document's first token
follows a begin mark. The model is made by a few jobs, each of which counts what a chunk of documents holds before
anything is shuffled, so that a frequent word or pair costs one entry a chunk. Of order 2:

1. token counts, in shards by ranges of the token's 64-bit hash: sorted hash arrays, whose order gives each token a
   number (its rank);
2. pair counts, in shards by context: sorted arrays of 64-bit keys (rank of the context, rank of the word), and for
   each context its count and the numbers of words that follow it once, twice and more often. The pairs of frequent
   contexts are spread over all shards by both ranks;
3. for each token the number of different contexts before it.

Of order 3, job 2 counts trigrams instead, in shards by their middle word: such a shard holds all that a pair of words
is a context of, and the numbers of different words before the pairs that begin with the middle word, which are the
counts of order 2. Trigrams with a frequent middle word are spread over all shards; one more job adds up their pairs.

The shards are files of arrays below the shared folder; scoring tasks map them into memory and look up the distinct
tokens and pairs of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import cut, map_batches, scratch_path, worker_memo
from runscope.llm.shards import map_arrays, write_arrays

#: Tokens that are counted together in a task before they are sent on.
CHUNK_TOKENS = 1_500_000
#: Tokens that are scored together: fewer, as a trigram's look-ups hold more arrays at once than its counting.
SCORE_TOKENS = 600_000
#: Bytes of text that are hashed at once.
HASH_BYTES = 2 << 20
#: Bytes of learned text for each shard: what one task merges.
SHARD_BYTES = 16 << 20
#: A pair that fewer different words follow has no stored sums: they are made from its counts.
WIDE = 8

_M32 = np.uint64(32)
#: Ranks that stand for no token of the vocabulary.
UNKNOWN, BEGIN = 0xFFFFFFFF, 0xFFFFFFFE


def mixed(v: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    v = v.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The end token: not the hash of any run of bytes that a word can be (its length part is no length).
END = int(mixed(np.array([0xE0F << 40], np.uint64))[0])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    tables = worker_memo("powers", dict)
    if tables.get("n", 0) < n:
        n = max(n, 2 * HASH_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            tables[name] = np.cumprod(p, dtype=np.uint64)
        tables["n"] = n
    return tables["up"], tables["down"]


def hashed_tokens(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the documents, an END after each; and the number of tokens of each, END included."""
    data = b"\n".join(docs).lower() + b"\n"
    chars = np.frombuffer(data, np.uint8)
    space = _SPACE[chars]
    word = ~space
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(space & ~before)
    if len(start):
        up, down = _power_tables(len(chars))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[chars] * up[:len(chars)], dtype=np.uint64)])
        h = mixed((sums[end] - sums[start]) * down[start] ^ ((end - start).astype(np.uint64) << np.uint64(44)))
    else:
        h = np.zeros(0, np.uint64)
    first = np.cumsum([0] + [len(d) + 1 for d in docs[:-1]])
    words = np.diff(np.concatenate([np.searchsorted(start, first), [len(start)]]))
    n = words + 1
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = END
    out[keep] = h
    return out, n


def _chunks(batches: Iterator[pa.RecordBatch],
            most: int | None = None) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray]]:
    """(row values, token hashes, tokens of each row) of about CHUNK_TOKENS (or ``most``) tokens at a time; rows stay
    whole."""
    most = most or CHUNK_TOKENS
    rows, hashes, counts, total = [], [], [], 0
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(n).to_pylist() for n in names]
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= HASH_BYTES):
                size += len(texts[to])
                to += 1
            h, n = hashed_tokens(texts[at:to])
            hashes.append(h)
            counts.append(n)
            rows += list(zip(*(c[at:to] for c in columns)))
            total += len(h)
            at = to
            if total >= most:
                yield rows, np.concatenate(hashes), np.concatenate(counts)
                rows, hashes, counts, total = [], [], [], 0
    if hashes:  # not ``rows``: training reads no column besides the text
        yield rows, np.concatenate(hashes), np.concatenate(counts)


def _small_counts(c: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold all of them, the width first."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(c.max(initial=0)) < 1 << (8 * int(k[2])))
    return kind.encode() + c.astype(kind).tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(np.int64)


_PART = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_PART_DDL = "shard int, keys binary, counts binary"


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts, one row for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
    rows = [(int(shard[a]), keys[a:b].tobytes(), _small_counts(counts[a:b]))
            for a, b in zip(at, [*at[1:], len(shard)])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _PART.field(i).type) for i in range(3)],
                                         schema=_PART)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys of all rows of a shard, and the sums of their counts."""
    keys = np.concatenate([np.frombuffer(k.as_buffer(), "<u8") for k in table.column("keys")])
    counts = np.concatenate([_counts(c.as_py()) for c in table.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _by_range(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash: ranges of equal width, so that shards follow the order of the hashes."""
    return ((h >> _M32) * np.uint64(shards) >> _M32).astype(np.int32)


@dataclass
class Model:
    """What a scoring task needs besides the shard files: some numbers for each shard, none for each token."""

    folder: str
    shards: int
    tokens: int = 0
    vocabulary: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # rank of each shard's first token
    sizes: set = field(default_factory=set)  # names of the files that exist
    hot: dict[int, tuple] = field(default_factory=dict)  # frequent contexts: count, words once, twice, more
    pairs: int = 0
    discounts: tuple = (0.0, 0.0, 0.0)
    low_discounts: tuple = (0.0, 0.0, 0.0)
    low_of: tuple = (0, 0, 0)  # tokens with one, two, more contexts
    order: int = 2
    top_discounts: tuple = (0.0, 0.0, 0.0)  # of order 3

    def file(self, name: str) -> dict[str, np.ndarray] | None:
        return map_arrays(f"{self.folder}/{name}") if name in self.sizes else None

    def ranks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (UNKNOWN: none) and training counts of sorted distinct hashes."""
        rank, count = np.full(len(h), UNKNOWN, np.int64), np.zeros(len(h), np.int64)
        shard = _by_range(h, self.shards)
        for s, a, b in _runs(shard):
            f = self.file(f"token-{s}")
            if f is not None:
                at, ok = _found(f["keys"], h[a:b])
                rank[a:b] = np.where(ok, at + self.first[s], UNKNOWN)
                count[a:b] = np.where(ok, f["counts"][at], 0)
        return rank, count

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        return np.isin(v, np.array(sorted(self.hot), np.int64))

    def pair_shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Shard of a pair: by its context, by both ranks where that is frequent (of order 3, in files of their own)."""
        hot = self.is_hot(v)
        key = np.where(hot, mixed((v.astype(np.uint64) << _M32) | w.astype(np.uint64)), mixed(v))
        return _by_range(key, self.shards) + np.where(hot & (self.order > 2), self.shards, 0).astype(np.int32)

    def context_shard(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of a pair (second word, first word) as a context, and whether its trigrams are spread by their last
        word too: those of two frequent words are."""
        v, u = (context >> _M32).astype(np.int64), (context & np.uint64(UNKNOWN)).astype(np.int64)
        hot = self.is_hot(v)
        return _by_range(np.where(hot, mixed(context), mixed(v)), self.shards), hot & self.is_hot(u)

    def spread_shard(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _by_range(mixed(mixed(context) ^ (w.astype(np.uint64) * np.uint64(_BASE))), self.shards)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(shard):
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        yield from zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shard)])


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _pairs(model: Model, hashes: np.ndarray, n: np.ndarray):
    """Ranks by place, training counts by place, and the rank of the token before each place."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    rank, count = model.ranks(distinct)
    rank, count = rank[inverse], count[inverse]
    before = np.concatenate([[BEGIN], rank[:-1]])
    before[np.concatenate([[0], np.cumsum(n)[:-1]])] = BEGIN
    return rank, count, before


def _count_tokens(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in _chunks(batches):
            keys, counts = np.unique(hashes, return_counts=True)
            yield from _dealt(keys, counts, _by_range(keys, shards))
    return run


def _token_shard(folder: str, hot_share: float):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        write_arrays(folder, f"token-{s}", {"keys": keys, "counts": counts})
        frequent = np.flatnonzero(counts >= hot_share * counts.sum())
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()),
                         "total": pa.array([int(counts.sum())], pa.int64()),
                         "at": pa.array([frequent.tolist()], pa.list_(pa.int64())),
                         "often": pa.array([counts[frequent].tolist()], pa.list_(pa.int64()))})
    return run


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, n in _chunks(batches):
            rank, _, before = _pairs(model, hashes, n)
            keys, counts = np.unique((before.astype(np.uint64) << _M32) | rank.astype(np.uint64), return_counts=True)
            shard = model.pair_shard((keys >> _M32).astype(np.int64), (keys & np.uint64(UNKNOWN)).astype(np.int64))
            yield from _dealt(keys, counts, shard)
    return run


_NUMBERS = ["n", "n1", "n2", "n3", "n4"]
_PAIR_OUT = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("hot", pa.list_(
    pa.list_(pa.int64())))] + [(k, pa.int64()) for k in _NUMBERS])
_PAIR_DDL = "shard int, keys binary, counts binary, hot array<array<long>>, " + ", ".join(f"{k} long" for k in _NUMBERS)


def _of_counts(c: np.ndarray) -> dict[str, int]:
    return {"n": len(c)} | {f"n{i}": int((c == i).sum()) for i in (1, 2, 3, 4)}


def _pair_shard(model: Model):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        context, sums = _write_pairs(model, s, keys, counts)
        hot = np.flatnonzero(model.is_hot(context))
        # For each token here the number of contexts, to the shard of its rank.
        words, contexts = np.unique((keys & np.uint64(UNKNOWN)).astype(np.int64), return_counts=True)
        parts = list(_dealt(words.astype(np.uint64), contexts, model_range(words, model)))
        rows = [dict(zip(("shard", "keys", "counts"), r)) for p in parts
                for r in zip(*(p.column(i).to_pylist() for i in range(3)))]
        rows.append({"shard": -1 - s, "hot": [[int(context[i]), *(int(x[i]) for x in sums)] for i in hot],
                     **_of_counts(counts)})
        return pa.Table.from_pylist(rows, schema=_PAIR_OUT)
    return run


def model_range(rank: np.ndarray, model: Model) -> np.ndarray:
    """Shard of a rank: that which holds its hash."""
    return (np.searchsorted(model.first, rank, side="right") - 1).astype(np.int32)


_FOLLOW = pa.schema([("shard", pa.int32())] + [(k, pa.int64()) for k in _NUMBERS])


def _write_follow(model: Model, s: int, words: np.ndarray, contexts: np.ndarray) -> pa.Table:
    dense = np.zeros(int(model.first[s + 1] - model.first[s]), np.uint32)
    dense[words.astype(np.int64) - model.first[s]] = contexts
    write_arrays(model.folder, f"follow-{s}", {"contexts": dense})
    return pa.Table.from_pylist([{"shard": s, **_of_counts(contexts)}], schema=_FOLLOW)


def _follow_shard(model: Model):
    def run(table: pa.Table) -> pa.Table:
        return _write_follow(model, table.column("shard")[0].as_py(), *_merged(table))
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from the numbers of entries with counts 1 to 4.

    Where one of these numbers is 0, a discount that can't be told is half its count (at most 1.5).
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a and y else 0.5 * i
        out.append(min(max(d, 0.0), float(i)))
    return tuple(out)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers of no sign, byte place by byte place, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        raw = a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        data = pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)
        out += [np.array([width, len(a), len(data)], "<u8").tobytes(), data]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, n, size = (int(x) for x in np.frombuffer(data, "<u8", 3, at))
        raw = pa.Codec("zstd").decompress(data[at + 24:at + 24 + size], width * n, asbytes=True)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += 24 + size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.zeros(1, np.uint64))


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else \
        np.zeros(0, np.int64)


def _added(rows: list[list[np.ndarray]], n: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys (given as steps) of all rows, and the sums of their n columns of numbers."""
    keys = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _starts(keys)
    return keys[at], *(np.add.reduceat(np.concatenate([r[i] for r in rows])[order].astype(np.int64), at)
                       for i in range(1, n + 1))


def _triples(model: Model, hashes: np.ndarray, n: np.ndarray):
    """Ranks and training counts by place; the distinct contexts (second word, first word) and each place's number in
    them. A document's first token has no context of two words: it follows (BEGIN, BEGIN)."""
    rank, count, before = _pairs(model, hashes, n)
    first = np.concatenate([[BEGIN], before[:-1]])
    first[before == BEGIN] = BEGIN
    context, at = np.unique((before.astype(np.uint64) << _M32) | first.astype(np.uint64), return_inverse=True)
    return rank, count, context, at


_TRI = pa.schema([("shard", pa.int32()), ("data", pa.binary())])


def _count_triples(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, n in _chunks(batches):
            rank, _, context, at = _triples(model, hashes, n)
            keys, counts = np.unique((at.astype(np.uint64) << _M32) | rank.astype(np.uint64), return_counts=True)
            at, w = (keys >> _M32).astype(np.int64), keys & np.uint64(UNKNOWN)
            shard, spread = model.context_shard(context)
            shard = np.where(spread[at], model.spread_shard(context[at], w), shard[at])
            order = np.argsort(shard, kind="stable")
            context, w, counts, shard = context[at][order], w[order], counts[order], shard[order]
            rows = []
            for s, a, b in _runs(shard):
                to = _starts(context[a:b])
                rows.append((s, _packed(_steps(context[a:b][to]), np.diff([*to, b - a]), w[a:b], counts[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TRI.field(i).type) for i in (0, 1)],
                                             schema=_TRI)
    return run


_KIND = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("data", pa.binary()),
                   ("numbers", pa.list_(pa.list_(pa.int64())))])
_KIND_DDL = "kind string, shard int, data binary, numbers array<array<long>>"


def _kinds(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], _KIND.field(i).type) for i in range(4)], schema=_KIND)


def _sent(kind: str, keys: np.ndarray, shard: np.ndarray, *numbers: np.ndarray) -> list[tuple]:
    """Sorted keys and their numbers, one row for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    keys, numbers, shard = keys[order], [x[order] for x in numbers], shard[order]
    return [(kind, s, _packed(_steps(keys[a:b]), *(x[a:b] for x in numbers)), None) for s, a, b in _runs(shard)]


def _sums(counts: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For runs of counts: the sum, and how many are one, two and more."""
    return [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            for x in (counts, counts == 1, counts == 2, counts >= 3)]


def _short(counts: np.ndarray) -> dict[str, np.ndarray]:
    big = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "big_at": big, "big": counts[big]}


def _long(f: dict, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Counts by place; 0 where not ok."""
    if not len(f["counts"]):
        return np.zeros(len(at), np.int64)
    c = f["counts"][np.minimum(at, len(f["counts"]) - 1)].astype(np.int64)
    big = np.flatnonzero((c == 255) & ok)
    c[big] = f["big"][np.searchsorted(f["big_at"], at[big])]
    return np.where(ok, c, 0)


def _write_pairs(model: Model, s: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The file of a shard of pairs; its contexts and their sums."""
    v = (keys >> _M32).astype(np.int64)
    at = _starts(v)
    context, sums = v[at], _sums(counts, at)
    write_arrays(model.folder, f"pair-{s}", {
        "keys": keys, **_short(counts), "context": context, "total": sums[0],
        **{k: x.astype(np.uint32) for k, x in zip(("once", "twice", "more"), sums[1:])}})
    return context, sums


def _of_pairs(model: Model, s: int, keys: np.ndarray, counts: np.ndarray, hot: bool) -> list[tuple]:
    """Writes a shard of pairs with the counts of order 2 (keys: both ranks) and gives what later jobs need of it."""
    context, sums = _write_pairs(model, s, keys, counts)
    words, contexts = np.unique(keys & np.uint64(UNKNOWN), return_counts=True)
    told = [[int(v), *(int(x[i]) for x in sums)] for i, v in enumerate(context)] if hot else []
    return [*_sent("follow", words, model_range(words.astype(np.int64), model), contexts),
            ("pair", s, None, [list(_of_counts(counts).values()), *told])]


def _triple_shard(model: Model):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        rows = [_unpacked(d.as_py()) for d in table.column("data")]
        context = np.concatenate([np.repeat(np.cumsum(r[0], dtype=np.uint64), r[1].astype(np.int64)) for r in rows])
        w, counts = (np.concatenate([r[i] for r in rows]) for i in (2, 3))
        del rows
        order = np.lexsort((w, context))
        context, w, counts = context[order], w[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (w[1:] != w[:-1])]))
        context, w, counts = context[at], w[at], np.add.reduceat(counts, at)
        begins = (context >> _M32) == np.uint64(BEGIN)
        starts = w[begins], counts[begins]  # the first tokens are pairs only
        context, w, counts = context[~begins], w[~begins], counts[~begins]

        at = _starts(context)
        pair, sums = context[at], _sums(counts, at)
        v = pair >> _M32
        wide = np.flatnonzero((sums[1] + sums[2] + sums[3] >= WIDE) | (np.maximum.reduceat(counts, at) >= 255
                                                                       if len(at) else np.zeros(0, bool)))
        v_at = _starts(v)
        write_arrays(model.folder, f"triple-{s}", {
            "v": v[v_at].astype(np.uint32), "v_at": np.append(v_at, len(pair)).astype(np.uint32),
            "u": pair.astype(np.uint32), "at": np.append(at, len(w)).astype(np.uint32), "w": w.astype(np.uint32),
            **_short(counts), "wide": wide.astype(np.uint32), "total": sums[0][wide],
            **{k: x[wide].astype(np.uint32) for k, x in zip(("once", "twice", "more"), sums[1:])}})
        out = [("triple", s, None, [list(_of_counts(counts).values())])]
        _, both = model.context_shard(pair)
        out += _sent("sums", pair[both], _by_range(mixed(pair[both]), model.shards), *(x[both] for x in sums))

        # Pairs of order 2: a word before the pair counts once.
        keys = ((context >> _M32) << _M32) | w
        keys, before = np.unique(keys, return_counts=True)
        hot = model.is_hot((keys >> _M32).astype(np.int64))
        hot_keys = np.concatenate([keys[hot], (np.uint64(BEGIN) << _M32) | starts[0]])
        hot_counts = np.concatenate([before[hot], starts[1]])
        order = np.argsort(hot_keys, kind="stable")
        hot_keys, hot_counts = hot_keys[order], hot_counts[order]
        out += _sent("hot", hot_keys, _by_range(mixed(hot_keys), model.shards), hot_counts)
        if not hot.all():
            out += _of_pairs(model, s, keys[~hot], before[~hot], False)
        return _kinds(out)
    return run


def _hot_shard(model: Model):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = _added([_unpacked(d.as_py()) for d in table.column("data")], 1)
        return _kinds(_of_pairs(model, s + model.shards, keys, counts, True))
    return run


def _sums_shard(model: Model):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, *sums = _added([_unpacked(d.as_py()) for d in table.column("data")], 4)
        write_arrays(model.folder, f"sums-{s}", {"keys": keys, **dict(zip(("total", "once", "twice", "more"), sums))})
        return pa.table({"shard": pa.array([s], pa.int32())})
    return run


def _follow_packed(model: Model):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        words, contexts = _added([_unpacked(d.as_py()) for d in table.column("data")], 1)
        return _write_follow(model, s, words, contexts)
    return run


def _train_triples(rows: DataFrame, model: Model) -> None:
    by_shard = lambda df: df.repartition(model.shards, "shard").groupBy("shard")
    parts = by_shard(map_batches(rows, _count_triples(model), "shard int, data binary")).applyInArrow(
        _triple_shard(model), _KIND_DDL)
    parts = cut(parts, "ngram-triples")
    hot = cut(by_shard(parts.where("kind = 'hot'")).applyInArrow(_hot_shard(model), _KIND_DDL), "ngram-hot-pairs")
    sums = cut(by_shard(parts.where("kind = 'sums'")).applyInArrow(_sums_shard(model), "shard int"), "ngram-sums")
    model.sizes |= {f"sums-{r[0]}" for r in sums.collect()}

    both = parts.unionByName(hot)
    numbers = {"triple": np.zeros(5, np.int64), "pair": np.zeros(5, np.int64)}
    told: dict[int, np.ndarray] = {}
    for kind, s, own in both.where("kind IN ('triple', 'pair')").select("kind", "shard", "numbers").collect():
        model.sizes.add(f"{kind}-{s}")
        numbers[kind] += np.array(own[0], np.int64)
        for v, *sums in own[1:]:
            told[v] = told.get(v, 0) + np.array(sums, np.int64)
    model.hot = {v: () for v in model.hot} | {v: tuple(int(x) for x in n) for v, n in told.items()}
    model.top_discounts = discounts(*numbers["triple"][1:].tolist())
    model.pairs, model.discounts = int(numbers["pair"][0]), discounts(*numbers["pair"][1:].tolist())
    _train_follow(by_shard(both.where("kind = 'follow'")), _follow_packed(model), model)


def _train_follow(parts, fn, model: Model) -> None:
    follow = cut(parts.applyInArrow(fn, "shard int, " + ", ".join(f"{k} long" for k in _NUMBERS)), "ngram-follow")
    total = follow.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in _NUMBERS]).first()
    model.low_discounts = discounts(*total[1:])
    model.low_of = (total[1], total[2], total[0] - total[1] - total[2])
    model.sizes |= {f"follow-{r[0]}" for r in follow.select("shard").collect()}


def train(docs: DataFrame, learn: Column, shards: int | None = None, order: int = 3) -> Model:
    """Count all rows for which ``learn`` holds (null texts as empty) and write the model below the shared folder.

    ``order`` is 2 or 3. ``shards`` is the number of files of each kind; one for each SHARD_BYTES of text if not given.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    rows = docs.where(learn).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folder = scratch_path(spark, "ngram-model")
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = 1 + int(size) // SHARD_BYTES
    model = Model(folder, shards, order=order)
    by_shard = lambda df: df.repartition(shards, "shard").groupBy("shard")

    found = by_shard(map_batches(rows, _count_tokens(shards), _PART_DDL)).applyInArrow(
        _token_shard(folder, 0.25), "shard int, n long, total long, at array<long>, often array<long>")
    found = sorted(cut(found, "ngram-tokens").collect(), key=lambda r: r["shard"])
    n = np.zeros(shards, np.int64)
    for r in found:
        n[r["shard"]] = r["n"]
    model.tokens, model.vocabulary = sum(r["total"] for r in found), int(n.sum())
    model.first = np.concatenate([[0], np.cumsum(n)])
    if model.vocabulary >= BEGIN:
        raise OverflowError("too many distinct tokens for 32-bit ranks")
    model.sizes = {f"token-{r['shard']}" for r in found}
    # A context with over a quarter of a shard's mean share of the tokens is spread: 4 * shards at most.
    limit = 0.25 * model.tokens / shards
    model.hot = {int(model.first[r["shard"]]) + a: () for r in found for a, c in zip(r["at"], r["often"]) if c > limit}
    model.hot[BEGIN] = ()
    if order == 3:
        _train_triples(rows, model)
        return model

    parts = by_shard(map_batches(rows, _count_pairs(model), _PART_DDL)).applyInArrow(_pair_shard(model), _PAIR_DDL)
    parts = cut(parts, "ngram-pairs")
    own = parts.where("shard < 0")
    hot = own.select(F.explode("hot").alias("h")).groupBy(F.col("h")[0].alias("v")).agg(
        *[F.sum(F.col("h")[i]).alias(f"s{i}") for i in (1, 2, 3, 4)])
    model.hot = {v: () for v in model.hot} | {r[0]: tuple(r)[1:] for r in hot.collect()}
    total = own.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in _NUMBERS]).first()
    model.pairs, model.discounts = total[0], discounts(*total[1:])
    model.sizes |= {f"pair-{-1 - r[0]}" for r in own.select("shard").collect()}
    _train_follow(by_shard(parts.where("shard >= 0").select("shard", "keys", "counts")), _follow_shard(model), model)
    return model


def _discount(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def probabilities(model: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """p(w | v) of distinct pairs of ranks in the order of their keys; all unknown words together have one share."""
    words, at_word = np.unique(w, return_inverse=True)
    follow = np.zeros(len(words), np.int64)
    known = words[words < BEGIN]
    for s, a, b in _runs(model_range(known, model)):
        f = model.file(f"follow-{s}")
        if f is not None:
            follow[a:b] = f["contexts"][known[a:b] - model.first[s]]
    flat = 1.0 / (model.vocabulary + 1)
    if model.pairs:
        spare = sum(d * n for d, n in zip(model.low_discounts, model.low_of)) / model.pairs
        low = np.maximum(follow - _discount(follow, model.low_discounts), 0) / model.pairs + spare * flat
    else:
        low = np.full(len(words), flat)
    low = low[at_word]

    count = np.zeros(len(v), np.int64)
    stats = np.zeros((4, len(v)), np.int64)  # of the context: count, words that follow once, twice, more often
    shard = model.pair_shard(v, w)
    order = np.argsort(shard, kind="stable")
    keys = ((v.astype(np.uint64) << _M32) | w.astype(np.uint64))[order]
    for s, a, b in _runs(shard[order]):
        f = model.file(f"pair-{s}")
        if f is None:
            continue
        at, ok = _found(f["keys"], keys[a:b])
        count[order[a:b]] = _long(f, at, ok)
        at, ok = _found(f["context"], v[order[a:b]])
        for i, name in enumerate(("total", "once", "twice", "more")):
            stats[i, order[a:b]] = np.where(ok, f[name][at], 0)
    for context, numbers in model.hot.items():
        stats[:, v == context] = np.array(numbers or (0, 0, 0, 0))[:, None]
    total = np.maximum(stats[0], 1)
    spare = sum(d * stats[i] for i, d in enumerate(model.discounts, 1)) / total
    high = np.maximum(count - _discount(count, model.discounts), 0) / total + spare * low
    return np.where(stats[0] > 0, high, low)


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked value in its own sorted range lo..hi of the values, and whether it is there."""
    at, to = lo.astype(np.int64), hi.astype(np.int64)
    left = np.flatnonzero(at < to)
    while len(left):
        mid = (at[left] + to[left]) >> 1
        less = values[mid] < asked[left]
        at[left[less]] = mid[less] + 1
        to[left[~less]] = mid[~less]
        left = left[at[left] < to[left]]
    ok = at < hi
    ok[ok] = values[at[ok]] == asked[ok]
    return at, ok


def _context_range(f: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each context in a file of trigrams, and the range of its words (an empty one: not there)."""
    v, u = (context >> _M32).astype(np.uint32), (context & np.uint64(UNKNOWN)).astype(np.uint32)
    if not len(f["v"]):
        return (np.zeros(len(context), np.int64),) * 3
    i, ok = _found(f["v"], v)
    lo, hi = f["v_at"][i].astype(np.int64), f["v_at"][i + 1].astype(np.int64)
    at, ok = _within(f["u"], lo, np.where(ok, hi, lo), u)
    i = np.where(ok, at, 0)
    lo, hi = f["at"][i].astype(np.int64), f["at"][i + 1].astype(np.int64)
    return i, np.where(ok, lo, 0), np.where(ok, hi, 0)


def _context_sums(f: dict, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Count of each context and how many words follow it once, twice and more often; from the counts, if few."""
    out = np.zeros((4, len(i)), np.int64)
    few = np.flatnonzero((hi > lo) & (hi - lo < WIDE))
    for step in range(WIDE - 1):
        few = few[lo[few] + step < hi[few]]
        c = f["counts"][lo[few] + step].astype(np.int64)
        out[0, few] += c
        out[np.minimum(c, 3), few] += 1
    if len(f["wide"]):
        at, ok = _found(f["wide"], i.astype(np.uint32))
        ok &= hi > lo
        for k, name in enumerate(("total", "once", "twice", "more")):
            out[k, ok] = f[name][at[ok]]
    return out


def triple_probabilities(model: Model, context: np.ndarray, at: np.ndarray, w: np.ndarray,
                         low: np.ndarray) -> np.ndarray:
    """p(w | u v) of distinct trigrams: their contexts' numbers among the distinct ones, their last words, and their
    probabilities by the last two words."""
    shard, spread = model.context_shard(context)
    sums = np.zeros((4, len(context)), np.int64)
    lo, hi = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
    own = np.flatnonzero(~spread)
    own = own[np.argsort(shard[own], kind="stable")]
    for s, a, b in _runs(shard[own]):
        f = model.file(f"triple-{s}")
        if f is not None:
            i, lo[own[a:b]], hi[own[a:b]] = _context_range(f, context[own[a:b]])
            sums[:, own[a:b]] = _context_sums(f, i, lo[own[a:b]], hi[own[a:b]])
    both = np.flatnonzero(spread)
    place = _by_range(mixed(context[both]), model.shards)
    both, place = both[np.argsort(place, kind="stable")], np.sort(place)
    for s, a, b in _runs(place):
        f = model.file(f"sums-{s}")
        if f is not None:
            i, ok = _found(f["keys"], context[both[a:b]])
            for k, name in enumerate(("total", "once", "twice", "more")):
                sums[k, both[a:b]] = np.where(ok, f[name][i], 0)

    count = np.zeros(len(w), np.int64)
    known = np.flatnonzero(sums[0][at] > 0)
    c = at[known]
    place = np.where(spread[c], model.spread_shard(context[c], w[known]), shard[c])
    order = np.argsort(place, kind="stable")
    known, place = known[order], place[order]
    for s, a, b in _runs(place):
        f = model.file(f"triple-{s}")
        if f is None:
            continue
        c = at[known[a:b]]
        first, last = lo[c], hi[c]
        far = np.flatnonzero(spread[c])
        _, first[far], last[far] = _context_range(f, context[c[far]])
        i, ok = _within(f["w"], first, last, w[known[a:b]].astype(np.uint32))
        count[known[a:b]] = _long(f, i, ok)
    total = np.maximum(sums[0], 1)
    spare = (sum(d * sums[i] for i, d in enumerate(model.top_discounts, 1)) / total)[at]
    high = np.maximum(count - _discount(count, model.top_discounts), 0) / total[at] + spare * low
    return np.where(sums[0][at] > 0, high, low)


def _log_probabilities(model: Model, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the model's probability of each token, and its training count."""
    if model.order == 2:
        rank, count, before = _pairs(model, hashes, n)
        keys, inverse = np.unique((before.astype(np.uint64) << _M32) | rank.astype(np.uint64), return_inverse=True)
        p = probabilities(model, (keys >> _M32).astype(np.int64), (keys & np.uint64(UNKNOWN)).astype(np.int64))
        return np.log10(p)[inverse], count
    rank, count, context, at = _triples(model, hashes, n)
    keys, inverse = np.unique((at.astype(np.uint64) << _M32) | rank.astype(np.uint64), return_inverse=True)
    at, w = (keys >> _M32).astype(np.int64), keys & np.uint64(UNKNOWN)
    pairs, pair_of = np.unique(((context >> _M32)[at] << _M32) | w, return_inverse=True)
    low = probabilities(model, (pairs >> _M32).astype(np.int64), (pairs & np.uint64(UNKNOWN)).astype(np.int64))
    return np.log10(triple_probabilities(model, context, at, w, low[pair_of]))[inverse], count


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                  ("perplexity", pa.float64())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, n in _chunks(batches, SCORE_TOKENS):
            log, count = _log_probabilities(model, hashes, n)
            base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            score = np.add.reduceat(log, at)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                pa.array(n.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(np.add.reduceat(base, at)),
                pa.array(score), pa.array(10.0 ** np.minimum(-score / n, 300.0))], schema=_OUT)
    return run


def score_documents(docs: DataFrame, model: Model, learn: Column) -> DataFrame:
    """One row per document row: doc_id, held_out (``learn`` doesn't hold), n_tokens (words and the end), n_known
    (tokens seen in training), train_tokens, base_score (log10 probability by smoothed token frequencies), score
    (log10 probability by the model), perplexity.

    Null and empty texts are their end token. Null and repeated ids stay as they are; an empty table gives an empty
    result; a model of no documents spreads its probability evenly over an unknown word alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learn).alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, "
                       "train_tokens long, base_score double, score double, perplexity double")
