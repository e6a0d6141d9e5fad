"""Adaptive context-mixing range coder for token ids, over many blocks at once.

A stream of ids is cut into blocks of ``block`` ids.  Ids are coded as ranks in the stream's table, which holds each
distinct id and its count, the most frequent first.  Each block starts from the same model, that of the table, and has
its own checksum, so any block can be decoded alone.  Per id the model has three predictions: the id that last followed
the two ids before (order 2), the one that last followed the id before (order 1), each with a confidence that grows with
every hit, and the ids' own frequencies (order 0), cut into bands of equal weight whose shares adapt to the block.  Their
evidence is mixed into one frequency table of six symbols: hit of order 2, hit of order 1, or one of four bands.  A
carrying range coder of 48 bits codes the symbol and, in a band, the id by its frequency there.  All blocks of a stream
take the same step together, as numpy vectors; every number stays below 2**53, so doubles are exact.

Defined cases: ids may be any below 2**32; an empty stream has no blocks; a damaged or cut file raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 512
SLOTS = 9  # bits of a context table: as many entries as a block has ids
BANDS = 4
PAUSE = 32  # steps from one look at the counts' limit to the next
#: Fixed values of the format.
EVIDENCE = np.array([4.0, 60, 160, 320, 520, 760, 1000, 1300, 1600, 1900, 2200, 2500, 2800, 3000, 3200, 3400])
STEP, LIMIT = 24.0, 16_384.0
LOW, CARRY = float(1 << 32), 65536.0
_M1, _M2, _M3, _M4, _CUT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(32 - SLOTS)


class Table:
    """The distinct ids of a stream by falling count, and their bands of nearly equal weight."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, -counts.astype(np.int64)))
        self.ids, self.counts = ids[order].astype(np.uint32), counts[order].astype(np.int64)
        self.ends = np.cumsum(self.counts)
        total = int(self.ends[-1]) if len(order) else 0
        self.total = total
        # a band ends with the first rank that reaches its share of the weight
        marks = np.searchsorted(self.ends, total * np.arange(1, BANDS) / BANDS) + 1
        cuts = np.concatenate([[0], np.minimum(marks, len(order)), [len(order)]])
        self.band = np.repeat(np.arange(BANDS), np.diff(cuts))
        before = np.concatenate([[0], self.ends])
        self.base, self.weight = before[cuts[:-1]].astype(float), np.diff(before[cuts]).astype(float)
        self.start = (self.ends - self.counts).astype(float) - self.base[self.band]
        # a symbol's own table: hits, of no band, have one entry of weight 1 behind all ranks
        self.start, self.freq = np.append(self.start, 0.0), np.append(self.counts.astype(float), 1.0)
        self.weights, self.bases = np.concatenate([[1.0, 1.0], self.weight]), np.concatenate([[total, total], self.base]).astype(float)
        self.most = 2 if self.weight.max(initial=1.0) > CARRY else 1  # words that may leave for one id of a band
        self.symbol = (self.band + 2).astype(np.int64)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of a stream and the ranks of its ids."""
        if len(ids) and int(ids.max()) < 1 << 22:
            counts = np.bincount(ids)
            found = np.flatnonzero(counts)
            table = cls(found, counts[found])
            rank = np.empty(len(counts), np.uint32)
            rank[table.ids] = np.arange(len(table.ids), dtype=np.uint32)
            return table, rank[ids]
        found, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        table = cls(found, counts)
        rank = np.empty(len(found), np.uint32)
        rank[np.searchsorted(found, table.ids)] = np.arange(len(found), dtype=np.uint32)
        return table, rank[place]

    def pack(self) -> bytes:
        order = np.argsort(self.ids)
        ids = self.ids[order].astype(np.int64)
        steps = np.diff(ids, prepend=0)
        return struct.pack("<I", len(ids)) + zlib.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + self.counts[order].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        (n,) = struct.unpack_from("<I", data)
        raw = np.frombuffer(zlib.decompress(data[4:]), np.uint8).reshape(2, 4, n)
        steps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in raw)
        return cls(np.cumsum(steps), counts)


class Model:
    """The mixed predictions of n blocks.  Counts and ends are whole numbers held as doubles, which numpy divides fast."""

    def __init__(self, n: int, table: Table):
        self.lane = np.arange(n)
        self.base = self.lane << SLOTS
        kind = np.uint32 if len(table.ids) < (1 << 24) - 1 else np.uint64  # a rank and four bits of confidence
        self.kind, self.conf, self.shift, self.unit = kind, kind(255), kind(8), kind(1)
        none = np.iinfo(kind).max - 255
        self.one, self.two = np.full(n << SLOTS, none, kind), np.full(n << SLOTS, none, kind)
        shares = np.floor(128 * table.weight / max(1, table.total)) + (table.weight > 0)
        self.counts = np.repeat(np.concatenate([[16.0, 16.0], shares])[:, None], n, axis=1)
        self.flat_counts = self.counts.ravel()
        self.total = self.counts.sum(axis=0)
        self.prev, self.before, self.step = np.zeros(n, np.uint32), np.zeros(n, np.uint32), 0
        self.ends = np.zeros((BANDS + 3, n))
        self.flat_ends = self.ends.ravel()

    def predict(self) -> np.ndarray:
        """Sets the symbols' ends in self.ends and returns the totals."""
        self.at1 = self.base + ((self.prev * _M1) >> _CUT)
        self.at2 = self.base + ((((self.prev * _M2) ^ (self.before * _M3)) * _M4) >> _CUT)
        self.e1, self.e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.q1, self.q2 = self.e1 >> self.shift, self.e2 >> self.shift
        ends, counts = self.ends, self.counts
        np.add(counts[0], EVIDENCE.take(self.e2 & self.conf), out=ends[1])
        np.add(counts[1], EVIDENCE.take(self.e1 & self.conf), out=ends[2])
        ends[2] += ends[1]
        for k in range(2, BANDS + 2):
            np.add(ends[k], counts[k], out=ends[k + 1])
        return ends[BANDS + 2]

    def update(self, flat: np.ndarray, ranks: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        self.flat_counts[flat] += STEP
        self.total += STEP
        fresh = ranks.astype(self.kind) << self.shift
        most = fresh + self.kind(15)
        self.one[self.at1] = np.where(hit1, np.minimum(self.e1 + self.unit, most), fresh)
        self.two[self.at2] = np.where(hit2, np.minimum(self.e2 + self.unit, most), fresh)
        self.before, self.prev = self.prev, ranks
        self.step += 1
        if self.step % PAUSE == 0 and self.total.max() > LIMIT:
            over = np.flatnonzero(self.total > LIMIT)
            half = np.floor(self.counts[:, over] / 2) + 1
            self.counts[:, over] = half
            self.total[over] = half.sum(axis=0)


class _Out:
    """The range coder's end of n blocks: low, range, and the words that have left."""

    def __init__(self, n: int, steps: int):
        self.low, self.rng = np.zeros(n), np.full(n, float((1 << 48) - 1))
        self.words, self.used = np.zeros((n, 3 * steps + 8), np.int32), np.zeros(n, np.int64)

    def put(self, total: np.ndarray, start: np.ndarray, width: np.ndarray, most: int = 1) -> None:
        unit = np.floor(self.rng / total)
        self.low += unit * start
        np.multiply(unit, width, out=self.rng)
        for _ in range(most):
            short = np.flatnonzero(self.rng < LOW)
            at, have = self.used[short], self.low[short]
            top = np.floor(have / LOW)
            self.words[short, at] = top
            self.used[short] = at + 1
            self.low[short] = (have - top * LOW) * CARRY
            self.rng[short] *= CARRY

    def finish(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for k in range(3):
            top = np.floor(self.low / LOW)
            self.words[lane, self.used + k] = top
            self.low = (self.low - top * LOW) * CARRY
        words = self.words[:, : int(self.used.max()) + 3]
        while (over := words >> 16).any():  # carries
            words &= 0xFFFF
            words[:, :-1] += over[:, 1:]
        out = words.astype("<u2")
        return [out[k, : u + 3].tobytes() for k, u in enumerate(self.used.tolist())]


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The stream's table and its coded blocks; nothing for an empty stream."""
    if not len(ids):
        return []
    table, ranks = Table.of(np.asarray(ids, np.uint32))
    n, steps = -(-len(ids) // block), min(block, len(ids))
    grid = np.full(n * block, ranks[-1], np.uint32)
    grid[: len(ids)] = ranks
    grid = np.ascontiguousarray(grid.reshape(n, block).T[:steps])
    model, out = Model(n, table), _Out(n, steps)
    for row in grid:
        total = model.predict()
        symbol = table.symbol.take(row)
        hit1, hit2 = row == model.q1, row == model.q2
        np.copyto(symbol, 1, where=hit1)
        np.copyto(symbol, 0, where=hit2)
        flat = symbol * n + model.lane
        start = model.flat_ends.take(flat)
        out.put(total, start, model.flat_ends.take(flat + n) - start)
        mine = np.where(symbol > 1, row, len(table.ids))
        out.put(table.weights.take(symbol), table.start.take(mine), table.freq.take(mine), table.most)
        model.update(flat, row, hit1, hit2)
    return [table.pack(), *out.finish()]


def decode(blocks: list[bytes], total_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of a whole stream, or of any of its blocks, from the table and the coded blocks."""
    n = len(blocks) - 1
    if n < 1:
        return np.empty(0, np.uint32)
    table, steps = Table.unpack(blocks[0]), min(block, total_ids)
    lookup = np.append(np.repeat(np.arange(len(table.ids), dtype=np.int32), table.counts), np.int32(len(table.ids)))  # place in the stream's weight → rank
    words = np.zeros((n, max(map(len, blocks[1:])) // 2 + 4), np.int64)
    for k, b in enumerate(blocks[1:]):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
    model, rng = Model(n, table), np.full(n, float((1 << 48) - 1))
    code = words[:, 0] * LOW + words[:, 1] * CARRY + words[:, 2]
    used, last = np.full(n, 3), words.shape[1] - 1
    grid = np.empty((steps, n), np.uint32)
    value, over, symbol = np.empty(n), np.empty((BANDS + 1, n), bool), np.empty(n, np.int64)

    def renew(most: int = 1) -> None:
        for _ in range(most):
            short = np.flatnonzero(rng < LOW)
            at = used[short]
            code[short] = code[short] * CARRY + words[short, np.minimum(at, last)]
            used[short] = at + 1
            rng[short] *= CARRY

    for row in grid:
        total = model.predict()
        unit = np.floor(rng / total)
        np.floor(code / unit, out=value)
        np.greater_equal(value, model.ends[1 : BANDS + 2], out=over)
        np.add.reduce(over, axis=0, dtype=np.int64, out=symbol)
        flat = symbol * n + model.lane
        start = model.flat_ends.take(flat)
        code -= unit * start
        rng[:] = unit * (model.flat_ends.take(flat + n) - start)
        renew()
        weight = table.weights.take(symbol)
        unit = np.floor(rng / weight)
        at = np.minimum(np.floor(code / unit), weight - 1)
        mine = lookup.take((table.bases.take(symbol) + at).astype(np.int64))
        code -= unit * table.start.take(mine)
        np.multiply(unit, table.freq.take(mine), out=rng)
        renew(table.most)
        row[:] = mine
        np.copyto(row, model.q1, where=symbol == 1, casting="unsafe")
        np.copyto(row, model.q2, where=symbol == 0, casting="unsafe")
        model.update(flat, row, row == model.q1, row == model.q2)
    full = np.zeros((n, block), np.uint32)
    full[:, :steps] = table.ids.take(np.minimum(grid, len(table.ids) - 1)).T
    return full.ravel()[:total_ids]


#: Fixed values of the file format.
MAGIC = b"LGIDS2\r\n"
HEAD = struct.Struct("<8sIIIIQ")  # magic, shard, part, documents, block ids, ids


def pack_file(shard: int, part: int, names: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One file: head, document table (doc_id, ids), id table, then per block its size, checksum of its ids and code."""
    documents = zlib.compress(names.astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), 1)
    table, *codes = encode(ids, block) or [b""]
    out = [HEAD.pack(MAGIC, shard, part, len(names), block, len(ids))]
    for data in (documents, table):
        out += [struct.pack("<II", len(data), zlib.crc32(data)), data]
    for k, code in enumerate(codes):
        own = ids[k * block : (k + 1) * block].astype("<u4").tobytes()
        out += [struct.pack("<II", len(code), zlib.crc32(own)), code]
    return b"".join(out)


def unpack_file(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """shard, part, doc_ids, lengths and ids of one file; raises ValueError if it is cut or a checksum fails."""
    at = HEAD.size

    def piece() -> tuple[bytes, int]:
        nonlocal at
        if len(data) < at + 8:
            raise ValueError("id file is cut off")
        size, crc = struct.unpack_from("<II", data, at)
        at += 8 + size
        if len(data) < at:
            raise ValueError("id file is cut off")
        return data[at - size : at], crc

    if len(data) < at or data[:8] != MAGIC:
        raise ValueError("not an id file")
    _, shard, part, docs, block, count = HEAD.unpack_from(data)
    (documents, crc), (table, own) = piece(), piece()
    if zlib.crc32(documents) != crc or zlib.crc32(table) != own:
        raise ValueError(f"a table of shard {shard} does not match its checksum")
    documents = zlib.decompress(documents)
    found = [piece() for _ in range(-(-count // block))]
    ids = decode([table, *(code for code, _ in found)], count, block)
    for k, (_, crc) in enumerate(found):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} of shard {shard} does not match its checksum")
    return shard, part, np.frombuffer(documents, "<i8", docs), np.frombuffer(documents, "<i8", docs, 8 * docs), ids
