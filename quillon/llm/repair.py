"""Token ids in grammar-compressed binary blocks (Re-Pair), with random access.

Each shard of documents, in ascending id order, is cut into blocks of whole
documents.  Within a block, frequent pairs of neighbouring symbols are replaced
by nonterminals again and again, until no pair occurs ``LEAST_COUNT`` times: a rarer one
would save no symbol, as its rule takes two.  Pairs go by falling frequency: a round takes
all that occur more often than a bound, which falls from the most frequent pair's count by
``FALL`` a round; where chosen pairs overlap the more frequent one wins.  A pair never
spans two documents.  A block stores its rules, the expansion length of every
nonterminal, the symbols, and each document's place, so that any range of any document is
decoded without touching the rest.

Block layout, little-endian: ``QRP2``; counts of documents, rules and symbols
(3 x u4); bits of a symbol and of a length (2 x u1); document ids (i8), whether each is null
(u1), symbol offsets (u4, one more than documents), token counts (u8); then, as packed
bits that begin at a byte: rules (left, right), expansion lengths, symbols.
Blocks are the ``payload`` column of a Parquet table, one row a block, committed by
Spark's own writer, so a lost task leaves nothing behind; ``shard`` and ``block``
order them, ``start`` counts the tokens of the shard before each.

Null text is an empty text and still gets its end id.  Null ids come first and stay null;
repeated ids are kept and ordered by their text's hash; other columns don't matter,
whatever their names; an empty table gives no blocks.  Texts of any length are whole: a
document larger than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, identified, new_path, partitions, rows_of
from .tokens import token_path, word_ids

MAGIC = b"QRP2"
BLOCK_TOKENS, LEAST_COUNT, FALL, HASH_BITS = 1_000_000, 3, 0.5, 20
#: For pairs that occur as often as this, fewer cells, which the processor's cache holds, sort out enough.
FEW_CELLS_FROM, FEW_CELLS_BITS = 128, 16
#: Stands for a document's end while pairs are counted; never part of a pair.
END = np.uint32(0xFFFFFFFF)
FAR = np.int64(1 << 60)


def counted_pairs(s: np.ndarray, bound: int | None, least: int, at: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The bound that held (None: the count of the fullest cell), the pairs that occur as often
    (left << 32 | right) by falling frequency, the places of these and which pair is at each.

    Pairs are first counted by hash; only those in cells that are full enough are sorted.
    ``at``: the only places, in order, at which pairs can be that occur as often."""
    left, right = s[:-1], s[1:]
    if at is None:
        bits = HASH_BITS if bound is None or bound < FEW_CELLS_FROM else FEW_CELLS_BITS
        h = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.intp)
        cells = np.bincount(h, minlength=1 << bits)
        bound = max(least, int(cells.max()) if bound is None else bound)
        at = np.flatnonzero((cells >= bound)[h])
    a, b = left[at], right[at]
    inner = (a != END) & (b != END)
    at = at[inner]
    pairs, which, n = np.unique(a[inner].astype(np.uint64) << np.uint64(32) | b[inner], return_inverse=True, return_counts=True)
    order = np.flatnonzero(n >= bound)
    order = order[np.argsort(-n[order], kind="stable")]
    rank = np.full(len(n), -1)
    rank[order] = np.arange(len(order))
    rank = rank[which]
    return bound, pairs[order], at[rank >= 0], rank[rank >= 0]


def settled(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places keep their pair: in a run of one pair every second, else the more frequent of
    two that overlap."""
    beside = np.diff(at) == 1
    same = np.concatenate([[False], beside & (rank[1:] == rank[:-1])])
    begin = np.flatnonzero(~same)
    second = (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 1
    own = np.where(second, FAR, rank)
    after, before = np.append(np.where(beside, own[1:], FAR), FAR), np.concatenate([[FAR], np.where(beside, own[:-1], FAR)])
    return ~second & (own < after) & (own < before)


def compress(s: np.ndarray, first: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules; rule k rewrites nonterminal ``first + k``.

    While the bound stays, only pairs that were as frequent before and those with a new symbol
    can be as frequent: after the first round at the least bound the others aren't looked at."""
    rules, made, bound, changed = [np.empty((0, 2), np.uint32)], 0, None, None
    while len(s) > 1:
        bound, pairs, at, rank = counted_pairs(s, bound, least, changed)
        frequent, changed = at, None
        if len(at):
            keep = settled(at, rank)
            at, rank = at[keep], rank[keep]
            enough = np.bincount(rank, minlength=len(pairs)) >= least
            keep = enough[rank]
            at, number = at[keep], (np.cumsum(enough) - 1)[rank[keep]]
            pairs = pairs[enough]
        if not len(at):
            if bound == least:
                break
        else:
            rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
            rest = np.ones(len(s), bool)
            rest[at + 1] = False
            s = s.copy()
            s[at] = (first + made + number).astype(np.uint32)
            if bound == least:
                stay, new = frequent[rest[frequent]], at - np.arange(len(at))
                changed = np.unique(np.concatenate([stay - np.searchsorted(at, stay), new - 1, new]))
            s, made = s[rest], made + len(pairs)
            if changed is not None:
                changed = changed[(changed >= 0) & (changed < len(s) - 1)]
        bound = max(least, int(bound * FALL))
    return s, np.concatenate(rules)


def to_bits(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers below 2 ** width, one after the other, from the lowest bit on."""
    rows = -(-len(x) // 8)
    lanes = np.zeros((8, rows), np.uint64)  # eight numbers take a whole number of bytes
    for j in range(8):
        lanes[j, : len(x[j::8])] = x[j::8]
    out = np.zeros((rows, width + 9), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        for k in range((shift + width + 7) // 8):
            part = lanes[j] << np.uint64(shift) if k == 0 else lanes[j] >> np.uint64(8 * k - shift)
            out[:, byte + k] |= part.astype(np.uint8)
    return out[:, :width].tobytes()[: (len(x) * width + 7) // 8]


def from_bits(data: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Numbers start to stop; only their bytes are looked at."""
    if stop <= start:
        return np.empty(0, np.uint32)
    first, rows = start // 8, -(-stop // 8) - start // 8
    part = data[first * width : (first + rows) * width]
    grid = np.zeros((rows, width + 9), np.uint8)
    grid[:, :width] = np.concatenate([part, np.zeros(rows * width - len(part), np.uint8)]).reshape(rows, width)
    out = np.empty((rows, 8), np.uint64 if width > 32 else np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        x = grid[:, byte].astype(np.uint64) >> np.uint64(shift)
        for k in range(1, (shift + width + 7) // 8):
            x |= grid[:, byte + k].astype(np.uint64) << np.uint64(8 * k - shift)
        out[:, j] = x & mask
    return out.ravel()[start - 8 * first : stop - 8 * first]


def width_of(most: int) -> int:
    return max(1, int(most).bit_length())


def levels(rules: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Spans of rules that only use rules before the span."""
    most = rules.astype(np.int64).max(1, initial=0) - first
    done = 0
    while done < len(rules):
        ready = np.flatnonzero(most[done:] >= done)
        end = done + int(ready[0]) if len(ready) else len(rules)
        yield done, end
        done = end


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of each nonterminal."""
    out = np.ones(len(rules), np.int64)
    for a, b in levels(rules, first):
        r = rules[a:b].astype(np.int64) - first
        out[a:b] = np.where(r >= 0, out[np.maximum(r, 0)], 1).sum(1)
    return out


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Expansions:
    """The terminals of every nonterminal, one after the other, made level by level."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first: int):
        self.first, self.lengths = first, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.flat = np.empty(int(lengths.sum()), np.uint32)
        for a, b in levels(rules, first):
            at = int(self.starts[a])
            part = self.of(rules[a:b].ravel())
            self.flat[at : at + len(part)] = part

    def of(self, s: np.ndarray) -> np.ndarray:
        """The terminals of a run of symbols."""
        big = s >= self.first
        r = np.where(big, s.astype(np.int64) - self.first, 0)
        if not len(self.lengths):
            return s
        sizes = np.where(big, self.lengths[r], 1)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[(ends - sizes)[~big]] = s[~big]
        own = np.repeat(big, sizes)
        out[own] = self.flat[gathered(self.starts[r[big]], sizes[big])]
        return out


def expand(s: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Terminals of a run of symbols; only the rules that it uses are looked at."""
    while (big := s >= first).any():
        n = np.where(big, 2, 1)
        to = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        r = rules[s[big] - np.uint32(first)]
        out[to[~big]] = s[~big]
        out[to[big]], out[to[big] + 1] = r[:, 0], r[:, 1]
        s = out
    return s


def pack(docs: list[tuple[int | None, bytes]], first: int) -> bytes:
    """A block of documents given as (id, ids as little-endian u4)."""
    counts = np.array([len(b) // 4 for _, b in docs], np.uint64)
    end = END.tobytes()
    s, rules = compress(np.frombuffer(end.join(b for _, b in docs) + end, np.uint32), first)
    ends = np.flatnonzero(s == END)
    offsets = np.zeros(len(docs) + 1, np.uint32)
    offsets[1:] = ends - np.arange(len(ends))
    s, lengths = s[s != END], lengths_of(rules, first)
    wide = width_of(max(s.max(initial=0), rules.max(initial=0)))
    long = width_of(lengths.max(initial=0))
    ids = np.array([0 if d is None else d for d, _ in docs], "<i8")
    null = np.array([d is None for d, _ in docs], np.uint8)
    head = np.array([len(docs), len(rules), len(s)], "<u4").tobytes() + bytes([wide, long])
    return b"".join([MAGIC, head, ids.tobytes(), null.tobytes(), offsets.tobytes(), counts.tobytes(), to_bits(rules.ravel(), wide), to_bits(lengths, long), to_bits(s, wide)])


class Block:
    """Reads a block; ``first`` is the smallest nonterminal."""

    def __init__(self, data: bytes, first: int):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        n, m, self.size = np.frombuffer(data, "<u4", 3, 4).tolist()
        self.wide, long = data[16], data[17]
        at, self.first = 18, first

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.ids = [None if x else d for d, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.offsets, self.counts = take("<u4", n + 1).astype(np.int64), take("<u8", n)
        self.rules = from_bits(take("u1", (2 * m * self.wide + 7) // 8), self.wide, 0, 2 * m).reshape(-1, 2)
        self.lengths = from_bits(take("u1", (m * long + 7) // 8), long, 0, m).astype(np.int64)
        self.bits = take("u1", (self.size * self.wide + 7) // 8)

    def symbols(self, start: int, stop: int) -> np.ndarray:
        return from_bits(self.bits, self.wide, start, stop)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols(self.offsets[i], self.offsets[i + 1]), self.rules, self.first)

    def tokens(self, i: int, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of document i; only the symbols that cover them are expanded."""
        s = self.symbols(self.offsets[i], self.offsets[i + 1])
        start, stop = max(start, 0), min(stop, int(self.counts[i]))
        if stop <= start:
            return np.empty(0, np.uint32)
        n = np.ones(len(s), np.int64)
        big = s >= self.first
        n[big] = self.lengths[s[big] - self.first]
        ends = np.cumsum(n)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(s[a:b], self.rules, self.first)[start - skipped : stop - skipped]

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        whole = Expansions(self.rules, self.lengths, self.first).of(self.symbols(0, self.size))
        at = 0
        for d, n in zip(self.ids, self.counts.tolist(), strict=True):
            yield d, whole[at : at + n]
            at += n


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, first: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, end it with ``end_id`` and write the blocks in ascending id order."""

    def encode(batches):
        coder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, block, held, size, start = TaskContext.get().partitionId(), 0, [], 0, 0

        def flushed():
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "start": [start], "n_tokens": [size], "payload": [pack(held, first)]}, schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.documents(batch.column(1)), strict=True):
                ids += end
                if held and size + len(ids) // 4 > BLOCK_TOKENS:
                    yield flushed()
                    block, held, start, size = block + 1, [], start + size, 0
                held.append((doc_id, ids))
                size += len(ids) // 4
        if held:
            yield flushed()

    texts = identified(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("_tie"), *ROW)
    order = ["doc_id", "_tie", *ROW]
    dealt = texts.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(encode, "shard int, block int, start long, n_tokens long, payload binary").write.parquet(path)


def read_tokens(spark, path: str, first: int) -> DataFrame:
    """One row per document from the files: id, start, count and checksum of its ids."""

    def decode(batches):
        for base, payload in rows_of(batches):
            ids, counts, crcs = [], [], []
            for d, x in Block(payload, first).all():
                ids.append(d)
                counts.append(len(x))
                crcs.append(zlib.crc32(x))
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.cumsum(n) - n + base), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("start")).alias("base"), "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Ids of the tokenizer's vocabulary end below this.
FIRST_NONTERMINAL, END_ID, VOCABULARY = 1 << 16, 2, "word_bpe_49k.json"


def op3_repair_tokens(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, token_path(VOCABULARY), END_ID, FIRST_NONTERMINAL)
    return read_tokens(spark, path, FIRST_NONTERMINAL)
