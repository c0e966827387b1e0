"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens at once.
A sequence is filled from a pool of pieces: of those that fit, the one whose demand
vector has the largest weighted dot product with what is left of the limits goes
next, weights being the pool's mean demands.  When no whole piece fits, the piece
with the largest product that can be cut to what is left is cut, and its rest goes back to
the pool.  So a sequence is short only if the limit on segments or loss ends it, or if it
is a task's last one.

A document's first part is its prompt, whose tokens bear no loss; ``PROMPT`` is its share.
With the loss limit below the token limit, sequences need prompts beside loss-bearing
tokens, and a sequence of cut rests alone would be ended by the loss limit.

Every task packs its own partition of the input with a bounded pool, so nothing is
shuffled, no group of rows matters, and a lost task is repeated alike: the number of
a sequence is made of the task's partition and a count.  Texts of any length are
whole; null text is an empty text, whose end id is packed like any other; repeated
rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .tokens import token_path, word_ids


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 1920


#: Pieces a task chooses from at once, and the part of a document that is its prompt.
POOL, PROMPT = 512, 0.125


class Packer:
    """Takes documents (key, tokens, tokens without loss at the start), gives whole
    sequences as lists of (key, start, length)."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.size = limits, pool
        self.keys: list = []
        self.demand = np.zeros((3, 0), np.int64)
        self.start = np.zeros(0, np.int64)
        self.context = np.zeros(0, np.int64)

    def add(self, documents: list[tuple]) -> None:
        n = np.array([d[1] for d in documents], np.int64)
        context = np.minimum(np.array([d[2] for d in documents], np.int64), n)
        new = np.stack([n, np.ones_like(n), n - context])
        self.keys.extend(d[0] for d in documents)
        self.demand = np.concatenate([self.demand, new], 1)
        self.start = np.concatenate([self.start, np.zeros_like(n)])
        self.context = np.concatenate([self.context, context])

    def __len__(self) -> int:
        return len(self.keys)

    def drain(self, least: int) -> Iterator[list[tuple]]:
        """Sequences until fewer than ``least`` pieces are left (1: all)."""
        while len(self) >= max(least, 1):
            yield self.fill()

    def fill(self) -> list[tuple]:
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)
        scale = left.astype(float)
        weight = self.demand.mean(1) / scale**2
        live = np.ones(len(self), bool)
        out = []
        while left[0] > 0 and left[1] > 0 and live.any():
            score = (weight * left) @ self.demand
            fits = live & (self.demand <= left[:, None]).all(0)
            if fits.any():
                i = int(np.where(fits, score, -1.0).argmax())
                n = int(self.demand[0, i])
            else:
                most = self.cuts(left)
                most[~live] = 0
                i = int(np.where(most > 0, score, -1.0).argmax())
                n = int(most[i])
                if n == 0:
                    break
            out.append((self.keys[i], int(self.start[i]), n))
            used = self.loss(i, n)
            left -= (n, 1, used)
            self.start[i] += n
            self.demand[0, i] -= n
            self.demand[2, i] -= used
            live[i] = self.demand[0, i] > 0 and fits[i]
            if self.demand[0, i] > 0:  # a document gives a sequence one piece at most
                live[i] = False
        done = self.demand[0] == 0
        if done.any():
            self.keys = [k for k, x in zip(self.keys, done, strict=True) if not x]
            self.demand, self.start, self.context = self.demand[:, ~done], self.start[~done], self.context[~done]
        return out

    def loss(self, i: int, n: int) -> int:
        """Loss-bearing tokens of the next n of piece i."""
        return max(0, n - max(0, int(self.context[i] - self.start[i])))

    def cuts(self, left: np.ndarray) -> np.ndarray:
        """The most tokens of each piece that fit."""
        free = np.maximum(self.context - self.start, 0)
        return np.minimum(np.minimum(left[0], self.demand[0]), free + left[2])


PIECE = "sequence_id long, offset long, start long, length long, doc_tokens long, ids binary"


def packed(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt: float = PROMPT) -> DataFrame:
    """One row per piece: doc_id, its place in its document and in its sequence, and its ids
    (binary, little-endian u4).  ``prompt``: the share of a document that bears no loss."""

    def pack(batches):
        coder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        packer, base, count = Packer(limits), TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}  # key: document's id, ids, tokens not yet given
        fresh: list[tuple] = []
        key = 0

        def rows(sequences):
            nonlocal count
            columns = [[], [], [], [], [], [], []]
            for sequence in sequences:
                offset = 0
                for k, start, n in sequence:
                    doc = held[k]
                    for c, x in zip(columns, (doc[0], base + count, offset, start, n, len(doc[1]) // 4, doc[1][4 * start : 4 * (start + n)]), strict=True):
                        c.append(x)
                    offset += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[k]
                count += 1
                if len(columns[0]) >= 1000:
                    yield batch(columns)
                    columns = [[], [], [], [], [], [], []]
            if columns[0]:
                yield batch(columns)

        def batch(c):
            kinds = [*[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["doc_id", "sequence_id", "offset", "start", "length", "doc_tokens", "ids"])

        for one in batches:
            for doc_id, ids in zip(one.column(0).to_pylist(), coder.documents(one.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                held[key] = [doc_id, ids, n]
                fresh.append((key, n, int(n * prompt)))
                key += 1
                if len(fresh) >= POOL // 2:
                    packer.add(fresh)
                    fresh = []
                    yield from rows(packer.drain(POOL // 2 + 1))
        if fresh:
            packer.add(fresh)
        yield from rows(packer.drain(1))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(trimmed(pack), f"doc_id long, {PIECE}")


END_ID, VOCABULARY = 1, "word_bpe_49k.json"


def op6_vector_packing(spark, sf_dir: str) -> DataFrame:
    df = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_path(VOCABULARY), END_ID)
    return df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_stage(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, with their ids."""
    return packed(docs, token_path(VOCABULARY), END_ID)
