"""Removal of long substrings that occur more than once, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else
in the table.  Every window of ``length`` bytes has an anchor: the last of the least of
its ``grams`` overlapping grams, by hash.  Equal windows have equal anchors at equal
places, so windows are judged among those of their anchor only:

1. the anchors of each shard of documents are counted over all shards; windows of an
   anchor that occurs once are unique;
2. a run (neighbouring windows of one anchor) is known by a 128-bit digest.  Runs that
   occur twice are repeats as a whole; this collapses copies before any comparison;
3. the different runs of an anchor go to one bucket.  Outside of the anchor's gram,
   which stands as one symbol, their bytes are concatenated, the suffix array is
   built by Lyndon groups, and neighbours in it that agree over a window are repeats.
   Runs of an anchor with more than ``HOT_RUNS`` different ones are split further: into
   windows, counted by their digest;
4. verdicts return to the shards and become spans of the documents.

Every step is a shuffle by shard, anchor or digest; nothing is collected.  A shard's
text is handled in pieces of a quarter of a megabyte, so very long texts need little memory.

Null text is empty; texts shorter than ``length`` stay as they are, unless they are
part of nothing; repeated rows are repeats of each other; an empty table gives an
empty result.  Strings are judged on the input, so all their copies go.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import freed, mixed, sharded, written
from .suffixes import suffix_array

LENGTH, SHARD_BYTES, PIECE, HOT_RUNS, BUCKET_SYMBOLS = 400, 12_000_000, 1 << 18, 512, 100_000
PLACE_BITS = np.uint64(20)
#: Odd multipliers and byte values of the two polynomial hashes, by a rule.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
BYTES = tuple(mixed(np.arange(1, 257, dtype=np.uint64) * b) for b in BASES)


def grams_of(length: int) -> int:
    """Grams in a window: about a third of its length."""
    return max(1, length * 8 // 25)


@functools.cache
def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, for any place of a piece."""
    base = BASES[which]
    out = []
    for x in (base, np.uint64(pow(int(base), -1, 1 << 64))):
        row = np.full(PIECE + 1, x, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return tuple(out)


class Hashes:
    """Prefix sums of polynomial hashes of a piece; any substring's hash is two lookups."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, {}

    def total(self, which: int) -> np.ndarray:
        if which not in self.sums:
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTES[which][self.data] * powers(which)[0][: len(self.data)], out=total[1:])
            self.sums[which] = total
        return self.sums[which]

    def of(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        total = self.total(which)
        return mixed((total[stop] - total[start]) * powers(which)[1][start])

    def all(self, width: int) -> np.ndarray:
        """The first hash of every substring of a width."""
        total = self.total(0)
        n = len(total) - width
        return mixed((total[width:] - total[:n]) * powers(0)[1][:n])


@dataclass
class Runs:
    """Runs of a piece: anchor hash, anchor's place, first and last window, digest."""

    anchor: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: Hashes

    def digest(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of a run's bytes and of its anchor's place in them."""
        stop = self.last + length
        return tuple(mixed(self.hashes.of(self.first, stop, k) + (self.place - self.first).astype(np.uint64) * np.uint64(0x100000001B3)) for k in (0, 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, starts: np.ndarray, length: int) -> Runs:
    """Runs of the windows of a piece; texts begin at ``starts`` and windows don't cross."""
    grams = grams_of(length)
    gram = length - grams + 1
    hashes, empty = Hashes(data), np.empty(0, np.int64)
    if len(data) < length:
        return Runs(np.empty(0, np.uint64), empty, empty, empty, hashes)
    h = hashes.all(gram)
    low = np.uint64((1 << int(PLACE_BITS)) - 1)
    least = sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), grams)
    ends = np.append(starts[1:], len(data))
    stop = ends - length + 1
    good = stop > starts  # texts with a window
    step = np.zeros(len(least) + 1, np.int8)
    step[starts[good]] += 1
    step[stop[good]] -= 1
    whole = np.cumsum(step[:-1], dtype=np.int8) > 0  # windows within one text
    new = np.ones(len(least), bool)  # where a run begins: another anchor, or another text
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[starts[good]] = True
    new &= whole
    first = np.flatnonzero(new)
    if not len(first):
        return Runs(np.empty(0, np.uint64), empty, empty, empty, hashes)
    last = np.append(first[1:], len(least)) - 1
    last = np.minimum(last, stop[good][np.searchsorted(starts[good], first, "right") - 1] - 1)
    place = (low - (least[first] & low)).astype(np.int64)
    return Runs(h[place], place, first, last, hashes)


class Pieces:
    """A shard's texts as pieces: bytes, where texts begin, and which row each is of."""

    def __init__(self, texts: pa.ChunkedArray, length: int):
        self.texts = [t.as_py().encode("utf-8", "surrogatepass") for t in texts]
        self.length = length

    def __iter__(self):
        held, rows, offsets, size = [], [], [], 0
        for row, b in enumerate(self.texts):
            if len(b) < self.length:
                continue
            if size and size + len(b) > PIECE:
                yield self.piece(held, rows, offsets)
                held, rows, offsets, size = [], [], [], 0
            if len(b) > PIECE:
                for at in range(0, len(b) - self.length + 1, PIECE - self.length):
                    yield self.piece([b[at : at + PIECE - 1]], [row], [at])
            else:
                held.append(b)
                rows.append(row)
                offsets.append(0)
                size += len(b)
        if held:
            yield self.piece(held, rows, offsets)

    def piece(self, held, rows, offsets):
        data = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.array([len(b) for b in held])
        starts = np.cumsum(sizes) - sizes
        return data, starts, np.array(rows), np.array(offsets), runs_of(data, starts, self.length)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place in sorted ``among`` or -1."""
    if not len(among):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)


class Keys:
    """Looks up 128-bit keys: by their first half, verified by the second."""

    def __init__(self, table: pa.Table, k1: str = "k1", k2: str = "k2"):
        a, b = unsigned(table[k1]), unsigned(table[k2])
        self.order = np.lexsort((b, a))
        self.a, self.b = a[self.order], b[self.order]

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Row of each key in the table, or -1; equal first halves are stepped over."""
        if not len(self.a):
            return np.full(len(x), -1)
        at = np.searchsorted(self.a, x)
        out = np.full(len(x), -1)
        todo = np.flatnonzero(at < len(self.a))
        while len(todo):
            here = at[todo]
            same = self.a[here] == x[todo]
            hit = same & (self.b[here] == y[todo])
            out[todo[hit]] = self.order[here[hit]]
            todo = todo[same & ~hit]
            at[todo] += 1
            todo = todo[at[todo] < len(self.a)]
        return out


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(shard, h, n): the anchors of each shard."""

    def run(table: pa.Table) -> pa.Table:
        found = [runs.anchor for *_, runs in Pieces(table["text"], length)]
        h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        return pa.table({"shard": pa.array(np.full(len(h), table["shard"][0].as_py(), np.int32)), "h": signed(h), "n": pa.array(n.astype(np.int64))})

    return docs.groupBy("shard").applyInArrow(run, "shard int, h long, n long")


def run_counts(docs: DataFrame, anchors, length: int) -> DataFrame:
    """(shard, h, k1, k2, n): each shard's different runs whose anchor occurs twice."""

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        known = np.sort(unsigned(own["h"]))
        rows = [np.empty((0, 3), np.uint64)]
        for *_, runs in Pieces(texts["text"], length):
            use = member(runs.anchor, known) >= 0
            k1, k2 = runs.digest(length)
            rows.append(np.stack([runs.anchor, k1, k2], 1)[use])
        rows = np.concatenate(rows)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows = rows[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.empty(0, np.int64)
        n = np.diff(np.append(new, len(rows)))
        rows = rows[new]
        shard = texts["shard"][0].as_py() if texts.num_rows else 0
        return pa.table({"shard": pa.array(np.full(len(n), shard, np.int32)), "h": signed(rows[:, 0]), "k1": signed(rows[:, 1]), "k2": signed(rows[:, 2]), "n": pa.array(n.astype(np.int64))})

    return docs.groupBy("shard").cogroup(anchors).applyInArrow(run, "shard int, h long, k1 long, k2 long, n long")


def fetched(docs: DataFrame, wanted, length: int, buckets: int) -> DataFrame:
    """The wanted runs: their bytes beside the anchor's gram, by bucket of anchor; or, of hot
    anchors (bucket -1), the digests of their windows."""
    grams = grams_of(length)
    gram = length - grams + 1

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "h", "k1", "k2", "total", "left", "right", "hot_1", "hot_2")}
        keys, hot, total = Keys(own), own["hot"].to_numpy(zero_copy_only=False), own["total"].to_numpy()
        seen = np.zeros(len(total), bool)
        windows = {}
        shard = own["shard"][0].as_py() if own.num_rows else 0
        for data, *_, runs in Pieces(texts["text"], length) if own.num_rows else ():
            k1, k2 = runs.digest(length)
            row = keys.find(k1, k2)
            for i in np.flatnonzero(row >= 0).tolist():
                r = int(row[i])
                if seen[r]:
                    continue
                seen[r] = True
                first, last, place = int(runs.first[i]), int(runs.last[i]), int(runs.place[i])
                if hot[r]:
                    s = np.arange(first, last + 1)
                    for w in zip(*(runs.hashes.of(s, s + length, k).tolist() for k in (0, 1)), strict=True):
                        windows[w] = windows.get(w, 0) + int(total[r])
                    continue
                h = int(runs.anchor[i])
                for k, v in zip(out, (h % buckets, h, k1[i], k2[i], total[r], data[first:place].tobytes(), data[place + gram : last + length].tobytes(), 0, 0), strict=True):
                    out[k].append(v)
        for (w1, w2), n in windows.items():
            for k, v in zip(out, (-1, shard, 0, 0, n, b"", b"", w1, w2), strict=True):
                out[k].append(v)
        kinds = {"total": pa.int64(), "bucket": pa.int64(), "left": pa.binary(), "right": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) if k in kinds else signed(np.array(v, np.uint64)) for k, v in out.items()})

    return docs.groupBy("shard").cogroup(wanted).applyInArrow(run, "bucket long, h long, k1 long, k2 long, total long, left binary, right binary, hot_1 long, hot_2 long")


def repeated_windows(table: pa.Table, length: int) -> pa.Table:
    """Of a bucket's runs that occur once: a bit for each window that is in another run too."""
    grams = grams_of(length)
    h, lefts, rights = unsigned(table["h"]), table["left"].to_pylist(), table["right"].to_pylist()
    names = {x: 257 + i for i, x in enumerate(np.unique(h).tolist())}
    text: list[int] = []
    spans = []  # where the run begins, its number of windows
    ok = bytearray()
    for x, left, right in zip(h.tolist(), lefts, rights, strict=True):
        run = [*(c + 2 for c in left), names[x] + 2, *(c + 2 for c in right)]
        n = len(run) - grams + 1  # a window is ``grams`` symbols: grams - 1 bytes and the anchor
        spans.append((len(text), n))
        text += [*run, 1]
        ok += b"\1" * n + b"\0" * (len(run) - n + 1)
    text.append(0)
    ok.append(0)
    # An order-preserving string whose slices compare fast.
    flat = "".join(map(chr, (c if c < 0xD800 else c + 0x800 for c in text)))
    twice = bytearray(len(text))
    before = -1
    for i in suffix_array(text):
        if ok[i]:
            if before >= 0 and flat[i : i + grams] == flat[before : before + grams]:
                twice[i] = twice[before] = 1
            before = i
    bits = [bytes(twice[a : a + n]) for a, n in spans]
    use = [i for i, (t, b) in enumerate(zip(table["total"].to_pylist(), bits, strict=True)) if t == 1 and any(b)]
    part = table.take(pa.array(use, pa.int64()))
    return pa.table({"k1": part["k1"], "k2": part["k2"], "bits": pa.array([bits[i] for i in use], pa.binary())})


def judged(docs: DataFrame, verdicts, length: int) -> DataFrame:
    """Every document with the spans that go (start, stop, in bytes)."""
    carried = [f for f in docs.schema.fields if f.name == "more"]

    def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which of n places are in some span from first to last."""
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, last + 1, -1)
        return np.cumsum(step[:-1]) > 0

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        pieces = Pieces(texts["text"], length)
        kind = own["kind"].to_numpy()
        known = own.filter(pa.array(kind < 2))
        bits = known["bits"].to_pylist()
        keys, hot = Keys(known), Keys(own.filter(pa.array(kind == 2)))
        gone: list[list] = [[] for _ in pieces.texts]
        for data, starts, rows, offsets, runs in pieces if own.num_rows else ():
            n = len(data)
            found = keys.find(*runs.digest(length))
            part = np.array([r >= 0 and bool(bits[r]) for r in found.tolist()], bool)
            whole = (found >= 0) & ~part
            windows = covered(n, runs.first[whole], runs.last[whole])
            for i in np.flatnonzero(part).tolist():
                windows[runs.first[i] : runs.last[i] + 1] |= np.frombuffer(bits[found[i]], bool)
            if len(hot.a):
                at = np.flatnonzero(covered(n, runs.first[found < 0], runs.last[found < 0]))
                at = at[member(runs.hashes.of(at, at + length, 0), hot.a) >= 0]
                again = hot.find(runs.hashes.of(at, at + length, 0), runs.hashes.of(at, at + length, 1)) >= 0
                windows[at[again]] = True
            at = np.flatnonzero(windows)
            if not len(at):
                continue
            bytes_gone = covered(n, at, at + length - 1)
            ends = np.append(starts[1:], n)
            for k in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                edge = np.flatnonzero(np.diff(bytes_gone[starts[k] : ends[k]].astype(np.int8), prepend=0, append=0)) + int(offsets[k])
                mine = gone[rows[k]]
                for x, y in edge.reshape(-1, 2).tolist():
                    if mine and x <= mine[-1][1]:
                        mine[-1][1] = max(y, mine[-1][1])
                    else:
                        mine.append([x, y])
        kept = []
        for b, spans in zip(pieces.texts, gone, strict=True):
            cuts = [0, *(c for s in spans for c in s), len(b)]
            kept.append(b"".join(b[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)) if spans else b)
        columns = {"doc_id": texts["doc_id"], "n_bytes": pa.array([len(b) for b in pieces.texts], pa.int64()), "spans": pa.array(gone, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())}
        return pa.table(columns | {f.name: texts[f.name] for f in carried})

    schema = StructType([*StructType.fromDDL("doc_id long, n_bytes long, spans array<array<bigint>>, kept binary"), *carried])
    return docs.groupBy("shard").cogroup(verdicts).applyInArrow(run, schema)


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans that go and the kept bytes of every row; with ``carry`` the
    other columns as a struct, ``more``."""
    spark = docs.sparkSession
    df = sharded(docs, id_col, text_col, SHARD_BYTES, carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = df.select("shard", "text")
    anchors = written(anchor_counts(texts, length), "anchors")
    freed(spark)
    often = written(anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "often")
    runs = written(run_counts(texts, anchors.select("shard", "h").join(often, "h").groupBy("shard"), length), "runs")
    freed(spark)
    each = runs.groupBy("h", "k1", "k2").agg(F.sum("n").alias("total"), F.min("shard").alias("shard"))
    each = written(each, "different-runs")
    kinds_of = each.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = each.join(kinds_of, "h").withColumn("hot", F.col("kinds") > HOT_RUNS).select("shard", "k1", "k2", "total", "hot")
    wanted = written(wanted, "wanted")
    symbols = wanted.where("NOT hot").count() * grams_of(length) * 2
    found = written(fetched(texts, wanted.groupBy("shard"), length, max(1, -(-symbols // BUCKET_SYMBOLS))), "fetched")
    freed(spark)
    edges = found.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: repeated_windows(t, length), "k1 long, k2 long, bits binary")
    edges = edges.join(each.where("total = 1").select("k1", "k2", "shard"), ["k1", "k2"])
    hot = found.where("bucket = -1").select(F.col("hot_1").alias("k1"), F.col("hot_2").alias("k2"), "total", F.col("h").cast("int").alias("shard"))
    twice = hot.groupBy("k1", "k2").agg(F.sum("total").alias("n")).where("n > 1").select("k1", "k2")
    none = F.lit(b"")
    verdicts = (
        runs.join(each.where("total > 1").select("h", "k1", "k2"), ["h", "k1", "k2"]).select("shard", "k1", "k2", F.lit(0).alias("kind"), none.alias("bits"))
        .union(edges.select("shard", "k1", "k2", F.lit(1), "bits"))
        .union(hot.select("shard", "k1", "k2").distinct().join(twice, ["k1", "k2"]).select("shard", "k1", "k2", F.lit(2), none))
    )
    verdicts = written(verdicts, "verdicts")
    freed(spark)
    return judged(df, verdicts.groupBy("shard"), length)


def kept_text() -> Column:
    """What is left as text; a character that a cut would split goes as a whole."""
    whole = F.col("kept").cast("string")
    return F.when(F.is_valid_utf8(whole), whole).otherwise(F.regexp_replace(F.make_valid_utf8(whole), "\ufffd", ""))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    df = repeats_removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return df.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), kept_text().alias("text"))


def dedup_stage(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their own columns; the text is what is left of it, and ``n_chars``
    its characters."""
    df = repeats_removed(docs, id_col, text_col, length, carry=True).withColumn("_q_text", kept_text())

    def column(name: str):
        if name == id_col:
            return F.col("doc_id").cast(docs.schema[name].dataType).alias(name)
        if name == text_col:
            return F.col("_q_text").alias(name)
        if name == "n_chars":
            return F.length("_q_text").cast(docs.schema[name].dataType).alias(name)
        return F.col("more").getField(name).alias(name)

    return df.select(*map(column, docs.columns))
