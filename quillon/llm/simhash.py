"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at ``radius`` bits or fewer have a value between them that is at
half the radius or less from both.  So every distinct fingerprint emits all variants
within half the radius, variants are shuffled, and fingerprints that meet at one are
linked: they are within the radius of each other by the triangle inequality, which
is verified.  Those that meet are linked to the least of them, never all to all, and
the links' connected components are the classes.

Copies are collapsed first, so a group of copies counts once.  Variants are emitted
in passes by a linear hash, so that at most one pass's variants are on disk; a pass
is dealt into buckets whose number grows with the fingerprints, so a bucket stays
bounded.  The last table maps every document to its class through its fingerprint.

Null text is an empty text; a text without words has fingerprint zero and links like
any other; fewer words than a shingle's give one shingle; repeated rows repeat in the
result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, freed, identified, mixed, named, new_path, partitions, rows_of, trimmed, written
from .components import components, least_reached
from .repair import gathered

SEED, RADIUS, PASS_BITS = 42, 4, 3
BUCKET_VARIANTS, CHUNK = 1_000_000, 65_536
#: Masks whose parities, three bits, tell the pass.
PASS_MASKS = (0xAAAAAAAAAAAAAAAA, 0xCCCCCCCCCCCCCCCC, 0xF0F0F0F0F0F0F0F0)


def shingles(text: str, size: int):
    """Hashes of the text's shingles, in order, by chunks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), stops[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")


def shingle_set(text: str, size: int) -> np.ndarray:
    """The hashes of the different shingles, in order of size."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingles(text, size)]))


def bit_counts(chunks, hashes: int = 1) -> tuple[int, np.ndarray]:
    """The number of shingles, and how many of them set each of 64 * hashes bits.

    Further hashes are a mix of the first, as good as independent."""
    n, ones = 0, np.zeros(64 * hashes, np.int64)
    for h in chunks:
        n += len(h)
        for k in range(hashes):
            x = mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h
            ones[64 * k : 64 * k + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return n, ones


def majority(chunks, hashes: int) -> np.ndarray:
    """64 bits a hash; a bit is set if over half of the shingles' hashes have it."""
    n, ones = bit_counts(chunks, hashes)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8") if n else np.zeros(hashes, np.uint64)


def fingerprint(text: str, size: int, hashes: int = 1) -> np.ndarray:
    return majority(shingles(text, size), hashes)


def fingerprints(docs: DataFrame, size: int, hashes: int = 1, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keys`` (longs) and fp, fp1, ... (the bits as signed longs) of every text."""
    names = ["fp", *(f"fp{k}" for k in range(1, hashes))]

    def run(batches):
        for batch in batches:
            out = [(*row[:-1], fingerprint(row[-1], size, hashes)) for row in rows_of([batch])]
            own = [pa.array([r[i] for r in out], pa.int64()) for i in range(1 + len(keys))]
            fps = np.array([r[-1] for r in out], np.uint64).reshape(-1, hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(hashes))], names=["doc_id", *keys, *names])

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return df.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *keys, *names]))


def ball(half: int) -> np.ndarray:
    """All masks of at most ``half`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)], np.uint64)


def parities(x: np.ndarray) -> np.ndarray:
    """The pass of each value: linear, so that of a ^ b is that of a ^ that of b."""
    return sum((np.bitwise_count(x & np.uint64(m)) & 1).astype(np.uint8) << i for i, m in enumerate(PASS_MASKS))


def met(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Links (u, v) between fingerprints that meet at a variant; every pass is written."""
    spark, masks = distinct.sparkSession, ball(radius // 2)
    far = ball(radius - radius // 2)
    if len(far) > len(masks):
        raise ValueError("an even radius is needed: both sides emit the same ball")
    passes = 1 << PASS_BITS
    buckets = max(1, -(-n * len(masks) // passes // BUCKET_VARIANTS))
    of_mask = parities(masks)
    path = new_path(spark, "links")

    def emit(which: int):
        chosen = [np.flatnonzero(of_mask == which ^ c).astype(np.uint16) for c in range(passes)]

        def run(batches):
            for batch in batches:
                all_fps = batch.column(0).to_numpy().view(np.uint64)
                for at in range(0, len(all_fps), 4000):
                    fps = all_fps[at : at + 4000]
                    own, variants, used = parities(fps), [], []
                    for c in range(passes):
                        some = fps[own == c]
                        variants.append((some[:, None] ^ masks[chosen[c]][None, :]).ravel())
                        used.append(np.tile(chosen[c], len(some)))
                    v, m = np.concatenate(variants), np.concatenate(used)
                    b = ((mixed(v) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    b = b.astype(np.uint16 if buckets <= 65536 else np.uint32)
                    order = np.argsort(b, kind="stable")
                    v, m, b = v[order], m[order], b[order]
                    cuts = np.flatnonzero(np.diff(b)) + 1
                    first = np.concatenate([[0], cuts]) if len(b) else np.array([], int)
                    last = np.concatenate([cuts, [len(b)]])[: len(first)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(b[first].astype(np.int64)),
                            pa.array([v[x:y].tobytes() for x, y in zip(first, last, strict=True)], pa.binary()),
                            pa.array([m[x:y].tobytes() for x, y in zip(first, last, strict=True)], pa.binary()),
                        ],
                        names=["bucket", "variants", "masks"],
                    )

        return run

    def link(table: pa.Table) -> pa.Table:
        v = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["variants"]])
        m = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table["masks"]])
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        u = w = np.empty(0, np.uint64)
        if len(twice):
            near = np.searchsorted(twice, v)
            at = np.flatnonzero(twice[np.minimum(near, len(twice) - 1)] == v)
            fps = v[at] ^ masks[m[at]]
            order = np.lexsort((fps, v[at]))
            value, fps = v[at][order], fps[order]
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            least = np.repeat(fps[start], np.diff(np.append(start, len(value))))
            good = (fps != least) & (np.bitwise_count(fps ^ least) <= radius)
            pairs = np.unique(np.stack([fps[good], least[good]], 1), axis=0)
            u, w = pairs[:, 0], pairs[:, 1]
        return pa.table({"u": pa.array(u.copy().view(np.int64)), "v": pa.array(w.copy().view(np.int64))})

    for which in range(passes):
        freed(spark)
        sent = distinct.select("fp").mapInArrow(emit(which), "bucket long, variants binary, masks binary")
        sent.groupBy("bucket").applyInArrow(link, "u long, v long").write.parquet(f"{path}/pass={which}")
        del sent
    return spark.read.parquet(path).select("u", "v")


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For every row of (doc_id, fp): the least doc_id that links reach from it."""
    fps = written(fps, "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(met(distinct, distinct.count(), radius))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = written(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(of_fp, "fp")


WORDS = 4


def op10_simhash_balls(spark, sf_dir: str) -> DataFrame:
    df = classes(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORDS))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates by similarity, the share of different shingles that two texts have in common.
#: Six hashes give SKETCH bits; of these each table takes SHORT bits as a fingerprint of its own.
#: Two texts with a similarity of 0.8 differ in a share of acos(2 s / (1 + s)) / pi = 0.151 of the
#: bits; of those pairs 12 in 100 have two or fewer differing bits in a table, and nearly all have in
#: one of 60, unrelated texts hardly ever.
STAGE_WORDS, HASHES, TABLES, SHORT, SHORT_RADIUS, TABLES_A_PASS, TABLE_BUCKET = 5, 6, 60, 32, 2, 4, 250_000
#: A table is dealt by as many of a short fingerprint's bits at least.
LEAST_CUT = 3
SKETCH, SIMILARITY = 64 * HASHES, 0.8
#: Texts that differ in a larger share of bits don't meet: five deviations above 0.151.
MOST_DIFFERENT = 0.25
#: Groups of up to FEW are compared in one array operation.
FEW = 8
#: Of eight shingles so many, by their hash, are looked for in other texts; a bucket's shingles.
LOOKED_FOR, SHINGLE_BUCKETS, SHINGLE_BUCKET = 3, 64, 1_000_000
#: The texts and the bytes of their shingles that are compared at once are twice these at most.
BLOCK, BLOCK_BYTES = 512, 1 << 26
FPS = ["fp", *(f"fp{k}" for k in range(1, HASHES))]


def table_bits(table: int) -> np.ndarray:
    """The bits of a table, spread by a rule: every bit is in as many tables."""
    rank = np.argsort(mixed(np.arange(SKETCH, dtype=np.uint64) + np.uint64(1 + SKETCH * (table * SHORT // SKETCH))), kind="stable")
    at = table * SHORT % SKETCH
    return rank[at : at + SHORT]


def start_and_size(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def parts_of(b: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal buckets begins and ends."""
    start, size = start_and_size(b)
    return list(zip(start.tolist(), (start + size).tolist(), strict=True))


def joined(arrays, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in arrays)])


def near_groups(fps: np.ndarray, most: int) -> np.ndarray:
    """For each sketch the place of one that links of at most ``most`` differing bits lead to:
    the same for all that they lead to one another."""
    group, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        root, left = left[0], left[1:]
        group[root], reached = root, np.array([root])
        while len(reached) and len(left):
            some, reached = reached[:64], reached[64:]
            near = (np.bitwise_count(fps[left][:, None] ^ fps[some][None]).sum(2, dtype=np.int64) <= most).any(1)
            group[left[near]] = root
            reached, left = np.concatenate([reached, left[near]]), left[~near]
    return group


def shorts(fps: np.ndarray, table: int) -> np.ndarray:
    """The short fingerprints of sketches in a table."""
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(table_bits(table).tolist()):
        out |= (fps[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)) << np.uint64(i)
    return out


def placed(short: np.ndarray, masks: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all variants of short fingerprints, told by their first ``cut`` bits, in order,
    and whose they are: a short fingerprint is sent once to a bucket, not once a variant."""
    heads = np.unique(masks >> np.uint64(SHORT - cut))
    b = ((short >> np.uint64(SHORT - cut))[:, None] ^ heads[None, :]).ravel()
    order = np.argsort(b, kind="stable")
    return b[order].astype(np.int64), np.repeat(np.arange(len(short)), len(heads))[order]


def met_tables(sketches: DataFrame, tables_a_pass: int = TABLES_A_PASS) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ids whose short fingerprints meet at
    a variant in some table and whose sketches differ in few bits.

    All pairs of a group that meets count, whatever its size; a bucket gives a link a member.
    Sketches alone are sent; a bucket makes the variants that fall into it."""
    spark, most = sketches.sparkSession, int(MOST_DIFFERENT * SKETCH)
    masks = np.array([m for m in ball(SHORT_RADIUS // 2) if m < (1 << SHORT)], np.uint64)
    cut = min(SHORT, max(LEAST_CUT, math.ceil(math.log2(1 + sketches.count() * len(masks) / TABLE_BUCKET))))
    path = new_path(spark, "links")

    def emit(tables: range):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4000):
                    part = batch.slice(at, 4000)
                    ids = part.column(0).to_numpy()
                    fps = np.stack([c.to_numpy() for c in part.columns[1:]], 1).view(np.uint64)
                    out = []
                    for t in tables:
                        b, who = placed(shorts(fps, t), masks, cut)
                        out += [(t, int(b[x]), ids[who[x:y]].tobytes(), fps[who[x:y]].tobytes()) for x, y in parts_of(b)]
                    columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
                    kinds = [*[pa.int64()] * 2, *[pa.binary()] * 2]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["table", "bucket", "ids", "fps"])

        return run

    def variants(short: np.ndarray, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those in the bucket, by value, and whose they are; those of very many in several parts."""
        parts = 1 + len(short) // TABLE_BUCKET
        for part in range(parts):
            keys, who = [], []
            for m in masks:
                key = short ^ m
                use = key >> np.uint64(SHORT - cut) == bucket
                if parts > 1:
                    use &= mixed(key) % np.uint64(parts) == part
                who.append(np.flatnonzero(use))
                keys.append(key[use])
            keys, who = np.concatenate(keys), np.concatenate(who)
            order = np.argsort(keys)
            yield keys[order], who[order]

    def link(table: pa.Table) -> pa.Table:
        ids, fps = joined(table["ids"], np.int64), joined(table["fps"], np.uint64).reshape(-1, HASHES)
        pairs = [np.empty((0, 2), np.int64)]
        label = np.arange(len(ids))  # members that larger groups have led to one another
        for keys, who in variants(shorts(fps, table["table"][0].as_py()), table["bucket"][0].as_py()):
            start, size = start_and_size(keys)
            small = np.repeat(size <= FEW, size)
            for step in range(1, FEW):
                at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:]) if len(keys) > step else np.empty(0, np.int64)
                a, b = who[at], who[at + step]
                near = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64) <= most
                pairs.append(np.stack([a[near], b[near]], 1))
            for k in np.argsort(-size, kind="stable")[: (size > FEW).sum()]:
                own = who[start[k] : start[k] + size[k]]
                if (label[own] == label[own[0]]).all():
                    continue
                group = near_groups(fps[own], most)
                pairs.append(np.stack([own, own[group]], 1))
                for root in np.unique(group):
                    old = np.unique(label[own[group == root]])
                    if len(old) > 1:
                        label[np.isin(label, old)] = old[0]
        pairs = np.concatenate(pairs)
        u, v = least_reached(ids[pairs[:, 0]], ids[pairs[:, 1]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    for at in range(0, TABLES, tables_a_pass):
        freed(spark)
        sent = sketches.select("id", *FPS).mapInArrow(trimmed(emit(range(at, min(TABLES, at + tables_a_pass)))), "table long, bucket long, ids binary, fps binary")
        sent.groupBy("table", "bucket").applyInArrow(link, "u long, v long").write.parquet(f"{path}/pass={at}")
        del sent
    out = spark.read.parquet(path).select("u", "v")
    out._quillon_path = path
    return out


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """Row key, doc_id, ``id`` (a digest of the set of shingles), the number of the set's shingles
    and a share of them by their hash."""

    def run(batches):
        for batch in batches:
            out = []
            for *own, text in rows_of([batch]):
                x = shingle_set(text, size)
                out.append((*own, xxhash.xxh64_intdigest(x.tobytes(), SEED), len(x), x[(x & np.uint64(7)) < LOOKED_FOR].tobytes()))
            *own, ids, n, some = zip(*out, strict=True) if out else [()] * (len(ROW) + 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in own), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(some, pa.binary())], names=[*ROW, "doc_id", "id", "n", "some"])

    df = docs.select(*ROW, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return df.mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in [*ROW, "doc_id", "id", "n"]) + ", some binary")


def alone(rows: DataFrame) -> DataFrame:
    """``id`` and how many of the shingles looked for are in no other set.

    Of a shingle the least and the largest id are sent from each batch."""
    total = rows.agg(F.sum(F.octet_length("some"))).first()[0] or 0
    buckets = max(SHINGLE_BUCKETS, -(-total // 8 // SHINGLE_BUCKET))

    def ends(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(h)
        h, lo, hi = h[order], lo[order], hi[order]
        start, _ = start_and_size(h)
        return (h[start], np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)) if len(h) else (h, lo, hi)

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                ids = np.repeat(part.column(0).to_numpy(), [len(x.as_buffer()) // 8 for x in part.column(1)])
                h, lo, hi = ends(joined(part.column(1), np.uint64), ids, ids)
                b = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                cuts = parts_of(b)
                yield pa.RecordBatch.from_arrays([pa.array([int(b[x]) for x, _ in cuts], pa.int64()), *(pa.array([z[x:y].tobytes() for x, y in cuts], pa.binary()) for z in (h, lo, hi))], names=["bucket", "h", "lo", "hi"])

    def count(table: pa.Table) -> pa.Table:
        _, lo, hi = ends(joined(table["h"], np.uint64), joined(table["lo"], np.int64), joined(table["hi"], np.int64))
        ids, n = np.unique(lo[lo == hi], return_counts=True)
        return pa.table({"id": pa.array(ids, pa.int64()), "alone": pa.array(n, pa.int64())})

    sent = rows.select("id", "some").mapInArrow(trimmed(emit), "bucket long, h binary, lo binary, hi binary")
    return sent.groupBy("bucket").applyInArrow(count, "id long, alone long").groupBy("id").agg(F.sum("alone").alias("alone"))


def sketched(texts: DataFrame, size: int) -> DataFrame:
    """``id``, the sketch and the set of shingles of every (id, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, size) for _, t in rows_of([part])]
                fps = np.array([majority([x], HASHES) for x in sets], np.uint64).reshape(-1, HASHES).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(HASHES)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", *FPS, "s"])

    return texts.mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in ["id", *FPS]) + ", s binary")


def alike(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Pairs of places of sets with ``least`` of their shingles in common, whose components are
    those of all such pairs: every set is held against all that aren't yet reached."""
    n = np.array([len(x) for x in sets], np.int64)
    begin = np.cumsum(n) - n
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, pairs = np.repeat(np.arange(len(sets)), n), [np.empty((0, 2), np.int64)]
    # What is in no other set counts against a set whatever it is held against.
    left = np.bincount(who[times[shingle] > 1], minlength=len(sets)) >= least * n
    held = size = start = None

    def indexed():
        """The sets that aren't reached, by shingle."""
        nonlocal held, size, start, number
        some = np.flatnonzero(left[who])
        held = who[some[np.argsort(shingle[some], kind="stable")]]
        size = np.bincount(shingle[some], minlength=len(times))
        start, number = np.cumsum(size) - size, int(left.sum())

    number = 0
    indexed()
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], reached = False, [first]
        while reached:
            a = reached.pop()
            if 2 * (now := int(left.sum())) < number:
                indexed()
            if not now:
                break
            own = shingle[begin[a] : begin[a] + n[a]]
            both = np.bincount(held[gathered(start[own], size[own])], minlength=len(sets))
            found = np.flatnonzero(left & (both >= least * (n[a] + n - both)))
            left[found] = False
            pairs.append(np.stack([np.full(len(found), a), found], 1))
            reached += found.tolist()
    return np.concatenate(pairs)


def similar(members: DataFrame, least: float) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within a component (id, root, s)
    whose sets of shingles have ``least`` of their shingles in common.

    A component is compared whole; a larger one than ``BLOCK`` is dealt into blocks, and every
    two blocks are compared."""
    spark = members.sparkSession
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum(F.octet_length("s")) / F.lit(BLOCK_BYTES))).alias("blocks"))
    total = members.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    own, other = F.col("own"), F.col("other")
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 OR own <> other")
    whole, bags = F.col("blocks") == 1, max(partitions(spark), -(-total // (BLOCK_BYTES // 4)))
    place = F.when(whole, F.pmod(F.xxhash64("root"), F.lit(bags))).otherwise(F.col("root"))
    dealt = dealt.select(whole.alias("whole"), place.alias("place"), F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), "root", "id", "s")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("root")
        ids, found = table["id"].to_numpy(), [np.empty((0, 2), np.int64)]
        for x, y in parts_of(table["root"].to_numpy()):
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["s"].slice(x, y - x)]
            found.append(ids[x + alike(sets, least)])
        found = np.concatenate(found)
        return pa.table({"u": pa.array(found[:, 0].copy(), pa.int64()), "v": pa.array(found[:, 1].copy(), pa.int64())})

    return dealt.groupBy("whole", "place", "a", "b").applyInArrow(compare, "u long, v long")


def near_classes(docs: DataFrame, size: int = STAGE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """Row key, doc_id and class (``root``) of every row; classes are the connected components
    of texts with a similarity of ``least`` or more, which is verified on the shingles.

    A text too many of whose shingles are in no other text has no partner and isn't sketched."""
    docs = identified(docs)
    rows = written(shingled(docs, size), "shingled")
    distinct = rows.groupBy("id").agg(F.min(F.struct(*ROW)).alias("first"), F.first("n").alias("n"))
    distinct = distinct.join(alone(rows), "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    distinct = written(distinct.select("id", "first.*", (F.col("n") - F.col("alone") >= F.lit(least) * F.col("n")).alias("may")), "distinct")
    texts = docs.select(*ROW, F.coalesce("text", F.lit("")).alias("text")).join(distinct.where("may").drop("may"), ROW).select("id", "text")
    sets = written(sketched(texts, size), "sketches")
    # The shingles looked for have done their work; what is on disk here is there in all later passes.
    slim = written(rows.select(*ROW, "doc_id", "id"), "ids")
    discard(rows)
    # Sketches go to several buckets, so that no more of these are on disk than the texts take.
    links = met_tables(sets, max(1, min(TABLES_A_PASS, distinct.count() // max(1, sets.count()))))
    met = written(components(links), "met")
    discard(links)
    met = met.select(F.col("u").alias("id"), "root").union(met.select("root", "root").distinct())
    members = written(sets.select("id", "s").join(met, "id"), "members")
    discard(sets)
    roots = written(components(similar(members, least)), "roots")
    discard(members)
    classed = slim.join(roots.withColumnRenamed("u", "id"), "id", "left")
    return classed.select(*ROW, "doc_id", F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every class of near-duplicates the row with the least doc_id, with its own columns."""
    keyed = identified(docs)
    rows = written(near_classes(keyed), "rows")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", *ROW)).alias("k")).select(*(F.col(f"k.{c}").alias(c) for c in ROW))
    return keyed.join(written(kept, "kept"), ROW, "left_semi").select(*named(docs))
