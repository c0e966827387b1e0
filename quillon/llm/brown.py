"""Language-model scores by Brown's class bigrams, with exchange clustering.

    P(word | previous) = P(class(word) | class(previous)) * P(word | class(word))

Words are moved between classes by exchange: given the class bigrams, each word goes to
the class where the training text is most likely, its own count taken out of the class it
leaves.  The moves of a round are found at once from the counts of the classes beside each
word, so a round is one pass over the tokens and one shuffle of counts.  The likelihood of
the training text comes with every pass: a round that doesn't raise it is taken back, and
the next moves only half as large a share of the words.  Rounds end when no word would move,
or two shares in a row don't raise it, or a round gains less than ``STALL`` a token.

Class transitions are smoothed by Witten-Bell.  An unknown word has the chance of the unknown
class, the share of training tokens seen once, and within it that of one of as many unseen
words as were seen once.  So the chances of all words, seen or not, and of the end sum to one.

Every task cuts its part of the table into shards of bounded size, without moving a text.  Their
tokens are written once, as numbers of the shard's own dictionary, which is in order of the
words' 64-bit hashes.  The vocabulary is cut
into buckets by hash; which of a bucket's words each shard has is written once too.  A round
sends classes from buckets to shards and counts from shards to buckets, as arrays of bytes.  Counts
are summed in a shard first, and over groups of ``GROUP`` shards where there are more than
that, so a word that all shards have is never gathered from all of them at once.  Nothing that
grows with the corpus is broadcast or collected; only class bigrams, a table of fixed size,
reach the driver.  Between passes everything is in the shared folder.

Ids are long integers.  Null text is an empty text, whose end is a token; null ids hash as an
empty string; without any training text every word is unknown; repeated rows count as often
as they occur; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, freed, rows_of, texts_of, written
from .tokens import KIND, SPACE, bytes_of, offsets_of

CLASSES, ALONE = 64, 32
END, UNKNOWN, STATES = CLASSES, CLASSES + 1, CLASSES + 2
#: Places of a word's neighbours: the state before it, or STATES and the one after.
SIDES = 2 * STATES
#: Text bytes of a shard, words of a bucket (a word counts in each shard that has it), shards of a group.
SHARD_BYTES, BUCKET_WORDS, GROUP = 12_000_000, 1_000_000, 4096
FOLDS, HELD = 5, 1
#: The least gain of a round, in log10 a token, and the bits of a count beside its key.
STALL, COUNT_BITS = 0.01, 24
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and held_out of every row."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    return texts_of(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of large binary texts: how many words each has, the number of each word, distinct words."""
    raw, offsets = bytes_of(texts), offsets_of(texts)
    begins = offsets[:-1] - offsets[0]
    word = KIND[raw] != SPACE
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(word[1:], word[:-1], out=edge[1 : len(raw)])
    edge[begins] = True
    edges = np.flatnonzero(edge) if len(raw) else np.empty(0, np.int64)
    first, size = edges[:-1], np.diff(edges)
    own = word[first] if len(raw) else np.empty(0, bool)
    first, size = first[own], size[own]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(ASCII_LOWER[raw][word])]).dictionary_encode()
    n = np.diff(np.searchsorted(first, np.append(begins, len(raw))))
    return n, found.indices.to_numpy(), found.dictionary


def tokenized(docs: DataFrame) -> DataFrame:
    """A row a shard: ids, flags and token counts of its texts, the tokens as numbers of its own
    words (-1 ends a text), the words' hashes in order and their training counts."""

    def shards(batches):
        held, size, k = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(np.diff(offsets_of(batch["text"].cast(pa.large_binary()))) + 16) if batch.num_rows else np.empty(0, np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, before + SHARD_BYTES - size, "right")))
                held.append(batch.slice(at, stop - at))
                size, at = size + int(sizes[stop - 1]) - before, stop
                if size >= SHARD_BYTES or at < batch.num_rows:
                    yield made(held, k)
                    held, size, k = [], 0, k + 1
        if held:
            yield made(held, k)

    def made(held: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n, number, distinct = words_of(table["text"].chunk(0).cast(pa.large_binary()))
        digest = xxhash.xxh64_intdigest
        hashes, same = np.unique(np.array([digest(w) for w in distinct.to_pylist()], np.uint64), return_inverse=True)
        tokens = np.full(len(number) + len(n), -1, np.int32)
        tokens[np.arange(len(number)) + np.repeat(np.arange(len(n)), n)] = same.astype(np.int32)[number]
        flags = table["held_out"].to_numpy()
        train = tokens[np.repeat(~flags, n + 1)]
        counts = np.bincount(train[train >= 0], minlength=len(hashes)).astype(np.int64)
        row = {"shard": [TaskContext.get().partitionId() << 32 | k], "ids": [table["doc_id"].to_pylist()]}
        return pa.RecordBatch.from_pydict(row | {k: [x.tobytes()] for k, x in (("held", flags), ("lengths", n + 1), ("tokens", tokens), ("words", hashes), ("counts", counts))}, schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("held", "lengths", "tokens", "words", "counts"))])
    return docs.mapInArrow(shards, "shard long, ids array<long>, held binary, lengths binary, tokens binary, words binary, counts binary")


def array(x, kind=np.int64) -> np.ndarray:
    """The numbers of a binary value."""
    return np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, kind)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's words begin among hashes in order; buckets are ranges of equal width."""
    width = (1 << 64) // buckets + 1
    return np.searchsorted(hashes, np.array([k * width for k in range(1, buckets)], np.uint64)) if buckets > 1 else np.empty(0, np.int64)


def spans(edges: np.ndarray, n: int) -> list[tuple[int, int]]:
    cuts = [0, *edges.tolist(), n]
    return list(zip(cuts, cuts[1:]))


def vocabulary(corpus: DataFrame, buckets: int) -> DataFrame:
    """By bucket: a row of its training words' counts (shard -1), and for each shard a row of the
    places of the shard's words among these (beyond the last: not in training)."""

    def dealt(batches):
        for shard, words, counts in rows_of(batches):
            w, c = array(words, np.uint64), array(counts)
            cut = [(b, x, y) for b, (x, y) in enumerate(spans(bucket_edges(w, buckets), len(w))) if y > x]
            yield pa.RecordBatch.from_pydict({"bucket": [b for b, *_ in cut], "shard": [shard] * len(cut), "words": [w[x:y].tobytes() for _, x, y in cut], "counts": [c[x:y].tobytes() for _, x, y in cut]}, schema=sent)

    def run(table: pa.Table) -> pa.Table:
        words, counts = [array(x, np.uint64) for x in table["words"]], [array(x) for x in table["counts"]]
        every, which = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, which, np.concatenate(counts))
        seen = total > 0
        place = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)[which]
        at = np.cumsum([0, *map(len, words)]).tolist()
        own = [place[x:y].tobytes() for x, y in zip(at, at[1:])]
        b, n = table["bucket"][0].as_py(), table.num_rows + 1
        return pa.table({"bucket": pa.array([b] * n, pa.int32()), "shard": pa.array([-1, *table["shard"].to_pylist()], pa.int64()), "numbers": pa.array([total[seen].tobytes(), *own], pa.binary())})

    sent = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
    parts = corpus.select("shard", "words", "counts").mapInArrow(dealt, "bucket int, shard long, words binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(run, "bucket int, shard long, numbers binary")


def first_classes(vocabulary: DataFrame) -> DataFrame:
    """The ``ALONE`` most frequent words each begin in a class of their own, others in one by place."""
    top = (
        vocabulary.where("shard = -1")
        .mapInArrow(_most_frequent, "bucket int, place int, c long")
        .orderBy(F.desc("c"), "bucket", "place")
        .limit(ALONE)
        .collect()
    )
    alone = {}
    for k, r in enumerate(top):
        alone.setdefault(r["bucket"], []).append((r["place"], k))

    def run(batches):
        for bucket, numbers in rows_of(batches):
            out = (np.arange(len(array(numbers))) * 0x9E3779B1 >> 7) % (CLASSES - ALONE) + ALONE
            for place, k in alone.get(bucket, ()):
                out[place] = k
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "class": pa.array([out.astype(np.uint8).tobytes()], pa.binary())})

    return vocabulary.where("shard = -1").select("bucket", "numbers").mapInArrow(run, "bucket int, class binary")


def _most_frequent(batches):
    for batch in batches:
        for bucket, numbers in zip(batch["bucket"].to_pylist(), batch["numbers"], strict=True):
            c = array(numbers)
            at = np.sort(np.argsort(-c, kind="stable")[:ALONE])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * len(at), pa.int32()), "place": pa.array(at.astype(np.int32)), "c": pa.array(c[at])})


def dictionaries(vocabulary: DataFrame, classes: DataFrame, with_counts: bool = False) -> DataFrame:
    """For each shard and bucket: the places of its words and their states; or, to score with,
    their states and training counts."""

    def run(batches):
        for shard, bucket, numbers, own, counts in rows_of(batches):
            place = array(numbers, np.int32)
            state = np.append(array(own, np.uint8), np.uint8(UNKNOWN))[place]
            c = np.append(array(counts), 0)[place].tobytes() if with_counts else numbers
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "numbers": pa.array([c], pa.binary()), "state": pa.array([state.tobytes()], pa.binary())})

    counts = vocabulary.where("shard = -1").select("bucket", F.col("numbers").alias("counts"))
    given = classes.join(counts, "bucket") if with_counts else classes.withColumn("counts", F.lit(b""))
    df = vocabulary.where("shard >= 0").join(given.hint("merge"), "bucket")  # grows with the vocabulary: no broadcast
    return df.select("shard", "bucket", "numbers", "class", "counts").mapInArrow(run, "shard long, bucket int, numbers binary, state binary")


class Shard:
    """A shard's tokens and states; dictionary rows come in any order."""

    def __init__(self, corpus: pa.Table, own: pa.Table):
        row = {k: corpus[k][0] for k in ("held", "lengths", "tokens")}
        self.held, self.lengths, self.tokens = array(row["held"], bool), array(row["lengths"]), array(row["tokens"], np.int32)
        order = np.argsort(own["bucket"].to_numpy(), kind="stable").tolist()
        self.buckets = own["bucket"].take(pa.array(order, pa.int64())).to_pylist()
        states, numbers = [array(own["state"][k], np.uint8) for k in order], [own["numbers"][k] for k in order]
        self.sizes = [len(x) for x in states]
        self.numbers = numbers
        self.state = np.concatenate([*states, np.array([END], np.uint8)])[self.tokens].astype(np.int64)
        self.before = np.concatenate([[END], self.state[:-1]])[: len(self.state)]  # a text begins after an end


def neighbours(corpus: DataFrame, dictionary: DataFrame, groups: int) -> DataFrame:
    """Counts of training text: in bucket -1 the class bigrams, by ``a * STATES + b``, else the
    states beside each word of the bucket, by ``place * SIDES + side``; packed."""

    def run(corpus: pa.Table, own: pa.Table) -> pa.Table:
        if not corpus.num_rows:
            return schema.empty_table()
        s = Shard(corpus, own)
        train = np.repeat(~s.held, s.lengths)
        pairs = np.bincount((s.before * STATES + s.state)[train], minlength=STATES * STATES)
        out = [(-1, packed(np.flatnonzero(pairs), pairs[pairs > 0]))]  # keys in order
        inner = np.flatnonzero(train & (s.tokens >= 0))
        t, after = s.tokens[inner].astype(np.int64) * SIDES, np.append(s.state[1:], END)
        keys, n = np.unique(np.concatenate([t + s.before[inner], t + STATES + after[inner]]), return_counts=True)
        word = np.cumsum([0, *s.sizes])
        cut = np.searchsorted(keys, word * SIDES)
        for k, b in enumerate(s.buckets):
            x, y = int(cut[k]), int(cut[k + 1])
            if y > x:
                place = array(s.numbers[k], np.int32)[keys[x:y] // SIDES - word[k]].astype(np.int64)
                out.append((b, packed(place * SIDES + keys[x:y] % SIDES, n[x:y])))
        group = hash(corpus["shard"][0].as_py()) % groups
        return pa.table({"bucket": [b for b, _ in out], "part": [group] * len(out), "entries": [x for _, x in out]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("entries", pa.binary())])
    blocks = corpus.select("shard", "held", "lengths", "tokens").groupBy("shard").cogroup(dictionary.groupBy("shard")).applyInArrow(run, "bucket int, part int, entries binary")
    if groups > 1:
        blocks = blocks.groupBy("bucket", "part").applyInArrow(summed, "bucket int, part int, entries binary")
    return blocks


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in order and their counts, two bytes an entry: the step from the key before, and the
    count.  What doesn't fit a byte takes further entries."""
    steps = np.diff(keys, prepend=0)
    wide, more = steps // 255, (counts - 1) // 255
    size = 1 + wide + more
    ends = np.cumsum(size)
    out = np.zeros((2, int(ends[-1]) if len(ends) else 0), np.uint8)
    own = ends - 1 - more  # steps of 255 before it, counts of 255 after
    first = ends - size
    for at, n, row in ((first, wide, 0), (own + 1, more, 1)):
        if n.any():
            some = n > 0
            out[row, np.repeat(at[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n.sum()))] = 255
    out[0, own], out[1, own] = steps % 255, counts - 255 * more
    return out.tobytes()


def unpacked(entries: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's counts."""
    parts = [np.empty(0, np.int64)]
    for x in entries:
        steps, n = array(x, np.uint8).reshape(2, -1)
        some = n > 0
        parts.append(np.cumsum(steps, dtype=np.int64)[some] << COUNT_BITS | n[some])
    x = np.sort(np.concatenate(parts))
    keys, n = x >> COUNT_BITS, x & ((1 << COUNT_BITS) - 1)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(n, start) if len(start) else n


def summed(table: pa.Table) -> pa.Table:
    return pa.table({"bucket": table["bucket"][:1], "part": table["part"][:1], "entries": pa.array([packed(*unpacked(table["entries"]))], pa.binary())})


def bigrams(blocks: DataFrame) -> np.ndarray:
    """Class bigrams, summed over shards; STATES * STATES numbers."""

    def add(batches):
        total = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            keys, n = unpacked(batch.column(0))
            total[keys] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = blocks.where("bucket = -1").select("entries").mapInArrow(add, "pair long, n long")
    out = np.zeros(STATES * STATES, np.int64)
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(STATES, STATES)


def likelihood(pairs: np.ndarray) -> float:
    """log10 of the training text's chance under unsmoothed class bigrams and emissions, but for
    a constant: the words' own counts."""
    n = pairs.astype(float)
    log = lambda x: (x * np.log10(np.maximum(x, 1))).sum()
    return float(log(n) - log(n.sum(1)) - log(n.sum(0)[:CLASSES]))


def exchanged(blocks: DataFrame, classes: DataFrame, pairs: np.ndarray, share: int, turn: int) -> DataFrame:
    """Every training word in the class that makes the text most likely; of the words, one in
    ``share`` may move, others each turn.  With the number of words that moved."""
    forth = np.log(transition_matrix(pairs, 0.0)[:, : END + 1] + 1e-12).astype(np.float32)
    sizes = pairs.sum(0)[:CLASSES].astype(np.float32)

    def run(table: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        old = array(own["class"][0], np.uint8)
        keys, n = unpacked(table["entries"])
        best = old.copy()
        for at in range(0, len(old), 8192):
            stop = min(len(old), at + 8192)
            x, y = np.searchsorted(keys, [at * SIDES, stop * SIDES])
            seen = np.bincount(keys[x:y] - at * SIDES, n[x:y], (stop - at) * SIDES).reshape(-1, SIDES).astype(np.float32)
            count, now = seen[:, :STATES].sum(1), old[at:stop].astype(np.int64)
            gain = seen[:, : END + 1] @ forth[: END + 1, :CLASSES] + seen[:, STATES : STATES + END + 1] @ forth[:CLASSES].T
            weight = np.log(np.maximum(sizes[None] + count[:, None], 1))
            rows = np.arange(len(now))
            weight[rows, now] = np.log(np.maximum(sizes[now], 1))
            gain -= count[:, None] * weight
            to = gain.argmax(1)
            free = (np.arange(at, stop) + turn) % share == 0
            move = free & (gain[rows, to] > gain[rows, now] + 1e-3)
            best[at:stop] = np.where(move, to, now)
        return pa.table({"bucket": own["bucket"], "class": [best.tobytes()], "moved": [int((best != old).sum())]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("class", pa.binary()), ("moved", pa.int64())])
    counted = blocks.where("bucket >= 0").groupBy("bucket")
    return counted.cogroup(classes.groupBy("bucket")).applyInArrow(run, "bucket int, class binary, moved long")


def transition_matrix(pairs: np.ndarray, unknown: float) -> np.ndarray:
    """Witten-Bell smoothed class transitions; rows sum to one."""
    known = pairs.astype(float)
    known[:, UNKNOWN] = 0
    known[UNKNOWN] = 0
    share = known.sum(0) + 1e-3
    share[UNKNOWN] = 0
    share = share / share.sum()
    total, kinds = known.sum(1, keepdims=True), np.maximum((known > 0).sum(1, keepdims=True), 1)
    out = (known + kinds * share) / (total + kinds) * (1 - unknown)
    out[:, UNKNOWN] = unknown
    return out


class Model:
    """Class transitions and emissions; what scores a text."""

    def __init__(self, pairs: np.ndarray, tokens: int, once: int):
        unknown = min(max((once + 0.5) / (tokens + 1), 1e-9), 0.5)
        self.step = np.log10(transition_matrix(pairs, unknown))
        self.size = np.log10(np.maximum(pairs.sum(0), 1).astype(float))
        self.size[UNKNOWN], self.size[END] = np.log10(max(once, 1)), 0.0  # as many unseen words as seen once

    def log(self, before: np.ndarray, state: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the chance of each token, given states and the words' counts."""
        word = state < CLASSES
        return self.step[before, state] - self.size[state] + np.where(word, np.log10(np.maximum(counts, 1)), 0)


def scored(corpus: DataFrame, dictionary: DataFrame, model: Model, tokens: int, kinds: int, ends: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every text."""

    def run(corpus: pa.Table, own: pa.Table) -> pa.Table:
        s = Shard(corpus, own)
        c = np.concatenate([*map(array, s.numbers), [ends]])[s.tokens]
        at = np.cumsum(s.lengths) - s.lengths
        known, base, log = (np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64), np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1))), model.log(s.before, s.state, c)))
        columns = {"doc_id": corpus["ids"].combine_chunks().flatten(), "held_out": s.held, "n_tokens": s.lengths, "n_known": known, "base_score": base, "score": log}
        return pa.table({k: v if isinstance(v, pa.Array | pa.ChunkedArray) else pa.array(v) for k, v in columns.items()})

    sides = corpus.select("shard", "ids", "held", "lengths", "tokens").groupBy("shard").cogroup(dictionary.groupBy("shard"))
    return sides.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def totals(corpus: DataFrame, vocabulary: DataFrame) -> tuple[int, int, int, int]:
    """Tokens (ends too), distinct words, words seen once, and ends of the training texts."""

    def words(batches):
        for batch in batches:
            for x in map(array, batch.column(0)):
                yield pa.RecordBatch.from_pydict({"c": [int(x.sum())], "kinds": [len(x)], "once": [int((x == 1).sum())]})

    def texts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(int((~array(x, bool)).sum()) for x in batch.column(0))]})

    found = vocabulary.where("shard = -1").select("numbers").mapInArrow(words, "c long, kinds long, once long")
    c, kinds, once = found.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("c", "kinds", "once"))).first()
    ends = corpus.select("held").mapInArrow(texts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return c + ends, kinds + (ends > 0), once, ends


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, history: list[float] | None = None) -> DataFrame:
    """Learn from the training folds and score every text.  ``rounds`` bounds the exchange;
    ``history`` is given the training likelihood of every round that was kept, in log10 a token."""
    spark = docs.sparkSession
    corpus = written(tokenized(prepared(docs, id_col, text_col)), "corpus")
    freed(spark)
    shards, size = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    words = written(vocabulary(corpus, max(1, math.ceil(size / 8 / BUCKET_WORDS))), "vocabulary")
    freed(spark)
    tokens, kinds, once, ends = totals(corpus, words)
    groups = max(1, math.ceil(shards / GROUP))
    classes, best, turn, share, failed = written(first_classes(words), "classes"), None, 0, 1, 0
    kept = None  # classes, blocks and bigrams of the best round
    while True:
        blocks = written(neighbours(corpus, dictionaries(words, classes), groups), "neighbours")
        freed(spark)
        pairs = bigrams(blocks)
        now = likelihood(pairs) / max(tokens, 1)
        gain = math.inf if best is None else now - best
        if gain > 0:
            if kept:
                discard(kept[0])
                discard(kept[1])
            kept, best, failed = (classes, blocks, pairs), now, 0
            if history is not None:
                history.append(now)
        else:
            discard(classes)
            discard(blocks)
            share, failed = 2 * share, failed + 1
        turn += 1
        if 0 < gain < STALL or failed == 2 or (rounds is not None and turn > rounds):
            break
        classes = written(exchanged(kept[1], kept[0], kept[2], share, turn), "classes")
        freed(spark)
        moved = classes.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
        if not moved and share == 1:
            discard(classes)
            break
    classes, blocks, pairs = kept
    discard(blocks)
    out = scored(corpus, dictionaries(words, classes.select("bucket", "class"), with_counts=True), Model(pairs, tokens, once), tokens, kinds, ends)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op2_class_bigrams(spark, sf_dir: str) -> DataFrame:
    df = class_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
