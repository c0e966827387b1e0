"""Full-text, vector and hybrid search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import pg
from ..sources.shared import written

K1, B, RRF = 1.2, 0.75, 60


# --- text ------------------------------------------------------------------------


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf and the document's length: one row for each term of a document."""
    words = docs.select(F.col(id_col).alias("id"), pg.tsvector(text_col).alias("w"))
    return words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """id and score of every document with a term of the query.

    Texts are tokenized once: a length and the query's counts are written for each, from
    which totals and scores are taken.  Nothing but matches is shuffled."""
    spark = docs.sparkSession
    terms = sorted(set(spark.range(1).select(pg.tsvector(F.lit(query))).first()[0]))
    same = lambda t: lambda x: x == F.lit(t)
    counts = lambda w: F.struct(F.size(w).cast("double").alias("dl"), *(F.size(F.filter(w, same(t))).cast("double").alias(f"t{i}") for i, t in enumerate(terms)))
    measured = F.get(F.transform(F.array(pg.tsvector(text_col)), counts), F.lit(0))  # the words are a variable: made once
    counted = written(docs.select(F.col(id_col).alias("id"), measured.alias("m")).select("id", "m.*"), "counts")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    any_term = F.lit(False)
    for i in range(len(terms)):
        df = totals[f"d{i}"] or 0
        idf = math.log((totals["n"] - df + 0.5) / (df + 0.5) + 1)
        t = F.col(f"t{i}")
        score = score + F.when(t > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / (totals["avgdl"] or 1.0)))).otherwise(0.0)
        any_term = any_term | (t > 0)
    return counted.where(any_term).select("id", score.alias("score"))


def best(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Highest scores first, ties by id."""
    return df.orderBy(F.desc(score), F.asc("id")).limit(k)


# --- vectors ---------------------------------------------------------------------

METRICS = {"l2": pg.l2_distance, "cosine": pg.cosine_distance, "inner_product": lambda a, b: -pg.inner_product(a, b), "l1": pg.l1_distance}


def knn(df: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact nearest neighbours; a filter goes before the ranking."""
    df = df.where(where) if where is not None else df
    return df.withColumn("distance", METRICS[metric](vec_col, query)).orderBy("distance", id_col).limit(k)


#: Query vectors of a scan of a table, and those whose distances to a batch are made at once.
BLOCK, TILE, PAIRS = 4096, 512, 1 << 16


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A batch's lists as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"vectors have to have {width} elements")
    return flat.reshape(len(column), width)


def _rough(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs by a product of matrices, those of l2 squared, and what they may be off."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "l1":
            far = sum(np.abs(q[:, j, None] - x[:, j]) for j in range(q.shape[1]))
            return far, 1e-12 * (np.abs(q).sum(1) + np.abs(x).sum(1).max())
        far, a, b = q @ x.T, (q**2).sum(1), (x**2).sum(1)
        if metric == "cosine":
            size = np.sqrt(a)[:, None] * np.sqrt(b)
            return np.where(size == 0, 1.0, 1 - far / size), np.full(len(q), 1e-12)
        slack = 1e-12 * (a + b.max())
        return (a[:, None] - 2 * far + b if metric == "l2" else -far), slack


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of row to row."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric in ("l1", "l2"):
            return np.abs(x - q).sum(1) if metric == "l1" else np.sqrt(((x - q) ** 2).sum(1))
        dot = (x * q).sum(1)
        size = np.sqrt((x**2).sum(1)) * np.sqrt((q**2).sum(1))
        return -dot if metric == "inner_product" else np.where(size == 0, 1.0, 1 - dot / size)


class _Nearest:
    """The ``k`` nearest rows of each query so far, ties by id; distances count up to ``digits``."""

    def __init__(self, vectors: np.ndarray, k: int, metric: str, digits: int | None):
        self.q, self.k, self.metric, self.digits = vectors, k, metric, digits
        self.at, self.ids, self.d = np.empty(0, np.int64), None, np.empty(0)
        self.last = np.full(len(vectors), np.inf)

    def add(self, own: np.ndarray, x: np.ndarray, allowed=None) -> None:
        """A batch; ``allowed`` gives which of its rows a tile of queries may meet."""
        found = [(self.at, own[:0] if self.ids is None else self.ids, self.d)]
        bad = bool(np.isnan(x).any())
        for a in range(0, len(self.q), TILE):
            q = self.q[a : a + TILE]
            far, slack = _rough(self.metric, q, x)
            if bad or np.isnan(q).any():
                far = np.where(np.isnan(far), np.inf, far)
            met = allowed(slice(a, a + len(q)), far.shape) if allowed else None
            if met is not None:
                far[~met] = np.inf
            near = far <= self._limit(self.last[a : a + TILE], slack)[:, None]
            if far.shape[1] > self.k and near.sum() > 4 * self.k * len(q):  # much nearer than all before
                top = np.partition(far, self.k - 1, axis=1)[:, self.k - 1] + slack
                top = np.sqrt(np.maximum(top, 0)) if self.metric == "l2" else top
                near &= far <= self._limit(top, slack)[:, None]
            at, rows = np.nonzero(near if met is None else near & met)
            for i in range(0, len(at), PAIRS):
                j, r = at[i : i + PAIRS], rows[i : i + PAIRS]
                found.append((j + a, own[r], _exact(self.metric, q[j], x[r])))
        if len(found) > 1:
            at, ids, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids, d if self.digits is None else np.round(d, self.digits), at))
            at, ids, d = at[order], ids[order], d[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            self.at, self.ids, self.d = (c[place < self.k] for c in (at, ids, d))
            full = place == self.k - 1
            self.last[at[full]] = np.where(np.isnan(d[full]), np.inf, d[full])

    def _limit(self, d: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Up to where rough distances may be as near as ``d``."""
        d = d + (0 if self.digits is None else 2 * 10.0**-self.digits)
        return (d**2 if self.metric == "l2" else d) + slack


def _scanned(rows: DataFrame, asked: DataFrame, k: int, metric: str, id_col: str, prepared, digits: int | None = None) -> DataFrame:
    """query_id, ``id_col`` and distance of the ``k`` nearest ``rows`` (id, vector, further columns) of
    each row of ``asked`` (id, vector).

    Queries go in blocks, each a scan of the table; a task keeps the nearest of its rows so far, so
    it holds a block, a batch and their results, and tasks' results are ranked again.  ``prepared``
    takes a block's vectors and gives what takes a batch to its ``allowed``, or None for all."""
    spark, found, waiting = rows.sparkSession, None, []
    schema = f"query_id {dict(asked.dtypes)[asked.columns[0]]}, {id_col} {dict(rows.dtypes)[id_col]}, distance double"
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, id_col)

    def scan(ids: np.ndarray, vectors: np.ndarray):
        allowed = prepared(vectors)

        def run(batches):
            best = _Nearest(vectors, k, metric, digits)
            for batch in batches:
                if batch.num_rows:
                    x = _vectors(batch.column(1), vectors.shape[1])
                    own = batch.column(0).to_numpy(zero_copy_only=False)
                    best.add(own.astype(str) if own.dtype == object else own, x, allowed and allowed(batch, x))
            if len(best.at):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[best.at], best.ids, best.d)], names=["query_id", id_col, "distance"])

        return run

    def add():
        some = rows.mapInArrow(scan(np.array([r[0] for r in waiting]), np.array([r[1] for r in waiting], dtype=float)), schema)
        return some if found is None else found.union(some)

    for r in asked.toLocalIterator():
        waiting.append(r)
        if len(waiting) == BLOCK:
            found, waiting = add(), []
    if waiting:
        found = add()
    if found is None:
        found = spark.createDataFrame([], schema)
    near = F.col("distance") if digits is None else F.round("distance", digits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(near, id_col))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The numbers of each row's ``n`` nearest centres."""
    out = []
    for a in range(0, len(x), TILE):
        far = (centres**2).sum(1) - 2 * x[a : a + TILE] @ centres.T
        out.append(far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def _as_vectors(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull()).select(id_col, F.col(vec_col).cast("array<double>").alias("v"), *more)


def knn_all(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """query_id, ``id_col`` and distance of the exact ``k`` nearest rows of every query, by all pairs;
    distances that are the same up to ``digits`` are ties, which go by id."""
    return _scanned(_as_vectors(df, id_col, vec_col), _as_vectors(queries, id_col, vec_col), k, metric, id_col, lambda vectors: None, digits)


class IvfIndex:
    """Approximate search: k-means cells fitted on a bounded sample, every vector indexed.

    A query looks into the nearest cells only; the cell column is what the table is
    partitioned by when it is written, so other cells' files are not read."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, cells: int = 16, sample: int = 100_000, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.id_col, self.vec_col = id_col, vec_col
        known = df.where(F.col(vec_col).isNotNull())
        n = known.count()
        some = known if n <= sample else known.where(F.pmod(F.xxhash64(id_col), F.lit(n)) < sample)
        model = KMeans(k=cells, seed=seed, featuresCol="_v", maxIter=10).fit(some.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v")))
        self.centres = [[float(x) for x in c] for c in model.clusterCenters()]
        self.table = self._placed(df)

    def _placed(self, df: DataFrame) -> DataFrame:
        """With the number of the nearest cell; null for no vector."""
        centres, at = np.array(self.centres), df.columns.index(self.vec_col)

        def run(batches):
            for batch in batches:
                given = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
                cells = np.zeros(len(given), np.int32)
                if given.any():
                    cells[given] = _nearest_centres(_vectors(batch.column(at).filter(pa.array(given)).cast(pa.list_(pa.float64())), centres.shape[1]), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32(), mask=~given)], names=[*batch.schema.names, "cell"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("cell", IntegerType())]))

    def insert(self, rows: DataFrame) -> None:
        """Rows of new ids, or new vectors of known ones."""
        self.delete(rows.select(self.id_col))
        self.table = self.table.unionByName(self._placed(rows))

    def delete(self, ids: DataFrame) -> None:
        self.table = self.table.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti").select(*self.table.columns)

    def search_all(self, queries: DataFrame, k: int, probes: int = 4, metric: str = "l2") -> DataFrame:
        """query_id, id and distance of the ``k`` nearest of every row of ``queries`` (same columns):
        queries meet the rows of their cells, and distances are exact."""
        centres = np.array(self.centres)

        def prepared(vectors: np.ndarray):
            probed = np.zeros((len(vectors), len(centres)), bool)
            np.put_along_axis(probed, _nearest_centres(vectors, centres, probes), True, axis=1)

            def allowed(batch: pa.RecordBatch, x: np.ndarray):
                cells = batch.column(2).to_numpy()
                return lambda tile, far: probed[tile][:, cells]

            return allowed

        return _scanned(_as_vectors(self.table, self.id_col, self.vec_col, "cell"), _as_vectors(queries, self.id_col, self.vec_col), k, metric, self.id_col, prepared)

    def write(self, path: str) -> None:
        self.table.repartition("cell").write.partitionBy("cell").parquet(path)

    def search(self, query: list[float], k: int, probes: int = 4, where: Column | None = None) -> DataFrame:
        order = sorted(range(len(self.centres)), key=lambda i: math.dist(query, self.centres[i]))[:probes]
        return knn(self.table.where(F.col("cell").isin(order)), query, k, "l2", self.id_col, self.vec_col, where)


class ProductQuantizer:
    """Vectors as a code for each part; distances from tables of the query's parts."""

    def __init__(self, df: DataFrame, vec_col: str, parts: int = 4, codes: int = 16, sample: int = 100_000, seed: int = 7, rounds: int = 10):
        """k-means of all parts at once on a bounded sample: a job a round, in which every task sums
        up the members of its rows' nearest codes."""
        self.vec_col, self.parts = vec_col, parts
        known = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"))
        n = known.count()
        if not n:
            raise ValueError("there are no vectors to fit codes to")
        some = known if n <= sample else known.where(F.pmod(F.xxhash64("v"), F.lit(n)) < sample)
        some = written(some.repartition(df.sparkSession.sparkContext.defaultParallelism, "v"), "sample")
        first = [r[0] for r in some.distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(codes).collect()]  # as many as codes
        self.width = width = len(first[0]) // parts
        books = np.array(first)[:, : width * parts].reshape(len(first), parts, width).transpose(1, 0, 2).copy()
        full = len(first[0])

        def summed(books: np.ndarray):
            def run(batches):
                total = np.zeros((*books.shape[:2], width + 1))
                for batch in batches:
                    x = _vectors(batch.column(0), full)
                    for p, book in enumerate(books):
                        own = x[:, p * width : (p + 1) * width]
                        code = _nearest_centres(own, book, 1)[:, 0] if len(x) else np.empty(0, int)
                        for j in range(width):
                            total[p, :, j] += np.bincount(code, own[:, j], len(book))
                        total[p, :, width] += np.bincount(code, minlength=len(book))
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

            return run

        for _ in range(rounds):
            total = sum(np.frombuffer(r[0]).reshape(*books.shape[:2], width + 1) for r in some.mapInArrow(summed(books), "total binary").collect())  # a few numbers a code and task
            books = np.where(total[:, :, width:] > 0, total[:, :, :width] / np.maximum(total[:, :, width:], 1), books)
        self.books = [[[float(x) for x in c] for c in book] for book in books]

    def part(self, p: int) -> Column:
        return F.slice(self.vec_col, p * self.width + 1, self.width)

    def encode(self, df: DataFrame, into: str = "code") -> DataFrame:
        codes = []
        for p, book in enumerate(self.books):
            far = F.array(*(pg.l2_distance(self.part(p), c) for c in book))
            codes.append((F.array_position(far, F.array_min(far)) - 1).cast("int"))
        return df.withColumn(into, F.array(*codes))

    def distance(self, query: list[float], code: str = "code") -> Column:
        """Asymmetric: the query is exact, the vectors are their codes."""
        total = F.lit(0.0)
        for p, book in enumerate(self.books):
            own = query[p * self.width : (p + 1) * self.width]
            table = F.array(*(F.lit(float(sum((a - b) ** 2 for a, b in zip(own, c, strict=True)))) for c in book))
            total = total + F.get(table, F.get(code, F.lit(p)))
        return F.sqrt(total)

    def search(self, df: DataFrame, queries: DataFrame, k: int, shortlist: int, id_col: str = "id") -> DataFrame:
        """query_id, ``id_col`` and exact distance of the ``k`` nearest of each row of ``queries``.

        Queries go in blocks, each a scan of the table; in every batch the ``shortlist`` nearest
        by code are ranked by their vectors, and batches' results are ranked again.  The distance by
        code is that to what the code stands for, made for all pairs by a product of matrices."""
        books, width = [np.array(b) for b in self.books], self.width

        def prepared(vectors: np.ndarray):
            def allowed(batch: pa.RecordBatch, x: np.ndarray):
                if shortlist >= len(x):
                    return None
                parts = [x[:, p * width : (p + 1) * width] for p in range(len(books))]
                coded = np.concatenate([book[_nearest_centres(part, book, 1)[:, 0]] for part, book in zip(parts, books, strict=True)], axis=1)
                sizes, known = (coded**2).sum(1), coded.shape[1]

                def of(tile: slice, shape: tuple[int, int]) -> np.ndarray:
                    far = sizes - 2 * vectors[tile, :known] @ coded.T
                    return far <= np.partition(far, shortlist - 1, axis=1)[:, shortlist - 1 : shortlist]

                return of

            return allowed

        return _scanned(_as_vectors(df, id_col, self.vec_col), _as_vectors(queries, id_col, self.vec_col), k, "l2", id_col, prepared)


def biased(hits: DataFrame, central: DataFrame, k: int, alpha: float, where: Column | None = None) -> DataFrame:
    """The ``k`` best of a search's hits (id, distance) by a blend of distance and centrality (id,
    centrality): (1 - alpha) * distance / largest - alpha * centrality, lower first."""
    alpha = min(max(alpha, 0.0), 1.0)
    hits = hits.where(where) if where is not None else hits
    most = hits.agg(F.max("distance").alias("_most"))
    near = F.when(F.col("_most") > 0, F.col("distance") / F.col("_most")).otherwise(0.0)
    weight = F.least(F.greatest(F.coalesce("centrality", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    scored = hits.crossJoin(F.broadcast(most)).join(central, "id", "left")  # one row
    return scored.select("id", ((1 - alpha) * near - alpha * weight).alias("score")).orderBy("score", "id").limit(k)


def refined(hits: DataFrame, least: float | None = None, distinct_by: str | None = None, group_by: str | None = None, per_group: int = 3, namespace: tuple[str, object] | None = None) -> DataFrame:
    """A search's hits (id, score, further columns) of one namespace and of a score, with the best of
    each value of ``distinct_by``, or the ``per_group`` best of each group with their place in it."""
    if namespace:
        hits = hits.where(F.col(namespace[0]) == F.lit(namespace[1]))
    if least is not None:
        hits = hits.where(F.col("score") >= least)
    best_of = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score"), "id"))
    if distinct_by:
        hits = hits.withColumn("_r", best_of(distinct_by)).where("_r = 1").drop("_r")
    if group_by:
        hits = hits.withColumn("place", best_of(group_by)).where(F.col("place") <= per_group)
    return hits


# --- fusion ----------------------------------------------------------------------


def ranked(df: DataFrame, score: str = "score", descending: bool = True) -> DataFrame:
    """Ranks from one; a bounded list, as results of a search are."""
    w = Window.orderBy(F.desc(score) if descending else F.asc(score), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w))


def rrf(lists: list[DataFrame], k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of lists with id and rank."""
    out = None
    for x in lists:
        part = x.select("id", (F.lit(1.0) / (k + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("s").alias("score"))


def min_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores from zero to one; all one if they are tied."""
    w = Window.partitionBy(F.lit(1))
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def linear(vector: DataFrame, text: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight * vector + (1 - weight) * text, each from zero to one."""
    a = min_max(vector).select("id", F.col("score").alias("a"))
    b = min_max(text).select("id", F.col("score").alias("b"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.join(b, "id", "full").select("id", (weight * z("a") + (1 - weight) * z("b")).alias("score"))


def mmr(candidates: list[tuple], query: list[float], k: int, weight: float = 0.5) -> list[tuple]:
    """Maximal marginal relevance over a bounded list of (id, vector), as (id, score)."""
    weight = min(max(weight, 0.0), 1.0)

    def cos(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    left, chosen = sorted(candidates), []
    while left and len(chosen) < k:
        score = lambda c: weight * cos(query, c[1]) - (1 - weight) * max([0.0, *(cos(c[1], v) for _, v, _ in chosen)])
        top = max(left, key=lambda c: (score(c), -c[0]))
        chosen.append((*top, score(top)))
        left.remove(top)
    return [(i, s) for i, _, s in chosen]


# --- chunks ----------------------------------------------------------------------


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50, least: int = 1) -> DataFrame:
    """id, ordinal and chunk: windows of characters, each ``size - overlap`` after the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size - overlap))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.posexplode(starts).alias("ordinal", "at"))
    return out.select("id", "ordinal", F.substring("t", F.col("at") + 1, F.lit(size)).alias("chunk")).where(F.length("chunk") >= least)


def merged(hits: DataFrame, all_chunks: DataFrame, most: int) -> DataFrame:
    """Hits (id, ordinal) that follow one another as one text of at most ``most`` characters: a run
    is cut where the next chunk would make it longer.  Texts are those of the chunks (id, ordinal,
    chunk), so overlaps are kept."""
    order = Window.partitionBy("id").orderBy("ordinal")
    found = all_chunks.join(hits.select("id", "ordinal").distinct(), ["id", "ordinal"], "left_semi")
    runs = found.withColumn("run", F.col("ordinal") - F.row_number().over(order)).groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))).alias("c"))

    def add(made, x):
        """The last text goes on, or another begins."""
        last = F.element_at(made, -1)
        longer = F.concat(last["text"], F.lit(" "), x["chunk"])
        own = F.struct(x["ordinal"].alias("first"), x["ordinal"].alias("last"), x["chunk"].alias("text"))
        joined = F.struct(last["first"].alias("first"), x["ordinal"].alias("last"), longer.alias("text"))
        rest = F.slice(made, 1, F.size(made) - 1)
        return F.when(F.size(made) == 0, F.array(own)).when(F.length(longer) <= most, F.concat(rest, F.array(joined))).otherwise(F.concat(made, F.array(own)))

    kind = f"array<struct<first:{dict(found.dtypes)['ordinal']},last:{dict(found.dtypes)['ordinal']},text:string>>"
    parts = runs.select("id", F.explode(F.aggregate("c", F.array().cast(kind), add)).alias("p"))
    return parts.select("id", "p.first", "p.last", "p.text")


def expanded(hits: DataFrame, all_chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Chunks around each hit (id, ordinal)."""
    wanted = hits.select("id", F.explode(F.sequence(F.col("ordinal") - before, F.col("ordinal") + after)).alias("ordinal")).distinct()
    return all_chunks.join(wanted, ["id", "ordinal"], "left_semi")
