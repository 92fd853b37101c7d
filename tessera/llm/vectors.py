"""Search of a stated set of query vectors against all vectors, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, spread, table

#: Vectors that a task searches at once, and numbers of a block of queries that go to all tasks (8 MB).
CANDIDATES_PER_BLOCK, NUMBERS_PER_QUERY_BLOCK = 8192, 1 << 20

#: Blocks of queries whose results are stored together.
BLOCKS_AT_ONCE = 16

#: Queries of a block that are scored against each other beforehand, for a first bar to pass.
SAMPLE = 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


class Best:
    """The best candidates of each query so far, and the bar: a score that its last result has at least."""

    def __init__(self, bars: np.ndarray, top: int) -> None:
        self.bars, self.top = bars.copy(), top
        self.ids = [np.empty(0, np.int64) for _ in bars]
        self.scores = [np.empty(0) for _ in bars]

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates below the bar need not be among them; higher scores come first, ties to the smaller id."""
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], scores])
        first = np.lexsort((ids, -scores))[: self.top]
        self.ids[query], self.scores[query] = ids[first], scores[first]
        if len(first) == self.top:
            self.bars[query] = max(self.bars[query], scores[first[-1]])


#: (ids ascending, their vectors, ids of the queries, their vectors, the best so far): adds a block's candidates to the best.
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Best], None]


def _first_bars(asked: np.ndarray, wanted: np.ndarray, top: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A score that each query's last result reaches at least, from some rows of its own block; -inf if those are too few."""
    bars = np.full(len(asked), -np.inf)
    some, ids = wanted[:SAMPLE], asked[:SAMPLE]
    if len(some) <= top:
        return bars
    for i, query in enumerate(wanted):
        scores = score(some, query)
        scores = scores[ids != asked[i]]
        bars[i] = np.partition(scores, len(scores) - top)[len(scores) - top]
    return bars


def search(
    frame: DataFrame,
    id_column: str,
    vector_column: str,
    is_query: Column,
    top: int,
    score_type: str,
    scorer: Scorer,
    prepare: Callable[[np.ndarray], np.ndarray],
    score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
    numbers_per_query_block: int = NUMBERS_PER_QUERY_BLOCK,
) -> DataFrame:
    """Each query's ``top`` best candidates: query_id, rank (from 1), the id column, score.

    The candidates stay where they are. The queries go to all of them, a block of bounded size at a time: its vectors, and
    for each query a bar that its last result reaches at least (from ``score`` of the block's own rows). A task takes its
    candidates in blocks, too, and ``scorer`` adds each block's to the best so far, which raise the bar for the next. At
    most ``top`` rows a query leave a task. ``prepare`` turns vectors into those that are compared. Higher scores come
    first, ties to the smaller id. Only vectors of the same length are compared. Rows with a null id or an unusable vector
    take no part; of several query rows with one id the smallest vector is searched for; a candidate with the query's own
    id is not one of its candidates; other repeated ids are candidates each. An empty table gives an empty result.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "search")
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))
    queries = rows.where("asks").groupBy("id").agg(F.min_by("vec", F.struct("dim", "vec")).alias("vec"))
    queries = scratch.keep(queries.withColumn("dim", F.size("vec")))
    found_schema = f"query_id long, id long, score {score_type}"
    candidates = spread(rows.select("dim", "id", "vec"))

    def against(asked: np.ndarray, wanted: np.ndarray, bars: np.ndarray):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(bars, top)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def block() -> None:
                ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(ids, kind="stable")
                scorer(ids[order], prepare(vectors[order]), asked, wanted, best)

            for batch in batches:
                for at in range(0, batch.num_rows, candidates_per_block):
                    part = batch.slice(at, candidates_per_block)
                    flat = np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64)
                    held.append((part.column(1).to_numpy(), flat.reshape(part.num_rows, -1)))
                    if sum(len(i) for i, _ in held) >= candidates_per_block:
                        block()
            if held:
                block()
            many = [len(x) for x in best.ids]
            kind = np.int64 if score_type == "long" else np.float64
            scores = np.array([_held_in_long(s) for x in best.scores for s in x] if kind is np.int64 else [s for x in best.scores for s in x], kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked, many), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()), pa.array(scores)],
                names=["query_id", "id", "score"],
            )

        return run

    asking = {r["dim"]: ceil(r["n"] * max(1, r["dim"]) / numbers_per_query_block) for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if max(asking.values(), default=1) > 1:  # a folder for each block, so that a block is read alone
        many = F.create_map(*(F.lit(x) for pair in asking.items() for x in pair))[F.col("dim")]
        queries = scratch.keep(queries.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int")), ["dim", "block"])
    else:
        queries = queries.withColumn("block", F.lit(0))
    parts, kept = [], []
    for dim, many in sorted(asking.items()):
        same = candidates.where(F.col("dim") == dim).select("dim", "id", "vec")
        for block_no in range(many):
            mine = queries.where((F.col("dim") == dim) & (F.col("block") == block_no)).select("id", "vec").toArrow()
            if not mine.num_rows:
                continue
            order = np.argsort(mine["id"].to_numpy(), kind="stable")
            asked = mine["id"].to_numpy()[order]
            flat = np.asarray(mine["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
            wanted = prepare(flat.reshape(len(order), -1)[order])
            parts.append(same.mapInArrow(against(asked, wanted, _first_bars(asked, wanted, top, score)), found_schema))
            if len(parts) == BLOCKS_AT_ONCE:
                kept.append(scratch.keep(_top(_union(parts), top)))
                parts = []
    found = _top(_union([*parts, *kept]), top) if parts or kept else spark.createDataFrame([], f"{found_schema}, rank int")
    return found.select("query_id", "rank", F.col("id").alias(id_column), "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (p.select("query_id", "id", "score") for p in parts))


def _top(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _held_in_long(score: float) -> int:
    return min(max(int(score), -(1 << 63)), (1 << 63) - 1)


# --- exact top-k by the threshold algorithm ---------------------------------------------------------------------------

#: Places of each sorted list that are read first; each later depth is longer by a quarter.
FIRST_DEPTH = 16

#: Once the lists are read so deep that this many times the candidates were met, on average, all are scored.
ALL_MET = 4

#: Integer scores below this are exact in double precision.
EXACT = float(1 << 53)


def depths(count: int) -> np.ndarray:
    """The depths at which the bound is looked at; the last is the lists' length."""
    out = [min(FIRST_DEPTH, count)]
    while out[-1] < count:
        out.append(min(count, out[-1] + max(1, out[-1] // 4)))
    return np.array(out)


def threshold_search(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, wanted: np.ndarray, best: Best) -> int:
    """Fagin's threshold algorithm for the inner product of integer vectors (ids ascending); returns how many scores it took.

    One list per dimension holds the candidates sorted by their value there, made once for all queries. A query reads the
    lists in parallel, from the large end where its component is positive, from the small end where it is negative; each
    candidate met for the first time is scored in full. No candidate yet unseen can score more than the sum, over the
    lists, of the component times the last value read; once that bound is below the bar (the top-th best score so far, in
    other blocks too), reading stops (at an equal bound it goes on, as a candidate with a smaller id may tie).
    """
    count, dim = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    at = depths(count)
    high, low = (np.take_along_axis(vectors, order[x], axis=0) for x in (count - at, at - 1))
    bounds = np.maximum(wanted, 0) @ high.T + np.minimum(wanted, 0) @ low.T
    scored = 0
    for i, (query, q) in enumerate(zip(asked, wanted, strict=True)):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(count, bool)
        own = np.searchsorted(ids, [query, query + 1])
        seen[own[0] : own[1]] = True
        step = 0
        while True:
            enough = np.flatnonzero(bounds[i] < best.bars[i])
            stop = int(enough[0]) if len(enough) else len(at) - 1
            if step > stop or step == len(at):
                break
            depth, lists = at[step], len(up) + len(down)
            if at[step if np.isinf(best.bars[i]) else stop] * lists >= ALL_MET * count or not lists:
                met, step = np.ones(count, bool), len(at)
            else:
                met = np.zeros(count, bool)
                met[order[count - depth :, up]] = True
                met[order[:depth, down]] = True
                step += 1
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scored += len(new)
            scores = vectors[new] @ q if len(new) < count // 2 else (vectors @ q)[new]
            passing = scores >= best.bars[i]
            best.add(i, ids[new[passing]], scores[passing])
    return scored


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024.0 * vectors)


def exact_top_k(frame: DataFrame, id_column: str, vector_column: str, is_query: Column, top: int, **blocks: int) -> DataFrame:
    """The ``top`` largest integer inner products for each query, each component x taken as floor(1024 x).

    See ``search`` for nulls, ties and repeated rows. Products too large for double precision are summed as whole
    numbers; a score outside the range of a long is held at its end.
    """

    def scorer(ids, vectors, asked, wanted, best):  # noqa: ANN001, ANN202
        most = np.abs(vectors).max(initial=0) * np.abs(wanted).max(initial=0) * max(1, vectors.shape[1])
        if most >= EXACT:
            whole = np.vectorize(int, otypes=[object])
            vectors, wanted = (whole(x) if x.size else x.astype(object) for x in (vectors, wanted))
            for i, (query, q) in enumerate(zip(asked, wanted, strict=True)):
                others = np.flatnonzero(ids != query)
                best.add(i, ids[others], vectors[others] @ q)
            return
        threshold_search(ids, vectors, asked, wanted, best)

    def score(vectors, query):  # noqa: ANN001, ANN202
        with np.errstate(over="ignore", invalid="ignore"):  # scores that are not exact are no bar
            exact = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query)) < EXACT
            return np.where(exact, np.einsum("ij,j->i", vectors, query), -np.inf)  # without BLAS, as the driver was forked

    return search(frame, id_column, vector_column, is_query, top, "long", scorer, _integers, score, **blocks)


# --- approximate nearest neighbours by rotated one-bit codes ----------------------------------------------------------

#: Seed of the random rotation; width of the error bound in its standard deviations, as published. On check_l it sends 7.6 %
#: of the candidates to exact comparison at a recall of 0.996 (2.5: 13.8 % and 0.9998; 3.0: 21 % and 1.0).
SEED, WIDTH = 20240521, 1.9


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors scaled by a power of two (which changes no cosine), their lengths, and unit vectors."""
    peak = np.abs(vectors).max(axis=1, initial=0.0)
    scaled = np.ldexp(vectors, -np.frexp(peak)[1][:, None])
    lengths = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled, lengths, scaled / np.where(lengths > 0, lengths, 1.0)[:, None]


def one_bit_index(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and for each the two scalars that correct an estimate: the inner
    product of the vector with its code's unit vector, and the standard deviation of the estimate's error."""
    dim = units.shape[1]
    turned = units @ turn
    fit = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(dim), 1e-12)
    spread = np.sqrt(np.maximum(0.0, 1.0 - fit * fit)) / fit / np.sqrt(max(1, dim - 1))
    return np.packbits(turned > 0, axis=1), fit, spread


def one_bit_estimate(codes: np.ndarray, fit: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimates of the inner products of all coded vectors with one rotated unit query, from bytes of bits and a table
    of the 256 partial sums of each byte."""
    dim = len(turned)
    padded = np.zeros(codes.shape[1] * 8)
    padded[:dim] = turned
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
    sums = padded.reshape(-1, 8) @ bits.T
    total = np.zeros(len(codes))
    for byte, partial in enumerate(sums):
        total += partial[codes[:, byte]]
    return (2.0 * total - turned.sum()) / np.sqrt(dim) / fit


def nearest(
    frame: DataFrame, id_column: str, vector_column: str, is_query: Column, top: int,
    seed: int = SEED, width: float = WIDTH, **blocks: int,
) -> DataFrame:
    """The ``top`` nearest candidates found for each query, by cosine.

    Every vector is indexed: rotated at random and kept as one bit a dimension with two correction scalars; nothing is
    fitted. The candidates with the best estimates of a block are compared exactly, which raises the query's bar. Of the
    others, those whose estimate and error bound (``width`` standard deviations) reach the bar are reranked by the exact
    cosine in double precision on the original vectors. Zero vectors take no part; see ``search`` for the rest.
    """
    some = frame.where(F.exists(vector_column, lambda x: x != 0))

    def scorer(ids, vectors, asked, wanted, best):  # noqa: ANN001, ANN202
        one_bit_search(ids, vectors, asked, wanted, best, seed, width)

    def score(vectors, query):  # noqa: ANN001, ANN202
        return cosines(*unit(vectors)[:2], *(x[0] for x in unit(query[None])[:2]))

    return search(some, id_column, vector_column, is_query, top, "double", scorer, lambda x: x, score, **blocks)


def cosines(scaled: np.ndarray, lengths: np.ndarray, ask: np.ndarray, ask_length: float) -> np.ndarray:
    return (scaled * ask).sum(axis=1) / (lengths * ask_length)


def one_bit_search(
    ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, wanted: np.ndarray, best: Best, seed: int = SEED, width: float = WIDTH
) -> int:
    """Adds a block's candidates to the best; returns how many were compared exactly."""
    turn = rotation(vectors.shape[1], seed)
    scaled, lengths, units = unit(vectors)
    codes, fit, spread_ = one_bit_index(units, turn)
    asks, ask_lengths, ask_units = unit(wanted)
    turned = ask_units @ turn
    error = width * spread_
    compared = 0
    for i, query in enumerate(asked):
        estimate = one_bit_estimate(codes, fit, turned[i])
        own = np.searchsorted(ids, [query, query + 1])
        estimate[own[0] : own[1]] = -np.inf
        upper = estimate + error
        first = np.argpartition(-estimate, best.top)[: best.top] if len(estimate) > best.top else np.arange(len(estimate))
        first = first[estimate[first] > -np.inf]
        exact = cosines(scaled[first], lengths[first], asks[i], ask_lengths[i])
        before = best.bars[i]
        best.add(i, ids[first], exact)
        upper[first] = -np.inf
        more = np.flatnonzero((upper >= max(before, best.bars[i])) & (estimate > -np.inf))
        exact = cosines(scaled[more], lengths[more], asks[i], ask_lengths[i])
        passing = exact >= best.bars[i]
        best.add(i, ids[more[passing]], exact[passing])
        compared += len(first) + len(more)
    return compared


# --- queries ----------------------------------------------------------------------------------------------------------


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of each vector whose id is divisible by 100, against all others."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_top_k(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of each vector whose id is divisible by 50, against all others."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


OP3_SQL = """
WITH usable AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM usable
), whole AS (
  SELECT vec_id, d, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
