"""Approximate nearest neighbours (operator 6) by collision counting.

Vectors are dealt at random into blocks of bounded size. Each block keeps one sorted array per random projection of its
normalised vectors. A query opens a window around its own projection on every array; virtual rehashing widens all windows
by a factor, round by round, and only newly entered positions add to the vectors' collision counts. Once
enough vectors exceed the collision threshold, these are verified by their exact cosine. The best of each block meet
in a small per-query top-k.

Queries come in blocks as well, so a task holds one block of vectors and one of queries, whatever the table's size.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length than the
query's are not compared with it; null ids take no part; repeated rows are candidates each, but rows of the query's own id are none; rows of one query id with different vectors are
a search each (ranks begin anew), equal ones are one search; ties go to the smaller id; vectors of
very small or large components are scaled by powers of two, which leaves their cosines as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block, about.
BLOCK = 8192
QUERY_BLOCK = 1024
PROJECTIONS = 64
#: Share of the projections on which a vector must collide.
COLLISIONS = 0.6
#: Share of a block's vectors (and at least MANY) that are to exceed it before the search of the block ends.
VERIFIED = 0.22
MANY = 64
WIDEN = 1.15
SEED = 11


def lines(dims: int, n: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(dims, n))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Block:
    """Single-projection sorted arrays of a block's vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.vectors = vectors
        self.unit = unit(vectors)
        self.lines = lines(vectors.shape[1], projections)
        shadow = self.unit @ self.lines
        self.order = np.argsort(shadow, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(shadow.T, self.order, axis=1)
        self.first_width = float(np.median(np.abs(shadow))) if len(vectors) else 1.0

    def candidates(self, query: np.ndarray, k: int, collisions: float = COLLISIONS, verified: float = VERIFIED) -> np.ndarray:
        """Positions of the vectors above the collision threshold when the search ends, or all if the block is small."""
        n, m = len(self.vectors), len(self.order)
        enough = min(n, max(k, MANY, int(verified * n)))
        if enough >= n:
            return np.arange(n)
        at = unit(query[None])[0] @ self.lines
        counts = np.zeros(n, np.int64)
        left = [int(np.searchsorted(self.sorted[j], at[j])) for j in range(m)]
        right = list(left)
        need = int(np.ceil(collisions * m))
        width = self.first_width
        while True:
            entered = []
            for j in range(m):
                a, b = self.sorted[j].searchsorted((at[j] - width, at[j] + width)).tolist()
                entered += [self.order[j, a : left[j]], self.order[j, right[j] : b]]
                left[j], right[j] = a, b
            counts += np.bincount(np.concatenate(entered), minlength=n)
            found = np.flatnonzero(counts >= need)
            if len(found) >= enough:
                return found
            width *= WIDEN

    def nearest(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest found; the vector of the query's own id is left out."""
        at = self.candidates(query, k + 1)
        at = at[ids[at] != own]
        score = cosine(query, self.vectors[at])
        best = np.lexsort((ids[at], -score))[:k]
        return ids[at][best], score[best]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that their largest component is near 1: cosines stay what they are to the last bit, and no norm under- or overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, each pair by the same sums whatever the block."""
    dot = (vectors * query).sum(axis=1)
    return dot / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        marks = table["mark"].to_numpy()
        ids = table["vec_id"].to_numpy()
        dims = np.diff(table["vec"].combine_chunks().offsets.to_numpy())
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(dims)])
        out = []
        for d in np.unique(dims):
            mine = np.flatnonzero((dims == d) & ~is_query)
            asked = np.flatnonzero((dims == d) & is_query)
            if not len(mine) or not len(asked):
                continue
            take = lambda rows: scaled(flat[(starts[rows][:, None] + np.arange(d)).reshape(-1)].reshape(len(rows), d))  # noqa: B023, E731
            mine = mine[np.argsort(ids[mine], kind="stable")]
            block = Block(take(mine))
            for q, mark, v in zip(ids[asked].tolist(), marks[asked].tolist(), take(asked), strict=True):
                found, score = block.nearest(v, ids[mine], q, k)
                out.append((np.full(len(found), q), np.full(len(found), mark), found, score))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(4)]
        return pa.Table.from_arrays([*[pa.array(c.astype(np.int64)) for c in cols[:3]], pa.array(cols[3].astype(np.float64))], ["query_id", "mark", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the vectors that take part, in double precision."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null")
    return base.where(finite & F.exists("vec", lambda x: x != 0.0))


def search(vectors: DataFrame, queries, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every vector for which the condition ``queries`` (on vec_id) holds, its k nearest found."""
    base = usable(vectors, key, column)
    n, asked = base.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
    theirs = base.select(block.alias("block"), every(query_blocks).alias("query_block"), F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("mark"), "vec_id", "vec")
    # The mark tells different vectors of one query id apart.
    ours = base.where(queries).withColumn("mark", F.xxhash64("vec")).dropDuplicates(["vec_id", "mark"]).select(every(blocks).alias("block"), query_block.alias("query_block"), F.lit(True).alias("is_query"), "mark", "vec_id", "vec")
    pairs = theirs.unionByName(ours)
    found = pairs.groupBy("block", "query_block").applyInArrow(_search(k), "query_id long, mark long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
