"""Exact top-k inner products with KD-trees per shard of space.

Space is cut into cells by medians of a sample, and the rows of a cell into shards of bounded size. Each shard is split at
medians of its widest dimension into a tree whose nodes keep tight bounding boxes, once. A query walks a tree best-first: the
inner product can't exceed the sum, over dimensions, of the better of the box's two sides, and the walk ends when that bound
falls below the kth score found. Each query first searches a shard of the cell with the best bound; its kth score then goes
with it to the shards of those cells alone whose bound reaches it.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import mix, staged, table

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 16384, 8192, 64
#: Cells of space for each width, and how many components the sample that fits them has at most (twice as many are drawn at worst).
MOST_CELLS, SAMPLE_VALUES = 512, 1 << 20


class KDTree:
    """Median splits over whole-number vectors; rows are permuted so that each node is a run of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        spans, self.children, low, high, least = [(0, len(ids))], [], [], [], []
        at = 0
        while at < len(spans):
            lo, hi = spans[at]
            own = vectors[order[lo:hi]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            least.append(ids[order[lo:hi]].min())
            wide = high[-1] - low[-1]
            if hi - lo > leaf and wide.any():
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(wide.argmax())], mid)]
                self.children.append((len(spans), len(spans) + 1))
                spans += [(lo, lo + mid), (lo + mid, hi)]
            else:
                self.children.append(None)
            at += 1
        self.spans, self.ids, self.vectors = spans, ids[order], vectors[order]
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each query could have in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, kth: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Up to k best (scores, ids), ties to smaller ids; ``kth`` is a (score, id) that a result has to beat, if known."""
        scores, ids = np.zeros(0, self.vectors.dtype), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and (-bound < kth[0] or (-bound == kth[0] and self.least[node] > kth[1])):
                if -bound < kth[0]:
                    break
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.spans[node]
            found = self.vectors[lo:hi] @ query
            keep = self.ids[lo:hi] != own
            if kth is not None:
                keep &= found >= kth[0]
            if keep.any():
                scores, ids = np.concatenate((scores, found[keep])), np.concatenate((ids, self.ids[lo:hi][keep]))
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(ids) == k and (kth is None or (-scores[-1], ids[-1]) < (-kth[0], kth[1])):
                    kth = (scores[-1], ids[-1])
        return scores, ids


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), np.int64)


def _exact(data: np.ndarray) -> np.ndarray:
    """Whole numbers, as doubles where every inner product is exact in them."""
    most = float(np.abs(data).max(initial=0))
    return data.astype(np.float64) if most * most * max(1, data.shape[1]) < 2.0**52 else data


@dataclass(frozen=True)
class Cells:
    """Median splits of space, fitted on a sample: inner nodes have a dimension, a cut and two children, leaves a cell."""

    dimension: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    cell: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, most: int) -> Cells:
        nodes, leaves, open_ = [[0, 0, 0, 0, 0]], 1, [(0, np.arange(len(sample)))]
        while open_ and leaves < most:
            at, own = open_.pop(0)  # breadth first, so that cells are of like size
            part = sample[own]
            wide = int(part.var(axis=0).argmax()) if len(part) else 0
            cut = float(np.median(part[:, wide])) if len(part) else 0.0
            right = part[:, wide] > cut
            if not right.any() and len(part):
                cut, right = float(part[:, wide].max()) - 1, part[:, wide] == part[:, wide].max()
            if not right.any() or right.all():
                continue  # all alike
            nodes[at][:4] = [wide, cut, len(nodes), len(nodes) + 1]
            open_ += [(len(nodes), own[~right]), (len(nodes) + 1, own[right])]
            nodes += [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
            leaves += 1
        table_ = np.array(nodes, float)
        cell = np.cumsum(table_[:, 2] == 0) - 1
        return cls(table_[:, 0].astype(int), table_[:, 1], table_[:, 2:4].astype(int), cell)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(vectors), int), np.arange(len(vectors))
        while (inner := self.child[node, 0] > 0).any():
            right = vectors[rows[inner], self.dimension[node[inner]]] > self.cut[node[inner]]
            node[inner] = self.child[node[inner], right.astype(int)]
        return self.cell[node]


def _grouped(widths: np.ndarray):
    """Row numbers by width."""
    return ((int(w), np.flatnonzero(widths == w)) for w in np.unique(widths))


def _assigned(cells: dict[int, Cells]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = np.zeros(len(frame), np.int64)
            for width, at in _grouped(frame["width"].to_numpy()):
                if width in cells:
                    cell[at] = cells[width].of(_matrix(frame["vec"].iloc[at]))
            yield frame.assign(cell=cell)

    return run


def _boxed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one task's rows the box and number of rows of each cell."""
    found: dict[tuple[int, int], list] = {}
    for frame in frames:
        for width, at in _grouped(frame["width"].to_numpy()):
            data, cells = _matrix(frame["vec"].iloc[at]), frame["cell"].to_numpy()[at]
            for cell in np.unique(cells):
                own = cells == cell
                low, high, n = data[own].min(axis=0), data[own].max(axis=0), int(own.sum())
                if (width, int(cell)) in found:
                    was = found[width, int(cell)]
                    low, high, n = np.minimum(was[0], low), np.maximum(was[1], high), was[2] + n
                found[width, int(cell)] = [low, high, n]
    rows = [(w, c, low.tolist(), high.tolist(), n) for (w, c), (low, high, n) in found.items()]
    yield pd.DataFrame(rows, columns=["width", "cell", "low", "high", "n"])


@dataclass(frozen=True)
class Boxes:
    """The cells of one width: their boxes and numbers of shards."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each query could have in each cell, a little above where it is not exact."""
        q, low, high = queries.astype(float), self.low.astype(float), self.high.astype(float)
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        return out + np.abs(out) * 1e-9


def _shard_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


_ROUTED = "id long, vec array<long>, width int, kth_score long, kth_id long, cell long, part long"


def _routed(boxes: dict[int, Boxes], first: bool):
    """Queries with the shards they search: at ``first`` one of the cell with the best bound, else all others that can hold better ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, at in _grouped(frame["width"].to_numpy()):
                box, ids = boxes[width], frame["id"].to_numpy(np.int64)[at]
                for lo in range(0, len(at), 1024):
                    rows, own = frame.iloc[at[lo : lo + 1024]], ids[lo : lo + 1024]
                    limits = box.bounds(_matrix(rows["vec"]))
                    best = limits.argmax(axis=1)
                    home = _shard_of(own, box.parts[best])
                    if first:
                        yield rows.assign(cell=box.cell[best], part=home)
                        continue
                    score = rows["kth_score"].to_numpy(float, na_value=-np.inf)
                    query, place = np.nonzero(limits >= score[:, None])  # ties by id are the tree's to decide
                    times = box.parts[place]
                    query, place = np.repeat(query, times), np.repeat(place, times)
                    part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
                    keep = ~((place == best[query]) & (part == home[query]))
                    yield rows.iloc[query[keep]].assign(cell=box.cell[place[keep]], part=part[keep])

    return run


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    tree = KDTree(frame["id"].to_numpy(np.int64), _exact(_matrix(frame["vec"])))
    return pd.DataFrame({"width": frame["width"].iloc[:1], "cell": frame["cell"].iloc[:1], "part": frame["part"].iloc[:1], "tree": [pickle.dumps(tree)]})


_FOUND = "query_id long, vec_id long, score long"


def _searching(k: int):
    def run(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        query, found, scores = [], [], []
        if len(trees) and len(asked):
            tree = pickle.loads(trees["tree"].iloc[0])
            queries, ids = _matrix(asked["vec"]), asked["id"].to_numpy(np.int64)
            if not np.issubdtype(tree.vectors.dtype, np.integer):
                exact = _exact(np.vstack((queries, tree.high.astype(np.int64), tree.low.astype(np.int64))))
                queries = exact[: len(queries)]
                if np.issubdtype(exact.dtype, np.integer):
                    tree.vectors, tree.low, tree.high = (x.astype(np.int64) for x in (tree.vectors, tree.low, tree.high))
            known = asked["kth_score"].notna().to_numpy()
            kth = list(zip(asked["kth_score"].fillna(0).astype("int64"), asked["kth_id"].fillna(0).astype("int64"), strict=True))
            for lo in range(0, len(queries), 256):
                for i, bounds in enumerate(tree.bounds(queries[lo : lo + 256]), lo):
                    best, at = tree.search(queries[i], bounds, int(ids[i]), k, kth[i] if known[i] else None)
                    query.append(np.full(len(at), ids[i]))
                    found.append(at)
                    scores.append(best.astype(np.int64))
        parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (query, found, scores)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, most_cells: int = MOST_CELLS) -> DataFrame:
    """The k highest inner products of each query row with every other row: (query_id, rank, vec_id, score).

    Components become floor(scale * x). ``is_query`` is a condition on ``id``. Rows whose id or vector is null, or whose
    vector is empty or holds a null or non-finite component, take no part, nor do those whose scaled length squared reaches
    2**62, as their products don't fit a long. Vectors of different length are never compared. Fewer than k rows give fewer
    results; ties go to the smaller id. A query never finds rows of its own id; of rows that repeat an id each is a candidate,
    and its distinct vectors are queries that share their k results. An empty table gives no rows; other columns are not read.

    Cells of space are fitted on a sample of at most ``SAMPLE_VALUES`` components; every row is dealt to them, and the rows of
    a cell to shards of about ``shard_rows`` by a hash of the id, so no group of equal vectors is one task. A tree is built
    once for each shard. Only cells, at most ``most_cells`` for each width, are known to the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * scale, F.lit(2.0)))
    rows = rows.where(square < 2.0**62).select("id", F.transform("vec", lambda x: F.floor(x.cast("double") * scale)).alias("vec")).withColumn("width", F.size("vec")).where("width > 0")
    n, widest = rows.agg(F.count("*"), F.max("width")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = max(64, SAMPLE_VALUES // widest)
    share = min(1.0, drawn / n)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select("width", "vec").limit(2 * drawn).toPandas()
    want = max(1, min(most_cells, math.ceil(n / shard_rows)))
    cells = {w: Cells.fit(_matrix(sample["vec"].iloc[at]), want) for w, at in _grouped(sample["width"].to_numpy())}
    rows = staged(rows.mapInPandas(_assigned(cells), "id long, vec array<long>, width int, cell long"), "topk-cells")

    told = rows.mapInPandas(_boxed, "width int, cell long, low array<long>, high array<long>, n long")
    boxes = _gathered_boxes(told, shard_rows)
    parts = spark.createDataFrame([(w, int(c), int(p)) for w, b in boxes.items() for c, p in zip(b.cell, b.parts, strict=True)], "width int, cell long, parts long")
    dealt = rows.join(F.broadcast(parts), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    trees = staged(dealt.groupBy("width", "cell", "part").applyInPandas(_built, "width int, cell long, part long, tree binary"), "topk-trees")

    asked = rows.where(is_query).select("id", "vec", "width").dropDuplicates(["id", "vec"])
    blocks = max(1, math.ceil(asked.count() / block_queries))
    key = ["width", "cell", "part", "block"]

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        routed = queries.mapInPandas(_routed(boxes, first), _ROUTED).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
        used = trees.join(routed.select(*key).distinct(), key[:3])
        routed = routed.select(*(F.col(c).alias(c) for c in routed.columns))  # columns of its own beside those of used
        return used.groupBy(*key).cogroup(routed.groupBy(*key)).applyInPandas(_searching(k), _FOUND)

    unknown = F.lit(None).cast("long")
    home = staged(_best(searched(asked.withColumns({"kth_score": unknown, "kth_id": unknown}), True), k), "topk-home")
    kth = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
    far = searched(asked.join(kth, "id", "left").select("id", "vec", "width", "kth_score", "kth_id"), False)
    return _best(home.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", "rank", "vec_id", "score")


def _gathered_boxes(told: DataFrame, shard_rows: int) -> dict[int, Boxes]:
    """The boxes of all cells, merged over tasks: one row for each cell and dimension comes to the driver."""
    counts = {(r["width"], r["cell"]): r["n"] for r in told.groupBy("width", "cell").agg(F.sum("n").alias("n")).collect()}
    zipped = told.select("width", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
    sides = zipped.groupBy("width", "cell", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high")).toPandas()
    out = {}
    for width, rows in sides.groupby("width"):
        rows = rows.sort_values(["cell", "at"])
        cell = rows["cell"].to_numpy(np.int64)[:: int(width)]
        low, high = (rows[c].to_numpy(np.int64).reshape(len(cell), -1) for c in ("low", "high"))
        n = np.array([counts[width, c] for c in cell])
        out[int(width)] = Boxes(cell, low, high, -(-n // shard_rows))
    return out


def op5_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every vector whose id 100 divides, against all; nulls, ties, repeats and empty tables as in ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
