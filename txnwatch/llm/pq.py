"""Embedding near-duplicates by product quantisation.

Equal vectors are one class first. A bounded sample trains coarse centroids and, on residuals, a
code book per subspace. Every class is put into the inverted list of its nearest centroid with
its residual codes and the length of what the codes leave out. As a query, it probes the
``max_probes`` nearest of the lists that can hold a vector within the cosine (for unit vectors
within distance r, the query is at most r beyond the plane between the two centroids). A link is
found if either end probes the other's list, and counts for both. In a list, table-lookup
(asymmetric) distances to the codes discard vectors that are out of reach even by the left-out
length, a strict bound, and exact cosines in double precision settle the rest. So links can be
lost to the number of probes only; with ``max_probes`` of None none are.

Lists are cut into blocks of at most about ``block`` vectors on either side, so a list with a
third of all vectors is many tasks. A block gives counts per vector and at most one tree of
links over its members, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.links import components
from txnwatch.llm.tables import kept

SLACK = 1e-9


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids (lists x dimensions) and code books (subspaces x codes x width)."""

    centroids: np.ndarray
    books: np.ndarray

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width).swapaxes(0, 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest list, residual codes and length of what they leave out."""
        lists = squared(x, self.centroids).argmin(axis=1)
        parts = self.parts(x - self.centroids[lists])
        codes = np.stack([squared(p, b).argmin(axis=1) for p, b in zip(parts, self.books)], axis=1)
        left = sum(
            ((p - b[codes[:, j]]) ** 2).sum(axis=1) for j, (p, b) in enumerate(zip(parts, self.books))
        )
        return lists, codes.astype(np.uint8), np.sqrt(left)

    def probes(self, x: np.ndarray, reach: float, most: int | None = None) -> Iterator[np.ndarray]:
        """Of each vector, the nearest ``most`` lists (or all) that can hold one within
        ``reach`` of it; the first is its own."""
        far = squared(x, self.centroids)
        home = far.argmin(axis=1)
        apart = np.sqrt(squared(self.centroids, self.centroids))
        for i, h in enumerate(home):
            near = far[i] - far[i, h] <= 2 * (reach + SLACK) * apart[h] + SLACK
            near[h] = False
            others = np.flatnonzero(near)
            yield np.concatenate([[h], others[np.argsort(far[i, others], kind="stable")]])[:most]

    def tables(self, q: np.ndarray, number: int) -> np.ndarray:
        """Squared distance of each query's residual part to each code (subspace, query, code)."""
        return np.stack([squared(p, b) for p, b in zip(self.parts(q - self.centroids[number]), self.books)])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None]
    return np.maximum(gap, 0)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; an empty cluster keeps its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def train(sample: np.ndarray, lists: int, subspaces: int, codes: int, seed: int = 9) -> Quantiser:
    rng = np.random.default_rng(seed)
    centroids = _means(sample, lists, 8, rng)
    subspaces = min(subspaces, sample.shape[1])
    width = -(-sample.shape[1] // subspaces)
    blank = Quantiser(centroids, np.zeros((subspaces, 1, width)))
    residual = sample - centroids[squared(sample, centroids).argmin(axis=1)]
    books = [_means(p, codes, 8, rng) for p in blank.parts(residual)]
    return Quantiser(centroids, np.stack(books))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their scale."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame, dimensions: int | None) -> DataFrame:
    """(rep, n, embedding) of the different usable vectors; rep is the smallest vec_id."""
    sound = (
        F.size("embedding").__gt__(0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    usable = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    usable = usable.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))
    if dimensions is None:
        common = (
            usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        )
        dimensions = common[0] if common else 0
    usable = usable.where(F.size("embedding") == dimensions)
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def near_duplicates(
    vectors: DataFrame,
    min_cosine: float = 0.9,
    dimensions: int | None = None,
    max_train: int = 20_000,
    max_lists: int = 1024,
    max_probes: int | None = 16,
    subspaces: int = 16,
    codes: int = 64,
    block: int = 2048,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts other vectors with a cosine of ``min_cosine`` (positive) or more;
    component_id is the smallest vec_id that links reach, kept tells whether it is the vector's
    own. Vectors that are null, empty, zero, of another length than ``dimensions`` (default: the
    most common) or with null or non-finite components link with nothing, as do rows without
    vec_id, whose component_id and kept are null. Rows that repeat a vec_id are linked as vectors
    of their own under one id. At most ``max_train`` vectors, those with the smallest hash of
    their id, train the quantiser; all are indexed. With a bounded ``max_probes``, links of vectors
    that are many lists apart may be missed; none is reported below ``min_cosine``. Other columns are not read. An empty table
    gives an empty result.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be positive and at most 1")
    vectors = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    found = kept(classes(vectors, dimensions), "vector-classes")
    total = found.count()
    if not total:
        return vectors.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.when(F.col("vec_id").isNotNull(), True).alias("kept"),
        )
    sample = found.select("rep", "embedding").orderBy(F.xxhash64("rep")).limit(max_train).toPandas()
    sample = unit(np.stack(sample.sort_values("rep")["embedding"].to_numpy()))
    quantiser = train(sample, int(min(max_lists, max(1, total**0.5))), subspaces, codes)
    reach = float(np.sqrt(2 - 2 * min_cosine))
    indexed = kept(_indexed(found, quantiser, reach, max_probes), "vector-lists")
    cuts = _cuts(indexed, block)
    sides = _sides(indexed, cuts)
    out = sides.groupBy("list", "base_cut", "query_cut").applyInPandas(
        _block(quantiser, min_cosine, reach), "a long, b long, n long"
    )
    out = kept(out, "vector-links")
    counts = out.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    roots = components(out.where("b IS NOT NULL").select("a", "b"))
    by_class = (
        found.join(counts, "rep", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            "embedding",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    keyed = vectors.withColumn("key", F.transform("embedding", lambda x: x + F.lit(0.0)))
    joined = keyed.join(by_class.withColumnRenamed("embedding", "key"), "key", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "vec_id"))
    return joined.select(
        "vec_id",
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def _indexed(
    found: DataFrame, quantiser: Quantiser, reach: float, max_probes: int | None
) -> DataFrame:
    """(rep, n, list, probes, vector, codes, left) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            raw = np.ascontiguousarray(raw, np.float64).reshape(batch.num_rows, -1)
            x = unit(raw)
            lists, codes, left = quantiser.encode(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(lists, pa.int32()),
                    pa.array([p.astype(np.int32) for p in quantiser.probes(x, reach, max_probes)], pa.list_(pa.int32())),
                    pa.array([v.tobytes() for v in raw], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(left),
                ],
                ["rep", "n", "list", "probes", "vector", "codes", "left"],
            )

    schema = "rep long, n long, list int, probes array<int>, vector binary, codes binary, left double"
    return found.select("rep", "n", "embedding").mapInArrow(run, schema)


def _cuts(indexed: DataFrame, block: int) -> DataFrame:
    """Number of blocks each list's vectors (base) and queries are cut into; a row per list."""
    base = indexed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("base_cuts"))
    asks = indexed.select(F.explode("probes").alias("list")).groupBy("list")
    queries = asks.agg(F.ceil(F.count("*") / block).cast("int").alias("query_cuts"))
    return F.broadcast(base.join(queries, "list"))  # at most max_lists rows


def _sides(indexed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every vector once for each block that holds it and once for each block it asks."""

    def own(salt: str, n: str) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    payload = ["rep", "n", "vector", "codes", "left"]
    base = indexed.select("list", "probes", *payload).join(cuts, "list")
    base = base.select(
        "list", own("base", "base_cuts").alias("base_cut"), every("query_cuts").alias("query_cut"),
        F.lit(False).alias("asks"), F.lit(None).cast("int").alias("home"), "probes", *payload,
    )
    queries = indexed.select(F.explode("probes").alias("list"), F.col("list").alias("home"), *payload).join(cuts, "list")
    queries = queries.select(
        "list", every("base_cuts").alias("base_cut"), own("query", "query_cuts").alias("query_cut"),
        F.lit(True).alias("asks"), "home", F.lit(None).cast("array<int>").alias("probes"),
        "rep", "n", "vector",
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left"),
    )
    return base.unionByName(queries)


def _block(quantiser: Quantiser, min_cosine: float, reach: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["list"].iloc[0])
        base, asks = rows[~rows["asks"]], rows[rows["asks"]]
        if not len(base) or not len(asks):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        vectors = unit(np.stack([np.frombuffer(v) for v in base["vector"]]))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in base["codes"]])
        limit = (reach + base["left"].to_numpy(float) + SLACK) ** 2 + SLACK
        ids, sizes = base["rep"].to_numpy(np.int64), base["n"].to_numpy(np.int64)
        asked = unit(np.stack([np.frombuffer(v) for v in asks["vector"]]))
        askers, asker_sizes = asks["rep"].to_numpy(np.int64), asks["n"].to_numpy(np.int64)
        homes = asks["home"].to_numpy(np.int64)
        probed = np.zeros((len(ids), len(quantiser.centroids)), bool)
        for i, lists in enumerate(base["probes"]):
            probed[i, lists] = True
        one_way = np.zeros(len(ids), np.int64)
        group = np.arange(len(ids))
        a, b, n = [], [], []
        for start in range(0, len(asked), 256):
            q, q_ids = asked[start : start + 256], askers[start : start + 256]
            tables = quantiser.tables(q, number)
            far = sum(t[:, codes[:, j]] for j, t in enumerate(tables))
            qi, xi = np.nonzero(far <= limit[None])
            other = q_ids[qi] != ids[xi]
            qi, xi = qi[other], xi[other]
            close = np.einsum("ij,ij->i", q[qi], vectors[xi]) >= min_cosine
            qi, xi = qi[close], xi[close]
            counts = np.bincount(qi, sizes[xi], len(q)).astype(np.int64)
            hit = np.flatnonzero(counts)
            # a link that only this side finds counts for the other one here
            alone = ~probed[xi, homes[start + qi]]
            one_way += np.bincount(xi[alone], asker_sizes[start + qi[alone]], len(ids)).astype(np.int64)
            a.extend(q_ids[hit])
            b.extend([None] * len(hit))
            n.extend(counts[hit])
            cut = np.searchsorted(qi, np.arange(len(q) + 1))
            for i in hit:
                linked = xi[cut[i] : cut[i + 1]]
                met, first = np.unique(group[linked], return_index=True)
                for at in first:  # one link to each tree met; they are one tree from here on
                    a.append(q_ids[i])
                    b.append(ids[linked[at]])
                    n.append(0)
                if len(met) > 1:
                    group[np.isin(group, met)] = met[0]
        met_only = np.flatnonzero(one_way)
        a.extend(ids[met_only])
        b.extend([None] * len(met_only))
        n.extend(one_way[met_only])
        return pd.DataFrame(
            {"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array(n, "Int64")}
        )

    return run
