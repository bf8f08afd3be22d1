"""Centroid clustering of vectors in exact integers, with Hamerly's bounds.

Components become integers ``floor(scale * x)``. Each vector keeps its cluster, one upper bound of the distance to its own centroid and
one lower bound of the distance to any other. When centroids have moved, the bounds are loosened by their drift; only where they
no longer tell clusters apart (and half the gap to the next centroid doesn't either) is the own distance taken anew, and where that doesn't
decide, all centroids are scanned in integers, ties going to the smaller number. Bounds are rounded outward, so they decide nothing wrongly.

A round is one pass over the table of the round before, with no shuffle of vectors: rows are written with new bounds, and the task adds one row with the sums of
what changed its cluster. Those sums travel in limbs of 40 bits, so they are exact at any size; what comes to the driver has ``k * (components + 1)`` sums at most.

Defined results: vectors with a null, a non-finite component, another number of components, or one beyond 2 ** 1017 (whose scaled value
isn't finite) are left out; repeated rows count each; a null id hashes as an empty one; of equal hashes the smaller vector is the earlier
centroid; fewer vectors than ``k`` give as many centroids; columns beyond id and vector are ignored; an empty table gives an empty result. A distance or inertia beyond a long is
null, clusters are exact all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, stored
from .words import trim

LIMB = 40
#: Relative slack of the bounds, far above what a few roundings lose.
SLACK = 1e-12
#: Rows handled at once.
ROWS = 4096
_LONG = 1 << 63


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """``id`` and ``x`` (doubles) of the vectors that take part."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda v: v.cast("double"))
    fine = (F.size("x") == dims) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 2.0**1017))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))


def _exact_bound(dims: int) -> int:
    """Below this, squared distances of integer vectors fit in 62 bits."""
    return 1 << ((62 - math.ceil(math.log2(max(dims, 2)))) // 2 - 1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to each row of c, in the integers of both."""
    out = np.empty((len(x), len(c)), x.dtype if x.dtype == c.dtype else object)
    for j in range(len(c)):
        diff = x - c[j]
        out[:, j] = (diff * diff).sum(axis=1)
    return out


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as doubles, rounded away from the truth on the safe side."""
    if squares.dtype == object:
        roots = np.array([float(math.isqrt(int(s)) + up) for s in squares], float)
    else:
        roots = np.sqrt(squares.astype(float))
    return roots * (1 + SLACK) if up else roots * (1 - SLACK)


class Centres:
    """Centroids as Python integers, with what a pass needs of them: how far each moved, and half the gap to the nearest other."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows = rows
        dims = len(rows[0]) if rows else 0
        small = all(abs(v) < _exact_bound(dims) for r in rows for v in r)
        self.exact = np.array(rows, np.int64 if small else object).reshape(len(rows), dims)
        moved = [sum((a - b) ** 2 for a, b in zip(r, o, strict=True)) for r, o in zip(rows, before or rows, strict=True)]
        self.drift = _root(np.array(moved, object), True) * np.array([m > 0 for m in moved]) if rows else np.empty(0)
        self.gap = np.full(len(rows), np.inf)
        for i, r in enumerate(rows):
            others = [sum((a - b) ** 2 for a, b in zip(r, o, strict=True)) for j, o in enumerate(rows) if j != i]
            if others:
                self.gap[i] = _root(np.array([min(others)], object), False)[0] / 2
        most = np.argsort(-self.drift)
        self.others = np.array([self.drift[most[1]] if len(rows) > 1 and i == most[0] else (self.drift[most[0]] if len(rows) > 1 else 0.0) for i in range(len(rows))])


def _integers(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer rows: 64-bit ones, and Python integers where those might not do."""
    big = (np.abs(x) >= _exact_bound(x.shape[1])).any(axis=1)
    parts = [(np.flatnonzero(~big), x[~big].astype(np.int64))]
    if big.any():
        parts.append((np.flatnonzero(big), np.array([[int(v) for v in r] for r in x[big]], object)))
    return [p for p in parts if len(p[0])]


def _assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray, centres: Centres) -> None:
    """New clusters and bounds of integer rows, in place."""
    old = np.flatnonzero(cluster >= 0)
    upper[old] = (upper[old] + centres.drift[cluster[old]]) * (1 + SLACK)
    lower[old] = np.maximum(0.0, (lower[old] - centres.others[cluster[old]]) * (1 - SLACK))
    fence = np.maximum(lower[old], centres.gap[cluster[old]])
    unsure = old[~(upper[old] < fence)]
    if len(unsure):
        own = x[unsure] - centres.exact[cluster[unsure]]
        upper[unsure] = _root((own * own).sum(axis=1), True)
        unsure = unsure[~(upper[unsure] < np.maximum(lower[unsure], centres.gap[cluster[unsure]]))]
    scan = np.concatenate((np.flatnonzero(cluster < 0), unsure))
    if not len(scan):
        return
    d = _distances(x[scan], centres.exact)
    nearest = d.argmin(axis=1)
    cluster[scan] = nearest
    upper[scan] = _root(d[np.arange(len(scan)), nearest], True)
    if d.shape[1] > 1:
        rest = d.copy()
        rest[np.arange(len(scan)), nearest] = rest.max() + 1
        lower[scan] = _root(rest.min(axis=1), False)
    else:
        lower[scan] = np.inf
    scans[scan] += 1


def _limbs(value: int) -> list[int]:
    """value as limbs of LIMB bits, the last one signed."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class Moves:
    """Sums and counts of the rows that joined each cluster, less those that left it."""

    def __init__(self, k: int, dims: int):
        self.sums, self.counts = np.zeros((k, dims), object), np.zeros(k, np.int64)

    def add(self, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        moved = np.flatnonzero(before != after)
        for sign, to in ((1, after), (-1, before)):
            rows = moved[to[moved] >= 0]
            for j in np.unique(to[rows]):
                mine = rows[to[rows] == j]
                self.sums[j] += sign * x[mine].sum(axis=0).astype(object)
                self.counts[j] += sign * len(mine)

    def limbs(self) -> list[dict]:
        """Sums by cluster, component (the count last) and limb."""
        values = [(j, p, int(v)) for j, row in enumerate(self.sums) for p, v in enumerate([*row, self.counts[j]]) if v]
        return [{"cluster": j, "component": p, "limb": i, "value": v} for j, p, value in values for i, v in enumerate(_limbs(value)) if v]


_MOVED = "array<struct<cluster:int,component:int,limb:int,value:long>>"


def _pass(state: DataFrame, centres: Centres, dims: int, scale: int, first: bool, last: bool) -> DataFrame:
    """One assignment of all vectors: rows with new bounds (and distances in the last), and a row of sums a task."""
    k = len(centres.rows)
    sent = state.select("id", "x", *([] if first else ["cluster", "upper", "lower", "scans"]))
    schema = StructType([sent.schema["id"], sent.schema["x"], *StructType.fromDDL(f"cluster int, upper double, lower double, scans int, distance long, moved {_MOVED}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, moves = to_arrow_schema(schema), Moves(k, dims)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                x = np.asarray(batch.column("x").flatten(), float).reshape(n, dims)
                if first:
                    x = np.floor(scale * x)
                    cluster, upper, lower, scans = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
                else:
                    cluster, upper, lower, scans = (np.array(batch.column(c)) for c in ("cluster", "upper", "lower", "scans"))
                before, distance = cluster.copy(), [None] * n
                for rows, ints in _integers(x):
                    part = [a[rows] for a in (cluster, upper, lower, scans)]
                    _assign(ints, *part, centres)
                    for a, p in zip((cluster, upper, lower, scans), part, strict=True):
                        a[rows] = p
                    moves.add(ints, before[rows], cluster[rows])
                    if last:
                        own = ints - centres.exact[cluster[rows]]
                        for i, d in zip(rows.tolist(), (own * own).sum(axis=1).tolist(), strict=True):
                            distance[i] = d if d < _LONG else None
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), values, pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(scans), pa.array(distance, pa.int64()), pa.nulls(n, arrow.field("moved").type)], schema=arrow)
            trim()
        if found := moves.limbs():
            yield pa.RecordBatch.from_pylist([{"moved": found}], schema=arrow)

    return sent.mapInArrow(run, schema)


def _first_centres(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [[int(math.floor(scale * v)) for v in r.x] for r in kept.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64) -> DataFrame:
    """The id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` and ``scans`` (full scans so far) of every vector kept.

    k and the components bound what the driver holds. Each round's table is deleted when the next one is written.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vec_col, dims)
    rows = _first_centres(kept, k, seed, scale)
    if not rows:
        return _result(spark, kept.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "scans": F.lit(0)}), id_col, [], [], None)
    centres, sums, counts, state = Centres(rows), [[0] * dims for _ in rows], [0] * len(rows), None
    for turn in range(rounds + 1):
        new = stored(_pass(kept if state is None else state, centres, dims, scale, state is None, turn == rounds), "vectors")
        if state is not None:
            discard(state)
        state = new.where(F.col("moved").isNull())
        state.stored_at = new.stored_at
        if turn < rounds:
            limbs = new.where(F.col("moved").isNotNull()).select(F.explode("moved").alias("m")).select("m.*")
            for r in limbs.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():
                value = r.value << (LIMB * r.limb)
                if r.component < dims:
                    sums[r.cluster][r.component] += value
                else:
                    counts[r.cluster] += value
            centres = Centres([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centres.rows, strict=True)], centres.rows)
    totals: list[int | None] = [0] * len(rows)
    for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("distance").alias("known"), F.count(F.lit(1)).alias("n")).collect():
        totals[r.cluster] = int(r.d) if r.known == r.n and r.d is not None else None
    whole = None if None in totals else sum(totals)
    return _result(spark, state, id_col, centres.rows, totals, whole)


def _result(spark: SparkSession, state: DataFrame, id_col: str, rows: list[list[int]], totals: list[int | None], whole: int | None) -> DataFrame:
    fits = lambda v: v if v is not None and v < _LONG else None
    facts = [(j, fits(t), fits(whole), sha256(",".join(map(str, r)).encode()).hexdigest()) for j, (r, t) in enumerate(zip(rows, totals, strict=True))]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def _sql(k: int = 16, rounds: int = 3) -> str:
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY key) - 1 AS cluster, q FROM (SELECT q, sha256('1:' || vec_id) AS key FROM v ORDER BY key LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT vec_id, v.q AS q, cluster, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{i})")
        parts.append(f"a{i} AS (SELECT vec_id, q, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{i}) GROUP BY cluster, pos)")
            parts.append(f"m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS q FROM s{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (cluster))")
    final = f"SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN (SELECT cluster, q FROM c{rounds}) c{rounds} USING (cluster)"
    return "WITH " + ",\n".join(parts) + "\n" + final


SQL = _sql()
