"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative for each group.

Vectors of one label are compared, by cosine in double precision.  Equal unit vectors of a label are one class, so
exact copies are counted and not compared.

* Centres are fitted by spherical k-means on a bounded sample (at most ``sample`` classes, in hash order; at most
  ``max_cells`` centres, so what every task gets is bounded too).  The number of cells grows while vectors of the sample
  visit few of them.
* Every class has its home cell, that of the centre with the largest product.  A link can cross a border only near it:
  with angle t at the threshold, a vector v of home b can be linked with a vector of home a only if
  v * (c_b - c_a) <= sin(t) * |c_b - c_a|.  A vector visits all cells for which that holds, so no link is lost.
* A cell of one label is dealt into blocks of about ``block`` rows.  A group of rows is one pair of blocks; it gives for each
  home row the number of its links, and links rows to a representative of what hangs together: never more rows than it has read.

Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing; so are those with a null label or id.
Vectors of different length are never compared.  Repeated rows of an id are one node; its n_links counts rows.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import materialise, mix64, table, with_column_batches
from vocspark.llm.components import components
from vocspark.llm.registry import query

THRESHOLD = 0.98
# Products this close to the threshold are summed again exactly.
UNSURE = 1e-12
STEP = 512
# More cells are taken while a vector visits no more than this many on average; scattered vectors get few cells.
MAX_VISITS = 6
KEYS = ["label", "dim", "cell"]

def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit): valid vectors scaled to length 1."""
    def task(batches):
        for batch in batches:
            out = []
            for i, x, label in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(),
                                   batch.column("label").to_pylist()):
                if i is None or x is None or label is None or not x or any(v is None for v in x):
                    continue
                v = np.array(x, dtype=np.float64)
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = v / np.abs(v).max() + 0.0
                out.append((i, label, len(v), (v / np.sqrt(v @ v)).tobytes()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["vec_id", "label", "dim", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    return with_column_batches(rows, ["vec_id", "embedding", "label"], "vec_id bigint, label bigint, dim int, unit binary", task)


def kmeans(units: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres of spherical k-means; an empty cell keeps its centre."""
    order = np.argsort(mix64(np.arange(len(units), dtype=np.uint64) + np.uint64(seed)))
    centres = units[order[:cells]].copy()
    for _ in range(rounds):
        home = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def visits(units: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of every vector, and the cells (columns) in which it must be compared."""
    reach = math.sin(math.acos(threshold)) + 1e-9
    products = units @ centres.T
    home = products.argmax(axis=1)
    rows = np.arange(len(units))
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    near = products[rows, home][:, None] - products <= reach * apart[home] + 1e-9
    near[rows, home] = True
    return home, near


def fit_centres(classes: DataFrame, threshold: float, sample: int, max_cells: int, dims: int = 4) -> dict[int, np.ndarray]:
    """Centres for the most frequent vector lengths, from at most ``sample`` classes each; other lengths have one cell."""
    found = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(dims).collect()
    out = {}
    for dim in [r["dim"] for r in found]:
        rows = classes.where(F.col("dim") == dim).select("unit", F.xxhash64("unit").alias("h")).orderBy("h").limit(sample).collect()
        units = np.frombuffer(b"".join(r["unit"] for r in rows), dtype=np.float64).reshape(len(rows), dim)
        best, cells = None, 4
        while cells <= min(max_cells, max(4, len(units) // 8)):
            centres = kmeans(units, min(cells, len(units)))
            if best is not None and visits(units, centres, threshold)[1].sum() > MAX_VISITS * len(units):
                break
            best, cells = centres, cells * 4
        out[dim] = best
    return out


def place(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(label, dim, cell, home, id, copies, unit): each class in its home cell and as a visitor near a border."""
    def task(batches):
        for batch in batches:
            dims, units = np.array(batch.column("dim")), batch.column("unit").to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim in centres:
                    u = np.frombuffer(b"".join(units[k] for k in rows), dtype=np.float64).reshape(-1, dim)
                    home, near = visits(u, centres[dim], threshold)
                    r, cell = np.nonzero(near)
                    own = home[r] == cell
                else:
                    r, cell, own = np.arange(len(rows)), np.zeros(len(rows), dtype=int), np.ones(len(rows), dtype=bool)
                part = batch.take(pa.array(rows[r]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), pa.array(cell.astype(np.int32)), pa.array(own), part.column("id"),
                     part.column("copies"), part.column("unit")], names=["label", "dim", "cell", "home", "id", "copies", "unit"])

    return with_column_batches(classes, ["label", "dim", "id", "copies", "unit"],
                               "label bigint, dim int, cell int, home boolean, id bigint, copies bigint, unit binary", task)


def joined_rows(hit: np.ndarray) -> np.ndarray:
    """For a matrix of links between rows and columns: the component number of every row and column, -1 if alone."""
    rows, columns = hit.shape
    row, column = np.arange(rows), np.full(columns, rows)
    while True:
        column_now = np.where(hit, row[:, None], rows).min(axis=0, initial=rows)
        row_now = np.minimum(row, np.where(hit, column_now[None, :], rows).min(axis=1, initial=rows))
        if (column_now == column).all() and (row_now == row).all():
            break
        row, column = row_now, column_now
    return np.concatenate((np.where(hit.any(axis=1), row, -1), np.where(hit.any(axis=0), column, -1)))


def multiply(key, rows, threshold: float):
    """One pair of blocks: (a, links) for home rows with links, and (a, b) that hang together."""
    import pandas as pd
    lo, hi, dim = key[3], key[4], key[1]
    units = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(-1, dim)
    ids, home, mine, copies = (rows[c].to_numpy() for c in ("id", "home", "mine", "copies"))
    first, second = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    count, a_side, b_side = np.zeros(len(rows), dtype=np.int64), [], []
    for i in range(0, len(first), STEP):
        one = first[i:i + STEP]
        for j in range(0, len(second), STEP):
            two = second[j:j + STEP]
            product = units[one] @ units[two].T
            hit = product >= threshold
            for x, y in zip(*np.nonzero(np.abs(product - threshold) < UNSURE)):
                hit[x, y] = math.fsum((units[one[x]] * units[two[y]]).tolist()) >= threshold
            hit &= ids[one][:, None] != ids[two][None, :]
            if not hit.any():
                continue
            # A row counts in its home cell alone, where all its partners are, at home or as visitors.
            count[one] += np.where(home[one], hit @ copies[two], 0)
            if lo != hi:
                count[two] += np.where(home[two], copies[one] @ hit, 0)
            group = joined_rows(hit)
            members = np.concatenate((one, two))[group >= 0]
            a_side.append(ids[members])
            b_side.append(ids[one[group[group >= 0]]])
    linked = np.flatnonzero(count)
    edges = pd.DataFrame({"a": np.concatenate(a_side), "b": np.concatenate(b_side)}) if a_side else pd.DataFrame({"a": [], "b": []})
    edges = edges[edges["a"] != edges["b"]].drop_duplicates()
    return pd.DataFrame({"a": np.concatenate((ids[linked], edges["a"].to_numpy(dtype=np.int64))).astype(np.int64),
                         "b": pd.array([None] * len(linked) + edges["b"].astype("int64").tolist(), dtype="Int64"),
                         "links": pd.array(count[linked].tolist() + [None] * len(edges), dtype="Int64")})


def links(classes: DataFrame, threshold: float, sample: int, max_cells: int, block: int) -> DataFrame:
    """(a, b, links): link counts of classes (b null), and pairs that hang together (links null)."""
    placed = materialise(place(classes, fit_centres(classes, threshold, sample, max_cells), threshold), "vector-cells")
    sizes = placed.groupBy(*KEYS).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = placed.join(sizes, KEYS).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    # A row goes to every pair of blocks that its own block is part of.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *KEYS, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "home", "id", "copies", "unit")

    def task(key, rows):
        return multiply(key, rows, threshold)

    return dealt.groupBy(*KEYS, "lo", "hi").applyInPandas(task, "a bigint, b bigint, links bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = 8_000, max_cells: int = 256,
                 block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    valid = materialise(unit_vectors(vectors), "vector-units")
    classes = materialise(valid.groupBy("label", "dim", "unit").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    found = materialise(links(classes, threshold, sample, max_cells, block), "vector-links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    of = valid.join(classes, ["label", "dim", "unit"]).select("vec_id", "id", "copies")
    of = of.join(counts, of["id"] == counts["a"], "left").select(
        "vec_id", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    of = materialise(of, "vector-counts")
    joined = components(found.where("b IS NOT NULL").select("a", "b").union(of.select("vec_id", "id")), "a", "b")
    numbers = of.groupBy("vec_id").agg(F.max("n").alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(numbers, "vec_id", "left").join(
        joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


@query("op4_embedding_near_dedup", """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.98),
  r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
  m AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m""")
def embedding_near_dedup(spark, folder):
    return near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
