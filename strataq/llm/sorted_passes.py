"""Near-duplicate vectors by sorted projection passes.

A pass gives each vector the concatenated signs of ``BITS`` random projections,
orders all vectors by that string and compares each with the ``WINDOW`` next
ones. Passes do not carry vectors but codes: a signed byte per component and one
scale, with the length of what the rounding leaves, which bounds the error of a
cosine. Pairs that the bound decides are decided there; the few it leaves open
are verified on the vectors. Verified pairs of all passes are joined into
components. The number of
passes follows from the row count: a pair at the threshold shares the leading
log2(n / WINDOW) signs with a known probability, and there are as many passes
as make a miss in all of them rarer than 1 - ``TARGET`` on even data. What real
data have is measured: each pass tells for each vector how many leading signs
leave no more rows than a window, and so how likely it misses a pair there.
Vectors whose misses do not fall below 1 - ``TARGET`` go through further passes
among themselves as long as that settles half of them; the rest (dense cones)
is compared exactly in blocks, a quadratic number of comparisons. Sorting is a
range partition, so nothing is gathered in one task; a window ends at the edge
of a partition, and a pass counts for nothing for the vectors next to an edge.

Equal vectors are one class from the start. Each task links its verified pairs
into local components and hands on one edge per vector, not all pairs of a
window. Links are then counted exactly: if all members of a component lie
within half the threshold angle of its centre, each pair of them is linked by
the triangle inequality and the count is the size; other components are counted
by comparing blocks of at most about ``BLOCK`` members, however large they are.

Cases: null vectors, zero vectors and vectors with null or non-finite components
link with nothing, and neither do vectors of different lengths; each is its own
component. Equal vectors under several ids link with each other. Repeated ids
are taken once, with the smallest vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .components import components, cut

COSINE, WINDOW, BITS, TARGET, BLOCK, SEED = 0.95, 32, 48, 0.995, 2048, 20
#: Vectors that the passes leave open are compared exactly at once if they are no more than this.
FEW = 16_384
#: Comparisons per matrix product, to bound memory.
ROWS_AT_ONCE = 4096


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW) -> int:
    same = 1 - math.acos(cosine) / math.pi
    share = same ** max(math.log2(max(n, 2) / window), 1.0)
    return max(4, math.ceil(math.log(1 - TARGET) / math.log(1 - share)))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Unit rows in double precision; all lists have one length."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """The sign string of pass ``number`` as an integer; order of strings is order of integers."""
    planes = np.random.default_rng([SEED, number, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return ((x @ planes > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: signed bytes, scale, and an upper bound of the length of row - scale * bytes."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    scale = np.where(scale > 0, scale, np.float32(1))
    code = np.clip(np.rint(x / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    error = np.linalg.norm(x - code * scale[:, None].astype(np.float64), axis=1) + 1e-9
    return code, scale, np.nextafter(error.astype(np.float32), np.float32(np.inf))


def keyed(classes: DataFrame, passes: int, start: int = 0) -> DataFrame:
    """(pass, dim, key, id, code, scale, error): one row per class and pass, the passes numbered from ``start``."""
    schema = T.StructType([T.StructField("pass", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("key", T.LongType()), classes.schema["id"], T.StructField("code", T.BinaryType()), T.StructField("scale", T.FloatType()), T.StructField("error", T.FloatType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(whole, ROWS_AT_ONCE)
                sizes = pa.compute.list_value_length(part.column("vec")).to_numpy(zero_copy_only=False)
                for d in np.unique(sizes):
                    rows = part.filter(pa.array(sizes == d))
                    x, n = matrix(rows.column("vec")), rows.num_rows
                    code, scale, error = coded(x)
                    told = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error)]
                    for p in range(start, start + passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(signs(x, p)), rows.column("id").cast(arrow[3].type), *told], schema=arrow)

    return classes.select("id", "vec").mapInArrow(run, schema)


def decoded(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows near the unit vectors of ``keyed``, and how far from them at most."""
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1)
    return code * rows.column("scale").to_numpy().astype(np.float64)[:, None], rows.column("error").to_numpy().astype(np.float64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the edges, for each of n nodes."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def needed(keys: np.ndarray, window: int) -> np.ndarray:
    """For each row of sorted keys, how many leading signs leave at most ``window`` others beside it; over BITS where none do."""
    m = len(keys) - window - 1
    if m <= 0:
        return np.zeros(len(keys), np.int64)
    alike = BITS - np.frexp((keys[:m] ^ keys[window + 1 :]).astype(np.float64))[1].astype(np.int64)
    beyond = np.full(window + 1, -1)
    return np.lib.stride_tricks.sliding_window_view(np.r_[beyond, alike, beyond], window + 2).max(1) + 1


def windowed(rows: DataFrame, cosine: float, window: int) -> DataFrame:
    """(a, b) of each sorted partition: with ``sure``, edges that span the pairs which their codes prove; without, pairs across these whose codes leave it open. With null b, ``miss``: the logarithm of the chance that the pass misses a pair of a."""
    schema = T.StructType([T.StructField("a", rows.schema["id"].dataType), T.StructField("b", rows.schema["id"].dataType), T.StructField("sure", T.BooleanType()), T.StructField("miss", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    same = 1 - math.acos(cosine) / math.pi

    def misses(keys: list[np.ndarray], ids: list, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """Of one group; ``first`` and ``last`` tell whether it touches an edge of the partition."""
        signs_needed = needed(np.concatenate(keys), window)
        n = len(signs_needed)
        miss = np.where(signs_needed > BITS, 0.0, np.log1p(-np.minimum(same**signs_needed, 1 - 1e-12)))
        if first:
            miss[: window + 1] = 0.0
        if last:
            miss[max(n - window - 1, 0) :] = 0.0
        for k in range(0, n, ROWS_AT_ONCE):
            part = ids[k : k + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(part, arrow[0].type), pa.nulls(len(part), arrow[1].type), pa.nulls(len(part), pa.bool_()), pa.array(miss[k : k + ROWS_AT_ONCE])], schema=arrow)

    def edges(ids: list, a: np.ndarray, b: np.ndarray, sure: bool) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a], arrow[0].type), pa.array([ids[i] for i in b], arrow[1].type), pa.array(np.full(len(a), sure)), pa.nulls(len(a), pa.float64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple | None = None  # the last rows of what came before
        now, first = None, True  # the group whose keys are held
        keys: list[np.ndarray] = []
        held: list = []
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                group = part.column("pass").to_numpy().astype(np.int64) << 32 | part.column("dim").to_numpy()
                for g in np.unique(group):
                    rows = part.filter(pa.array(group == g))
                    (x, far), ids = decoded(rows), rows.column("id").to_pylist()
                    if now is not None and now != g:
                        yield from misses(keys, held, first, False)
                        keys, held, first = [], [], False
                    now = g
                    keys.append(rows.column("key").to_numpy())
                    held += ids
                    if carry is not None and carry[0] == g:
                        x, far, ids = np.concatenate([carry[1], x]), np.concatenate([carry[3], far]), carry[2] + ids
                    a, b, low = [], [], []
                    for step in range(1, min(window, len(x) - 1) + 1):
                        near = np.einsum("ij,ij->i", x[:-step], x[step:])
                        slack = far[:-step] + far[step:] + far[:-step] * far[step:]
                        hit = np.flatnonzero(near + slack >= cosine)
                        a.append(hit)
                        b.append(hit + step)
                        low.append(near[hit] - slack[hit] >= cosine)
                    if a:
                        left, right, proved = np.concatenate(a), np.concatenate(b), np.concatenate(low)
                        root = local_roots(len(x), left[proved], right[proved])
                        at = np.flatnonzero(root != np.arange(len(x)))
                        yield from edges(ids, root[at], at, True)
                        unsettled = ~proved & (root[left] != root[right])
                        yield from edges(ids, left[unsettled], right[unsettled], False)
                    carry = (g, x[-window:], ids[-window:], far[-window:])
        if held:
            yield from misses(keys, held, first, True)

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose vectors are linked."""
    vec = lambda c: classes.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}"))
    joined = pairs.join(vec("a"), "a").join(vec("b"), "b").select("a", "b", "vec_a", "vec_b")
    schema = T.StructType([T.StructField(c, classes.schema["id"].dataType) for c in ("a", "b")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("vec_a")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == d))
                hit = np.einsum("ij,ij->i", matrix(rows.column("vec_a")), matrix(rows.column("vec_b"))) >= cosine
                yield rows.filter(pa.array(hit)).select(["a", "b"]).cast(arrow)

    return joined.mapInArrow(run, schema)


def exact(rows: DataFrame, n: int, cosine: float) -> DataFrame:
    """(a, b) edges that span all linked pairs of ``rows`` (id, vec), n of them, by comparing blocks."""
    parts = math.ceil(n / BLOCK)
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    dealt = rows.select("id", "vec", F.size("vec").alias("dim"), F.explode(blocks).alias("pair")).select("id", "vec", "dim", "pair.i", "pair.j")
    schema = T.StructType([T.StructField("a", rows.schema["id"].dataType), T.StructField("b", rows.schema["id"].dataType)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        x = np.array(rows["vec"].tolist(), np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        root = np.arange(len(x))
        for k in range(0, len(x), BLOCK // 8 or 1):
            a, b = np.nonzero(x[k : k + (BLOCK // 8 or 1)] @ x.T >= cosine)
            root = local_roots(len(x), np.r_[a + k, np.arange(len(x))], np.r_[b, root])
        at = np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame({"a": ids[root[at]], "b": ids[at]})

    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dim", "i", "j")
    return dealt.groupBy("dim", "i", "j").applyInPandas(run, schema)


def linked_pairs(classes: DataFrame, n: int, cosine: float, window: int) -> DataFrame:
    """(a, b) edges that span the linked pairs of ``classes`` (id, vec), n of them."""
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    left, start = classes.select("id", "vec", F.lit(0.0).alias("miss")), 0
    edges = None
    while True:
        passes = passes_for(n, cosine, window)
        order = keyed(left, passes, start).repartitionByRange(parts, "pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
        told = cut(windowed(order, cosine, window))
        unsettled = told.where("NOT sure").select("a", "b").distinct()
        found = told.where("sure").select("a", "b").unionByName(verified(unsettled, classes, cosine))
        edges = found if edges is None else edges.unionByName(found)
        chance = told.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("miss").alias("more"))
        left = cut(left.join(chance, "id").select("id", "vec", (F.col("miss") + F.col("more")).alias("miss")).where(F.col("miss") > math.log(1 - TARGET)))
        before, n, start = n, left.count(), start + passes
        if n <= FEW or n > before / 2:
            return edges.unionByName(exact(left, n, cosine)) if n > 1 else edges


def centres(members: DataFrame) -> DataFrame:
    """root and centre (unit mean) of each component; tasks sum their rows first."""
    schema = T.StructType([members.schema["root"], T.StructField("sum", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == d))
                roots, which = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)
                total = np.zeros((len(roots), d))
                np.add.at(total, which, matrix(rows.column("vec")))
                yield pa.RecordBatch.from_arrays([pa.array(roots.tolist(), arrow[0].type), pa.array(total.tolist(), arrow[1].type)], schema=arrow)

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(rows["sum"].to_numpy()).sum(0)
        length = np.linalg.norm(total)
        return pd.DataFrame({"root": [key[0]], "centre": [(total / length if length > 0 else total).tolist()]})

    out = T.StructType([members.schema["root"], T.StructField("centre", T.ArrayType(T.DoubleType()))])
    return members.select("root", "vec").mapInArrow(sums, schema).groupBy("root").applyInPandas(whole, out)


def angles(rows: DataFrame) -> DataFrame:
    """``rows`` (id, root, copies, vec, centre) with the angle to the centre in place of it."""
    kept = [rows.schema[c] for c in ("id", "root", "copies", "vec")]
    schema = T.StructType([*kept, T.StructField("angle", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                centre = part.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", matrix(part.column("vec")), centre), -1, 1))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).cast(arrow.field(f.name).type) for f in kept), pa.array(angle)], schema=arrow)

    return rows.select("id", "root", "copies", "vec", "centre").mapInArrow(run, schema)


def counted(loose: DataFrame, cosine: float) -> DataFrame:
    """id and linked copies of other classes, by comparing blocks of the components in ``loose`` (id, root, copies, vec, size)."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    rows = loose.select("root", "id", "copies", "vec", own.alias("own"), F.explode(pairs).alias("pair")).select("root", "id", "copies", "vec", "own", "pair.i", "pair.j")
    schema = T.StructType([loose.schema["id"], T.StructField("linked", T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values("id")
        x = np.array(rows["vec"].tolist(), np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        copies, own = rows["copies"].to_numpy(np.int64), rows["own"].to_numpy()
        linked = np.zeros(len(x), np.int64)
        for k in range(0, len(x), ROWS_AT_ONCE):
            hit = x[k : k + ROWS_AT_ONCE] @ x.T >= cosine
            hit[np.arange(len(hit)), np.arange(k, k + len(hit))] = False
            if i != j:
                hit &= own[k : k + ROWS_AT_ONCE, None] != own[None, :]
            linked[k : k + ROWS_AT_ONCE] = hit @ copies
        return pd.DataFrame({"id": rows["id"], "linked": linked})

    # Without this, rows that are already dealt by root would keep all blocks of a component in one task.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "i", "j")
    return rows.groupBy("root", "i", "j").applyInPandas(run, schema).groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """One row per id: n_links, component_id, kept."""
    rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(vec_col)).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("vec").isNotNull() & finite, F.lit(False)))
    rows = rows.select("id", F.when(F.col("valid"), F.col("vec")).alias("vec"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"), "valid")
    valid = rows.where("valid")
    classes = cut(valid.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    n = classes.count()
    edges = linked_pairs(classes, n, cosine, window)
    roots = components(edges.distinct()).withColumnRenamed("node", "id")
    members = cut(classes.select("id", "copies", "vec").join(roots, "id"))
    turned = cut(angles(members.join(centres(members), "root")))
    size = turned.groupBy("root").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("size"), F.max("angle").alias("widest"))
    tight = F.col("widest") * 2 <= math.acos(cosine) - 1e-9
    placed = turned.join(size, "root")
    links = placed.where(tight).select("id", (F.col("total") - F.col("copies")).alias("linked")).unionByName(counted(placed.where(~tight), cosine))
    told = classes.select("h1", "h2", F.col("id").alias("class_id"), "copies").join(roots.select(F.col("id").alias("class_id"), "root"), "class_id", "left").join(links.select(F.col("id").alias("class_id"), "linked"), "class_id", "left")
    found = rows.select("id", "h1", "h2", "valid").join(told.withColumn("valid", F.lit(True)), ["h1", "h2", "valid"], "left")
    component = F.coalesce("root", "class_id", "id")
    return found.select(F.col("id").alias(id_col), F.coalesce(F.col("linked") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
