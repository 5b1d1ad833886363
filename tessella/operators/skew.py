"""Work per key where a few keys hold most records.

Three tools, none of which lets the rows of one key meet in one task:

``key_runs``
    per-key summaries over an ordered column, by range partitioning on the
    composite (key, order) and stitching the states of neighbouring partitions.
``running_sum``
    per-key prefix sums by the same partitioning.
``weighted_join``
    equi-join in which heavy keys of the left side are salted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import cut, partitions

SALTS = 64


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _ranged(df: DataFrame, keys: Sequence[str], order: str, n: int | None, salted: bool) -> DataFrame:
    """Columns k0.., o (, salt) in partitions cut at sampled quantiles of all of them, sorted."""
    cols = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] + [F.col(f"`{order}`").cast("long").alias("o")]
    by = [f"k{i}" for i in range(len(keys))] + ["o"]
    if salted:
        # copies of one (key, order) are spread too; the sort then keeps them adjacent
        cols.append((F.rand(11) * SALTS).cast("int").alias("salt"))
        by = [*by, "salt"]
    n = n or partitions(df.sparkSession)
    return df.select(*cols).repartitionByRange(n, *by).sortWithinPartitions(*by)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row's key differs from the row before; True at 0."""
    size = len(columns[0])
    new = np.zeros(size, dtype=bool)
    new[0] = True
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _run_states(n_keys: int, fields: pa.Schema):
    """Streams sorted batches and emits one state per key and partition."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        part = -1
        from pyspark import TaskContext

        if (ctx := TaskContext.get()) is not None:
            part = ctx.partitionId()

        def emit(keys, states):
            cols = [pa.array([k[i] for k in keys], fields.field(i).type) for i in range(n_keys)]
            cols.append(pa.array([part] * len(keys), pa.int32()))
            cols += [pa.array([s[i] for s in states], pa.int64()) for i in range(5)]
            return pa.RecordBatch.from_arrays(cols, schema=fields)

        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i) for i in range(n_keys)]
            order = b.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
            new = _changes(keys)
            at = np.flatnonzero(new)
            ends = np.append(at[1:], b.num_rows)
            step = np.zeros(b.num_rows, dtype=np.int64)
            step[1:] = order[1:] - order[:-1]
            step[at] = 0
            seen = (step > 0) | new
            rows = ends - at
            positions = np.add.reduceat(seen.astype(np.int64), at)
            gaps = np.maximum.reduceat(step, at)
            names = list(zip(*[k.take(pa.array(at)).to_pylist() for k in keys], strict=True))
            found = [[int(r), int(p), int(order[a]), int(order[e - 1]), int(g)] for r, p, a, e, g in zip(rows, positions, at, ends, gaps, strict=True)]
            if open_key is not None:
                if names[0] == open_key:
                    f = found[0]
                    found[0] = [state[0] + f[0], state[1] + f[1] - (state[3] == f[2]), state[2], f[3], max(state[4], f[4], f[2] - state[3])]
                else:
                    names.insert(0, open_key)
                    found.insert(0, state)
            open_key, state = names.pop(), found.pop()
            if names:
                yield emit(names, found)
        if open_key is not None:
            yield emit([open_key], [state])

    return states


def key_runs(df: DataFrame, keys: Sequence[str], order: str, n: int | None = None) -> DataFrame:
    """Per key: rows, distinct order values, the first and last, and the widest step.

    Rows are range-partitioned on (keys, order) at quantiles that Spark samples,
    so a key that holds a third of all rows is cut into as many partitions as
    its share asks for; copies of a single (key, order) are salted, so even
    these are cut. Each sorted partition is streamed into one state per key.
    A key's states are at most one per partition; they are put in partition
    order and stitched: where one state ends on the value with which the next
    begins, that value is counted once, and the step across is taken in.

    Returns the key columns and ``n_rows, n_positions, first_pos, last_pos,
    max_gap`` (long). Rows with a null order value count in n_rows only; a key
    that has no other rows gets n_positions 0 and null first_pos, last_pos and
    max_gap. Null keys form groups, as in GROUP BY. max_gap is 0 for a key with
    one position. An empty table gives an empty result. Other columns of
    ``df`` are not looked at, whatever their names.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kf = [T.StructField(f"k{i}", kinds[k]) for i, k in enumerate(keys)]
    out = T.StructType([*kf, T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n_rows", "n_positions", "first_pos", "last_pos", "max_gap")]])
    from pyspark.sql.pandas.types import to_arrow_schema

    ks = [f.name for f in kf]
    ranged = _ranged(df.filter(F.col(f"`{order}`").isNotNull()), keys, order, n, True)
    states = ranged.mapInArrow(_run_states(len(keys), to_arrow_schema(out)), out)
    blank = (
        df.filter(F.col(f"`{order}`").isNull())
        .groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
        .agg(F.count("*").alias("n_rows"))
        .select(*ks, F.lit(-1).alias("part"), "n_rows", F.lit(0).cast("long").alias("n_positions"), *[F.lit(None).cast("long").alias(c) for c in ("first_pos", "last_pos", "max_gap")])
    )
    w = Window.partitionBy(*ks).orderBy("part")
    stitched = (
        states.unionByName(blank)
        .withColumn("before", F.lag("last_pos").over(w))
        .groupBy(*ks)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            (F.sum("n_positions") - F.count(F.when(F.col("before") == F.col("first_pos"), 1))).alias("n_positions"),
            F.min("first_pos").alias("first_pos"),
            F.max("last_pos").alias("last_pos"),
            F.max(F.greatest("max_gap", F.col("first_pos") - F.col("before"))).alias("max_gap"),
        )
    )
    return stitched.select(*[F.col(a).alias(k) for a, k in zip(ks, keys, strict=True)], "n_rows", "n_positions", "first_pos", "last_pos", "max_gap")


def _local_sums(keys: list[int], value: int, schema: pa.Schema):
    """Streams a sorted partition and adds its number and each row's sum within key and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx is not None else 0
        open_key, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i) for i in keys]
            at = np.flatnonzero(_changes(columns))
            v = b.column(value).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(v)
            # each run of a key begins anew, but for one that the last batch left open
            before = np.where(at > 0, upto[at - 1], 0)
            first = tuple(c[0].as_py() for c in columns)
            if first == open_key:
                before[0] -= carried
            sums = upto - np.repeat(before, np.diff(np.append(at, b.num_rows)))
            open_key, carried = tuple(c[b.num_rows - 1].as_py() for c in columns), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(sums)], schema=schema)

    return run


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, n: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (integers) over the key's rows up to and with this one.

    Range partitions on (keys, order) as in key_runs, shuffled once: each sorted
    partition is streamed past one sum, and written with it. What the partitions before a
    row's own hold of its key (at most partitions x keys rows) is joined back.
    ``order`` must be unique within a key for a defined result. Null values count as 0; null keys
    form groups. A column named ``out`` is replaced.
    """
    n = n or partitions(df.sparkSession)
    df = df.drop(out)
    part, at, offset = _free(df, "part"), _free(df, "at_part"), _free(df, "offset")
    own = [_free(df, f"key{i}") for i in range(len(keys))]
    if not isinstance(df.schema[value].dataType, T.IntegralType):
        raise TypeError(f"{value} isn't a column of integers")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(out, T.LongType())])
    # spelled as in the schema, whatever the case the caller wrote
    place = {c.lower(): i for i, c in enumerate(df.columns)}
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    local = cut(ranged.mapInArrow(_local_sums([place[k.lower()] for k in keys], place[value.lower()], to_arrow_schema(schema)), schema), "ranged")
    sums = local.groupBy(*keys, part).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(offset))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(c) for k, c in zip(keys, own, strict=True)], F.col(part).alias(at), F.coalesce(F.sum(offset).over(before), F.lit(0)).alias(offset))
    on = F.col(part) == F.col(at)
    for k, c in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(c))
    return local.join(offsets, on).withColumn(out, F.col(out) + F.col(offset)).drop(part, at, offset, *own)


def weighted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join of many rows with one row per key, whose ``weight`` counts the key's rows at the left.

    Keys with more than 1 / (4 x salts) of the whole weight are heavy; by their
    definition there are at most 4 x salts of them, which bounds what is
    broadcast to flag them. Rows of a heavy key get one of ``salts`` salts by a
    hash of the ``spread`` columns, and the key's right row is repeated for
    each; all other keys have salt 0. ``how`` is inner or left.
    Null keys match nothing. The weight column is dropped.
    """
    limit = right.agg((F.sum(weight) / (4 * salts)).alias("_limit")).scalar()
    flagged = right.withColumn("_heavy", F.coalesce(F.col(weight) > limit, F.lit(False))).drop(weight)
    heavy = flagged.filter("_heavy").select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(True).alias("_is"))
    on = None
    for i, k in enumerate(keys):
        c = F.col(k) == F.col(f"_h{i}")
        on = c if on is None else on & c
    salted = (
        left.join(F.broadcast(heavy), on, "left")
        .withColumn("_salt", F.when(F.col("_is"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
        .drop("_is", *[f"_h{i}" for i in range(len(keys))])
    )
    many = flagged.withColumn("_salt", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return salted.join(many, [*keys, "_salt"], how).drop("_salt")
