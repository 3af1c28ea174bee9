"""Leave-one-prompt-out ridge regressors on bags of words, without a table of products.

A vocabulary of thousands of words has millions of products per fold, so nothing here is ever
quadratic in the features.  All folds are fitted together by conjugate gradients: one step is one pass
over the rows, which applies ``X'(X v)`` to the directions of all folds and targets at once, a row
adding nothing to its own fold.  Centring and shrinkage are of rank one or diagonal and are applied to
the summed result.  Directions are not scaled by the diagonal: with fewer rows than words that would
spread the spectrum and take several times as many steps.

Rows carry their bag as two arrays (:func:`bag_rows`).  They are packed once into blocks of ``BLOCK_ROWS``
rows, each with the list of its own words, and written to the shared folder; a step reads blocks only and
multiplies dense matrices of a block's rows and words.  It hands one matrix of features by folds and
targets to the tasks and gets one back, summed in pieces by as many tasks as there are shuffle
partitions.  ``STATE_BYTES`` bounds that matrix: more folds are fitted in groups, one after the other.

Rows with a missing target are left out; rows without a known word count like all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.operators.fit import MODEL_SCHEMA, complete_rows
from gradeflow.operators.folds import ALL
from gradeflow.operators.score import wide_models
from gradeflow.operators.vocab import FIRST_WORD_ID
from gradeflow.schemas import TARGET_COLUMNS
from gradeflow.session import checkpointed, scratch_dir

#: Bytes of one matrix of features by folds and targets.
STATE_BYTES = 64 << 20
#: Rows and cells of a packed block, and the numbers that travel in one row of a sum.
BLOCK_ROWS, BLOCK_CELLS, PIECE = 256, 2_000_000, 4096
BLOCK = "folds binary, targets binary, words binary, places binary, counts binary"


def bag_rows(
    df: DataFrame,
    bags: DataFrame,
    key: str = "student_id",
    first_id: int = FIRST_WORD_ID,
    value: Column | None = None,
) -> DataFrame:
    """``df`` with the long-form bags of :func:`vocab.vocab_features` as ``ids``, from 0, and ``counts``.

    ``value`` is the number a word stands for, its count ``n`` if not given.  A row without a known
    word has empty arrays.  Keys must be unique in ``df``.
    """
    number = F.col("n") if value is None else value
    # at most one item per word of the vocabulary
    item = F.struct((F.col("id") - first_id).cast("int").alias("id"), number.cast("double").alias("n"))
    gathered = bags.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("bag"))
    joined = df.join(gathered, key, "left")
    return joined.select(
        *df.columns,
        F.coalesce("bag.id", F.array().cast("array<int>")).alias("ids"),
        F.coalesce("bag.n", F.array().cast("array<double>")).alias("counts"),
    )


@dataclass
class Block:
    """Some rows: numbers of their folds (-1 for none), targets, the words they hold, and a line of counts each."""

    folds: np.ndarray
    targets: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """``X matrix``, a line per row."""
        return self.counts @ matrix[self.words]

    def add_transposed(self, values: np.ndarray, total: np.ndarray) -> None:
        """Add ``X' values`` to ``total``."""
        total[self.words] += self.counts.T @ values


def _packed(rows: DataFrame, place: dict[str, int], n_targets: int) -> DataFrame:
    """Blocks of rows ``(fold, targets, ids, counts)``; a place is row times words plus word."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = np.array([place.get(name, -1) for name in names.dictionary.to_pylist()] + [-1], np.int32)
            folds = codes[names.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
            targets = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1 : 1 + n_targets]])
            lists = batch.column(1 + n_targets)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = batch.column(2 + n_targets).flatten().to_numpy(zero_copy_only=False)
            ends, start = np.concatenate([[0], np.cumsum(sizes)]), 0
            while start < batch.num_rows:
                stop, used = start, 0
                while stop < batch.num_rows and stop - start < BLOCK_ROWS:
                    used += sizes[stop]
                    if stop > start and used * (stop + 1 - start) > BLOCK_CELLS:
                        break
                    stop += 1
                span = slice(ends[start], ends[stop])
                words, word = np.unique(ids[span], return_inverse=True)
                row = np.repeat(np.arange(stop - start), sizes[start:stop])
                parts = (folds[start:stop], targets[start:stop], words.astype(np.int32), row * len(words) + word, counts[span])
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], BLOCK_NAMES)
                start = stop

    return checkpointed(rows.sparkSession, rows.mapInArrow(pack, BLOCK), "bag-blocks")


BLOCK_NAMES = [part.split()[0] for part in BLOCK.split(", ")]


def _blocks(batch: pa.RecordBatch, n_targets: int) -> Iterator[Block]:
    types = (np.int32, np.float64, np.int32, np.int64, np.float64)
    columns = [batch.column(name) for name in BLOCK_NAMES]
    for i in range(batch.num_rows):
        folds, targets, words, places, counts = (
            np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(columns, types, strict=True)
        )
        # a word given twice in a row counts twice
        cells = np.bincount(places, counts, len(folds) * len(words)).reshape(len(folds), len(words))
        yield Block(folds, targets.reshape(len(folds), n_targets), words, cells)


def _summed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the pieces of one number that several tasks sent."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        for i, piece in enumerate(batch.column(0).to_pylist()):
            part = values[offsets[i] : offsets[i + 1]]
            if piece in held:
                held[piece] += part
            else:
                held[piece] = part.copy()
    if held:
        yield _pieces(held)


def _pieces(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    numbers = pa.array(list(held), pa.int32())
    return pa.RecordBatch.from_arrays([numbers, pa.array(list(held.values()), pa.list_(pa.float64()))], ["piece", "cells"])


def _total(
    blocks: DataFrame, n_targets: int, shape: tuple[int, int], add: Callable[[Block, np.ndarray], None]
) -> np.ndarray:
    """The sum over all blocks of the matrices that ``add`` adds up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in _blocks(batch, n_targets):
                total = np.zeros(shape) if total is None else total
                add(block, total)
        if total is not None:
            flat = total.ravel()
            for start in range(0, len(flat), PIECE):
                yield _pieces({start // PIECE: flat[start : start + PIECE]})

    layout = "piece int, cells array<double>"
    summed = blocks.mapInArrow(partial, layout).repartition("piece").mapInArrow(_summed_pieces, layout)
    out = np.zeros(shape[0] * shape[1])
    table = summed.toArrow()  # one matrix, bounded by STATE_BYTES
    for piece, cells in zip(table.column("piece").to_pylist(), table.column("cells").to_pylist(), strict=True):
        out[piece * PIECE : piece * PIECE + len(cells)] = cells
    return out.reshape(shape)


def _solve(
    blocks: DataFrame,
    names: list[str],
    first: int,
    sums: dict,
    targets: Sequence[str],
    size: int,
    lam: float,
    per_row: bool,
    tolerance: float,
    max_steps: int,
) -> list[tuple]:
    """Models of the folds ``names``, of which the first has number ``first``, by conjugate gradients."""
    spark, k, f = blocks.sparkSession, len(targets), len(names)

    def first_sums(block: Block, total: np.ndarray) -> None:
        ones = np.column_stack([np.ones(len(block.folds)), block.targets])  # count and targets
        own = (block.folds[:, None] == first + np.arange(f)[None, :])[:, :, None] * ones[:, None, :]
        block.add_transposed(np.concatenate([ones[:, None, :], own], axis=1).reshape(len(ones), -1), total)

    products = _total(blocks, k, (size, (f + 1) * (k + 1)), first_sums).reshape(size, f + 1, k + 1)
    products = products[:, :1] - products[:, 1:]  # all rows less those of the own fold
    n = np.array([sums[None][0] - sums.get(name, [0.0] * (k + 1))[0] for name in names])
    y_sum = np.array([[sums[None][1 + t] - sums.get(name, [0.0] * (k + 1))[1 + t] for t in range(k)] for name in names])
    x_sum, xy = products[:, :, 0], products[:, :, 1:]

    wide = (size, f * k)
    mean = np.repeat(x_sum / n, k, axis=1)
    weight = np.repeat(n, k)
    target = (xy - x_sum[:, :, None] * (y_sum / n[:, None])[None]).reshape(wide)
    column = first + np.arange(f * k) // k
    shrink = lam * weight if per_row else np.full(f * k, lam)

    def applied(direction: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(direction)

        def add(block: Block, total: np.ndarray) -> None:
            value = block.times(shared.value)
            value[block.folds[:, None] == column[None, :]] = 0.0
            block.add_transposed(value, total)

        try:
            product = _total(blocks, k, wide, add)
        finally:
            shared.unpersist()
        return product - mean * (weight * (mean * direction).sum(axis=0)) + shrink * direction

    solution, residual = np.zeros(wide), target.copy()
    direction, height = target.copy(), (target * target).sum(axis=0)
    enough = tolerance**2 * height
    for _ in range(max_steps):
        if (height <= enough).all():
            break
        image = applied(direction)
        curve = (direction * image).sum(axis=0)
        step = np.divide(height, curve, out=np.zeros_like(height), where=curve > 0)
        solution += step * direction
        residual -= step * image
        lower = (residual * residual).sum(axis=0)
        direction = residual + np.divide(lower, height, out=np.zeros_like(lower), where=height > 0) * direction
        height = lower
    else:
        raise RuntimeError(f"no convergence to {tolerance} within {max_steps} steps")
    intercept = (y_sum / n[:, None]).ravel() - (mean * solution).sum(axis=0)
    return [
        (name, t, round(float(n[i])), float(intercept[i * k + j]), solution[:, i * k + j].tolist())
        for i, name in enumerate(names)
        for j, t in enumerate(targets)
    ]


def fit_logo_sparse(
    rows: DataFrame,
    size: int,
    targets: Sequence[str] = TARGET_COLUMNS,
    lam: float = 1.0,
    key: str = "prompt_id",
    include_all: bool = False,
    per_row: bool = False,
    tolerance: float = 1e-9,
    max_steps: int = 500,
) -> DataFrame:
    """Ridge regressors on bags of ``size`` words (``ids``, ``counts``), one per held-out fold.

    ``lam`` shrinks the weights, not the intercept; with ``per_row`` it is the shrinkage per row fitted
    on, which keeps the number of steps the same however many rows there are.  Steps end when every residual of the normal
    equations is at most ``tolerance`` of their right side.  A lone fold has no rows to be fitted on
    and gives no model; rows without a fold are trained on.
    """
    if lam <= 0:
        raise ValueError("lam must be positive")
    if 8 * size * len(targets) > STATE_BYTES:
        raise ValueError(f"{size} features of one fold exceed {STATE_BYTES} bytes")
    spark = rows.sparkSession
    usable = complete_rows(rows, targets).select(
        F.col(key).cast("string").alias("fold"), *[F.col(t).cast("double").alias(t) for t in targets], "ids", "counts"
    )
    per_fold = usable.groupBy("fold").agg(F.count("*").cast("double").alias("n"), *[F.sum(t).alias(t) for t in targets])
    found = [(row.fold, [row.n, *[row[t] for t in targets]]) for row in per_fold.collect()]  # a row per fold
    totals = [sum(values) for values in zip(*[s for _, s in found], strict=True)]
    sums = {fold: s for fold, s in found if fold is not None}
    names = sorted(fold for fold, s in sums.items() if s[0] < totals[0])
    sums[None] = totals
    if include_all and found:
        names.append(ALL)
    path, schema = scratch_dir(spark, "sparse-models"), MODEL_SCHEMA
    spark.createDataFrame([], schema).write.parquet(path)
    if names:
        blocks = _packed(usable, {name: i for i, name in enumerate(names) if name != ALL}, len(targets))
        together = max(1, STATE_BYTES // (8 * size * (len(targets) + 1)) - 1)
        for first in range(0, len(names), together):
            some = names[first : first + together]
            fitted = _solve(blocks, some, first, sums, targets, size, lam, per_row, tolerance, max_steps)
            spark.createDataFrame(fitted, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def sparse_dot(weights: Column, ids: str = "ids", counts: str = "counts") -> Column:
    return F.aggregate(
        F.arrays_zip(F.col(ids).alias("i"), F.col(counts).alias("n")),
        F.lit(0.0),
        lambda total, cell: total + cell["n"] * F.get(weights, cell["i"]),
    )


def oof_predict_sparse(
    rows: DataFrame,
    models: DataFrame,
    targets: Sequence[str] = TARGET_COLUMNS,
    key: str = "prompt_id",
    prefix: str = "predicted_",
) -> DataFrame:
    """Score each row with the model that did not see its prompt, in the row."""
    wide = wide_models(models.filter(F.col("fold") != ALL), targets).withColumnRenamed("fold", key)
    scored = rows.join(wide, key)
    values = {prefix + t: F.col(f"model_{t}.intercept") + sparse_dot(F.col(f"model_{t}.weights")) for t in targets}
    return scored.select(*rows.columns, *[value.alias(name) for name, value in values.items()])
