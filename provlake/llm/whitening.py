"""Whitening vectors by incremental eigendecomposition.

Entries become whole numbers, and the covariance is that of the distinct vectors (the fit list).  Every partition of the
fit list applies a centred rank-one update for each of its vectors (``eigen_update``).  The spectra of the partitions are
combined in a tree, sixteen at a time, by further rank-one updates.  Rounding of many updates is then taken out by one
distributed Rayleigh-Ritz step: the vectors are projected on the basis found, their covariance there is summed over
partitions, and its small eigenproblem turns the basis into eigenvectors to double precision.  A last pass measures the
covariance of the whitened fit list.

What reaches the driver is one spectrum, one small matrix and exact sums of whole numbers, whatever the number of rows.

Edge cases: rows whose vector is null, empty, holds null or non-finite entries, or is narrower than the widest vector of
the table (its missing entries count as null) are dropped; entries beyond 2**40 are held at 2**40; a null vec_id stays null; repeated rows are
returned each but fit once; other columns are ignored; an empty table gives no rows.  Directions without variance (an
eigenvalue of at most 1e-12 of the trace) are no components, so one distinct vector alone gives no rows.  A deviation
beyond a long is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import arrow_schema, saved, ship_package
from provlake.llm.eigen_update import Spectrum

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2**40
FAN_IN = 16  # spectra that one task combines
LEAST_SHARE = 1e-12  # of the trace, for an eigenvalue to be a component
LOW_BITS = 20  # sums of whole numbers are kept as high and low parts, so that they stay exact

PARTS = "part long, state binary, high array<long>, low array<long>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows that can be whitened; ``x`` holds whole numbers."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("e") > 0))
    width = rows.agg(F.max(F.size("e"))).first()[0]

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(SCALE * c, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))) + SHIFT

    return rows.where(F.size("e") == (width or 0)).select("vec_id", F.transform("e", whole).alias("x"))


def matrix_of(column):
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def combined(parts: DataFrame, merge) -> list | None:
    """Reduce rows of ``PARTS`` to one by ``merge(states)``, ``FAN_IN`` at a time; None for no rows."""
    schema = arrow_schema(PARTS)

    def step(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        sums = [np.sum([r[c] for r in rows], axis=0).tolist() for c in ("high", "low")]
        return pa.table([[rows[0]["part"] // FAN_IN], [merge([r["state"] for r in rows])], *[[s] for s in sums]], schema=schema)

    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return None
    while top > 0:
        parts = saved(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(step, PARTS), "eigen-level")
        top //= FAN_IN
    return parts.first()


def per_partition(fit: DataFrame, start, add, finish) -> DataFrame:
    """One row of ``PARTS`` for each partition of ``fit(x)`` that has rows; sums of ``x`` are exact."""
    schema = arrow_schema(PARTS)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        state, high, low = start(), 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                state = add(state, x)
                high, low = high + (x >> LOW_BITS).sum(axis=0), low + (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if not np.isscalar(high):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(
                ([TaskContext.get().partitionId()], [finish(state)], [high.tolist()], [low.tolist()]), schema, strict=True)], schema=schema)

    return saved(fit.mapInArrow(run, PARTS), "eigen-parts")


def summed_squares(fit: DataFrame, mean, basis):
    """Sum over the fit list of the outer products of the centred vectors projected on ``basis``."""
    import numpy as np

    size = basis.shape[1]

    def add(total, x):
        y = (x - mean) @ basis
        return total + y.T @ y

    row = combined(per_partition(fit, lambda: np.zeros((size, size)), add, lambda m: m.tobytes()),
                   lambda states: np.sum([np.frombuffer(s) for s in states], axis=0).tobytes())
    return np.frombuffer(row["state"]).reshape(size, size)


def spectrum_of(fit: DataFrame, width: int):
    """The combined spectrum of ``fit(x)`` with the exact sums of its entries, or None when there are no rows."""

    def add(state, x):
        for row in x.astype(float):
            state.add(row)
        return state

    def merge(states):
        first, *others = [Spectrum.from_bytes(s, width) for s in states]
        for s in others:
            first.merge(s)
        return first.to_bytes()

    row = combined(per_partition(fit, lambda: Spectrum(width), add, Spectrum.to_bytes), merge)
    if row is None:
        return None
    return Spectrum.from_bytes(row["state"], width), [(h << LOW_BITS) + low for h, low in zip(row["high"], row["low"], strict=True)]


class Whitening:
    """Exact count and sums of the fit list, eigenvalues (falling), eigenvectors as columns, and the measured error."""

    def __init__(self, fit: DataFrame, width: int, components: int):
        import numpy as np

        found = spectrum_of(fit, width)
        self.n, self.sums, self.values = 0, [0] * width, np.zeros(0)
        if found is None:
            return
        spectrum, self.sums = found
        self.n = spectrum.n
        self.mean = np.array([s / self.n for s in self.sums])
        basis, _ = np.linalg.qr(spectrum.q[:, ::-1])
        inner = summed_squares(fit, self.mean, basis) / self.n
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        self.trace = float(np.trace(inner))
        keep = [k for k in range(width - 1, -1, -1) if values[k] > LEAST_SHARE * self.trace][:components]
        self.values, self.vectors = values[keep], (basis @ turn)[:, keep]
        if len(self.values):
            unit = summed_squares(fit, self.mean, self.vectors / np.sqrt(self.values)) / self.n
            self.identity_error = float(abs(unit - np.eye(len(keep))).max())


def fitted(rows: DataFrame, components: int = 16) -> Whitening:
    """Fit on the distinct vectors of ``rows(x)``."""
    ship_package(rows.sparkSession)
    fit = saved(rows.select("x").distinct(), "fit-list")
    first = fit.first()
    return Whitening(fit, len(first["x"]) if first else 0, components)


def deviations(x, n: int, sums: list[int]):
    """Exact sums of (n * x - S)**2 per row; None where a long cannot hold one."""
    import numpy as np

    rough = (((x.astype(float) - np.array([s / n for s in sums])) * n) ** 2).sum(axis=1)
    low = np.array([s & (2**64 - 1) for s in sums], dtype=np.uint64).astype(np.int64)
    with np.errstate(over="ignore"):  # differences that fit are right also when n * x wraps
        off = x * np.int64(n) - low
        out = (off * off).sum(axis=1).tolist()
    for k in np.flatnonzero(rough > 2.0**62):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums, strict=True))
        out[k] = exact if exact < 2**63 else None
    return out


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """Rows of ``RESULT``: each row of ``rows(vec_id, x)`` on every component."""
    schema = arrow_schema(RESULT)
    k, n, sums = len(model.values), model.n, model.sums
    if k:
        mean, basis = model.mean, model.vectors / model.values**0.5
        shares, error = model.values / model.trace, model.identity_error

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x, m = matrix_of(batch.column(1)), batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            dev = pa.array(deviations(x, n, sums), type=pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), dev,
                pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))], schema=schema)

    return rows.mapInArrow(run, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the first 16 whitened components."""
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitened(rows, fitted(rows))
