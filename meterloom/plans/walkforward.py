"""Walk-forward fits: at each origin a model is fitted on all earlier rows and forecasts the rows of that day.

No history is read twice, and no row of a design leaves the task that read it. With z(t) = (x(t), y(t)), every input
partition reduces the consecutive rows of a day to the sums M(l) = sum of z(t) z(t-l)' for the lags l = 0..L, the first and last
L rows, and the number of known loads. Two neighbouring reductions merge exactly: their sums add, and the products that
cross the seam come from the last rows of one and the first rows of the other. Only these reductions are shuffled.

The rows of a series are then walked in order, one reduction at a time, with a running total. The total before an origin
holds everything the model needs:

- coefficients b from M(0);
- autocovariances of the residuals, (-b, 1)' M(l) (-b, 1): all residuals use the coefficients of this very origin;
- the last residuals, from the last rows.

A fold only changes the *basis*: scaling a column, or a trend that bends at a knot, is an affine map A of the raw terms
(constant on a part of a day between two knots), and the sums follow as A M(l) A'. So every fold has its own scaler, knots and
coefficients from one set of sums, and reads nothing at or after its origin. Coefficients return in the raw basis.

Rows without load count as rows (lags and positions see them) but enter no sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("series_id",)
LONG_AR = 20


def history_sums(panel: DataFrame, terms: Mapping[str, Column], keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Sums of each term over all earlier days of the series; 0 where there is no history."""
    days = panel.groupBy(*keys, F.to_date(ts).alias("date")).agg(*[F.sum(c).alias(n) for n, c in terms.items()])
    earlier = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*keys, "date", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in terms])


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


# ---- designs and their bases -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """One column of a fold's design as a map of raw columns.

    ``kind``: ``plain`` (the raw column), ``scaled`` (raw column minus its mean over the deviation; ``known`` is the raw column
    of 0/1 flags that stands in for the constant, ``stat`` the place in the fold's statistics), ``time`` (raw column over the
    fold's span) or ``hinge`` (time beyond ``knot``, 0 before it).
    """

    kind: str
    raw: int
    penalty: float
    known: int = 0
    stat: int = 0
    knot: int = 0
    at: float = 0.0


@dataclass(frozen=True)
class Basis:
    """The terms of a fold's design over ``width`` raw columns, the first of which is the constant."""

    terms: Sequence[Term]
    width: int

    @property
    def bends(self) -> bool:
        """Whether the basis changes along a series."""
        return any(t.kind == "hinge" for t in self.terms)

    def of(self, fold: dict, first_ts: int) -> np.ndarray:
        """Terms by raw columns, for rows from ``first_ts`` (microseconds) on up to the next knot of any fold."""
        out = np.zeros((len(self.terms), self.width))
        for r, t in enumerate(self.terms):
            if t.kind == "plain":
                out[r, t.raw] = 1.0
            elif t.kind == "scaled":
                mean, sd = fold["means"][t.stat], fold["sds"][t.stat]
                if mean is not None and sd is not None:
                    out[r, t.raw] = 1.0 / sd if sd else 1.0
                    out[r, t.known] -= mean * out[r, t.raw]
            elif fold["span"] and (t.kind == "time" or fold["knots"][t.knot] <= first_ts):
                out[r, t.raw] = 1.0 / fold["span"]
                out[r, 0] -= t.at if t.kind == "hinge" else 0.0
        return out

    @property
    def penalty(self) -> np.ndarray:
        return np.array([t.penalty for t in self.terms])


@dataclass(frozen=True)
class Design:
    """Raw columns, the constant first, and the terms made of them."""

    columns: Sequence[Column]
    terms: Sequence[Term]

    @property
    def basis(self) -> Basis:
        return Basis(tuple(self.terms), len(self.columns))


def plain_design(columns: Sequence[Column], penalty: float | Sequence[float]) -> Design:
    weights = [penalty] * len(columns) if isinstance(penalty, (int, float)) else list(penalty)
    return Design(list(columns), [Term("plain", i, w) for i, w in enumerate(weights)])


# ---- reductions of consecutive rows ------------------------------------------------------------------------------


def _symmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a.T @ b
    return (c + c.T) / 2


@dataclass
class Run:
    """Sums over rows ``first..last`` (positions in the series) and their outermost rows. Unknown rows are rows of zeros."""

    first: int
    last: int
    first_ts: int
    known: int
    sums: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    @classmethod
    def of(cls, first: int, first_ts: int, z: np.ndarray, known: int, lags: int) -> Run:
        sums = np.stack([_symmetric(z[l:], z[: len(z) - l]) if l < len(z) else np.zeros((z.shape[1],) * 2) for l in range(lags + 1)])
        return cls(first, first + len(z) - 1, first_ts, known, sums, z[:lags], z[max(0, len(z) - lags) :])

    def then(self, other: Run) -> Run:
        """Both runs as one; ``other`` follows, directly or after a gap."""
        lags = len(self.sums) - 1
        sums, head, tail = self.sums + other.sums, self.head, other.tail
        if lags and other.first == self.last + 1:
            n, m = len(self.tail), len(other.head)
            for l in range(1, lags + 1):
                lo, hi = max(0, l - n), min(l, m)
                if lo < hi:
                    sums[l] += _symmetric(other.head[lo:hi], self.tail[n - l + lo : n - l + hi])
            if len(head) < lags:
                head = np.concatenate([head, other.head])[:lags]
            if len(tail) < lags:
                tail = np.concatenate([self.tail, tail])[-lags:]
        return Run(self.first, other.last, self.first_ts, self.known + other.known, sums, head, tail)

    def seen_by(self, basis: np.ndarray) -> Run:
        """The run of ``basis x``; the load, last in z, stays."""
        t = np.zeros((len(basis) + 1, basis.shape[1] + 1))
        t[:-1, :-1], t[-1, -1] = basis, 1.0
        return Run(self.first, self.last, self.first_ts, self.known, t @ self.sums @ t.T, self.head @ t.T, self.tail @ t.T)


_RUN = "first_rn long, last_rn long, first_ts long, known long, sums array<double>, head array<double>, tail array<double>"


def _pack(run: Run, upper: tuple[np.ndarray, np.ndarray]) -> tuple:
    return run.first, run.last, run.first_ts, run.known, run.sums[:, upper[0], upper[1]].ravel(), run.head.ravel(), run.tail.ravel()


def _unpack(row: Sequence, q: int, lags: int) -> Run:
    first, last, first_ts, known, sums, head, tail = row
    upper = np.triu_indices(q)
    full = np.zeros((lags + 1, q, q))
    full[:, upper[0], upper[1]] = np.asarray(sums).reshape(lags + 1, -1)
    full[:, upper[1], upper[0]] = full[:, upper[0], upper[1]]
    return Run(first, last, first_ts, known, full, np.asarray(head, float).reshape(-1, q), np.asarray(tail, float).reshape(-1, q))


def day_runs(rows: DataFrame, design: Design, target: str = "total", lags: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, date, part`` and the run of the rows there, without a shuffle.

    ``rows`` has ``date``, the position ``rn`` and, where a day is cut, ``part``. A day that is spread over several input
    partitions gives several runs.
    """
    keys = list(keys)
    q = len(design.columns) + 1
    part = F.col("part") if "part" in rows.columns else F.lit(0)
    micros = F.unix_micros(F.col("ts").cast("timestamp")) if "ts" in rows.columns else F.lit(0).cast("long")
    cells = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in [*design.columns, F.col(target)]]
    taken = rows.select(*keys, "date", part.cast("int").alias("part"), F.col("rn").cast("long").alias("rn"), micros.alias("first_ts"), F.array(*cells).alias("z"))
    schema = f"{_key_schema(rows, keys)}, date date, part int, {_RUN}"
    upper = np.triu_indices(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # place and run of the rows that the next batch may go on with

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(*place, *_pack(r, upper)) for place, r in done]))
            types = [*id_types, pa.date32(), pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.float64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              [*keys, "date", "part", "first_rn", "last_rn", "first_ts", "known", "sums", "head", "tail"])

        for batch in batches:
            if not batch.num_rows:
                continue
            id_types = [batch.schema.field(i).type for i in range(len(keys))]
            z = np.asarray(batch.column(len(keys) + 4).flatten()).reshape(-1, q)
            codes = [np.asarray(batch.column(i).dictionary_encode(null_encoding="encode").indices) for i in range(len(keys))]
            day = np.asarray(batch.column(len(keys)).cast(pa.int32()))
            cut, rn, ts = (np.asarray(batch.column(len(keys) + i)) for i in (1, 2, 3))
            order = np.lexsort((rn, *codes[::-1]))
            z, day, cut, rn, ts, codes = z[order], day[order], cut[order], rn[order], ts[order], [c[order] for c in codes]
            known = ~np.isnan(z).any(1)
            z = np.where(known[:, None], z, 0.0)
            new = np.ones(len(rn), bool)
            new[1:] = rn[1:] != rn[:-1] + 1
            for c in (*codes, day, cut):
                new[1:] |= c[1:] != c[:-1]
            at = np.r_[np.flatnonzero(new), len(rn)]
            done = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                own = batch.slice(int(order[lo]), 1)
                place = (*[own.column(i)[0].as_py() for i in range(len(keys))], own.column(len(keys))[0].as_py(), int(cut[lo]))
                this = Run.of(int(rn[lo]), int(ts[lo]), z[lo:hi], int(known[lo:hi].sum()), lags)
                if held is not None and held[0] == place and held[1].last + 1 == this.first:
                    held = place, held[1].then(this)
                else:
                    if held is not None:
                        done.append(held)
                    held = place, this
            if done:
                yield batch_of(done)
        if held is not None:
            yield batch_of([held])

    return taken.mapInArrow(run, schema)


# ---- the walk ----------------------------------------------------------------------------------------------------

_FOLDS = "array<struct<fold:int,start:bigint,stop:bigint,means:array<double>,sds:array<double>,span:double,knots:array<bigint>>>"


def one_fold() -> Column:
    """Every row of a series is forecast, in the raw basis."""
    return F.expr(f"cast(array(struct(0 as fold, 0L as start, {2**62}L as stop, cast(array() as array<double>) as means, "
                  f"cast(array() as array<double>) as sds, cast(null as double) as span, cast(array() as array<bigint>) as knots)) as {_FOLDS})")


def _coefficients(total: Run, penalty: np.ndarray) -> np.ndarray:
    gram, moment = total.sums[0][:-1, :-1] + np.diag(penalty), total.sums[0][:-1, -1]
    try:
        return np.linalg.solve(gram, moment)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, moment, rcond=None)[0]


def error_state(total: Run, beta: np.ndarray, order: int = LONG_AR) -> tuple[float, float, float, float, float, float] | None:
    """``phi1, phi2, theta, u(t), u(t-1), theta e(t)`` after the rows of ``total``, whose last lag is ``order + 1``."""
    weight = np.r_[-beta, 1.0]
    fit = arma21_from_autocovariances(np.einsum("i,lij,j->l", weight, total.sums, weight) / max(1, total.known), order)
    if fit is None:
        return None
    (phi1, phi2, theta), flt = fit
    u = np.zeros(order + 1)
    recent = (total.tail @ weight)[::-1][: order + 1]
    u[: len(recent)] = recent
    return float(phi1), float(phi2), float(theta), float(u[0]), float(u[1]), float(theta * (flt @ u))


def walk(runs: DataFrame, design: Design, lags: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coefficients, and the state of ARMA(2,1) errors where ``lags`` is not 0, for every fold and part of a day.

    ``runs`` is a table of :func:`day_runs` with the series' ``folds``. Gives ``keys, date, part, fold, known`` (loads before the
    origin), ``first_rn, last_rn`` (of the part), ``beta`` (raw basis), ``phi1, phi2, theta`` and ``a, b, shock``: the last two
    errors and the carried shock just before the part.
    """
    keys = list(keys)
    terms = design.basis
    q, n_keys, penalty, bends = terms.width + 1, len(keys), terms.penalty, terms.bends
    names = ["phi1", "phi2", "theta", "a", "b", "shock"]

    def origin(fold: dict, run: Run, date) -> tuple:
        return date, run.first >= fold["start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, folds, raw, own, state = None, None, [], None, {}, {}
        out: list[tuple] = []

        def close() -> None:
            """Emit the held part, then add its rows to the totals."""
            nonlocal raw
            (date, part), this = held
            for i, fold in enumerate(folds):
                basis = terms.of(fold, this.first_ts)
                if fold["start"] <= this.first < fold["stop"]:
                    mark = origin(fold, this, date)
                    if state.get(i, (None,))[0] != mark:
                        total = own.get(i) if bends else (raw.seen_by(basis) if raw is not None else None)
                        if total is None or not total.known:
                            state[i] = (mark, None, None, 0)
                        else:
                            beta = _coefficients(total, penalty)
                            state[i] = (mark, beta, error_state(total, beta, lags - 1) if lags else None, total.known)
                    _, beta, errors, known = state[i]
                    if beta is not None:
                        phi1, phi2, theta, a, b, shock = errors or (None,) * 6
                        out.append((*key, date, part, fold["fold"], known, this.first, this.last, basis.T @ beta, phi1, phi2, theta, a, b, shock))
                        if errors:
                            for _ in range(this.last - this.first + 1):  # on to the next part of the day
                                a, b, shock = phi1 * a + phi2 * b + shock, a, 0.0
                            state[i] = (state[i][0], beta, (phi1, phi2, theta, a, b, shock), known)
                if bends:
                    own[i] = own[i].then(this.seen_by(basis)) if i in own else this.seen_by(basis)
            if not bends:
                raw = raw.then(this) if raw is not None else this

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [*id_types, pa.date32(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.list_(pa.float64()), *[pa.float64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*keys, "date", "part", "fold", "known", "first_rn", "last_rn", "beta", *names])

        for batch in batches:
            id_types = [batch.schema.field(i).type for i in range(n_keys)]
            plain = [batch.column(i).to_pylist() for i in range(n_keys + 6)]
            for r in range(batch.num_rows):
                this_key, place = tuple(c[r] for c in plain[:n_keys]), (plain[n_keys][r], plain[n_keys + 1][r])
                arrays = [batch.column(n_keys + 6 + i)[r].values.to_numpy(zero_copy_only=False) for i in range(3)]
                this = _unpack([*[c[r] for c in plain[n_keys + 2 :]], *arrays], q, lags)
                if this_key == key and place == held[0]:
                    held = place, held[1].then(this)
                    continue
                if held is not None:
                    close()
                if this_key != key:
                    key, folds, raw, own, state = this_key, batch.column(n_keys + 9)[r].as_py(), None, {}, {}
                held = place, this
            if out:
                yield batch_of()
                out = []
        if held is not None:
            close()
            if out:
                yield batch_of()

    ordered = runs.select(*keys, "date", "part", "first_rn", "last_rn", "first_ts", "known", "sums", "head", "tail", "folds")
    ordered = ordered.repartition(*keys).sortWithinPartitions(*keys, "first_rn")
    return ordered.mapInArrow(run, f"{_key_schema(runs, keys)}, date date, part int, fold int, known long, first_rn long, last_rn long, beta array<double>, "
                              + ", ".join(f"{n} double" for n in names))


def error_path() -> Column:
    """Errors of ARMA(2,1) for every row of a part, from the state before it; null without a state."""
    start = F.struct(F.array().cast("array<double>").alias("path"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("shock").alias("shock"))

    def step(s: Column, _: Column) -> Column:
        now = F.col("phi1") * s["a"] + F.col("phi2") * s["b"] + s["shock"]
        return F.struct(F.array_append(s["path"], now).alias("path"), now.alias("a"), s["a"].alias("b"), F.lit(0.0).alias("shock"))

    steps = F.sequence(F.lit(1).cast("long"), F.col("last_rn") - F.col("first_rn") + 1)
    return F.when(F.col("phi1").isNotNull(), F.aggregate(steps, start, step, lambda s: s["path"]))


def walk_forward(rows: DataFrame, design: Design, folds: DataFrame | None = None, target: str = "total", lags: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``rows`` with ``fold``, ``fitted`` (the regression) and ``predicted`` (with the forecast of the errors where there are lags).

    ``folds`` has the ``folds`` of each series; without it every row is forecast, in the raw basis, as fold 0. A row appears once for
    each fold that forecasts it; rows without any history have null forecasts.
    """
    runs = day_runs(rows, design, target, lags, keys)
    runs = runs.withColumn("folds", one_fold()) if folds is None else runs.join(folds.select(*keys, "folds"), list(keys))
    solved = walk(runs, design, lags, keys)
    solved = solved.withColumn("errors", error_path()) if lags else solved
    placed = [*keys, "date", "part"] if "part" in rows.columns else [*keys, "date"]
    made = solved.select(*placed, "fold", "beta", "first_rn", *(["errors"] if lags else []))
    joined = rows.join(made, placed, "left")
    fitted = reduce(lambda s, x: s + x, [F.col("beta")[i] * c.cast("double") for i, c in enumerate(design.columns)])
    out = joined.withColumn("fitted", fitted)
    ahead = F.coalesce(F.get("errors", (F.col("rn") - F.col("first_rn")).cast("int")), F.lit(0.0)) if lags else F.lit(0.0)
    return out.withColumn("predicted", F.col("fitted") + ahead).drop("beta", "first_rn", "errors")


def walk_forward_linear(rows: DataFrame, design: Sequence[Column], target: str = "total", penalty: float | Sequence[float] = 1e-3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``fitted``: a regression on all days before the row's own."""
    return walk_forward(rows, plain_design(design, penalty), target=target, keys=keys).drop("fold", "predicted")


# ---- ARMA(2,1) errors --------------------------------------------------------------------------------------------


def arma21_from_autocovariances(g: np.ndarray, order: int = LONG_AR) -> tuple[np.ndarray, np.ndarray] | None:
    """Hannan-Rissanen estimate from autocovariances g[0..order+1].

    A long autoregression stands in for the innovations; the ARMA coefficients are the regression of u(t) on u(t-1),
    u(t-2) and the innovation at t-1, all of whose moments are combinations of g. Returns (phi1, phi2, theta) and the
    innovation filter, or None when g carries no information.
    """
    if not np.isfinite(g).all() or g[0] <= 1e-12:
        return None
    lag = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    ar = np.linalg.solve(g[lag] + np.eye(order) * g[0] * 1e-6, g[1 : order + 1])
    flt = np.concatenate([[1.0], -ar])
    i = np.arange(order + 1)
    e0 = flt @ g[np.abs(np.subtract.outer(i, i))] @ flt
    u1, u2, u0 = flt @ g[i], flt @ g[np.abs(1 - i)], flt @ g[i + 1]
    m = np.array([[g[0], g[1], u1], [g[1], g[0], u2], [u1, u2, e0]])
    try:
        phi1, phi2, theta = np.linalg.solve(m, np.array([g[1], g[2], u0]))
    except np.linalg.LinAlgError:
        phi1, phi2, theta = np.inf, np.inf, 0.0
    if not (abs(phi2) < 1 and phi2 + phi1 < 1 and phi2 - phi1 < 1):
        # Outside the stationary region: the autoregressive part by Yule-Walker, which always lies inside.
        r1, r2 = g[1] / g[0], g[2] / g[0]
        phi1, phi2, theta = r1 * (1 - r2) / (1 - r1**2 + 1e-12), (r2 - r1**2) / (1 - r1**2 + 1e-12), 0.0
    return np.array([phi1, phi2, theta]), flt
