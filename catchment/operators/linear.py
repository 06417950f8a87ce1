"""Linear-Gaussian filter and smoothers for any model, over many series at once and over long ones in spans.

A model says how a state of n numbers moves from row to row (F, with noise Q) and how m readings show it (H, with noise R), each for every row of its own;
see Model, and Given for matrices that are constants or array columns. A step, or any run of them, acts on the state before it as an element
(A, b, C, eta, J) of five arrays, and two elements compose to one (temporal parallelisation of Bayesian smoothers, Sarkka and Garcia-Fernandez 2021). So each span of a series
is first composed to one element by its own task, then the short list of elements gives every span its starting state, and then all spans are filtered at once.
A long series needs no task of its own. Backwards the same is done with affine functions of the state behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, finite, span_of, with_next, with_previous
from ..plans.config import SYMMETRY, covariance, negative_direction

#: How far a covariance may be raised, as a share of its own scale, before it counts as not scorable.
MOST_RAISED = 1e-6
#: Rows that a task works on at once; more cost memory and save no time.
BLOCK_ROWS = 20_000
LOG_TWO_PI = float(np.log(2 * np.pi))


@runtime_checkable
class Model(Protocol):
    """What the filter needs of a model; the methods get blocks of step rows and return one array a row.

    reads: the columns of readings (null: missing); moves: the columns that transitions reads; needs: those that process, observation and
    initial read. A row without dt starts its series: it doesn't move.
    """

    states: int
    reads: tuple[str, ...]
    moves: tuple[str, ...]
    needs: tuple[str, ...]

    def transitions(self, rows: pd.DataFrame) -> np.ndarray: ...

    def process(self, rows: pd.DataFrame) -> np.ndarray: ...

    def observation(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]: ...

    def initial(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]: ...


@dataclass(frozen=True)
class Given:
    """A model whose matrices are given: each as a constant for all rows, or as the name of a column of arrays in row-major order (see matrix_faults).

    mean and cov are the state before the first reading.
    """

    reads: tuple[str, ...]
    f: object
    q: object
    h: object
    r: object
    mean: object
    cov: object

    def __post_init__(self):
        mean = np.asarray(self.mean, dtype=float)
        if mean.ndim != 1 or not mean.size or not self.reads:
            raise ValueError("a model needs a state and a reading")
        if not np.isfinite(mean).all():
            raise ValueError("the initial mean must be finite")
        covariance(self.cov, mean.size, "cov")
        for name, shape in self.shapes().items():
            value = getattr(self, name)
            if isinstance(value, str):
                continue
            if np.shape(value) != shape or not np.isfinite(np.asarray(value, dtype=float)).all():
                raise ValueError(f"{name} takes {' x '.join(map(str, shape))} finite numbers")
            if name in "qr":
                covariance(value, shape[0], name)

    @property
    def states(self) -> int:
        return len(self.mean)

    def shapes(self) -> dict[str, tuple[int, int]]:
        n, m = self.states, len(self.reads)
        return {"f": (n, n), "q": (n, n), "h": (m, n), "r": (m, m)}

    def _columns(self, names: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for v in (getattr(self, x) for x in names) if isinstance(v, str)))

    @property
    def moves(self) -> tuple[str, ...]:
        return self._columns("f")

    @property
    def needs(self) -> tuple[str, ...]:
        return self._columns("qhr")

    def _each(self, name: str, rows: pd.DataFrame) -> np.ndarray:
        value, shape = getattr(self, name), self.shapes()[name]
        if not isinstance(value, str):
            return np.broadcast_to(np.asarray(value, dtype=float), (len(rows), *shape)).copy()
        out = np.zeros((len(rows), shape[0] * shape[1]))
        for i, v in enumerate(rows[value]):
            if v is not None:
                out[i] = v
        return out.reshape(-1, *shape)

    def transitions(self, rows: pd.DataFrame) -> np.ndarray:
        return self._each("f", rows)

    def process(self, rows: pd.DataFrame) -> np.ndarray:
        return self._each("q", rows)

    def observation(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return self._each("h", rows), self._each("r", rows)

    def initial(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = self.states
        return np.broadcast_to(np.asarray(self.mean, dtype=float), (len(rows), n)).copy(), np.broadcast_to(np.asarray(self.cov, dtype=float), (len(rows), n, n)).copy()


def matrix_faults(rows: DataFrame, model: Given) -> DataFrame:
    """(series, us, matrix, fault) for rows whose array columns don't fit the model: a wrong size, values that aren't finite, and for Q and R an array that differs from its transpose or has a negative variance in some direction.

    f and q of a series' first row aren't used, but must fit or be null.
    """
    found = None
    for name, (high, wide) in model.shapes().items():
        c = getattr(model, name)
        if not isinstance(c, str):
            continue
        bad = F.when(F.size(c) != high * wide, "size").when(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        if name in "qr":
            far = [F.abs(F.col(c)[i * wide + j] - F.col(c)[j * wide + i]) > SYMMETRY[1] + SYMMETRY[0] * F.abs(F.col(c)[j * wide + i]) for i in range(high) for j in range(i)]
            for x in far:
                bad = bad.when(x, "not symmetric")
            # Only arrays without another fault go to Python.
            bad = F.when(bad.isNotNull(), bad).when(_negative(high)(F.when(bad.isNull(), F.col(c)).otherwise(F.array().cast("array<double>"))), "negative variance")
        missing = F.when(F.col(c).isNull() & (F.lit(name in "hr") | F.col("dt").isNotNull()), "missing")
        one = rows.filter(F.col(c).isNotNull()).withColumn("fault", bad).select("series", "us", "fault").unionByName(rows.filter(F.col(c).isNull()).withColumn("fault", missing).select("series", "us", "fault"))
        one = one.filter("fault IS NOT NULL").select("series", "us", F.lit(name).alias("matrix"), "fault")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else rows.sparkSession.createDataFrame([], "series string, us long, matrix string, fault string")


def _negative(size: int) -> Callable:
    """Whether arrays of size x size numbers have a negative variance in some direction; false for other sizes."""

    def test(values: pd.Series) -> pd.Series:
        return pd.Series([len(v) == size * size and negative_direction(np.asarray(v, dtype=float).reshape(size, size)) for v in values], dtype=bool)

    return F.pandas_udf(test, "boolean")


def infinite_readings(obs: DataFrame, reads: tuple[str, ...]) -> DataFrame:
    """(series, us, reading) for each reading that is infinite: neither a number nor missing."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.abs(F.col(c)) == float("inf"), F.lit(c)) for c in reads])))
    return obs.select("series", "us", each.alias("reading"))


def model_steps(obs: DataFrame, model: Model, span: int = SPAN_US) -> DataFrame:
    """obs(series, us, readings, columns of the model) with dt, the seconds since the series' row before (null for its first): the step rows of filtered.

    NaN readings are missing; an infinite one is an error.
    """
    rows = obs
    for c in model.reads:
        wrong = F.raise_error(F.concat(F.lit(f"{c} is infinite in series "), F.col("series").cast("string"))).cast("double")
        rows = rows.withColumn(c, F.when(F.abs(F.col(c)) == float("inf"), wrong).otherwise(finite(c)))
    timed = with_previous(rows, "series", ["us"], "before", span)
    return timed.withColumn("dt", (F.col("us") - F.col("before.us")) / 1e6).drop("before")


@dataclass(frozen=True)
class Names:
    """Column names of a state of n numbers and m readings: covariances by their upper triangle."""

    n: int
    m: int

    def upper(self, prefix: str, size: int) -> list[str]:
        between = "" if size <= 10 else "_"
        return [f"{prefix}{i}{between}{j}" for i in range(size) for j in range(i, size)]

    @property
    def mean(self) -> list[str]:
        return [f"m{i}" for i in range(self.n)]

    @property
    def cov(self) -> list[str]:
        return self.upper("p", self.n)

    @property
    def state(self) -> list[str]:
        return self.mean + self.cov

    @property
    def before(self) -> list[str]:
        return [f"b{c}" for c in self.state]

    @property
    def smoothed(self) -> list[str]:
        return [f"s{c}" for c in self.state]

    @property
    def innovation(self) -> list[str]:
        return [f"v{i}" for i in range(self.m)]

    @property
    def spread(self) -> list[str]:
        return self.upper("s", self.m)

    @property
    def element(self) -> list[str]:
        n = self.n
        return [f"{c}{i}" for c, k in (("a", n * n), ("b", n), ("c", n * n), ("e", n), ("j", n * n)) for i in range(k)]

    @property
    def backward(self) -> list[str]:
        n = self.n
        return [f"{c}{i}" for c, k in (("a", n * n), ("e", n), ("l", n * n)) for i in range(k)]


def names_of(model: Model) -> Names:
    return Names(model.states, len(model.reads))


def t_(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def sym(x: np.ndarray) -> np.ndarray:
    return (x + t_(x)) / 2


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Matrices times vectors."""
    return (a @ x[..., None])[..., 0]


def solved(s: np.ndarray, b: np.ndarray) -> np.ndarray:
    """s^-1 b for many symmetric s; a singular one is inverted as far as it goes. Each is solved as if alone."""
    try:
        return np.linalg.solve(s, b)
    except np.linalg.LinAlgError:
        singular = np.linalg.slogdet(s)[0] == 0
        out = np.empty(np.broadcast_shapes(s.shape[:-2], b.shape[:-2]) + (s.shape[-1], b.shape[-1]))
        out[~singular] = np.linalg.solve(s[~singular], b[~singular])
        out[singular] = np.linalg.pinv(s[singular], hermitian=True) @ b[singular]
        return out


def seen_readings(y: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(H, R, y) with the missing components (NaN) taken out: their rows of H are zero, their variance one, their value zero."""
    seen = np.isfinite(y)
    own = r * (seen[:, :, None] & seen[:, None, :])
    at = np.arange(y.shape[1])
    own[:, at, at] += ~seen
    return h * seen[:, :, None], own, np.where(seen, y, 0.0)


def predict(m: np.ndarray, p: np.ndarray, f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) after moving by F with noise Q, for many states at once."""
    return times(f, m), sym(f @ p @ t_(f) + q)


def update(m: np.ndarray, p: np.ndarray, y: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mean, covariance, innovation, its covariance) after readings y (NaN: missing), for many states at once.

    The covariance is in Joseph form; a singular innovation covariance is inverted as far as it goes, its row's neighbours untouched.
    """
    h, own, z = seen_readings(y, h, r)
    v = z - times(h, m)
    s = sym(h @ p @ t_(h) + own)
    gain = t_(solved(s, h @ p))
    rest = np.eye(m.shape[1]) - gain @ h
    return m + times(gain, v), sym(rest @ p @ t_(rest) + gain @ own @ t_(gain)), v, s


def log_density(v: np.ndarray, s: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Logarithm of the normal density of each row's count readings (0 for none). v and s are as update gives them: what is missing adds nothing.

    A covariance without a Cholesky factor is raised on its diagonal, from rounding size in steps of ten times, by its own scale; NaN beyond MOST_RAISED of it.
    """
    out = np.full(len(v), np.nan)
    scale = np.trace(s, axis1=1, axis2=2) / s.shape[1]
    todo, raised = np.flatnonzero(np.isfinite(scale) & (scale > 0)), 0.0
    while len(todo):
        own = s[todo] + raised * scale[todo][:, None, None] * np.eye(s.shape[1])
        good, root = np.ones(len(todo), dtype=bool), None
        try:
            root = np.linalg.cholesky(own)
        except np.linalg.LinAlgError:
            root = np.zeros_like(own)
            for i, x in enumerate(own):
                try:
                    root[i] = np.linalg.cholesky(x)
                except np.linalg.LinAlgError:
                    good[i] = False
        at = todo[good]
        white = np.linalg.solve(root[good], v[at][:, :, None])[:, :, 0]
        logs = 2 * np.log(np.diagonal(root[good], axis1=1, axis2=2)).sum(axis=1)
        out[at] = -0.5 * (count[at] * LOG_TWO_PI + logs + (white * white).sum(axis=1))
        todo, raised = todo[~good], max(np.finfo(float).eps, raised * 10)
        if raised > MOST_RAISED:
            break
    return np.where(count == 0, 0.0, out)


def step_elements(y: np.ndarray, f: np.ndarray, q: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """The element of each step: move by F with noise Q, then read y."""
    h, own, z = seen_readings(y, h, r)
    s = sym(h @ q @ t_(h) + own)
    hf = h @ f
    gain = t_(solved(s, h @ q))
    rest = np.eye(f.shape[1]) - gain @ h
    weighed = solved(s, z[:, :, None])[:, :, 0]
    return rest @ f, times(gain, z), sym(rest @ q), times(t_(hf), weighed), sym(t_(hf) @ solved(s, hf))


def compose(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The elements x followed by y."""
    a1, b1, c1, e1, j1 = x
    a2, b2, c2, e2, j2 = y
    one = np.eye(a1.shape[1])
    left = t_(np.linalg.solve(t_(one + c1 @ j2), t_(a2)))
    right = t_(np.linalg.solve(t_(one + j2 @ c1), a1))
    return left @ a1, times(left, b1 + times(c1, e2)) + b2, sym(left @ c1 @ t_(a2) + c2), times(right, e2 - times(j2, b1)) + e1, sym(right @ j2 @ a1 + j1)


def apply_element(m: np.ndarray, p: np.ndarray, x: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """State (m, p) after the element."""
    a, b, c, e, j = x
    left = t_(np.linalg.solve(t_(np.eye(a.shape[1]) + p @ j), t_(a)))
    return times(left, m + times(p, e)) + b, sym(left @ p @ t_(a) + c)


def packed(p: np.ndarray) -> np.ndarray:
    """The upper triangles of symmetric arrays, row by row."""
    i, j = np.triu_indices(p.shape[-1])
    return p[:, i, j]


def unpacked(v: np.ndarray) -> np.ndarray:
    n = int((np.sqrt(8 * v.shape[1] + 1) - 1) / 2)
    p = np.empty((len(v), n, n))
    i, j = np.triu_indices(n)
    p[:, i, j] = v
    p[:, j, i] = v
    return p


def groups_of(df: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of equal keys in a sorted frame."""
    new = np.ones(len(df), dtype=bool)
    if len(df):
        new[1:] = np.logical_or.reduce([df[k].to_numpy()[1:] != df[k].to_numpy()[:-1] for k in keys])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(df)))


def in_step(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows) for the first row of every group, then the second, ..."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    for t in range(size[0] if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        yield order[:n], start[:n] + t


def in_step_back(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows) for the last row of every group, then the last but one, ..."""
    for groups, rows in in_step(start, size):
        yield groups, 2 * start[groups] + size[groups] - 1 - rows


def by_groups(df: DataFrame, keys: list[str], order: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """work over whole groups of keys, many at a time, in blocks of about `rows` rows, sorted by keys and order.

    Groups are dealt by hash and sorted by Spark; a block ends where a group ends, so memory is bounded by
    `rows` and the largest group, which the span bounds.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= rows:
                whole = pd.concat(held, ignore_index=True)
                start, _ = groups_of(whole, keys)
                if start[-1]:
                    yield work(whole.iloc[: start[-1]].reset_index(drop=True))
                held = [whole.iloc[start[-1] :].reset_index(drop=True)]
        if held and any(map(len, held)):
            yield work(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def doubles(columns: list[str]) -> str:
    return ", ".join(f"{n} double" for n in columns)


def kernel_inputs(df: pd.DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """(y, F, Q, H, R) of step rows.

    A row that starts its series doesn't move; its noise is the initial covariance, and the state before it is the initial mean with no
    covariance. So a first reading without noise is taken in like any other.
    """
    first = df["dt"].isna().to_numpy()
    f, q = model.transitions(df), model.process(df)
    f[first] = np.eye(model.states)
    if first.any():
        q[first] = model.initial(df[first])[1]
    h, r = model.observation(df)
    return df[list(model.reads)].to_numpy(dtype=float), f, q, h, r


def composed_groups(parts: tuple[np.ndarray, ...], start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """One element a group: its rows' elements one after the other."""
    out = [x[start].copy() for x in parts]
    for groups, rows in in_step(start, size):
        if rows[0] == start[groups[0]]:
            continue
        for target, value in zip(out, compose(tuple(x[groups] for x in out), tuple(x[rows] for x in parts)), strict=True):
            target[groups] = value
    return out


def filtered_groups(m: np.ndarray, p: np.ndarray, inputs: tuple[np.ndarray, ...], start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mean and covariance before each reading, after it, innovation, its covariance) of all rows, from the groups' states (m, p), which are changed."""
    y, f, q, h, r = inputs
    rows_, n, k = len(y), m.shape[1], y.shape[1]
    out = tuple(np.empty((rows_, *shape)) for shape in ((n,), (n, n), (n,), (n, n), (k,), (k, k)))
    if len(start) == 1:
        _filtered_alone(m, p, inputs, range(start[0], start[0] + size[0]), out)
        return out
    for groups, rows in in_step(start, size):
        bm, bp = predict(m[groups], p[groups], f[rows], q[rows])
        m[groups], p[groups], v, s = update(bm, bp, y[rows], h[rows], r[rows])
        for target, value in zip(out, (bm, bp, m[groups], p[groups], v, s), strict=True):
            target[rows] = value
    return out


def _filtered_alone(m: np.ndarray, p: np.ndarray, inputs: tuple[np.ndarray, ...], rows: range, out: tuple[np.ndarray, ...]) -> None:
    """filtered_groups of one group: the same steps on single matrices, as arrays of one cost several times the work."""
    y, f, q, h, r = inputs
    h, own, z = seen_readings(y, h, r)
    mean, cov, one = m[0], p[0], np.eye(m.shape[1])
    for i in rows:
        bm, bp = f[i] @ mean, f[i] @ cov @ f[i].T + q[i]
        bp = (bp + bp.T) / 2
        v, hp = z[i] - h[i] @ bm, h[i] @ bp
        s = hp @ h[i].T + own[i]
        s = (s + s.T) / 2
        gain = solved(s[None], hp[None])[0].T
        rest = one - gain @ h[i]
        mean, cov = bm + gain @ v, rest @ bp @ rest.T + gain @ own[i] @ gain.T
        cov = (cov + cov.T) / 2
        for target, value in zip(out, (bm, bp, mean, cov, v, s), strict=True):
            target[i] = value
    m[0], p[0] = mean, cov


def span_elements(spans: DataFrame, model: Model) -> DataFrame:
    """One composed element per (series, span) of step rows, with what the initial state needs of the span's first row."""
    names = names_of(model)
    keep = [c for c in dict.fromkeys(model.needs) if c not in ("series", "span")]

    def work(df: pd.DataFrame) -> pd.DataFrame:
        start, size = groups_of(df, ["series", "span"])
        out = composed_groups(step_elements(*kernel_inputs(df, model)), start, size)
        flat = np.hstack([x.reshape(len(start), -1) for x in out])
        return pd.concat([pd.DataFrame(flat, columns=names.element), df.iloc[start][["series", "span", *keep]].reset_index(drop=True)], axis=1)

    kept = "".join(f", {c} {spans.schema[c].dataType.simpleString()}" for c in keep)
    return by_groups(spans, ["series", "span"], "us", work, f"{doubles(names.element)}, series string, span long{kept}")


def elements_of(df: pd.DataFrame, n: int) -> tuple[np.ndarray, ...]:
    """The five arrays of element rows."""
    x, out, at = df[Names(n, 0).element].to_numpy(dtype=float), [], 0
    for shape in ((n, n), (n,), (n, n), (n,), (n, n)):
        k = int(np.prod(shape))
        out.append(x[:, at : at + k].reshape(-1, *shape))
        at += k
    return tuple(out)


def span_states(elements: DataFrame, model: Model) -> DataFrame:
    """(series, span, m0, ...): the state before each span, by applying the elements of the spans before it in turn."""
    names = names_of(model)

    def work(df: pd.DataFrame) -> pd.DataFrame:
        parts = elements_of(df, model.states)
        start, size = groups_of(df, ["series"])
        m = model.initial(df.iloc[start])[0]
        p = np.zeros((len(start), model.states, model.states))
        means, covs = np.empty((len(df), model.states)), np.empty((len(df), model.states, model.states))
        for groups, rows in in_step(start, size):
            means[rows], covs[rows] = m[groups], p[groups]
            m[groups], p[groups] = apply_element(m[groups], p[groups], tuple(v[rows] for v in parts))
        return pd.DataFrame(np.hstack([means, packed(covs)]), columns=names.state).assign(series=df["series"].to_numpy(), span=df["span"].to_numpy())

    return by_groups(elements, ["series"], "span", work, f"{doubles(names.state)}, series string, span long")


def filtered(step_rows: DataFrame, model: Model, keeps: tuple[str, ...] = (), span: int = SPAN_US) -> DataFrame:
    """The filter over step_rows(series, us, dt, the model's columns, keeps): (series, us, readings, dt, moves, keeps, bm0 .., m0 .., v0 .., s00 .., log_density).

    bm0 .. and bp00 .. are the state before the reading, m0 .. and p00 .. after it, v0 .. the innovations (null if not read), s00 .. their covariance, and log_density
    the logarithm of the readings' density (0 without any; null if the covariance isn't positive definite however little it is raised).
    """
    names = names_of(model)
    spans = step_rows.withColumn("span", span_of("us", span))
    joined = spans.join(span_states(span_elements(spans, model), model), ["series", "span"])
    numbers = names.before + names.state + names.innovation + names.spread + ["log_density"]
    keep = list(dict.fromkeys(["series", "us", *model.reads, "dt", *model.moves, *keeps]))

    def work(df: pd.DataFrame) -> pd.DataFrame:
        inputs = kernel_inputs(df, model)
        start, size = groups_of(df, ["series", "span"])
        bm, bp, m, p, v, s = filtered_groups(df[names.mean].to_numpy()[start], unpacked(df[names.cov].to_numpy()[start]), inputs, start, size)
        seen = np.isfinite(inputs[0])
        flat = np.hstack([bm, packed(bp), m, packed(p), np.where(seen, v, np.nan), packed(s), log_density(v, s, seen.sum(axis=1))[:, None]])
        return pd.concat([df[keep].reset_index(drop=True), pd.DataFrame(flat, columns=numbers)], axis=1)

    types = {c: step_rows.schema[c].dataType.simpleString() for c in keep}
    done = by_groups(joined, ["series", "span"], "us", work, ", ".join(f"{c} {k}" for c, k in types.items()) + ", " + doubles(numbers))
    nan = {c for c, k in types.items() if k == "double"} | {*names.innovation, "log_density"}
    return done.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in nan else c for c in keep + numbers])


def with_row_behind(states: DataFrame, model: Model, span: int) -> DataFrame:
    """Filtered rows with n_us and what the smoothers need of the row behind in the series (null for the last)."""
    names = names_of(model)
    carried = list(dict.fromkeys(["dt", *model.moves, *names.before, *names.state]))
    ahead = with_next(states, "series", carried, "next", span)
    return ahead.select("series", span_of("us", span).alias("span"), "us", *names.state, *[F.col(f"next.{n}").alias(f"n_{n}") for n in ("us", *carried)])


def backward_functions(df: pd.DataFrame, model: Model) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """((A, e, L), whether there is a row behind): a row's smoothed state as a function of that of the row behind it, A x + e and A P A' + L; without one, A is zero."""
    names = names_of(model)
    has_next = df["n_us"].notna().to_numpy()
    m, p = df[names.mean].to_numpy(), unpacked(df[names.cov].to_numpy())
    n_before = np.nan_to_num(df[[f"n_{x}" for x in names.before]].to_numpy(dtype=float))
    bm, bp = n_before[:, : model.states], unpacked(n_before[:, model.states :])
    f = model.transitions(df[[f"n_{c}" for c in model.moves]].set_axis(list(model.moves), axis=1) if model.moves else df[["us"]])
    return backward_parts(m, p, bm, bp, f, has_next), has_next


def backward_parts(m: np.ndarray, p: np.ndarray, bm: np.ndarray, bp: np.ndarray, f: np.ndarray, has_next: np.ndarray) -> tuple[np.ndarray, ...]:
    """The functions (A, e, L) of backward_functions from the states after each row's reading, and from F and the state before the reading of the row behind it; bp is changed."""
    bp[~has_next] = np.eye(m.shape[1])
    gain = t_(solved(bp, f @ p)) * has_next[:, None, None]
    return gain, m - times(gain, bm), sym(p - gain @ bp @ t_(gain))


def after(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The backward function x of what y gives."""
    a, e, l_ = x
    return a @ y[0], e + times(a, y[1]), l_ + a @ y[2] @ t_(a)


def applied(x: tuple[np.ndarray, ...], m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, e, l_ = x
    return e + times(a, m), sym(l_ + a @ p @ t_(a))


def smoothed_back(states: DataFrame, model: Model, span: int = SPAN_US) -> DataFrame:
    """(series, us, sm0 .., sp00 ..): every row smoothed back from its series' last one, in work linear in the rows.

    As in the filter, the backward functions of a span compose to one by its own task, the short list of them is run through from the last span, and then all spans
    are swept back at once from the states behind them.
    """
    names, n = names_of(model), model.states
    rows = with_row_behind(states, model, span)

    def composed(df: pd.DataFrame) -> pd.DataFrame:
        parts, _ = backward_functions(df, model)
        start, size = groups_of(df, ["series", "span"])
        out = [x[start + size - 1].copy() for x in parts]
        for groups, back in in_step_back(start, size):
            if back[0] == start[groups[0]] + size[groups[0]] - 1:
                continue
            for target, value in zip(out, after(tuple(x[back] for x in parts), tuple(x[groups] for x in out)), strict=True):
                target[groups] = value
        head = df.iloc[start]
        return pd.DataFrame(np.hstack([x.reshape(len(start), -1) for x in out]), columns=names.backward).assign(series=head["series"].to_numpy(), span=head["span"].to_numpy())

    def behind(df: pd.DataFrame) -> pd.DataFrame:
        x = df[names.backward].to_numpy()
        parts = x[:, : n * n].reshape(-1, n, n), x[:, n * n : n * n + n], x[:, n * n + n :].reshape(-1, n, n)
        start, size = groups_of(df, ["series"])
        m, p = np.zeros((len(start), n)), np.zeros((len(start), n, n))
        means, covs = np.empty((len(df), n)), np.empty((len(df), n, n))
        for groups, i in in_step_back(start, size):
            means[i], covs[i] = m[groups], p[groups]
            m[groups], p[groups] = applied(tuple(v[i] for v in parts), m[groups], p[groups])
        return pd.DataFrame(np.hstack([means, packed(covs)]), columns=names.smoothed).assign(series=df["series"].to_numpy(), span=df["span"].to_numpy())

    def swept(df: pd.DataFrame) -> pd.DataFrame:
        parts, _ = backward_functions(df, model)
        start, size = groups_of(df, ["series", "span"])
        tips = df[names.smoothed].to_numpy()[start]
        means, covs = swept_groups(parts, tips[:, :n].copy(), unpacked(tips[:, n:]), start, size)
        return pd.DataFrame(np.hstack([means, packed(covs)]), columns=names.smoothed).assign(series=df["series"].to_numpy(), us=df["us"].to_numpy())

    elements = by_groups(rows, ["series", "span"], "us", composed, f"{doubles(names.backward)}, series string, span long")
    tips = by_groups(elements, ["series"], "span", behind, f"{doubles(names.smoothed)}, series string, span long")
    done = by_groups(rows.join(tips, ["series", "span"]), ["series", "span"], "us", swept, f"{doubles(names.smoothed)}, series string, us long")
    return done.select("series", "us", *names.smoothed)


def swept_groups(parts: tuple[np.ndarray, ...], m: np.ndarray, p: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariances) of all rows, each group swept back from the state (m, p) behind its last row."""
    means, covs = np.empty((len(parts[0]), m.shape[1])), np.empty(parts[0].shape)
    for groups, i in in_step_back(start, size):
        m[groups], p[groups] = applied(tuple(x[i] for x in parts), m[groups], p[groups])
        means[i], covs[i] = m[groups], p[groups]
    return means, covs


def smoothed_by_lag(states: DataFrame, model: Model, lag: int, span: int = SPAN_US) -> DataFrame:
    """(series, us, sm0 .., sp00 .., release_us, released): each row smoothed back from the first row at least lag microseconds later, in work linear in the rows whatever the lag.

    Time is cut into blocks as long as the lag, so the rows from one to its release lie in its own block and the next. A row's function is that of its block
    from it on, after that of the next block up to the row before the release; both come from one scan over each block. Rows are copied to
    the spans before as far as the lag reaches, so that a span's task finds all it needs.
    """
    names, n = names_of(model), model.states
    first = F.floor((F.col("us") - lag) / F.lit(span)).cast("long")
    placed = with_row_behind(states, model, span).withColumn("at", F.col("span")).withColumn("span", F.explode(F.sequence(first, F.col("at"))))
    flat = placed.withColumn("own", F.col("span") == F.col("at")).drop("at")

    def work(df: pd.DataFrame) -> pd.DataFrame:
        us, own = df["us"].to_numpy(), df["own"].to_numpy()
        start, size = groups_of(df, ["series", "span"])
        parts, has_next = backward_functions(df, model)
        blocks = df[["series", "span"]].assign(block=us // lag)
        b_start, b_size = groups_of(blocks, ["series", "span", "block"])
        ahead, so_far = scans(parts, b_start, b_size)
        last = np.empty(len(df), dtype=np.int64)
        for a, k in zip(start, size, strict=True):
            part = us[a : a + k]
            last[a : a + k] = a + np.searchsorted(part, part + lag, side="left") - 1
        released = has_next[last]
        state = np.nan_to_num(df[[f"n_{x}" for x in names.state]].to_numpy(dtype=float))[last]
        m, p = state[:, :n], unpacked(state[:, n:])
        block = blocks["block"].to_numpy()
        far = np.flatnonzero(block[last] != block)
        m[far], p[far] = applied(tuple(x[last[far]] for x in so_far), m[far], p[far])
        m, p = applied(ahead, m, p)
        flat = np.where(released[:, None], np.hstack([m, packed(p)]), np.nan)
        got = pd.DataFrame(flat, columns=names.smoothed).assign(series=df["series"].to_numpy(), us=us, released=released)
        behind = np.nan_to_num(df["n_us"].to_numpy(dtype=float))[last].astype(np.int64)
        got["release_us"] = pd.arrays.IntegerArray(behind, ~released)
        return got[own]

    done = by_groups(flat, ["series", "span"], "us", work, f"{doubles(names.smoothed)}, series string, us long, released boolean, release_us long")
    return done.select("series", "us", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names.smoothed], "release_us", "released")


def scans(parts: tuple[np.ndarray, ...], start: np.ndarray, size: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(each row's function from it to its group's end, from its group's start to it), composed."""
    ahead, so_far = tuple(x.copy() for x in parts), tuple(x.copy() for x in parts)
    for groups, i in in_step_back(start, size):
        inner = i[i < start[groups] + size[groups] - 1]
        for target, value in zip(ahead, after(tuple(x[inner] for x in parts), tuple(x[inner + 1] for x in ahead)), strict=True):
            target[inner] = value
    for groups, i in in_step(start, size):
        if i[0] == start[groups[0]]:
            continue
        for target, value in zip(so_far, after(tuple(x[i - 1] for x in so_far), tuple(x[i] for x in parts)), strict=True):
            target[i] = value
    return ahead, so_far


@dataclass(frozen=True)
class Step:
    """One row's state before and after its reading."""

    before_mean: np.ndarray
    before_cov: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    innovation: np.ndarray
    spread: np.ndarray
    log_density: float
    complete: bool


def first_step(mean, cov, y, h, r) -> Step:
    """The first row's step: the initial state and a reading y (NaN: missing) that H shows with noise R. All inputs are checked."""
    m = _numbers(mean, (np.size(mean),), "mean")
    n = m.size
    p = covariance(cov, n, "cov")
    values = np.atleast_1d(np.asarray(y, dtype=float))
    if not n or values.ndim != 1 or not values.size or np.isinf(values).any():
        raise ValueError("y takes one finite number or NaN a reading, and a state has one number at least")
    h, r = _numbers(h, (values.size, n), "h"), covariance(r, values.size, "r")
    p = sym(p)
    after_m, after_p, v, s = update(m[None], p[None], values[None], h[None], r[None])
    seen = np.isfinite(values)
    density = log_density(v, s, np.array([seen.sum()]))[0]
    return Step(m, p, after_m[0], after_p[0], np.where(seen, v[0], np.nan), np.where(seen[:, None] & seen, s[0], np.nan), float(density), bool(seen.all()))


def single_step(mean, cov, f, q, y, h, r) -> Step:
    """A row's step from the state after the row before: move by F with noise Q, then read y. All inputs are checked."""
    m = _numbers(mean, (np.size(mean),), "mean")
    n = m.size
    before, spread = predict(m[None], covariance(cov, n, "cov")[None], _numbers(f, (n, n), "f")[None], covariance(q, n, "q")[None])
    return first_step(before[0], spread[0], y, h, r)


def _numbers(values, shape: tuple[int, ...], name: str) -> np.ndarray:
    out = np.asarray(values, dtype=float)
    if out.shape != shape or not np.isfinite(out).all():
        raise ValueError(f"{name} takes {' x '.join(map(str, shape))} finite numbers")
    return out
