"""One Newton solver for the ridge logistic models of all species at once.

Rows are stored once as blocks: one row per site, or per slice of a site with
more outings than a block should hold. A step is one pass over the blocks. Each
task multiplies a block's columns with the coefficients of all species and sums
loss, gradient and curvature per species; the sums of slices of tasks, then of
species, are added up on the executors, where each species' small system is
solved. The driver sees one step vector per species.

A site's own effect never reaches the driver. Given the other coefficients it is
the root of an increasing function of one variable over that site's rows, so a
task finds it by itself, and eliminating it from the sums gives the exact
gradient and curvature of what is left. Only sites of several blocks, at most
the outings over the block limit, keep a number per species between steps; their
part of the curvature is diagonal and eliminated before a system is solved.

Steps are halved for a species whose loss rises, so each converges from any
start; species leave the passes as they converge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldcast.session import shipped

#: outings worked on at once
CHUNK = 8192
#: species of one pass; a task holds a curvature matrix for each
SPECIES = 128
MAX_STEPS = 60
#: squared Newton decrement below which the step just taken was the last
CLOSE = 1e-9
#: slices whose sums are added up before those of a species
SLICES = 32


@dataclass(frozen=True)
class Layout:
    """Columns of a block: the intercept, one per level of each category, then the
    numeric ones; ``hot`` sites keep a coefficient of their own."""

    levels: tuple[int, ...]
    numeric: int
    hot: int
    penalty: float

    @property
    def width(self) -> int:
        return 1 + sum(self.levels) + self.numeric


class Block:
    """Outings of some stored rows: columns, labels, and where each site starts."""

    def __init__(self, batch: pa.RecordBatch, layout: Layout, place: np.ndarray):
        rows = batch.column("rows")
        sizes = pc.list_value_length(rows).to_numpy().astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.n = int(sizes.sum())
        *levels, numeric, seen = rows.flatten().flatten()
        self.x = np.zeros((self.n, layout.width))
        self.x[:, 0] = 1.0
        at = 1
        for column, many in zip(levels, layout.levels):
            k = column.to_numpy()
            known = np.flatnonzero(k >= 0)
            self.x[known, at + k[known]] = 1.0
            at += many
        if layout.numeric:
            self.x[:, at:] = numeric.flatten().to_numpy().reshape(self.n, layout.numeric)
        # labels of the species of this pass
        many = pc.list_value_length(seen).to_numpy()
        owner, which = np.repeat(np.arange(self.n), many), place[seen.flatten().to_numpy()]
        self.y = np.zeros((self.n, int(place.max(initial=-1)) + 1))
        self.y[owner[which >= 0], which[which >= 0]] = 1.0
        self.site = np.repeat(np.arange(len(sizes)), sizes)
        self.hot = batch.column("hot").to_numpy()
        self.free = batch.column("own").to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Stored rows of about ``limit`` outings together; a larger one comes alone."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("rows")).to_numpy())])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def site_effects(z: np.ndarray, y: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The effect per site and species that is best given the rest ``z``: Newton's
    method inside a bracket that shrinks with every look."""
    n = np.diff(np.append(starts, len(z)))
    site = np.repeat(np.arange(len(n)), n)
    high = np.repeat(n[:, None] / penalty, z.shape[1], 1)
    low, a = -high, np.zeros(high.shape)
    positive = np.add.reduceat(y, starts, axis=0)
    for _ in range(200):
        p = _sigmoid(z + a[site])
        g = np.add.reduceat(p, starts, axis=0) - positive + penalty * a
        h = np.add.reduceat(p * (1.0 - p), starts, axis=0) + penalty
        low, high = np.where(g < 0, a, low), np.where(g > 0, a, high)
        close = np.abs(g / h) <= 1e-12 * (1.0 + np.abs(a))
        new = a - g / h
        new = np.where(((new <= low) | (new >= high)) & ~close, (low + high) / 2, new)
        done = close.all()
        a = new
        if done:
            break
    return a


def _solved(block: Block, theta: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Linear predictors, and the effects of sites that are whole in this block."""
    k = layout.width
    z = block.x @ theta[:, :k].T
    effect = np.zeros((len(block.hot), theta.shape[0]))
    kept = np.flatnonzero(block.hot >= 0)
    effect[kept] = theta[:, k:][:, block.hot[kept]].T
    free = np.flatnonzero(block.free)
    if len(free):
        rows = block.free[block.site]
        n = np.diff(np.append(block.starts, block.n))[free]
        effect[free] = site_effects(z[rows], block.y[rows], np.cumsum(n) - n, layout.penalty)
    return z + effect[block.site], effect


def _sums(packed: DataFrame, layout: Layout, active: np.ndarray, theta: np.ndarray,
          species: int) -> DataFrame:
    """slice, species, hot, v: of each task, loss, gradient and curvature per
    species; of hot sites, gradient, curvature and their cross terms."""
    sent = packed.sparkSession.sparkContext.broadcast((active, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, theta = sent.value
        place = np.full(species, -1)
        place[active] = np.arange(len(active))
        k, m, pen = layout.width, len(active), layout.penalty
        loss, grad, curve = np.zeros(m), np.zeros((m, k)), np.zeros((m, k, k))
        hot: dict[int, np.ndarray] = {}
        for part in chunks(batches):
            b = Block(part, layout, place)
            z, effect = _solved(b, theta, layout)
            p = _sigmoid(z)
            rest, w = p - b.y, p * (1.0 - p)
            free, kept = np.flatnonzero(b.free), np.flatnonzero(b.hot >= 0)
            loss += (np.logaddexp(0.0, z) - b.y * z).sum(0) + 0.5 * pen * (effect[free] ** 2).sum(0)
            grad += rest.T @ b.x
            own = np.add.reduceat(w, b.starts, axis=0)
            gap = np.add.reduceat(rest, b.starts, axis=0)
            for h in kept.tolist():
                if b.hot[h] not in hot:
                    hot[b.hot[h]] = np.zeros((m, k + 2))
                hot[b.hot[h]][:, 0] += gap[h]
                hot[b.hot[h]][:, 1] += own[h]
            for j in range(m):
                weighted = b.x * w[:, j, None]
                curve[j] += b.x.T @ weighted
                if len(free) or len(kept):
                    cross = np.add.reduceat(weighted, b.starts, axis=0)
                    f = cross[free] / np.sqrt(own[free, j] + pen)[:, None]
                    curve[j] -= f.T @ f
                    for h in kept.tolist():
                        hot[b.hot[h]][j, 2:] += cross[h]
        upper = np.triu_indices(k)
        dense = np.concatenate([loss[:, None], grad, curve[:, upper[0], upper[1]]], axis=1)
        part = TaskContext.get().partitionId() % SLICES
        for at, v in [(-1, dense), *hot.items()]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int32)), pa.array(active.astype(np.int32)),
                 pa.array(np.full(m, at, np.int32)), pa.array(list(v), pa.list_(pa.float64()))],
                names=["slice", "species", "hot", "v"])

    return packed.mapInArrow(run, "slice int, species int, hot int, v array<double>")


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of each hot site (-1: all other columns), in its order, summed.
    All but those of -1 have one length."""
    hot = table["hot"].to_numpy()
    v = table["v"].combine_chunks()
    ends = v.offsets.to_numpy()
    flat = v.values.to_numpy()
    ids, where = np.unique(hot, return_inverse=True)
    out = [np.zeros(0)] * len(ids)
    for r, i in enumerate(where.tolist()):
        x = flat[ends[r]:ends[r + 1]]
        out[i] = out[i] + x if len(out[i]) else x.copy()
    return ids, out


def _by_slice(sums: DataFrame) -> DataFrame:
    """The sums of the tasks of one slice, added up."""
    def add(table: pa.Table) -> pa.Table:
        ids, total = _added(table.combine_chunks())
        return pa.table({"slice": pa.array(np.full(len(ids), table["slice"][0].as_py(), np.int32)),
                         "species": pa.array(np.full(len(ids), table["species"][0].as_py(), np.int32)),
                         "hot": pa.array(ids), "v": pa.array(total, pa.list_(pa.float64()))})

    return sums.groupBy("species", "slice").applyInArrow(
        add, "slice int, species int, hot int, v array<double>")


def _steps(sums: DataFrame, layout: Layout, active: np.ndarray, theta: np.ndarray) -> DataFrame:
    """species, loss, decrement, step: the Newton step of each species."""
    sent = sums.sparkSession.sparkContext.broadcast((active, theta))

    def solve(table: pa.Table) -> pa.Table:
        active, theta = sent.value
        j = table["species"][0].as_py()
        at = theta[np.searchsorted(active, j)]
        ids, total = _added(table.combine_chunks())
        k, pen = layout.width, layout.penalty
        dense = total[0]
        loss, g = dense[0], dense[1:1 + k].copy()
        upper = np.triu_indices(k)
        h = np.zeros((k, k))
        h[upper] = dense[1 + k:]
        h = h + h.T - np.diag(np.diag(h))
        beta, hot = at[:k], at[k:]
        # the intercept bears no penalty
        g[1:] += pen * beta[1:]
        h[np.arange(1, k), np.arange(1, k)] += pen
        loss += 0.5 * pen * ((beta[1:] ** 2).sum() + (hot ** 2).sum())
        gh, hh, cross = pen * hot, np.full(len(hot), pen), np.zeros((len(hot), k))
        for i, v in zip(ids[1:].tolist(), total[1:]):
            gh[i] += v[0]
            hh[i] += v[1]
            cross[i] = v[2:]
        left = h - cross.T @ (cross / hh[:, None]) if len(hot) else h
        # without a penalty columns may say the same twice: the shortest step then
        inverse = np.linalg.pinv(left, hermitian=True) if not pen else None
        rest = g - cross.T @ (gh / hh) if len(hot) else g
        step = -(inverse @ rest if inverse is not None else np.linalg.solve(left, rest))
        own = -(gh + cross @ step) / hh
        decrement = -float(g @ step + gh @ own)
        return pa.table({"species": pa.array([j], pa.int32()), "loss": pa.array([loss]),
                         "decrement": pa.array([decrement]),
                         "step": pa.array([np.concatenate([step, own])], pa.list_(pa.float64()))})

    return _by_slice(sums).groupBy("species").applyInArrow(
        solve, "species int, loss double, decrement double, step array<double>")


def solve(packed: DataFrame, layout: Layout, species: Sequence[int], all_species: int,
          prevalence: Sequence[float]) -> np.ndarray:
    """Coefficients of the given species: a row each of columns, then hot sites."""
    shipped(packed)
    m, size = len(species), layout.width + layout.hot
    at = np.zeros((m, size))
    at[:, 0] = np.log(np.asarray(prevalence)) - np.log1p(-np.asarray(prevalence))
    step, part, loss = np.zeros((m, size)), np.ones(m), np.full(m, np.inf)
    trial, live = at.copy(), np.arange(m)
    codes = np.asarray(species)
    for _ in range(MAX_STEPS):
        sums = _sums(packed, layout, codes[live], trial[live], all_species)
        rows = _steps(sums, layout, codes[live], trial[live]).toArrow()
        order = np.searchsorted(codes[live], rows["species"].to_numpy())
        new_loss, near = np.empty(len(live)), np.empty(len(live))
        new_step = np.empty((len(live), size))
        new_loss[order], near[order] = rows["loss"].to_numpy(), rows["decrement"].to_numpy()
        new_step[order] = rows["step"].combine_chunks().flatten().to_numpy().reshape(-1, size)
        better = new_loss <= loss[live] + 1e-10 * np.abs(new_loss)
        good, bad = live[better], live[~better]
        at[good], step[good], loss[good], part[good] = trial[good], new_step[better], new_loss[better], 1.0
        part[bad] /= 2.0
        trial[live] = at[live] + part[live, None] * step[live]
        live = live[~(better & (near < CLOSE))]
        if not len(live):
            return trial
    raise RuntimeError(f"the fits of species {codes[live].tolist()} did not converge in {MAX_STEPS} steps")


def fitted_sites(packed: DataFrame, layout: Layout, species: Sequence[int], all_species: int,
                 theta: np.ndarray) -> DataFrame:
    """site, species, effect of every site that is whole in its block."""
    sent = packed.sparkSession.sparkContext.broadcast((np.asarray(species), theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, theta = sent.value
        place = np.full(all_species, -1)
        place[codes] = np.arange(len(codes))
        for part in chunks(batches):
            b = Block(part, layout, place)
            free = np.flatnonzero(b.free)
            if len(free):
                _, effect = _solved(b, theta, layout)
                site = part.column("site").take(pa.array(np.repeat(free, len(codes))))
                yield pa.RecordBatch.from_arrays(
                    [site, pa.array(np.tile(codes.astype(np.int32), len(free))),
                     pa.array(effect[free].ravel())], names=["site", "species", "effect"])

    return shipped(packed.where("own")).mapInArrow(run, "site string, species int, effect double")


def information(packed: DataFrame, layout: Layout, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and Fisher information of one species' coefficients:
    the weighted cross products of all columns, summed in one pass."""
    if layout.hot or layout.penalty:
        raise ValueError("the information is that of a fit without a penalty")
    total = None
    for r in _by_slice(_sums(shipped(packed), layout, np.array([0]), theta[None], 1)).select("v").collect():
        total = np.array(r["v"]) + (0.0 if total is None else total)  # SLICES rows at most
    k = layout.width
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = total[1 + k:]
    return float(total[0]), out + out.T - np.diag(np.diag(out))
