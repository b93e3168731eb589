"""A small network with a narrow middle, trained in batches over all rows of a table.

Rows are dealt to workers by hash, so many to each that they fit in its memory.  One worker trains by itself; of
several, each trains an epoch from the same weights, and the weights are averaged in pieces by executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.storage import cut, cut_counted

#: Slope of the units and learning rate.
SLOPE, RATE = 0.01, 1e-3
#: Rows of one worker, and weights of one piece when they are averaged.
WORKER_ROWS, PIECE = 20_000, 1 << 16
#: Shares of rows to train on and to validate with; the rest tests.
TRAIN, VALIDATE = 0.8, 0.1


@dataclass(frozen=True)
class Head:
    """A stretch of the output: softmax with cross entropy, or as it is with squared errors over its size."""

    name: str
    size: int
    weight: float = 1.0
    squared: bool = False


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Network:
    """Two hidden layers, the middle, two hidden layers, and the heads; the middle and the output have no unit."""

    inputs: int
    heads: tuple[Head, ...]
    hidden: int = 512
    latent: int = 32
    seed: int = 1
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        if not self.layers:
            rng = np.random.default_rng(self.seed)
            widths = [self.inputs, self.hidden, self.hidden, self.latent, self.hidden, self.hidden, sum(h.size for h in self.heads)]
            self.layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(widths, widths[1:], strict=False)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer."""
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            y = out[-1] @ w + b
            out.append(y if i in (2, len(self.layers) - 1) else np.where(y > 0, y, SLOPE * y))
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[3]

    def losses(self, output: np.ndarray, targets: list[np.ndarray]) -> tuple[list[float], np.ndarray]:
        """Mean loss of each head, not weighed, and the gradient of their weighed sum at the output."""
        found, grads, at, n = [], [], 0, len(output)
        for head, t in zip(self.heads, targets, strict=True):
            y = output[:, at : at + head.size]
            at += head.size
            if head.squared:
                found.append(float(((y - t) ** 2).sum() / head.size / n))
                grads.append(head.weight * 2 * (y - t) / head.size / n)
            else:
                p = softmax(y)
                found.append(float(-(t * np.log(p + 1e-9)).sum() / n))
                grads.append(head.weight * (p * t.sum(axis=1, keepdims=True) - t) / n)
        return found, np.concatenate(grads, axis=1)

    def weighed(self, losses: list[float]) -> float:
        return sum(h.weight * x for h, x in zip(self.heads, losses, strict=True))

    def gradients(self, x: np.ndarray, targets: list[np.ndarray]) -> tuple[list[float], list]:
        acts = self.forward(x)
        found, grad = self.losses(acts[-1], targets)
        grads = []
        for i in reversed(range(len(self.layers))):
            grads.append((acts[i].T @ grad, grad.sum(axis=0)))
            grad = grad @ self.layers[i][0].T
            if i and i != 3:
                grad = grad * np.where(acts[i] > 0, 1.0, SLOPE)
        return found, grads[::-1]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for layer in self.layers for a in layer])

    def load(self, values: np.ndarray) -> None:
        at, made = 0, []
        for layer in self.layers:
            parts = []
            for a in layer:
                parts.append(np.asarray(values[at : at + a.size], dtype=np.float64).reshape(a.shape))
                at += a.size
            made.append(tuple(parts))
        self.layers = made


class Rows(Protocol):
    """Training rows of one worker."""

    def __len__(self) -> int: ...

    def batch(self, part: np.ndarray, epoch: int, rng: np.random.Generator | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Input and targets of some rows; ``rng`` is None where nothing is to be drawn, as in tests."""


class Adam:
    def __init__(self, net: Network):
        self.net, self.steps = net, 0
        self.state = [[np.zeros_like(a) for a in (*layer, *layer)] for layer in net.layers]

    def step(self, grads: list) -> None:
        self.steps += 1
        made = []
        for layer, pair, s in zip(self.net.layers, grads, self.state, strict=True):
            new = []
            for j, (value, g) in enumerate(zip(layer, pair, strict=True)):
                s[j] = 0.9 * s[j] + 0.1 * g
                s[j + 2] = 0.999 * s[j + 2] + 0.001 * g * g
                new.append(value - RATE * (s[j] / (1 - 0.9**self.steps)) / (np.sqrt(s[j + 2] / (1 - 0.999**self.steps)) + 1e-8))
            made.append(tuple(new))
        self.net.layers = made


def batch_size(epoch: int, batch: int, double_at: tuple[int, ...]) -> int:
    """The batch of an epoch, doubled at each of ``double_at`` up to it."""
    return batch << sum(epoch >= at for at in double_at)


def learn(net: Network, rows: Rows, epochs: range, batch: int, double_at: tuple[int, ...], seed: int) -> list[list[float]]:
    """Trains over all rows once an epoch; losses of each epoch by head."""
    optimiser, history = Adam(net), []
    for epoch in epochs:
        rng = np.random.default_rng([seed, epoch])
        order, size, seen = rng.permutation(len(rows)), batch_size(epoch, batch, double_at), np.zeros(len(net.heads))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            losses, grads = net.gradients(*rows.batch(part, epoch, rng))
            optimiser.step(grads)
            seen += np.array(losses) * len(part)
        history.append((seen / max(1, len(order))).tolist())
    return history


def evaluate(net: Network, rows: Rows, batch: int = 4096) -> np.ndarray:
    """Sums of the heads' losses over rows, without drawing anything."""
    total = np.zeros(len(net.heads))
    for at in range(0, len(rows), batch):
        part = np.arange(at, min(at + batch, len(rows)))
        x, targets = rows.batch(part, 0, None)
        total += np.array(net.losses(net.forward(x)[-1], targets)[0]) * len(part)
    return total


def shares(frame: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to train on, to validate and to test with, 80, 10 and 10 in a hundred by a hash of the key."""
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000))
    train, test = int(1000 * TRAIN), int(1000 * (TRAIN + VALIDATE))
    return frame.filter(at < train), frame.filter((at >= train) & (at < test)), frame.filter(at >= test)


def _table(batches) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


_PIECES = "piece int, vals array<double>, rows double, losses array<array<double>>"


def _average(batches):
    """Pieces of all workers, added up by weight: one array a piece."""
    sums: dict[int, list] = {}
    for batch in batches:
        for piece, values, rows, losses in zip(*(batch.column(c) for c in ("piece", "vals", "rows", "losses")), strict=True):
            s = sums.setdefault(piece.as_py(), [0.0, 0.0, 0.0])
            n = rows.as_py()
            s[0], s[1], s[2] = s[0] + n * values.values.to_numpy(), s[1] + n, s[2] + n * np.array(losses.as_py())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s[0] / s[1] for s in sums.values()], pa.list_(pa.float64())), pa.array([s[1] for s in sums.values()], pa.float64()),
         pa.array([(s[2] / s[1]).tolist() for s in sums.values()], pa.list_(pa.list_(pa.float64())))],
        ["piece", "vals", "rows", "losses"],
    )


def train(frame: DataFrame, key: str, net: Network, made: Callable[[pa.Table], Rows], epochs: int, batch: int, double_at: tuple[int, ...], worker_rows: int = WORKER_ROWS) -> list[list[float]]:
    """Trains ``net`` on every row of ``frame``; mean losses of each epoch by head.  Nothing without rows."""
    rows, count = cut_counted(frame)
    if not count:
        return []
    workers = -(-count // worker_rows)
    dealt = rows.coalesce(1) if workers == 1 else cut(rows.repartition(workers, F.xxhash64(key)))
    pieces = -(-len(net.flat()) // PIECE)
    step = epochs if workers == 1 else 1  # by itself a worker needs no averaging
    history = []
    for first in range(0, epochs, step):
        held = frame.sparkSession.sparkContext.broadcast((net, net.flat()))

        def run(batches, first=first, held=held):
            table = _table(batches)
            if table is None:
                return
            own, weights = held.value
            own = Network(own.inputs, own.heads, own.hidden, own.latent, own.seed, list(own.layers))
            own.load(weights)
            losses = learn(own, made(table), range(first, first + step), batch, double_at, own.seed)
            flat = own.flat()
            for i in range(0, pieces):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([flat[i * PIECE : (i + 1) * PIECE]], pa.list_(pa.float64())), pa.array([float(table.num_rows)]), pa.array([losses], pa.list_(pa.list_(pa.float64())))],
                    ["piece", "vals", "rows", "losses"],
                )

        found = dealt.mapInArrow(run, _PIECES)
        if workers > 1:
            found = found.repartition(pieces, "piece").mapInArrow(_average, _PIECES)
        found = sorted(found.collect(), key=lambda r: r["piece"])  # the weights, once
        net.load(np.concatenate([r["vals"] for r in found]))
        history += found[0]["losses"]
        held.unpersist()
    return history


def test(frame: DataFrame, net: Network, made: Callable[[pa.Table], Rows], batch_rows: int = 4096) -> dict[str, float]:
    """Mean loss of each head, and their weighed sum as ``loss``, over all rows; nothing without rows."""
    held = frame.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            if b.num_rows:
                sums = evaluate(held.value, made(pa.Table.from_batches([b])))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums), pa.array(np.full(len(sums), float(b.num_rows)))], ["head", "loss", "rows"])

    found = {r["head"]: r["s"] / r["n"] for r in frame.mapInArrow(run, "head int, loss double, rows double").groupBy("head").agg(F.sum("loss").alias("s"), F.sum("rows").alias("n")).collect()}
    if not found:
        return {}
    each = [found[i] for i in range(len(net.heads))]
    return {h.name: x for h, x in zip(net.heads, each, strict=True)} | {"loss": net.weighed(each)}


def weights_table(spark, net: Network) -> DataFrame:
    """(layer, part, row, vals): a network's weights as rows, to be written and read again."""
    rows = [(i, part, j, [float(v) for v in line]) for i, layer in enumerate(net.layers) for part, a in zip(("weights", "bias"), layer, strict=True) for j, line in enumerate(np.atleast_2d(a))]
    return spark.createDataFrame(rows, "layer int, part string, row int, vals array<double>")


def from_weights(net: Network, table: DataFrame) -> Network:
    """``net`` with the weights of ``weights_table``."""
    found: dict[tuple, list] = {}
    for r in table.orderBy("layer", "part", "row").collect():  # the weights, once
        found.setdefault((r["layer"], r["part"]), []).append(r["vals"])
    net.layers = [(np.array(found[i, "weights"]), np.array(found[i, "bias"][0])) for i in range(len(net.layers))]
    return net
