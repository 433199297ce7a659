"""Small networks with imported weights, over batches of windows.

A weight file is JSON: ``layers``, each with its shapes, and ``sha256``, the digest of the layers' canonical text. A file whose
digest or shapes do not hold is refused before any row is read. The layers go to the executors once, as a broadcast of a
bounded size; a convolution is one matrix product for a batch of windows.

Layers: ``conv`` (weight out x in x width, bias, stride, padding), ``dense`` (weight out x in, bias), ``leaky`` (slope), ``pool`` (mean and
maximum over time, side by side), ``join`` (appends the row's statistics), ``scale`` (mean and scale of each value).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The largest weight file, in bytes.
MOST_BYTES = 64 << 20

KINDS = {"conv": ("weight", "bias", "stride", "padding"), "dense": ("weight", "bias"), "leaky": ("slope",), "pool": (), "join": (), "scale": ("mean", "scale")}


def digest(layers: list[dict]) -> str:
    return hashlib.sha256(json.dumps(layers, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_network(spark: SparkSession, path: str, layers: list[dict]) -> None:
    """A folder with one file of weights."""
    spark.createDataFrame([(json.dumps({"layers": layers, "sha256": digest(layers)}),)], "value string").coalesce(1).write.text(path)


def read_network(spark: SparkSession, path: str) -> list[dict]:
    """The layers of a weight file; ValueError if it is too large, altered or ill-shaped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("length").collect()
    if len(files) != 1 or files[0].length > MOST_BYTES:
        raise ValueError(f"not one weight file of at most {MOST_BYTES} bytes: {path}")
    doc = json.loads(spark.read.text(path, wholetext=True).first().value)
    if digest(doc["layers"]) != doc["sha256"]:
        raise ValueError("the digest of the weights is wrong")
    check(doc["layers"])
    return doc["layers"]


def check(layers: list[dict]) -> None:
    """ValueError unless each layer has what its kind needs, in shapes that fit one another."""
    channels, flat = None, None
    for n, layer in enumerate(layers):
        kind = layer.get("kind")
        if kind not in KINDS or set(layer) != {"kind", *KINDS[kind]}:
            raise ValueError(f"layer {n}: {kind} with {sorted(layer)}")
        w = np.array(layer.get("weight", 0.0), float)
        if kind in ("conv", "dense"):
            if w.ndim != (3 if kind == "conv" else 2) or len(layer["bias"]) != len(w) or not np.isfinite(w).all():
                raise ValueError(f"layer {n}: weight {w.shape}, bias {len(layer['bias'])}")
        if kind == "conv":
            if flat or (channels is not None and w.shape[1] != channels) or layer["stride"] < 1 or layer["padding"] < 0:
                raise ValueError(f"layer {n}: {w.shape[1]} channels for {channels}")
            channels = len(w)
        elif kind == "pool":
            flat = None if channels is None else 2 * channels
        elif kind == "join":
            flat = None
        elif kind == "dense":
            if flat is not None and w.shape[1] != flat:
                raise ValueError(f"layer {n}: {w.shape[1]} values for {flat}")
            flat = len(w)


def convolved(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, stride: int, padding: int) -> np.ndarray:
    """Windows (n x in x time) through a bank of filters, as one product of matrices."""
    out, _, width = weight.shape
    x = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
    seen = np.lib.stride_tricks.sliding_window_view(x, width, axis=2)[:, :, ::stride]
    n, _, t, _ = seen.shape
    flat = seen.transpose(0, 2, 1, 3).reshape(n * t, -1)
    return (flat @ weight.reshape(out, -1).T + bias).reshape(n, t, out).transpose(0, 2, 1)


def forward(layers: list[dict], x: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """The output (n x values) of windows (n x channels x time) and statistics (n x values)."""
    for layer in layers:
        kind = layer["kind"]
        if kind == "conv":
            x = convolved(x, np.array(layer["weight"], float), np.array(layer["bias"], float), layer["stride"], layer["padding"])
        elif kind == "dense":
            x = x @ np.array(layer["weight"], float).T + np.array(layer["bias"], float)
        elif kind == "leaky":
            x = np.where(x > 0, x, layer["slope"] * x)
        elif kind == "pool":
            x = np.concatenate([x.mean(axis=2), x.max(axis=2)], axis=1)
        elif kind == "join":
            x = np.concatenate([x, stats], axis=1)
        else:
            x = (x - np.array(layer["mean"], float)) / np.array(layer["scale"], float)
    return x


def predicted(rows: DataFrame, key: str, window: str, stats: str, layers: list[dict]) -> DataFrame:
    """key and output (array of doubles) of each row's ``window`` (time x channels) and ``stats`` (array).

    A window that is null, empty, ragged or holds a null has a null output, as have statistics with a null. Windows of one batch
    may differ in length; those of one length go together.
    """
    check(layers)
    weights = rows.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes: dict[tuple[int, int, int], list[int]] = {}
            held, out = [], [None] * b.num_rows
            for i, (w, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                good = w and s is not None and all(v is not None for v in s) and all(t is not None and len(t) == len(w[0]) and all(v is not None for v in t) for t in w)
                held.append((w, s) if good else None)
                if good:
                    shapes.setdefault((len(w), len(w[0]), len(s)), []).append(i)
            for (_, _, n), at in shapes.items():
                x = np.array([held[i][0] for i in at], float).transpose(0, 2, 1)
                y = forward(weights.value, x, np.array([held[i][1] for i in at], float).reshape(len(at), n))
                for i, v in zip(at, y, strict=True):
                    out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "output"])

    return rows.select(key, window, stats).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, output array<double>")
