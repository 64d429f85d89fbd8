"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import bound_arrow_batches

UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Is there a character of Unicode category L? str.isalpha tests for just these."""
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Config:
    """sample_rows labelled rows of each label, and sample_chars of each, bound what the fit sees (and the driver holds)."""

    window: int = 256
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    sample_rows: int = 1000
    sample_chars: int = 768
    max_labels: int = 256
    epochs: int = 5
    batch: int = 64
    rate: float = 0.004
    seed: int = 5


class ByteNet:
    """Byte embedding, filters of several widths, maximum over the window, softmax.

    All filters share one matrix over the widest patch; rows beyond a filter's width are held at zero.
    """

    def __init__(self, labels: list[str], config: Config = Config()) -> None:
        self.labels, self.config = labels, config
        rng = np.random.default_rng(config.seed)
        e, wide, f = config.embed, max(config.widths), config.filters * len(config.widths)
        self.mask = np.zeros((wide * e, f), np.float32)
        for i, w in enumerate(config.widths):
            self.mask[: w * e, i * config.filters : (i + 1) * config.filters] = 1
        self.table = rng.normal(0, 0.5, (256, e)).astype(np.float32)
        self.table[0] = 0  # padding
        self.kernel = rng.normal(0, (2 / (wide * e)) ** 0.5, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(f, np.float32)
        self.head = rng.normal(0, f**-0.5, (f, len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, widest patch) of embedded bytes."""
        e, wide = self.config.embed, max(self.config.widths)
        v = self.table[x].reshape(len(x), -1)
        s = v.strides
        shape = (len(x), x.shape[1] - wide + 1, wide * e)
        return np.lib.stride_tricks.as_strided(v, shape, (s[0], s[1] * e, s[1]), writeable=False)

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        p = self._patches(x)
        return (np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.kernel).reshape(len(x), p.shape[1], -1).max(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the labels for each window (rows of bytes), a few windows at a time to stay in cache."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), 32):
            z = np.maximum(self._pooled(x[i : i + 32]) + self.bias, 0) @ self.head + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + 32] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on cross-entropy; only the patch that won a filter's maximum gets its gradient."""
        c = self.config
        rng = np.random.default_rng(c.seed)
        names = ("table", "kernel", "bias", "head", "offset")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(c.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), c.batch):
                pick = order[i : i + c.batch]
                step += 1
                for n, g in self._gradients(x[pick], y[pick]).items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    moved = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
                    getattr(self, n)[...] -= (c.rate * moved).astype(np.float32)
                self.kernel *= self.mask
                self.table[0] = 0

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, wide = self.config.embed, max(self.config.widths)
        p = self._patches(x)
        z = np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.kernel
        z = z.reshape(len(x), p.shape[1], -1)
        at = z.argmax(axis=1)  # (windows, filters)
        top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        logits = hidden @ self.head + self.offset
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        d = (q @ self.head.T) * (top > 0)
        rows = np.arange(len(x))[:, None]
        won = p[rows, at]  # (windows, filters, patch)
        d_patch = d[:, :, None] * self.kernel.T[None]
        table = np.zeros_like(self.table)
        for j in range(wide):
            np.add.at(table, x[rows, at + j].ravel(), d_patch[:, :, j * e : (j + 1) * e].reshape(-1, e))
        return {
            "table": table,
            "kernel": np.einsum("bfk,bf->kf", won, d),
            "bias": d.sum(axis=0),
            "head": hidden.T @ q,
            "offset": q.sum(axis=0),
        }


def windows_of(raw: bytes, size: int) -> np.ndarray:
    """All bytes of a text in rows of size, the last filled up with zeros."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def fit(df: DataFrame, text_col: str, label_col: str, key_col: str, config: Config = Config()) -> ByteNet | None:
    """Train on the labelled rows of df: for each label the config.sample_rows of least hash of key and text, and of each a piece of
    config.sample_chars at a hashed place. Rows with equal key, text and label count once; of equal hashes ties go by the piece. None where no row has
    a label and a text; more than config.max_labels labels are an error.

    A label's different rows are counted first, as hashes and with sums before the shuffle. The counts give the hash below which there are
    the wanted rows and half as many more, so of a label that has most rows only about 1.5 sample_rows leave the tasks that read them. Whole texts
    are hashed, so rows that share one key don't share a hash, and every label with a text gets training rows.
    """
    text, label, key = F.col(f"`{text_col}`"), F.col(f"`{label_col}`"), F.col(f"`{key_col}`")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(config.seed), key, text), 11) / F.lit(float(1 << 53))
    start = F.pmod(F.xxhash64(F.lit(config.seed + 1), key), F.greatest(F.lit(1), F.length(text) - config.sample_chars + 1))
    labelled = df.where(text.isNotNull() & label.isNotNull())
    different = labelled.select(label.cast("string").alias("label"), order.alias("o")).distinct()
    counts = different.groupBy("label").count().limit(config.max_labels + 1).collect()
    if not counts:
        return None
    if len(counts) > config.max_labels:
        raise ValueError(f"over {config.max_labels} labels")
    labels = sorted(r.label for r in counts)
    below = [(r.label, min(1.0, (1.5 * config.sample_rows + 100) / r["count"])) for r in counts]
    below = df.sparkSession.createDataFrame(below, "label string, below double")
    rows = labelled.select(
        label.cast("string").alias("label"), order.alias("o"), F.substr(text, (start + 1).cast("int"), F.lit(config.sample_chars)).alias("piece")
    )
    rows = rows.join(F.broadcast(below), "label").where("o < below").select("label", "o", "piece").distinct()
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("o", "piece")))
    sample = sorted((r.label, r.o, r.piece) for r in best.where(F.col("n") <= config.sample_rows).collect())
    x, y = [], []
    for label_of, _, piece in sample:
        for w in windows_of(piece.encode(), config.window):
            x.append(w)
            y.append(labels.index(label_of))
    net = ByteNet(labels, config)
    if len(labels) > 1:
        net.fit(np.stack(x), np.array(y))
    return net


def predict_languages(df: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred string and score double, replacing columns of these names.

    The whole text is cut into windows; each window's probabilities count by its letters (bytes of ASCII letters and of
    non-ASCII characters). score is the winner's share, in [0, 1]; of equal ones the first label in order wins. A text that is null or
    has no letter gets 'und' and 0, as does every text when there is no net. One pass, no shuffle; the net is broadcast (some 10 kB).
    """
    spark = df.sparkSession
    bound_arrow_batches(spark, 4 << 20)
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text_col}`"].alias("__text"))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() for v in batch.column(len(kept))]
            names, scores = predict_texts(shared.value, texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names
            )

    return source.mapInArrow(run, schema)


#: Windows predicted at once; a longer text is taken in several turns.
TURN = 4096


def predict_texts(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    live = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
    if not live:
        return names, scores
    votes = np.zeros((len(live), len(net.labels)))
    held: list[np.ndarray] = []
    owners: list[int] = []
    is_letter = np.zeros(256, bool)
    is_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def flush() -> None:
        x = np.concatenate(held)
        np.add.at(votes, np.array(owners), net.predict(x) * is_letter[x].sum(axis=1)[:, None])
        held.clear()
        owners.clear()

    for k, i in enumerate(live):
        w = windows_of(texts[i].encode(), net.config.window)
        for at in range(0, len(w), TURN):
            held.append(w[at : at + TURN])
            owners += [k] * len(held[-1])
            if len(owners) >= TURN:
                flush()
    if owners:
        flush()
    votes /= np.maximum(votes.sum(axis=1, keepdims=True), 1e-300)
    for k, i in enumerate(live):
        best = int(votes[k].argmax())
        names[i], scores[i] = net.labels[best], min(1.0, float(votes[k][best]))
    return names, scores
