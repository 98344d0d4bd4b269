"""Language identification with a small convolutional network over bytes.

A text is cut into windows of ``window`` bytes. In each, filters of several widths slide over byte
embeddings, their largest answers are pooled, and a softmax gives the languages' chances; a text's chances
are its windows' means weighted by their bytes. Training is plain numpy on a bounded sample of labelled
texts; scoring replaces embedding and filters by tables of byte pairs, so a filter is a few look-ups.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.llm import words as W


@dataclass(frozen=True)
class LanguageSpec:
    """``per_label`` bounds the training texts of one language (about); ``window`` is in bytes."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    size: int = 8
    per_label: int = 1500
    steps: int = 700
    batch: int = 96
    rate: float = 0.01
    seed: int = 3


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, labels: list[str], spec: LanguageSpec):
        rng = np.random.default_rng(spec.seed)
        self.labels, self.spec = labels, spec
        self.weights = {"embed": rng.normal(0, 0.5, (256, spec.size)).astype(np.float32)}
        self.weights["embed"][0] = 0
        for w in spec.widths:
            self.weights[f"filter{w}"] = rng.normal(0, (w * spec.size) ** -0.5, (w * spec.size, spec.filters)).astype(np.float32)
            self.weights[f"bias{w}"] = np.zeros(spec.filters, dtype=np.float32)
        wide = len(spec.widths) * spec.filters
        self.weights["out"] = rng.normal(0, wide**-0.5, (wide, len(labels))).astype(np.float32)
        self.weights["level"] = np.zeros(len(labels), dtype=np.float32)

    def fit(self, windows: np.ndarray, targets: np.ndarray) -> "ByteNet":
        """Adam on cross-entropy; a filter's gradient flows through its largest answer only."""
        spec, w = self.spec, self.weights
        rng = np.random.default_rng(spec.seed + 1)
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        for step in range(1, spec.steps + 1):
            pick = rng.integers(0, len(windows), min(spec.batch, len(windows)))
            x, y = windows[pick], targets[pick]
            n, rows = len(x), np.arange(len(x))[:, None]
            laid = w["embed"][x]
            pooled, where = [], {}
            for width in spec.widths:
                spans = np.lib.stride_tricks.sliding_window_view(laid, width, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, width * spec.size)
                answers = spans @ w[f"filter{width}"] + w[f"bias{width}"]
                where[width] = answers.argmax(axis=1)
                pooled.append(np.maximum(np.take_along_axis(answers, where[width][:, None, :], axis=1)[:, 0], 0))
            hidden = np.concatenate(pooled, axis=1)
            logits = hidden @ w["out"] + w["level"]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[rows[:, 0], y] -= 1
            chance /= n
            grads = {"out": hidden.T @ chance, "level": chance.sum(axis=0), "embed": np.zeros_like(w["embed"])}
            back = (chance @ w["out"].T) * (hidden > 0)
            for k, width in enumerate(spec.widths):
                flow = back[:, k * spec.filters : (k + 1) * spec.filters]
                at = where[width][:, :, None] + np.arange(width)
                spans = laid[rows[:, :, None], at].reshape(n, spec.filters, -1)
                grads[f"filter{width}"] = np.einsum("nfd,nf->df", spans, flow)
                grads[f"bias{width}"] = flow.sum(axis=0)
                np.add.at(grads["embed"], x[rows[:, :, None], at], np.einsum("nf,df->nfd", flow, w[f"filter{width}"]).reshape(n, spec.filters, width, spec.size))
            grads["embed"][0] = 0
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                pace = spec.rate * min(1.0, 2 * (1 - step / (spec.steps + 1)))
                w[k] = (w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width the filters' answers to its byte pairs (and a last single byte)."""
        out, spec = {}, self.spec
        for width in spec.widths:
            single = [self.weights["embed"] @ self.weights[f"filter{width}"][k * spec.size : (k + 1) * spec.size] for k in range(width)]
            pairs = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, width - 1, 2)]
            out[width] = pairs + ([single[-1]] if width % 2 else [])
        return out

    def predict(self, windows: np.ndarray, tables) -> np.ndarray:
        """Chances of every language for rows of ``window`` bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for width in self.spec.widths:
            n = windows.shape[1] - width + 1
            answers = None
            for k, table in enumerate(tables[width]):
                key = pairs[:, 2 * k : 2 * k + n] if len(table) > 256 else windows[:, 2 * k : 2 * k + n]
                part = table[key]
                answers = part if answers is None else np.add(answers, part, out=answers)
            pooled.append(np.maximum(answers.max(axis=1) + self.weights[f"bias{width}"], 0))
        logits = np.concatenate(pooled, axis=1) @ self.weights["out"] + self.weights["level"]
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        return chance / chance.sum(axis=1, keepdims=True)


def train_language(labelled: DataFrame, spec: LanguageSpec = LanguageSpec()) -> ByteNet | None:
    """A network from rows with ``text`` and ``lang``; about ``per_label`` texts of each language are drawn,
    by a seeded draw, and some windows of each. None without a labelled text."""
    rows = labelled.where("lang is not null and text is not null and length(text) > 0").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    drawn = rows.sampleBy("lang", {k: min(1.0, spec.per_label / n) for k, n in sizes.items()}, seed=spec.seed)
    # whole texts stay on the executors; three windows from anywhere in each reach the driver
    size = F.greatest(F.length("text") - spec.window, F.lit(1))
    spots = F.array(*[F.pmod(F.xxhash64("text", F.lit(k)), size) + 1 for k in range(3)])
    cut = drawn.select("lang", F.transform(F.array_distinct(spots), lambda at: F.substr("text", at.cast("int"), F.lit(spec.window))).alias("cuts"))
    labels = sorted(sizes)
    rng = np.random.default_rng(spec.seed)
    windows, targets = [], []
    for lang, cuts in sorted(cut.collect()):
        for text in cuts:
            data = np.frombuffer(text.encode()[: spec.window], dtype=np.uint8)
            # short texts are met too: a third of the windows is shortened
            if len(data) > 24 and rng.random() < 1 / 3:
                data = data[: rng.integers(16, len(data))]
            row = np.zeros(spec.window, dtype=np.uint8)
            row[: len(data)] = data
            windows.append(row)
            targets.append(labels.index(lang))
    if not windows:
        return None
    return ByteNet(labels, spec).fit(np.stack(windows), np.array(targets))


def identify(docs: DataFrame, net: ByteNet | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the language and its chance, under these ``names`` whatever ``docs`` has.

    ``und`` with score 0 if the text is null or has no letter (or there is no network). Repeated rows give repeated
    rows. Every byte of a text is read.
    """
    text = F.col("text").cast("string")
    kept = [c for c in docs.columns if c not in names]
    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{names[0]}` string, `{names[1]}` double"
    spec = net.spec if net else LanguageSpec()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            data, limits = W.text_bytes(batch.column(0))
            lettered = batch.column(1).to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, len(net.labels) if net else 1), dtype=np.float64)
            if net:
                size = np.diff(limits)
                count = np.where(lettered, -(-size // spec.window), 0)
                text = np.repeat(np.arange(batch.num_rows), count)
                start = limits[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * spec.window
                weight = np.minimum(limits[text + 1] - start, spec.window)
                for a in range(0, len(text), 512):
                    spot = start[a : a + 512, None] + np.arange(spec.window)
                    inside = np.arange(spec.window) < weight[a : a + 512, None]
                    windows = np.where(inside, data[np.minimum(spot, len(data) - 1)], 0).astype(np.uint8)
                    np.add.at(total, text[a : a + 512], net.predict(windows, tables) * weight[a : a + 512, None])
            mass = total.sum(axis=1)
            known = mass > 0
            best = total.argmax(axis=1)
            told = np.array(net.labels if net else [""], dtype=object)[best]
            told[~known] = "und"
            chance = np.where(known, total.max(axis=1) / np.where(known, mass, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(told, pa.string()), pa.array(np.clip(chance, 0, 1))], [*kept, *names])

    ask = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    # columns travel by place, so their names may be any; the result has them again
    return docs.select(text.alias("_0"), ask.alias("_1"), *[F.col(f"`{c}`").alias(f"_{k + 2}") for k, c in enumerate(kept)]).mapInArrow(score, schema)
