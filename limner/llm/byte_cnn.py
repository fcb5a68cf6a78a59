"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over embedded bytes of a fixed-length window; the maximum of
each filter over the window feeds a softmax. The network is trained with numpy on windows of
a bounded sample of labelled texts. Since an embedding followed by a filter is linear, each filter
becomes a table with one row per byte, and a text is scored by adding table rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limner.llm.words import give_back, tidy
from limner.plans.joins import lookup_join

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: The network is fitted on so many texts of each language at most, and so many windows of each text.
TEXTS_PER_LANGUAGE = 800
WINDOWS_PER_TEXT = 3
EPOCHS = 6
#: A small sample is gone through more often, until so many steps are done.
STEPS = 500
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, each ``size`` bytes of its UTF-8 form with A-Z in lower case, the last padded by zeros."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    raw += bytes(-len(raw) % size)
    return np.frombuffer(raw, np.uint8).reshape(-1, size)


@dataclass
class ByteCNN:
    """Weights of the network. ``bytes_`` embeds bytes, ``filters[w]`` has ``w * EMBEDDING`` rows."""

    labels: list[str]
    bytes_: np.ndarray
    filters: dict[int, np.ndarray]
    shifts: dict[int, np.ndarray]
    out: np.ndarray
    out_shift: np.ndarray

    @classmethod
    def new(cls, labels: list[str], seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            labels, draw(256, EMBEDDING, scale=0.5), {w: draw(w * EMBEDDING, FILTERS, scale=(2 / (w * EMBEDDING)) ** 0.5) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, draw(len(WIDTHS) * FILTERS, len(labels), scale=0.2), np.zeros(len(labels), np.float32),
        )

    def _weights(self) -> list[np.ndarray]:
        return [self.bytes_, *self.filters.values(), *self.shifts.values(), self.out, self.out_shift]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 4e-3, seed: int = 11) -> ByteCNN:
        """Adam on the cross entropy of windows ``x`` and label numbers ``y``."""
        rng = np.random.default_rng(seed)
        weights = self._weights()
        means = [np.zeros_like(w) for w in weights]
        squares = [np.zeros_like(w) for w in weights]
        step = 0
        batches = max(1, len(x) // size)
        epochs = max(epochs, -(-STEPS // batches))
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), batches):
                step += 1
                now = rate * (1 - epoch / epochs)
                for w, g, m, s in zip(weights, self._gradients(x[rows], y[rows]), means, squares, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        embedded = self.bytes_[x]
        pooled, places = [], {}
        for w in WIDTHS:
            columns = np.concatenate([embedded[:, k : length - w + 1 + k] for k in range(w)], axis=2)
            heat = columns @ self.filters[w] + self.shifts[w]
            places[w] = heat.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(heat, places[w][:, None], axis=1)[:, 0], 0))
        hidden = np.concatenate(pooled, axis=1)
        error = softmax(hidden @ self.out + self.out_shift)
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ self.out.T) * (hidden > 0)
        d_bytes = np.zeros_like(self.bytes_)
        d_filters, d_shifts = [], []
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = places[w][:, :, None] + np.arange(w)
            seen = x[rows[:, :, None], at]
            parts = self.bytes_[seen].reshape(n, FILTERS, w * EMBEDDING)
            d_filters.append(np.einsum("nf,nfe->ef", own, parts))
            d_shifts.append(own.sum(axis=0))
            to_bytes = (own[:, :, None] * self.filters[w].T[None]).reshape(n, FILTERS, w, EMBEDDING)
            np.add.at(d_bytes, seen, to_bytes)
        return [d_bytes, *d_filters, *d_shifts, hidden.T @ error, error.sum(axis=0)]

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, what a byte at each place of the filter adds to it."""
        return {w: [np.ascontiguousarray(self.bytes_ @ self.filters[w][k * EMBEDDING : (k + 1) * EMBEDDING]) for k in range(w)] for w in WIDTHS}

    def probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], rows: int = 64) -> np.ndarray:
        """Label probabilities of each window, in blocks of ``rows`` windows."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        length = x.shape[1]
        for start in range(0, len(x), rows):
            part = x[start : start + rows]
            pooled = []
            for w in WIDTHS:
                heat = tables[w][0][part[:, : length - w + 1]]
                for k in range(1, w):
                    heat += tables[w][k][part[:, k : length - w + 1 + k]]
                pooled.append(np.maximum(heat.max(axis=1) + self.shifts[w], 0))
            out[start : start + rows] = softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_shift)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _sampled_windows(per_text: int):
    @tidy
    def run(batches):
        for batch in batches:
            langs, parts = [], []
            for lang, text, draw in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("draw").to_pylist(), strict=True):
                text = text.as_py()
                if not has_letter(text):
                    continue
                found = windows_of(text)
                for i in range(min(per_text, len(found))):
                    own = (draw // 7**i) % len(found)
                    size = WINDOW if i else 24 + draw % (WINDOW - 24)
                    langs.append(lang)
                    parts.append(found[own].tobytes()[:size].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.binary())})

    return run


def fit_language_model(docs: DataFrame, learn: Column, per_language: int = TEXTS_PER_LANGUAGE, per_text: int = WINDOWS_PER_TEXT) -> ByteCNN | None:
    """A network for the languages of ``docs(doc_id, text, lang)`` among rows where ``learn`` holds.

    Fitted on windows anywhere in at most ``per_language`` texts of each language, those of the smallest hash of
    the id. None if no row can be learned from.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    draw = F.xxhash64("doc_id")
    # ids beyond four times the expected range of a language's smallest hashes never leave their task
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    reach = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", share.alias("share"))
    near = lookup_join(rows.select("doc_id", "lang"), reach, ["lang"]).where((draw.cast("double") + 2.0**63) / 2.0**64 <= F.col("share"))
    order = Window.partitionBy("lang").orderBy(draw, "doc_id")
    ids = near.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("doc_id", "lang")
    # of different texts under one id and language, the shorter
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("one")).select("doc_id", "lang", "one.text")
    texts = texts.select("lang", "text", F.pmod(draw, F.lit(1 << 40)).alias("draw"))
    sample = texts.mapInArrow(_sampled_windows(per_text), "lang string, part binary").orderBy("lang", "part").collect()
    if not sample:
        return None
    labels = sorted({r.lang for r in sample})
    number = {lang: i for i, lang in enumerate(labels)}
    x = np.frombuffer(b"".join(r.part for r in sample), np.uint8).reshape(-1, WINDOW)
    model = ByteCNN.new(labels).fit(x, np.array([number[r.lang] for r in sample]))
    del sample, x
    give_back()
    return model


def _predicted(model: ByteCNN | None):
    @tidy
    def run(batches):
        tables = model.tables() if model else {}
        for batch in batches:
            texts = batch.column("text")
            n = batch.num_rows
            names, scores = [UNKNOWN] * n, [0.0] * n
            waiting: list[tuple[int, np.ndarray]] = []
            held = 0
            for i in range(n + 1):
                if i < n and model:
                    text = texts[i].as_py()
                    if has_letter(text):
                        waiting.append((i, windows_of(text)))
                        held += len(waiting[-1][1])
                if waiting and (held > 2048 or i == n):
                    sizes = np.array([len(w) for _, w in waiting])
                    every = np.concatenate([w for _, w in waiting])
                    weight = np.count_nonzero(every, axis=1).astype(np.float64)
                    weighted = model.probabilities(every, tables) * weight[:, None]
                    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    total = np.add.reduceat(weighted, starts) / np.add.reduceat(weight, starts)[:, None]
                    for (row, _), p in zip(waiting, total, strict=True):
                        best = int(p.argmax())
                        names[row], scores[row] = model.labels[best], float(min(max(p[best], 0.0), 1.0))
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"],
            )

    return run


def predict_languages(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    The probabilities of all windows of the whole text are averaged by their length. ``und`` with score 0 for
    texts that are null or have no letter, and for all if there is no model. Other columns are not looked at.
    """
    return docs.select("doc_id", "text").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: ByteCNN | None, min_score: float) -> DataFrame:
    """The rows whose text has a language, recognised with at least ``min_score``; all their columns as they are."""
    own = docs.withColumnsRenamed({c: f"own {c}" for c in docs.columns if c in ("lang_pred", "score")})

    @tidy
    def run(batches):
        for batch in batches:
            found = next(iter(_predicted(model)([batch.select(["text"])])))
            good = [name != UNKNOWN and score >= min_score for name, score in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
