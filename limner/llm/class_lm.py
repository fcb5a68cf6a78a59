"""Class-based bigram language model with exchange clustering.

Every word has a class; a text's probability is the product of class transitions and of the words'
probabilities within their class. The frequent words are clustered one by one, all others (unseen ones too)
by their endings, so that the class of any word is known from a table of fixed size. Counts of words
and of class neighbours are taken from all training texts by Spark jobs; between them the driver moves words to
the class that makes the corpus likelier, all words of a half at once.

Words are counted by 64-bit hashes: two of a billion distinct words share one with a chance of 0.03.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limner.llm.frequent import most_frequent
from limner.llm.words import text_groups, word_endings, word_hashes
from limner.plans.staging import stage

#: Words with an own code; the rarer ones share the codes of their endings. Codes have 16 bits.
WORDS, ENDINGS = 61_440, 4_096
#: Words that are clustered one by one.
CLUSTERED = 12_288
CLASSES = 32
SWEEPS = 5
BLOCKS, SHARES = 16, 32
_HELD = 1 << 22
_UNITS = CLUSTERED + ENDINGS
_UNIT_OF = np.concatenate((np.arange(CLUSTERED), np.zeros(WORDS - CLUSTERED, np.int64), CLUSTERED + np.arange(ENDINGS)))


def _endings(texts: pa.Array) -> np.ndarray:
    return (word_endings(texts) % np.uint64(ENDINGS)).astype(np.int32)


def _counted(batches):
    """Counts of the words of a task's texts, a few million words at a time."""
    hashes, endings, held = [], [], 0

    def flush():
        every, ends = np.concatenate(hashes), np.concatenate(endings)
        words, at, n = np.unique(every, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ends[at]), pa.array(n)], names=["word", "ending", "n"])

    for batch in batches:
        for start, stop in text_groups(batch):
            texts = batch.column("text").slice(start, stop - start)
            hashes.append(word_hashes(texts)[0])
            endings.append(_endings(texts))
            held += len(hashes[-1])
            if held > _HELD:
                yield flush()
                hashes, endings, held = [], [], 0
    if held:
        yield flush()


@dataclass
class Words:
    """Counts over all training texts: ``top`` are the hashes of the frequent words in order, ``code`` their codes by count."""

    top: np.ndarray
    code: np.ndarray
    count: np.ndarray
    ending: np.ndarray
    rare_types: np.ndarray
    rare_tokens: np.ndarray
    texts: int
    tokens: int
    types: int
    discount: float

    def codes(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return (WORDS + endings).astype(np.uint16)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        return np.where(self.top[at] == hashes, self.code[at], WORDS + endings).astype(np.uint16)

    def unit_of(self) -> np.ndarray:
        """The clustered unit of each code: frequent words are their own, the others that of their ending."""
        unit = _UNIT_OF.copy()
        n = len(self.ending)
        if n > CLUSTERED:
            unit[CLUSTERED:n] = CLUSTERED + self.ending[CLUSTERED:]
        return unit


def count_words(train: DataFrame) -> tuple[Words, DataFrame]:
    """The words of ``train(text)`` and the table ``word, n`` of all of them."""
    counts = train.select("text").mapInArrow(_counted, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    sizes = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    texts = train.count()
    top = sorted(most_frequent(counts, WORDS), key=lambda r: (-r.n, r.word))
    word = np.array([r.word for r in top], np.int64).view(np.uint64)
    count, ending = np.array([r.n for r in top], np.int64), np.array([r.ending for r in top], np.int64)
    rare_types, rare_tokens = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in counts.groupBy("ending").agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).collect():
        rare_types[r.ending], rare_tokens[r.ending] = r.types, r.tokens
    if len(top):
        rare_types -= np.bincount(ending, minlength=ENDINGS)
        rare_tokens -= np.bincount(ending, weights=count, minlength=ENDINGS).astype(np.int64)
    order = np.argsort(word)
    discount = sizes.once / (sizes.once + 2 * sizes.twice) if sizes.once else 0.5
    discount = min(max(discount, 0.1), 0.9)
    words = Words(word[order], order.astype(np.int64), count, ending, rare_types, rare_tokens, texts, sizes.tokens + texts, sizes.types + (texts > 0), discount)
    return words, counts.select("word", "n")


def _coded(words: Words):
    """Each text as codes, with its distinct rare words."""

    def run(batches):
        for batch in batches:
            for start, stop in text_groups(batch):
                texts = batch.column("text").slice(start, stop - start)
                hashes, before = word_hashes(texts)
                endings = _endings(texts)
                codes = words.codes(hashes, endings)
                rare = np.flatnonzero(codes >= WORDS)
                owner = np.searchsorted(before, rare, "right") - 1
                order = np.lexsort((hashes[rare], owner))
                rare, owner = rare[order], owner[order]
                own = hashes[rare]
                new = np.ones(len(rare), bool)
                new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare))).astype(np.int32)
                cuts = pa.array(np.searchsorted(owner[first], np.arange(stop - start + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (own[first].view(np.int64), codes[rare[first]].astype(np.int32), times)]
                n = stop - start
                packed = pa.array([codes[a:b].tobytes() for a, b in zip(before, before[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, n) for c in ("row_no", "doc_id", "held_out")), packed, *lists], names=["row_no", "doc_id", "held_out", "codes", "words", "word_codes", "times"])

    return run


_CODED = "row_no long, doc_id long, held_out boolean, codes binary, words array<long>, word_codes array<int>, times array<int>"


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with an end before, between and after them (as WORDS + ENDINGS), and the place of each text's end."""
    raw, offsets = text_bytes_of(column)
    codes = np.frombuffer(raw, np.uint16)
    bounds = offsets // 2
    n = len(bounds) - 1
    out = np.full(len(codes) + n + 1, WORDS + ENDINGS, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))] = codes
    return out, bounds[1:] + np.arange(1, n + 1)


def text_bytes_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return (data.to_pybytes()[bounds[0] : bounds[-1]] if data is not None else b""), bounds - bounds[0]


def _neighbours(unit: np.ndarray, classes: np.ndarray):
    """How often each unit follows and precedes each class, in blocks of units."""
    width = CLASSES + 1

    def run(batches):
        total = np.zeros((2, (_UNITS + 1) * width), np.int64)
        share = 0
        for batch in batches:
            if batch.num_rows:
                share = batch.column("row_no")[0].as_py() % SHARES
            units = unit[_sequence(batch.column("codes"))[0]]
            own = classes[units]
            total[0] += np.bincount(units[1:] * width + own[:-1], minlength=total.shape[1])
            total[1] += np.bincount(units[:-1] * width + own[1:], minlength=total.shape[1])
        parts = np.array_split(total, BLOCKS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([share] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "share", "sums"])

    return run


def _added(batches):
    """Sums of blocks, one after the other: a task holds one sum for each of its blocks, however many rows come."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, share, part in zip(batch.column("block").to_pylist(), batch.column("share").to_pylist(), batch.column("sums"), strict=True):
            one = np.frombuffer(part.as_buffer(), np.int64)
            if (block, share) in sums:
                sums[block, share] += one
            else:
                sums[block, share] = one.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in sums], pa.int32()), pa.array([s for _, s in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "share", "sums"]
    )


_BLOCK = "block int, share int, sums binary"


def neighbour_counts(coded: DataFrame, unit: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (units + end) x (classes + end) of the class before and the class after each unit, over all rows of ``coded``."""
    parts = coded.select("row_no", "codes").mapInArrow(_neighbours(unit, classes), _BLOCK)
    parts = parts.repartition("block", "share").mapInArrow(_added, _BLOCK).withColumn("share", F.lit(0))
    rows = parts.repartition("block").mapInArrow(_added, _BLOCK).collect()
    width, size = CLASSES + 1, (_UNITS + 1) * (CLASSES + 1)
    out = np.zeros((2, size), np.int64)
    cuts = np.array_split(np.arange(size), BLOCKS)
    for r in rows:
        out[:, cuts[r.block][0] : cuts[r.block][-1] + 1] += np.frombuffer(bytes(r.sums), np.int64).reshape(2, -1)
    return out[0].reshape(-1, width), out[1].reshape(-1, width)


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Classes after moving each movable unit to where it fits best, without its own share in the counts it is judged by."""
    table = transitions(before, classes).astype(np.float64)
    sizes = table.sum(axis=0)
    n = before.sum(axis=1)
    units = np.flatnonzero(movable & (n > 0))
    b, a, own, size = before[units].astype(np.float64), after[units].astype(np.float64), classes[units], n[units].astype(np.float64)
    eps = 0.5
    into, out_of = np.log(table[:, :CLASSES] + eps), np.log(table[:CLASSES] + eps)
    cost = 2 * np.log(sizes[:CLASSES] + eps * CLASSES)
    gain = b @ into + a @ out_of.T - size[:, None] * cost
    rows = np.arange(len(units))
    kept = (b * np.log(np.maximum(table[:, own].T - b, 0) + eps)).sum(axis=1) + (a * np.log(np.maximum(table[own] - a, 0) + eps)).sum(axis=1)
    gain[rows, own] = kept - size * 2 * np.log(np.maximum(sizes[own] - size, 0) + eps * CLASSES)
    moved = classes.copy()
    moved[units] = gain.argmax(axis=1)
    return moved


def transitions(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs, the end as last class."""
    table = np.zeros((CLASSES + 1, CLASSES + 1), np.int64)
    np.add.at(table.T, classes, before)
    return table


def likelihood(table: np.ndarray) -> float:
    """The part of the corpus log-likelihood that depends on the classes."""
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    x = table.astype(np.float64)
    return f(x) - f(x.sum(axis=1)) - f(x.sum(axis=0))


def cluster(coded: DataFrame, words: Words, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit (the end has its own) and the class transitions, of the likeliest sweep."""
    unit = np.append(words.unit_of(), _UNITS)
    classes = np.append(np.arange(_UNITS) % CLASSES, CLASSES)
    best = None
    for sweep in range(sweeps + 1):
        before, after = neighbour_counts(coded, unit, classes)
        table = transitions(before, classes)
        value = likelihood(table)
        if best is None or value > best[0]:
            best = (value, classes, table)
        if sweep == sweeps:
            break
        movable = np.ones(_UNITS + 1, bool) if sweep == 0 else (np.arange(_UNITS + 1) * 7919 // 64 + sweep) % 2 == 0
        movable[_UNITS] = False
        classes = exchange(before, after, classes, movable)
    return best[1], best[2]


@dataclass
class ClassModel:
    """Log10 probabilities. ``of_code`` and ``base_of_code`` are those of frequent words, for rare ones without their count."""

    class_of: np.ndarray
    step: np.ndarray
    of_code: np.ndarray
    unseen: np.ndarray
    base_of_code: np.ndarray
    base_all: float


def build(words: Words, unit_classes: np.ndarray, table: np.ndarray) -> ClassModel:
    """Transitions smoothed by the class frequencies; within a class absolute discounting, what it frees for unseen words."""
    class_of = unit_classes[np.append(words.unit_of(), _UNITS)]
    n_top = len(words.count)
    tokens, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    np.add.at(tokens, class_of[:n_top], words.count)
    np.add.at(types, class_of[:n_top], 1)
    np.add.at(tokens, class_of[WORDS : WORDS + ENDINGS], words.rare_tokens)
    np.add.at(types, class_of[WORDS : WORDS + ENDINGS], words.rare_types)
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * (CLASSES + 1))
    step = np.log10((table + share) / (table.sum(axis=1, keepdims=True) + 1))
    whole = np.log10(tokens + 1)
    of_code = np.zeros(WORDS + ENDINGS + 1)
    of_code[:n_top] = np.log10(words.count - words.discount) - whole[class_of[:n_top]]
    of_code[WORDS:-1] = -whole[class_of[WORDS:-1]]
    base = np.zeros(WORDS + ENDINGS + 1)
    base[:n_top] = np.log10(words.count + 1)
    base[-1] = np.log10(words.texts + 1)
    unseen = np.log10(words.discount * types + 1)[class_of[WORDS : WORDS + ENDINGS]]
    return ClassModel(class_of, step, of_code, unseen, base, float(np.log10(words.tokens + words.types + 1)))


def _scored(model: ClassModel):
    def run(batches):
        for batch in batches:
            codes, ends = _sequence(batch.column("codes"))
            classes = model.class_of[codes]
            values = np.concatenate(([0.0], model.step[classes[:-1], classes[1:]] + model.of_code[codes[1:]]))
            known = ((codes < WORDS) | (codes == WORDS + ENDINGS)).astype(np.int64)
            starts = np.concatenate(([1], ends[:-1] + 1)) if len(ends) else ends
            sums = [np.add.reduceat(x, starts) if len(starts) else x[:0] for x in (values, model.base_of_code[codes], known)]
            n = ends - starts + 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_no", "doc_id", "held_out")), pa.array(n.astype(np.int64)), pa.array(sums[2]), pa.array(sums[1] - n * model.base_all), pa.array(sums[0])],
                names=["row_no", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def class_model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for every row of ``docs(doc_id, text)``.

    Learned from the rows where ``held_out`` is false. A text's tokens are its words, A-Z in lower case, and one end; a null text
    is empty. ``score`` is the model's log10 probability of all tokens, ``base_score`` that of add-one unigrams over
    the training words and one unseen word; ``perplexity`` is ``10 ** (-score / n_tokens)``. Every row is scored, those that repeat a ``doc_id`` or
    have none too.
    """
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    words, counts = count_words(docs.where("NOT held_out"))
    coded = docs.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(_coded(words), _CODED)
    coded = stage(coded, "codes")
    classes, table = cluster(coded.where("NOT held_out"), words)
    model = build(words, classes, table)
    whole = coded.select("row_no", "doc_id", "held_out", "codes").mapInArrow(
        _scored(model), "row_no long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    rare = coded.select("row_no", F.inline(F.arrays_zip("words", "word_codes", "times"))).withColumnRenamed("words", "word")
    unseen = docs.sparkSession.createDataFrame([(WORDS + i, float(x)) for i, x in enumerate(model.unseen)], "word_codes int, unseen double")
    met = rare.join(counts, "word", "left").join(F.broadcast(unseen), "word_codes")
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    of_word = F.when(n > 0, F.log10(F.greatest(n - words.discount, F.lit(1e-3)))).otherwise(F.col("unseen"))
    met = met.select(
        "row_no", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(n > 0, times).otherwise(0).cast("long").alias("n_known"), (times * F.log10(n + 1.0)).alias("base_score"), (times * of_word).alias("score"),
    )
    out = whole.union(met).groupBy("row_no").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
