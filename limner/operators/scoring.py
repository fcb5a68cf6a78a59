"""Scoring items against a bank of prompt vectors.

Scores stay inside the item row as one array with a value per class, in class
order: items are never multiplied by prompts into a long table, and argmax,
ranks and top-k are expressions on that array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from limner.functions import vectors as V
from limner.functions.numbers import round_exact
from limner.functions.text import fill_template
from limner.plans.staging import stage

MAX_BANK_BYTES = 256 << 20
#: Numbers of a bank that may stand in a plan.
PLAN_VALUES = 1 << 16
#: Size of either side of a tile.
BLOCK_BYTES = 16 << 20


def build_prompts(classes: DataFrame, templates: Sequence[str], n_templates: int = 1, slot: str = "style") -> DataFrame:
    """Every class with every template: ``prompt_id, class_id, template_id, prompt_text``.

    ``n_templates`` is held within 1 and the number of templates.
    """
    n = max(1, min(int(n_templates), len(templates)))
    each = F.posexplode(F.array(*[F.lit(t) for t in templates[:n]])).alias("template_id", "template")
    grid = classes.select("class_id", "name", each)
    return grid.select(
        (F.col("class_id") * n + F.col("template_id")).alias("prompt_id"),
        "class_id",
        "template_id",
        fill_template(F.col("template"), slot, F.col("name")).alias("prompt_text"),
    )


def caption_rows(df: DataFrame, class_col: str, template: str, slot: str = "style_id") -> DataFrame:
    """Pair every row with the caption of its class."""
    return df.withColumn("text", fill_template(F.lit(template), slot, F.col(class_col).cast("string")))


@dataclass(frozen=True)
class Bank:
    """Prompt vectors in class order; ``starts`` says where each class begins."""

    class_ids: list
    starts: list[int]
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]


def load_bank(
    bank: DataFrame, class_col: str = "class_id", order: str = "template_id", vector: str = "vector",
    max_bytes: int = MAX_BANK_BYTES,
) -> Bank | None:
    """Bring the bank to the driver once if it fits ``max_bytes``; None if it does not."""
    size = bank.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not size["n"]:
        raise ValueError("the prompt bank is empty")
    if size["n"] * size["d"] * 8 > max_bytes:
        return None
    rows = bank.select(class_col, V.as_double(F.col(vector)).alias("v")).orderBy(class_col, order).toArrow()
    ids = rows[class_col].to_pylist()
    starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    lengths = set(rows["v"].combine_chunks().value_lengths().to_pylist())
    if len(lengths) != 1:
        raise ValueError(f"bank vectors differ in length: {sorted(lengths)}")
    flat = rows["v"].combine_chunks().flatten().to_numpy()
    return Bank([ids[i] for i in starts], starts, flat.reshape(len(ids), -1))


def _unit(m: np.ndarray, floor: float = V.NORM_FLOOR) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), floor)


def _dense(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length as a matrix; raises on a vector of another length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths.min() != dim or lengths.max() != dim):
        bad = lengths[lengths != dim][0]
        raise ValueError(f"item vector has {bad} values, the bank has {dim}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), dim)


def _lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """Matrix rows as list values, with NULL where ``present`` is false."""
    offsets = np.concatenate([[0], np.cumsum(np.where(present, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~present))


def linear_scorer(weights: np.ndarray, starts: Sequence[int] | None = None, unit: bool = False, bias: np.ndarray | None = None):
    """Arrow UDF ``vector -> scores``: one matrix product per batch.

    ``starts`` pools the products of each class by their maximum, ``unit``
    normalises both sides first (cosine), ``bias`` is added before pooling.
    """
    weights = _unit(weights) if unit else weights
    starts = None if starts is None or len(starts) == len(weights) else np.asarray(starts)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vectors: pa.Array) -> pa.Array:
        present = ~vectors.is_null().to_numpy(zero_copy_only=False)
        x = _dense(vectors.drop_null(), weights.shape[1])
        x = _unit(x) if unit else x
        out = x @ weights.T
        if bias is not None:
            out = out + bias
        if starts is not None:
            out = np.maximum.reduceat(out, starts, axis=1)
        return _lists(out, present)

    return score


def score_classes(
    items: DataFrame, bank: Bank, vector: str, cosine: bool = True, engine: str = "arrow", out: str = "class_scores"
) -> DataFrame:
    """Add ``out``: the best score per class over its prompts, in ``bank.class_ids`` order.

    ``engine="arrow"`` multiplies whole batches; ``engine="catalyst"`` evaluates the
    same expression with built-in functions. Its bank is part of the plan, so one of more than ``PLAN_VALUES`` numbers goes the other way.
    """
    if engine == "arrow" or (engine == "catalyst" and bank.vectors.size > PLAN_VALUES):
        scorer = linear_scorer(bank.vectors, bank.starts, unit=cosine)
        return items.withColumn(out, scorer(F.col(vector)))
    if engine != "catalyst":
        raise ValueError(f"unknown engine {engine!r}")
    rows = _unit(bank.vectors) if cosine else bank.vectors
    v = V.as_double(F.col(vector))
    v = V.l2_normalize(v) if cosine else v
    ends = [*bank.starts[1:], len(rows)]
    stacked = V.constant([rows[a:b] for a, b in zip(bank.starts, ends)])
    # bound as an element, so that no prompt and no term computes the unit vector again; the work of a row is worth moving it to all cores
    best = F.transform(F.array(v), lambda unit: F.transform(stacked, lambda prompts: F.array_max(V.project(unit, prompts))))
    spread = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.withColumn(out, F.get(best, F.lit(0)))


@dataclass(frozen=True)
class Tiles:
    """Items and prompts cut so that a task multiplies one chunk of items with one block of prompts.

    A block holds whole classes, but for those that have more prompts than a block: they are ``split`` over all blocks.
    There are fewer of them than blocks.
    """

    blocks: int
    chunks: int
    split: list

    @classmethod
    def plan(cls, items: DataFrame, bank: DataFrame, vector: str, bank_vector: str, class_col: str, block_bytes: int) -> Tiles:
        """Both sides of a tile have about ``block_bytes``; whichever is the larger table is then read by fewer tiles of the other."""
        size = bank.agg(F.count("*").alias("n"), F.max(F.size(bank_vector)).alias("d")).first()
        width = 8 * (size["d"] or 1)
        blocks = max(1, -(-size["n"] * width // block_bytes))
        chunks = max(1, -(-items.count() * width // block_bytes))
        most = max(1, block_bytes // width)
        split = bank.groupBy(class_col).agg(F.count("*").alias("n")).where(F.col("n") > most).select(class_col).collect() if blocks > 1 else []
        return cls(int(blocks), int(chunks), [r[0] for r in split])

    def items(self, items: DataFrame, keys: Sequence[str], vector: str, *more: str) -> DataFrame:
        """Every item once for each block."""
        chunk = F.pmod(F.xxhash64(*keys), F.lit(self.chunks)).cast("int").alias("_chunk")
        rows = items.where(F.col(vector).isNotNull()).select(*keys, *more, V.as_double(F.col(vector)).alias("_x"), chunk)
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("_block"))

    def prompts(self, bank: DataFrame, bank_vector: str, class_col: str) -> DataFrame:
        """Every prompt once for each chunk."""
        block = F.xxhash64(class_col)
        if self.split:
            block = F.when(F.col(class_col).isin(self.split), F.xxhash64(class_col, bank_vector)).otherwise(block)
        rows = bank.select(F.col(class_col).alias("class_id"), V.as_double(F.col(bank_vector)).alias("_w"), F.pmod(block, F.lit(self.blocks)).cast("int").alias("_block"))
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("_chunk"))


#: Scores of a tile that are in memory at once.
TILE_SCORES = 1 << 22


def _tile_scores(a: pa.Table, b: pa.Table, keys: Sequence[str], cosine: bool) -> Iterator[tuple[pa.Table, list, np.ndarray]]:
    """Some items of a tile with their best score for each class of it. Rows and classes come in the same order every time."""
    if not a.num_rows or not b.num_rows:
        return
    a = a.sort_by([(k, "ascending") for k in keys])
    dim = b["_w"].combine_chunks().value_lengths()[0].as_py()
    w = _dense(b["_w"].combine_chunks(), dim)
    ids = b["class_id"].combine_chunks()
    order = np.lexsort((*w.T[::-1], np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]))
    ids = ids.take(pa.array(order)).to_pylist()
    w = _unit(w[order]) if cosine else w[order]
    starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    classes = [ids[i] for i in starts]
    step = max(1, TILE_SCORES // len(w))
    for at in range(0, a.num_rows, step):
        part = a.slice(at, step)
        x = _dense(part["_x"].combine_chunks(), dim)
        yield part, classes, np.maximum.reduceat((_unit(x) if cosine else x) @ w.T, starts, axis=1)


def _by_tile(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = list(run(a, b))
        return pa.concat_tables(parts).cast(arrow) if parts else arrow.empty_table()

    return left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInArrow(tile, schema)


def _key_fields(items: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [items.schema[n] for n in names]


def score_long(
    items: DataFrame, bank: DataFrame, keys: Sequence[str], vector: str, bank_vector: str = "vector", cosine: bool = True,
    class_col: str = "class_id", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keys, class_id, score`` for a bank too large for one process: a row for each item and class.

    The best score per class of each tile (see ``Tiles``) is followed by a plain aggregate, combined on the map
    side. ``block_predictions`` finds the best class and the rank of the true one without these rows.
    """
    keys = list(keys)
    tiles = Tiles.plan(items, bank, vector, bank_vector, class_col, block_bytes)
    schema = T.StructType([*_key_fields(items, keys), T.StructField("class_id", bank.schema[class_col].dataType), T.StructField("score", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        for part, classes, best in _tile_scores(a, b, keys, cosine):
            owner = pa.array(np.repeat(np.arange(part.num_rows), len(classes)))
            yield part.select(keys).take(owner).append_column("class_id", pa.array(classes * part.num_rows)).append_column("score", pa.array(best.ravel()))

    return max_pool(_by_tile(tiles.items(items, keys, vector), tiles.prompts(bank, bank_vector, class_col), run, schema), keys)


def block_predictions(
    items: DataFrame, bank: DataFrame, keys: Sequence[str], vector: str, truth: str, bank_vector: str = "vector", cosine: bool = True,
    class_col: str = "class_id", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keys, truth, pred_label, true_rank`` for a bank of any size, by two passes over the tiles.

    The first pass leaves one row for each item and block: the best class, its score and the score of the true class. With the
    best of these known, the second one counts in each block the classes that beat the true score; their sum is the rank. Of classes
    split over blocks the names are kept, so that each counts once. The lowest class wins ties; without prompts of the true
    class the rank is NULL, and both are for items without a vector. Nothing has a row for each item and class.
    """
    keys = list(keys)
    tiles = Tiles.plan(items, bank, vector, bank_vector, class_col, block_bytes)
    kind = bank.schema[class_col].dataType
    prompts = tiles.prompts(bank, bank_vector, class_col)
    split = set(tiles.split)
    found = T.StructType([*_key_fields(items, [*keys, truth]), T.StructField("score", T.DoubleType()), T.StructField("class_id", kind), T.StructField("own", T.DoubleType())])

    def best_of(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        for part, classes, best in _tile_scores(a, b, keys, cosine):
            place = {c: i for i, c in enumerate(classes)}
            own = np.array([place.get(t, -1) for t in part[truth].to_pylist()])
            top = best.argmax(axis=1)  # classes ascend, so the lowest of equals
            rows = np.arange(part.num_rows)
            out = part.select([*keys, truth]).append_column("score", pa.array(best[rows, top])).append_column("class_id", pa.array([classes[i] for i in top]))
            yield out.append_column("own", pa.array(best[rows, own], mask=own < 0))

    firsts = _by_tile(tiles.items(items, keys, vector, truth), prompts, best_of, found)
    chosen = firsts.groupBy(*keys, truth).agg(F.min(F.struct((-F.col("score")).alias("score"), "class_id")).alias("_best"), F.max("own").alias("_own"))
    chosen = stage(chosen.select(*keys, truth, F.col("_best.class_id").alias("pred_label"), "_own"), "best-classes")

    counts = T.StructType([*_key_fields(items, [*keys, truth]), T.StructField("n", T.LongType()), T.StructField("wide", T.ArrayType(kind))])

    def beaten_by(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        for part, classes, best in _tile_scores(a, b, keys, cosine):
            own = part["_own"].to_numpy()[:, None]
            rank = {t: i for i, t in enumerate(sorted({*classes, *part[truth].to_pylist()}))}
            ids, true = np.array([rank[c] for c in classes]), np.array([rank[t] for t in part[truth].to_pylist()])[:, None]
            beats = ((best > own) | ((best == own) & (ids < true))) & (ids != true)
            wide = np.array([c in split for c in classes])
            names = [[classes[i] for i in np.flatnonzero(row)] for row in beats & wide] if wide.any() else [[]] * part.num_rows
            out = part.select([*keys, truth]).append_column("n", pa.array((beats & ~wide).sum(axis=1)))
            yield out.append_column("wide", pa.array(names, pa.list_(to_arrow_type(kind))))

    known = items.join(chosen.where("_own IS NOT NULL").select(*keys, truth, "_own"), [*keys, truth])
    beaten = _by_tile(tiles.items(known, keys, vector, truth, "_own"), prompts, beaten_by, counts)
    wide = F.size(F.array_distinct(F.flatten(F.collect_list("wide"))))  # one list a block, of fewer names than blocks
    ranks = beaten.groupBy(*keys, truth).agg((F.sum("n") + wide + 1).cast("int").alias("true_rank"))
    done = chosen.drop("_own").join(ranks, [*keys, truth], "left").select(*keys, truth, "pred_label", "true_rank")
    blank = items.where(F.col(vector).isNull()).select(*keys, truth, F.lit(None).cast(kind).alias("pred_label"), F.lit(None).cast("int").alias("true_rank"))
    return done.unionByName(blank)


def max_pool(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class score = the best of its prompts."""
    return scores.groupBy(*keys, "class_id").agg(F.max("score").alias("score"))


def scores_to_rows(df: DataFrame, keys: Sequence[str], class_ids: Sequence, scores: str = "class_scores") -> DataFrame:
    """In-row scores as ``keys, class_id, score`` rows."""
    ids = F.lit(list(class_ids))
    long = df.select(*keys, F.posexplode(scores).alias("_at", "score"))
    return long.select(*keys, F.get(ids, F.col("_at")).alias("class_id"), "score")


def scores_to_columns(df: DataFrame, base: Sequence[str], names: Sequence[str], scores: str = "class_scores") -> DataFrame:
    """In-row scores as one column per class name; no pivot, no shuffle."""
    return df.select(*base, *[F.get(scores, F.lit(i)).alias(n) for i, n in enumerate(names)])


def class_columns(df: DataFrame, base: Sequence[str] = ("source_shard", "source_row_idx", "true_label", "pred_label")) -> list[str]:
    """Score columns of a wide prediction table: all that are not base columns."""
    return [c for c in df.columns if c not in base]


def columns_to_rows(df: DataFrame, base: Sequence[str]) -> DataFrame:
    """Wide prediction table as ``base, label, score`` rows."""
    present = [c for c in base if c in df.columns]
    return df.unpivot(present, class_columns(df, base), "label", "score")


def predict(df: DataFrame, class_ids: Sequence, truth: str | None = None, scores: str = "class_scores") -> DataFrame:
    """Add ``pred_label`` (lowest id on ties) and, with a truth column, its ``true_rank``."""
    ids = F.lit(list(class_ids))
    out = df.withColumn("pred_label", F.get(ids, V.argmax(F.col(scores))))
    if truth is not None:
        place = (F.array_position(ids, F.col(truth)) - 1).cast("int")
        out = out.withColumn("true_rank", V.rank_of(F.col(scores), F.nullif(place, F.lit(-1))))
    return out


def argmax_class(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best class per item from score rows, lowest id on ties."""
    best = F.max_by("class_id", F.struct(F.col("score"), (-F.col("class_id")).alias("_tie")))
    return scores.groupBy(*keys).agg(best.alias("pred_label"), F.max("score").alias("score"))


def true_rank(scores: DataFrame, truth: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rank of the true class from score rows: 1 + number of classes that beat it; NULL if it has no score.

    The score of the true class is found first; the classes that beat it are then counted, so that
    no item's scores are ever brought together.
    """
    keys = list(keys)
    rows = scores.join(truth, keys)
    own = rows.where(F.col("class_id") == F.col(label)).groupBy(*keys, label).agg(F.max("score").alias("_s"))
    beats = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("class_id") < F.col(label)))
    counted = rows.join(own, [*keys, label], "left").groupBy(*keys, label).agg(F.max("_s").alias("_s"), F.count_if(beats).alias("_n"))
    return counted.select(*keys, label, F.when(F.col("_s").isNotNull(), F.col("_n") + 1).cast("int").alias("true_rank"))


def topk_classes(df: DataFrame, class_ids: Sequence, k: int, scores: str = "class_scores") -> DataFrame:
    """Add ``top_classes``: the ids of the ``k`` best classes, best first."""
    ids = F.lit(list(class_ids))
    return df.withColumn("top_classes", F.transform(V.best_positions(F.col(scores), k), lambda i: F.get(ids, i)))


def best_prompts(items: DataFrame, bank: Bank, vector: str, cosine: bool = True, out: str = "best_prompts") -> DataFrame:
    """Add ``out``: for each class, in ``bank.class_ids`` order, the score and the place of its best prompt among its own.

    The place is carried through the maximum over the prompts of a class (the first of equals), so that no row for an item and a prompt is made.
    """
    weights = _unit(bank.vectors) if cosine else bank.vectors
    starts = np.asarray(bank.starts)
    kind = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("place", T.IntegerType())]))

    @F.arrow_udf(kind)
    def best(vectors: pa.Array) -> pa.Array:
        present = ~vectors.is_null().to_numpy(zero_copy_only=False)
        x = _dense(vectors.drop_null(), weights.shape[1])
        scores = (_unit(x) if cosine else x) @ weights.T
        ends = [*starts[1:], len(weights)]
        place = np.stack([scores[:, a:b].argmax(axis=1) for a, b in zip(starts, ends)], axis=1)
        top = np.take_along_axis(scores, place + starts, axis=1)
        cells = pa.StructArray.from_arrays([pa.array(top.ravel()), pa.array(place.ravel().astype(np.int32))], names=["score", "place"])
        offsets = np.concatenate([[0], np.cumsum(np.where(present, len(starts), 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), cells, mask=pa.array(~present))

    return items.withColumn(out, best(F.col(vector)))


def check_dims(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(fitting, misfits)`` by vector length; a NULL vector is a misfit."""
    fits = F.coalesce(F.size(vector) == dim, F.lit(False)) & F.col(vector).isNotNull()
    return df.filter(fits), df.filter(~fits)


def detect(df: DataFrame, labels: Sequence[str], threshold: float, scores: str = "class_scores") -> DataFrame:
    """Add ``detections``: labels whose unrounded score reaches ``threshold``, best first.

    Scores are emitted at 4 decimals and ordered by that value, then by vocabulary order.
    """
    names = F.lit(list(labels))
    scored = F.transform(scores, lambda s, i: F.struct(s.alias("raw"), i.alias("pos"), F.get(names, i).alias("label")))
    kept = F.filter(scored, lambda d: d["raw"] >= threshold)
    ranked = F.array_sort(F.transform(kept, lambda d: F.struct((-round_exact(d["raw"], 4)).alias("neg"), d["pos"], d["label"])))
    return df.withColumn(
        "detections", F.transform(ranked, lambda d: F.struct(d["label"].alias("label"), (-d["neg"]).alias("score")))
    )


def detect_rows(scores: DataFrame, keys: Sequence[str], labels: Sequence[str], threshold: float) -> DataFrame:
    """``keys, detections`` from ``keys, label, score`` rows.

    A label counts once, with its best score, so an item with any number of rows
    still ends in one value per label of the vocabulary.
    """
    best = [F.max(F.when(F.col("label") == x, F.col("score").cast("double"))) for x in labels]
    wide = scores.groupBy(*keys).agg(F.array(*best).alias("_scores"))
    return detect(wide, labels, threshold, "_scores").drop("_scores")
