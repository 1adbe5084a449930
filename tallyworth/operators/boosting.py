"""Boosted trees for several classes at once, grown level by level from histograms.

Every round fits one tree a class to the gradients of the softmax loss, by gains of second order. The rows are held in
bins, in blocks of numpy arrays that stay on the executors, and one pass a level sums the gradients by (model, class,
node, feature, bin) for all open nodes, all classes and all models (the folds of a cross-validation) together. A shuffle
brings the sums of a model and class together, and the task that has them picks the splits; only these come to the driver.
Where no model has more rows than one task takes, the rows of a model lie in one task, which needs no other's sums: then all
rounds are one pass. Several models that keep the cores busy by themselves may have more rows each, up to a fixed number.

Gradients are rounded to whole multiples of 2^-24 before they are summed. Sums of whole numbers do not depend on their
order, so neither partitioning nor a lost executor changes a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyworth.functions.buckets import HASH_RANGE
from tallyworth.session import discard, written_at

BINS = 256
SCALE = 1 << 24
# The least gain of a split, and the rounds after which the scores of all rows are written anew.
LEAST_GAIN = 1e-6
WRITTEN_ROUNDS = 8
# Of percentile_approx, for the borders of the bins: exact up to so many rows, and off by so small a share beyond.
_ACCURACY = 100_000
# Rows that a task takes in a pass, those of a block, and those that are worth a task of their own while blocks are made.
TASK_ROWS, BLOCK_ROWS, PACKED_ROWS = 100_000, 50_000, 10_000
# Rows of a model that one task takes at most where several models keep more than half of the cores busy.
MODEL_ROWS = 1_000_000
_LEAF, _OPEN = -1, -2


@dataclass(frozen=True)
class Boosting:
    """Settings of boosted trees; `least_weight` is the least sum of second derivatives on either side of a split."""

    depth: int
    rate: float
    rounds: int
    rows_share: float = 1.0
    columns_share: float = 1.0
    least_weight: float = 1.0
    seed: int = 42
    penalty: float = 1.0

    def __post_init__(self):
        if self.rate <= 0 or not 0 < self.rows_share <= 1 or not 0 < self.columns_share <= 1:
            raise ValueError(f"rate and shares must be above 0, shares at most 1: {self}")


@dataclass
class Tree:
    """Nodes in heap order: the feature that a node asks (below 0: none), the border and the value of each."""

    depth: int
    features: list[int] = field(default_factory=list)
    borders: list[int] = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    def __post_init__(self):
        size = (1 << (self.depth + 1)) - 1
        self.features, self.borders, self.values = [_OPEN, *[_LEAF] * (size - 1)], [0] * size, [0.0] * size


def drawn_columns(settings: Boosting, round_: int, class_: int, columns: int) -> list[int]:
    """The features that one tree may ask: the first of them in the order of a hash."""
    order = sorted(range(columns), key=lambda i: hashlib.md5(f"{settings.seed}:{round_}:{class_}:{i}".encode()).hexdigest())
    return sorted(order[: max(1, int(settings.columns_share * columns))])


def _draw(settings: Boosting, round_: int, classes: int, columns: int) -> list[list[int]]:
    return [drawn_columns(settings, round_, k, columns) for k in range(classes)]


def bin_borders(rows: DataFrame, features: Sequence[str], models: int) -> list[list[list[float]]]:
    """The borders of the bins of each model and feature: its quantiles in steps of 1/256, ascending, each once."""
    at = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    asked = [F.percentile_approx(F.col(f"`{name}`").cast("double"), at, F.lit(_ACCURACY)).alias(f"q{i}") for i, name in enumerate(features)]
    found = {r["model"]: r for r in rows.groupBy("model").agg(*asked).collect()}
    return [[sorted(set(found[m][f"q{i}"])) if m in found else [] for i in range(len(features))] for m in range(models)]


def splits(node: np.ndarray, feature: np.ndarray, bin_: np.ndarray, sums: np.ndarray, settings: Boosting) -> dict[int, tuple]:
    """For every open node of a tree: feature, border, sums of it and of its left side; feature -1: none.

    Cells, in the order of node, feature and bin, hold the sums (g, h, rows) of one bin of one feature of one node. Of
    equal gains the first feature and the lowest border win.
    """
    g, h, rows = sums
    new_node = np.append(True, node[1:] != node[:-1])
    starts = np.flatnonzero(new_node | np.append(True, feature[1:] != feature[:-1]))
    sizes = np.diff(np.append(starts, len(node)))

    def both(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum up to each cell of its node and feature, and the whole."""
        upto = np.cumsum(x)
        before = np.repeat(upto[starts] - x[starts], sizes)
        return upto - before, np.repeat(np.add.reduceat(x, starts), sizes)

    (gl, g_all), (hl, h_all), (nl, n_all) = both(g), both(h), both(rows)
    a, b, c, d = gl / SCALE, hl / SCALE, g_all / SCALE, h_all / SCALE
    e, f = (g_all - gl) / SCALE, (h_all - hl) / SCALE
    p = settings.penalty
    gain = a * a / (b + p) + e * e / (f + p) - c * c / (d + p)
    fits = (nl < n_all) & (b >= settings.least_weight) & (f >= settings.least_weight) & (gain > LEAST_GAIN)
    gain = np.where(fits, gain, -1.0)
    found = {}
    edges = np.append(np.flatnonzero(new_node), len(node))
    for lo, hi in zip(edges, edges[1:]):
        i = lo + int(np.argmax(gain[lo:hi]))
        asked = int(feature[i]) if fits[i] else -1
        found[int(node[i])] = (asked, int(bin_[i]), c[i], d[i], a[i], b[i])
    return found


def _grown(tree: Tree, node: int, level: int, found: tuple, settings: Boosting) -> None:
    """Give an open node its split and its sides their values, or make it a leaf."""
    asked, border, g, h, gl, hl = found

    def value(x: float, y: float) -> float:
        return float(-x / (y + settings.penalty) * settings.rate)

    tree.features[node], tree.borders[node], tree.values[node] = asked, border, value(g, h)
    if asked < 0:
        return
    for child, x, y in ((2 * node + 1, gl, hl), (2 * node + 2, g - gl, h - hl)):
        tree.features[child] = _OPEN if level + 1 < settings.depth else _LEAF
        tree.values[child] = value(x, y)


@dataclass
class Block:
    """Some rows as arrays, one entry or column a row: model, label, bins by feature, bits of the rounds that draw it, scores by class."""

    model: np.ndarray
    label: np.ndarray
    bins: np.ndarray
    drawn: np.ndarray
    scores: np.ndarray


@dataclass
class Forest:
    """The trees of one round as arrays by model, class and node."""

    features: np.ndarray
    borders: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(trees: list[list[Tree]]) -> Forest:
        def gathered(name: str, kind: type) -> np.ndarray:
            return np.array([[getattr(t, name) for t in own] for own in trees], kind)

        return Forest(gathered("features", np.int16), gathered("borders", np.int16), gathered("values", np.float64))

    def places(self, class_: int, model: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of a class's tree that each row reaches by at most so many levels."""
        size = self.features.shape[2]
        features, borders = (np.ascontiguousarray(x[:, class_]).ravel() for x in (self.features, self.borders))
        root = model.astype(np.int64) * size
        cells, rows = np.ascontiguousarray(bins).ravel(), np.arange(len(model))
        at = np.zeros(len(model), np.int64)
        for _ in range(levels):
            here = root + at
            asked = features[here]
            bin_ = cells[np.maximum(asked, 0).astype(np.int64) * len(model) + rows]
            at = np.where(asked < 0, at, 2 * at + 1 + (bin_ > borders[here]))
        return at


def _drawn(users: pd.Series, settings: Boosting) -> np.ndarray:
    """Packed bits of every round, by row: whether `key_hash` of the user and the round is within the share."""
    least = int(settings.rows_share * HASH_RANGE)
    if least >= HASH_RANGE:
        return np.zeros((0, len(users)), np.uint8)
    codes, names = pd.factorize(users)
    own = [name.encode() for name in names]
    bits = np.zeros((settings.rounds, len(own)), bool)
    for round_ in range(settings.rounds):
        seed = f"{settings.seed}:{round_}:".encode()
        heads = b"".join(hashlib.md5(seed + name).digest()[:4] for name in own)
        bits[round_] = np.frombuffer(heads, ">u4") < least
    return np.packbits(bits, axis=0)[:, codes]


_BLOCK = "rows int, model binary, label binary, bins binary, drawn binary"


def _packed(parts: Iterable[pd.DataFrame], borders: list[list[np.ndarray]], settings: Boosting, by_model: bool) -> Iterator[pd.DataFrame]:
    """Blocks of binned rows, if asked for of one model each; a part has model, user (text), label and then the features."""

    def block(rows: pd.DataFrame, drawn: np.ndarray) -> tuple:
        model = rows["model"].to_numpy(np.int16)
        bins = np.zeros((rows.shape[1] - 3, len(rows)), np.uint8)
        for m in np.unique(model):
            own = model == m
            for i in range(len(bins)):
                bins[i, own] = np.searchsorted(borders[m][i], rows.iloc[:, 3 + i].to_numpy(np.float64)[own])
        arrays = (model, rows["label"].to_numpy(np.int8), bins, drawn)
        return (len(rows), *(a.tobytes() for a in arrays))

    def blocks(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        drawn = _drawn(rows["user"], settings)  # of all models at once, as they learn from the same users
        own = rows.groupby("model").indices.values() if by_model else [np.arange(len(rows))]
        return pd.DataFrame([block(rows.iloc[x], drawn[:, x]) for x in own], columns=["rows", "model", "label", "bins", "drawn"])

    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= BLOCK_ROWS:
            yield blocks(held)
            held = []
    if any(map(len, held)):
        yield blocks(held)


def _unpacked(row: Row, classes: int) -> Block:
    model, label = np.frombuffer(row["model"], np.int16), np.frombuffer(row["label"], np.int8)
    bins, drawn = (np.frombuffer(row[c], np.uint8).reshape(-1, row["rows"]) for c in ("bins", "drawn"))
    return Block(model, label, bins, drawn, np.zeros((classes, row["rows"])))


def _raised(block: Block, forest: Forest, depth: int) -> Block:
    """The block with the trees of one more round added to its scores."""
    scores = block.scores.copy()
    for k in range(len(scores)):
        scores[k] += forest.values[block.model, k, forest.places(k, block.model, block.bins, depth)]
    return Block(block.model, block.label, block.bins, block.drawn, scores)


def _slopes(block: Block, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows drawn for a round, their bins and their rounded first and second derivatives by class."""
    own, label, bins, scores = np.arange(len(block.label)), block.label, block.bins, block.scores
    if len(block.drawn):
        own = np.flatnonzero(block.drawn[round_ // 8] & (128 >> round_ % 8))
        label, bins, scores = label[own], bins[:, own], scores[:, own]
    e = np.exp(scores - scores.max(axis=0))
    share = e / sum(e)
    g = np.floor((share - (np.arange(len(scores))[:, None] == label)) * SCALE + 0.5)
    h = np.floor(2 * share * (1 - share) * SCALE + 0.5)
    return own, bins, g, h


def _sums(blocks: Iterable[Block], forest: Forest, drawn: list[list[int]], round_: int, level: int) -> Iterator[tuple[int, tuple]]:
    """By model and class: the sums (g, h, rows) of each (open node of the level, drawn feature, bin) that has rows, beside its number."""
    models, classes, _ = forest.features.shape
    first, nodes = (1 << level) - 1, 1 << level
    open_ = forest.features[:, :, first : first + nodes] == _OPEN
    places = [np.where(open_[:, k], np.cumsum(open_[:, k]).reshape(models, nodes) - 1, -1) for k in range(classes)]
    sums = [np.zeros((3, np.count_nonzero(open_[:, k]), len(drawn[k]), BINS)) for k in range(classes)]
    for block in blocks:
        rows, bins, *slopes = _slopes(block, round_)
        model = block.model[rows]
        for k, total in enumerate(sums):
            if not total.size:
                continue
            node = forest.places(k, model, bins, level) - first  # below 0: of a leaf above this level
            place = np.where(node < 0, -1, places[k][model, np.maximum(node, 0)])
            own = np.flatnonzero(place >= 0)
            start, weights = place[own] * BINS, [x[k, own] for x in slopes]
            for i, feature in enumerate(drawn[k]):
                cell = start + bins[feature, own]
                for summed, x in zip(total, (*weights, None)):
                    summed[:, i] += np.bincount(cell, x, len(summed) * BINS).reshape(-1, BINS)
    for k, total in enumerate(sums):
        size = len(drawn[k]) * BINS
        for m in range(models):
            own = total[:, places[k][m][open_[m, k]]].reshape(3, -1)
            cells = np.flatnonzero(own[2])
            if len(cells):
                numbers = np.flatnonzero(open_[m, k])[cells // size] * size + cells % size
                yield m * classes + k, (numbers, own[:, cells].astype(np.int64))


def _splits(parts: Iterable[tuple[int, tuple]], drawn: list[list[int]], settings: Boosting, level: int) -> Iterator[tuple]:
    """Of each open node of a model and class: (model, class, node) and its split, from the sums of all tasks."""
    totals: dict[int, np.ndarray] = {}
    for key, (cells, sums) in parts:
        size = (1 << level) * len(drawn[key % len(drawn)]) * BINS
        totals.setdefault(key, np.zeros((3, size), np.int64))[:, cells] += sums
    for key, total in totals.items():
        model, class_ = divmod(key, len(drawn))
        found = _picked(total, np.arange(1 << level) + (1 << level) - 1, drawn[class_], settings)
        yield from (((model, class_, node), split) for node, split in found.items())


def _picked(total: np.ndarray, nodes: np.ndarray, columns: list[int], settings: Boosting) -> dict[int, tuple]:
    """The splits of the nodes, from their sums (g, h, rows) by node, drawn feature and bin, one cell beside the other."""
    cells = np.flatnonzero(total[2])
    place, bin_ = np.divmod(cells, BINS)
    at, i = np.divmod(place, len(columns))
    return splits(nodes[at], np.array(columns)[i], bin_, total[:, cells], settings)


def _level(state: RDD, trees: list[list[Tree]], drawn: list[list[int]], settings: Boosting, round_: int, level: int) -> list[tuple]:
    """One pass over the rows: the splits of all open nodes of a level."""
    sums = state.mapPartitions(partial(_sums, forest=Forest.of(trees), drawn=drawn, round_=round_, level=level))
    tasks = min(state.getNumPartitions(), len(trees) * len(drawn))
    if tasks > 1:
        sums = sums.partitionBy(tasks)
    return sums.mapPartitions(partial(_splits, drawn=drawn, settings=settings, level=level)).collect()


def _one_block(blocks: Sequence[Block]) -> Block:
    """The rows of several blocks as one."""
    return Block(*(np.concatenate([getattr(block, f.name) for block in blocks], axis=-1) for f in fields(Block)))


def _whole(blocks: Iterable[Block], settings: Boosting) -> Iterator[tuple[int, list[list[Tree]]]]:
    """The number of the model whose rows are all in these blocks, and its trees by round and class."""
    own = list(blocks)
    if not own:
        return
    block, rounds = _one_block(own), []
    for round_ in range(settings.rounds):
        drawn = _draw(settings, round_, len(block.scores), len(block.bins))
        rows, bins, g, h = _slopes(block, round_)
        trees = []
        for k, columns in enumerate(drawn):
            tree, leaves = _whole_tree(block.bins, rows, bins, (g[k], h[k]), columns, settings)
            block.scores[k] += np.array(tree.values)[leaves]
            trees.append(tree)
        rounds.append(trees)
    yield int(own[0].model[0]), rounds


def _whole_tree(every: np.ndarray, rows: np.ndarray, bins: np.ndarray, slopes: tuple, columns: list[int], settings: Boosting) -> tuple[Tree, np.ndarray]:
    """A tree grown from the drawn rows, with their bins and slopes, and the leaf of every row.

    Of the two sides of a split only the one of fewer rows is summed: the other's sums are what is left of the node's, to
    the last digit, as all are sums of whole numbers.
    """
    tree, at = Tree(settings.depth), np.zeros(every.shape[1], np.int64)
    cells, places = np.ascontiguousarray(every).ravel(), np.arange(every.shape[1])
    sums = _cell_sums(np.zeros(len(rows), np.int64), 1, bins, slopes, columns)
    for level in range(settings.depth):
        first = (1 << level) - 1
        nodes = np.flatnonzero(np.array(tree.features[first : 2 * first + 1]) == _OPEN) + first
        for node, split in _picked(sums.reshape(3, -1).astype(np.int64), nodes, columns, settings).items():
            _grown(tree, node, level, split, settings)
        features, borders = np.array(tree.features), np.array(tree.borders)
        asked = features[at]
        at = np.where(asked < 0, at, 2 * at + 1 + (cells[np.maximum(asked, 0) * len(at) + places] > borders[at]))
        parents = np.flatnonzero(features[nodes] >= 0)  # their places among the nodes
        if level + 1 == settings.depth or not len(parents):
            break
        low = np.full(len(features), -1)
        low[2 * nodes[parents] + 1] = 2 * np.arange(len(parents))
        low[2 * nodes[parents] + 2] = 2 * np.arange(len(parents)) + 1
        side = low[at[rows]]  # 2 a parent's place, and 1 for the high side; below 0: in a leaf
        sizes = np.bincount(side[side >= 0], minlength=2 * len(parents))
        fewer = 2 * np.arange(len(parents)) + (sizes[1::2] < sizes[::2])
        summed = np.flatnonzero((side >= 0) & (side == fewer[side >> 1]))
        part = _cell_sums(side[summed] >> 1, len(parents), bins[:, summed], [x[summed] for x in slopes], columns)
        rest = sums[:, parents] - part
        sums = np.empty((3, 2 * len(parents), *part.shape[2:]))
        sums[:, fewer], sums[:, fewer ^ 1] = part, rest
    _closed([tree])
    return tree, at


def _cell_sums(place: np.ndarray, places: int, bins: np.ndarray, slopes: Sequence[np.ndarray], columns: list[int]) -> np.ndarray:
    """The sums (g, h, rows) by place, drawn feature and bin."""
    total, start = np.zeros((3, places, len(columns), BINS)), place * BINS
    for i, feature in enumerate(columns):
        cell = start + bins[feature]
        for summed, x in zip(total, (*slopes, None)):
            summed[:, i] = np.bincount(cell, x, places * BINS).reshape(-1, BINS)
    return total


def _binned(rows: DataFrame, features: Sequence[str], borders: list[list[list[float]]], settings: Boosting) -> tuple[DataFrame, str, bool]:
    """The rows as a written table of blocks, in at most as many parts as a pass takes tasks, its path, and whether blocks are of one
    model each, none of which has more rows than a task takes. Rows without a user are never drawn."""
    counts = [r["count"] for r in rows.groupBy("model").count().collect()]
    most, tasks, cores = max(counts, default=0), max(1, -(-sum(counts) // TASK_ROWS)), rows.sparkSession.sparkContext.defaultParallelism
    alone = most <= TASK_ROWS or most <= MODEL_ROWS and len(counts) > 1 and 2 * len(counts) > cores
    packing = max(tasks, min(cores, sum(counts) // PACKED_ROWS))
    numbers = (F.col(f"`{name}`").cast("double").alias(f"x{i}") for i, name in enumerate(features))
    plain = rows.where("user IS NOT NULL").select("model", F.col("user").cast("string").alias("user"), F.col("label").cast("int").alias("label"), *numbers)
    edges = [[np.array(x, np.float64) for x in own] for own in borders]
    pack = partial(_packed, borders=edges, settings=settings, by_model=alone)
    state, path = written_at(plain.repartition(packing, "user").mapInPandas(pack, _BLOCK), "boosting-rows")
    return state.coalesce(tasks), path, alone


def _seedlings(models: int, classes: int, settings: Boosting) -> list[list[Tree]]:
    return [[Tree(settings.depth) for _ in range(classes)] for _ in range(models)]


def _closed(trees: list[Tree]) -> None:
    """Nodes left open become leaves."""
    for tree in trees:
        tree.features = [max(f, _LEAF) for f in tree.features]


def _held(state: RDD) -> RDD:
    return state.persist(StorageLevel.MEMORY_AND_DISK)


def fit(rows: DataFrame, features: Sequence[str], classes: int, settings: Boosting, models: int = 1) -> list[list[list[dict]]]:
    """The trees of every model, round and class, as lists of nodes with the raw thresholds of their features.

    `rows` has model (0 .. models - 1), user, label (a class number) and the features, none of them null; a row that
    several models learn from comes once for each. Rows are drawn by a hash of seed, round and user, columns by one of
    seed, round, class and number. A model without rows gets trees of one node with value 0.
    """
    spark = rows.sparkSession
    borders = bin_borders(rows, features, models)
    binned, path, alone = _binned(rows, features, borders, settings)
    blocks = binned.rdd.map(partial(_unpacked, classes=classes))
    if alone:
        if models > 1:  # all blocks of a model into the task of its number
            blocks = blocks.map(lambda block: (int(block.model[0]), block)).partitionBy(models, int).values()
        found = dict(blocks.mapPartitions(partial(_whole, settings=settings)).collect())
        discard(spark, path)
        every = [found.get(m) or _rootlings(classes, settings) for m in range(models)]
    else:
        every = _by_level(blocks, path, models, classes, len(features), settings, spark)
    return [[[_nodes(t, borders[m], features) for t in own] for own in rounds] for m, rounds in enumerate(every)]


def _rootlings(classes: int, settings: Boosting) -> list[list[Tree]]:
    """The trees of a model without rows."""
    rounds = [_seedlings(1, classes, settings)[0] for _ in range(settings.rounds)]
    for own in rounds:
        _closed(own)
    return rounds


def _by_level(blocks: RDD, path: str, models: int, classes: int, columns: int, settings: Boosting, spark: SparkSession) -> list[list[list[Tree]]]:
    """The trees by model, round and class, a pass a level; the table of the blocks, at `path`, is dropped."""
    state, before = _held(blocks), None
    every: list[list[list[Tree]]] = [[] for _ in range(models)]
    for round_ in range(settings.rounds):
        trees, drawn = _seedlings(models, classes, settings), _draw(settings, round_, classes, columns)
        for level in range(settings.depth):
            if not any(_OPEN in t.features for m in trees for t in m):
                break
            for (model, class_, node), split in _level(state, trees, drawn, settings, round_, level):
                _grown(trees[model][class_], node, level, split, settings)
        if before is not None:  # the first pass of a round has held its scores
            before.unpersist()
            before = None
            if state.isCheckpointed():
                discard(spark, path)
                path = state.getCheckpointFile()
        for m, own_trees in enumerate(trees):
            _closed(own_trees)
            every[m].append(own_trees)
        if round_ + 1 < settings.rounds:
            before, state = state, _held(state.map(partial(_raised, forest=Forest.of(trees), depth=settings.depth)))
            if (round_ + 1) % WRITTEN_ROUNDS == 0:
                state.checkpoint()
    state.unpersist()
    discard(spark, path)
    return every


def _nodes(tree: Tree, borders: list[list[float]], features: Sequence[str]) -> list[dict]:
    """The nodes of a tree that a row can reach, in heap order: node, feature, threshold (at most: low), low, high, value."""
    out, reached = [], {0}
    for n in range(len(tree.features)):
        if n not in reached:
            continue
        asked = tree.features[n]
        if asked < 0:
            out.append({"node": n, "feature": None, "threshold": None, "low": None, "high": None, "value": tree.values[n]})
        else:
            reached |= {2 * n + 1, 2 * n + 2}
            out.append({"node": n, "feature": features[asked], "threshold": borders[asked][tree.borders[n]], "low": 2 * n + 1, "high": 2 * n + 2, "value": 0.0})
    return out


@dataclass
class Walk:
    """The nodes of a tree as arrays; a leaf leads to itself."""

    features: np.ndarray
    thresholds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray
    steps: int

    @staticmethod
    def of(nodes: list[dict], features: Sequence[str]) -> Walk:
        place = {n["node"]: i for i, n in enumerate(nodes)}
        leaf = [n["feature"] is None for n in nodes]
        steps = [0] * len(nodes)
        for i, n in enumerate(nodes):  # a child stands after its parent
            if not leaf[i]:
                steps[place[n["low"]]] = steps[place[n["high"]]] = steps[i] + 1
        return Walk(
            np.array([0 if end else features.index(n["feature"]) for end, n in zip(leaf, nodes)]),
            np.array([0.0 if end else n["threshold"] for end, n in zip(leaf, nodes)], np.float64),
            np.array([i if end else place[n["low"]] for i, (end, n) in enumerate(zip(leaf, nodes))]),
            np.array([i if end else place[n["high"]] for i, (end, n) in enumerate(zip(leaf, nodes))]),
            np.array([n["value"] for n in nodes], np.float64),
            max(steps),
        )

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The value of the leaf that each row ends up in; `x` is by feature and row."""
        at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(self.steps):
            at = np.where(x[self.features[at], rows] <= self.thresholds[at], self.low[at], self.high[at])
        return self.values[at]


def prediction(trees: list[list[list[dict]]], features: Sequence[str], classes: int) -> Column:
    """The class with the highest score, the lowest of equals, as a double; null where a feature is null.

    Scores are added in the order of the rounds, so the class is the one that the rules of the same trees give.
    """
    walks = [[Walk.of(tree, features) for tree in own] for own in trees]

    def best(*columns: pd.Series) -> pd.Series:
        x = np.array([c.to_numpy(np.float64) for c in columns])
        scores = np.zeros((classes, x.shape[1]))
        for own in walks:
            for k, walk in enumerate(own):
                scores[k] += walk.scores(x)
        return pd.Series(scores.argmax(axis=0).astype(np.float64))

    numbers = [F.col(f"`{name}`").cast("double") for name in features]
    known = reduce(Column.__and__, (x.isNotNull() for x in numbers))
    return F.when(known, F.pandas_udf(best, "double")(*numbers))
