"""Ranked lexical search of many items at once, by a dual-tree search.

A document is a point whose coordinates are the impacts of the terms that some item has. Documents are
sorted by their heaviest coordinates, so that like ones stand together; each batch of a task becomes a
tree of leaves of 64 documents, and a node holds the largest value of each coordinate below it. Items are put
into a tree the same way, a node holding the largest weight of each term. The product of an item node and a
document node bounds every score between them. If it's below the weakest k-th score of the
node's items, the whole pair is left out; a score that equals the k-th is not, so the search is exact.

The k-th scores of one document in sixteen are found first and start every task's search, so nearly all
tasks leave out most pairs. A task hands on at most k rows per item.

Items are taken in blocks of bounded size (``ITEMS_AT_ONCE``, ``TERMS_AT_ONCE``), each against all documents; what is
broadcast is one block's terms, weights and k-th scores. An item with more terms is a block of its own.

Defined results: a null text has no terms; documents without a term count in nothing; documents without an id
come last among equal scores; rows that share an id are ranked each on its own, as are items; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.scratch import Scratch

LEAF = 64
FAN_OUT = 8
ITEMS_AT_ONCE = 4096
TERMS_AT_ONCE = 1 << 16
CELLS_AT_ONCE = 1 << 22
TEXT_AT_ONCE = 1 << 22
SAMPLE = 16
NO_ID = np.iinfo(np.int64).max

#: Bytes of a term as they are, A to Z lowered, all others a blank. Letters beyond ASCII have bytes from 128 on.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in a whole text; a very long one is read piece by piece."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > TEXT_AT_ONCE:
            blank = data.find(b" ", at + TEXT_AT_ONCE)
            end = len(data) if blank < 0 else blank
        counts.update(data[at:end].split())
        at = end
    return counts


@dataclass
class ItemNode:
    """A node of the tree of items: terms (sorted), the largest weight of each, and either items or children."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[int]
    children: list[ItemNode]


def item_tree(items: list[np.ndarray], weight: np.ndarray) -> ItemNode:
    """The tree over items (arrays of term numbers), like ones together: in the order of their heaviest terms."""

    def heaviest(k: int) -> list:
        terms = items[k]
        return terms[np.argsort(-weight[terms], kind="stable")[:3]].tolist()

    nodes = [ItemNode(np.sort(items[k]), weight[np.sort(items[k])], [k], []) for k in sorted(range(len(items)), key=heaviest)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), FAN_OUT):
            part = nodes[at : at + FAN_OUT]
            terms = np.unique(np.concatenate([p.terms for p in part]))
            above.append(ItemNode(terms, weight[terms], [k for p in part for k in p.items], part))
        nodes = above
    return nodes[0]


class Search:
    """The search of one task: keeps the k best of each item over all batches it's given."""

    def __init__(self, root: ItemNode, items: list[np.ndarray], weight: np.ndarray, floors: np.ndarray, k: int):
        self.root, self.items, self.weight, self.k = root, items, weight, k
        self.weakest = floors.copy()
        self.best: list[list] = [[] for _ in items]
        self.computed = 0

    def batch(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """Search documents given by their coordinates: ``lengths`` of them each, in ``terms`` and ``impacts``."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at, n = 0, len(ids)
        while at < n:
            stop = min(n, at + LEAF * FAN_OUT)
            present = np.unique(terms[starts[at] : starts[stop]])
            while stop < n and (stop - at) // LEAF * max(1, len(present)) < CELLS_AT_ONCE // 2 and stop - at < 1 << 14:
                stop = min(n, stop + LEAF * FAN_OUT)
                present = np.unique(terms[starts[at] : starts[stop]])
            part = slice(starts[at], starts[stop])
            self._tree(ids[at:stop], rows[at:stop], starts[at : stop + 1] - starts[at], terms[part], impacts[part], present)
            at = stop

    def _tree(self, ids, rows, starts, terms, impacts, present) -> None:
        self.ids, self.rows, self.starts, self.present = ids, rows, starts, present
        self.columns, self.impacts = np.searchsorted(present, terms), impacts
        leaves = -(-len(ids) // LEAF)
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        maxima = np.zeros((leaves, len(present)))
        np.maximum.at(maxima, (doc // LEAF, self.columns), impacts)
        self.levels = [maxima]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN_OUT), axis=0))
        self._visit(self.root, len(self.levels) - 1, np.zeros(1, np.int64))

    def _visit(self, node: ItemNode, level: int, boxes: np.ndarray) -> None:
        """Follow an item node against document nodes of one level: bound all of them, leave out what can't matter."""
        at = np.searchsorted(self.present, node.terms)
        at[at == len(self.present)] = 0
        known = self.present[at] == node.terms if len(self.present) else np.zeros(len(at), bool)
        if not known.any():
            return
        bound = self.levels[level][np.ix_(boxes, at[known])] @ node.weights[known].astype(np.float64)
        bound = bound * (1 + 1e-9)  # never below the whole-number product
        weakest = max(1, min(self.weakest[k] for k in node.items))
        keep = bound >= weakest - 0.5
        boxes, bound = boxes[keep], bound[keep]
        if not len(boxes):
            return
        if level == 0 and not node.children:
            self._score(node.items[0], boxes[np.argsort(-bound, kind="stable")], np.sort(bound)[::-1])
            return
        if level:
            boxes = (boxes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            boxes, level = boxes[boxes < len(self.levels[level - 1])], level - 1
        for child in node.children or [node]:
            self._visit(child, level, boxes)

    def _score(self, item: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Exact scores of an item against the documents of some leaves, the most promising ones first."""
        weight = np.zeros(len(self.present), np.int64)
        at = np.searchsorted(self.present, self.items[item])
        at[at == len(self.present)] = 0
        known = self.present[at] == self.items[item]
        weight[at[known]] = self.weight[self.items[item][known]]
        step, at = 4, 0
        while at < len(leaves) and bound[at] >= max(1, self.weakest[item]) - 0.5:
            for leaf in leaves[at : at + step]:
                first, last = leaf * LEAF, min((leaf + 1) * LEAF, len(self.ids))
                lo, hi = self.starts[first], self.starts[last]
                points = weight[self.columns[lo:hi]] * self.impacts[lo:hi]
                running = np.concatenate([[0], np.cumsum(points)])
                scores = running[self.starts[first + 1 : last + 1] - lo] - running[self.starts[first:last] - lo]
                self.computed += last - first
                good = np.flatnonzero(scores >= max(1, self.weakest[item]))
                if len(good):
                    found = zip((-scores[good]).tolist(), self.ids[first + good].tolist(), self.rows[first + good].tolist(), strict=True)
                    best = sorted([*self.best[item], *found])[: self.k]
                    self.best[item] = best
                    if len(best) == self.k:
                        self.weakest[item] = max(self.weakest[item], -best[-1][0])
            at += step


def _index(docs: DataFrame, vocabulary, id_col: str, text: str) -> DataFrame:
    """Of every document with a term: ``doc_id``, ``row``, ``n`` terms, and those of the items' terms it has with their counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, row, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = term_counts(value)
                n = counts.total()
                if n:
                    met = sorted((number[t], c) for t, c in counts.items() if t in number)
                    for column, v in zip(out, (key, row, n, [t for t, _ in met], [c for _, c in met]), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "row", "n", "terms", "counts"]
            )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text")
    )
    return rows.mapInArrow(read, "doc_id long, row long, n long, terms array<int>, counts array<long>")


def _document_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each of the items' terms is: summed by batch in the tasks, then by term."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_terms, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(found[terms])], ["term", "df"])

    rows = index.select("terms").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for term, n in rows.collect():  # at most one row per term of the block of items
        df[term] = n
    return df


def _coordinates(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple:
    """Lengths, terms and impacts of a batch's documents, in whole numbers."""
    lengths = np.diff(batch.column("terms").offsets.to_numpy())
    terms = batch.column("terms").flatten().to_numpy()
    tf = batch.column("counts").flatten().to_numpy()
    m = 10 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
    return lengths, terms, (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, lengths))


def _search(rows: DataFrame, shared, k: int, totals: tuple[int, int]) -> DataFrame:
    """The k best of each item in each task, with scores of at least the item's floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, floors = shared.value
        task = Search(item_tree(items, weight), items, weight, floors, k)
        for batch in batches:
            if batch.num_rows:
                lengths, terms, impacts = _coordinates(batch, *totals)
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                task.batch(ids, batch.column("row").to_numpy(), lengths, terms, impacts)
        found = [(i, d, r, -s) for i, best in enumerate(task.best) for s, d, r in best]
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "row", "score"])

    return rows.mapInArrow(search, "item long, doc_id long, row long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame, item_col: str, text: str) -> Iterator[tuple[list, list]]:
    """(item ids, their distinct terms) block by block; no block but the one in hand is on the driver."""
    keys, terms, n = [], [], 0
    for row in items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text}`").alias("text")).toLocalIterator():
        own = sorted(term_counts(row["text"]))
        if keys and (len(keys) == ITEMS_AT_ONCE or n + len(own) > TERMS_AT_ONCE):
            yield keys, terms
            keys, terms, n = [], [], 0
        keys.append(row["item"])
        terms.append(own)
        n += len(own)
    if keys:
        yield keys, terms


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block, (keys, terms) in enumerate(_item_blocks(items, item_col, item_text)):
        out = out.unionByName(_search_block(docs, keys, terms, k, id_col, text, Scratch(spark, f"search-{block}")))
    return out


def _search_block(docs: DataFrame, keys: list, terms: list, k: int, id_col: str, text: str, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for own in terms for t in own}))}
    numbers = [np.array([vocabulary[t] for t in own], np.int64) for own in terms]
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not vocabulary:
        return none
    index = scratch.put(_index(docs, spark.sparkContext.broadcast(vocabulary), id_col, text), "index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return none
    df = _document_frequencies(index, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    totals, met = (n_docs, n_terms), index.where(F.size("terms") > 0)

    floors = np.zeros(len(keys), np.int64)
    sample = met.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    first = _ranked(_search(sample, spark.sparkContext.broadcast((numbers, weight, floors)), k, totals), k)
    for item, score in first.where(F.col("rank") == k).select("item", "score").collect():  # at most one per item
        floors[item] = score

    heavy = spark.sparkContext.broadcast(weight)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, impacts = _coordinates(batch, *totals)
            points, stops = heavy.value[terms] * impacts, np.cumsum(lengths)
            two = np.zeros((2, batch.num_rows), np.int32)
            for d, (stop, length) in enumerate(zip(stops.tolist(), lengths.tolist(), strict=True)):
                own = points[stop - length : stop]
                top = own.argmax()
                two[0, d] = terms[stop - length + top]
                own[top] = -1
                two[1, d] = terms[stop - length + own.argmax()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(two[0]), pa.array(two[1])], [*batch.schema.names, "heaviest", "second"])

    kind = "doc_id long, row long, n long, terms array<int>, counts array<long>, heaviest int, second int"
    order = ["heaviest", "second", "row"]
    like = met.mapInArrow(keyed, kind).repartitionByRange(*order).sortWithinPartitions(*order)
    found = _search(like, spark.sparkContext.broadcast((numbers, weight, floors)), k, totals)
    names = spark.createDataFrame([(n, key) for n, key in enumerate(keys)], "item long, item_id long")
    best = scratch.put(_ranked(found, k), "best")
    doc_id = F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
