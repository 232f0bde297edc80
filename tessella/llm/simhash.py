"""SimHash near-duplicates: fingerprints, and their self-join over a binary trie.

Equal fingerprints are one class first, so copies cost nothing later. The join walks pairs of trie
nodes down together: each level adds one to the differing bits where the two nodes take different
sides, and a pair is dropped once they exceed the budget. So that executors walk apart, there are
``budget + 1`` tries over orders of the bits, each with another block of them on top: fingerprints
within the budget are equal in some block, so in one of the tries they lie below one node at that
block's depth. Each such node is walked against itself, many nodes at once in numpy, level by level
in bounded chunks; a node with more than ``MOST_TOGETHER`` fingerprints is split in the same way by
its other bits. Copies of a fingerprint are ``budget + 1`` whatever their number. Links become
components by alternating star joins.

Within ``budget`` 2 a fingerprint has at most 64 + 2016 neighbours, so no group of near copies
makes a quadratic number of links, and a task keeps the edges of a forest of them. A text is hashed whole, its hashes some thousands at a time.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are
linked like any other; with fewer words than a shingle the whole sequence is the one shingle;
null ids take part but name a component only where it has no other id (then component_id is null);
repeated rows share one result; an empty table gives an empty result; further columns are ignored
by ``near_groups``, whatever their names, and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import least_reachable
from tessella.runtime import checkpointed

SHINGLE = 3
BUDGET = 2
SEED = 42
MOST_TOGETHER = 1 << 20  # fingerprints of one node that one task holds, 32 bytes each; larger nodes are split
_CHUNK = 1 << 15  # node pairs walked at a time; as many may wait at each of 64 levels
_LINKS = 1 << 20  # links held before they are cut to the edges of a forest
_BRUTE = 64  # products of node sizes from which a pair is compared directly
_HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    spans = zip([0, *ends], ends[shingle - 1 :])
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _HASHES):
        part = hashes[i : i + _HASHES].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(rows: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with the text replaced by its fingerprint, a signed long named ``fp``."""
    kept = [f for f in rows.schema.fields if f.name != text_col]
    ordered = rows.select(*(F.col(f.name) for f in kept), F.col(text_col))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            own = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.view(np.int64))], names=[*(f.name for f in kept), "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ordered.mapInArrow(made, f"{schema}, fp long")


# the trie


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where in sorted ``values`` each node [low, high) passes from bit 0 to bit 1 at ``depth``."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    return np.clip(np.searchsorted(values, (values[low] & above) | bit), low, high)


def linked_pairs(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of values of ``a`` and ``b`` (of ``a`` itself if None) within ``budget`` bits; some may come twice."""
    found = [(np.empty(0, np.uint64),) * 2, *walked_links(a, b, budget, starts)]
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    return left, right


def walked_links(a: np.ndarray, b: np.ndarray | None, budget: int, starts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs as they are found.

    Both arrays are sorted, unsigned, without repeats. With ``starts`` only pairs inside the nodes of
    ``a`` that start there are looked for. A frontier too long for one pass is cut in two and
    walked one half after the other.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    begin = np.array([0]) if starts is None else starts
    until = np.append(begin[1:], len(a))
    other = (begin, until) if own else (np.zeros(1, np.int64), np.array([len(b)]))
    todo = [(0, np.stack([begin, until, *other, np.zeros(len(begin), np.int64)], axis=1).astype(np.int64))]
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > _CHUNK:
            half = len(pairs) // 2
            todo += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= _BRUTE
        if depth == 64:
            small[:] = True
        for left, right in _compared(a, b, pairs[small], budget):
            if own:
                low, high = np.minimum(left, right), np.maximum(left, right)
                left, right = low[low < high], high[low < high]
            if len(left):
                yield left, right
        pairs = pairs[~small]
        if not len(pairs):
            continue
        al, ah, bl, bh, spent = pairs.T
        am, bm = _split(a, al, ah, depth), _split(b, bl, bh, depth)
        sides = [((al, am), (bl, bm), 0), ((am, ah), (bm, bh), 0), ((al, am), (bm, bh), 1), ((am, ah), (bl, bm), 1)]
        following = []
        for (x0, x1), (y0, y1), more in sides:
            go = (x1 > x0) & (y1 > y0) & (spent + more <= budget)
            if own:  # of two nodes only one order
                go &= x0 <= y0
            following.append(np.stack([x0, x1, y0, y1, spent + more], axis=1)[go])
        todo.append((depth + 1, np.concatenate(following)))


def forest(links: Iterator[tuple[np.ndarray, np.ndarray]], most: int = _LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join what the links join; never more than about ``most`` links are held."""
    held, number = [(np.empty(0, np.uint64),) * 2], 0
    for left, right in links:
        held.append((left, right))
        number += len(left)
        if number > most:
            held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            number = len(held[0][0])
            most = max(most, 2 * number)
    return stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _compared(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between the members of small nodes, by their differing bits."""
    if not len(pairs):
        return []
    wide = pairs[:, 3] - pairs[:, 2]
    each = (pairs[:, 1] - pairs[:, 0]) * wide
    row = np.repeat(np.arange(len(pairs)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    x, y = a[pairs[row, 0] + nth // wide[row]], b[pairs[row, 2] + nth % wide[row]]
    near = np.bitwise_count(x ^ y) <= budget
    return [(x[near], y[near])]


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, root) for each linked value but the roots; the root is the least value reachable."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label, new)  # the root hears of it too
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]
        label = new


# views: orders of the bits, so that near fingerprints come to share the uppermost ones


def _turned(low: np.ndarray, width: int, by: int) -> np.ndarray:
    """``low`` of ``width`` bits, turned left by ``by``."""
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    return low if not by else ((low << np.uint64(by)) | (low >> np.uint64(width - by))) & mask


def views(values: np.ndarray, depth: int, budget: int = BUDGET) -> list[tuple[np.ndarray, int]]:
    """The ``budget + 1`` views of values whose uppermost ``depth`` bits are settled, and their settled depths.

    The other bits fall into ``budget + 1`` blocks. Two values within the budget differ in at most
    ``budget`` blocks, so some view has a block on top that is equal in both.
    """
    rest = 64 - depth
    cuts = [rest * k // (budget + 1) for k in range(budget + 2)]
    mask = np.uint64((1 << rest) - 1) if rest < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    return [((values & ~mask) | _turned(values & mask, rest, cuts[k]), depth + cuts[k + 1] - cuts[k]) for k in range(budget + 1)]


def _viewed(budget: int):
    """(path, depth, value, fp) to its views; a view's path has one more digit."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, depth, value, fp = (c.to_numpy() for c in batch.columns)
            for d in np.unique(depth):
                at = depth == d
                for k, (turned, settled) in enumerate(views(value[at].view(np.uint64), int(d), budget)):
                    columns = (path[at] * (budget + 2) + k + 1, np.full(at.sum(), settled), turned.view(np.int64), fp[at])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "depth", "value", "fp"])

    return made


def _walked(budget: int):
    """Rows in order of (path, top, value) to star edges of the links among those that share path and top."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last group that may go on
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)  # path, top, value, fp
            if not len(rows):
                continue
            if held and (held[0][0, :2] == rows[-1, :2]).all():
                held.append(rows)  # all of one group
                continue
            last = len(rows) - 1 - int(np.argmax((rows[::-1, :2] != rows[-1, :2]).any(axis=1))) if (rows[:, :2] != rows[-1, :2]).any() else -1
            yield from _edges(np.concatenate([*held, rows[: last + 1]]), budget)
            held = [rows[last + 1 :]]
        if held:
            yield from _edges(np.concatenate(held), budget)

    return made


def _edges(rows: np.ndarray, budget: int) -> Iterator[pa.RecordBatch]:
    """Star edges among whole groups of rows (path, top, value, fp)."""
    if not len(rows):
        return
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    sizes = np.diff(np.append(first, len(rows)))
    rows = rows[np.repeat(sizes > 1, sizes)]
    for path in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == path]
        values, at = np.unique(own[:, 2].view(np.uint64), return_index=True)
        fps = own[at, 3].view(np.uint64)
        tops = own[at, 1]
        starts = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1])))
        u, v = forest(walked_links(values, None, budget, starts))
        u, v = fps[np.searchsorted(values, u)], fps[np.searchsorted(values, v)]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def linked(classes: DataFrame, budget: int = BUDGET, most: int = MOST_TOGETHER) -> DataFrame:
    """(u, v) star edges that join all linked fingerprints ``fp`` of ``classes``.

    Each fingerprint is copied ``budget + 1`` times, at any number of fingerprints. Only those below
    a node with more than ``most`` of them are copied so often again, by the blocks of their other
    bits, until no node has more; one with ``budget`` bits left has 2 ** ``budget`` fingerprints at most.
    """
    zero = F.lit(0).cast("long")
    now = classes.select(zero.alias("path"), zero.alias("depth"), F.col("fp").alias("value"), "fp")
    top = F.expr("shiftrightunsigned(value, cast(64 - depth AS int))")
    walked = _walked(budget)
    found = None
    while True:
        viewed = now.mapInArrow(_viewed(budget), "path long, depth long, value long, fp long").withColumn("top", F.when(F.col("depth") == 64, F.col("value")).otherwise(top))
        viewed = viewed.persist(StorageLevel.MEMORY_AND_DISK)  # until its edges are written; what a lost executor had is made again
        hot = viewed.where(f"64 - depth > {budget}").groupBy("path", "top").count().where(F.col("count") > most).select("path", "top")
        some = not hot.isEmpty()  # at most (budget + 1) * rows / most
        if some:
            hot = checkpointed(hot)
            now = checkpointed(viewed.join(hot, ["path", "top"], "left_semi").select("path", "depth", "value", "fp"))
        cool = viewed.join(hot, ["path", "top"], "left_anti") if some else viewed
        dealt = cool.select("path", "top", "value", "fp").repartition("path", "top").sortWithinPartitions("path", "top", "value")
        edges = checkpointed(dealt.mapInArrow(walked, "u long, v long").distinct())
        viewed.unpersist()
        found = edges if found is None else found.unionByName(edges)
        if not some:
            return found


def _grouped(narrow: DataFrame, budget: int) -> DataFrame:
    """``narrow`` (id, fp, ...) with ``root``: the same for all rows of a component."""
    classes = checkpointed(narrow.select("fp").distinct())
    roots = least_reachable(linked(classes, budget)).toDF("fp", "root")
    named = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return narrow.join(named, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component_id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    narrow = checkpointed(with_fingerprints(rows, "text", shingle))
    classes = narrow.groupBy("fp").agg(F.min("id").alias("least"))
    roots = least_reachable(linked(checkpointed(classes), budget)).toDF("fp", "root")
    named = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = narrow.join(named.join(least, "root").select("fp", "component_id"), "fp")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Rows that share that id are ordered by their text's hash; if the very row is repeated, one stays.
    """
    names = docs.columns
    fields = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_id, at_text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    rows = fields.select(at_id.alias("id"), F.xxhash64(at_text).alias("h"), at_text.alias("text"))
    narrow = checkpointed(with_fingerprints(rows, "text", shingle))
    grouped = _grouped(narrow, budget)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best"))
    best = checkpointed(best.select(F.col("best.id").alias("b_id"), F.col("best.h").alias("b_h")))
    kept = fields.join(best, at_id.eqNullSafe(F.col("b_id")) & (F.xxhash64(at_text) == F.col("b_h")), "left_semi")
    same = narrow["id"].eqNullSafe(best["b_id"]) & (narrow["h"] == best["b_h"])
    repeated = narrow.join(best, same, "left_semi").groupBy("id", "h").count().where("count > 1")
    if not repeated.isEmpty():
        key = [at_id, F.xxhash64(at_text)]
        turn = F.row_number().over(Window.partitionBy(*key).orderBy(*(c for c in (F.to_json(F.struct(f)) for f in fields.columns))))
        kept = kept.withColumn("turn", turn).where("turn = 1").drop("turn")
    return kept.toDF(*names)
