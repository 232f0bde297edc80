"""A quality classifier trained on weak labels.

Overlapping heuristic labellers vote on every text. Expectation-maximisation over the counts of
all different rows of votes estimates their accuracies, and the posterior labels of a bounded
sample, about ``most_rows`` different texts chosen by their hash, train a hashed linear scorer that
then judges every text by itself: by its words, the shapes of its words and lines, and how much it
repeats. No annotation is used.

Defined cases: a null text counts as empty; a text without words has only the features of an
empty text; repeated rows are judged one by one and equal texts alike, so ties need no rule; an
empty table gives an empty result; further columns are ignored, whatever their names; texts are read
whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import linear
from tessella.llm.quality_signals import packed, posteriors, signals, votes
from tessella.llm.texts import digests, distinct_pairs, slices, tokens
from tessella.runtime import checkpointed

MOST_ROWS = 8_000
LEAST_QUALITY = 0.5
_LEVELS = 16


def _shapes(words: pa.Array) -> pa.Array:
    """Words with runs of small letters, capitals and digits as one sign each."""
    small = pc.replace_substring_regex(words, r"\p{Ll}+", "a")
    capital = pc.replace_substring_regex(small, r"\p{Lu}+", "A")
    return pc.replace_substring_regex(capital, r"\p{N}+", "0")


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature) of each text's different features, and each text's pattern of votes."""
    whole = pc.fill_null(texts, "")
    words = tokens(whole)
    own = signals(whole)
    columns = [digests(pc.ascii_lower(words.words).to_pylist(), 21), digests(_shapes(words.words).to_pylist(), 22)]
    by_word = np.stack(columns, axis=1)
    owner, code = distinct_pairs(words.owner, words.codes)
    parts = [(np.repeat(owner, 2), by_word[code].ravel())]
    for k, (name, share) in enumerate(own.shares.items()):
        scale = np.log1p(share) if name in ("words", "length") else np.sqrt(np.clip(share, 0, 1)) * 4
        level = np.minimum((scale * 4).astype(np.int64), _LEVELS * 2)
        parts.append((np.arange(len(whole)), digests([f"{k}={x}" for x in level], 23)))
    every = np.concatenate([f for _, f in parts]) & np.uint64(linear.DIMENSIONS - 1)
    owners, features = distinct_pairs(np.concatenate([o for o, _ in parts]), every.astype(np.int64))
    return owners, features, packed(votes(own))


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, least: float = LEAST_QUALITY) -> DataFrame:
    """One row per row of ``docs``: its id, the labellers' posterior ``weak_label``, score and kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(packed(votes(signals(part.column(0)))))], names=["pattern"])

    patterns = checkpointed(rows.select("text").mapInArrow(voted, "pattern long"))
    weak = posteriors(patterns)
    known = {r["pattern"]: r["posterior"] for r in weak.collect()}  # at most 3 ** labellers, some hundreds in practice
    number = patterns.count()
    steps = 1 << 30
    share = min(1.0, most_rows / max(number, 1))
    # copies of a text share its hash, so a hot text could fill the sample: each text counts once, and meets its copies where they are
    sample = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(steps)) < int(steps * share)).distinct()
    sorted_patterns = np.array(sorted(known), dtype=np.int64)
    sorted_posteriors = np.array([known[p] for p in sorted(known)])

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                owner, features, pattern = features_of(part.column(0))
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(features.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(pattern)], names=["features", "pattern"])

    got = sample.mapInArrow(prepared, "features array<int>, pattern long").toArrow()
    telling, model = _fitted(got, sorted_patterns, sorted_posteriors)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, features, pattern = features_of(part.column(1))
                hit, at = linear.chosen(features, telling)
                score = model.scores(owner[hit], at, part.num_rows)
                label = sorted_posteriors[np.searchsorted(sorted_patterns, pattern)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(score)], names=["id", "weak_label", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scored, f"id {kind}, weak_label double, score double")
    return found.select(F.col("id").alias(id_col), "weak_label", "score", (F.col("score") >= least).alias("kept"))


def _fitted(got: pa.Table, patterns: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, linear.Linear]:
    """Telling features and the scorer over them, from the sample's features and patterns."""
    lists = got["features"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    label = posterior[np.searchsorted(patterns, got["pattern"].to_numpy())] if got.num_rows else np.empty(0)
    # texts come in any order: by their features, and texts alike in all of them once
    once = {flat[a:b].tobytes(): (flat[a:b], y) for a, b, y in zip(bounds[:-1], bounds[1:], label, strict=True)}
    rows = [once[k][0] for k in sorted(once)]
    targets = np.array([once[k][1] for k in sorted(once)])
    telling = linear.telling(rows, targets, least_z=4.0, two_sided=True)
    return telling, linear.fit(linear.restricted(rows, telling), targets, np.zeros(len(telling)), epochs=10)
