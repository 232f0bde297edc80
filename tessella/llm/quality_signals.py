"""Measures of a text's quality and the votes that overlapping heuristics give on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.texts import Tokens, distinct_pairs, mixed, slices, sums, tokens

WINDOW = 8
BAD, ABSTAIN, GOOD = 0, 1, 2


def repeated_words(words: Tokens, window: int = WINDOW) -> np.ndarray:
    """Per text: words inside a window of ``window`` words that the text has twice or more."""
    n, codes = len(words.codes), words.codes
    if n < window:
        return np.zeros(len(words.starts) - 1, dtype=np.int64)
    owner = words.owner
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    spread, digest = mixed(codes), mixed(owner[at])
    for k in range(window):
        digest = (digest ^ spread[at + k]) * np.uint64(0x100000001B3) + np.uint64(k)
    order = np.argsort(digest, kind="stable")
    ranked = digest[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    x, y = at[order[same]], at[order[same + 1]]
    equal = owner[x] == owner[y]
    for k in range(window):
        equal &= codes[x + k] == codes[y + k]
    if equal.all():
        hit = np.unique(np.concatenate([x, y]))
    else:  # two windows share a digest: compare the windows themselves
        rows = np.column_stack([owner[at], *(codes[at + k] for k in range(window))])
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hit = at[count[inverse.ravel()] > 1]
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return sums((np.cumsum(step[:-1]) > 0).astype(np.int64), words.starts)


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that have a word, and those of them that equal an earlier line."""
    split = pc.split_pattern(texts, "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wordy = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.empty(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[wordy]
    lines = np.bincount(owner, minlength=len(texts))
    first, _ = distinct_pairs(owner, codes[wordy])
    return lines, lines - np.bincount(first, minlength=len(texts))


@dataclass
class Signals:
    """The measures of some texts, one array each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    shares: dict[str, np.ndarray]


def signals(texts: pa.Array) -> Signals:
    """Counts as the rules name them, and shares (0 to 1) that the heuristics look at."""
    whole = pc.fill_null(texts, "")
    words = tokens(whole)
    n = words.counts.astype(np.int64)
    some = np.maximum(n, 1)
    chars = pc.utf8_length(words.words).to_numpy(zero_copy_only=False).astype(np.int64)
    per = lambda flags: sums(flags[words.codes].astype(np.int64), words.starts)
    match = lambda pattern: pc.match_substring_regex(words.words, pattern).to_numpy(zero_copy_only=False).astype(bool)
    word_chars = per(chars)
    symbols = pc.count_substring_regex(whole, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    lines, dup_lines = repeated_lines(whole)
    owner, own = distinct_pairs(words.owner, words.codes)
    follows = np.zeros(len(words.codes), dtype=np.int64)
    if len(follows) > 1:
        follows[1:] = (words.codes[1:] == words.codes[:-1]) & (words.owner[1:] == words.owner[:-1])
    repeat = repeated_words(words)
    shares = {
        "symbols": symbols / np.maximum(word_chars, 1),
        "marked": per(match(r"[#*$%&|<>]{2,}$")) / some,
        "pipes": per(match(r"^\|+$")) / some,
        "shouted": per(match(r"!{2,}$")) / some,
        "capitals": per(match(r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$")) / some,
        "digits": per(match(r"[0-9]")) / some,
        "repeats": repeat / some,
        "echoes": sums(follows, words.starts) / some,
        "dup_lines": dup_lines / np.maximum(lines, 1),
        "variety": np.bincount(owner, minlength=len(n)) / some,
        "length": word_chars / some,
        "words": n.astype(np.float64),
        "ends": per(match(r"[.!?]$")) / some,
    }
    return Signals(n, word_chars, symbols, dup_lines, repeat, shares)


#: heuristic: measure, bad from, good to. A measure between the two abstains; ``-`` before a name turns it round.
HEURISTICS: dict[str, tuple[str, float, float]] = {
    "symbol_characters": ("symbols", 0.10, 0.01),
    "marked_words": ("marked", 0.20, 0.02),
    "table_bars": ("pipes", 0.10, 0.01),
    "shouting": ("shouted", 0.15, 0.02),
    "capital_words": ("capitals", 0.30, 0.06),
    "number_words": ("digits", 0.40, 0.10),
    "repeated_windows": ("repeats", 0.30, 0.05),
    "echoed_words": ("echoes", 0.15, 0.04),
    "repeated_lines": ("dup_lines", 0.40, 0.15),
    "poor_variety": ("-variety", -0.15, -0.35),
    "long_words": ("length", 14.0, 9.5),
    "short_words": ("-length", -2.2, -3.0),
    "few_words": ("-words", -1.0, -40.0),
    "no_sentences": ("-ends", -0.001, -0.02),
}


def votes(measured: Signals, heuristics: dict[str, tuple[str, float, float]] = HEURISTICS) -> np.ndarray:
    """(texts, heuristics) of BAD, ABSTAIN or GOOD. Texts without words get BAD only from few_words."""
    out = np.full((len(measured.n_words), len(heuristics)), ABSTAIN, dtype=np.int64)
    for j, (name, bad, good) in enumerate(heuristics.values()):
        value = -measured.shares[name[1:]] if name.startswith("-") else measured.shares[name]
        out[:, j] = np.where(value >= bad, BAD, np.where(value <= good, GOOD, ABSTAIN))
        if name != "-words":
            out[measured.n_words == 0, j] = ABSTAIN
    return out


def packed(table: np.ndarray) -> np.ndarray:
    """A row of votes as one number in base 3."""
    return table @ (3 ** np.arange(table.shape[1], dtype=np.int64))


def unpacked(patterns: np.ndarray, width: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(width, dtype=np.int64) % 3


@dataclass
class LabelModel:
    """Two classes, and for each voter how often it gives each vote in each class."""

    prior: float
    rates: np.ndarray  # (2 classes: bad, good; voters; 3 votes)

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """The probability of the good class for each row of votes."""
        voter = np.arange(table.shape[1])
        bad = np.log(self.rates[0, voter, table]).sum(axis=1) + np.log1p(-self.prior)
        good = np.log(self.rates[1, voter, table]).sum(axis=1) + np.log(self.prior)
        return 1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500)))


#: What a voter is held to do before any text is seen, and how many texts that counts as.
BEFORE = np.array([[0.25, 0.25, 0.50], [0.01, 0.14, 0.85]])
STRENGTH = 20.0
PRIOR = 0.85
#: The largest share of good texts that one heuristic may call bad, unless the texts speak against it.
MOST_FALSE = 0.005
#: Of texts that no other heuristic objects to, the largest share that one may object to and be believed.
LONE = 0.05


def allowed_false(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each voter the share of good texts that it may call bad.

    ``MOST_FALSE`` for those whose lone objections are rare. A voter that alone objects to more than
    ``LONE`` of the texts that all others let pass may be wrong about all of them.
    """
    bad = table == BAD
    calm = (bad.sum(axis=1)[:, None] - bad == 0) * counts[:, None]
    lone = (bad * calm).sum(axis=0) / np.maximum(calm.sum(axis=0), 1)
    return np.where(lone > LONE, lone, MOST_FALSE)


def fit(table: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over different rows of votes with their counts."""
    width = table.shape[1]
    model = LabelModel(PRIOR, np.repeat(BEFORE[:, None, :], width, axis=1))
    onehot = (table[:, :, None] == np.arange(3)).astype(np.float64)
    most_false = allowed_false(table, counts)
    for _ in range(rounds):
        good = model.posterior(table)
        own = np.stack([counts * (1 - good), counts * good])
        rates = np.einsum("cp,pjv->cjv", own, onehot) + STRENGTH * BEFORE[:, None, :]
        rates /= rates.sum(axis=2, keepdims=True)
        # without this, the two classes may part texts by whatever else sets them apart: the good
        # class holds no voter that calls more than a few of its texts bad, and none is worse than chance
        rates[1, :, BAD] = np.minimum(rates[1, :, BAD], most_false)
        rates[0, :, BAD] = np.maximum(rates[0, :, BAD], rates[1, :, BAD])
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (own[1].sum() + STRENGTH * PRIOR) / (counts.sum() + STRENGTH)
        done = abs(prior - model.prior) < 1e-10 and np.abs(rates - model.rates).max() < 1e-9
        model = LabelModel(float(prior), rates)
        if done:
            break
    return model


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, the five counts, pattern): one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = signals(part.column(1))
                columns = (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words, packed(votes(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in columns)], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(made, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def posteriors(patterns: DataFrame) -> DataFrame:
    """(pattern, posterior, weak): the fitted model's view of each different row of votes.

    ``patterns`` has a column ``pattern``. At most 3 ** heuristics rows reach the driver, in
    practice some hundreds, whatever the number of texts; counts cover all of them.
    """
    spark = patterns.sparkSession
    found = patterns.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    table = unpacked(found["pattern"].to_numpy(dtype=np.int64), len(HEURISTICS))
    if not len(found):
        return spark.createDataFrame([], "pattern long, posterior double")
    model = fit(table, found["n"].to_numpy(dtype=np.float64))
    found["posterior"] = model.posterior(table)
    return spark.createDataFrame(list(zip(found["pattern"].astype(int).tolist(), found["posterior"].tolist(), strict=True)), "pattern long, posterior double")
