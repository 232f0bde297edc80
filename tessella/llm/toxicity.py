"""Toxicity by weak supervision.

Many voters look at a text: lexicons told from labelled rows, one for each kind of feature (whole
words, and word beginnings of each length) and tier of evidence; fixed lexicons of insults by
theme and language; and patterns. A voter votes toxic or clean, or abstains. A generative label
model with two classes estimates by expectation-maximisation how often each voter gives each vote
in each class, and the correlations of the voters within the classes; voters that say the same
share their weight. The model sees votes only: annotations give its starting rates and a prior of
``STRENGTH`` rows, no more. Its posterior probabilities train a linear classifier over hashed words
and word beginnings, and that classifier scores every text.

The fit takes a bounded sample of labelled rows, at most about ``most_labelled``, chosen by a hash
of the id; all rows are scored, whole. Nothing but the text is an input of a score.

Defined cases: a null text counts as empty, and empty texts get the score of a text that has no
telling word; a null id is never held out and never labelled; labels that repeat an id count as
toxic if one is; without labels the fixed lexicons alone decide; repeated rows are scored one by
one and equal texts alike, so ties need no rule; a text is read whole, whatever its length; empty
tables work; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import linear
from tessella.llm.texts import digests, distinct_pairs, slices, tokens
from tessella.runtime import checkpointed

BEGINNINGS = (4, 5, 6, 7, 8)
MOST_LABELLED = 16_000
LEAST_Z = 5.0
FOLDS, HELD_OUT = 5, 0
TOXIC, ABSTAIN, CLEAN = 0, 1, 2
KINDS = 1 + len(BEGINNINGS)  # of features; the lowest bits of a feature's number tell its kind
_KIND_BITS = 7
TIERS = (0.95, 0.8, 0.0)  # least shares of toxic rows among a lexicon's features' rows
LEXICONS = len(TIERS) * KINDS
STRENGTH = 0.05  # of the rows: what the starting rates of a voter count as
_SMOOTHING = 2.0
FEEBLE = 0.3
FIXED_WEIGHT = 4.0
SLICE_BYTES = 2 << 20  # of text in hand at a time
SHORT = 20  # words below which finding nothing says nothing

# Lexicons of insults.
INSULTS = {
    "wits": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "clown", "brainless"),
    "contempt": ("loser", "losers", "worthless", "pathetic", "trash", "garbage", "scum", "vermin", "filth", "useless"),
    "disgust": ("disgusting", "vile", "repulsive", "revolting", "nasty", "hideous"),
    "german": ("idioten", "dummkopf", "trottel", "abschaum", "arschloch", "widerlich"),
    "french": ("imbécile", "connard", "salaud", "ordure", "crétin", "débile"),
    "spanish": ("idiota", "estúpido", "imbécil", "basura", "escoria", "asqueroso"),
}
PATTERNS = (r"^[a-z]\*{2,}[a-z]+", r"^[a-z]*[@$!][a-z]*t[a-z]*$", r"^[a-z]+[0-9@$]+[a-z]+$", r"[!?]{3,}$")
_TRIMMED = ".,!?;:#*$%&|\"'()"


@dataclass
class Found:
    """Telling features and other signs of some texts."""

    owner: np.ndarray
    features: np.ndarray  # distinct per owner
    patterns: np.ndarray  # (texts, patterns) whether a word fits


def _word_features(words: pa.Array) -> np.ndarray:
    """(words, 1 + beginnings): the number of each word and of its beginnings."""
    plain = pc.utf8_trim(words, _TRIMMED)
    columns = [digests(plain.to_pylist(), 1)]
    columns += [digests(pc.utf8_slice_codeunits(plain, 0, k).to_pylist(), 10 + k) for k in BEGINNINGS]
    numbers = np.stack(columns, axis=1) & np.uint64(linear.DIMENSIONS - 1 - _KIND_BITS)
    return (numbers | np.arange(KINDS, dtype=np.uint64)).astype(np.int64)


def found_in(texts: pa.Array, only: np.ndarray | None = None) -> Found:
    """The distinct features of each text, all of them or those in sorted ``only``."""
    words = tokens(texts, lower=True)
    fits = np.stack([pc.match_substring_regex(words.words, p).to_numpy(zero_copy_only=False).astype(bool) for p in PATTERNS], axis=1)
    by_word = _word_features(words.words)
    owner, code = distinct_pairs(words.owner, words.codes)
    patterns = np.zeros((len(texts), len(PATTERNS)), dtype=bool)
    np.logical_or.at(patterns, owner, fits[code])
    word = np.repeat(np.arange(len(by_word)), by_word.shape[1])
    flat = by_word.ravel()
    if only is not None:
        hit, at = linear.chosen(flat, only)
        word, flat = word[hit], at
    # the words' features, in order of words, laid out for each (text, word)
    starts = np.searchsorted(word, np.arange(len(by_word) + 1))
    each = (starts[1:] - starts[:-1])[code]
    row = np.repeat(np.arange(len(code)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    own, features = distinct_pairs(owner[row], flat[starts[code[row]] + nth])
    return Found(own, features, patterns)


def fixed_features() -> list[np.ndarray]:
    """The features of each fixed lexicon: whole words only."""
    return [np.unique(_word_features(pa.array(words))[:, 0]) for words in INSULTS.values()]


@dataclass
class Told:
    """Features told from labelled rows, in order, and the share of toxic rows among those that have each."""

    features: np.ndarray
    shares: np.ndarray

    def lexicons(self) -> list[np.ndarray]:
        """The features by tier and kind."""
        kind, tier = self.features & _KIND_BITS, np.searchsorted(-np.array(TIERS), -self.shares)
        return [self.features[(kind == k) & (tier == t)] for t in range(len(TIERS)) for k in range(KINDS)]


def voted(rows: list[np.ndarray], patterns: np.ndarray, long: np.ndarray, told: Told) -> np.ndarray:
    """(texts, voters): the votes of told lexicons, fixed lexicons and patterns; ``long`` texts may vote clean."""
    lexicons = [*told.lexicons(), *fixed_features()]
    out = np.full((len(rows), len(lexicons) + len(PATTERNS)), ABSTAIN, dtype=np.int64)
    for k, lexicon in enumerate(lexicons[:LEXICONS]):
        out[long, k] = CLEAN if len(lexicon) else ABSTAIN
    for i, own in enumerate(rows):
        for k, lexicon in enumerate(lexicons):
            if linear.chosen(own, lexicon)[0].any():
                out[i, k] = TOXIC
    out[:, len(lexicons) :][patterns] = TOXIC
    return out


@dataclass
class LabelModel:
    """Rates of each vote by class (toxic, clean), and the weight that correlation leaves a voter."""

    prior: float
    rates: np.ndarray  # (2, voters, 3)
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        voter = np.arange(votes.shape[1])
        ratio = np.log(self.rates[0, voter, votes]) - np.log(self.rates[1, voter, votes])
        return linear.sigmoid(np.log(self.prior / (1 - self.prior)) + ratio @ self.weights)


_BEFORE = np.array([[0.30, 0.40, 0.30], [0.02, 0.40, 0.58]])


def measured_rates(votes: np.ndarray, toxic: np.ndarray, weight: float = 0.0, before: np.ndarray | None = None) -> np.ndarray:
    """(2, voters, 3): how often each voter gives each vote among rows of each class, ``toxic`` being their probabilities."""
    onehot = (votes[:, :, None] == np.arange(3)).astype(np.float64)
    rates = np.einsum("cn,njv->cjv", np.stack([toxic, 1 - toxic]), onehot) + (0 if before is None else weight * before)
    return rates / np.maximum(rates.sum(axis=2, keepdims=True), 1e-300)


def shared_weights(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The weight of each voter: within a class voters should not agree beyond chance; those that do share theirs.

    Correlations up to ``FEEBLE`` say nothing: many voters would each lose a little to all others.
    """
    said = (votes == TOXIC).astype(np.float64)
    excess = np.zeros((votes.shape[1],) * 2)
    for weight in (toxic, 1 - toxic):
        size = max(weight.sum(), 1e-9)
        apart = said - weight @ said / size
        covariance = (apart * weight[:, None]).T @ apart / size
        deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        excess += np.maximum(covariance / np.outer(deviation, deviation) - FEEBLE, 0) / (1 - FEEBLE) / 2
    np.fill_diagonal(excess, 0)
    return 1 / (1 + excess.sum(axis=1))


def fit_labels(votes: np.ndarray, annotated: np.ndarray, rounds: int = 30) -> LabelModel:
    """The label model of ``votes``; the annotations (1 toxic, 0 clean, -1 none) give the start and a weak prior."""
    known = annotated >= 0
    before = measured_rates(votes[known], (annotated[known] == 1).astype(np.float64), _SMOOTHING, np.broadcast_to(_BEFORE[:, None, :] + 1e-6, (2, votes.shape[1], 3)))
    share = float(np.clip((annotated == 1).sum() / max(known.sum(), 1), 0.01, 0.5))
    model = LabelModel(share, before, np.ones(votes.shape[1]))
    for _ in range(rounds):
        toxic = model.posterior(votes)
        rates = measured_rates(votes, toxic, STRENGTH * len(votes), before)
        rates[1, :, TOXIC] = np.minimum(rates[1, :, TOXIC], rates[0, :, TOXIC])  # no voter for toxic speaks against it
        model = LabelModel(float(np.clip(toxic.mean(), 0.005, 0.5)), rates, shared_weights(votes, toxic))
    return model


@dataclass
class Scorer:
    """Telling features, in order, and the linear model over their positions."""

    features: np.ndarray
    model: linear.Linear

    def scores(self, texts: pa.Array) -> np.ndarray:
        own = found_in(texts, self.features)
        return self.model.scores(own.owner, own.features, len(texts))


def fit_scorer(told: Told, rows: list[np.ndarray], patterns: np.ndarray, long: np.ndarray, annotated: np.ndarray) -> Scorer:
    """From telling features and the labelled texts that have them: label model and classifier."""
    fixed = np.unique(np.concatenate(fixed_features()))
    features = np.union1d(told.features, fixed)
    start = np.where(np.isin(features, fixed), FIXED_WEIGHT, 0.0)  # it stays where no labelled row has the word
    if not len(rows):
        return Scorer(features, linear.Linear(start, -FIXED_WEIGHT / 2))
    votes = voted(rows, patterns, long, told)
    targets = fit_labels(votes, annotated).posterior(votes)
    return Scorer(features, linear.fit(linear.restricted(rows, features), targets, start, epochs=20))


def held_out(id_column: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_labelled: int) -> Scorer:
    """The scorer of a bounded sample of the labelled rows of ``docs`` that are not held out."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    n = usable.count()
    steps = 1 << 30
    if n > most_labelled:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < int(steps * most_labelled / n))
    # about most_labelled rows of 12 bytes at most
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(usable), "id").select("y", "text")

    told = telling_features(rows)
    features = np.union1d(told.features, np.unique(np.concatenate(fixed_features())))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                own = found_in(part.column(1), features)
                bounds = np.searchsorted(own.owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(features[own.features]))
                pattern = own.patterns @ (1 << np.arange(len(PATTERNS)))
                long = tokens(part.column(1)).counts >= SHORT
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(pattern.astype(np.int32)), pa.array(long)], names=["y", "features", "pattern", "long"])

    got = rows.mapInArrow(made, "y int, features array<long>, pattern int, long boolean").toArrow()
    lists = got["features"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    y, long = got["y"].to_numpy(), got["long"].to_numpy().astype(bool)
    order = np.lexsort([y, long, [len(r) for r in own], [int(r.sum()) for r in own]]) if own else np.empty(0, int)  # the rows come in any order
    pattern = got["pattern"].to_numpy()[:, None] >> np.arange(len(PATTERNS)) & 1
    return fit_scorer(told, [own[i] for i in order], pattern[order].astype(bool), long[order], y[order])


def telling_features(rows: DataFrame, least_z: float = LEAST_Z, least_rows: int = 3) -> Told:
    """Features whose share of toxic rows is far above the mean, of (y, text); counted where the rows are.

    Tasks send (feature, rows, toxic rows); only features that pass come to the driver, some of
    those of a bounded number of rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                own = found_in(part.column(1))
                y = part.column(0).to_numpy() == 1
                features, at = np.unique(own.features, return_inverse=True)
                total = np.bincount(at, minlength=len(features)).astype(np.int64)
                toxic = np.bincount(at, weights=y[own.owner], minlength=len(features)).astype(np.int64)
                every = [np.append(x, e) for x, e in ((features, -1), (total, len(y)), (toxic, int(y.sum())))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in every], names=["feature", "total", "toxic"])

    counts = checkpointed(rows.mapInArrow(counted, "feature long, total long, toxic long").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("toxic").alias("toxic")).where(f"toxic >= {least_rows} OR feature < 0"))
    every = counts.where("feature < 0").first()
    if every is None or not 0 < every["toxic"] < every["total"]:
        return Told(np.empty(0, dtype=np.int64), np.empty(0))
    share = every["toxic"] / every["total"]
    z = (F.col("toxic") - F.col("total") * share) / F.sqrt(F.col("total") * share * (1 - share))
    found = counts.where("feature >= 0").withColumn("z", z).where(F.col("z") > least_z).select("feature", (F.col("toxic") / F.col("total")).alias("share")).toArrow().sort_by("feature")
    return Told(found["feature"].to_numpy().astype(np.int64), found["share"].to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, score and predicted."""
    return scored_with(docs, fit_from(docs, labels, id_col, text_col, label_col, most_labelled), id_col, text_col)


def scored_with(docs: DataFrame, scorer: Scorer, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scoring(scorer, [0, 2]), f"id {kind}, held_out boolean, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``docs`` without the rows that the classifier finds toxic, in their own columns."""
    scorer = fit_from(docs, labels, id_col, text_col, label_col, most_labelled)
    names = docs.columns
    fields = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_text = f"c{names.index(text_col)}"
    score = F.arrow_udf(_score_only(scorer), "double")  # rows stay where they are: only texts go to the workers, only scores come back
    scored = fields.withColumn("score", score(F.coalesce(F.col(at_text), F.lit(""))))
    return scored.where("score < 0.5").select(*(F.col(c).alias(n) for c, n in zip(fields.columns, names, strict=True)))


def _score_only(scorer: Scorer):
    """Batches of texts to their scores."""

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [scorer.scores(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, SLICE_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return made


def _scoring(scorer: Scorer, keep: list[int]):
    """Batches whose second column is the text, to the columns ``keep`` and the score."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                names = [part.schema.names[i] for i in keep]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(scorer.scores(part.column(1)))], names=[*names, "score"])

    return made
