"""Quality rules and classifier, and toxicity, against direct versions and held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import quality_classifier, quality_rules, quality_signals, texts, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def direct_base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def base_of(texts_):
    own = quality_signals.signals(pa.array(texts_, pa.string()))
    return [tuple(map(int, x)) for x in zip(own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words, strict=True)]


PIECE = st.sampled_from(["a", "b", "é", "A", " ", "  ", "\n", "\t", "#", "a b c d e f g h ", "|", " ", "\x1c", "\r\n", "a b\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECE, max_size=40).map("".join)), max_size=5))
def test_counts(many):
    assert base_of(many) == [direct_base(t) for t in many]
    got = texts.tokens(pa.array(many, pa.string()), lower=True)
    words = got.words.to_pylist()
    assert [[words[c] for c in got.codes[a:b]] for a, b in zip(got.starts[:-1], got.starts[1:], strict=True)] == [
        [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(t or "")] for t in many
    ]


def test_windows_of_one_digest_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality_signals, "mixed", lambda x: np.zeros(len(x), np.uint64))
    many = ["a b c d e f g h i j a b c d e f g h", "a b c d e f g h", " ".join("abcdefghijklm")]
    assert base_of(many) == [direct_base(t) for t in many]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.9
    table = np.full((20_000, 5), quality_signals.ABSTAIN)
    for j, rate in enumerate((0.3, 0.4, 0.2, 0.5, 0.3)):
        table[:, j] = np.where(good, np.where(rng.random(20_000) < 0.002, 0, 2), np.where(rng.random(20_000) < rate, 0, 2))
    patterns, counts = np.unique(quality_signals.packed(table), return_counts=True)
    model = quality_signals.fit(quality_signals.unpacked(patterns, 5), counts.astype(float))
    assert abs(model.rates[0, 3, 0] - 0.5) < 0.1
    called = model.posterior(table) < 0.5
    assert (called & ~good).sum() / called.sum() > 0.9 and (called & ~good).sum() / (~good).sum() > 0.8


def test_a_rule_that_misfires_is_not_believed():
    """One of six rules calls 10 % of good texts bad, whatever else they are; the others are right."""
    rng = np.random.default_rng(6)
    good = rng.random(40_000) < 0.85
    table = np.full((40_000, 6), quality_signals.ABSTAIN)
    for j, rate in enumerate((0.3, 0.4, 0.3, 0.5, 0.4)):
        table[:, j] = np.where(good, np.where(rng.random(40_000) < 0.002, 0, 2), np.where(rng.random(40_000) < rate, 0, 2))
    table[:, 5] = np.where(rng.random(40_000) < 0.1, 0, 2)
    patterns, counts = np.unique(quality_signals.packed(table), return_counts=True)
    kinds = quality_signals.unpacked(patterns, 6)
    allowed = quality_signals.allowed_false(kinds, counts.astype(float))
    assert (allowed[:5] == quality_signals.MOST_FALSE).all() and 0.08 < allowed[5] < 0.12
    model = quality_signals.fit(kinds, counts.astype(float))
    assert abs(model.rates[1, 5, 0] - 0.1) < 0.02
    called = model.posterior(table) < 0.5
    assert (called & good).sum() < 0.02 * good.sum() and (called & ~good).sum() > 0.8 * (~good).sum()


def test_verdicts_equal_a_direct_reckoning(spark):
    """Votes, posterior and verdict of each text, one at a time in plain Python, from the fitted rates."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = quality_signals.votes(quality_signals.signals(pa.array(list(rows.values()), pa.string())))
    patterns, counts = np.unique(quality_signals.packed(every), return_counts=True)
    model = quality_signals.fit(quality_signals.unpacked(patterns, every.shape[1]), counts.astype(float))
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(docs).collect()}
    for (i, text), own in zip(rows.items(), every, strict=True):
        odds = model.prior / (1 - model.prior)
        for j, vote in enumerate(own):
            odds *= model.rates[1, j, vote] / model.rates[0, j, vote]
        n, _, _, _, repeated = direct_base(text)
        assert abs(got[i]["quality"] - odds / (1 + odds)) < 1e-6
        assert got[i]["kept"] == (n >= 20 and 100 * repeated <= 30 * n and odds / (1 + odds) >= 0.5)


def test_quality_rules(spark, awkward, no_docs):
    wide = awkward.withColumns({"id": F.lit("x"), "pattern": F.lit(1), "n_words": F.lit(3)})
    got = quality_rules.judge_quality(wide).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((r["doc_id"], *direct_base(r["text"])) for r in awkward.collect())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge_quality(no_docs).count() == 0


def accuracy(rows, truth):
    both = [(r, truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    return both


def test_quality_verdicts_agree_with_annotations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for judged, verdict in ((quality_rules.judge_quality(docs), "quality"), (quality_classifier.classify_quality(docs), "score")):
        both = accuracy(judged.collect(), truth)
        low = [(r[verdict] < 0.5, y == 0) for r, y in both]
        hit = sum(a and b for a, b in low)
        assert hit / max(sum(a for a, _ in low), 1) > 0.85 and hit / sum(b for _, b in low) > 0.8


def test_quality_classifier_cases(awkward, no_docs):
    wide = awkward.withColumns({"id": F.lit("x"), "pattern": F.lit(1), "score": F.lit(3)})
    got = quality_classifier.classify_quality(wide).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in awkward.collect())
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)
    assert quality_classifier.classify_quality(no_docs).count() == 0


def test_quality_scores_follow_the_weak_labels_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: (r["weak_label"], r["score"]) for r in quality_classifier.classify_quality(docs).collect()}
    two = {r["doc_id"]: (r["weak_label"], r["score"]) for r in quality_classifier.classify_quality(docs.repartition(7, "doc_id")).collect()}
    assert one.keys() == two.keys() and all(abs(a - b) < 1e-9 for i in one for a, b in zip(one[i], two[i], strict=True))
    same = sum((label < 0.5) == (score < 0.5) for label, score in one.values())
    assert same > 0.97 * len(one)


def test_a_hot_text_reaches_the_driver_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "" if i % 5 < 2 else f"The text number {i} has a few plain words, and ends. " * 9) for i in range(3000)], "doc_id long, text string").repartition(6)
    seen = []
    whole = quality_classifier._fitted
    monkeypatch.setattr(quality_classifier, "_fitted", lambda got, *a: seen.append(got.num_rows) or whole(got, *a))
    assert quality_classifier.classify_quality(docs, most_rows=100_000).count() == 3000
    assert seen == [1801]


def planted_votes(rng, n):
    """Votes of six voters on texts of which a tenth are toxic; the last two always say the same."""
    toxic = rng.random(n) < 0.1
    votes = np.full((n, 6), toxicity.ABSTAIN)
    for j, (hit, false) in enumerate([(0.7, 0.01), (0.5, 0.02), (0.8, 0.005), (0.3, 0.05), (0.4, 0.01)]):
        said = rng.random(n) < np.where(toxic, hit, false)
        votes[:, j] = np.where(said, toxicity.TOXIC, np.where(rng.random(n) < 0.6, toxicity.CLEAN, toxicity.ABSTAIN))
    votes[:, 5] = votes[:, 4]
    return votes, toxic


def test_label_model_finds_rates_and_correlations_from_votes_alone():
    votes, toxic = planted_votes(np.random.default_rng(4), 20_000)
    annotated = np.where(np.arange(20_000) < 300, toxic, -1)  # a few, for the start
    model = toxicity.fit_labels(votes, annotated)
    measured = toxicity.measured_rates(votes, toxic.astype(float))
    assert np.abs(model.rates - measured)[0, :4].max() < 0.15 and np.abs(model.rates - measured)[1, :4].max() < 0.02
    assert model.weights[4] < 0.75 and model.weights[5] < 0.75 and model.weights[:4].min() > 0.8
    called = model.posterior(votes) >= 0.5
    assert (called & toxic).sum() > 0.85 * toxic.sum() and (called & toxic).sum() > 0.9 * called.sum()
    flipped = toxicity.fit_labels(votes, np.where(np.arange(20_000) < 300, annotated, np.where(np.arange(20_000) < 320, 1, -1)))
    assert ((flipped.posterior(votes) >= 0.5) == called).mean() > 0.97  # twenty wrong annotations among some fifty toxic ones change little


def test_posterior_is_the_weighted_product_of_rates():
    rng = np.random.default_rng(9)
    votes, toxic = planted_votes(rng, 500)
    model = toxicity.fit_labels(votes, toxic.astype(int))
    for own, p in zip(votes[:50], model.posterior(votes[:50]), strict=True):
        odds = model.prior / (1 - model.prior)
        for j, v in enumerate(own):
            odds *= (model.rates[0, j, v] / model.rates[1, j, v]) ** model.weights[j]
        assert abs(p - odds / (1 + odds)) < 1e-9


def test_lexicons_are_by_kind_of_feature():
    words = toxicity._word_features(pa.array(["abcdefghij"]))[0]
    assert [int(w) & toxicity._KIND_BITS for w in words] == list(range(toxicity.KINDS))
    told = toxicity.Told(np.sort(words), np.linspace(0.5, 1, len(words)))
    lexicons = told.lexicons()
    assert sum(map(len, lexicons)) == len(words) and all(len({int(f) & toxicity._KIND_BITS for f in x}) <= 1 for x in lexicons)


def test_toxicity(spark, awkward, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(a and b for a, b in held)
    assert hit >= 0.6 * sum(b for _, b in held) and hit >= 0.8 * sum(a for a, _ in held)  # six toxic rows at this size; see the next test
    again = toxicity.score_toxicity(docs.repartition(5), labels).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in again) == sorted((r["doc_id"], round(r["score"], 9)) for r in rows)
    # labels of held-out rows make no difference
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.score_toxicity(docs, flipped).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in other) == sorted((r["doc_id"], round(r["score"], 9)) for r in rows)
    none = labels.limit(0)
    assert toxicity.score_toxicity(no_docs, none).count() == 0
    wide = awkward.withColumns({"id": F.lit("x"), "y": F.lit(1), "score": F.lit(3)})
    own = spark.createDataFrame([(1, None, 1), (2, 0, 0), (None, 1, 1), (3, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(wide, own).count() == awkward.count()
    kept = toxicity.drop_toxic(wide, none)
    assert kept.columns == wide.columns and kept.count() == awkward.count()
    insult = spark.createDataFrame([(1, "you worthless idiot", "en", "a", 3)], awkward.schema)
    assert toxicity.drop_toxic(insult, none).count() == 0


def test_toxicity_on_held_out_rows_of_the_larger_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert sum(r["toxic"] for r in rows) > 50
    # one in twelve toxic rows here has no word that any other has
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and hit >= 0.95 * sum(r["predicted"] for r in rows)
