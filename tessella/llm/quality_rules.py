"""Quality rules by weak supervision.

Each rule votes good or bad on a text, or abstains. Expectation-maximisation over all texts
estimates how far each rule's votes can be trusted, and the posterior probability of quality
decides where other filters ask that all rules pass. Two plain limits stay as they are: too few
words, and too many words in repeated windows (``base_failed``).

Defined cases: a null text counts as empty and fails the base limits; rows are judged one by one,
repeated or not; an empty table gives an empty result; further columns are ignored, whatever their
names; texts are measured whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.quality_signals import measured, posteriors
from tessella.runtime import checkpointed

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
LEAST_QUALITY = 0.5


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_QUALITY) -> DataFrame:
    """One row per row of ``docs``: its id, the counts, base_failed, kept, and the posterior ``quality``."""
    rows = checkpointed(measured(docs, id_col, text_col))
    judged = rows.join(posteriors(rows), "pattern")  # a local table of known size: the planner broadcasts it if it is small
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= least)).alias("kept"), F.col("posterior").alias("quality"),
    )
