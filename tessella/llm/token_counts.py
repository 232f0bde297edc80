"""Exact token counts of whole texts, huge ones included.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are spliced in their
overlap at a common boundary that is proven stable: both have a token boundary there, and the
place stands between a visible character and white space, which no pre-token of a byte-level BPE
spans. Where an overlap has no such place, it is widened until it has one or covers the text.
Ordinary texts are encoded by stable segments (white space with the word after it), each
different segment of a batch once.

Defined cases: a null text is empty and has no tokens; strings of special tokens inside a text
count as the library takes them by default; rows are counted one by one, repeated or not; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CHUNK = 32_768
OVERLAP = 512
HUGE = 65_536  # UTF-8 bytes from which a text is encoded in chunks
LIMIT = 512
_SLICE_BYTES = 4 << 20
_MOST_KNOWN = 300_000


def stable_boundary(text: str, at: int) -> bool:
    """Whether every pre-tokenisation has a boundary before ``text[at]``: visible, then white."""
    return 0 < at < len(text) and text[at] in " \n\t\r" and not text[at - 1].isspace() and text[at - 1].isprintable()


def spliced_ids(text: str, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The token ids of ``text`` from overlapping chunks, equal to those of the whole."""
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than its chunk")
    ids: list[int] = []
    start, end = 0, min(chunk, len(text))  # of the chunk in hand
    now, starts = _encoded(text, tokenizer, start, end)
    done = 0  # tokens of the chunk in hand that the previous chunk has given
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            until = min(len(text), begin + max(chunk, 2 * width))
            after, after_starts = _encoded(text, tokenizer, begin, until)
            least = starts[done] if done < len(starts) else start
            common = {x for x in after_starts if x > begin or begin == 0}.intersection(starts)
            cut = next((x for x in sorted(common, reverse=True) if least <= x < end and stable_boundary(text, x)), None)
            if cut is not None or until == len(text) and begin == start:
                break
            width *= 2
        if cut is None:  # the overlap has grown over all that is left
            now, starts, done, end = after, after_starts, bisect_left(after_starts, least), until
            continue
        ids += now[done : bisect_left(starts, cut)]
        now, starts, start, end = after, after_starts, begin, until
        done = bisect_left(starts, cut)
    return ids + now[done:]


def _encoded(text: str, tokenizer: Tokenizer, begin: int, end: int) -> tuple[list[int], list[int]]:
    got = tokenizer.encode(text[begin:end], add_special_tokens=False)
    return got.ids, [begin + a for a, _ in got.offsets]


class SegmentCounter:
    """Counts of tokens by stable segments, each different segment encoded once."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.known = tokenizer, {}

    def count(self, texts: pa.StringArray) -> np.ndarray:
        """The number of tokens of each text; no nulls."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not size:
            return np.zeros(len(texts), dtype=np.int64)
        data = texts.buffers()[2].slice(base, size)
        at = offsets - base
        starts = self._starts(np.frombuffer(data, dtype=np.uint8), at)
        bounds = np.append(starts, size).astype(np.int32)
        segments = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), data).dictionary_encode()
        each = self._encode(segments.dictionary.to_pylist())[segments.indices.to_numpy()]
        total = np.concatenate(([0], np.cumsum(each)))
        return np.diff(total[np.searchsorted(starts, at)])

    @staticmethod
    def _starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where segments start: with each text, and with white space after a visible character.

        Of characters beyond ASCII only U+00C0 to U+00FF (first byte C3) count as visible here;
        others, some of which are white space, just make a longer segment.
        """
        first = np.zeros(len(data), dtype=bool)
        visible = (data > 0x20) & (data < 0x7F)
        visible[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        first[1:] = visible[:-1] & ((data[1:] == 0x20) | (data[1:] == 0x0A))
        first[at[at < len(data)]] = True
        return np.flatnonzero(first)

    def _encode(self, segments: list[str]) -> np.ndarray:
        if len(self.known) > _MOST_KNOWN:
            self.known = {}
        if new := [s for s in segments if s not in self.known]:
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.known.update(zip(new, map(len, got), strict=True))
        return np.fromiter((self.known[s] for s in segments), dtype=np.int64, count=len(segments))


def token_counts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_tokens and over_limit.

    ``tokenizer_json`` is the tokenizer's definition, sent to the workers as text, so they need no
    file of their own.
    """
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary, a few MB

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(sent.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        segments = SegmentCounter(tokenizer)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1)
                sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
                long = sizes >= huge
                tokens = np.zeros(len(texts), dtype=np.int64)
                tokens[~long] = segments.count(texts.filter(pa.array(~long)))
                for i in np.flatnonzero(long):
                    tokens[i] = len(spliced_ids(texts[int(i)].as_py(), tokenizer, chunk, overlap))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = whole.schema["id"].dataType.simpleString()
    return whole.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a few MB, so that memory doesn't follow the length of the batch's texts."""
    texts = batch.column(1)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + _SLICE_BYTES, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
