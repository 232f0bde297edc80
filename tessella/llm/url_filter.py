"""URL rules by a sorted digest array.

Every rule (host and path prefix) is one 64-bit xxhash key in a sorted array with the rule's full
string beside it, all in one file that each worker maps into memory; a second sorted array has the
rules' hosts with the lengths of path that occur under each. A batch of URLs looks up its host
suffixes, by one binary search for the whole batch, and asks for those that have rules with their
own path lengths by another; the stored strings then tell collisions from hits. The file travels
with ``SparkContext.addFile``, so memory and network per worker follow the rules and not the pages.

Defined cases: a null URL, or one without ``://``, has empty host and path and no rule; no rule
fits gives the default verdict; of rules given twice the last counts, and no two rules of equal
length fit one URL; repeated rows are judged one by one; a URL is read whole, whatever its length;
an empty rule list and an empty table work; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import string
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"
_MAGIC = 0x54455355


def _digests(strings: Sequence[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(a) for a in strings), dtype=np.uint64, count=len(strings))


class RuleIndex:
    """The mapped file: counts; keys in order, offsets and verdicts; hosts in order with their path lengths; strings."""

    def __init__(self, path: str):
        self.path = path
        head = np.fromfile(path, dtype="<u8", count=5)
        if int(head[0]) != _MAGIC:
            raise ValueError(f"{path} is not a rule index")
        n, hosts, lengths, blob = (int(x) for x in head[1:])
        at = 40

        def mapped(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(dtype).itemsize * count
            part = np.memmap(path, dtype=dtype, mode="r", offset=at, shape=(count,)) if count else np.empty(0, dtype)
            at += size
            return part

        self.keys, self.starts = mapped("<u8", n), mapped("<u8", n + 1)
        self.hosts, self.host_starts, self.path_lengths = mapped("<u8", hosts), mapped("<u8", hosts + 1), mapped("<u8", lengths)
        self.blocks, self.blob = mapped("u1", n), mapped("u1", blob)

    def rule(self, i: int) -> str:
        return bytes(self.blob[int(self.starts[i]) : int(self.starts[i + 1])]).decode()

    def find(self, asked: Sequence[str]) -> np.ndarray:
        """For each string the index of the equal rule, or -1."""
        found = np.full(len(asked), -1, dtype=np.int64)
        if not len(self.keys) or not len(asked):
            return found
        digests = _digests(asked)
        first = np.searchsorted(self.keys, digests, side="left")
        last = np.searchsorted(self.keys, digests, side="right")
        for i in np.flatnonzero(last > first):
            found[i] = next((j for j in range(first[i], last[i]) if self.rule(j) == asked[i]), -1)
        return found

    def lengths_under(self, hosts: Sequence[str]) -> dict[str, list[int]]:
        """For those of ``hosts`` that rules name (or share a digest with such): the lengths of the rules' paths."""
        if not len(self.hosts) or not len(hosts):
            return {}
        digests = _digests(hosts)
        at = np.minimum(np.searchsorted(self.hosts, digests), len(self.hosts) - 1)
        return {hosts[i]: self.path_lengths[int(self.host_starts[at[i]]) : int(self.host_starts[at[i] + 1])].tolist() for i in np.flatnonzero(self.hosts[at] == digests)}

    def longest(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """For each URL the index of the longest rule that fits its host and path, or -1."""
        suffixes: dict[str, list[str]] = {}
        for host in hosts:
            if host and host not in suffixes:
                labels = host.split(".")
                suffixes[host] = [".".join(labels[i:]) for i in range(len(labels))]
        ruled = self.lengths_under(sorted({s for own in suffixes.values() for s in own}))
        under = {host: [(s, ruled[s]) for s in own if s in ruled] for host, own in suffixes.items()}
        asked: dict[str, int] = {}
        wanted: list[list[int]] = []
        for host, path in zip(hosts, paths, strict=True):
            own = [s + path[:n] for s, lengths in under.get(host, ()) for n in lengths if n <= len(path)]
            wanted.append([asked.setdefault(x, len(asked)) for x in own])
        strings = list(asked)
        found = self.find(strings)
        best = np.full(len(wanted), -1, dtype=np.int64)
        for i, own in enumerate(wanted):
            hits = [j for j in own if found[j] >= 0]
            if hits:
                best[i] = found[max(hits, key=lambda j: len(strings[j]))]
        return best


def write_index(rules: Iterable[tuple[str, str]], folder: str) -> str:
    """The index file of (verdict, rule) pairs; a rule is a host and a path such as ``net/de/``."""
    verdicts = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        verdicts[rule] = verdict
    ordered = sorted(verdicts, key=lambda r: (xxhash.xxh64_intdigest(r), r))
    blobs = [r.encode() for r in ordered]
    under: dict[int, set[int]] = defaultdict(set)
    for r in ordered:
        host = r.split("/", 1)[0]
        under[xxhash.xxh64_intdigest(host)].add(len(r) - len(host))
    lengths = [sorted(under[h]) for h in sorted(under)]
    parts = [
        np.array([_MAGIC, len(ordered), len(under), sum(map(len, lengths)), sum(map(len, blobs))], dtype="<u8"),
        _digests(ordered).astype("<u8"),
        np.cumsum([0, *map(len, blobs)]).astype("<u8"),
        np.array(sorted(under), dtype="<u8"),
        np.cumsum([0, *map(len, lengths)]).astype("<u8"),
        np.array([n for own in lengths for n in own], dtype="<u8"),
        np.array([verdicts[r] == "block" for r in ordered], dtype="u1"),
        np.frombuffer(b"".join(blobs), dtype="u1"),
    ]
    content = b"".join(p.tobytes() for p in parts)
    path = Path(folder, f"rules-{hashlib.sha256(content).hexdigest()[:24]}.bin")
    if not path.exists():
        staged = Path(folder, f".{path.name}.{os.getpid()}")
        staged.write_bytes(content)
        staged.rename(path)
    return str(path)


#: Index files that an application has been given, by application and file name.
_SENT: dict[tuple[str, str], str] = {}


def _shipped(context: SparkContext, rules: Iterable[tuple[str, str]]) -> str:
    """The name under which workers find the rules' index. Equal rules are sent once."""
    folder = tempfile.mkdtemp(prefix="tessella-rules-")
    path = write_index(rules, folder)
    key = (context.applicationId, Path(path).name)
    if key in _SENT:
        shutil.rmtree(folder)
    else:
        context.addFile(path)
        _SENT[key] = path
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it as long as it lives
    return key[1]


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, the longest fitting rule, and the verdict."""
    spark = pages.sparkSession
    name = _shipped(spark.sparkContext, rules)
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase)
    asked = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.regexp_extract(url, parts, 2).alias("path"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(SparkFiles.get(name))
        for batch in batches:
            best = index.longest(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rule = pa.array([index.rule(i) if i >= 0 else None for i in best], pa.string())
            verdict = pa.array([default if i < 0 else "block" if index.blocks[i] else "allow" for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["id", "host", "path", "rule", "verdict"])

    kind = asked.schema["id"].dataType.simpleString()
    found = asked.mapInArrow(judged, f"id {kind}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("id", id_col)
