"""Packing, URL rules, mixing, token counts and exact deduplication against direct versions."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, mixing, packing, token_counts, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORDS.findall(text or ""))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# exact deduplication


def direct_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r["text"])].append(r["doc_id"])
    out, done = [], set()
    for r in rows:
        own = groups[lowered(r["text"])]
        keep = max((x for x in own if x is not None), default=None)
        kept = r["doc_id"] == keep and lowered(r["text"]) not in done  # one row of a group stays
        if kept:
            done.add(lowered(r["text"]))
        out.append((r["doc_id"], keep, len(own), kept, hashlib.sha256(lowered(r["text"]).encode()).hexdigest()))
    return Counter(out)


def test_exact_groups(awkward, no_docs):
    assert Counter(map(tuple, exact_dedup.exact_groups(awkward).collect())) == direct_groups(awkward.collect())
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_exact_groups_tell_texts_of_one_digest_apart(awkward, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda body: F.unhex(F.lit("00")))
    got = [tuple(r)[:4] for r in exact_dedup.exact_groups(awkward).collect()]
    assert Counter(got) == Counter(x[:4] for x in direct_groups(awkward.collect()).elements())


def test_a_text_that_is_most_rows(spark):
    rows = [(i if i % 3 else None, "Hot text") for i in range(3000)] + [(None, "hot TEXT")] * 1000 + [(None, "no id")] * 500 + [(9000 + i, f"own {i}") for i in range(500)] + [(2999, "hot text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter(map(tuple, got)) == direct_groups([{"doc_id": i, "text": t} for i, t in rows])
    assert Counter(r["text_sha256"] for r in got if r["kept"]).most_common(1)[0][1] == 1 and sum(r["kept"] for r in got) == 502
    assert Counter(lowered(r["text"]) for r in exact_dedup.drop_exact_copies(docs).collect()) == Counter({lowered(t): 1 for _, t in rows})


def test_a_hot_text_meets_its_group_by_salt(awkward):
    plan = exact_dedup.exact_groups(awkward)._jdf.queryExecution().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("digest" in line for line in joins) and any("salt" in line for line in joins)


def test_dropping_copies_keeps_one_row_each_and_all_columns(awkward, no_docs):
    wide = awkward.withColumns({"digest": F.lit("x"), "row": F.lit(1), "salt": F.array(F.lit(2))})
    kept = exact_dedup.drop_exact_copies(wide)
    assert kept.columns == wide.columns
    rows = kept.collect()
    assert Counter(lowered(r["text"]) for r in rows) == Counter({lowered(r["text"]): 1 for r in awkward.collect()})
    assert {r["doc_id"] for r in rows} == {2, 3, 4, 6, 8, 9, 10, 11, 12}
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0


# mixing


def direct_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if weight[s] * share > most * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * share for s in rest}
        fixed |= {s: most * sizes[s] for s in above}


def test_mix(spark, awkward, no_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "xyz"[rng.choice([0, 0, 0, 0, 1, 1, 2])]) for i in range(3000)]
    rows += [(None, "a b", None), (None, "a b", None), (9000, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rank": F.lit(1), "size": F.lit(2), "target": F.lit(3)})
    got = mixing.mix(docs.repartition(7)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    targets, taken = direct_targets(sizes), Counter()
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 60
    assert Counter(map(tuple, mixing.mix(docs.repartition(3)).collect())) == Counter(map(tuple, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in got for _ in range(r["copies"]))
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mix(awkward).count() == awkward.count()


def test_mix_runs_no_python(awkward):
    plan = mixing.mix(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12), st.sets(st.sampled_from([8, 16, 24, 40]), max_size=3))
def test_plan_is_best_fit(counts, smaller):
    permitted = sorted(smaller | {64})
    plan = packing.best_plan(counts, permitted, lambda c: c + 3.0)
    used, placed = defaultdict(int), Counter()
    for length, _, pieces, first, each, offset in plan.runs:
        for k in range(pieces):
            assert used[first + k // each] == offset + (k % each) * length
            used[first + k // each] += length
            placed[length] += 1
    assert placed == counts
    size = {first + i: c for first, n, c in plan.bins for i in range(n)}
    assert size.keys() == used.keys()
    assert all(size[b] == min(c for c in permitted if c >= u) for b, u in used.items())
    assert plan.cost == pytest.approx(min(direct_cost(counts, permitted, opened) for opened in subsets(permitted)))


def subsets(permitted):
    return [[c for i, c in enumerate(permitted[:-1]) if mask >> i & 1] + [permitted[-1]] for mask in range(1 << (len(permitted) - 1))]


def direct_cost(counts, permitted, opened):
    """Piece by piece: the least room that fits, else the size of the least cost per token."""
    pieces = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)
    left, bins = sum(pieces), []
    for n in pieces:
        fitting = [b for b in bins if b[0] - b[1] >= n]
        if fitting:
            best = min(fitting, key=lambda b: b[0] - b[1])
        else:
            c = min((c for c in opened if c >= n), key=lambda c: ((c + 3.0) / min(c, left), -c))
            bins.append(best := [c, 0])
        best[1] += n
        left -= n
    return sum(min(c for c in permitted if c >= used) + 3.0 for _, used in bins)


def test_pack(awkward, no_docs):
    rows = packing.pack(awkward.withColumns({"bin_id": F.lit(1), "rank": F.lit(1), "length": F.lit("x")}), (64, 512)).collect()
    per_doc, bins = Counter(), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]] += r["length"]
        if r["length"]:
            bins[r["bin_id"]].append((r["offset"], r["length"], r["bin_capacity"]))
        else:
            assert r["bin_id"] is None and r["bin_capacity"] is None
    want = Counter()
    for d in awkward.collect():
        want[d["doc_id"]] += words(d["text"])
    assert per_doc == want
    for own in bins.values():
        at = 0
        for offset, length, size in sorted(own):
            assert offset == at and at + length <= size
            at += length
    assert packing.pack(no_docs).count() == 0


# URL rules

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def direct_verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (lowered(m[1]), m[2]) if m else ("", "")
    fits = [(len(rule), rule, verdict) for verdict, rule in rules for h, p in [(rule.split("/", 1)[0], "/" + rule.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme", "http://COM/en/", "http://com/en", "x://a.com", "ftp://EXAMPLE.com/en/7?x=://b/c", "a://b://c/d", "http://é.net/de/8", "http://example.net:80/de/8", "http://.com/en/1", "http://xcom/en/1", "http://example.net/de/8#f"]
    urls += [f"https://{rng.choice(['', 'www.', 'A.b.'])}{rng.choice(['example.', 'other.', ''])}{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 99)}" for _ in range(300)]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, RULES).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(direct_verdict(u, RULES) for u in urls)
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}
    assert url_filter.judge_urls(pages, RULES).count() == len(urls)


def test_many_rules_and_long_urls(spark):
    rng = random.Random(8)
    hosts = [f"{a}.{b}" for a in ("x", "y.z", "shop") for b in ("com", "org", "co.uk")]
    rules = list({f"{rng.choice(hosts)}/{'p' * rng.randint(0, 300)}": None for _ in range(400)})
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    urls = [f"https://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{'p' * rng.randint(0, 400)}{'?' + 'q' * 9000 if i % 9 == 0 else ''}" for i in range(400)] + ["http://x.com/" + "p" * 70_000, "http://" + "a." * 3000 + "com/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, rules).collect()}
    assert all(got[i] == direct_verdict(u, rules) for i, u in enumerate(urls))


def test_index_confirms_strings_behind_equal_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s, *a: len(s) % 3)
    index = url_filter.RuleIndex(url_filter.write_index([("block", f"r{i}.org/") for i in range(30)], str(tmp_path)))
    assert [index.rule(i) if i >= 0 else None for i in index.find(["r7.org/", "r30.org/", "r29.org/", "x"])] == ["r7.org/", None, "r29.org/", None]


# token counts


@pytest.fixture(scope="module")
def tokenizer_json():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def tokenizer(tokenizer_json):
    return token_counts.Tokenizer.from_str(tokenizer_json)


PIECES = ["the", "ing", " ", "  ", "\n", "\n\n", "\t", "é", "ß ", "\u00a0", "\u2003", "'s", "123", "!?", "<|endoftext|>", "\U0001f600", "x" * 40, " a", "\x1c", "\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_splices_and_segments_equal_the_whole(tokenizer, text):
    import pyarrow as pa

    whole = tokenizer.encode(text, add_special_tokens=False).ids
    assert token_counts.spliced_ids(text, tokenizer, 24, 4) == whole
    got = token_counts.SegmentCounter(tokenizer).count(pa.array(["", text, "tail", text, ""], pa.string()).slice(1, 3))
    assert got.tolist() == [len(whole), len(tokenizer.encode("tail").ids), len(whole)]


def test_token_counts(awkward, no_docs, tokenizer_json, tokenizer):
    got = token_counts.token_counts(awkward.withColumns({"id": F.lit("x"), "n_tokens": F.lit(1)}), tokenizer_json, huge=20_000, chunk=4096, overlap=64).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect()]
    assert Counter(map(tuple, got)) == Counter((*w, w[2] > 512) for w in want)
    assert token_counts.token_counts(no_docs, tokenizer_json).count() == 0
    assert json.loads(tokenizer_json)["pre_tokenizer"]["add_prefix_space"] is False
