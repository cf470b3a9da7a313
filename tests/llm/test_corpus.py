"""Operators that compare or place documents, against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from vinculum.llm import decontaminate, jaccard_join, packing, suffix_dedup
from vinculum.llm.common import in_bitmap, marked
from vinculum.llm.components import components
from vinculum.session import scratch_dir, scratch_run

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def linked(rows, n, percent):
    """(id, set size, component, links) of every row by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            links[i], links[j], root[find(i)] = links[i] + 1, links[j] + 1, find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, len(sets[i]), least.get(find(i)) if key is not None else None, links[i]) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "unit"), [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 90, 300)])
def test_jaccard_join(docs, rows, none, n, percent, unit):
    out = [tuple(r) for r in jaccard_join.jaccard_join(docs, words=n, percent=percent, unit_shingles=unit).collect()]
    assert sorted(out, key=str) == sorted(linked(rows, n, percent), key=str)
    if n == 5:
        assert jaccard_join.jaccard_join(none, words=n, percent=percent).count() == 0


def test_a_large_group_is_dealt_out_in_rounds_and_steps_leave_nothing(spark, monkeypatch):
    """A text has a row in each unit of its block: in one go a group of k blocks would have k times its texts on disk."""
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{text} own{i}") for i in range(200)], "doc_id bigint, text string")
    dealt, solve = [], jaccard_join.link_units

    def counted(units, *rest):
        dealt.append(units.count())
        return solve(units, *rest)

    monkeypatch.setattr(jaccard_join, "link_units", counted)
    with scratch_run(spark):
        out = jaccard_join.jaccard_join(docs, unit_shingles=2_000).collect()
        folder = os.path.dirname(scratch_dir(spark)).removeprefix("file:")
        kept = {path.rsplit("-", 1)[0] for path in os.listdir(folder)}
    assert {(r["component_id"], r["n_links"]) for r in out} == {(0, 199)}
    assert sum(dealt) == 200 * 10 and len(dealt) == 5 and max(dealt) <= 4 * 200
    assert kept == {"sets", "classes", "edges", "links"}


def test_pipeline_stages_leave_no_arrays_of_n_grams(spark):
    """What the quality rules store of each text would stay on disk through all later stages."""
    with scratch_run(spark):
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
        kept = corpus_pipeline.keep_good(spark, docs, SF_DIR)
        near = corpus_pipeline.keep_one_of_near(spark, kept, SF_DIR)
        assert 0 < near.count() < kept.count() < docs.count()
        left = {path.rsplit("-", 1)[0] for path in os.listdir(os.path.dirname(scratch_dir(spark)).removeprefix("file:"))}
    assert left == {"trusted", "bitmap", "kept", "near"}


def test_the_bitmap_grows_with_the_shingles():
    assert jaccard_join.bitmap_bits(0) == jaccard_join.bitmap_bits(1 << 27) == 1 << 26
    assert jaccard_join.bitmap_bits(1_000_000_000) == jaccard_join.bitmap_bits(1 << 40) == 1 << 28
    names = np.random.default_rng(1).integers(0, 1 << 47, 10_000)
    bits = np.zeros(1 << 20, np.int64)
    batch = marked(names, 1 << 26, ordered=True)
    bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    assert in_bitmap(bits.view(np.uint8), names, ordered=True).all()
    assert not in_bitmap(bits.view(np.uint8), names ^ (1 << 40), ordered=True).all()
    part = marked(names[names < 1 << 40], 1 << 26, ordered=True)  # a part of the range marks its own words only
    assert part.column(0).to_numpy().max() < 1 << 13


@pytest.mark.parametrize("percent", [90, 80])
def test_sets_that_link_share_a_signature_whatever_is_in_their_slices(percent):
    rng = np.random.default_rng(4)
    for small in range(percent // (100 - percent), 400):
        large = small * 100 // percent
        value = np.sort(rng.integers(0, 1 << 63, large).astype(np.uint64) << np.uint64(1))
        part = np.delete(value, rng.choice(large, large - small, replace=False))
        found = [set(jaccard_join.signatures(np.zeros(len(v), np.int64), v, np.array([len(v)]), percent)[1].tolist()) for v in (part, value)]
        assert found[0] & found[1], (small, large)


def test_links_across_a_size_class_and_slices(spark):
    rows = []
    for i, (small, large) in enumerate([(30, 33), (95, 100)]):
        own = [f"w{i}x{k}" for k in range(large + 2)]
        rows += [(2 * i + 1, " ".join(own[: small + 2])), (2 * i + 2, " ".join(own))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(4, "doc_id")
    assert table.rdd.glom().map(len).collect() == [1, 1, 1, 1]
    out = [tuple(r) for r in jaccard_join.jaccard_join(table).collect()]
    assert sorted(out) == sorted(linked(rows, 3, 90)) and all(r[3] == 1 for r in out)


def test_divide_skip_finds_every_partner():
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 120, replace=False)
    sets = [np.unique(np.r_[rng.choice(base, 120 - k, replace=False), rng.integers(10_000, 20_000, k)]) for k in rng.integers(0, 14, 80)]
    sets.sort(key=len)
    lists = jaccard_join.Lists(np.repeat(np.arange(80), [len(s) for s in sets]), np.concatenate(sets), np.array([len(s) for s in sets]), 90)
    for x in range(80):
        plain = [y for y in range(x) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 90 * len(np.union1d(sets[x], sets[y]))]
        assert lists.partners(x).tolist() == plain


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50), (-3, 60), (60, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: -3 for i in [*range(31), 60, -3]} | {40: 40, 41: 40}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def deduped(rows, size=50):
    first: dict[bytes, int] = {}
    for key, text in rows:
        if key is not None:
            raw = (text or "").encode()
            for i in range(len(raw) - size + 1):
                first[raw[i : i + size]] = min(key, first.get(raw[i : i + size], key))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if key is not None:
            for i in range(len(raw) - size + 1):
                if first[raw[i : i + size]] < key:
                    gone[i : i + size] = True
        left = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(docs, rows, none):
    out = suffix_dedup.dedup(docs)
    assert sorted((tuple(r) for r in out.drop("kept").collect()), key=str) == sorted(deduped(rows), key=str)
    assert suffix_dedup.dedup(none).count() == 0


def test_contexts_of_a_common_anchor_are_ordered_in_bounded_units(spark, docs, rows, monkeypatch):
    """A line that many texts share, shorter than a match, gives one anchor many contexts: they are never ordered all at once."""
    rng = random.Random(3)
    line = "the very common line of forty-two letters "
    ends = ["".join(rng.choice("ab ") for _ in range(12)) for _ in range(6)]
    some = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(60, 90))) + rng.choice(ends) + line + rng.choice(ends) + "tail" * 9) for i in range(200)]
    sizes = []
    least_ids = suffix_dedup.least_ids
    own = np.concatenate([np.frombuffer(t.encode()[a : a + 80], np.uint8) for _, t in some for a in (t.index(line) - 20,)]).reshape(-1, 80)
    contexts = np.zeros(len(own), suffix_dedup.ROW)
    contexts["bytes"], contexts["size"], contexts["least"] = own, 80, np.arange(len(own)) % 50
    shard = np.arange(len(own)) % suffix_dedup.SHARDS
    monkeypatch.setattr(suffix_dedup, "UNIT_CONTEXTS", 20)
    monkeypatch.setattr(suffix_dedup, "least_ids", lambda rows, shard: sizes.append(len(rows)) or least_ids(rows, shard))
    assert (suffix_dedup.least_ids_of_any(contexts, shard) == least_ids(contexts, shard)).all()
    assert len(sizes) > 10 and max(sizes) < len(own) / 2
    both = rows + some
    found = suffix_dedup.dedup(spark.createDataFrame(both, "doc_id bigint, text string").repartition(5))
    assert sorted((tuple(r) for r in found.drop("kept").collect()), key=str) == sorted(deduped(both), key=str)


def test_merged_transforms_order_all_suffixes():
    rng = np.random.default_rng(4)
    shards = [np.frombuffer(bytes(rng.choice(list(b"ab"), 150)) + b"\0", np.uint8) for _ in range(3)]
    shards[1] = np.r_[shards[0][:90], shards[1]]
    merged, interval = suffix_dedup.merge_shards(shards, depth=12)
    flat, ends = np.concatenate(shards), np.cumsum([len(s) for s in shards])
    prefix = []
    for p in range(len(flat)):
        shard = int(np.searchsorted(ends, p, "right"))
        own = shards[shard]
        prefix.append(bytes(np.resize(np.roll(own, -(p - (ends[shard] - len(own)))), 12)))
    inside = [i for i in range(len(flat)) if b"\0" not in prefix[merged[i]]]
    got = [(int(interval[i]), prefix[merged[i]]) for i in inside]
    assert [p for _, p in got] == sorted(p for _, p in got)
    assert len({k for k, _ in got}) == len({p for _, p in got}) == len(set(got))


def test_merge_takes_few_rounds(monkeypatch):
    """Each round sorts all suffixes: fifty rounds of one character took most of the operator's time."""
    sorts = []

    class Counting:
        def __getattr__(self, name):
            if name in ("sort", "argsort"):
                sorts.append(name)
            return getattr(np, name)

    rng = np.random.default_rng(9)
    own = [np.r_[rng.choice(np.frombuffer(b"abc", np.uint8), 40 + i), np.zeros(1, np.uint8)] for i in range(4)]
    shards = [np.concatenate([own[i], own[(i + 1) % 4], own[(i + 2) % 4]]) for i in range(4)]
    monkeypatch.setattr(suffix_dedup, "np", Counting())
    for depth in (50, 16, 5):  # of six whole letters and a part, of whole letters only, and of less than one
        sorts.clear()
        merged, interval = suffix_dedup.merge_shards(shards, depth)
        assert len(sorts) < 40
        assert sorted(merged) == list(range(sum(map(len, shards))))
        flat, ends = np.concatenate(shards), np.cumsum([len(s) for s in shards])
        prefix = []
        for p in merged:
            k = int(np.searchsorted(ends, p, "right"))
            prefix.append(bytes(np.resize(np.roll(shards[k], -(p - (ends[k] - len(shards[k])))), depth)))
        assert prefix == sorted(prefix)
        assert interval.tolist() == np.cumsum([0, *(a != b for a, b in zip(prefix, prefix[1:], strict=False))]).tolist()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    sequence, offset = packing.best_fit(lengths, (100, 5, 4000), rule=rule)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        assert lengths[own].sum() <= 100 and len(own) <= 5
        assert (lengths[own].astype(int) ** 2).sum() <= 4000 or len(own) == 1
        assert offset[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()


def test_tokenising_holds_little():
    """A batch is split into words in small pieces, so that a worker's arrays do not add up to its batches' size many times over."""
    import tracemalloc
    from unittest.mock import MagicMock

    import pyarrow as pa

    docs = MagicMock()
    docs.select.return_value.mapInArrow = lambda run, schema: run
    run = packing.pieces(docs, packing.tokenizer_path())
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(400_000)]
    texts = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    first = list(run(iter([batch])))  # the words are learned
    tracemalloc.start()
    again = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again == first and sum(b.num_rows for b in again) >= len(texts)
    assert peak < 40 << 20


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = []
    for key, text in [*rows, (500, "Word, <|endoftext|><|ENDOFTEXT|> don't ÉCOLE's “q”.. x!?' 12.5% ́a ﬁ")]:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(key, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(500, "Word, <|endoftext|><|ENDOFTEXT|> don't ÉCOLE's “q”.. x!?' 12.5% ́a ﬁ")], "doc_id bigint, text string"))
    out = packing.pack_documents(more).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
    sequences: dict[int, list] = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in out) // 4096) + 1
    assert packing.pack_documents(none).count() == 0


def test_block_max_wand_retrieves_what_scoring_everything_does(monkeypatch):
    monkeypatch.setattr(decontaminate, "LIST_BLOCK", 3)
    rng = np.random.default_rng(8)
    terms = [rng.integers(0, 60, rng.integers(5, 30)).astype(np.uint64) for _ in range(40)]
    df = {k: sum(k in t for t in terms) for k in range(60)}
    index = decontaminate.Index(list(range(40)), terms, df, 40, float(np.mean([len(t) for t in terms])))
    for _ in range(60):
        places = sorted({int(p) for p in index.places(rng.integers(0, 80, 25).astype(np.uint64)) if p >= 0})
        plain = {}
        for p in places:
            for i, w in zip(index.ids[p], index.impacts[p], strict=True):
                plain[i] = plain.get(i, 0.0) + w
        for threshold in (0.2, 0.4, 0.6):
            got = dict(index.search(places, threshold))
            assert set(got) == {i for i, s in plain.items() if s >= threshold - 1e-9}
            assert all(got[i] == pytest.approx(plain[i]) for i in got)


def test_decontamination(spark, docs, rows, none):
    texts = [t for _, t in rows]
    whole = " ".join(texts[4].split()[30:60]) if len(texts[4].split()) >= 60 else texts[4]
    items = [(1, whole), (2, "words that no text of the corpus has in it at all, not one"), (3, None), (4, " "), (5, whole)]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_terms=20)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(rows[4][0], 1), (rows[4][0], 5)]
    split = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
    long = rows[-3][1].split()
    leak = " ".join(long[3000:3040])
    found = decontaminate.contaminated(docs, spark.createDataFrame([(9, leak.upper() + "!")], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.question_overlap, r.answer_overlap) for r in found] == [(400, 1.0, 1.0)] and len(split.findall(leak)) == 40
    assert decontaminate.contaminated(none, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_decontamination_of_halves_and_edited_passages(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    items = {i: words(n) for i, n in enumerate([38, 15, 24, 59, 11])}
    texts, expected = [], set()
    for i, own in items.items():
        half = -(-len(own) // 2)
        question, answer = own[:half], own[half:]
        edit = lambda part, at: [*part[:at], "edited", *part[at + 1 :]]
        planted = [question, answer, *(edit(own, at)[:half] + edit(answer, at % len(answer)) for at in range(half)), edit(question, half // 2), edit(answer, 2), [w.upper() for w in own]]
        for part in planted:
            expected.add((len(texts), i))
            texts.append(words(int(rng.integers(0, 300))) + part + words(int(rng.integers(0, 300))))
    texts += [words(400) for _ in range(50)]  # clean, of the same words
    texts += [[w for pair in zip(words(19), items[0][:19], strict=True) for w in pair]]  # the words, but no two of them together
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect()} == expected
