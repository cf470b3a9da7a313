"""The filter audit against a plain count over all orders."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np

from vinculum.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(80)] + ["É", "né", "A" * 9, "B2", "x\x00y"]
    rows = []
    for i in range(160):
        n = rng.choice([0, 3, 49, 50, 60, 200])
        text = rng.choice([" ", "\n", " \t "]).join(rng.choices(words, k=n))
        if i % 9 == 0:
            text += " costs $5"
        if i % 11 == 0:
            text = text.upper()
        rows.append((i, rng.choice(["web", "web", "book", None, ""]), text))
    rows += [(500 + i, "hot", "the same text " * 30) for i in range(90)]  # a group of copies
    rows += [(500, "book", "the same text " * 30), (None, "hot", "the same text " * 30), (None, "none", None), (700, "none", None), (701, "none", ""), (702, "none", " \n")]
    rows += [(800, "long", "word " * 60_000 + "last"), (801, "long", " ".join(f"u{i}" for i in range(30_000))), rows[3], rows[3]]
    return rows


def labels():
    return [(i, i % 2, int(i % 5 == 0)) for i in range(0, 160, 3)] + [(500, 1, 0), (501, 0, 1), (501, 1, None), (None, 1, 1), (9999, 1, 1), (502, None, None)]


def fails_by_hand(rows):
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, part, text in rows:
        text = text or ""
        words = WORD.findall(text)
        bits = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > first[text]]
        out.append((i, part or "", sum(1 << k for k, b in enumerate(bits) if b)))
    return out


def by_hand(rows, labelled):
    good = {i for i, q, _ in labelled if q == 1 and i is not None}
    toxic = {i for i, _, t in labelled if t == 1 and i is not None}
    out = {}
    failed = fails_by_hand(rows)
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                removed = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                shapley[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(1 for x in gone if x[1] & bit), sum(1 for x in own if x[1] == bit),
                    sum(1 for x in removed if x[0] in good), sum(1 for x in removed if x[0] in toxic),
                ]
                gone = gone + removed
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def frame(spark, rows, parts=6):
    clashing = "words string, term int, shard int, digest int, marks int, first int, n int, fails string"
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6, "y") for r in rows], f"doc_id bigint, source string, text string, {clashing}")
    return df.repartition(parts).withColumn("part", fa.F.coalesce("source", fa.F.lit("")))


def test_audit(spark):
    marked = spark.createDataFrame(labels(), "doc_id bigint, quality int, toxic int").withColumn("part", fa.F.lit(1))
    rows = fa.audit(fa.failures(frame(spark, corpus()), 2_000), marked).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows) and found == by_hand(corpus(), labels())


def test_matrix_is_the_texts(spark):
    """Every cell of every row, decoded by the corpus dictionary, is a word's count in its document."""
    docs = frame(spark, corpus())
    shards = fa.shards_of(docs, 2_000)
    stored = fa.write_through(fa.term_numbers(shards, 500), "numbers")
    word = {r.term: r.word for r in fa.dictionary(stored).collect()}
    assert len(set(word.values())) == len(word) and shards.count() > 10 and stored.select("range").distinct().count() > 10
    found = []
    for r in fa.term_matrix(shards, stored).collect():
        indptr, indices, counts = (np.frombuffer(r[c], k) for c, k in (("indptr", "<u4"), ("indices", "<i8"), ("counts", "<u4")))
        assert len(r.doc_id) + 1 == len(indptr) and indptr[-1] == len(indices) == len(counts)
        for i, own in enumerate(r.doc_id):
            cells = slice(indptr[i], indptr[i + 1])
            found.append((own, {word[t]: int(c) for t, c in zip(indices[cells], counts[cells], strict=True)}))
    expected = []
    for own, _, text in corpus():
        count = {}
        for w in WORD.findall(text or ""):
            count[w] = count.get(w, 0) + 1
        expected.append((own, count))
    key = lambda x: (x[0] is None, x[0] or 0, sorted(x[1].items()))
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_no_rows(spark):
    none = frame(spark, corpus()).where("false")
    assert fa.audit(fa.failures(none), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_parts_without_labels_count_zero(spark):
    rows = fa.audit(fa.failures(frame(spark, [(1, "a", "one"), (2, "a", "one")], 1)), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)
    assert {(r.removed, r.kept) for r in rows if r.filter_order == "AEBCD" and r.step == 2} == {(0, 0)}
