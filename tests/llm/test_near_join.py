import random

import numpy as np
import pytest
from odd import empty_documents, odd_documents, odd_rows

from pollspark.llm import near_join, simhash


def brute_groups(texts, shingle=5, similarity=0.8):
    """Groups of the texts by all pairs of word-shingle sets: for each text the first of its group."""
    def words(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()

    sets, root = [words(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and find(i) != find(j) and len(a & b) >= similarity * len(a | b) - 1e-9:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def check(spark, texts, groups=None):
    """One text of each brute-force group stays; the groups are returned."""
    groups = brute_groups(texts) if groups is None else groups
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(groups[i] for i in kept) == sorted(set(groups))
    return groups


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_copies_of_one_original_that_are_not_near_each_other(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(2):
        original = words_of(rng, 200)
        texts.append(" ".join(original))
        for k in range(120):  # another passage of 17 words each: 0.8 or more to the original, less to most others
            at = 1 + k * 181 // 120
            texts.append(" ".join(original[:at] + words_of(rng, 17) + original[at + 17:]))
    assert len(set(check(spark, texts))) == 2


def test_lists_are_compared_whole_after_the_rounds(spark, monkeypatch):
    rng = random.Random(2)
    base = words_of(rng, 300)
    texts = [" ".join(base[:150] + words_of(rng, 150)) for _ in range(40)]  # one shared passage, not near
    texts += [t + " tail of one text" for t in texts[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = near_join.all_pairs
    monkeypatch.setattr(near_join, "all_pairs", lambda *a: whole(*a, block=8))
    groups = brute_groups(texts)
    found = near_join.near_groups(docs, rounds=0).count()
    assert found == near_join.near_groups(docs).count() == len(texts) - len(set(groups)) == 14


def test_texts_ruled_by_one_repeated_phrase(spark):
    rng = random.Random(3)
    texts = []
    for g in range(8):  # the sets are the tails, while nearly all shingles are those of the phrase
        phrase = " ".join(["the same phrase again and again"] * 400)
        tail = words_of(rng, 60)
        texts += [f"{phrase} {' '.join(words_of(rng, 30))}", f"{phrase} {' '.join(tail)}", f"{phrase} {' '.join(tail[:-1])} other"]
    assert len(set(check(spark, texts))) == 16


def test_planted_edits_just_above_the_limit(spark):
    rng = random.Random(4)
    texts = []
    for similarity in (0.8, 0.82, 0.85, 0.9):
        for _ in range(8):
            base = words_of(rng, 300)
            n = int(300 * (1 - similarity) / (1 + similarity)) - 5  # words changed in one passage
            at = rng.randrange(1, 290 - n)
            block = base[:at] + words_of(rng, n) + base[at + n:]
            tail = base + words_of(rng, int(296 * (1 / similarity - 1)))
            scattered = [f"x{rng.random()}" if i % 60 == 30 and i < 300 * (1 - similarity) * 5 else w for i, w in enumerate(base)]
            for edited in (block, tail, scattered):  # each pair has words of its own
                own = {w: f"{w}-{len(texts)}" for w in base}
                texts += [" ".join(own.get(w, w) for w in t) for t in (base, edited)]
    groups = check(spark, texts)
    assert len(texts) - len(set(groups)) > 85


def test_components_of_fingerprints_are_compared_first(spark, monkeypatch):
    rng = random.Random(5)
    base = words_of(rng, 600)
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(words_of(rng, 600))]
    seen, whole = [], simhash.near_groups
    monkeypatch.setattr(simhash, "near_groups", lambda docs, **o: (seen.append(o["nominated"].collect()), whole(docs, **o))[1])
    check(spark, texts)
    assert [len(s) for s in seen] == [1]
    docs = spark.createDataFrame([(0, " ".join(["the same phrase again now"] * 300 + ["x"])), (1, " ".join(["the same phrase again now"] * 300 + words_of(rng, 30)))], "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 2 and [len(s) for s in seen] == [1, 1]  # one fingerprint, different sets


def test_sets_of_pairs_are_shuffled_once_and_not_written(spark, monkeypatch):
    rng = random.Random(6)
    bases = [words_of(rng, 60) for _ in range(30)]
    texts = spark.createDataFrame([(2 * i + k, " ".join([*b, f"tail{k}"] if k or i % 3 else words_of(rng, 60))) for i, b in enumerate(bases) for k in (0, 1)], "key long, text string")
    texts = texts.union(texts)  # each text twice
    pairs = spark.createDataFrame([(2 * i + 1, 2 * i) for i in range(30)], "x long, y long")
    written, write = [], near_join.stored
    monkeypatch.setattr(near_join, "stored", lambda df, name: (written.append(name), write(df, name))[1])
    monkeypatch.setattr(near_join, "BROADCAST_KEYS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_join.verified(pairs, texts, 5, 0.8)
        assert sorted(map(tuple, found.collect())) == [(2 * i + 1, 2 * i) for i in range(30) if i % 3]
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert written == ["near-wanted"] and plan.count("ReusedExchange") == 1


def test_long_texts_below_the_limit_are_not_compared_whole(spark, monkeypatch):
    rng = random.Random(7)
    shared = words_of(rng, 2600)
    texts = [" ".join(shared + words_of(rng, 1400)) for _ in range(8)]  # a similarity of about 0.48
    texts += [" ".join([*t.split()[:-100], *words_of(rng, 100)]) for t in texts[:3]]  # and three of 0.95
    texts += ["a short text with a few words", "a short text with a few other words"]
    seen, whole = [], near_join.verified
    monkeypatch.setattr(near_join, "verified", lambda pairs, *a: (seen.append(pairs.count()), whole(pairs, *a))[1])
    groups = check(spark, texts)
    assert len(set(groups)) == 10 and sum(seen) <= 6


CLASH = "firsttxtaboutone", "8evoeki07ccW0w1M"  # one 64-bit hash


def test_different_texts_of_one_hash_are_both_kept(spark):
    docs = spark.createDataFrame([(0, CLASH[0]), (1, CLASH[1]), (2, CLASH[1]), (3, None), (4, "another text"), (5, "another text")], "doc_id long, text string")
    assert docs.where("doc_id < 2").selectExpr("count(DISTINCT xxhash64(text)) AS n").first().n == 1
    keys = {(r.text, r[near_join.KEY]) for r in near_join.keyed(docs).collect()}
    assert len(keys) == len({k for _, k in keys}) == 4
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 1, 3, 4]


def test_keys_are_told_apart_until_no_two_are_equal(spark, monkeypatch):
    """With hashes of two values and few turns, many texts meet again after they got another hash."""
    whole, texts = near_join.F.xxhash64, [f"text {i}" for i in range(12)]
    monkeypatch.setattr(near_join.F, "xxhash64", lambda *a: near_join.F.pmod(whole(*a), near_join.F.lit(40)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    keys = {(r.text, r[near_join.KEY]) for r in near_join.keyed(docs).collect()}
    assert len(keys) == len({k for _, k in keys}) == len(texts)
