import hashlib
import re
from collections import Counter
from glob import glob

import numpy as np
import xxhash
from odd import empty_documents, odd_documents, odd_rows

from pollspark.llm import components, exact_dedup, line_dedup, simhash, substring
from pollspark.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def test_quotient_filter_is_lossless():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 2_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64) * 2
        f = exact_dedup.CountingQuotientFilter.of(np.concatenate([keys, keys[:n // 3]]))
        g = exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes())
        assert (g.fingerprints == f.fingerprints).all() and (g.counts == f.counts).all()
        assert (g.merge(f).counts == 2 * f.counts).all()


def test_exact_groups(spark):
    rows = odd_rows()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    found = exact_dedup.exact_groups(odd_documents(spark)).collect()
    assert len(found) == len(rows)
    sizes = Counter(norm)
    by_sha = {hashlib.sha256(x.encode()).hexdigest(): x for x in norm}
    for r in found:
        assert r.group_size == sizes[by_sha[r.text_sha256]]
    for x in sizes:
        group = [r for r in found if by_sha[r.text_sha256] == x]
        best = min((-len(t or ""), i is None, i or 0) for (i, t, *_), y in zip(rows, norm) if x == y)
        assert {r.keep_id for r in group} == {None if best[1] else best[2]}
        assert sum(r.kept for r in group) == 1
    assert exact_dedup.exact_groups(empty_documents(spark)).count() == 0
    kept = exact_dedup.kept_documents(odd_documents(spark))
    assert kept.count() == len(sizes) and kept.columns == odd_documents(spark).columns


def _fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, bits=3):
    x, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= bits):
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(x))]


def test_simhash_components(spark):
    rows = odd_rows()
    found = simhash.near_duplicates(odd_documents(spark)).collect()
    prints = [_fingerprint(t) for _, t, *_ in rows]
    groups, least = _groups(prints), {}
    for (i, *_), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, p, least.get(g)) for (i, *_), p, g in zip(rows, prints, groups))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


def test_long_lists_meet_in_blocks(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 7))}) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**63, 100)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.a: r.b for r in components.components(simhash.near_links(df, 3, block=32)).collect()}
    groups, least = _groups(prints), {}
    for x, g in zip(signed, groups):
        least[g] = min(least.get(g, x), x)
    assert [roots.get(x, x) for x in signed] == [least[g] for g in groups]


def test_verified_near_duplicates(spark):
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "short text"), (5, "short text"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert len(kept & {1, 2}) == 1 and {3, 4} <= kept and 5 not in kept
    assert simhash.one_of_each(empty_documents(spark)).count() == 0


def _substrings(texts, w):
    words = [re.findall(WORD, t or "") for t in texts]
    seen = Counter(tuple(x[i:i + w]) for x in words for i in range(len(x) - w + 1))
    for x in words:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i:i + w])] > 1:
                gone[i:i + w] = [True] * w
        yield len(x), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(x, gone) if not g).encode()).hexdigest()


def test_substring_dedup(spark):
    rows = odd_rows()
    for window, shortest in ((4, 2), (7, 2), (9, 9), (35, 18)):
        want = Counter((i, *x) for (i, *_), x in zip(rows, _substrings([t for _, t, *_ in rows], window)))
        found = substring.remove_repeats(odd_documents(spark).repartition(3), window, shortest=shortest).collect()
        assert Counter(tuple(r) for r in found) == want
    assert substring.remove_repeats(empty_documents(spark)).count() == 0


def test_line_dedup(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    gone, occurrences = {}, []
    for i, text, *_ in dict.fromkeys(rows):
        for p, line in enumerate((text or "").split("\n")):
            if words := frozenset(re.findall(WORD, line)):
                occurrences.append((i, p, words))
    for k, (i, p, words) in enumerate(sorted(occurrences, key=lambda x: x[:2])):
        if any(len(words & o) >= 0.8 * len(words | o) - 1e-9 for _, _, o in sorted(occurrences, key=lambda x: x[:2])[:k]):
            gone.setdefault(i, []).append(p)
    found = line_dedup.dedup_lines(odd_documents(spark, rows)).collect()
    assert Counter((r.doc_id, tuple(r.removed)) for r in found) == Counter((i, tuple(gone.get(i, ()))) for i, *_ in rows)
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_lines_go_on_to_later_partners(spark):
    """A line whose earliest candidates are not similar is compared with the others; null ids stand first."""
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{k}" for k in rng.choice(14, rng.integers(6, 12), replace=False)) for _ in range(160)]
    texts = ["\n".join(lines[i:i + 4]) for i in range(0, 160, 4)]
    rows = [(None if i == 0 else i, t) for i, t in enumerate(texts)]
    sets = [set(x.split()) for x in lines]
    gone = [any(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets[:k]) for k, a in enumerate(sets)]
    want = {rows[i][0]: [p for p in range(4) if gone[4 * i + p]] for i in range(40)}
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: list(r.removed) for r in found} == want and 20 < sum(gone) < 150


def test_components_of_unusual_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (4, 4), (None, 3), (5, None), (7, 6)], "a long, b long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(2, 1), (3, 1), (7, 6)]
    assert components.components(edges.limit(0)).count() == 0


def test_only_sets_in_pairs_are_joined_again(spark):
    """Of 203 different lines two are in a pair; the later one, which also repeats, goes wherever it stands."""
    near = [" ".join(f"n{k}" for k in range(10)), " ".join(f"n{k}" for k in range(11))]
    lone = [" ".join(f"x{i}_{k}" for k in range(6)) for i in range(201)]
    rows = [(1, near[0]), (2, "\n".join([near[1], lone[0], near[1]])), (3, "\n".join([lone[0], near[1]])), (4, "\n".join(lone[1:]))]
    before = set(glob(f"{shared_dir(spark)}/line-stands-*"))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in found} == {1: [], 2: [0, 2], 3: [0, 1], 4: []}
    new = set(glob(f"{shared_dir(spark)}/line-stands-*")) - before
    assert [spark.read.parquet(x).count() for x in new] == [2]
