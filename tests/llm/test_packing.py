import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from odd import empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pollspark.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def spec():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def test_every_token_is_what_its_bytes_merge_to():
    tokenizer, parts = Tokenizer.from_file(PATH), json.loads(spec())
    bare = json.loads(spec())
    bare["pre_tokenizer"], bare["added_tokens"], bare["post_processor"] = None, [], None  # only the merges
    bare = Tokenizer.from_str(json.dumps(bare))
    tokens = [(t, i) for t, i in parts["model"]["vocab"].items() if t not in [a["content"] for a in parts["added_tokens"]]]
    assert [e.ids for e in bare.encode_batch_fast([t for t, _ in tokens], add_special_tokens=False)] == [[i] for _, i in tokens]
    encode, r = packing.ByteLevelIds(spec(), public_tokenizers.PATTERN), random.Random(2)
    texts = ["".join(chr(r.choice([r.randint(32, 126), r.randint(0, 255), r.randint(0x300, 0x2FFF), r.randint(0x1F300, 0x1F6FF), 32, 10])) for _ in range(60)) for _ in range(500)]
    texts += ["a<|endoftext|>b", "", " " * 3000, "x" * 5000]
    for text in texts:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_joined_checksums():
    data = random.Random(1).randbytes(1000)
    cuts = [data[i:i + 128] for i in range(0, 1000, 128)]
    assert packing.joined_crc([zlib.crc32(c) for c in cuts], [len(c) for c in cuts]) == zlib.crc32(data)


def test_knapsack_and_plan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        price = np.append(0, rng.random(12))
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max(best[c - w] + price[w] for w in range(1, c + 1))
        worth, pattern = packing.knapsack(price)
        assert np.isclose(worth, best[12]) and sum(w * k for w, k in pattern.items()) <= 12
        assert np.isclose(sum(price[w] * k for w, k in pattern.items()), worth)
    for lengths in ([], [1], [256] * 5, [138] * 400, rng.integers(1, 257, 500), rng.integers(129, 256, 900)):
        demand = np.bincount(lengths, minlength=257).astype(float) if len(lengths) else np.zeros(257)
        plan, left = packing.plan(demand), demand.copy()
        for w, after, n in plan.cuts:
            left[after] += n
            left[w - after] += n
            left[w] -= n
        assert sum(n for w, _, n in plan.cuts) <= demand.sum()
        for pattern, n in plan.patterns:
            assert sum(w * k for w, k in pattern.items()) <= 256
            for w, k in pattern.items():
                left[w] -= k * n
        assert not left.any()
        least = -(-int(demand @ np.arange(257)) // 256)
        assert sum(n for _, n in plan.patterns) <= least * 1.02 + 2


def check(rows, texts, tokenizer, padding):
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for i, own in enumerate(ids):
        at = 0
        for start, length, crc, tokens in sorted(spans[i]):
            assert (start, tokens) == (at, len(own)) and crc == zlib.crc32(np.array(own[start:start + length], "<u4").tobytes())
            at += length
        assert at == len(own)
    total = sum(map(len, ids))
    assert len(sequences) * 2048 <= total * (1 + padding) + 2 * 2048


def test_packing(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    check(queries.op11_packing(spark, sf).collect(), [d.text for d in docs], tokenizer, 0.01)
    r, word = random.Random(3), "alpha beta gamma delta "
    texts = [t for _, t, *_ in odd_rows()] + [word * r.choice([60, 275, 275, 275, 400]) for _ in range(150)]
    own, pattern = spec(), public_tokenizers.PATTERN
    df = odd_documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).selectExpr("*", "1 AS units", "2 AS part", "3 AS low")
    found = packing.pack(df.repartition(5), lambda: packing.encoder(own, pattern), 1)
    renamed = found.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
    check(renamed.collect(), texts, tokenizer, 0.02)
    repeated = packing.pack(odd_documents(spark), lambda: packing.encoder(own, pattern), 1)
    assert repeated.groupBy().agg(F.sum("length")).first()[0] == sum(len(tokenizer.encode(t or "").ids) + 1 for _, t, *_ in odd_rows())
    assert packing.pack(empty_documents(spark), lambda: packing.encoder(own, pattern), 1).count() == 0
