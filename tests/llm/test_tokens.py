import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from odd import empty_documents, odd_documents, odd_rows
from tokenizers import Tokenizer

from pollspark.llm import byte_bpe, queries, wavelet


def test_bpe_equals_library_and_round_trips(spark):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.byte_bpe_digests(odd_documents(spark)).collect())
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = library.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)
    assert queries.byte_bpe_digests(empty_documents(spark)).count() == 0


def test_long_words_take_several_contractions_a_step():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merger = byte_bpe.Merger(ranks)
    words = ["a" * 3_000, "ab" * 500, "=-" * 400, "abcabcabd" * 50, "é" * 200, "the", "x"]
    for word, ids in zip(words, merger.encode_words(words)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(word)


def test_decoding_gathers_bytes_without_a_query():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    texts = ["", "é" * 9 + "\0 \U0001f600", "", "two words\n", "x" * 5_000]
    merger = byte_bpe.Merger(ranks)
    ids = merger.encode_words(texts)
    merger.con.close()
    assert merger.decode(ids) == [t.encode() for t in texts]
    assert b"".join(merger.decode([ids[1][:4], ids[1][4:]])) == texts[1].encode()  # cut inside a character
    assert merger.decode([]) == [] and merger.decode([b"", b""]) == [b"", b""]


def test_shards_hold_what_the_library_encodes(spark):
    docs = odd_documents(spark)
    shards = wavelet.write_shards(docs, P.path("byte_bpe_50k.json"), 2, shard_tokens=3_000)
    assert shards.count() > 1
    found = wavelet.read_shards(shards).drop("ids").toPandas().sort_values("start")
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for doc_id, text, *_ in odd_rows():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(-1 if doc_id is None else doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    ids = found.doc_id.fillna(-1).astype(int).tolist()
    assert ids == sorted(ids)
    assert found.start.tolist() == (found.n_tokens.cumsum() - found.n_tokens).tolist()
    got = {}
    for i, n, crc in zip(ids, found.n_tokens, found.ids_crc32):
        got.setdefault(i, []).append((n, crc))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert wavelet.read_shards(wavelet.write_shards(empty_documents(spark), P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_wavelet_matrix_access_count_and_find():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 511, 512, 513, 4_000):
        x = rng.integers(0, 300, n)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x, np.array([n]), 9).to_bytes())
        assert (m.all() == x).all()
        assert all(m.access(i) == x[i] for i in range(0, n, 97))
        for token in (0, 5, 299, 400, 600):
            places = np.flatnonzero(x == token)
            assert m.count(token) == len(places)
            assert [m.find(token, k) for k in range(min(3, len(places)))] == places[:3].tolist()


def test_encoder_equals_the_library_on_every_kind_of_chunk():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = wavelet.Encoder(file.read(), limit=5)
    tokens = [t for t in (encoder.special or ["<none>"])][:2]
    texts = ["it's HE'LL we've'd 'tis", "  two   blanks \n\n lines\t", " é1a2—b…", "Ελληνικά Русский 中文字 العربية ไทย", " a  b c\x1cd", "é \U0001f600‍!",
             "½ ² Ⅷ ª º 1234567", "", " ", "x" * 5_000, *tokens, *(f"before {t}after {t}" for t in tokens)]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
