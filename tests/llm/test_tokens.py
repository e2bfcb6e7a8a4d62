"""Token counts, BPE codec and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odd import no_docs, odd_docs  # noqa: F401  fixtures
from taxomatch.llm import bpe_codec, bpe_count, packing, wordids

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_tok():
    return Tokenizer.from_file(WORD)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def texts_by_id(docs):
    out = {}
    for r in docs.select("doc_id", "text").collect():
        out.setdefault(r[0], []).append(r[1] or "")
    return out


def test_counts_equal_the_library(odd_docs):
    tok = Tokenizer.from_file(BYTE)
    got, want = by_id(bpe_count.token_counts(odd_docs, BYTE, 20)), texts_by_id(odd_docs)
    assert got.keys() == want.keys()
    for key, texts in want.items():
        n = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
        assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got[key]) == sorted((len(t.encode()), k, k > 20) for t, k in zip(texts, n))


def test_merges_of_one_long_word():
    c = bpe_count.MergeCounter(BYTE)
    tok = Tokenizer.from_file(BYTE)
    for word in ("a" * 5000, "ab" * 3001, "thethethe" * 300, "zq", "z", ""):
        assert c.merge_count(word.encode()) == len(tok.encode(word, add_special_tokens=False).ids)


def test_codec_equals_the_library(odd_docs, word_tok):
    got, want = by_id(bpe_codec.encode_decode(odd_docs, WORD)), texts_by_id(odd_docs)
    for key, texts in want.items():
        ids = [word_tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert sorted((r.ids, r.decoded) for r in got[key]) == sorted((i, word_tok.decode(i, skip_special_tokens=False)) for i in ids)


def test_codec_digests(odd_docs):
    full, short = by_id(bpe_codec.encode_decode(odd_docs, WORD)), by_id(bpe_codec.encode_digests(odd_docs, WORD))
    for key, rows in full.items():
        want = [(len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows]
        assert sorted(tuple(r[1:]) for r in short[key]) == sorted(want)


def test_chunks_are_shared_wherever_they_stand():
    text = " ".join(f"word{k % 97}x{k % 31}" for k in range(3000)).encode()
    pieces = lambda raw: {bytes(x) for x in np.split(np.frombuffer(raw, "u1"), bpe_codec.borders(np.frombuffer(raw, "u1")))}
    a, b = pieces(text), pieces(b"something else before " + text + b" and after")
    assert len(a & b) > 0.95 * len(a)


def test_words_fall_back_to_a_fence(word_tok, monkeypatch):
    w = wordids.WordIds(WORD)
    monkeypatch.setattr(w, "pieces", lambda s: [])  # the numbers of pre-tokens never agree
    words = [b"don't", b"1a2", b"\xc3\xa9t\xc3\xa9!", b"\xe2\x80\x8b", b"plain"]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.of(words)] == [word_tok.encode(x.decode(), add_special_tokens=False).ids for x in words]


def test_packing_covers_every_id_once(odd_docs, word_tok):
    room, shard = 64, 5000
    rows = packing.pack(odd_docs, WORD, room, 1, shard_tokens=shard).collect()
    seqs, docs = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
    want = texts_by_id(odd_docs)
    assert docs.keys() == want.keys()
    for key, texts in want.items():
        ids = [word_tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert sum(r.length for r in docs[key]) == sum(map(len, ids))
        if len(texts) == 1:
            assert [x for r in sorted(docs[key], key=lambda r: r.start) for x in r.ids] == ids[0]
            assert {r.doc_tokens for r in docs[key]} == {len(ids[0])}
    # a task pads less than one sequence per shard
    total = sum(r.length for r in rows)
    assert len(seqs) * room - total < room * (3 + total // shard + 1)


def test_plan_is_balanced_and_greedy():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 400).tolist()
    plan = packing.plan_pieces(sizes, 256)
    fill, cost = {}, {}
    for _, _, n, s, _ in plan:
        fill[s] = fill.get(s, 0) + n
        cost[s] = cost.get(s, 0) + n + packing.QUADRATIC * n * n
    assert max(fill.values()) <= 256 and sum(fill.values()) == sum(sizes) and len(fill) == -(-sum(sizes) // 256)
    # by hand: room for 10; 7 and 6 open, 4 goes to the cheaper of the two, 3 to the other
    assert sorted((d, s) for d, _, _, s, _ in packing.plan_pieces([4, 7, 3, 6], 10)) == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_empty_tables(no_docs):
    assert bpe_count.token_counts(no_docs, BYTE, 1).count() == 0
    assert bpe_codec.encode_digests(no_docs, WORD).count() == 0
    assert packing.pack(no_docs, WORD).count() == 0
