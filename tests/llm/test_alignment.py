"""Alignment against both libraries on whole texts and a plain scan of offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from odd import no_docs, odd_docs  # noqa: F401  fixtures
from taxomatch.llm import alignment
from taxomatch.llm.bpe_count import byte_symbols

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain(ends_a, ends_b):
    """Groups by their shared ends; links by comparing all spans."""
    cuts = sorted(set(ends_a) & set(ends_b))
    spans = lambda ends: list(zip([0, *ends], ends))
    out, at = [], 0
    for c in cuts:
        out.append(([i for i, e in enumerate(ends_a) if at < e <= c], [j for j, e in enumerate(ends_b) if at < e <= c]))
        at = c
    near = [(i, j) for i, (s, e) in enumerate(spans(ends_a)) for j, (u, v) in enumerate(spans(ends_b)) if s < v and u < e]
    return out, near


def test_groups_and_links_of_random_cuts():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2))
        want, near = plain(a, b)
        assert groups_of(a, b) == want
        assert links_of(a, b) == near and len(near) == len(a) + len(b) - len(want)


def groups_of(ends_a, ends_b):
    cut_a, cut_b = (x.tolist() for x in alignment.shared_cuts(np.array(ends_a), np.array(ends_b)))
    return [(list(range(i, k)), list(range(j, m))) for i, k, j, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]


def links_of(ends_a, ends_b):
    i, j, many = alignment.overlaps(np.array(ends_a), np.array(ends_b))
    assert many.tolist() == np.bincount(i, minlength=len(ends_a)).tolist()
    return list(zip(i.tolist(), j.tolist()))


@pytest.fixture(scope="module")
def whole():
    """text -> (A's ids, B's ids, groups, links) of the libraries on whole texts."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_symbols())}

    def of(text):
        if not text:
            return [], [], [], []
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        raw_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            return [], [], [], []
        ends = [[sum(map(len, r[:k + 1])) for k in range(len(r))] if len(r) < 500 else _ends(r) for r in (raw_a, raw_b)]
        if len(a) < 500:
            parts, near = plain(*ends)
        else:
            parts, near = groups_of(*ends), links_of(*ends)
        groups = [(ends[0][x[-1]], [a[i] for i in x], [b[j] for j in y]) for x, y in parts]
        return a, b, groups, [(a[i], b[j]) for i, j in near]

    def _ends(raws):
        out, at = [], 0
        for r in raws:
            at += len(r)
            out.append(at)
        return out

    return of


def test_groups_equal_the_libraries(odd_docs, whole):  # noqa: F811
    want, got = {}, {}
    for r in odd_docs.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append([(e, x, y) for e, x, y in whole(r.text)[2]])
    for r in alignment.align(odd_docs, A, B).collect():
        assert [g.start for g in r.groups] == [0, *[g.end for g in r.groups]][:len(r.groups)]
        got.setdefault(r.doc_id, []).append([(g.end, g.a, g.b) for g in r.groups])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_text_with_the_mark_of_spaces_has_no_tokens(spark, whole):
    docs = spark.createDataFrame([(1, "a ▁ b"), (2, "a b"), (3, "  a  b  "), (4, "a ▁")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.alignment_digests(docs, A, B).collect()}
    assert (got[1].n_a, got[1].n_groups, got[1].n_best, got[1].count_sum, got[1].groups_sha256) == (0, 0, 0, 0, "")
    assert got[2].n_a == len(whole("a b")[0]) and got[3].n_b == len(whole("  a  b  ")[1]) and got[4].n_links == 0


def test_digests_equal_brute_force(odd_docs, whole):  # noqa: F811
    rows = [(r.doc_id, *whole(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    count = Counter(p for *_, near in rows for p in set(near))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = {}
    for key, a, b, groups, near in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for _, x, y in groups)
        want.setdefault(key, []).append((len(a), len(b), len(groups), len(near), sum(count[p] == top[p[0]] for p in near), sum(count[p] for p in near),
                                         hashlib.sha256(text.encode()).hexdigest() if a else ""))
    got = {}
    for r in alignment.alignment_digests(odd_docs, A, B).collect():
        got.setdefault(r.doc_id, []).append((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in alignment.pair_counts(odd_docs, A, B).collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_a_line_with_a_bad_stretch_is_sent_again():
    t = alignment.Tokenizers(A, B)
    t.bytes_b[t.b.encode("odd")[-1]] = b"?"  # as if a model changed that piece
    good, a, b = t.encode(["one", "odd", "two", "▁"])
    assert good.tolist() == [True, False, True, False] and b.tolist() == t.b.encode("one two")


def test_empty_table(no_docs):  # noqa: F811
    assert alignment.align(no_docs, A, B).count() == alignment.alignment_digests(no_docs, A, B).count() == alignment.pair_counts(no_docs, A, B).count() == 0
