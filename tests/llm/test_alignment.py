"""Cross-tokenizer alignment against sets of end offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("matchloom.llm.queries")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from matchloom.llm import token_alignment as ta  # noqa: E402

DOCS = "doc_id long, text string, place string, row long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(ta.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.vocabulary("piece_bpe_32k.model"))


def brute(texts, both):
    """Groups and links from every token's byte range, pair counts from all documents at once."""
    a, b = both
    alphabet = ta.byte_alphabet()
    docs = []
    for text in texts:
        ranges = [[], []]
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            tokens = [[(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens)],
                      [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i)
                        else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]]
            if all(b"".join(t for _, t in side) == b" " + text.encode() for side in tokens):
                for out, side in zip(ranges, tokens):
                    at = 0
                    for i, t in side:
                        out.append((at, at + len(t), i))
                        at += len(t)
        shared = sorted({r[1] for r in ranges[0]} & {r[1] for r in ranges[1]})
        start, groups = 0, []
        for end in shared:
            groups.append("|".join(",".join(str(i) for s, t, i in side if start <= s and t <= end) for side in ranges))
            start = end
        links = [(i, j) for s, t, i in ranges[0] for u, v, j in ranges[1] if max(s, u) < min(t, v)]
        docs.append((len(ranges[0]), len(ranges[1]), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(n, top.get(i, 0))
    return [(na, nb, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for na, nb, groups, links in docs]


TEXTS = [None, "", " ", "a", "Hello world", "don't  stop\n\n\tnow ", "<|endoftext|> </s> <unk> <0x41>", "naïve café 漢字 🙂🙂 é",
         "▁ piece", "a\0b", "0123456789 3.1415", "unbelievably antidisestablishmentarianism " * 3, "Hello world", "​﻿x\x85y z"]


@pytest.mark.parametrize("held", [0, 10 ** 6])
def test_alignment_against_brute_force(spark, both, held):
    some = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts = TEXTS + [t[:1500] for t in some]
    rows = [(k if k % 7 else None, t, "clash", k) for k, t in enumerate(texts)] + [(3, "Hello world", "", 0)] * 2
    want = brute([r[1] for r in rows], both)
    got = ta.alignments(spark.createDataFrame(rows, DOCS), held_pairs=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        str((r[0], *w)) for r, w in zip(rows, want))
    assert ta.alignments(spark.createDataFrame([], DOCS)).count() == 0


def test_align_equals_end_sets_on_random_ends():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randint(1, 300)
        odds = rng.choice([0.02, 0.5, 0.9])
        base = {k for k in range(1, total) if rng.random() < 0.6}
        sides = [sorted({k for k in base if rng.random() > 0.1} | {k for k in range(1, total) if rng.random() < odds * 0.1} | {total})
                 for _ in range(2)]
        ends = [np.array(s, np.int64) for s in sides]
        out = ta.align(*ends, *ends)
        shared = np.array(sorted(set(sides[0]) & set(sides[1])))
        assert (ends[0][out.past_a - 1] == shared).all() and (ends[1][out.past_b - 1] == shared).all()
        assert len(out.past_a) == len(out.past_b) == len(shared)
        merged = np.array(sorted(set(sides[0]) | set(sides[1])))
        want = set(zip(np.searchsorted(ends[0], merged).tolist(), np.searchsorted(ends[1], merged).tolist()))
        assert sorted(want) == sorted(zip(out.link_a.tolist(), out.link_b.tolist()))


def test_long_texts_and_spans(spark, both):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(150_000))
    rows = [(1, long, "", 0), (2, " " * 300_000 + "x", "", 0), (3, "\n \t" * 100_000, "", 0), (4, "a" * 200_000, "", 0)]
    out = {r.row.doc_id: r for r in ta.align_documents(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        ids = both[0].encode(" " + text, add_special_tokens=False).ids
        assert out[i].a_ids == ids and out[i].b_ids == both[1].encode(text)
        assert [out[i].groups[-1].a_to, out[i].groups[-1].b_to] == [len(out[i].a_ids), len(out[i].b_ids)]
        assert all(x.a_to == y.a_from and x.b_to == y.b_from for x, y in zip(out[i].groups, out[i].groups[1:]))
