"""Alignment of tokens against a merge written out token by token."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hearthway.llm import token_alignment
from hearthway.llm.token_alignment import Aligner, Merged, links, lockstep

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, n_a string"


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, models):
    """The contract's columns from plain loops."""
    a_model, b_model = models
    of = token_alignment.byte_level()
    docs = []
    for doc_id, text in rows:
        text = text or ""
        want = (" " + text).encode()
        a = [(i, bytes(of[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in b_model.encode(text) if text else []:
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        groups, ea, eb, ga, gb, j = [], 0, 0, [], [], 0
        for i, raw in a:
            ea += len(raw)
            ga.append(i)
            while eb < ea and j < len(b):
                eb += len(b[j][1])
                gb.append(b[j][0])
                j += 1
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((doc_id, len(a), len(b), groups))
    seen = collections.Counter(p for *_, groups in docs for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    most = collections.defaultdict(int)
    for (x, _), n in seen.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, n_a, n_b, groups in docs:
        all_links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(all_links), sum(seen[p] == most[p[0]] for p in all_links), sum(seen[p] for p in all_links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def key(row):
    return [str(x) for x in row]


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


def aligned(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in token_alignment.align(docs, A, B).collect()), key=key)


def test_odd_documents(spark, tmp_path, models):
    odd = ["", None, " ", "a", "a", "a  b", " a", "a ", "\n\n\tx  \n y", "▁a b", "<|endoftext|> <s></s> <0x41>", "naïve 你好 안녕 \U0001f600\U0001f600", "\x00\x01", "ab" * 3000, " " * 999, "　ﬁ１", "don't  we'll\r\n", "word " * 20000]
    rng = random.Random(5)
    odd += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "가", "▁", "ing", "<|", "1", "The"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(odd)] + [(3, "a"), (3, "a")]
    spark.createDataFrame([(i, t, None, None, 0, "x", "y") for i, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    assert aligned(spark.read.parquet(str(tmp_path / "d"))) == sorted(brute(rows, models), key=key)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e"))
    assert aligned(spark.read.parquet(str(tmp_path / "e"))) == []


def test_given_documents(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert aligned(docs) == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], models), key=key)


def test_stretches_and_wide_groups():
    rng = np.random.default_rng(2)
    for stretch in (1, 3, 64, 10**6):
        docs = [np.unique(rng.integers(1, 200, 90)) for _ in range(5)]
        a = np.concatenate([np.append(d[d < 200][::2], 200) + 200 * i for i, d in enumerate(docs)])
        b = np.concatenate([np.append(d[d < 200][::3], 200) + 200 * i for i, d in enumerate(docs)])
        got = lockstep(a, b, 200 * np.arange(6), stretch)
        both = np.intersect1d(a, b)
        assert (a[got.a_stop - 1] == both).all() and (b[got.b_stop - 1] == both).all()
    a_ids, b_ids = rng.integers(0, 9, 300), rng.integers(0, 9, 400)
    key, times = links(Merged(np.array([100, 101, 300]), np.array([200, 202, 400])), a_ids, b_ids, np.array([0, 1, 1]))
    want = collections.Counter()
    for doc, sa, sb in ((0, slice(0, 100), slice(0, 200)), (1, slice(100, 101), slice(200, 202)), (1, slice(101, 300), slice(202, 400))):
        want.update(doc << 32 | int(x) << 16 | int(y) for x in a_ids[sa] for y in b_ids[sb])
    assert dict(zip(key.tolist(), times.tolist(), strict=True)) == want


def test_spans_cover_the_text():
    aligner = Aligner(A, B)
    out = aligner.block(["The naïve word", None, "ing ing"], spans=True)
    assert [list(x)[-1:] for x in out["byte_cuts"]] == [[len(" The naïve word".encode())], [], [8]]
    assert [len(x) for x in out["a_cuts"]] == out["n_groups"] and [x[-1] for x in out["b_cuts"] if len(x)] == [out["n_b"][0], out["n_b"][2]]
