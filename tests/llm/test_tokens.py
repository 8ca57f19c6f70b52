"""Packing, token files, BPE: against the tokenizers library and against themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm.bpe import PrefixEncoder, encode_decode
from lodeseek.llm.dac import Codes, round_trip
from lodeseek.llm.packing import best_fit_rules, pack, place
from lodeseek.llm.queries import tokenizer_path
from lodeseek.llm.word_cache import CachedEncoder

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "a\n\nb  c ", "x" * 3000, "Ä ö́ 中文 🙂\x85\xa0z", "<|endoftext|> and <|startoftext|>", "don't STOP\r\nnow", "same", "same", "ΣΑΣ İ ﬁ", "\x1c\x1f tab\t", "|" * 50, "un mot " * 5000]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def random_texts(n):
    rng = random.Random(5)
    alphabet = [*"abcXYZ '\n .,!|12é ß中́​\x85\xa0\x1c🙂", "  ", "<|endoftext|>", "'ll", "the ", "Σ"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def rows(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", 9) for i, t in enumerate(texts)], "doc_id long, text string, row string, score int")


def ids_of(texts, end):
    t = library(BYTES)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_cached_encoder():
    t, e = library(BYTES), CachedEncoder(BYTES, limit=50)
    texts = [x or "" for x in ODD] + random_texts(3000)
    for _ in range(2):
        for at in range(0, len(texts), 500):
            for x, ids in zip(texts[at : at + 500], e.encode(texts[at : at + 500]), strict=True):
                assert ids.tolist() == t.encode(x, add_special_tokens=False).ids


def test_prefix_encoder():
    t, e = library(WORDS), PrefixEncoder(WORDS, limit=50)
    texts = [x or "" for x in ODD] + random_texts(3000)
    for ids, shown, x in zip(*e.encode(texts), texts, strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert shown == t.decode(want, skip_special_tokens=False)


def test_encode_decode(spark):
    t = library(WORDS)
    got = {r["doc_id"]: r for r in encode_decode(rows(spark, ODD), WORDS).collect()}
    for i, x in enumerate(ODD):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_decode(rows(spark, ODD).limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**24), max_size=1500), st.lists(st.integers(0, 10**6), max_size=30))
def test_codes(ids, at):
    ids = np.array(ids, np.uint32)
    codes = Codes.encode(ids)
    codes = Codes.of(**codes.row())
    assert codes.read(np.arange(len(ids))).tolist() == ids.tolist()
    if len(ids):
        some = np.array(at, np.int64) % len(ids)
        assert codes.read(some).tolist() == ids[some].tolist()


def test_round_trip(spark):
    want, start = ids_of(ODD, 2), 0
    got = {r["doc_id"]: r for r in round_trip(rows(spark, ODD).repartition(3), BYTES, segment_ids=1000).collect()}
    assert len(got) == len(ODD)
    for i, ids in enumerate(want):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    again = rows(spark, ["a b"]).union(rows(spark, ["a b"])).union(rows(spark, [None]))
    assert sorted((r["doc_id"], r["start"]) for r in round_trip(again, BYTES).collect()) == [(0, 0), (0, 1), (0, 4)]
    nameless = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    assert sorted((r["start"], r["doc_id"]) for r in round_trip(nameless, BYTES).collect()) == [(0, None), (2, 1)]
    assert round_trip(rows(spark, []), BYTES).count() == 0


def sequential(lengths, capacity):
    """Best-fit decreasing, piece by piece: the remaining capacities, in order of opening."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_best_fit(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    rules = best_fit_rules(histogram, 20)
    bins = {}
    for n, count in histogram.items():
        seq, offset = place(rules, np.full(count, n), np.arange(count))
        for s, o in zip(seq.tolist(), offset.tolist(), strict=True):
            bins.setdefault(s, []).append((o, n))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 20
    want = sequential(lengths, 20)
    assert sorted(20 - sum(n for _, n in b) for b in bins.values()) == sorted(want)


def test_pack(spark):
    texts = ODD + ["common words in a text " * k for k in range(1, 60)]
    docs = rows(spark, texts)
    got = pack(docs.union(docs.where("doc_id = 9")), BYTES, end_id=0, capacity=64).toPandas()
    want = ids_of(texts, 0)
    for i, ids in enumerate(want):
        pieces = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert pieces.piece.tolist() == list(range(len(pieces)))
        assert pieces.start.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        assert pieces.length.sum() == len(ids) and (pieces.length[1:] == 64).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert len(got[got.doc_id == 9]) == 2
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        assert seq.length.sum() <= 64
    assert got.sequence_id.nunique() == len(sequential(got.length.tolist(), 64))
    assert pack(rows(spark, []), BYTES).count() == 0
    nameless = pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), BYTES).collect()
    assert [(r["doc_id"], r["length"]) for r in nameless] == [(None, 1)]


def test_wrong_vocabulary():
    with pytest.raises(ValueError):
        PrefixEncoder(BYTES)
