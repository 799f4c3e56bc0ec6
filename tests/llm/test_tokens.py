"""Operators 1 and 5 against the public libraries."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe

from ..conftest import DATA

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = [None, "", " ", "  \n\n  x", "don't we'll I'M they've 'tis", "a" * 5000, "ab " * 3000, "12345 67.8", "日本語のテキスト", "é\u0301 ñ", "\u00a0\u2003x", "<|endoftext|>", "a<|endoftext|> b", "\t\tif x:\n\t\t\treturn", "🙂🙂🙃", "x" * 300 + "'s"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stmdrevlLSé1٣_-\u00a0\u3000\u0301中"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_pieces_as_the_pattern_has_them(text):
    (pieces, bounds), = bpe.split_pieces([text])
    assert pieces == regex.findall(P.PATTERN, text)
    assert bounds[-1] == len(text)


def test_ids_and_round_trip(spark, tik):
    texts = [*HARD, *(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("other", F.lit(1))
    got = {r.doc_id: r for r in bpe.with_bpe(df, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tik.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].other == 1
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_counts_as_the_library(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*HARD, *(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.with_token_counts(df, P.path("byte_bpe_50k.json")).collect():
        t = texts[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
        assert r.fit_chars == len(t) if n <= 1024 else len(lib.encode(t[: r.fit_chars], add_special_tokens=False).ids) <= 1024


def test_prefix_counts_are_those_of_each_prefix(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["don't  stop\n\n now's it", "x<|endoftext|>y  <|endo", "naïve 🙂 café  ", "internationalisation 2024"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.with_token_counts(df, P.path("byte_bpe_50k.json"), limit=5, prefixes=True).collect():
        t = texts[r.doc_id]
        assert r.prefix_counts == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.with_bpe(none, PATH).count() == 0 and bpe.with_token_counts(none, P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("alike", [False, True])
def test_distinct_pieces_are_merged_side_by_side(tik, monkeypatch, alike):
    """Only long pieces go one by one; pieces of equal hash are not taken for one another."""
    texts = [t or "" for t in HARD] + ["xqzj qqxz zzqj", "zyxw qqxz", "wxyz"]
    merge, alone = bpe.Vocabulary.merge, []
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, piece: alone.append(piece) or merge(self, piece))
    if alike:
        monkeypatch.setattr(bpe, "spans_hash", lambda buf, begins, ends: np.zeros(len(begins), np.uint64))
    for text, (ids, said, decoded, bounds) in zip(texts, bpe.encode(texts, PATH), strict=True):
        assert ids.tolist() == tik.encode_ordinary(text)
        assert bytes(said).decode() == " ".join(map(str, ids.tolist())) and bytes(decoded).decode() == text
        assert bounds.tolist() == bpe.split_pieces([text])[0][1].tolist()
    assert alone and min(map(len, alone)) > bpe.LONG
