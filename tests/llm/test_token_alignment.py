"""Alignment of two tokenizers against a brute-force pass with the libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterframe.llm import pair_hash, queries, token_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    out, more = {}, 0
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE
        out[chr(b) if shown else chr(256 + more)] = b
        more += not shown
    return out


def aligned(libraries, text):
    """(ids of A, ids of B, groups, links) of one text, token by token."""
    a, b = libraries
    if not text:
        return [], [], [], []
    one = a.encode(" " + text, add_special_tokens=False)
    byte = letters()
    ids_a, ids_b = one.ids, b.encode(text)
    parts_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return [], [], [], []
    end_a, end_b = np.cumsum([*map(len, parts_a)]).tolist(), np.cumsum([*map(len, parts_b)]).tolist()
    links, groups, i, j, lo_a, lo_b = [], [], 0, 0, 0, 0
    while i < len(ids_a) and j < len(ids_b):
        links.append((ids_a[i], ids_b[j]))
        if end_a[i] == end_b[j]:
            groups.append((ids_a[lo_a:i + 1], ids_b[lo_b:j + 1]))
            lo_a, lo_b = i + 1, j + 1
            i, j = i + 1, j + 1
        elif end_a[i] < end_b[j]:
            i += 1
        else:
            j += 1
    return ids_a, ids_b, groups, links


def answers(libraries, texts):
    each = [aligned(libraries, t) for t in texts]
    count = Counter(x for *_, links in each for x in links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    return [(len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x),
             ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)) for a, b, g, x in each]


ODD = [None, "", " ", "a", "▁ of its own", "<|endoftext|> and <s> </s> <unk>", "日本語 \U0001f600 é", "two\n\nlines\t x",
       "\x00 zero", "same", "same", "x" * 20_000, "the cat sat on the mat. " * 3_000]


@pytest.mark.parametrize("at_once,group", [(1 << 21, 1 << 14), (64, 16)])
def test_alignment_equals_brute_force(spark, libraries, at_once, group):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string") \
        .withColumn("alignment", F.lit("kept")).withColumn("pair", F.lit(1)).repartition(3)
    got = token_alignment.alignment(df, at_once=at_once, group=group).orderBy("doc_id").collect()
    assert [tuple(r["alignment_"]) for r in got] == answers(libraries, ODD)
    assert {r["alignment"] for r in got} == {"kept"}


def test_query_equals_brute_force(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = answers(libraries, [r.text for r in rows])
    got = queries.op11_token_alignment(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [
        (r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
        for r, w in zip(rows, want, strict=True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.alignment(df).count() == 0


def test_units_are_encoded_as_the_libraries_encode_the_text(libraries):
    tokens = token_alignment.Tokenizers(token_alignment.Vocabularies())
    a, b = libraries
    parts = [f"a{c}b {c} {c}{c}x 1{c}2 '{c}s {c}" for c in map(chr, [*range(1, 0x300), 0x3042, 0x1F600, 0x2028, 0x1E9E2])]
    parts += ["don't we'll I'VE  two   three\n\n four \t five", "x\r\n y\u00a0z \u3000w", "Zażółć gęślą jaźń " * 20]
    for text in parts:
        units = tokens.units(text)
        ids_a, ids_b, first_a, _ = tokens.encode(units)
        assert ids_a.tolist() == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert ids_b.tolist() == b.encode(text), repr(text)
        assert (np.diff(first_a) > 0).all()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=400), st.integers(1, 6))
def test_hash_is_minimal_and_knows_its_keys(keys, n_groups):
    keys = np.array(sorted(keys), np.int64)
    group = pair_hash.group_of(keys, n_groups)
    table = pair_hash.PairHash.of([pair_hash.build(keys[group == g]) for g in range(n_groups)])
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (table.keys[slots] == keys).all()
    assert (table.slots(np.setdiff1d(keys + 1, keys)) == -1).all()
