"""Word arrays, quality rules and token counts against plain Python."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library

from meterframe.llm import lexer, quality_rules, token_counts

TEXTS = [None, "", "   \n\t ", "one", "a b", "a b c", "a b c a b c a b c", "x " * 300,
         "Line one\nLine one\n \n Line one\n\nline two", "ein Wörter-Buch\x0bmit\x0cFormen\r\nund $$$ ### <b>",
         " not ascii　space", "the cat sat on the cat sat on the mat " * 20,
         "日本語 テキスト 日本語 テキスト 日本語 テキスト", "w" * 5000, " ".join(f"w{i}" for i in range(3000))]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(None, "null id here", None), (3, texts[3], "again"), (3, texts[3], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string") if extra else \
        spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_equal_pattern_and_hash_by_content():
    texts = [t for t in TEXTS] + ["tail", "one two", None, "a b c"]
    w = lexer.words(pa.array(texts, pa.string()))
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
    want = [x for t in texts for x in spaced(t)]
    assert got == want
    assert w.counts().tolist() == [len(spaced(t)) for t in texts]
    assert len(set(w.hash.tolist())) == len(set(want))
    by = {}
    for x, h in zip(want, w.hash.tolist(), strict=True):
        assert by.setdefault(x, h) == h
    low = lexer.words(pa.array(["Ab-cd ÉF\x007z_"]), lexer.ALNUM_WORDS, lower=True)
    assert [low.data[s:e].tobytes().decode() for s, e in zip(low.start, low.end, strict=True)] == ["ab", "cd", "Éf", "7z"]


def test_words_of_sliced_columns_and_slices_of_hashing(monkeypatch):
    texts = [f"alpha{i} beta {'g' * i}" for i in range(200)]
    whole = lexer.words(pa.array(texts))
    monkeypatch.setattr(lexer, "_SLICE", 64)
    assert (lexer.words(pa.array(texts)).hash == whole.hash).all()
    part = lexer.words(pa.array(texts).slice(50, 20))
    assert (part.hash == whole.hash[whole.first[50]:whole.first[70]]).all()
    ranges = list(lexer.blocks(pa.array(texts), 500))
    assert ranges[0][0] == 0 and ranges[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def brute_rules(text):
    w = spaced(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), len(lines), len(set(w)))


def test_measurements_equal_brute_force(spark):
    book = quality_rules.ledger(docs(spark)).collect()
    texts = {**dict(enumerate(TEXTS)), None: "null id here"}
    assert len(book) == len(TEXTS) + 3
    for r in book:
        n, chars, sym, dup, rep, lines, distinct = want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines,
                r.n_distinct_words) == want, r.doc_id
        fails = [n < 50, 100 * rep > 50 * n, 10 * sym > n, chars < 2 * n, chars > 15 * n, 100 * dup > 30 * lines,
                 100 * distinct < 5 * n]
        assert r.failed_bits == sum(1 << i for i, f in enumerate(fails) if f)
    assert quality_rules.ledger(empty(spark)).count() == 0


def test_ablation_equals_counting(spark):
    book = quality_rules.ledger(docs(spark))
    bits = [r.failed_bits for r in book.collect()]
    rules = [r.name for r in quality_rules.default_rules()]
    for r in quality_rules.ablation(book).collect():
        policy = next(p for p in quality_rules.POLICIES if (p.name, p.version) == (r.policy, r.version))
        mask, bit = quality_rules.mask_of(policy.rules), 1 << rules.index(r.rule)
        assert r.n_docs == len(bits)
        assert r.n_failed == sum(1 for b in bits if b & bit)
        assert r.n_only_this == sum(1 for b in bits if b & mask == bit)
        assert r.n_kept == sum(1 for b in bits if not b & mask)
        assert r.n_kept_without == sum(1 for b in bits if not b & mask & ~bit)
    assert quality_rules.ablation(quality_rules.ledger(empty(spark))).count() == 0


def test_rules_use_no_python(spark):
    plan = quality_rules.ledger(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def library():
    return Library.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_equal_library(spark, library):
    odd = ["<|endoftext|>x<|startoftext|> Hello'll I'm !!'s <|endoftext|", "ΑΣ ΑΣ' İI ſ K", "aaaa" * 200,
           "x　y z\x1cq\x85r 12345 3.14", "é ́ ño", "👍🏽👍 don't can't 'S 'LL"]
    texts = TEXTS + odd
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for chunk in (1 << 16, 40, 1):
        got = token_counts.count_tokens(docs(spark, texts), chunk=chunk)
        assert got.columns == ["doc_id", "text", "n_tokens", "n_tokens_"]       # the input has a column of that name
        rows = got.collect()
        assert len(rows) == len(texts) + 3
        for r in rows:
            assert r.n_tokens_ == (want[r.doc_id] if r.doc_id is not None else 3)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_every_character_counts_as_in_the_library(library):
    machine = token_counts.Tokenizer(token_counts.vocabulary())
    for c in [*range(0x3000), *range(0x3000, 0x34000, 13), *range(0xA640, 0xAC00), *range(0x1F300, 0x1F700)]:
        if not 0xD800 <= c < 0xE000:
            t = f"ab{chr(c)}cd 's"
            assert machine.count(t) == len(library.encode(t, add_special_tokens=False).ids), hex(c)


def test_chunk_maps_compose_associatively():
    t = token_counts.Tokenizer(token_counts.vocabulary())
    a, b, c = (t.chunk_map(x) for x in ("no", "thing to see", " here"))
    assert t.compose(t.compose(a, b), c) == t.compose(a, t.compose(b, c))
    assert t.count("nothing to see here" * 50, 7) == t.count("nothing to see here" * 50)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and np.uint64(1)
