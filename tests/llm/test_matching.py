"""Near duplicates, decontamination and substring dedup against brute force."""

import random
import re

import xxhash
from test_words_and_rules import empty, spaced

from meterframe.llm import decontamination, simhash, substring_dedup

rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(60)] + ["Über", "été", "日本"]


def sentence(n, vocab=VOCAB):
    return " ".join(rng.choice(vocab) for _ in range(n))


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(texts):
    """Smallest id reachable over links of at most two bits."""
    fp = {i: fingerprint(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if group[j] < group[i] and (fp[i] ^ fp[j]).bit_count() <= 2:
                    group[i], changed = group[j], True
    return fp, group


def corpus():
    texts = [None, "", " \n", "One", "one two", "ONE  two\n", sentence(40), sentence(300), sentence(3000)]
    base = sentence(400)
    texts += [base, base.upper(), base + " tail", base.replace("w1 ", "w2 ", 1), base]
    for i in range(25):
        w = base.split(" ")
        w[i * 7] = "edit"
        texts.append(" ".join(w))
    texts += [sentence(20) for _ in range(20)]
    return texts


def test_simhash_equals_brute_force(spark):
    texts = corpus()
    fp, group = classes(dict(enumerate(texts)))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df.repartition(5)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fp % (1 << 64) == fp[r.doc_id], r.doc_id
        assert r.component_id == group[r.doc_id]
    left = simhash.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(group.values()))


def test_simhash_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (1, "other words are here"),
                                (None, None)], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5
    assert sorted((r.doc_id is None, r.component_id is None) for r in got) == \
        [(False, False)] * 3 + [(True, False), (True, True)]
    assert sorted(map(str, (r.text for r in simhash.deduplicate(df).collect()))) == \
        ["None", "a b c d", "other words are here"]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


def test_links_connect_every_pair_within_the_radius(spark):
    fps = {rng.getrandbits(63) for _ in range(30)}
    for f in list(fps):
        g = f
        for _ in range(4):
            for b in rng.sample(range(63), rng.randrange(1, 3)):
                g ^= 1 << b
            fps.add(g)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius in (0, 2, 4):
        edges = [(r.u, r.v) for r in simhash.links(df, radius).collect()]
        assert all((u ^ v).bit_count() <= radius for u, v in edges)
        root = {f: f for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x
        for u, v in edges:
            root[find(u)] = find(v)
        if radius < 4:
            assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= radius)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(30)]
    df = spark.createDataFrame(path + star, "u long, v long").repartition(3)
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100)}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(texts, items, window=13):
    out = {}
    for i, t in texts.items():
        w, hit, which = item_words(t), set(), set()
        for item, it in items:
            v = item_words(it)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit |= set(range(p, p + n))
                        which.add(str(item))
        out[i] = (len(w), len(hit), sorted(which))
    return out


def test_decontamination_equals_brute_force(spark):
    items = [(1, sentence(30)), (2, "only three words"), (3, None), (4, "..."), (5, sentence(13)), (11, "Word"),
             (6, "a a a a a a a a a a a a a a a a a")]
    items += [(7, items[0][1].upper()), (8, items[0][1])]
    first = items[0][1].split(" ")
    texts = [None, "", "!!!", sentence(50), " ".join(first[:13]), " ".join(first[:12]), sentence(20) + " " + items[0][1],
             "Only, three; WORDS. only three words", items[4][1] + " " + items[4][1], "word", "a " * 40, "a " * 12,
             sentence(400) + "\n" + " ".join(first[5:25]) + "\n" + sentence(400)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontamination.contamination(docs.repartition(3), bench)
    got = {r.doc_id: (r.n_words, r.n_hit or 0, list(r["items"] or []))
           for r in decontamination.word_count(docs).join(hits, "key", "left").collect()}
    want = contaminated(dict(enumerate(texts)), items)
    assert got == want
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == \
        [i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)]


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    some = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z"), (2, None)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert decontamination.decontaminate(some, nothing).count() == 4
    assert [r.doc_id for r in decontamination.decontaminate(some, bench).collect()] == [2]


def kept(texts, window):
    where = {}
    words = [spaced(t) for t in texts]
    for d, w in enumerate(words):
        for s in range(len(w) - window + 1):
            where.setdefault(tuple(w[s:s + window]), []).append((d, s))
    gone = [set() for _ in texts]
    for at in where.values():
        if len(at) > 1:
            for d, s in at:
                gone[d] |= set(range(s, s + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g))
            for w, g in zip(words, gone, strict=True)]


def check_substrings(spark, texts, window, phrase, shards=None):
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = substring_dedup.remove_repeated(df.repartition(4), window, phrase).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(kept(texts, window)))
    assert len(got) == len(texts)


def test_substrings_equal_brute_force(spark, monkeypatch):
    passage, other = sentence(80), sentence(50)
    texts = [None, "", "short", passage, "before " + passage + " after", sentence(30) + "\n" + passage[10:300],
             other + " " + other, "x " * 100, "x " * 36, "x " * 35, "x " * 34, sentence(35), sentence(400),
             passage.upper(), " ".join(passage.split(" ")[:34]), passage.replace(" ", "\t\n"), "y z " * 60]
    for i in range(12):                                      # near copies: runs that agree only in part
        w = (passage + " " + other).split(" ")
        w[9 * i + 3] = f"edit{i}"
        texts.append(" ".join(w))
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    check_substrings(spark, texts, 35, 8)
    check_substrings(spark, texts, 10, 3)


def test_substrings_random_small_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 1000)
    texts = [sentence(rng.randrange(0, 120), ["a", "b", "c"]) for _ in range(40)]
    check_substrings(spark, texts, 6, 2)
    check_substrings(spark, texts, 9, 9)


def test_substrings_digest_repeated_rows_and_empty_table(spark):
    text = sentence(50)
    df = spark.createDataFrame([(1, text), (1, text), (None, "z")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeated(df).collect())
    assert got == [(1, 0, "z"), (50, 50, ""), (50, 50, "")]
    assert substring_dedup.remove_repeated(df, digest=True).where("length(kept) = 64").count() == 3
    assert substring_dedup.remove_repeated(empty(spark)).count() == 0


def test_locate_splits_the_alphabet(monkeypatch):
    docs = [[b"a", b"b", b"c", b"d"], [b"x", b"c", b"d"], []]
    passages = [(b"a", b"b"), (b"c", b"d"), (b"q", b"r")]
    whole = substring_dedup.locate(docs, passages)
    monkeypatch.setattr(substring_dedup, "_ALPHABET", 2)
    for a, b in zip(whole, substring_dedup.locate(docs, passages), strict=True):
        assert a.tolist() == b.tolist()
    assert [m.tolist() for m in whole] == [[True] * 4, [False, True, True], []]
