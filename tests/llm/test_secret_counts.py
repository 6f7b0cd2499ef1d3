"""The secret scan's grammars count the values of all documents."""

import random
from collections import Counter

from meterframe.llm import secrets

rng = random.Random(3)


def run(chars, n):
    return "".join(rng.choice(chars) for _ in range(n))


def digits(n):
    return run("0123456789", n)


def letters(n):
    return run("ghijklmnopqrstuvwxyz", n)


def rare():
    return f"key_{digits(4)}_{letters(6)}_{digits(6)}"


def corpus(n_hex, n_rare, n_ordinary):
    texts = [f"token = {run('0123456789abcdef', 40)}" for _ in range(n_hex)]
    texts += [f"secret = {rare()}" for _ in range(n_rare)]
    return texts + ["see " + "_".join(rng.choice([letters, digits])(rng.randrange(3, 8)) for _ in range(5)) + " there"
                    for _ in range(n_ordinary)]


def test_a_rare_format_of_a_large_table_is_found(spark):
    lone = rare()
    texts = [*corpus(4000, 24, 3000), f"a {lone} alone"]          # 24 of 4024 credentials: 0.6 %
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    grammar = secrets.learn(df)
    assert grammar.score(lone) >= grammar.settings.bits
    last = secrets.scan(df, grammar).where(f"doc_id = {len(texts) - 1}").first()
    assert [tuple(s) for s in last.spans] == [("grammar", 2, 2 + len(lone))]


def test_trees_count_every_symbol_of_every_value(spark):
    texts = corpus(1500, 30, 2500) + ["see aaaaaaaaaaaaaaaaaaaa", None, ""] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    values = {i: set() for i in range(4)}
    for t in texts:
        base = secrets.base_spans(t or "")
        for kind, _, _, v in base:
            values[kind].add(v)
        values[3] |= {v for _, _, v in secrets.candidates(t or "", base)}
    trees = secrets.trees(df, 12)
    assert set(trees) == {i for i, v in values.items() if v}
    for label, tree in trees.items():
        strings = ["".join(secrets._CLASS[c][0] for c in v) for v in values[label]]
        assert sum(tree.ends) == len(strings) > 1000 or label == 1
        assert sum(tree.use.values()) == sum(map(len, strings))
        prefixes = Counter(s[:i] for s in strings for i in range(1, len(s) + 1))
        assert len(tree.seen) == 1 + sum(n >= 12 for n in prefixes.values())
        for node, n in enumerate(tree.seen):
            assert n == tree.ends[node] + sum(c for (at, _), c in tree.use.items() if at == node)
        automaton = secrets.merged(tree, 0.01, 12)
        for end, step in zip(automaton.end, automaton.step, strict=True):
            assert abs(2 ** end * (end > automaton.UNSEEN) + sum(2 ** p for _, p in step.values()) - 1) < 1e-9
