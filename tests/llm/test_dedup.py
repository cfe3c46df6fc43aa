import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import dedup


def brute_set(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=2, percent=80):
    sets = [(i, brute_set(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉ \n\x1c", max_size=30)), max_size=6), st.integers(1, 4))
def test_sets_equal_brute_force(texts, width):
    got, want = dedup.shingle_sets(texts, width), [brute_set(t, width) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for a, x in zip(got, want):
        for b, y in zip(got, want):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_minima_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 90, 3, 300, 2)]
    whole = dedup.minima(sets, 20)
    a, b = dedup.functions(20)
    for j, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        assert all(whole[k, j] == (x * a[k] + b[k]).min() for k in range(20))
    monkeypatch.setattr(dedup, "CHUNK", 32)
    assert (dedup.minima(sets, 20) == whole).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


def test_near_copies_chains_and_edges_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " \n", "One", "one", "one two", "ONE  two", "two one"]
    for edits in (1, 3, 6, 8):  # groups whose members lie at and around the threshold
        texts += variants(rng, [f"w{rng.randrange(400)}" for _ in range(80)], 25, edits)
    chain = [f"c{i}" for i in range(60)]
    for step in range(12):  # each is near the one before, the ends are far apart
        texts.append(" ".join(chain[:step * 4] and [f"d{i}" for i in range(step * 4)] + chain[step * 4 :] or chain))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows] + [(None, "one two", "x")] * 2, "doc_id long, text string, kept string")
    got = dedup.near_duplicates(df, width=2).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    kept = dedup.drop_near_duplicates(df, width=2)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (2, "A b c d"), (9, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df, width=2).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]


def test_one_row_of_a_repeated_document_stays(spark):
    rows = [(2, "a b c d", "y"), (2, "a b c d", "x"), (2, "other words of the same id", "x"), (5, "A b c d", "x"), (9, None, "x"), (9, None, "x")]
    rows += [(None, "one two three", "x")] * 3 + [(None, "four", "x"), (None, None, "x"), (None, None, "x"), (None, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = dedup.drop_near_duplicates(df, width=2)
    assert kept.columns == df.columns
    want = [(2, "a b c d", "x"), (2, "other words of the same id", "x"), (9, None, "x"), (None, "one two three", "x"), (None, "four", "x"), (None, None, "x"), (None, None, "x"), (None, " ", "x")]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


def test_no_text_is_lost_where_an_id_has_several(spark):
    rows = [(1, "alpha beta gamma"), (5, "Alpha beta gamma"), (5, "one two three"), (9, "one two  three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df, width=2).collect()) == [(1, 1, True), (5, 1, False), (5, 1, False), (9, 1, False)]
    assert sorted(map(tuple, dedup.drop_near_duplicates(df, width=2).collect())) == [(1, "alpha beta gamma"), (5, "one two three")]


def test_repeated_ids_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["", "lone"] + [t for edits in (1, 4, 7) for t in variants(rng, [f"w{rng.randrange(400)}" for _ in range(60)], 12, edits)]
    rows = [(rng.choice([rng.randrange(30), rng.randrange(1000)]), t) for t in texts + rng.sample(texts, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places = brute(list(enumerate(t for _, t in rows)))  # each row by itself
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, r) in places.items():
        a, b = find(rows[k][0]), find(rows[r][0])
        root[max(a, b)] = min(a, b)
    got = Counter(tuple(r) for r in dedup.near_duplicates(df, width=2).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == Counter((i, places[k][0], find(i) if t else i, not t or find(i) == i) for k, (i, t) in enumerate(rows))
    kept = [tuple(r) for r in dedup.drop_near_duplicates(df, width=2).collect()]
    assert not Counter(kept) - Counter(rows)
    component = {text: places[k][1] for k, (_, text) in enumerate(rows) if text}
    assert Counter(component[t] for _, t in kept if t) == Counter(set(component.values()))  # one text of each component


def pages(rng, n, share):
    """Pages of one template, of which `share` of 200 words is the template's."""
    own = [f"t{i}" for i in range(int(200 * share))]
    return [" ".join(own + [f"u{rng.randrange(100_000)}" for _ in range(200 - len(own))]) for _ in range(n)]


def test_pages_of_a_template_are_not_compared_all_with_all(spark, monkeypatch):
    compared = []
    agree = dedup.agree
    monkeypatch.setattr(dedup, "agree", lambda pairs, least: compared.append(pairs.count()) or agree(pairs, least))
    rng = random.Random(5)
    for share in (0.8, 0.86):  # similarities of 0.66 and 0.75: no link, but most pairs share a bucket
        texts = pages(rng, 600, share)
        near = [t.replace("t3 ", "changed ") for t in texts[:20]]  # and a near copy of some
        compared.clear()
        got = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string"), width=2).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i if i < 600 else i - 600 for i in range(620)}
        assert sum(compared) < 20 * 620


def test_links_between_components_that_no_star_shows(spark, monkeypatch):
    """With stars cut off, the prefix filter alone finds every link."""
    rng = random.Random(9)
    texts = pages(rng, 40, 0.86) + [t for edits in (2, 5, 8) for t in variants(rng, [f"w{rng.randrange(400)}" for _ in range(90)], 20, edits)]
    sets = [sorted(x.view(np.int64).tolist()) for x in dedup.shingle_sets(texts, 2)]
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "id long, root long, set array<long>")
    got = {(r.a, r.b) for r in dedup.prefix_pairs(df, 80).collect()}
    want = {(i, j) for j, t in enumerate(sets) for i, s in enumerate(sets[:j]) if 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))}
    assert want <= got and len(got) < 3 * len(want) + 40


def test_very_long_words_and_texts(spark):
    word, prose = "x" * 10_000_000, " ".join(f"w{i % 50_021}" for i in range(1_500_000))
    rows = [(1, word), (2, word), (3, word + "y"), (4, prose), (5, prose + " end"), (6, f"a {word} b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got[1] == got[2] == (1, 1) and got[3] == (1, 3) and got[6] == (2, 6)
    assert got[5][1] == got[4][1] == 4 and got[5][0] == got[4][0] + 1
