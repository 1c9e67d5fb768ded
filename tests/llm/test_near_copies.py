"""The pipeline's near-copy stage against brute force over five-word shingle sets."""

import random

import pytest
from test_operators import ODD, documents, sample

import corpus_pipeline
from quillframe.llm import near_copies


def five_words(t):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def brute_roots(texts):
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited():
    """Texts with one to four words changed, so that similarities lie on both sides of 0.8; some share a passage."""
    r, out = random.Random(4), []
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 90))]
        out.append(" ".join(words))
        for _ in range(6):
            other = list(words)
            for i in r.sample(range(len(words)), r.randint(1, 4)):
                other[i] = "changed"
            out.append(" ".join(other))
        out.append(f"{passage} x{k} " + " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(5, 30))))
    return out


@pytest.mark.parametrize("few", [4, 0])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, few):
    """With few = 0, all rounds of links to centres are made first."""
    monkeypatch.setattr(near_copies, "FEW", few)
    texts = ODD + sample(40) + edited()
    roots = brute_roots(texts)
    assert len(set(roots)) < len(roots) - 20
    got = corpus_pipeline.near_dedup(spark, documents(spark, texts), "")
    assert set(got.columns) == set(documents(spark).columns)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(roots))


def test_null_and_repeated_ids(spark):
    """One row of each group stays, whatever its id; rows of one id in different groups are judged on their own."""
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (3, b), (3, b), (9, a + " more"), (None, b + " more"), (None, "alone here"), (5, ""), (None, None), (7, " ")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, node string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(3, a), (3, b), (0, "alone here"), (5, "")])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_most_planted_near_copies_are_found_by_keys_or_prefixes(spark):
    """Recall on a real table against brute force: every pair that reaches 0.8 ends in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    roots = brute_roots([r.text for r in docs])
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    assert len(set(roots)) < len(docs)
    assert sorted(r.doc_id for r in got.collect()) == sorted(docs[i].doc_id for i in set(roots))


def grouped():
    """A text and 150 copies with two words changed, similar to it but not to each other; and a hundred pairs of near copies."""
    r, out = random.Random(9), []
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(100)]
    changed = lambda words, n: " ".join(f"x{r.randrange(10**6)}" if i in at else w for at in [r.sample(range(6, 94), n)] for i, w in enumerate(words))
    base = text()
    out += [changed(base, 2) for _ in range(75)] + [" ".join(base)] + [changed(base, 2) for _ in range(75)]
    for _ in range(100):
        words = text()
        out += [" ".join(words), changed(words, 1)]
    return out


def test_later_rounds_hold_only_large_groups(spark, tmp_path):
    """A shingle takes no further part once all its pairs are drawn; the text in the middle of a group links it at once."""
    texts = grouped()
    nodes = near_copies.noded(documents(spark, texts)).select("node", "text")
    got = near_copies.near_copies(nodes, str(tmp_path / "tables"))
    node = {r.text: r.node for r in nodes.collect()}
    of = {r.node: r.root for r in got.collect()}
    roots = brute_roots(texts)
    groups = lambda keys: {frozenset(i for i, k in enumerate(keys) if k == key) for key in set(keys)}
    assert groups([of.get(node[t], node[t]) for t in texts]) == groups(roots)
    tables = [spark.read.parquet(str(p)) for p in sorted((tmp_path / "tables").iterdir(), key=lambda p: int(p.name))]
    rows = [t.count() for t in tables if t.columns == ["sh", "node", "at", "c"]]
    assert len(rows) > 1 and sum(rows) < 1.6 * rows[0]


def test_many_texts_are_asked_for_by_bits(spark, monkeypatch):
    monkeypatch.setattr(near_copies.common, "BROADCAST_ROWS", 0)
    texts = edited()
    got = corpus_pipeline.near_dedup(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_roots(texts)))


def test_whole_sets_of_possible_pairs_only(spark):
    """Whole sets are made for texts of pairs that the counts by bins leave, and for no others."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(f"v{i}" for i in range(200)), 4: "short"}
    tables = []

    def saved(df):
        tables.append(df.localCheckpoint())
        return tables[-1]

    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a long, b long")
    found = near_copies.verified(pairs, spark.createDataFrame(list(texts.items()), "node long, text string"), 5, near_copies.exact(0.8), saved)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    sets = [{r.node: len(r["of"]) for r in t.collect()} for t in tables if t.columns == ["node", "of"]]
    assert [sorted(s) for s in sets] == [[1, 2, 3, 4], [1, 2]]
    assert max(sets[0].values()) < min(sets[1].values()) == 8 * 196


def test_sets_go_when_pairs_are_judged(spark, tmp_path):
    """Tables of texts' sets, the largest ones, don't stay until the stage ends."""
    nodes = near_copies.noded(documents(spark, edited())).select("node", "text")
    assert near_copies.near_copies(nodes, str(tmp_path / "tables")).count()
    columns = [spark.read.parquet(str(p)).columns for p in (tmp_path / "tables").iterdir()]
    assert ["sh", "node", "at", "c"] in columns and ["node", "of"] not in columns
