"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import signature_join as J


def brute(rows):
    """Component of each row position by comparing all pairs of sets; equal ids are one node each."""
    import re

    def words(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

    def grams(w):
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    sets = [grams(words(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [None, "", "  \n", "a", "A", "b c", "B  c", "a b c d e", "a b c d e f", "é É", "x " * 3000]
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts += [common + " " + " ".join(rng.choice(vocabulary) for _ in range(n)) for n in range(3, 60, 2)]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(5, texts[5])]  # a repeated row


@pytest.mark.parametrize("block_sets", [4096, 8])
def test_components_match_all_pairs(spark, docs, block_sets):
    rows = corpus(1)
    found = J.similarity_components(docs(rows), block_sets=block_sets).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)


@pytest.mark.parametrize("block_sets", [4096, 8])
def test_every_link_is_counted(spark, docs, block_sets):
    rows = corpus(2)
    sets = [J.shingle_set(t) for _, t in rows]
    want = [sum(i != j and len(s) > 0 and len(t) > 0 and J.linked(s, t) for j, t in enumerate(sets)) for i, s in enumerate(sets)]
    found = J.link_counts(docs(rows), block_sets=block_sets).collect()
    assert sorted((r.doc_id, r.n_links) for r in found) == sorted((d, n) for (d, _), n, s in zip(rows, want, sets, strict=True) if len(s))


def test_empty_table(spark, docs):
    assert J.similarity_components(docs([])).count() == 0


def test_join_sets_equals_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = []
    for _ in range(150):
        keep = base[rng.random(300) > rng.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, rng.integers(1, 40), dtype=np.uint64)))))
    union, expected = J._Union(len(sets)), J._Union(len(sets))
    for i, j in J.join_sets(sets):
        assert J.linked(sets[i], sets[j])
        union.join(i, j)
    for i in range(len(sets)):
        for j in range(i):
            if J.linked(sets[i], sets[j]):
                expected.join(i, j)
    everything = np.arange(len(sets))
    assert (union.roots(everything) == expected.roots(everything)).all()


def levels(counts, row_bits=8):
    """Levels made of (hash, count) pairs, through the rows that travel."""
    cells = J.Cells(row_bits)
    hashes, n = (np.array(x, np.uint64) for x in zip(*counts, strict=True))
    order = np.argsort(hashes)
    values, n = J._runs(cells.upper(hashes[order]), n[order].astype(np.int64))
    sizes = J.bitmap_sizes(len(values), cells)
    bitmaps = [np.zeros(bits // 8, np.uint8) for bits in sizes]
    for row, payload, at in cells.pack(values):
        assert (cells.unpack(row, payload) == values[at]).all()
    for bitmap, bound in zip(bitmaps, J.BOUNDS, strict=True):
        bit = cells.place(values[n > bound], 8 * len(bitmap))
        np.bitwise_or.at(bitmap, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
    return J.Levels(cells, bitmaps)


@pytest.mark.parametrize("row_bits", [8, 17, 20])
def test_prefix_shares_a_shingle_with_every_partner(row_bits):
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, 3, dtype=np.uint64))))
        counted = levels([(x, rng.choice([2, 3, 9, 100, 70_000]) if x in a and x in b else rng.choice([1, 1, 5, 2000])) for x in np.union1d(a, b)], row_bits)
        if J.linked(a, b):
            assert np.intersect1d(J.prefix_of(a, counted), J.prefix_of(b, counted)).size


def test_levels_follow_the_counts(spark):
    texts = ["a b c d e"] * 6 + ["f g h i j", "f g h i j", "k l m n o"]
    cells = J.Cells(8)
    batch = [J.pa.RecordBatch.from_arrays([J.pa.array(texts)], ["text"])]
    out = [r for b in J._repeated_batches(iter(sorted_rows(J._sorted_batches(batch, cells))), cells) for r in b.to_pylist()]
    found = {int(v): level for r in out for v, level in zip(cells.unpack(r["row"], r["payload"]), r["levels"], strict=True)}
    assert found == {int(cells.upper(J.shingle_set(x))[0]): level for x, level in (("a b c d e", 2), ("f g h i j", 1))}


def sorted_rows(batches):
    table = J.pa.Table.from_batches(list(batches)).sort_by("row")
    return table.to_batches()


def test_boilerplate_does_not_tie_texts_to_one_family(spark, docs, monkeypatch):
    """Texts that share a long passage but are unrelated otherwise never meet in one block with those of another group."""
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = []
    for k in range(30):
        own = [f"o{k}_{i}" for i in range(60)]
        for c in range(3):
            words = list(own)
            words[rng.randrange(60)] = f"x{k}_{c}"
            rows.append((len(rows), shared + " " + " ".join(words)))
    sizes = []
    monkeypatch.setattr(J, "_join_blocks", lambda placed, n, labelled=False, was=J._join_blocks: sizes.append(placed.groupBy("block").count().collect()) or was(placed, n, labelled))
    found = J.similarity_components(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert max(r["count"] for r in sizes[0]) <= 3


def test_null_ids_and_very_long_texts(spark, docs):
    long = " ".join(f"v{i}" for i in range(300_000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "alone in the world it is"), (7, long), (8, long + " end"), (9, "a " * 40)]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similarity_components(docs(rows)).collect()), key=str)
    assert found == sorted([(None, 2, 3), (3, 2, 3), (None, 2, None), (7, 299_996, 7), (8, 299_997, 7), (9, 1, 9)], key=str)


def test_sql_gives_the_same_rows(spark):
    from oracle import connect, differences

    from tidemark.llm.queries import op1_signature_join, oracle_sql

    sf = "/root/testdata/sf0.01"
    assert differences(op1_signature_join(spark, sf), oracle_sql()["op1_signature_join"], connect(sf)) == []
