"""The corpus pipeline: each stage on what the one before kept."""

import random

import corpus_pipeline as P
from tidemark.llm import signature_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tidemark.llm._shared import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, step in P.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "test-stage")
        assert docs.columns == names, name
        assert 0 < docs.count() <= before
        before = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept
    assert sum(r.length for r in packed) <= 1024 * len({r.sequence_id for r in packed})


def test_run_equals_its_stages(spark):
    from tidemark.llm import _shared

    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), set(_shared._STAGED)
    out = sorted(P.run(spark, SF).collect())
    left = _shared._STAGED - before
    assert len(left) == 2 and sum("benchmark-decontamination" in p for p in left) == 1 and sum("pieces" in p for p in left) == 1  # what the result reads
    for _, step in P.STAGES:
        docs = _shared.stage(step(spark, docs, SF), "test-stage")
    assert out == sorted(docs.collect()) and out and P.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in P.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.count() == 0


def clashing(spark, rows):
    """Documents with odd rows and further columns named as the stages name theirs."""
    full = [(i, t, "en", "s", len(t) if t is not None else None, 0.5, 3, "x", -1, "y") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, removed_lines int, leaks string, component_id long, _row string")


def texts(seed=3):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(60)) for _ in range(n))
    base = [say(40) for _ in range(6)]
    near = [x.rsplit(" ", 1)[0] + " other" for x in base]
    return say, base, near


def test_one_row_of_each_component_stays(spark):
    say, base, near = texts()
    rows = [(5, base[0]), (5, say(30)), (3, near[0]), (3, near[0]), (3, near[0]), (9, near[0]), (None, base[1]), (None, base[1]), (None, near[1]), (None, say(20)), (8, None), (8, None), (8, ""), (1, " \n"), (1, " \n"), (4, near[2]), (4, base[2]), (6, base[2])]
    kept = signature_join.keep_one_of_each(clashing(spark, rows))
    assert kept.columns == clashing(spark, []).columns
    out = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    sets = [signature_join.shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and signature_join.linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    components: dict = {}
    for i in range(len(rows)):
        components.setdefault(root(i), []).append(i)
    want = []
    for members in components.values():
        least = min(rows[i][0] if rows[i][0] is not None else 1 << 60 for i in members)
        chosen = {rows[i] for i in members if (rows[i][0] if rows[i][0] is not None else 1 << 60) == least}
        want.append(chosen)
    assert len(out) == len(want)
    for chosen in want:  # of equal ids the text's hash decides
        assert sum(r in chosen for r in out) >= 1
    assert out.count((3, near[0])) == 1 and out.count((8, None)) == 2 and out.count((1, " \n")) == 2 and (5, base[0]) not in out


def test_stages_take_nulls_ties_and_repeated_rows(spark, tmp_path):
    say, base, near = texts(4)
    rows = [(1, None), (1, ""), (None, base[0]), (None, say(30)), (2, base[1]), (2, base[1]), (2, near[1]), (3, near[0]), (7, "word " * 30_000), (9, base[3] + ". " + base[4] + ". "), (10, say(9) + ". " + base[3] + ". " + base[4] + ".")]
    spark.createDataFrame([(2, 1, 0), (3, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, base[5]), (1, base[5]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing(spark, rows + [(20, say(40) + " " + base[5] + " " + say(40))])
    for name, step in P.STAGES[1:-1]:  # one by one, each on all rows
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.select("doc_id", "text", "n_chars", "score", "component_id").collect()
        assert all(r.score == 0.5 and r.component_id == -1 for r in found)
        if name == "line dedup":
            assert {(r.doc_id, r.text) for r in found if r.doc_id == 10} == {(10, rows[-1][1].split(". ")[0] + ". ")}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        if name == "benchmark decontamination":
            assert len(found) == len(rows)
    kept = P.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() <= len(rows) + 1
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    places: dict = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
