"""Line dedup: what must go, what must stay."""

import random

from tidemark.llm import line_dedup as L


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)).capitalize() + "."


def passage(rng, words):
    out = []
    while sum(len(s.split()) for s in out) < words:
        out.append(sentence(rng, rng.randint(3, 12)))
    return " ".join(out)


def run(docs, rows):
    return {r.doc_id: r for r in L.deduplicate(docs(rows), "gone").collect()}


def test_later_copies_of_passages_go_and_the_rest_stays(spark, docs):
    rng = random.Random(5)
    shared = [passage(rng, 60) for _ in range(3)]
    own = {i: passage(rng, 80) for i in range(12)}
    rows = [(i, own[i] + ("\n" if i % 2 else " ") + shared[i % 3] + (" " if i % 4 else "\n") + passage(rng, 40)) for i in range(12)]
    out = run(docs, rows)
    for i, text in rows:
        assert out[i].text.startswith(own[i])
        assert (shared[i % 3] in out[i].text) == (i < 3)
        if i < 3:
            assert out[i].text == text and out[i].gone == 0
        else:
            assert not any(s in out[i].text for s in shared[i % 3].split(". ") if len(s) > 60)


def test_every_removed_line_stands_earlier(spark, docs):
    rng = random.Random(8)
    pool = [passage(rng, 30) for _ in range(8)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else passage(rng, 20) for _ in range(6))) for i in range(40)]
    out = run(docs, rows)
    seen: set[str] = set()
    for i, text in rows:
        kept = out[i].text
        for line in (x.strip() for part in text.split("\n") for x in part.replace(". ", ".\n").split("\n")):
            if line not in kept:
                assert line in seen
        seen.update(x.strip() for part in text.split("\n") for x in part.replace(". ", ".\n").split("\n"))
    assert sum(r.gone for r in out.values()) > 0


def test_short_repeats_stay(spark, docs):
    rng = random.Random(9)
    rows = [(i, passage(rng, 40) + "\nAll rights reserved.\n" + passage(rng, 40)) for i in range(10)]
    assert all(r.gone == 0 and r.text == dict(rows)[i] for i, r in run(docs, rows).items())


def test_repeats_inside_a_text_and_whole_copies(spark, docs):
    rng = random.Random(10)
    p = passage(rng, 50)
    rows = [(1, p + "\n" + passage(rng, 30) + "\n" + p), (2, p), (3, "\n".join(["the very same line again and again " * 4] * 50))]
    out = run(docs, rows)
    assert out[1].text.count(p) == 1 and out[1].text.startswith(p)
    assert out[2].text == "" and out[2].gone > 0
    assert out[3].text.count("again and again") == 4


def test_edges(spark, docs):
    rng = random.Random(11)
    p = passage(rng, 60)
    long = "\n".join(passage(rng, 40) for _ in range(2000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, p), (4, p), (None, "\u0001 odd. mark\n" + p), (6, long), (7, "no newline at all " * 20_000)]
    out = [(r.doc_id, r.text, r.gone) for r in L.deduplicate(docs(rows), "gone").collect()]
    assert len(out) == len(rows)
    by = {}
    for d, t, _ in out:
        by.setdefault(d, []).append(t)
    assert by[1] == [None] and by[2] == [""] and by[3] == ["\n\n"] and by[6] == [long]
    assert by[None] == [rows[5][1]] and by[4] == ["", ""]  # null sorts first and keeps its copy; equal rows share a result
    assert L.deduplicate(docs([])).count() == 0
    assert L.deduplicate(docs(rows), "gone").columns == [*docs([]).columns, "gone"]


def test_passages_whose_lines_stand_singly_earlier_go(spark, docs):
    rng = random.Random(12)
    lines = [sentence(rng, 12) for _ in range(5)]
    alone = [(i, sentence(rng, 15) + "\n" + lines[i % 5] + "\n" + sentence(rng, 15)) for i in range(6)]
    whole = [(i, sentence(rng, 15) + "\n" + "\n".join(lines) + "\n" + sentence(rng, 15)) for i in (6, 7)]
    out = run(docs, alone + whole)
    assert all(out[i].text == text and out[i].gone == 0 for i, text in alone + whole[:1])
    assert out[7].gone == 5 and not any(x in out[7].text for x in lines)


def test_removed_lines_equal_a_plain_search(spark, docs):
    rng = random.Random(13)
    pool = [sentence(rng, rng.choice([2, 5, 9, 13, 25])) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    seen, want = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        want[i] = set()
        for lo in range(len(lines)):
            for hi in range(lo, len(lines)):
                if sum(len(x.split()) for x in lines[lo : hi + 1]) >= L.RUN_WORDS or hi - lo >= L.REACH:
                    key = tuple(lines[lo : hi + 1])
                    want[i] |= set(range(lo, hi + 1)) if key in seen else set()
                    seen.add(key)
    out = run(docs, rows)
    for i, text in rows:
        assert out[i].gone == len(want[i])
        assert out[i].text.split() == " ".join(x for k, x in enumerate(text.split("\n")) if k not in want[i]).split()


def test_questions_exclamations_and_quoted_sentences_are_lines(spark, docs):
    rng = random.Random(14)
    rows, shared = [], {}
    for k, end in enumerate(("?", "!", '."', ".)", "?”", '.")')):
        shared[k] = " ".join(sentence(rng, 12)[:-1] + end for _ in range(5))
        rows += [(2 * k + j, f"{sentence(rng, 9)[:-1]} {sentence(rng, 9)} {shared[k]} {sentence(rng, 15)}") for j in (0, 1)]
    out = run(docs, rows)
    for k, p in shared.items():
        assert out[2 * k].gone == 0 and out[2 * k].text == rows[2 * k][1]
        assert out[2 * k + 1].gone == 5 and p[:40] not in out[2 * k + 1].text and p[-40:] not in out[2 * k + 1].text


def test_lines_do_not_depend_on_the_mark(spark, docs):
    text = 'One. Two? "Three!" (Four.) Five..."") Six.\nSeven\n\n \r\n e.g.no end? '
    rows = [(1, text), (2, text + "\u0001"), (3, "\u0001h\u0001p. \u0001")]
    got = {r.doc_id: r.lines for r in docs(rows).select("doc_id", L.lines_of("text").alias("lines")).collect()}
    assert got[1] == ["One. ", "Two? ", '"Three!" ', "(Four.) ", 'Five..."") ', "Six.\n", "Seven\n\n \r\n", " e.g.no end? "]
    assert got[2] == [*got[1], "\u0001"]
    assert got[3] == ["\u0001h\u0001p. ", "\u0001"]


def test_blank_lines_are_no_repeats(spark, docs):
    rng = random.Random(15)
    rows = [(i, sentence(rng, 9) + "\n" * 30 + sentence(rng, 9) + "\n   \n" * 30) for i in range(4)] + [(9, "\n" * 500_000), (10, "\n" * 500_000)]
    out = run(docs, rows)
    assert all(out[i].text == text and out[i].gone == 0 for i, text in rows)


def test_words_are_counted_between_any_number_of_spaces(spark, docs):
    rows = [(i, "two" + " " * 40 + "words.") for i in range(3)]
    assert all(r.gone == 0 for r in run(docs, rows).values())


def test_frequent_runs_are_ranked_in_parts(spark, docs, monkeypatch):
    rng = random.Random(16)
    p, q = passage(rng, 40), passage(rng, 25)
    rows = [(i, sentence(rng, 15) + "\n" + (p + "\n" if i != 1 else "") + sentence(rng, 14) + "\n" + q) for i in range(120)] + [(5, p + " another text of this id"), (119, None)]
    plain = sorted(L.deduplicate(docs(rows), "gone").select("doc_id", "text", "gone").collect(), key=str)
    monkeypatch.setattr(L, "SAMPLE", 1)
    monkeypatch.setattr(L, "SALTS", 3)
    assert sorted(L.deduplicate(docs(rows), "gone").select("doc_id", "text", "gone").collect(), key=str) == plain
    by = {r.doc_id: r.text for r in plain if r.doc_id != 5}
    assert p in by[0] and q in by[0] and all(p not in by[i] and q not in by[i] for i in by if i and i != 119)


def test_sql_gives_the_same_rows(spark):
    from oracle import connect, differences

    from tidemark.llm.queries import op6_line_dedup, oracle_sql

    sf = "/root/testdata/sf0.01"
    assert differences(op6_line_dedup(spark, sf), oracle_sql()["op6_line_dedup"], connect(sf)) == []
