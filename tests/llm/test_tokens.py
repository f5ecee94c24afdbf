"""Tokenizer cache, packing and token store against the library itself."""

import random
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, token_store
from tidemark.llm._shared import staged_path
from tidemark.llm._tokens import CachedTokenizer
from tidemark.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "x\n\ny", "It's don't we'll", "ΑΣ ΟΔΟΣ", "İstanbul I", "á b ́c", "tab\tx \ty", "\x1c\x1d a\x1cb", "1,234.56 a,. b., c.", "<|endoftext|> q", "日本語 テスト。", "a\xa0b \xa0c", "😀 x", "² ½ a²", "ﬁ ŉ", "é.È, Ê", "K k Å"]


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cache_changes_no_id(path, monkeypatch):
    from tidemark.llm import _tokens

    monkeypatch.setattr(_tokens, "CACHE_BYTES", 100_000)
    monkeypatch.setattr(_tokens, "PART_CHARS", 64)
    rng = random.Random(5)
    letters = "aB é.,'\n\t  sS1²Σ!-́\xa0\x85"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choice(ODD) for _ in range(60)) for _ in range(20)]
    ours, library = CachedTokenizer(path), plain(path)
    for x in texts:
        assert array("I", ours.ids(x)).tolist() == library.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 1024): rng.randint(1, 3000) for _ in range(rng.choice([1, 5, 300]))}
    plan = packing.match_and_fit(counts, 1024)
    used: dict[int, int] = {}
    for items, number in plan:
        assert 0 < sum(items) <= 1024 and sum(3 * n > 1024 for n in items) <= 2
        for n in items:
            used[n] = used.get(n, 0) + number
    assert used == counts
    assert len(plan) < 8 * 1024
    for n, (ranks, first, slots, at) in packing.place_table(plan).items():
        assert ranks[0] == 0 and (at % 1 == 0).all() and (slots * n + at <= 1024).all()


def test_plan_is_close_to_the_bound():
    rng = random.Random(3)
    counts: dict[int, int] = {}
    for _ in range(20_000):
        n = rng.randint(1, 1023)
        counts[n] = counts.get(n, 0) + 1
    bins = sum(number for _, number in packing.match_and_fit(counts, 1024))
    assert bins <= 1.01 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.match_and_fit({0: 1}, 1024)
    assert packing.match_and_fit({}, 1024) == []
    assert packing.cut_lengths(1024, 1024) == [1024] and packing.cut_lengths(2050, 1024) == [2, 1024, 1024]


def rows():
    rng = random.Random(7)
    out = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "δέλτα", "x\ny"]) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    return out + [(60, None), (61, ""), (62, "long words " * 20_000), (3, out[3][1]), (None, "z"), (-5, " a  b ")]


def test_packing_documents(spark, docs):
    found = packing.pack(docs(rows()), BYTE).collect()
    library, texts = plain(BYTE), rows()
    whole: dict = {}
    for d, t in texts:
        whole.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    bins: dict[int, list] = {}
    for r in found:
        ids = whole[r.doc_id][0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in found) == sum(len(x) for v in whole.values() for x in v)
    for slots in bins.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs([]), BYTE).count() == 0


def test_token_store(spark, docs):
    path = staged_path(spark, "test-tokens")
    token_store.write(docs(rows()), path, WORD, partitions=5)
    found = sorted(token_store.digest(token_store.read(spark, path)).collect(), key=lambda r: r.start)
    library, start = plain(WORD), 0
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows()), key=lambda d: (d is not None, d or 0))
    for r in found:
        ids = library.encode(dict(rows())[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    lean = token_store.read(spark, path, ["doc_id", "start", "n_tokens"])
    assert "ids" not in lean._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    empty = staged_path(spark, "test-empty")
    token_store.write(docs([]), empty, WORD)
    assert token_store.digest(token_store.read(spark, empty)).count() == 0


def test_cache_is_bounded_by_bytes(monkeypatch):
    from tidemark.llm import _tokens

    monkeypatch.setattr(_tokens, "CACHE_BYTES", 50_000)
    ours = CachedTokenizer(BYTE)
    rng = random.Random(8)
    for _ in range(300):
        ours.ids(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 20, 5000]))) for _ in range(5)))
        for parts in (ours.first, ours.later):
            held = [*parts.items(), *parts.older.items()]
            assert sum(_tokens.CACHE_ENTRY + len(k) + len(v) for k, v in held) <= 50_000 and all(len(k) <= _tokens.CACHE_CHARS for k, _ in held)


def test_store_layout(spark, docs, tmp_path, monkeypatch):
    """Footers: dictionary or delta pages, row groups and pages of stated sizes, page indexes; a reader takes what it names."""
    import pyarrow.parquet as pq

    monkeypatch.setitem(token_store.LAYOUT, "parquet.block.size", str(1 << 18))
    monkeypatch.setitem(token_store.LAYOUT, "parquet.page.size", str(16 << 10))
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", str(rng.random())]) for _ in range(200))) for i in range(3000)]
    path = str(tmp_path / "store")
    token_store.write(docs(rows), path, WORD, partitions=2)
    groups = 0
    for file in (tmp_path / "store").glob("*.parquet"):
        footer = pq.ParquetFile(file).metadata
        groups += footer.num_row_groups
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            assert group.num_rows < 3000 / 2
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and column.has_column_index and column.compression == "ZSTD"
                if column.path_in_schema == "ids.list.element":
                    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
                if column.path_in_schema == "before":  # rising, without repeats: a dictionary doesn't pay
                    assert "DELTA_BINARY_PACKED" in column.encodings
    assert groups > 2
    plan = token_store.read(spark, path, ["doc_id", "n_tokens", "start"])._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("== Physical Plan ==")[1]
    some = token_store.read(spark, path).filter("doc_id = 77")
    assert "PushedFilters: [IsNotNull(part), IsNotNull(doc_id), EqualTo(doc_id,77)]" in some._jdf.queryExecution().toString() or "EqualTo(doc_id,77)" in some._jdf.queryExecution().toString()


def test_reading_shuffles_no_ids(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write(docs([(i, "a b c") for i in range(50)]), path, WORD, partitions=4)
    plan = token_store.digest(token_store.read(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError):
        token_store.write(docs([]), path, WORD, partitions=token_store.MOST_FILES + 1)
