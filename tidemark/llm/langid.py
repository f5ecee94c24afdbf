"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10).

Letters are lower-cased, everything else is a gap; n-grams of one to three
letters, gaps included, are hashed to a fixed number of buckets. Training counts
buckets per language over a sample of labelled rows whose size per language is
bounded, and takes the share of a language among all labelled rows as its prior;
the result is one log-probability matrix (buckets x languages), which is
broadcast: its size depends on parameters and on the number of languages, which
may be ``MOST_LANGUAGES`` at most. Scoring adds up matrix rows for the n-grams of
a batch in numpy; long texts are taken in parts that overlap by two characters,
so that their n-grams are those of the whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
equal scores go to the language that sorts first; with nothing to learn from
every text is ``und``; a null ``doc_id`` is not held out; repeated rows count and
are scored each for itself; an empty table gives no rows; other columns are
ignored; more languages than ``MOST_LANGUAGES`` are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches, crc_mod, pieces_by_bytes

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Training rows of a language, about: rows are kept by the hash of their id.
ROWS_A_LANGUAGE = 4000
SMOOTHING = 0.5
MOST_LANGUAGES = 1000
#: Characters of text that are turned to n-grams at once, and those that an n-gram reaches back.
PART, BACK = 1 << 19, 2
SCORED = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(letters: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that end at each place; ``buckets`` stands for none."""
    x = letters.astype(np.uint32)
    two = x * np.uint32(0x9E3779B1)
    two[1:] += x[:-1] * np.uint32(0x85EBCA6B)
    three = two.copy()
    three[2:] += x[:-2] * np.uint32(0xC2B2AE35)
    out = []
    for n, h in enumerate((x * np.uint32(0x27D4EB2F), two, three)):
        h = h ^ h >> np.uint32(15)
        h = h * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x165667B1)
        out.append(((h ^ h >> np.uint32(13)) % np.uint32(buckets)).astype(np.int32))
    # an n-gram counts where it ends in a letter, or (2 and 3) where a letter is followed by a gap
    solid = x > 0
    was = np.concatenate(([False], solid[:-1]))
    out[0][~solid] = buckets
    out[1][~(solid | was)] = buckets
    out[2][~(solid | was)] = buckets
    return out


def split_texts(texts: list[str | None], limit: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Parts of at most about ``limit`` characters: (row of each part, parts, characters at its begin that only lead in).

    A text has a gap before and after it; a long one is cut in several parts, each but the first led in by the end of the one before.
    """
    rows, parts, leads, total = [], [], [], 0
    for i, x in enumerate(texts):
        x = f" {x or ''} "
        for at in range(0, len(x), limit):
            lead = min(at, BACK)
            part = x[at - lead : at + limit]
            if total + len(part) > limit and parts:
                yield np.array(rows), parts, np.array(leads)
                rows, parts, leads, total = [], [], [], 0
            rows.append(i)
            parts.append(part)
            leads.append(lead)
            total += len(part)
    if parts:
        yield np.array(rows), parts, np.array(leads)


def part_grams(parts: list[str], leads: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Letters of all parts, their n-grams (none where a part only leads in), and where each part begins."""
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[raw]
    sizes = np.array([len(x) for x in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    ids = grams(letters, buckets)
    for k in range(BACK):
        at = begin[leads > k] + k
        for g in ids:
            g[at] = buckets
    return letters, ids, begin


def count_batches(batches: Iterator[pa.RecordBatch], languages: list[str], buckets: int, limit: int = PART) -> Iterator[pa.RecordBatch]:
    """lang, text -> for each language met, the buckets with a count."""
    place = {x: i for i, x in enumerate(languages)}
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for rows, parts, leads in split_texts(texts, limit):
            letters, ids, begin = part_grams(parts, leads, buckets)
            for r, a, b in zip(rows, begin, np.append(begin[1:], len(letters)), strict=True):
                own = counts.setdefault(place[langs[r]], np.zeros(buckets + 1, np.int64))
                for g in ids:
                    own += np.bincount(g[a:b], minlength=buckets + 1)
    for k, own in counts.items():
        used = np.flatnonzero(own[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([languages[k]] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "bucket", "n"])


class Model:
    """Languages in order and the log-probability matrix, its last row for 'no n-gram'."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def log_odds(self, texts: list[str | None], limit: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log joint of each language, and whether it has a letter."""
        out = np.zeros((len(texts), len(self.languages)))
        has = np.zeros(len(texts), bool)
        buckets = len(self.matrix) - 1
        for rows, parts, leads in split_texts(texts, limit):
            letters, ids, begin = part_grams(parts, leads, buckets)
            found = np.add.reduceat(letters > 0, begin, dtype=np.int64) > 0
            np.logical_or.at(has, rows, found)
            for k in range(len(self.languages)):
                column = np.ascontiguousarray(self.matrix[:, k])
                total = column[ids[0]]
                for g in ids[1:]:
                    total += column[g]
                np.add.at(out[:, k], rows, np.add.reduceat(total, begin, dtype=np.float64))
        return out + self.prior, has


def fit(labelled: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """Learn from (doc_id, lang, text) rows with a language."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.filter(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((buckets + 1, 0)), np.zeros(0))
    wide = 1 << 20
    limit = F.lit(0)
    for x in languages:
        limit = F.when(F.col("lang") == x, F.lit(min(wide, -(-wide * rows_a_language // sizes[x])))).otherwise(limit)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < limit).select("lang", "text")
    parts = sample.mapInArrow(lambda b: count_batches(b, languages, buckets), "lang string, bucket int, n long")
    total = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each language and bucket at most
    counts = np.full((buckets, len(languages)), SMOOTHING)
    place = {x: i for i, x in enumerate(languages)}
    counts[total.column("bucket").to_numpy(), [place[x] for x in total.column("lang").to_pylist()]] += total.column("n").to_numpy()
    matrix = np.log(counts / counts.sum(0))
    prior = np.log(np.array([sizes[x] for x in languages], float) / sum(sizes.values()))
    return Model(languages, np.vstack([matrix, np.zeros((1, len(languages)))]).astype(np.float32), prior)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (crc32 of the id, modulo 4, is 2), lang_pred and the posterior of that language."""
    spark = documents.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for batch in pieces_by_bytes(whole, 2, 1 << 22):
                n = batch.num_rows
                langs, scores = np.full(n, UNKNOWN, object), np.zeros(n)
                if m.languages:
                    joint, has = m.log_odds(batch.column(2).to_pylist())
                    best = joint.argmax(1)
                    odds = np.exp(joint - joint.max(1, keepdims=True))
                    langs[has] = np.array(m.languages, object)[best[has]]
                    scores[has] = (1 / odds.sum(1))[has]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, SCORED)


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and label all rows."""
    return predict(documents, fit(documents.filter(F.coalesce(crc_mod("doc_id", 4), F.lit(0)) != 2)))
