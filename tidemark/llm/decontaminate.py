"""Benchmark decontamination with a block-max BM25 index (operator 3).

The test items, not the corpus, are indexed: an inverted index of BM25 impacts,
scaled so that an item scores 1 against itself, with the largest impact of every
term in every block of items that holds it. Each training text is cut into
overlapping passages of words, and every passage is a query that asks for all
items above a threshold. As in block-max WAND, the passage's terms are ordered by
their largest impact; those before the pivot can't reach the threshold among
themselves, so only blocks that hold one from the pivot on are looked at, and of
these only blocks whose maxima add up to the threshold are opened. All passages
of a text move together, term by term over the blocks' maxima, in numpy. What
comes through is checked: question and answer of the item must both be found in
the text around the passage, by word trigrams (parts of one or two words by
themselves, word for word).

Document frequencies, mean length and the width of passages are taken over all
items, so what is found doesn't depend on how the index is dealt. It is dealt to
shards of about ``SHARD_ITEMS`` items and ``SHARD_CHARS`` characters; the driver
makes one at a time, a worker holds ``HELD_SHARDS`` at once, and ``PASS_SHARDS``
of them are broadcast for one pass over the corpus.

Defined results: items and texts that are null or have no word match nothing;
items with equal texts or ids are found each for itself; one row per document row
and item, the best passage; ties in score go to the first passage; rows that
repeat a ``doc_id`` or have none are treated each for itself; texts of any length
are searched whole; an empty benchmark leaves every document, an empty corpus
gives no rows; other columns are carried along by ``remove_leaked``, whatever
their names, and ignored by ``leaked_items``; a threshold of 0 or less is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import bounded_batches, fresh, shingle_hashes, stage, text_of, unstage, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK_ITEMS = 8
SHARD_ITEMS, SHARD_CHARS = 2000, 4_000_000
#: Shards searched in one pass over the corpus, and those that a worker holds at once.
PASS_SHARDS, HELD_SHARDS = 16, 2
GRAM = 3
#: Share of the question's and of the answer's trigrams that the text must hold.
OVERLAP = 0.5
ANSWER_WORDS = 5
#: Words of a text whose passages are bounded at a time.
TEXT_WORDS = 1 << 16
LEAK = T.ArrayType(T.StructType().add("item_id", "long").add("score", "double").add("question_overlap", "double").add("answer_overlap", "double").add("first_word", "long"))

#: ASCII punctuation parts words; letters of other scripts stay.
_PLAIN = bytes(32 if not chr(c).isalnum() and c < 128 else c for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> np.ndarray:
    return word_hashes(text.encode("utf-8", "surrogatepass").translate(_PLAIN))


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the two parts of an item: the answer is what follows the last
    question mark, else the last sentences up to at least five words."""
    question, mark, answer = text.rpartition("?")
    if not mark or not len(words_of(answer)):
        sentences = _SENTENCE.split(text.strip())
        answer = sentences.pop()
        while sentences and len(words_of(answer)) < ANSWER_WORDS:
            answer = sentences.pop() + " " + answer
        question = " ".join(sentences)
    q, a = words_of(question), words_of(answer)
    both = np.concatenate((q, a))
    cut = len(q)
    if not cut:  # one sentence: its last quarter answers
        cut = len(both) - len(both) // 4
    if len(both) >= 2 * GRAM:  # neither part is shorter than a trigram
        cut = min(max(cut, GRAM), len(both) - GRAM)
    else:
        cut = len(both)
    return both[:cut], both[cut:]


@dataclass(frozen=True)
class Statistics:
    """What is counted over all items: those with a word, their mean and largest number of words."""

    items: int
    mean: float
    longest: int

    @property
    def stride(self) -> int:
        return max(32, self.longest)

    @property
    def width(self) -> int:
        return self.stride + self.longest


class Index:
    """BM25 impacts of a shard of items: (id, text) each; ``terms`` and ``frequency`` are counted over all items."""

    def __init__(self, items: list[tuple[int, str]], of: Statistics, terms: np.ndarray, frequency: np.ndarray):
        parts = [(i, *question_and_answer(t)) for i, t in items]
        parts = [(i, q, a) for i, q, a in parts if len(q) + len(a)]
        self.items = [i for i, _, _ in parts]
        self.questions = [_part(q) for _, q, _ in parts]
        self.answers = [_part(a) for _, _, a in parts]
        self.stride, self.width = of.stride, of.width
        self.terms = terms
        self.blocks = -(-len(parts) // BLOCK_ITEMS)
        if not parts:
            return
        words = [np.concatenate((q, a)) for _, q, a in parts]
        lengths = np.array([len(w) for w in words], np.int64)
        rows, columns, counts = [], [], []
        for k, w in enumerate(words):
            term, count = np.unique(np.searchsorted(self.terms, w), return_counts=True)
            rows.append(term), columns.append(np.full(len(term), k)), counts.append(count)
        term, item, count = map(np.concatenate, (rows, columns, counts))
        idf = np.log1p((of.items - frequency + 0.5) / (frequency + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[item] / of.mean))
        impact /= np.bincount(item, impact, len(parts))[item]
        # postings by block: the terms that occur in it and their impacts on its items
        self.block_terms, self.block_impacts = [], []
        in_block = np.argsort(item // BLOCK_ITEMS, kind="stable")
        edges = np.searchsorted((item // BLOCK_ITEMS)[in_block], np.arange(self.blocks + 1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = in_block[lo:hi]
            terms, row = np.unique(term[own], return_inverse=True)
            impacts = np.zeros((len(terms), BLOCK_ITEMS), np.float32)
            impacts[row, item[own] % BLOCK_ITEMS] = impact[own]
            self.block_terms.append(terms)
            self.block_impacts.append(impacts)
        # the other way round: for each term its blocks and the largest impact in each
        holder = np.concatenate([np.full(len(t), k) for k, t in enumerate(self.block_terms)])
        held = np.concatenate(self.block_terms)
        largest = np.concatenate([x.max(1) for x in self.block_impacts]).astype(np.float64)
        order = np.argsort(held, kind="stable")
        self.post_block, self.post_max = holder[order], largest[order]
        self.post_at = np.searchsorted(held[order], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.post_max, self.post_at[:-1])

    def scores(self, terms: np.ndarray, block: int) -> np.ndarray:
        """Exact scores of the items of one block for a set of terms."""
        place = np.minimum(np.searchsorted(self.block_terms[block], terms), len(self.block_terms[block]) - 1)
        return self.block_impacts[block][place[self.block_terms[block][place] == terms]].sum(0, dtype=np.float64)

    def opened(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs that may hold an item at the threshold; rows are sorted by passage."""
        # by largest impact within a passage, smallest first: from the pivot on the sum has reached the threshold
        most = self.term_max[term]
        order = np.lexsort((most, passage))
        total = np.cumsum(most[order])
        begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        before = np.concatenate(([0.0], total))[begin]
        sizes = np.diff(np.append(begin, len(passage)))
        pivoted = np.empty(len(term), bool)
        pivoted[order] = total - np.repeat(before, sizes) >= threshold - 1e-9
        live = np.repeat(np.logical_or.reduceat(pivoted, begin), sizes)
        passage, term, pivoted = passage[live], term[live], pivoted[live]
        if not len(term):
            return term, term
        # term by term over the maxima of the blocks that hold it
        lists = self.post_at[term + 1] - self.post_at[term]
        at = np.repeat(self.post_at[term] - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
        key = np.repeat((passage - passage[0]) * self.blocks, lists) + self.post_block[at]
        if (n := int(passage[-1] - passage[0] + 1) * self.blocks) <= 4 * len(key):
            bound, reached = np.bincount(key, self.post_max[at], n), np.bincount(key, np.repeat(pivoted, lists), n)
            found = np.flatnonzero((bound >= threshold - 1e-5) & (reached > 0))
        else:
            keys, row = np.unique(key, return_inverse=True)
            bound, reached = np.bincount(row, self.post_max[at]), np.bincount(row, np.repeat(pivoted, lists))
            found = keys[(bound >= threshold - 1e-5) & (reached > 0)]
        return passage[0] + found // self.blocks, found % self.blocks

    def candidates(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(first word of a passage, item, score) of everything at or above ``threshold``."""
        if threshold <= 0:
            raise ValueError("the threshold must be positive")
        for base in range(0, max(1, len(words)), TEXT_WORDS - TEXT_WORDS % self.stride or self.stride):
            part = words[base : base + TEXT_WORDS + self.width]
            place = np.minimum(np.searchsorted(self.terms, part), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[place] == part)
            if not len(known):
                continue
            # a word lies in the passage of its own stride and, near the start of a stride, in those before
            first = known // self.stride
            keys = [first * len(self.terms) + place[known]]
            for back in range(1, -(-self.width // self.stride)):
                early = (first >= back) & (known - (first - back) * self.stride < self.width)
                keys.append((first[early] - back) * len(self.terms) + place[known[early]])
            passage, term = np.divmod(np.unique(np.concatenate(keys)), len(self.terms))
            step = max(1, (1 << 22) // max(1, self.blocks * 64))  # passages whose bounds are held at once
            for low in range(int(passage[0]), int(passage[-1]) + 1, step):
                a, b = np.searchsorted(passage, (low, low + step))
                if a == b:
                    continue
                for p, block in zip(*self.opened(passage[a:b], term[a:b], threshold), strict=True):
                    own = slice(*np.searchsorted(passage, (p, p + 1)))
                    scores = self.scores(term[own], int(block))
                    for k in np.flatnonzero(scores >= threshold):
                        yield base + int(p) * self.stride, int(block) * BLOCK_ITEMS + int(k), float(scores[k])

    def leaks(self, words: np.ndarray, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[dict]:
        """The items that a text holds: best passage of each, question and answer verified."""
        if not len(words) or not self.items:
            return []
        best: dict[int, tuple[float, int]] = {}
        checked: dict[int, tuple[float, float]] = {}
        for at, item, score in self.candidates(words, threshold):
            around = words[max(0, at - self.stride) : at + self.width + self.stride]
            found = _share(self.questions[item], around), _share(self.answers[item], around)
            if min(found) >= overlap and (item not in best or score > best[item][0]):
                best[item], checked[item] = (score, at), found
        return [{"item_id": self.items[k], "score": s, "question_overlap": checked[k][0], "answer_overlap": checked[k][1], "first_word": at} for k, (s, at) in best.items()]


def _part(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The width and the distinct grams of a question or an answer: trigrams, or all of a shorter one."""
    return min(GRAM, len(words)), np.unique(shingle_hashes(words, GRAM))


def _share(part: tuple[int, np.ndarray], around: np.ndarray) -> float:
    """Share of a part's grams found; a part without words is no hindrance."""
    width, grams = part
    if not width:
        return 1.0
    return float(np.isin(grams, shingle_hashes(around, width)).mean()) if len(around) >= width else 0.0


def _described_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(x) for x in text_of(batch.column(1))]
        terms = pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), terms], [*batch.schema.names, "n_words", "terms"])


def indexes(benchmark: DataFrame, shard_items: int | None = None) -> Iterator[Index]:
    """The test items in bounded shards, each with the statistics of all; the driver makes one at a time."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    described = stage(items.mapInArrow(_described_batches, "item_id long, text string, n_words long, terms array<long>").filter("n_words > 0"), "test-items")
    n, mean, longest, chars = described.agg(F.count("*"), F.avg("n_words"), F.max("n_words"), F.sum(F.length("text"))).first()
    if n:
        of = Statistics(n, float(mean), longest)
        shards = max(-(-n // (shard_items or SHARD_ITEMS)), -(-chars // SHARD_CHARS))
        dealt = described.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
        used = dealt.select("shard", F.explode("terms").alias("term"))
        frequency = used.groupBy("term").agg(F.count("*").alias("n"))
        counted = stage(used.distinct().join(frequency, "term"), "test-terms")
        for shard in range(shards):
            rows = [(r["item_id"], r["text"]) for r in dealt.filter(F.col("shard") == shard).select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
            terms = counted.filter(F.col("shard") == shard).select("term", "n").toArrow()
            term, number = terms.column("term").to_numpy().view(np.uint64), terms.column("n").to_numpy()
            order = np.argsort(term)
            yield Index(rows, of, term[order], number[order])
        unstage(counted)
    unstage(described)


def find_leaks(documents: DataFrame, shards: list[Broadcast], name: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``documents`` with a column called ``name``: the verified items of some shards that each text holds."""
    bounded_batches(documents.sparkSession)
    if name in documents.columns:
        raise ValueError(f"documents already has a column named {name}")
    at = documents.columns.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(x) for x in text_of(batch.column(at))]
            found: list[list[dict]] = [[] for _ in words]
            for shard in shards:
                index = shard.value
                for w, own in zip(words, found, strict=True):
                    own += index.leaks(w, threshold, overlap)
                if len(shards) > HELD_SHARDS:
                    shard.__dict__.pop("_value", None)  # read again from the worker's file for the next batch
            for own in found:
                own.sort(key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["first_word"], x["score"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, name])

    return documents.mapInArrow(run, T.StructType(documents.schema.fields + [T.StructField(name, LEAK)]))


def _passes(benchmark: DataFrame, shard_items: int | None) -> Iterator[list[Broadcast]]:
    """Broadcast shards, as many at a time as one pass over the corpus searches."""
    context = benchmark.sparkSession.sparkContext
    own: list[Broadcast] = []
    for index in indexes(benchmark, shard_items):
        own.append(context.broadcast(index))  # at most PASS_SHARDS of bounded size
        if len(own) == PASS_SHARDS:
            yield own
            own = []
    if own:
        yield own


def leaked_items(documents: DataFrame, benchmark: DataFrame, shard_items: int | None = None) -> DataFrame:
    """One row per document and test item found in it."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shards in _passes(benchmark, shard_items):
        found = find_leaks(rows, shards, "leaks").select("doc_id", F.inline("leaks"))
        out = found if out is None else stage(out, "leaks").unionByName(found)
    return out if out is not None else rows.limit(0).select("doc_id", F.inline(F.array().cast(LEAK)))


def remove_leaked(documents: DataFrame, benchmark: DataFrame, shard_items: int | None = None) -> DataFrame:
    """The documents that hold no test item; their columns are kept as they are."""
    name = fresh("leaks", documents.columns)
    out = None
    for shards in _passes(benchmark, shard_items):
        kept = documents if out is None else stage(out, "not-leaked")
        out = find_leaks(kept, shards, name).filter(F.size(name) == 0).select(*documents.columns)
    return documents if out is None else out
