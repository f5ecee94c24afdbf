"""Line deduplication by shared runs of lines (operator 6), in DataFrame and SQL functions only.

A text is a sequence of lines; a line ends at a newline with the blank lines after
it, or before the next word after a full stop, question or exclamation mark and up
to three closing quotes or brackets, so a passage pasted into the middle of a
paragraph is made of lines too. A run of lines counts if it has ``RUN_WORDS``
words or ``REACH`` + 1 lines. What is deleted: every line of a run that counts and
that stands earlier as well, in (doc_id, text hash, position) order.

The windows are, from every line on and back from every line, the shortest run
that counts. Whatever longer run is repeated, the windows inside it cover all its
lines and are repeated with it; so fingerprints, the hashes of the windows, are
guaranteed to meet for every match, a match extends both ways as far as window
after window is shared, and each needs to be compared with its first occurrence
only: no two later occurrences are ever paired. (Keeping only the minima of
neighbouring windows, as in plain winnowing, would need all pairs of occurrences
to extend from; see the README.)

A fingerprint's occurrences are ranked where they meet. Fingerprints so frequent
that one task would get too many, found in a sample of the documents, are ranked
in ``SALTS`` parts first; that moves work, never the result.

Every deleted line has an equal line earlier, so the first copy of a passage
always stays.

Defined results: null and empty texts stay as they are; a text all of whose
lines are repeated becomes empty; lines are compared without white space at
their ends; a blank line has no words, and only one at the very start of a text
is a line of its own; rows with equal doc_id and equal text get the same result
and do not repeat each other; a null doc_id sorts first; texts of any length are
cut as a whole; an empty table gives no rows; all other columns are carried along
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import stage

RUN_WORDS, REACH = 20, 8
#: One in SAMPLE documents is looked at for frequent fingerprints; FREQUENT of them at most, each seen OFTEN times there.
SAMPLE, FREQUENT, OFTEN, SALTS = 64, 1000, 16, 64
#: Parts lines for splitting. Where a text holds it, _HELD stands for it meanwhile.
_MARK, _HELD, _PART = "\u0001", "\u0001h", "\u0001p"
#: A sentence's last characters; closing quotes and brackets belong to it.
_END = r"\n(?:[ \t\r\n]*\n)?|[.?!][\"'”’»)\]]{0,3} "
#: Where a window stands, in 64 bits: 28 of its text's hash, 32 of its first line, 4 of its length less one.
_TEXT_BITS, _LENGTH_BITS = 36, 4


def lines_of(text: str) -> Column:
    """The lines of a text column; joined without a separator they give the text."""
    plain = F.split(F.regexp_replace(F.col(text), _END, "$0" + _MARK), _MARK)
    held = F.split(F.regexp_replace(F.replace(F.col(text), F.lit(_MARK), F.lit(_HELD)), _END, "$0" + _PART), _PART)
    other = F.transform(held, lambda x: F.replace(x, F.lit(_HELD), F.lit(_MARK)))
    return F.filter(F.when(F.contains(F.col(text), F.lit(_MARK)), other).otherwise(plain), lambda x: x != "")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \n\r\t"))


def _words(bare: Column) -> Column:
    spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(bare == "", 0).when(F.contains(bare, F.lit("  ")), F.size(F.split(bare, " +"))).otherwise(spaces + 1)


def windows(lines: DataFrame) -> DataFrame:
    """(doc_id, th, h, w) -> (run, doc_id, place): from each line on, and back from each line, the shortest run that counts."""
    n = F.size("h")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def words(i: Column, k: int) -> Column:
        return sum((F.get("w", i + j) for j in range(1, k)), F.get("w", i))

    def length(i: Column, step: int) -> Column:
        out = F.when(words(i, 1) >= RUN_WORDS, 1)
        for k in range(2, REACH + 1):
            out = out.when(words(i if step > 0 else i - (k - 1), k) >= RUN_WORDS, k)
        return out.when((i + step * REACH >= 0) & (i + step * REACH < n), REACH + 1)

    def run(lo: Column, k: Column) -> Column:
        place = F.shiftleft(lo.cast("long"), _LENGTH_BITS).bitwiseOR((k - 1).cast("long"))
        return F.when(k.isNotNull(), F.struct(F.xxhash64(F.slice("h", lo + 1, k)).alias("run"), place.alias("place")))

    # within arrays: a row for each line with its text's arrays beside it would be copied as often as the text has lines
    ahead = lines.select("doc_id", "th", "h", "w", F.transform(places, lambda i: length(i, 1)).alias("ahead"), places.alias("places"))
    both = ahead.withColumn("back", F.transform("places", lambda i: F.when(F.get("w", i) < RUN_WORDS, length(i, -1))))

    def forward(i: Column) -> Column:
        return run(i, F.get("ahead", i))

    def backward(i: Column) -> Column:
        k = F.get("back", i)
        first = i - k + 1
        # where it is also the shortest from its first line on, it is among those ahead
        return F.when(F.get("ahead", first) < k, run(first, k))

    runs = F.filter(F.concat(F.transform("places", forward), F.transform("places", backward)), lambda x: x.isNotNull())
    rows = both.select("doc_id", F.shiftleft("th", _TEXT_BITS).alias("_text"), F.explode(runs).alias("x"))
    return rows.select("x.run", "doc_id", F.col("_text").bitwiseOR(F.col("x.place")).alias("place"))


def frequent_runs(found: DataFrame) -> DataFrame:
    """The fingerprints that are met most, FREQUENT rows at most; ``found`` is that of a sample of the documents."""
    often = found.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    return often.orderBy(F.desc("n"), "run").limit(FREQUENT).select("run", F.lit(True).alias("frequent"))


def repeated_windows(lines: DataFrame) -> DataFrame:
    """(doc_id, th, h, w) -> (doc_id, place): windows that stand earlier as well."""
    found = windows(lines)
    hot = stage(frequent_runs(windows(lines.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))), "frequent-runs")
    dealt = found.join(F.broadcast(hot), "run", "left")  # broadcast: FREQUENT rows at most
    salt = F.when(F.col("frequent"), F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS))).otherwise(F.lit(0))
    order = Window.partitionBy("run", "salt").orderBy("doc_id", "place")
    ranked = dealt.withColumn("salt", salt).withColumn("rank", F.dense_rank().over(order))
    # of a frequent one the first of each part is still to be compared with the other firsts
    open_ = F.col("frequent") & (F.col("rank") == 1)
    some = stage(ranked.filter((F.col("rank") > 1) | F.col("frequent")).select("doc_id", "place", F.when(open_, F.col("run")).alias("head")), "repeated-windows")
    heads = some.filter("head IS NOT NULL").withColumn("rank", F.dense_rank().over(Window.partitionBy("head").orderBy("doc_id", "place")))
    return some.filter("head IS NULL").select("doc_id", "place").unionByName(heads.filter("rank > 1").select("doc_id", "place"))


def deduplicate(documents: DataFrame, removed: str = "removed_lines") -> DataFrame:
    """``documents`` with repeated runs cut out of ``text``, and a column called ``removed`` with their number of lines."""
    names = documents.columns
    packed = F.struct(*names).alias("_row")  # no other name of the input can clash with those used here
    text_hash = F.shiftright(F.xxhash64("text"), _TEXT_BITS)
    keyed = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), text_hash.alias("_th"), packed)
    lines = keyed.filter("_text IS NOT NULL AND _text <> ''").select(F.col("_id").alias("doc_id"), F.col("_th").alias("th"), F.transform(lines_of("_text"), _bare).alias("bare"))
    lines = stage(lines.select("doc_id", "th", F.transform("bare", lambda x: F.xxhash64(x)).alias("h"), F.transform("bare", _words).alias("w")), "lines")
    first = F.shiftright("place", _LENGTH_BITS).bitwiseAND(F.lit((1 << _TEXT_BITS - _LENGTH_BITS) - 1)).cast("int")
    last = first + F.col("place").bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1)).cast("int")
    # a document's deleted lines, as many as it has at most
    gone = repeated_windows(lines).groupBy("doc_id", F.shiftright("place", _TEXT_BITS).alias("_run_th")).agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(first, last)))).alias("_gone")).withColumnRenamed("doc_id", "_doc")
    joined = keyed.join(gone, keyed["_id"].eqNullSafe(gone["_doc"]) & (keyed["_th"] == gone["_run_th"]), "left").withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines_of("_row.text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), ""))
    number = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")
    return joined.select(*(text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names), number.alias(removed))


#: The same rows in DuckDB, over a table ``documents`` whose ids are distinct and whose texts hold no \u0001.
SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(text, '(\n(?:[ \t\r\n]*\n)?|[.?!]["''”’»)\]]{0,3} )', '\1' || chr(1), 'g'), chr(1)) AS lines
  FROM documents WHERE text <> ''
), part AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut
), line AS (SELECT * FROM part WHERE line <> ''
), bare AS (SELECT doc_id, pos, line, trim(line, chr(32) || chr(10) || chr(13) || chr(9)) AS bare FROM line
), counted AS (
  SELECT *, CASE WHEN bare = '' THEN 0 WHEN contains(bare, '  ') THEN len(string_split_regex(bare, ' +')) ELSE length(bare) - length(replace(bare, ' ', '')) + 1 END AS w FROM bare
), summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM counted
), counting AS (
  SELECT a.doc_id, a.pos AS lo, b.pos AS hi FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 8
  WHERE b.total - a.total + a.w >= 20 OR b.pos = a.pos + 8
), shortest AS (
  SELECT doc_id, lo, min(hi) AS hi FROM counting GROUP BY doc_id, lo
  UNION SELECT doc_id, max(lo) AS lo, hi FROM counting GROUP BY doc_id, hi
), run AS (
  SELECT s.doc_id, lo, hi, string_agg(bare, chr(1) ORDER BY pos) AS run FROM shortest s JOIN bare b ON s.doc_id = b.doc_id AND b.pos BETWEEN lo AND hi GROUP BY s.doc_id, lo, hi
), later AS (SELECT doc_id, lo, hi FROM run QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, lo, hi) > 1
), gone AS (SELECT DISTINCT b.doc_id, b.pos FROM later l JOIN bare b ON l.doc_id = b.doc_id AND b.pos BETWEEN lo AND hi
), kept AS (
  SELECT l.doc_id, count(g.pos) AS removed_lines, coalesce(string_agg(l.line, '' ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.text, d.text) AS text, coalesce(k.removed_lines, 0) AS removed_lines FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
