"""Operator 12: words grouped by spelling, by a join on asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point makes one of the
other. Of such a pair the shorter word (of equal ones the smaller) contributes two
disjoint chunks, its halves, and the other word its positional grams. One edit leaves
one of the halves whole, at its place or shifted by one: the first half stays where it
is, the second half moves by the difference of the lengths. So grams take part only
where the lengths of a pair (equal, or one apart) would put a half.

A half alone is too common a key. A pair that keeps one half has its edit in the other,
where the same holds once more: one of that half's own two chunks is kept. Each key is
therefore a half and a quarter, or: a prefix and a suffix that leave out the quarter
which the edit is in. A pair is taken under the first of its common keys only and
verified by its edit distance, so no pair comes twice. All steps are joins and
aggregations inside the JVM, with partial counts before each shuffle.

A word's form is its near word of largest count (of equal counts the smallest word), if
that is twice the word's own or more; its root is the last word on the way from form to
form. Counts at least double on each step, so ways have no rings and are followed by
doubling: rounds grow with the logarithm of their length.

Nulls and odd rows: a null text has no words; a null doc_id counts as an empty one where
it decides on deletions; repeated rows count each; an empty table has no words; other
columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lasting, scratch, written

#: Letters of words: ASCII and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Least code points and occurrences of a word, and how many times its own count its form must have.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in so many loses a code point in the query.
DELETE_ONE_IN = 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, run: each maximal run of at least so many letters, A-Z in lower case."""
    found = F.regexp_extract_all("text", F.lit(LETTERS + f"{{{least},}}"), 0)
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def misspelt(found: DataFrame) -> DataFrame:
    """word: the runs, some with one code point less, as the checksum of their document and themselves decides."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    found = found.select("run", F.crc32(named.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _kept(size: Column) -> list[tuple[Column, Column]]:
    """(prefix, suffix) lengths of a word of this size that are kept when the edit is in its last, third, second, first quarter."""
    half = F.floor(size / 2)
    first, third = F.floor(half / 2), half + F.floor((size - half) / 2)
    return [(third, F.lit(0)), (half, size - third), (first, size - half), (F.lit(0), size - first)]


def _keys(word: str, size: Column) -> list[Column]:
    """What the word has of each key of words of this size: prefix, suffix and, between them, the key's own name."""

    def key(k: int, prefix: Column, suffix: Column) -> Column:
        end = F.substring(word, F.length(word) - suffix.cast("int") + 1, suffix.cast("int"))
        return F.concat(F.substring(word, F.lit(1), prefix.cast("int")), F.lit(f" {k} "), size.cast("string"), F.lit(" "), end)

    return [key(k, *kept) for k, kept in enumerate(_kept(size))]


def _exploded(words: DataFrame, word: str, n: str, size: Column) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(k).alias("k"), key.alias("key")) for k, key in enumerate(_keys(word, size))))
    return words.select(F.inline(keys), word, n)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of near words once. words: word, n, each word once."""
    chunks = _exploded(words, "word", "n", F.length("word"))
    grams = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    grams = grams.withColumn("size", F.explode(F.array(F.length("other"), F.length("other") - 1))).where(F.col("size") > 0)
    grams = _exploded(grams, "other", "other_n", F.col("size")).drop("k")
    met = chunks.join(grams, "key")
    longer = F.length("other") > F.length("word")
    met = met.where((longer | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    size = F.length("word")
    before = F.lit(False)
    for k, (own, others) in enumerate(zip(_keys("word", size), _keys("other", size), strict=True)):
        before = before | ((F.col("k") > k) & (own == others))
    return met.where(~before).select("word", "n", "other", "other_n")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    best = F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))
    both = F.array(
        F.struct("word", "n", best.alias("best")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("other")).alias("best")),
    )
    sides = pairs.select(F.inline(both))
    alone = words.select("word", "n", F.lit(None).cast(sides.schema["best"].dataType).alias("best"))
    found = sides.unionByName(alone).groupBy("word").agg(
        F.first("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best")
    )
    more = -F.col("best.less") >= times * F.col("n")
    return found.select(
        "word", "n", "n_near", F.when(more, F.col("best.other")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """word, root of every word that has a form: the last word on the way from form to form."""
    spark = found.sparkSession
    way = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "ways")
    while way.where("moved").limit(1).count():
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        way = written(way, "ways")
    return way.select("word", "root")


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. words: word, n, each word once."""
    with scratch(words.sparkSession):
        words = written(words, "words")
        found = written(forms(words, near_pairs(words)), "forms")
        found = found.join(roots(found), "word", "left")
        return lasting(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spellings")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the words of all documents, some of whose runs lose a code point first."""
    return spelling_groups(counted(misspelt(runs(documents(spark, sf_dir)))))


#: DuckDB SQL for the checksum (crc32, unsigned) of a list of bytes: eight shifts a byte.
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, {}), lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, "
    "[0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))), "
    "4294967295::UBIGINT)"
)
_BYTES = (
    "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] "
    "ELSE [(192 + (unicode(x) >> 6))::UBIGINT, (128 + (unicode(x) & 63))::UBIGINT] END))"
)
OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{5,}}')), '{_UPPER}', '{_LOWER}') AS run
  FROM documents
), per_doc AS (SELECT id, run, count(*) AS times FROM runs GROUP BY id, run),
hashed AS (SELECT run, times, {CRC32_SQL.format(_BYTES.format("id || ':' || run"))} AS h FROM per_doc),
cut AS (
  SELECT times, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), less AS (
  SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM less x JOIN less y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT DISTINCT x.word, x.n, y.word, y.n FROM less x JOIN words y ON x.a || x.b = y.word
  UNION SELECT DISTINCT y.word, y.n, x.word, x.n FROM less x JOIN words y ON x.a || x.b = y.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), ways AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT w.word, f.form, steps + 1 FROM ways w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word) w ON w.word = f.word
"""
