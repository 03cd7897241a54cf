"""Spelling variants grouped by reduced alphabets (operator 12).

Words that differ by one inserted, deleted or replaced letter still differ by one such edit at most when their
letters are hashed to a few symbols. So the distinct reduced words (cells) are few, each generates its
one-edit neighbourhood, and a join with the cells leaves only pairs of cells that can hold near words; their words
are verified with the edit distance of the original strings.

* An unordered pair of cells is generated once: by deletions from the longer word, by replacements with
  a higher symbol from one of equal length (an insertion of one cell is a deletion of the other), and by a
  cell itself for the words that it holds.
* A pair of cells that would give more than ``CROWDED`` pairs of words is not expanded. The words of such cells go on to the
  next alphabet (8, then 32 symbols, then each letter its own), where they form smaller cells; on the last
  one a cell is a single word. Nothing is capped, and no step emits the square of a cell.
* A word's form is its most frequent near word if that is at least twice as frequent; roots
  follow forms by pointer doubling, as many rounds as the logarithm of the longest chain.

Defined cases: a null text has no runs; a null id enters the hash as an empty string; an empty table, or one
without frequent words, has no rows; a word without near words has n_near 0; repeated rows count again; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed, lower_ascii, release, table

#: Letters of a run once A-Z are lower-cased.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Symbols of the alphabets, tried in turn; a code point modulo the last is itself.
ALPHABETS = (8, 32, 256)
#: Pairs of words that a pair of cells may be expanded to.
CROWDED = 1_024
MIN_LENGTH, MIN_COUNT, DROPS_ONE_IN = 5, 3, 97


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, drops_one_in: int = DROPS_ONE_IN) -> DataFrame:
    """(word, n): runs of letters of whole texts; a run of a document loses a letter where its hash says so."""
    low = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    # Maximal runs only: a shorter run cannot reach the least length.
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(f"([a-z\\u00C0-\\u00FF]{{{min_length},}})"), F.lit(1))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drops_one_in == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
                  ).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).filter(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def _symbols(size: int, letters: str) -> dict[str, str]:
    """Letter to symbol; symbols keep the order of their numbers."""
    return {c: chr(0x100 + ord(c) % size) for c in letters}


def _neighbours(reduced: str, symbols: list[str]) -> Column:
    """Cells at one deletion from a reduced word, or one replacement by a higher symbol, and its own."""
    alphabet = f"array({', '.join(repr(s) for s in symbols)})"
    start, rest = f"substr({reduced}, 1, i - 1)", f"substr({reduced}, i + 1)"
    places = f"sequence(1, length({reduced}))"
    return F.expr(f"""
        array_distinct(concat(
          array(xxhash64({reduced})),
          transform({places}, i -> xxhash64(concat({start}, {rest}))),
          flatten(transform({places}, i -> transform(filter({alphabet}, s -> s > substr({reduced}, i, 1)),
                                                     s -> xxhash64(concat({start}, s, {rest})))))))""")


def near_pairs(words: DataFrame, alphabets: tuple[int, ...] = ALPHABETS, crowded: int = CROWDED, letters: str = LETTERS) -> DataFrame:
    """(a, na, b, nb) once for each unordered pair of words at one edit. ``words``: (word, n), distinct words of ``letters``."""
    #: sizes: how many words each cell of the word held in the alphabets before.
    level = words.select("word", "n", F.lit(None).cast("array<bigint>").alias("sizes"))
    found = None
    for turn, size in enumerate(alphabets):
        symbol = _symbols(size, letters)
        reduced = F.translate("word", "".join(symbol), "".join(symbol.values()))
        level = checkpointed(level.withColumn("reduced", reduced).withColumn("cell", F.xxhash64("reduced")))
        cells = level.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
        near = (level.select("cell", "reduced").distinct()
                .select(F.col("cell").alias("c1"), F.explode(_neighbours("reduced", sorted(set(symbol.values())))).alias("c2")))
        pairs = checkpointed(
            near.join(cells.select(F.col("cell").alias("c2"), F.col("held").alias("held2")), "c2")
            .join(cells.select(F.col("cell").alias("c1"), F.col("held").alias("held1")), "c1")
            .groupBy("c1", "c2").agg((F.max("held1") * F.max("held2")).alias("product")))
        last = turn == len(alphabets) - 1
        few = F.lit(True) if last else F.col("product") <= crowded
        a = level.select(F.col("cell").alias("c1"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("sizes").alias("sa"))
        b = level.select(F.col("cell").alias("c2"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("sizes").alias("sb"))
        verified = (
            pairs.filter(few).select("c1", "c2").join(a, "c1").join(b, "c2")
            # Within a cell each pair once, and only pairs that every alphabet before left to this one.
            .filter((F.col("c1") != F.col("c2")) | (F.col("a") < F.col("b")))
            .filter(F.expr(f"sa IS NULL OR forall(zip_with(sa, sb, (x, y) -> x * y), p -> p > {crowded})"))
            .filter(F.levenshtein("a", "b", 1) == 1)
            # Collisions of cell hashes may bring a pair from both sides.
            .select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                    F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        )
        found = verified if found is None else found.unionByName(verified)
        if last:
            break
        full = pairs.filter(~few)
        if full.isEmpty():
            break
        touched = full.select(F.explode(F.array("c1", "c2")).alias("cell")).distinct()
        level = (level.join(touched, "cell").join(cells, "cell")
                 .select("word", "n", F.concat(F.coalesce("sizes", F.expr("CAST(array() AS ARRAY<BIGINT>)")), F.array("held")).alias("sizes")))
    return found.dropDuplicates(["a", "b"])


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("nb").alias("m"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("na").alias("m"), F.col("a").alias("other")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                         F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until all point at a word without one."""
    at = checkpointed(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = checkpointed(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
        release(at.sparkSession)


def variants(docs: DataFrame, alphabets: tuple[int, ...] = ALPHABETS, crowded: int = CROWDED, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of ``docs`` (see ``frequent_words``)."""
    words = checkpointed(frequent_words(docs, **counting))
    formed = checkpointed(forms(words, near_pairs(words, alphabets, crowded)))
    return (formed.join(roots(formed), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# CRC-32 bit by bit (reflected polynomial 0xEDB88320); near words share what is left when a place is blanked
# (replacement) or one is what is left of the other when a letter goes.
ORACLE = """
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hexed AS (SELECT run, c, hex(encode(keyed)) AS h FROM counted),
hashed AS (
  SELECT run, c, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM hexed, crc
), said AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, c
  FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), blank AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM blank a JOIN blank b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, w.word, w.n FROM blank a JOIN words w ON a.rest = w.word
  UNION
  SELECT w.word, a.word, a.n FROM blank a JOIN words w ON a.rest = w.word
), ranked AS (
  SELECT word, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near
  FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 2 * w.n THEN r.other END AS form,
         CASE WHEN r.m >= 2 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain(word, tip) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.tip AS root FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""
