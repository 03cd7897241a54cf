"""Benchmark decontamination by exact word windows (operator 9, native).

Every benchmark item gives its windows of ``n`` consecutive words (an item of fewer
words is one window). A document is scanned inside its row: each of its windows is
hashed and looked up in the benchmark's hash set, hits are verified on the words
themselves, and the union of the verified windows is what is hit. Texts never leave
their row; to name the items, only the distinct sets of windows found are joined.

The set travels to the executors inside the plan while it holds at most
``max_broadcast`` windows (counted first, a fixed bound of some MB). A larger benchmark
is joined by hash with the windows of the distinct texts, verified on the words, and
joined back; no hint is given there, so only a side of measured size is broadcast.

Defined cases: null and empty texts have no words, are never hit and add no window; an
item with a null id still hits but is not named; repeated items are one item when their
ids are equal; repeated documents are judged row by row; an empty benchmark leaves every
document clean; other columns are kept by ``decontaminate`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD_ANY, checkpointed, lower_ascii, pinned, table, words

#: Windows held in the plan at most: about 100 bytes each.
MAX_BROADCAST = 20_000

_SPAN = "struct<s:int,e:int,win:string>"
_NONE = f"CAST(array() AS array<{_SPAN}>)"


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, len, win, hash): the distinct windows of each item, words joined by a space."""
    items = (
        benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("w"))
        .filter(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    )
    return (
        items.select("item_id", "len", "w", F.explode(F.expr("sequence(0, size(w) - len)")).alias("i"))
        .select("item_id", "len", F.expr("concat_ws(' ', slice(w, i + 1, len))").alias("win"),
                F.expr("xxhash64(slice(w, i + 1, len))").alias("hash"))
        .distinct()
    )


def _literals(values: list) -> str:
    return ",".join(f"'{v}'" if isinstance(v, str) else f"{v}L" if v > -2**63 else "(-9223372036854775807L - 1L)"
                    for v in values)


def _spans(length: int, test: str) -> str:
    """SQL: the windows of ``length`` words of array ``w`` whose start ``i`` passes ``test``, in order."""
    return (f"CASE WHEN size(w) >= {length} THEN transform(filter(sequence(0, size(w) - {length}), i -> {test}), "
            f"i -> struct(i AS s, i + {length} AS e, concat_ws(' ', slice(w, i + 1, {length})) AS win)) ELSE {_NONE} END")


def _lookup(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """``_hits`` from a set held in the plan: by hash, then on the words."""
    rows = windows.select("len", "win", "hash").distinct().collect()  # counted: at most max_broadcast
    parts = []
    for length in sorted({r["len"] for r in rows}):
        own = [r for r in rows if r["len"] == length]
        by_hash = f"xxhash64(slice(w, i + 1, {length})) IN ({_literals(sorted({r['hash'] for r in own}))})"
        # Words hold no quote or backslash.
        parts.append(f"filter({_spans(length, by_hash)}, h -> h.win IN ({_literals(sorted(r['win'] for r in own))}))")
    return pinned(scanned, "_hits", F.expr(f"concat({', '.join(parts)})" if parts else _NONE))


def _joined(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """``_hits`` by joins: the windows of the distinct texts meet the benchmark's hashes, then its words."""
    keyed = scanned.withColumn("_key", F.sha2(F.concat_ws(" ", "w"), 256))
    texts = keyed.select("_key", "w").distinct()
    every = F.expr("concat(" + ",".join(
        f"CASE WHEN size(w) >= {m} THEN transform(sequence(0, size(w) - {m}), i -> "
        f"struct(xxhash64(slice(w, i + 1, {m})) AS hash, i AS s, i + {m} AS e)) "
        "ELSE CAST(array() AS array<struct<hash:bigint,s:int,e:int>>) END"
        for m in sorted(r["len"] for r in windows.select("len").distinct().collect())) + ")")  # n lengths at most
    by_hash = (texts.select("_key", F.explode(every).alias("x")).select("_key", "x.*")
               .join(windows.select("hash").distinct(), "hash", "left_semi")
               .groupBy("_key").agg(F.collect_list(F.struct("s", "e")).alias("c")))  # bounded by one text
    by_words = (texts.join(by_hash, "_key")
                .select("_key", F.explode(F.expr("transform(c, x -> struct(x.s, x.e, "
                                                 "concat_ws(' ', slice(w, x.s + 1, x.e - x.s)) AS win))")).alias("x"))
                .select("_key", "x.*").join(windows.select("win").distinct(), "win", "left_semi")
                .groupBy("_key").agg(F.collect_list(F.struct("s", "e", "win")).alias("_hits")))
    return keyed.join(by_words, "_key", "left").drop("_key").withColumn("_hits", F.coalesce("_hits", F.expr(_NONE)))


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of ``docs``: ``_row`` (all its columns), ``_w`` (lower-cased words), ``_hits`` (verified windows: s, e, win),
    ``_n_words`` and ``_n_hit``."""
    windows = benchmark_windows(benchmark, n)
    scanned = pinned(docs.select(F.struct(*docs.columns).alias("_row")), "w", words(lower_ascii(F.col("_row.text"))))
    small = windows.select("win").distinct().count() <= max_broadcast
    found = _lookup(scanned, windows) if small else _joined(scanned, windows)
    return found.withColumns({
        "_n_words": F.size("w").cast("long"),
        "_n_hit": F.expr("""aggregate(array_sort(transform(_hits, h -> struct(h.s AS s, h.e AS e))),
            struct(0L AS n, 0 AS upto),
            (a, h) -> struct(a.n + greatest(0, h.e - greatest(h.s, a.upto)) AS n, greatest(a.upto, h.e) AS upto), a -> a.n)"""),
    }).withColumnRenamed("w", "_w")


#: At least this share of a contaminated document's words is hit.
SHARE = 0.05


def contaminated(share: float = SHARE):
    per = round(1 / share)
    return (F.col("_n_hit") > 0) & (F.col("_n_hit") * per >= F.col("_n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, remove: str = "documents",
                  max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) with every hit word and the gap
    after it cut out of the texts. Columns stay as they are."""
    marked = mark(docs, benchmark, n, max_broadcast)
    if remove == "documents":
        return marked.filter(~contaminated()).select("_row.*")
    cut = F.expr(f"""concat(element_at(_gaps, 1), array_join(transform(
        filter(sequence(1, size(_w)), i -> NOT exists(_hits, h -> i > h.s AND i <= h.e)),
        i -> concat(_raw[i - 1], _gaps[i])), ''))""")
    pieces = marked.withColumns({"_gaps": F.split("_row.text", WORD_ANY, -1),
                                 "_raw": F.regexp_extract_all("_row.text", F.lit(f"({WORD_ANY})"), F.lit(1))})
    text = F.when(F.col("_n_hit") > 0, cut).otherwise(F.col("_row.text"))
    return pieces.withColumn("_text", text).select(*(F.col("_text").alias("text") if c == "text" else f"_row.`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    # Written once: the texts are scanned once, and both sides of the join read narrow rows.
    marked = checkpointed(mark(docs.select("doc_id", "text"), benchmark).select(
        "_row.doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), contaminated().alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("_hits.win"))).alias("wins"))
        .withColumn("set_key", F.sha2(F.concat_ws("\n", "wins"), 256)))
    # The items follow from the set of windows found: each distinct set is looked up once.
    hit = marked.filter(F.size("wins") > 0)
    sets = hit.select("set_key", "wins").distinct()
    items = (sets.select("set_key", F.explode("wins").alias("win"))
             .join(benchmark_windows(benchmark).select("win", "item_id"), "win")
             .groupBy("set_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
             .select("set_key", F.size("ids").cast("long").alias("found"), F.sha2(F.array_join("ids", ","), 256).alias("sha")))
    clean = marked.filter(F.size("wins") == 0).withColumns({"found": F.lit(0).cast("long"), "sha": F.sha2(F.lit(""), 256)})
    return (hit.drop("wins").join(items, "set_key").unionByName(clean.drop("wins"))
            .select("doc_id", "n_words", "n_hit", F.col("found").alias("n_items"), F.col("sha").alias("items_sha256"),
                    "contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (
  SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents
), dw AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))
), hits AS (SELECT rid, m, i, dw.win FROM dw WHERE win IN (SELECT win FROM bw)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits JOIN bw USING (win) WHERE item_id IS NOT NULL)
  GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
