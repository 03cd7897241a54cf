"""Join operators Spark lacks or plans badly.

* ``not_in_anti_join`` keeps SQL ``NOT IN`` semantics without the null-aware
  broadcast anti join (which needs the whole right side in memory).
* ``disjunctive_join`` rewrites ``a.x = b.k OR a.y = b.p`` (a nested loop in
  Catalyst) into two equi-joins.
* ``phrase_hits`` finds ``a LIKE concat('%', b, '%')`` (a nested loop in Catalyst) by an
  Aho-Corasick automaton of the phrases while their measured size allows one, in one pass over the texts.
* ``containment_join`` finds the same beyond that size by a token equi-join plus an exact ``contains`` check.
"""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in_anti_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """``left WHERE left_col NOT IN (SELECT right_col FROM right)``.

    * right empty -> every left row (NULL keys included);
    * right holds a NULL -> no row;
    * else rows whose key is non-NULL and absent from right.
    The two counts are one uncorrelated scalar subquery; the anti join itself
    is an ordinary hash/sort-merge ``left_anti`` on non-NULL keys.
    """
    stats = right.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(F.col(right_col)).alias("nn"))).scalar()
    keys = right.select(F.col(right_col).alias("_nk")).filter(F.col("_nk").isNotNull())
    anti = left.join(keys, left[left_col] == keys["_nk"], "left_anti")
    return anti.filter((stats.getField("n") == 0)
                       | ((stats.getField("nn") == stats.getField("n")) & F.col(left_col).isNotNull()))


def disjunctive_join(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str],
                     how: str = "inner") -> DataFrame:
    """Join on ``left.f0 = right.f1 OR left.s0 = right.s1`` as two equi-joins.

    Pairs matching the first equality come from join 1; pairs matching only the
    second come from join 2 with the first equality excluded, so no pair is
    counted twice and no distinct over whole rows is needed. ``how='left'``
    adds the left rows that match neither.
    """
    l0, r0 = first
    l1, r1 = second
    j1 = left.join(right, left[l0] == right[r0], "inner")
    j2 = left.join(right, (left[l1] == right[r1]) & ~F.coalesce(left[l0] == right[r0], F.lit(False)), "inner")
    both = j1.unionByName(j2)
    if how == "inner":
        return both
    if how != "left":
        raise ValueError(how)
    unmatched = (left.join(right.select(F.col(r0).alias("_r0")), left[l0] == F.col("_r0"), "left_anti")
                 .join(right.select(F.col(r1).alias("_r1")), left[l1] == F.col("_r1"), "left_anti"))
    for f in right.schema.fields:
        unmatched = unmatched.withColumn(f.name, F.lit(None).cast(f.dataType))
    return both.unionByName(unmatched)


def lookup_with_fallback(rows: DataFrame, exact: DataFrame, exact_on: tuple[str, str],
                         fallback: DataFrame, fallback_on: tuple[str, str], value: str, out: str,
                         labels: tuple[str, str] = ("exact", "nation")) -> DataFrame:
    """Value from the exact lookup row, else from the fallback table (one row per key)."""
    e = exact.select(F.col(exact_on[1]).alias("_ek"), F.col(value).alias("_ev"))
    f = fallback.select(F.col(fallback_on[1]).alias("_fk"), F.col(value).alias("_fv"))
    joined = (rows.join(e, rows[exact_on[0]] == F.col("_ek"), "left")
              .join(f, rows[fallback_on[0]] == F.col("_fk"), "left"))
    return (joined
            .withColumn(out, F.coalesce("_ev", "_fv"))
            .withColumn("matched_by", F.when(F.col("_ek").isNotNull(), labels[0])
                        .when(F.col("_fv").isNotNull(), labels[1]))
            .drop("_ek", "_ev", "_fk", "_fv"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _salted(df: DataFrame, salts: int) -> DataFrame:
    """Every row once per salt: the side with few rows per key, so that a frequent key of the other spreads."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


#: Phrases of up to this many bytes of UTF-8 in all travel to the tasks as an automaton (some 50 bytes of memory a byte).
AUTOMATON_BYTES = 2 * 1024 * 1024
#: Letters of the q-grams that short items are looked up by.
GRAM = 3


def _grams(text: str, length: str) -> Column:
    """Distinct substrings of a length; none of a shorter text."""
    return F.expr(f"IF(length({text}) >= {length}, array_distinct(transform(sequence(1, length({text}) - {length} + 1), "
                  f"i -> substring({text}, i, {length}))), array())")


def phrase_hits(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str,
                most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The columns of ``docs`` but its text, and ``item_key`` of each item whose text the document contains, once for
    each row of ``docs`` and distinct key.

    The phrases are measured first (one aggregate). Up to ``most_bytes`` each task builds one automaton of them and
    reads its texts once, whatever the number of phrases; beyond that, or where ``ahocorasick`` is not installed, the pairs come from
    ``containment_join``, for which ``doc_key`` has to be unique. Items without a non-blank character match nothing; equal texts
    of several keys all match; a null text contains nothing.
    """
    phrases = items.filter(F.col(item_text).rlike(r"\S")).select(F.col(item_key).alias("_i"), F.col(item_text).alias("_p")).distinct()
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("_p") + 16), F.lit(0))).first()[0]
    keep = [c for c in docs.columns if c != doc_text]
    if size > most_bytes or importlib.util.find_spec("ahocorasick") is None:
        named = phrases.withColumnRenamed("_i", item_key)
        return containment_join(docs, doc_key, doc_text, named, item_key, "_p").select(*keep, item_key).distinct()
    listed = phrases.toArrow()
    keys, places = listed.column("_i").combine_chunks(), {}
    for place, text in enumerate(listed.column("_p").to_pylist()):
        places.setdefault(text, []).append(place)
    types = docs.schema
    schema = ", ".join(f"`{c}` {types[c].dataType.simpleString()}" for c in keep) + f", `{item_key}` {items.schema[item_key].dataType.simpleString()}"

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for text, its in places.items():
            machine.add_word(text, its)
        if places:
            machine.make_automaton()
        names = keys.to_pylist()
        for batch in batches:
            at, found = [], []
            for row, text in enumerate(batch.column(doc_text).to_pylist() if places else []):
                # One place for each distinct key.
                hits = {names[place]: place for _, its in machine.iter(text or "") for place in its}
                at += [row] * len(hits)
                found += hits.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), keys.take(pa.array(found, pa.int64()))],
                                             names=[*keep, item_key])

    return docs.mapInArrow(run, schema)


def containment_join(docs: DataFrame, doc_key: str, doc_text: str,
                     items: DataFrame, item_key: str, item_text: str, salts: int = 16) -> DataFrame:
    """Pairs (doc, item) with ``contains(doc_text, item_text)``, exact.

    Candidates come from equi-joins on tokens; only (key, token) pairs are
    exploded -- texts are not copied per token -- and the whole texts are
    compared once per candidate pair.

    * Items of three or more whitespace tokens: each interior token is a whole
      token of any text containing the item. The interior token with the lowest
      document frequency is the join key (frequencies from the same token
      explode, partially aggregated), so a common word never drives the join.
    * Shorter items: their longest token lies inside one token of the document. The key is the rarest of that
      token's q-grams (``GRAM`` letters, fewer for a shorter one) among the q-grams of the distinct document tokens, of
      which a token has as many as letters; tokens found by it are compared whole.
    * Items without any non-blank character are not keywords and match nothing.

    A token in every document, or an item in every document, is spread over
    ``salts`` tasks by the document's hash: the item side is repeated per salt.
    """
    salt = F.pmod(F.xxhash64("_d"), F.lit(salts)).cast("int").alias("_salt")
    doc_tok = docs.select(F.col(doc_key).alias("_d"), F.explode(F.array_distinct(_tokens(F.col(doc_text)))).alias("_tok"))
    salted_tok = doc_tok.select("_d", "_tok", salt)

    toks = _tokens(F.col(item_text))
    items_k = items.select(F.col(item_key).alias("_i"), toks.alias("_toks"))
    long_tok = (items_k.filter(F.size("_toks") >= 3)
                .select("_i", F.explode(F.slice("_toks", 2, F.greatest(F.size("_toks") - 2, F.lit(0)))).alias("_tok")))
    # Document frequencies are only needed for the items' interior tokens: the semi join
    # keeps the aggregate to that vocabulary instead of every word of every document.
    df_tok = (doc_tok.groupBy("_tok").agg(F.count(F.lit(1)).alias("_df"))
              .join(long_tok.select("_tok").distinct(), "_tok", "left_semi"))
    # Interior tokens absent from every document cannot match: the inner join drops them.
    long_key = (long_tok.join(df_tok, "_tok")
                .groupBy("_i").agg(F.min(F.struct("_df", "_tok")).alias("_m"))
                .select("_i", F.col("_m._tok").alias("_tok")))

    short_key = (items_k.filter((F.size("_toks") >= 1) & (F.size("_toks") < 3))
                 .select("_i", F.try_element_at(F.array_sort(F.transform(
                     "_toks", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("t")))), F.lit(1))
                     .getField("t").alias("_key")))
    # At most GRAM lengths, whatever the number of items.
    lengths = short_key.agg(F.collect_set(F.least(F.length("_key"), F.lit(GRAM)))).scalar()
    grams = (doc_tok.select("_tok").distinct().withColumn("_len", F.explode(lengths))
             .select("_tok", F.explode(_grams("_tok", "_len")).alias("_gram")))
    key_grams = short_key.select("_i", "_key", F.explode(_grams("_key", f"least({GRAM}, length(_key))")).alias("_gram"))
    frequency = (grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
                 .join(key_grams.select("_gram").distinct(), "_gram", "left_semi"))
    rarest = (key_grams.join(frequency, "_gram").groupBy("_i", "_key").agg(F.min(F.struct("_n", "_gram")).alias("_m"))
              .select("_i", "_key", F.col("_m._gram").alias("_gram")))
    short_tok = (grams.join(rarest, "_gram").filter(F.col("_tok").contains(F.col("_key")))
                 .select("_i", "_tok").distinct())
    keyed = _salted(long_key.unionByName(short_tok), salts)
    cand = salted_tok.join(keyed, ["_tok", "_salt"]).select("_d", "_i").distinct()
    # Column names of docs and items must not clash (rename before calling). The items' texts join the
    # narrow candidates; the documents' texts are shuffled once, by document.
    it = _salted(items.withColumnRenamed(item_key, "_ik"), salts)
    wanted = cand.select("_d", F.col("_i").alias("_ik"), salt).join(it, ["_ik", "_salt"])
    pairs = wanted.join(docs, (F.col("_d") == F.col(doc_key)) & F.col(doc_text).contains(F.col(item_text)))
    return pairs.withColumnRenamed("_ik", item_key).drop("_d", "_salt")
