"""How the words of each source of a language differ from the other sources and from the language.

Each task sorts pointers to the word starts of its Arrow buffers (``word_pointers``), and equal
runs give occurrences and documents per word and source, a shard at a time.  Spark adds them up by
language and word, keeps the words of enough documents, and compares the sources.

The comparison of a source with each other one over all kept words is never made word by word
for words that neither has: with f(x, y) = floor((x - y)^2 / y), 0 for a word's absence, and A, B
the two sources, the sum over all kept words is

    V f(0, 0) + sum over A of [f(a, 0) - f(0, 0)] + sum over B of [f(0, b) - f(0, 0)]
      + sum over both of [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]

where the sums over A and over B need only how many words have each count, and the last one the
words that both have.  Work and rows are the pairs of sources that share a word; the result has
all pairs of sources of a language anyway.

Nulls in text, lang or source count as ''.  Repeated rows and ids are documents of their own.  A
group without words, or a language without kept words, has rows of value 0 for its pairs and no
rows of terms; a source alone in its language has no pairs.  An empty table gives an empty result.
Only text, lang and source are read, so further columns of any name are no concern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, tidy

SCALE = 1_000_000_000


def shard_counts(docs: DataFrame, shard_bytes: int = 16 << 20, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n and docs of each shard of about ``shard_bytes`` bytes of text (a longer
    text is a shard); term '' stands for the group itself, which may have no term."""
    empty = F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyrack.llm.word_pointers import counts

        def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            text, lang, source = (c.chunk(0) for c in table.columns)
            lang, source = pc.dictionary_encode(lang), pc.dictionary_encode(source)
            wide = len(source.dictionary)
            pairs, group = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
            terms, of, n, docs = counts(text, group)
            of = np.concatenate([np.arange(len(pairs)), of])
            none, zero = pa.array([""] * len(pairs)), np.zeros(len(pairs), np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(pairs[of] // wide)),
                    source.dictionary.take(pa.array(pairs[of] % wide)),
                    pa.concat_arrays([none, terms]),
                    pa.array(np.concatenate([zero, n])),
                    pa.array(np.concatenate([zero, docs])),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, lengths = 0, np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = int(lengths[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(lengths, before + shard_bytes - size, side="right")))
                held.append(batch.slice(at, stop - at))
                size += int(lengths[stop - 1]) - before
                at = stop
                if size >= shard_bytes or at < batch.num_rows:
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)

    texts = docs.select(*(F.coalesce(col(c).cast("string"), empty).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    return texts.mapInArrow(tidy(run), "lang string, source string, term string, n bigint, docs bigint")


def term_table(docs: DataFrame, least_docs: int = 3, **columns: str) -> DataFrame:
    """lang, term, total and ``sources`` (source, n) of the terms in at least ``least_docs`` documents
    of their language; term '' lists the sources of a language.  Written to the shared folder."""
    shards = shard_counts(docs, **columns)
    # one exchange for both aggregates
    each = shards.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return materialise(terms.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "audit-terms")


def _share(n: Column, all_of: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / all_of), exact; null where ``all_of`` is 0."""
    big = lambda x: x.cast("decimal(19,0)")
    top, bottom = big(F.lit(SCALE)) * big(n + 1), F.nullif(big(all_of), big(F.lit(0)))
    return F.call_function("div", top, bottom) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(19,0)")


def audit_sources(docs: DataFrame, least_docs: int = 3, top_terms: int = 200, **columns: str) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    terms = term_table(docs, least_docs, **columns)
    spread = lambda df: df.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", "s.source", "s.n")
    kept = terms.where("term <> ''")
    groups = spread(terms.where("term = ''")).select("lang", "source")
    times = materialise(spread(kept).groupBy("lang", "source", "n").agg(F.count("*").alias("times")), "audit-times", light=True)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    sizes = times.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("group_n"))
    stats = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "kept", "lang_n"])
    stats = stats.select("*", (F.col("group_n") + F.col("kept")).alias("of"), (F.col("lang_n") + F.col("kept")).alias("lang_of"))
    stats = materialise(stats.withColumn("p0", _share(F.lit(0), F.col("of"))), "audit-groups", light=True)

    own = stats.select("lang", "source", "of", "p0", "lang_of")
    other = stats.select("lang", F.col("source").alias("item"), F.col("of").alias("item_of"), F.col("p0").alias("q0"))
    p0, q0, p, q = (F.col(c) for c in ("p0", "q0", "p", "q"))

    # every kept word counts as one that neither has
    base = stats.select("lang", "source", "p0", "kept").join(other, "lang").where("source <> item")
    base = base.select("lang", "source", "item", (F.coalesce(_apart(p0, q0), F.lit(0).cast("decimal(19,0)")) * F.col("kept").cast("decimal(19,0)")).alias("value"))
    # words of one of the two, by their counts: seen from it, and from the other
    single = times.join(own, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("of"))).join(other, "lang").where("source <> item")
    here, there = _apart(p, q0) - _apart(p0, q0), _apart(q0, p) - _apart(q0, p0)
    both_ways = F.array(F.struct("source", "item", here.alias("x")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), there.alias("x")))
    single = single.select("lang", "times", F.explode(both_ways).alias("e")).select("lang", "e.source", "e.item", (F.col("e.x") * F.col("times").cast("decimal(16,0)")).alias("value"))
    # words of both
    shared = kept.where(F.size("sources") > 1).select("lang", "sources", F.explode("sources").alias("a")).select("lang", "sources", "a.source", "a.n")
    shared = shared.join(own, ["lang", "source"]).select("lang", "source", "p0", _share(F.col("n"), F.col("of")).alias("p"), F.explode("sources").alias("b"))
    shared = shared.select("lang", "source", "p0", "p", F.col("b.source").alias("item"), F.col("b.n").alias("m")).where("source <> item")
    shared = shared.join(other, ["lang", "item"]).withColumn("q", _share(F.col("m"), F.col("item_of")))
    shared = shared.select("lang", "source", "item", (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("value"))
    wide = lambda df: df.withColumn("value", F.col("value").cast("decimal(38,0)"))
    pairs = wide(base).unionByName(wide(single)).unionByName(wide(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("bigint").alias("value")))
    over = spread(kept).join(own, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("of")).alias("p"), _share(F.col("total"), F.col("lang_of")).alias("q"))
    over = over.where(p > q).select("lang", "source", F.lit("term").alias("part"), "item", _apart(p, q).cast("bigint").alias("value"))
    # the limit on ranks is applied before the exchange, so a large group sends few rows
    return pairs.unionByName(ranked(over).where(F.col("rank") <= top_terms))


LETTERS_UP, LETTERS_DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB: every group and every kept word of its language, compared pair by pair.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
w AS (SELECT r, lang, source, translate(unnest(words), '{LETTERS_UP}', '{LETTERS_DOWN}') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.group_n + l.v) AS p, 1 + {SCALE}::HUGEINT * (k.total + 1) // (l.lang_n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  GROUP BY a.lang, a.source, b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
