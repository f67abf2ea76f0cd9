"""Source divergence audit: how far the vocabularies of the sources of a language lie apart.

Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII.  A language
keeps the V terms that at least ``LEAST`` of its documents hold.  A group, (lang, source)
or a whole language, gives a term the share ``p = 1 + floor(UNIT * (count + 2) / (N + 2V))``,
N being its occurrences of all kept terms, and two shares lie ``floor((p-q)^2 / (p+q))`` apart.

The sum of that over all V terms is never laid out over terms and sources.  A pair of
groups starts at V times the distance of two zero counts; postings (lang, term, source,
count > 0) add what differs from it:

* a posting against another group without the term: only its count matters, so postings
  are grouped by count first, and each count meets the sources of its language;
* a term that both groups hold: the postings of a term, at most one per source, meet
  each other once and add ``f(a,b) - f(a,0) - f(0,b) + f(0,0)``, summed before they are exchanged.

So work grows with the pairs of sources that do share a term, as the answer itself
grows with the pairs of sources.  The highest terms of a group are found by a window with
a limit, which drops all but ``TOP`` of each group in every task before rows are
exchanged, so a group with a third of all terms is no task of its own.

Null text, lang and source count as ''.  Repeated rows and rows that share an id are
documents of their own; ids are not read; texts of any length are taken whole, in memory in proportion to them.  A source
without terms still has its pairs; a language without kept terms has pairs at 0 and no
terms; a source alone in its language has no pairs.  Ties are ordered by the
bytes of the item.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, kept

#: What stands between terms: a term is a run of anything else.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in, at least.
LEAST = 10
#: Whole of a share.
UNIT = 1_000_000_000
#: Terms that are told of a group.
TOP = 10
#: Rows of the table of groups up to which it is sent to all executors.
SENT = 100_000


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """``(lang, term, source, count, total, head)`` of the kept terms: occurrences in the source and in the language; one row of each term is its head.

    A document adds its terms and, apart from them, its distinct terms; both are
    summed in the task that reads it.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    # Cutting between terms costs a tenth of matching each; it leaves an empty piece where a text begins or ends with a cut.
    terms = F.split(F.translate(blank(text), UPPER, LOWER), BETWEEN)
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), terms.alias("_terms"))
    views = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("_terms").alias("t")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct("_terms").alias("t")))
    each = rows.select("lang", "source", F.explode(views).alias("v")).select("lang", "source", "v.n", "v.d", F.explode("v.t").alias("term")).where("term <> ''")
    counts = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("count"), F.sum("d").alias("docs"))
    # A term has at most one row for each source.
    term = Window.partitionBy("lang", "term")
    every = counts.withColumns({"_in": F.sum("docs").over(term), "total": F.sum("count").over(term), "head": F.min("source").over(term) == F.col("source")})
    return every.where(F.col("_in") >= least).select("lang", "term", "source", "count", "total", "head")


def share(count: Column, n: Column, v: Column) -> Column:
    """The share of ``count``; null where there are neither occurrences nor terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.nullif(n + 2 * v, F.lit(0))
    # The product exceeds 64 bits for counts over nine milliards.
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2), wide(whole)) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, found: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, n, v, p0, n_lang)`` of every group that occurs, with or without terms; ``p0`` is its share of a term it lacks."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    all_ = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct()
    own = found.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("head").cast("long")).alias("heads"))
    rows = all_.join(own, ["lang", "source"], "left").fillna(0, ["n", "heads"])
    whole = Window.partitionBy("lang")
    rows = rows.withColumns({"v": F.sum("heads").over(whole), "n_lang": F.sum("n").over(whole)})
    return rows.select("lang", "source", "n", "v", "n_lang", share(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("p0"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources of each (lang, source) by distance, and the terms it has more of than its language."""
    found = kept(postings(docs, text, lang, source, least))
    groups = kept(groups_of(docs, found, lang, source))
    few = F.broadcast(groups) if groups.count() <= SENT else groups
    # Shares of postings, with what their group gives a term it lacks.
    known = kept(
        found.join(few, ["lang", "source"]).select(
            "lang", "term", "source", "count", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")
        )
    )
    forget(found)
    side = lambda t, x, *more: t.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p0", *more)), *(["term"] if "term" in t.columns and "p" in more else []))
    zero = apart(F.col("p0_a"), F.col("p0_b"))
    # Both parts below are as large as the answer, or as the counts that differ, not as the postings.
    base = side(groups, "a", "v").join(side(few, "b"), "lang").where("source_a < source_b")
    base = base.select("lang", "source_a", "source_b", F.coalesce(F.col("v_a") * zero, F.lit(0)).alias("x"))
    counts = known.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    lone = counts.select("lang", F.col("source").alias("source_a"), F.col("p0").alias("p0_a"), "p", "m").join(side(few, "b"), "lang").where("source_a <> source_b")
    lone = lone.select(
        "lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), (F.col("m") * (apart(F.col("p"), F.col("p0_b")) - zero)).alias("x")
    ).where("x <> 0")
    both = side(known, "a", "p").join(side(known, "b", "p"), ["lang", "term"]).where("source_a < source_b")
    shared = apart(F.col("p_a"), F.col("p_b")) - apart(F.col("p_a"), F.col("p0_b")) - apart(F.col("p0_a"), F.col("p_b")) + zero
    both = both.select("lang", "source_a", "source_b", shared.alias("x")).where("x <> 0")
    one = ["lang", "source_a", "source_b"]
    # Each is summed on its own, so that sums of the many postings are formed before they meet the others.
    pairs = base.unionByName(lone.groupBy(*one).agg(F.sum("x").alias("x"))).unionByName(both.groupBy(*one).agg(F.sum("x").alias("x")))
    pairs = pairs.groupBy(*one).agg(F.sum("x").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    terms = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda t: t.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir).select("text", "lang", "source"))


#: Every group meets every kept term of its language.
SQL = rf"""with docs as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
words as (select id, lang, source, unnest(w) term from docs),
vocabulary as (select lang, term from words group by 1, 2 having count(distinct id) >= {LEAST}),
sizes as (select lang, count(*) v from vocabulary group by 1),
counts as (select lang, source, term, count(*) c from words join vocabulary using (lang, term) group by 1, 2, 3),
groups as (select distinct lang, source from docs),
dense as (select g.lang, g.source, k.term, coalesce(c.c, 0) c from groups g join vocabulary k on k.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
of_group as (select *, sum(c) over (partition by lang, source) n from dense),
shares as (select d.lang, d.source, term, c, 1 + (({UNIT}::hugeint * (c + 2)) // (n + 2 * v)::hugeint)::bigint p from of_group d join sizes s on s.lang = d.lang),
langs as (select lang, term, sum(c) c, sum(sum(c)) over (partition by lang) n from dense group by 1, 2),
whole as (select l.lang, term, 1 + (({UNIT}::hugeint * (c + 2)::hugeint) // (n + 2 * v)::hugeint)::bigint q from langs l join sizes s on s.lang = l.lang),
sums as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::bigint x
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(x, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, 'term' part, p.term item, (((p - q) * (p - q)) // (p + q))::bigint as value
  from shares p join whole w on w.lang = p.lang and w.term = p.term where p.c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {"op12_divergence": SQL}
