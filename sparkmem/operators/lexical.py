"""Weighted BM25 over several columns, topic keys, sentence keys and pseudo-relevance feedback.

Queries are a DataFrame (qid, terms array); all of them run as one job. Ids are ranked first, payload joins last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expanded_query, key_terms, pieces, search_terms, terms, tidy, units
from .graph import cut
from .temporal import valid_at

# Weight of each indexed column, and the columns whose values stand before the content.
WEIGHTS = {"title": 1.0, "content": 2.0, "tool_name": 0.5, "type": 0.5, "project": 0.5, "scope": 0.5, "topic_key": 0.5}
BEFORE_CONTENT = ["type", "topic_key", "project"]
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Asked terms up to which rows are reduced to them by a literal list.
MOST_LITERALS = 10_000


class Index:
    """Postings (term, id, tf weighted, length of the row) and the corpus row (docs, mean_length)."""

    def __init__(self, postings: DataFrame, corpus: DataFrame):
        self.postings, self.corpus = postings, corpus

    def of(self, queries: DataFrame) -> Index:
        return self

    def persist(self) -> Index:
        for x in (self.postings, self.corpus):
            x.persist()
        return self


def indexed(df: DataFrame) -> DataFrame:
    """The seven columns as they are indexed: absent ones empty, the content behind type, topic key and project."""
    held = df if "tool_name" in df.columns else df.withColumn("tool_name", F.lit(None).cast("string"))
    before = [F.coalesce(c, F.lit("")) for c in BEFORE_CONTENT]
    return held.withColumn("content", F.concat_ws(" ", *before, F.coalesce("content", F.lit(""))))


def analysed(df: DataFrame, weights: dict[str, float], id_col: str = "id", analyser: Callable[[Column], Column] = terms, only: list[str] | None = None) -> DataFrame:
    """id, length, words (term, w) of each row; only: the terms to keep, which don't change the length."""
    fields = F.array(*(F.struct(F.lit(w).alias("w"), analyser(F.coalesce(c, F.lit(""))).alias("t")) for c, w in weights.items()))
    kept = (lambda t: t) if only is None else lambda t: F.filter(t, lambda x: x.isin(*only))
    length = F.aggregate("f", F.lit(0), lambda s, x: s + F.size(x["t"])).cast("long")
    words = F.flatten(F.transform("f", lambda f: F.transform(kept(f["t"]), lambda t: F.struct(t.alias("term"), f["w"].alias("w")))))
    return df.select(F.col(id_col).alias("id"), fields.alias("f")).select("id", length.alias("length"), words.alias("words"))


def asked_terms(queries: DataFrame, most: int = MOST_LITERALS) -> list[str] | None:
    """The distinct terms of the queries, or None if they are too many for a list."""
    found = [r["t"] for r in queries.select(F.explode("terms").alias("t")).distinct().limit(most + 1).collect()]
    return None if len(found) > most else found


def build(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "id", analyser: Callable[[Column], Column] = terms, queries: DataFrame | None = None) -> Index:
    """Analyse the columns of live rows once and count each term by row and column weight; queries need the same analyser.

    weights: by default the seven columns as they are indexed. queries: an index for these alone, made in one scan that
    lets go of all other terms before rows are spread out."""
    only = asked_terms(queries) if queries is not None else None
    rows = analysed(indexed(df) if weights is None else df, weights or WEIGHTS, id_col, analyser, only)
    if only is not None:
        return _reduced(rows if only else rows.limit(0))
    words = rows.select("id", "length", F.explode("words").alias("x")).select("id", "length", "x.*")
    postings = words.groupBy("term", "id", "length").agg(F.sum("w").alias("tf"))
    return Index(postings, rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")))


def _reduced(rows: DataFrame) -> Index:
    """An index of rows whose words are few: each row counts once, without an id, beside its words, so that one scan yields both tables."""
    own = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("w"))), "words")
    words = rows.select("id", "length", F.explode(own).alias("x"))
    counted = cut(words.groupBy("x.term", F.when(F.col("x.term").isNotNull(), F.col("id")).alias("id"), "length").agg(F.sum("x.w").alias("tf"), F.count("*").alias("n")))
    corpus = counted.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("mean_length"))
    return Index(counted.where("term is not null").select("term", "id", "length", "tf"), corpus)


class Scanned:
    """Rows that have no index: each group of queries makes one of its own terms, in one scan, as build() does."""

    def __init__(self, df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "id", analyser: Callable[[Column], Column] = terms):
        self.of = lambda queries: build(df, weights, id_col, analyser, queries)


def idf(docs: Column, df: Column) -> Column:
    return F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def saturated(tf: Column, length: Column, mean_length: Column) -> Column:
    """The part of a term's score that its row decides."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def bm25(index: Index | Scanned, queries: DataFrame, *, all_terms: bool = True) -> DataFrame:
    """qid, id, score (larger is better): rows that hold all distinct terms of the query, or any of them."""
    index = index.of(queries)
    asked = queries.select("qid", F.array_distinct("terms").alias("terms")).select("qid", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    hits = index.postings.join(asked, "term")
    df = index.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(index.corpus))  # one row
    part = idf(F.col("docs"), F.col("df")) * saturated(F.col("tf"), F.col("length"), F.col("mean_length"))
    out = scored.groupBy("qid", "id").agg(F.sum(part).alias("score"), F.count("*").alias("met"), F.first("n_terms").alias("n_terms"))
    return out.where(F.col("met") == F.col("n_terms") if all_terms else F.col("met") >= 1).select("qid", "id", "score")


def ranked(hits: DataFrame, limit: int | None = None, *order) -> DataFrame:
    """hits with their position in each query's list, best score first and smaller id on ties."""
    out = hits.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*(order or (F.desc("score"), F.asc("id"))))))
    return out if limit is None else out.where(F.col("position") <= limit)


def topic_exact(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows whose topic key is the query."""
    hits = df.join(queries.select("qid", F.col("text").alias("topic_key")), "topic_key")
    return ranked(hits.select("qid", "id", F.lit(1000.0).alias("score"), "updated_at"), None, F.desc("updated_at"), F.asc("id")).drop("updated_at")


def topic_expansion(df: DataFrame, queries: DataFrame, least_bytes: int = 3) -> DataFrame:
    """Rows whose topic key holds a query term: keys are matched once, rows join the keys."""
    keys = df.select("topic_key").where("topic_key is not null").distinct()
    asked = queries.select("qid", F.explode(F.filter(search_terms(F.col("text")), lambda t: F.octet_length(t) >= least_bytes)).alias("term"))
    met = keys.join(F.broadcast(asked) if queries.isLocal() else asked, F.lower("topic_key").contains(F.col("term"))).select("qid", "topic_key").distinct()
    hits = df.join(met, "topic_key").select("qid", "id", F.lit(500.0).alias("score"), "updated_at")
    return ranked(hits, None, F.desc("updated_at"), F.asc("id")).drop("updated_at")


#: Bytes of a unit, of which sentence keys are made.
UNIT_BYTES = 1200


def facts_of(df: DataFrame) -> DataFrame:
    """observation_id, n, fact: the sentences of each row's units.

    A unit ends behind a sentence if it holds the end of one, so units matter only to rows with a sentence longer than a
    unit; only these are cut by a program."""
    rows = df.select(F.col("id").alias("observation_id"), F.coalesce("content", F.lit("")).alias("text"))
    rows = rows.withColumn("cut", pieces(F.col("text")))
    long = F.exists("cut", lambda s: F.octet_length(s) > UNIT_BYTES)
    short = rows.where(~long).select("observation_id", tidy(F.col("cut")).alias("facts"))
    cut_up = rows.where(long).select("observation_id", units("text").alias("units")).select("observation_id", tidy(F.flatten(F.transform("units", pieces))).alias("facts"))
    return short.unionByName(cut_up).select("observation_id", F.posexplode("facts").alias("n", "fact"))


FACTS = 1 << 31  # more than an observation has sentences


def fact_index(df: DataFrame, *, scanned: bool = False) -> tuple[Index | Scanned, DataFrame]:
    """An index of sentences, or scans of them, and the observation of each sentence."""
    facts = facts_of(df).select((F.col("observation_id").cast("decimal(28,0)") * FACTS + F.col("n")).alias("id"), "observation_id", "fact")
    if scanned:  # the id tells the observation
        return Scanned(facts, {"fact": 1.0}), None
    return build(facts, {"fact": 1.0}), facts.select("id", "observation_id")


def fact_hits(index: Index | Scanned, owners: DataFrame | None, queries: DataFrame, limit: int, over_fetch: int = 20) -> DataFrame:
    """Observations by their best sentence, each seen once. queries: (qid, text); interrogatives don't have to occur, and a
    question of nothing else has no list."""
    asked = queries.select("qid", key_terms(F.col("text")).alias("terms"))
    pool = ranked(bm25(index, asked), limit * over_fetch, F.round("score", 9).desc(), F.asc("id"))
    pool = pool.withColumn("observation_id", F.floor((F.col("id") - F.pmod("id", F.lit(FACTS).cast("decimal(28,0)"))) / FACTS).cast("long")) if owners is None else pool.join(owners, "id")
    first = pool.groupBy("qid", F.col("observation_id").alias("id")).agg(F.min("position").alias("at"), F.max("score").alias("score"))
    return ranked(first, limit, F.asc("at"), F.asc("id")).drop("at")


def feedback_terms(hits: DataFrame, df: DataFrame, queries: DataFrame, *, top: int = 3, head: int = 300, least: int = 2, most_terms: int = 3) -> DataFrame:
    """qid, term: the new terms that the first hits of a query use at least twice."""
    first = hits.where(F.col("position") <= top)
    enough = first.groupBy("qid").agg(F.count("*").alias("n")).where("n >= 2").select("qid")
    heads = df.select("id", F.substring(F.concat_ws(" ", "title", "content"), 1, head).alias("text"))  # no more of a text is moved
    texts = first.join(enough, "qid", "left_semi").join(heads, "id").select("qid", "text")
    used = texts.select("qid", F.explode(terms(F.col("text"))).alias("term")).where(F.char_length("term") >= 3)
    counts = used.groupBy("qid", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    new = counts.join(queries.select("qid", F.explode("terms").alias("term")), ["qid", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), F.asc("term")))
    return new.withColumn("nth", place).where(F.col("nth") <= most_terms).select("qid", "term", "n", "nth")


def with_feedback(index: Index | Scanned, df: DataFrame, queries: DataFrame, limit: int, first: DataFrame | None = None) -> DataFrame:
    """What the query with its feedback terms finds beyond the first list, which is three times the limit long."""
    best = (F.round("score", 9).desc(), F.asc("id"))
    first = cut(ranked(bm25(index, queries), 3 * limit, *best)) if first is None else first
    more = feedback_terms(first, df, queries).groupBy("qid").agg(F.collect_list("term").alias("more"))
    wider = cut(queries.join(more, "qid").select("qid", F.concat("terms", "more").alias("terms")))
    found = ranked(bm25(index, wider), limit, *best)
    return found.join(first.select("qid", "id"), ["qid", "id"], "left_anti")


def relaxed(index: Index | Scanned, queries: DataFrame, limit: int) -> DataFrame:
    """The strict list of each query, or where it is empty the list of any term."""
    index = index.of(queries)
    strict = bm25(index, queries).withColumn("tier", F.lit(0))
    loose = bm25(index, queries, all_terms=False).withColumn("tier", F.lit(1))
    both = strict.unionByName(loose)
    kept = both.withColumn("first", F.min("tier").over(Window.partitionBy("qid"))).where("tier = first").drop("first")
    return ranked(kept, limit)


def relaxed_tiers(index: Index | Scanned, queries: DataFrame, limit: int) -> DataFrame:
    """qid, id, score, position, tier of queries (qid, text): rows with all words (0), where there are none with all content
    words (1), else with any of them (2). The last two apply only if a query has both content words and others."""
    words = queries.select("qid", F.array_distinct(terms(F.col("text"))).alias("words"), search_terms(F.col("text")).alias("content"))
    mixed = (F.size("content") > 0) & (F.size("content") < F.size("words"))
    found = bm25(index, words.select("qid", F.col("words").alias("terms"))).withColumn("tier", F.lit(0))
    for tier, every in ((1, True), (2, False)):
        left = words.where(mixed).join(found.select("qid").distinct(), "qid", "left_anti").select("qid", F.col("content").alias("terms"))
        found = found.unionByName(bm25(index, left, all_terms=every).withColumn("tier", F.lit(tier)))
    return ranked(found, limit, F.round("score", 9).desc(), F.asc("id"))


def with_synonyms(index: Index | Scanned, queries: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """The hits, and for queries (qid, text) without any the rows with any of their corrected words or their synonyms; a
    query that has alternatives or quotes of its own is left alone."""
    free = queries.where(~F.lower("text").contains(" or ") & ~F.col("text").contains('"')).join(hits.select("qid").distinct(), "qid", "left_anti")
    wider = free.select("qid", F.array_distinct(terms(F.regexp_replace(expanded_query(F.col("text")), " or ", " "))).alias("terms"))
    more = ranked(bm25(index, wider, all_terms=False), limit, F.round("score", 9).desc(), F.asc("id"))
    return hits.select("qid", "id", "score", "position").unionByName(more.select("qid", "id", "score", "position"))


def neighbours(hits: DataFrame, edges: DataFrame, *, top: int = 5, dead: tuple[str, ...] = ("deprecated", "superseded")) -> DataFrame:
    """qid, id: neighbours of the first hits over live edges, both ways, without the hits themselves."""
    live = (edges.where(~F.col("fact_state").isin(*dead)) if dead else edges).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = hits.where(F.col("position") <= top).join(both, hits["id"] == both["a"]).select("qid", F.col("b").alias("id")).distinct()
    return near.join(hits.select("qid", "id"), ["qid", "id"], "left_anti")


def temporal_neighbours(hits: DataFrame, facts: DataFrame, obs: DataFrame, at: Column, *, top: int = 5) -> DataFrame:
    """qid, id: live neighbours of the first hits over facts valid at a time, created by then."""
    near = neighbours(hits, valid_at(facts, at), top=top, dead=())
    return near.join(obs.where(F.col("deleted_at").isNull() & (F.col("created_at") <= at)).select("id"), "id", "left_semi").select("qid", "id")
