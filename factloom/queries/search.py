"""Queries on retrieval: every item whose id is divisible by 50 is a query, against all rows; evaluation takes all items."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numbers import extract_numbers
from factloom.operators import search, vectors
from factloom.operators.predicates import where
from factloom.plans import ablation
from factloom.session import cut_lineage
from factloom.sources.tables import table

_K = 10


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the evaluation items whose id is divisible by 50."""
    return table(spark, sf, "eval_items").where("item_id % 50 = 0").select("item_id", "question")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every label that a section has, as a query of its own."""
    return table(spark, sf, "filing_sections").select(F.col("item_label").alias("label")).where("label IS NOT NULL").distinct()


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def fts_and_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all words of a label, whatever their number."""
    terms = search.query_terms(_labels(spark, sf), "label", "label", stemmed=True)
    posts = search.postings(_docs(spark, sf), "doc_id", "text", terms=terms, stemmed=True)
    return search.match_all(posts, terms).withColumnsRenamed({"query": "label", "doc": "doc_id"})


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = search.search(_docs(spark, sf), _queries(spark, sf), "doc_id", "text", "item_id", "question", _K)
    return best.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_FILTERS = {"form": ["10-K", "10-Q"], "section": ["Item 1A", "Item 2", "Item 7"], "fiscal_year": list(range(2013, 2020))}


def _directory(spark: SparkSession, sf: str, **filters: object) -> DataFrame:
    return search.chunk_directory(table(spark, sf, "chunks"), table(spark, sf, "filings"), table(spark, sf, "companies"), **filters)


def bm25_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search among chunks of annual and quarterly reports, three items and seven years."""
    chunks = _directory(spark, sf, **_FILTERS)
    best = search.search(chunks, _queries(spark, sf), "id", "text", "item_id", "question", _K)
    about = chunks.select(F.col("id").alias("doc"), "ticker", "fiscal_year", "form", "section")
    return best.join(about, "doc").select(F.col("query").alias("item_id"), F.col("doc").alias("chunk_id"), "ticker", "fiscal_year", "form", "section", "rank", F.round("score", 6).alias("score"))


def cover_density_topk(spark: SparkSession, sf: str) -> DataFrame:
    terms = search.query_terms(_labels(spark, sf), "label", "label")
    posts = search.postings(_docs(spark, sf), "doc_id", "text", positions=True, terms=terms)
    best = search.top_k(search.cover_density(posts, terms).withColumn("score", F.round("score", 9)), _K)
    return best.select(F.col("query").alias("label"), F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _nearest(spark: SparkSession, sf: str, **filters: object) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.nearest(e.where("vec_id % 50 = 0"), where(e, **filters), _K)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", F.round("score", 6).alias("similarity"))


def vector_topk_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an inverted-list index over all rows; half of the lists, for these vectors form no clusters."""
    e = table(spark, sf, "embeddings")
    best = vectors.nearest_indexed(e.where("vec_id % 50 = 0"), vectors.build_index(e), _K, probes=32)
    return best.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", F.round("score", 6).alias("similarity"))


def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, label=[1, 3]).select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", F.round("score", 6).alias("similarity"))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two vector searches, one over all rows and one over two labels, fused by rank."""
    fused = search.fuse([_nearest(spark, sf), _nearest(spark, sf, label=[1, 3])], ["all", "some"]).where(F.col("rank") <= _K)
    return fused.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "all_rank", "some_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def term_vector(text: pd.Series) -> pd.Series:
    """A deterministic stand-in for an embedding model: signed counts of hashed terms, length 1."""

    def one(t: str | None) -> np.ndarray:
        v = np.zeros(64)
        for w in set(re.findall("[a-z0-9]+", (t or "").lower())):
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h & 4096 else -1
        return v / max(1e-12, np.sqrt(v @ v))

    return text.map(one)


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical and vector top 20 over the chunks of two forms and seven years, fused, enriched with their text, and reranked to 10."""
    chunks = cut_lineage(_directory(spark, sf, form=_FILTERS["form"], fiscal_year=_FILTERS["fiscal_year"]).select("id", "filing_id", "ticker", "form", "fiscal_year", "text"))
    queries = _queries(spark, sf).select(F.col("item_id").cast("string").alias("id"), F.col("question").alias("text"))
    lexical = search.search(chunks, queries, "id", "text", "id", "text", 20)
    dense = vectors.nearest(queries.select("id", term_vector(F.col("text")).alias("v")), chunks.select("id", term_vector(F.col("text")).alias("v")), 20, "id", "v")
    fused = search.fuse([lexical, dense], ["bm25", "dense"]).where("rank <= 20")
    enriched = fused.join(chunks.withColumnRenamed("id", "doc"), "doc").join(queries.select(F.col("id").alias("query"), F.col("text").alias("question")), "query")
    best = search.rerank(enriched.withColumnRenamed("rank", "fused_rank"), search.term_overlap(F.col("question"), F.col("text")), _K)
    return best.select(F.col("query").alias("item_id"), F.col("doc").alias("chunk_id"), "filing_id", "ticker", "fiscal_year", "bm25_rank", "dense_rank", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


def eval_by_config(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation item under the lexical and the hybrid configuration, and the latter with facts.

    The items name no tickers and years, so the facts step takes the revenue facts of all.
    """
    gold = F.get(extract_numbers("gold_answer"), F.lit(0))["value"]
    questions = table(spark, sf, "eval_items").select(F.col("item_id").alias("id"), "tier", F.col("question").alias("text"), gold.alias("gold"))
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "id")
    return ablation.evaluate_all(questions, docs, [name for name, step in ablation.STEPS if step in ablation.RUN_HERE], term_vector, table(spark, sf, "xbrl_facts"), table(spark, sf, "companies"))


QUERIES = {f.__name__: f for f in (fts_and_match, bm25_topk, bm25_filtered_topk, cover_density_topk, vector_topk, vector_topk_indexed, vector_topk_filtered, rrf_fusion, hybrid_topk, eval_by_config)}

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
_NEAR = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS s FROM e q, e r WHERE q.vec_id % 50 = 0)"""
_TERMS = f"terms AS (SELECT item_id, unnest(list_filter(list_distinct({_WORDS.format('question')}), lambda t: t NOT IN ({_STOP}))) AS term FROM eval_items WHERE item_id % 50 = 0)"
_POSTS = f"words AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), posts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2)"

_LABELS = "labels AS (SELECT DISTINCT item_label AS label FROM filing_sections WHERE item_label IS NOT NULL)"
_STEM = """CASE WHEN regexp_matches(t, '[^ea]ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '[^aeo]es$') OR regexp_matches(t, '[^aeus]s$') THEN regexp_replace(t, 's$', '') ELSE t END"""

SQL = {
    "fts_and_match": f"""WITH {_LABELS}, t AS (SELECT label, unnest(list_distinct(list_transform(list_filter({_WORDS.format("label")}, lambda t: t NOT IN ({_STOP})), lambda t: {_STEM}))) AS term FROM labels),
      n AS (SELECT label, count(*) AS n FROM t GROUP BY 1), p AS (SELECT DISTINCT doc_id, unnest(list_transform({_WORDS.format("text")}, lambda t: {_STEM})) AS term FROM documents)
      SELECT label, doc_id FROM t JOIN p USING (term) JOIN n USING (label) GROUP BY label, doc_id, n HAVING count(*) = n""",
    "bm25_filtered_topk": f"""WITH chosen AS (SELECT DISTINCT c.id, ticker, fiscal_year, form, section, c.text FROM chunks c JOIN filings f ON f.id = c.filing_id JOIN companies k ON k.cik = f.cik
        WHERE form IN ('10-K', '10-Q') AND section IN ('Item 1A', 'Item 2', 'Item 7') AND fiscal_year BETWEEN 2013 AND 2019),
      {_TERMS}, words AS (SELECT id, unnest({_WORDS.format("text")}) AS term FROM chosen), posts AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
      lens AS (SELECT id, sum(tf) AS len FROM posts GROUP BY 1), size AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM lens), df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
      s AS (SELECT item_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score
        FROM terms JOIN posts USING (term) JOIN df USING (term) JOIN lens USING (id), size GROUP BY 1, 2),
      b AS (SELECT item_id, id, cast(row_number() OVER w AS INTEGER) AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10)
      SELECT item_id, id AS chunk_id, ticker, fiscal_year, form, section, rank, score FROM b JOIN chosen USING (id)""",
    "cover_density_topk": f"""WITH {_LABELS}, t AS (SELECT label, unnest(list_distinct(list_filter({_WORDS.format("label")}, lambda t: t NOT IN ({_STOP})))) AS term FROM labels),
      n AS (SELECT label, count(*) AS n FROM t GROUP BY 1), w AS (SELECT doc_id, {_WORDS.format("text")} AS l FROM documents), p AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM w),
      h AS (SELECT label, doc_id, n, term, pos FROM t JOIN p USING (term) JOIN n USING (label)),
      l AS (SELECT a.label, a.doc_id, a.pos, a.n, b.term, max(b.pos) AS last FROM h a JOIN h b ON a.label = b.label AND a.doc_id = b.doc_id AND b.pos <= a.pos GROUP BY ALL),
      c AS (SELECT label, doc_id, pos, min(last) AS start FROM l GROUP BY label, doc_id, pos, n HAVING count(*) = n),
      m AS (SELECT label, doc_id, start, min(pos) AS pos FROM c GROUP BY ALL), s AS (SELECT label, doc_id, round(sum(1 / (pos - start + 1)), 9) AS score FROM m GROUP BY 1, 2)
      SELECT label, doc_id, cast(row_number() OVER w AS INTEGER) AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
    "bm25_topk": f"""WITH {_TERMS}, {_POSTS}, lens AS (SELECT doc_id, sum(tf) AS len FROM posts GROUP BY 1), size AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM lens),
      df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
      s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score
        FROM terms JOIN posts USING (term) JOIN df USING (term) JOIN lens USING (doc_id), size GROUP BY 1, 2)
      SELECT item_id, doc_id, cast(row_number() OVER w AS INTEGER) AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
    "vector_topk": f"WITH {_NEAR} SELECT query_id, vec_id, cast(row_number() OVER w AS INTEGER) AS rank, round(s, 6) AS similarity FROM s WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 10",
    "vector_topk_filtered": f"WITH {_NEAR} SELECT query_id, vec_id, cast(row_number() OVER w AS INTEGER) AS rank, round(s, 6) AS similarity FROM s WHERE label IN (1, 3) WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 10",
    "rrf_fusion": f"""WITH {_NEAR}, a AS (SELECT query_id, vec_id, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 10),
      b AS (SELECT query_id, vec_id, row_number() OVER w AS r FROM s WHERE label IN (1, 3) WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 10),
      f AS (SELECT query_id, vec_id, cast(a.r AS INTEGER) AS all_rank, cast(b.r AS INTEGER) AS some_rank, coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0) AS x FROM a FULL JOIN b USING (query_id, vec_id))
      SELECT query_id, vec_id, all_rank, some_rank, round(x, 9) AS rrf_score, cast(row_number() OVER w AS INTEGER) AS rank FROM f
      WINDOW w AS (PARTITION BY query_id ORDER BY x DESC, all_rank NULLS LAST, some_rank NULLS LAST, vec_id) QUALIFY row_number() OVER w <= 10""",
}
