"""Full-text search over postings of the words that are asked for.

Postings are rows (doc, len, term, tf, positions); a set of queries is rows (query, term). Words that no query asks for are
dropped where the text is, so what is shuffled are hits. A corpus that is searched often has its whole postings written once as
a table. Scores are computed on ids; texts are joined after the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ingest import latest_per_key
from factloom.operators.predicates import where
from factloom.session import cut_lineage

# Words that no query asks for.
STOP_WORDS = [
    "a", "about", "after", "all", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has",
    "have", "he", "how", "if", "in", "into", "is", "it", "its", "more", "most", "no", "not", "of", "on", "or", "other", "our", "out", "over", "s",
    "so", "some", "such", "t", "than", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "under", "up", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "will", "with", "would", "you", "your",
]
#: Most distinct query terms that are broadcast to the texts; beyond it terms and texts meet in a shuffle.
BROADCAST_TERMS = 100_000


def stem(word: Column) -> Column:
    """An English word without its plural ending: -ies becomes -y, -es -e, and -s is dropped, but not after u or s."""
    return (
        F.when(word.rlike("[^ea]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("[^aeo]es$"), F.regexp_replace(word, "s$", ""))
        .when(word.rlike("[^aeus]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def tokens(text: Column, stemmed: bool = False) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    return F.transform(words, stem) if stemmed else words


def postings(docs: DataFrame, doc_id: str, text: str, positions: bool = False, terms: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """(doc, len, term, tf) of each document's terms, with positions on request; NULL and empty texts have none.

    ``terms``: keep only these, which are broadcast if they are few, and a row without a term for each document with words.
    """
    words = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text), stemmed).alias("w")).withColumn("len", F.size("w"))
    rows = words.select("doc", "len", F.posexplode("w").alias("pos", "term"))
    if terms is not None:
        wanted = terms.select("term", F.lit(True).alias("_hit")).distinct()
        if wanted.count() <= BROADCAST_TERMS:
            marked = words.where("len > 0").select("doc", "len", F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("pos", "term"))
            rows = marked.join(F.broadcast(wanted), "term", "left").where("_hit OR term IS NULL")
        else:
            rows = rows.join(wanted, "term").unionByName(words.where("len > 0").select("doc", "len", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("term"), F.lit(True).alias("_hit")))
    extra = [F.array_sort(F.collect_list("pos")).alias("positions")] if positions else []
    return rows.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"), *extra)


def query_terms(queries: DataFrame, query_id: str, text: str, drop_stop_words: bool = True, stemmed: bool = False) -> DataFrame:
    """(query, term_no, term, n_terms): the distinct terms of each query, numbered from 0."""
    terms = tokens(F.col(text))
    if drop_stop_words:
        terms = F.filter(terms, lambda t: ~t.isin(STOP_WORDS))
    terms = F.array_distinct(F.transform(terms, stem) if stemmed else terms)
    return queries.select(F.col(query_id).alias("query"), terms.alias("t")).select("query", F.posexplode("t").alias("term_no", "term"), F.size("t").alias("n_terms"))


def chunk_directory(chunks: DataFrame, filings: DataFrame, companies: DataFrame, **filters: object) -> DataFrame:
    """Chunks with ticker, fiscal_year and form of their filing and company; repeated ids once, unknown filings and companies not at all.

    ``filters``: ticker, fiscal_year, form, section; empty ones are no filter. They are applied to the tables before these are joined.
    """
    own = {k: v for k, v in filters.items() if k not in ("ticker", "fiscal_year", "form")}
    dated = where(filings.select(F.col("id").alias("filing_id"), "cik", "fiscal_year", "form"), **{k: filters[k] for k in ("fiscal_year", "form") if k in filters})
    known = where(companies.select("cik", "ticker"), **{k: filters[k] for k in ("ticker",) if k in filters})
    return latest_per_key(where(chunks, **own), ["id"], ["created_at", "char_offset_start"]).join(dated.join(known, "cik"), "filing_id")


def match_all(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, doc): documents that hold every term of the query."""
    hits = posts.join(terms, "term").groupBy("query", "doc", "n_terms").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n = n_terms").select("query", "doc")


def bm25(posts: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score): BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); any term may match.

    ``posts`` are those of all terms, or of those asked for with a row for each document.
    """
    size = posts.groupBy("doc").agg(F.first("len").alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")).first()
    df = posts.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(size["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(size["avg_len"] or 1.0)))
    rows = posts.join(terms.select("query", "term").join(df, "term"), "term")
    return rows.groupBy("query", "doc").agg(F.sum(idf * tf).alias("score"))


def search(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k: int, stemmed: bool = False) -> DataFrame:
    """(query, doc, score, rank): the best ``k`` documents of each query by BM25. Hits are written once and read for
    frequencies and scores; scores are rounded to nine places so that ties don't hang on the order of addition."""
    terms = cut_lineage(query_terms(queries, query_id, query, stemmed=stemmed))
    posts = cut_lineage(postings(docs, doc_id, text, terms=terms, stemmed=stemmed))
    return top_k(bm25(posts, terms).withColumn("score", F.round("score", 9)), k)


def cover_density(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, doc, score) of documents with all terms: the sum over minimal covers of 1 / length.

    ``posts`` must have positions. A cover is a shortest stretch of words with every query term. Each place knows the last place
    of every term up to it by a running maximum per term number, so the work grows with the places, not their square.
    """
    most = terms.agg(F.max("n_terms")).first()[0] or 0
    rows = posts.join(terms, "term").select("query", "doc", "term_no", "n_terms", "positions")
    full = rows.groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("_n")).where("n = _n").select("query", "doc")
    hits = rows.join(full, ["query", "doc"]).select("query", "doc", "term_no", "n_terms", F.explode("positions").alias("pos"))
    so_far = Window.partitionBy("query", "doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = hits.select("*", *[F.max(F.when(F.col("term_no") == k, F.col("pos"))).over(so_far).alias(f"_{k}") for k in range(most)])
    # NULL as long as a term hasn't come; terms beyond the query's own don't count.
    start = F.least(*[F.lit(1 << 30)] * 2, *[F.when(F.col("n_terms") > k, F.coalesce(f"_{k}", F.lit(-1))).otherwise(1 << 30) for k in range(most)])
    shortest = last.select("query", "doc", "pos", start.alias("start")).where("start >= 0").groupBy("query", "doc", "start").agg(F.min("pos").alias("pos"))
    return shortest.groupBy("query", "doc").agg(F.sum(1 / (F.col("pos") - F.col("start") + 1)).alias("score"))


def top_k(scored: DataFrame, k: int, query: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """Adds rank (from 1) and keeps the first k per query; ties go to the smaller id.

    Spark cuts each task's rows to k per query before the shuffle (window group limit).
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(lists: Sequence[DataFrame], names: Sequence[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query, doc, rank): query, doc, <name>_rank..., rrf_score, rank.

    The score is the sum of 1 / (k + rank) over the lists that have the document; a rank is NULL where the list
    lacks it. Ties go to the better rank in the earlier list.
    """
    tagged = None
    for frame, name in zip(lists, names):
        part = frame.select("query", "doc", F.lit(name).alias("list"), F.col("rank").alias("r"))
        tagged = part if tagged is None else tagged.unionByName(part)
    ranks = [F.min(F.when(F.col("list") == n, F.col("r"))).alias(f"{n}_rank") for n in names]
    fused = tagged.groupBy("query", "doc").agg(*ranks)
    score = sum((F.coalesce(1 / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n in names), F.lit(0.0))
    w = Window.partitionBy("query").orderBy(F.desc("rrf_score"), *[F.asc_nulls_last(f"{n}_rank") for n in names], "doc")
    return fused.withColumn("rrf_score", score).withColumn("rank", F.row_number().over(w))


def rerank(pairs: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Order (query, doc, ...) by a scorer column, missing scores as 0, and keep k per query."""
    return top_k(pairs.withColumn("rerank_score", F.coalesce(scorer, F.lit(0.0))), k, score="rerank_score")


def term_overlap(query_text: Column, text: Column) -> Column:
    """A scorer without a model: the share of the query's terms that the text has."""
    q = F.array_distinct(F.filter(tokens(query_text), lambda t: ~t.isin(STOP_WORDS)))
    return F.try_divide(F.size(F.array_intersect(q, tokens(text))).cast("double"), F.size(q).cast("double"))
