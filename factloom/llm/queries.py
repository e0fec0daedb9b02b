"""Queries p1, p4 to p8 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.keys import accession_key, digest
from factloom.llm import language
from factloom.llm.leakage import contained_items, leaked_items
from factloom.llm.mixing import mix_sources, mixed_sequences
from factloom.llm.neardup import duplicate_groups, expand_pairs, near_duplicates
from factloom.llm.splitting import oversized, split_texts
from factloom.llm.survivors import best_representatives
from factloom.sources.tables import table

_FIELDS = ("concept", "unit", "fiscal_period", "form")


def _usable(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    """Facts that name a figure, and the key of the figure."""
    facts = table(spark, sf, "xbrl_facts")
    acc = accession_key(F.col("accession_number"))
    usable = facts.where(acc.isNotNull() & F.col("cik").isNotNull() & F.col("canonical_concept").isNotNull() & F.col("period_end").isNotNull())
    return usable, [F.col("cik"), F.col("canonical_concept"), F.col("period_start"), F.col("period_end"), acc]


def _representatives(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    usable, keys = _usable(spark, sf)
    keep = [F.col("cik"), F.col("canonical_concept"), F.col("period_start"), F.col("period_end"), keys[-1].alias("accession_key")]
    return best_representatives(usable, keys, "id", "value", "created_at", _FIELDS, ("concept", "unit", "fiscal_period"), keep)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _representatives(spark, sf)[0].select("survivor_id")


def p1_golden_records(spark: SparkSession, sf: str) -> DataFrame:
    return _representatives(spark, sf)[0].withColumnRenamed("val", "value")


def p1_precedence(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _FIELDS)), F.col("field") + 1)
    return _representatives(spark, sf)[1].withColumn("field", name)


def p1_undated_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Currency reasoning on facts of which a third has lost its time, against the values that the times give.

    Per field: figures with several records, those of them in which the field changes and a record has lost its time, and in how many of
    each the value found is the latest one.
    """
    facts, keys = _usable(spark, sf)
    key, lost = digest(*keys).alias("k"), F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    find = lambda df: best_representatives(df, keys, "id", "value", "created_at", _FIELDS, _FIELDS[:3], [key])[0].select("k", *_FIELDS)
    blanked = facts.withColumn("created_at", F.when(~lost, F.col("created_at")))
    change = facts.groupBy(key).agg(F.max(lost).alias("lost"), *[(F.min(f) < F.max(f)).alias(f"c_{f}") for f in _FIELDS])
    found = find(blanked).withColumnsRenamed({f: f"n_{f}" for f in _FIELDS})
    rows = find(facts).join(found, "k").join(change, "k")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"n_{f}")).alias("same"), (F.col(f"c_{f}") & F.col("lost")).alias("open")) for f in _FIELDS]))
    return (
        rows.select(each.alias("x")).select("x.*").groupBy("field")
        .agg(F.count(F.lit(1)).alias("n_figures"), F.count_if("same").alias("n_same"), F.count_if("open").alias("n_open"), F.count_if(F.col("open") & F.col("same")).alias("n_open_same"))
    )


def _near_duplicates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sections, versions = table(spark, sf, "filing_sections"), table(spark, sf, "section_versions")
    texts = sections.select(F.lit("filing_sections").alias("set"), "id", F.col("text_md").alias("text"))
    texts = texts.unionByName(versions.select(F.lit("section_versions").alias("set"), F.col("version_id").alias("id"), "text"))
    return near_duplicates(texts, run_words=3, threshold=0.6, least_words=20)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return expand_pairs(*_near_duplicates(spark, sf)).withColumnRenamed("set", "record_set")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(*_near_duplicates(spark, sf)).withColumnsRenamed({"set": "record_set", "class": "class_id", "group": "group_id"})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized sections and how many of their paragraphs had to be cut within, by the cuts made."""
    pieces = split_texts(oversized(table(spark, sf, "filing_sections"), "text_md"), "id", "text_md", with_text=False)
    return pieces.where("piece_no = 1").select(F.col("id").alias("section_id"), "forced_paragraphs")


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all sections, in the manner of chunks: offsets in the filing's full text."""
    sections = table(spark, sf, "filing_sections")
    about = sections.select("id", "filing_id", "section", "item_label", "char_offset_start")
    return (
        split_texts(sections, "id", "text_md")
        .join(about, "id")
        .select(
            F.col("id").alias("section_id"), "filing_id", "section", "item_label", "piece_no",
            (F.col("char_offset_start") + F.col("piece_start")).alias("char_offset_start"),
            (F.col("char_offset_start") + F.col("piece_end")).alias("char_offset_end"),
            "text", "cut",
        )
    )


def p5_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each section must satisfy: where they begin and end, and how many are too long, share less than
    the overlap with the piece before, or hold another text than the section's."""
    sections = table(spark, sf, "filing_sections").select(F.col("id").alias("_id"), "text_md")
    pieces = split_texts(table(spark, sf, "filing_sections"), "id", "text_md").join(sections, F.col("id") == F.col("_id"))
    before = F.lag("piece_end").over(Window.partitionBy("id").orderBy("piece_no"))
    same = F.substring("text_md", F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")) == F.col("text")
    rows = pieces.select("id", "piece_start", "piece_end", same.alias("same"), (before - F.col("piece_start")).alias("shared"))
    return rows.groupBy(F.col("id").alias("section_id")).agg(
        F.min("piece_start").alias("first_char"), F.max("piece_end").alias("last_char"), F.count_if(F.col("piece_end") - F.col("piece_start") > 4096).alias("n_long"),
        F.count_if(F.col("shared") < 200).alias("n_little_overlap"), F.count_if(~F.col("same")).alias("n_other_text"),
    )


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of which the mix used and left unused less than their target."""
    return _mix(spark, sf)[1].where("short").select("source")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p7_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_sequences(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", F.explode(F.array("question", "passage")).alias("passage"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), _passages(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("shared_words").alias("longest_run"))


def p6_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold 0.8 or more of the five-word shingles of an item's question or passage."""
    return contained_items(table(spark, sf, "documents"), _passages(spark, sf)).select("doc_id", "item_id", F.round("containment", 9).alias("containment"))


def _model(spark: SparkSession, sf: str) -> language.Model:
    return language.train(table(spark, sf, "lang_samples"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_cases(table(spark, sf, "documents"), _model(spark, sf)).select("doc_id", "seg_no", "lang")


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    return language.detect_languages(table(spark, sf, "documents"), _model(spark, sf))


QUERIES = {
    "p1_found": p1_found,
    "p1_golden_records": p1_golden_records,
    "p1_precedence": p1_precedence,
    "p1_undated_recall": p1_undated_recall,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_coverage": p5_coverage,
    "p6_found": p6_found,
    "p6_leaked_items": p6_leaked_items,
    "p6_contained": p6_contained,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_sequences": p7_sequences,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}

_GROUPS = """
WITH f AS (SELECT *, regexp_replace(accession_number, '[-\\s]', '', 'g') AS a FROM xbrl_facts WHERE regexp_replace(accession_number, '[-\\s]', '', 'g') <> ''
  AND cik IS NOT NULL AND canonical_concept IS NOT NULL AND period_end IS NOT NULL),
g AS (SELECT *, count(*) OVER same AS n, hash(cik) AS h, row_number() OVER (PARTITION BY cik, canonical_concept, period_start, period_end, a ORDER BY (value IS NULL)::INT,
  -((concept IS NOT NULL)::INT + (unit IS NOT NULL)::INT + (fiscal_period IS NOT NULL)::INT), created_at DESC, id) AS r
  FROM f WINDOW same AS (PARTITION BY cik, canonical_concept, period_start, period_end, a))
"""


def _latest(col: str) -> str:
    return f"arg_min({col}, struct_pack(a := epoch_us(TIMESTAMP '9999-12-31') - epoch_us(created_at), b := id)) FILTER ({col} IS NOT NULL)"


# DuckDB has no compatibility normalisation: ligatures are replaced, other such characters are no letters here.
_PLAIN = """regexp_extract_all(lower(regexp_replace(regexp_replace(replace(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'),
  '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'), '<[^<>]*>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"""


def _grams(n: int) -> str:
    """Runs of n words of documents (d) and of the questions and passages of items (p)."""
    gram = f"unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: struct_pack(i := i, g := array_to_string(w[i:i + {n - 1}], ' '))), recursive := true)"
    return f"""WITH x AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents), d AS (SELECT doc_id, {gram} FROM x WHERE len(w) >= {n}),
      y AS (SELECT item_id, part, {_PLAIN.format("t")} AS w FROM (SELECT item_id, 1 AS part, question AS t FROM eval_items UNION ALL SELECT item_id, 2, passage FROM eval_items)),
      p AS (SELECT item_id, part, {gram} FROM y WHERE len(w) >= {n})"""


SQL = {
    "p1_found": _GROUPS + "SELECT id AS survivor_id FROM g WHERE n > 1 AND r = 1",
    "p1_golden_records": _GROUPS
    + f"""SELECT min(id) FILTER (r = 1) AS survivor_id, cik, canonical_concept, period_start, period_end, a AS accession_key, {_latest("value")} AS value,
      {", ".join(f"{_latest(c)} AS {c}" for c in _FIELDS)}, count(*) AS n_records FROM g WHERE n > 1 GROUP BY cik, canonical_concept, period_start, period_end, a""",
    "p1_precedence": _GROUPS
    + """, s AS (SELECT cik, canonical_concept, period_start, period_end, a, field, created_at, list(DISTINCT state) AS states FROM (
        SELECT * FROM g, LATERAL (SELECT unnest(['concept', 'unit', 'fiscal_period', 'form']) AS field, unnest([concept, unit, fiscal_period, form]) AS state)) WHERE n > 1
        AND state IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL),
      l AS (SELECT field, states, lag(states) OVER (PARTITION BY cik, canonical_concept, period_start, period_end, a, field ORDER BY created_at) AS before FROM s),
      t AS (SELECT field, prev, unnest(states) AS state FROM (SELECT field, states, unnest(before) AS prev FROM l)),
      p AS (SELECT field, least(prev, state) AS lo, greatest(prev, state) AS hi, count(*) FILTER (prev < state) AS up, count(*) FILTER (prev > state) AS down
        FROM t WHERE prev <> state GROUP BY ALL)
      SELECT field, CASE WHEN up > down THEN lo ELSE hi END AS before, CASE WHEN up > down THEN hi ELSE lo END AS after, greatest(up, down) AS support, least(up, down) AS against
      FROM p WHERE up <> down""",
    "p4_found": """
      WITH t AS (SELECT 'filing_sections' AS record_set, id, text_md AS text FROM filing_sections UNION ALL SELECT 'section_versions', version_id, text FROM section_versions),
      w AS (SELECT record_set, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM t),
      s AS (SELECT record_set, id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 20),
      n AS (SELECT record_set, id, count(*) AS n FROM s GROUP BY 1, 2),
      c AS (SELECT a.record_set, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.record_set = b.record_set AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3)
      SELECT c.record_set, id_a, id_b FROM c JOIN n x ON x.record_set = c.record_set AND x.id = id_a JOIN n y ON y.record_set = c.record_set AND y.id = id_b
      WHERE c / (x.n + y.n - c) >= 0.6""",
    "p4_groups": """
      WITH RECURSIVE t AS (SELECT 'filing_sections' AS record_set, id, text_md AS text FROM filing_sections UNION ALL SELECT 'section_versions', version_id, text FROM section_versions),
      w AS (SELECT record_set, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM t), m AS (SELECT record_set, id, w, min(id) OVER (PARTITION BY record_set, w) AS class_id, count(*) OVER (PARTITION BY record_set, w) AS copies FROM w WHERE len(w) >= 20),
      s AS (SELECT record_set, id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM m WHERE id = class_id),
      n AS (SELECT record_set, id, count(*) AS n FROM s GROUP BY 1, 2),
      c AS (SELECT a.record_set, a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.record_set = b.record_set AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
      l AS (SELECT c.record_set, a, b FROM c JOIN n x ON x.record_set = c.record_set AND x.id = a JOIN n y ON y.record_set = c.record_set AND y.id = b WHERE c / (x.n + y.n - c) >= 0.6),
      e AS (SELECT record_set, a, b FROM l UNION ALL SELECT record_set, b, a FROM l), d AS (SELECT record_set, a, count(*) AS links FROM e GROUP BY 1, 2),
      r AS (SELECT record_set, a, b FROM e UNION SELECT r.record_set, r.a, e.b FROM r JOIN e ON r.record_set = e.record_set AND r.b = e.a),
      g AS (SELECT record_set, a, min(b) AS least FROM r GROUP BY 1, 2)
      SELECT m.record_set, id, class_id, coalesce(least(g.least, class_id), class_id) AS group_id, coalesce(links, 0) AS links, copies
      FROM m LEFT JOIN d ON d.record_set = m.record_set AND d.a = class_id LEFT JOIN g ON g.record_set = m.record_set AND g.a = class_id""",
    "p5_found": """
      SELECT id AS section_id, len(list_filter(string_split_regex(replace(replace(text_md, chr(13) || chr(10), chr(1) || chr(2)), chr(13), chr(10)),
        '(?:\\x01\\x02|\\n)(?:[ \\t]*(?:\\x01\\x02|\\n))+'), lambda x: len(x) > 4096)) AS forced_paragraphs FROM filing_sections WHERE len(text_md) > 4096""",
    "p5_coverage": """SELECT id AS section_id, 0 AS first_char, cast(length(text_md) AS INTEGER) AS last_char, 0::BIGINT AS n_long, 0::BIGINT AS n_little_overlap, 0::BIGINT AS n_other_text
      FROM filing_sections WHERE text_md <> ''""",
    "p6_found": _grams(12) + " SELECT DISTINCT doc_id, item_id FROM d JOIN p USING (g)",
    "p6_leaked_items": _grams(12)
    + """, m AS (SELECT DISTINCT doc_id, item_id, part, p.i AS i, d.i - p.i AS shift FROM d JOIN p USING (g)),
      r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, part, shift ORDER BY i) AS island FROM m),
      n AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, part, shift, island)
      SELECT item_id, count(DISTINCT doc_id) AS n_docs, cast(max(n) AS INTEGER) AS longest_run FROM n GROUP BY 1""",
    "p6_contained": _grams(5)
    + """, u AS (SELECT DISTINCT doc_id, g FROM d), v AS (SELECT DISTINCT item_id, part, g FROM p), size AS (SELECT item_id, part, count(*) AS n FROM v GROUP BY 1, 2),
      c AS (SELECT doc_id, item_id, count(*) / n AS c FROM u JOIN v USING (g) JOIN size USING (item_id, part) GROUP BY doc_id, item_id, part, n)
      SELECT doc_id, item_id, round(max(c), 9) AS containment FROM c WHERE c >= 0.8 GROUP BY 1, 2""",
    "p7_found": """
      WITH d AS (SELECT regexp_replace(lower(trim(source)), '[-\\s_]+', '_', 'g') AS source, len(text) AS n FROM documents),
      t AS (SELECT m.source, target_share, max_repeats, coalesce(sum(n), 0) AS n FROM mix_targets m LEFT JOIN d ON d.source = regexp_replace(lower(trim(m.source)), '[-\\s_]+', '_', 'g') GROUP BY 1, 2, 3)
      SELECT source FROM t WHERE n * max_repeats < target_share * (SELECT sum(n) FROM t)""",
}
