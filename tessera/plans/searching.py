"""Search queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, full_lines, tokens
from tessera.operators import search as S
from tessera.session import table

QUESTION = "when erased things and thereof onions are loaded"
RAW_QUESTION = "that order_and the on"
SYNONYM_QUESTION = "who printed averages of other erea inan thon"
#: v1 tokens of documents, in SQL
TOKENS = f"""
tw AS (SELECT doc_id AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9]*')) AS w FROM documents),
tp AS (SELECT id, lower(unnest(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))) AS t FROM tw),
tk AS (SELECT id, CASE WHEN t LIKE '%ies' AND length(t) >= 6 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ied' AND length(t) >= 6 THEN left(t, length(t) - 3) || 'y'
 WHEN t LIKE '%ing' AND length(t) >= 6 THEN left(t, length(t) - 3) WHEN t LIKE '%es' AND length(t) >= 5 THEN left(t, length(t) - 2)
 WHEN t LIKE '%s' AND length(t) >= 4 THEN left(t, length(t) - 1) WHEN t LIKE '%ed' AND length(t) >= 5 THEN left(t, length(t) - 2) ELSE t END AS term
 FROM tp WHERE length(t) >= 2 AND t NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
po AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY ALL),
fr AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM po GROUP BY term)"""


def _similar(question: str) -> str:
    words = S.words_of(question)
    share = " + ".join(f"CASE WHEN term = '{w}' THEN 1.0 WHEN length('{w}') >= 3 AND starts_with(term, '{w}') AND length(term) <= {len(w) + 4} THEN 0.5 ELSE 0.0 END" for w in words)
    reach = lambda w: f"CASE WHEN term = '{w}' OR (length('{w}') >= 3 AND starts_with(term, '{w}') AND length(term) <= {len(w) + 4}) THEN 1 ELSE 0 END"
    cover = " + ".join(f"max({reach(w)})" for w in words)
    return f"""{TOKENS},
qv AS (SELECT term, idf, ({share}) * idf AS q FROM fr),
sm AS (SELECT id, round(sum((1 + ln(tf)) * idf * q) / ((SELECT sqrt(sum(q * q)) FROM qv) * sqrt(sum(((1 + ln(tf)) * idf) * ((1 + ln(tf)) * idf)))) * (0.4 + 0.6 * ({cover}) / {len(words)}), 6) AS score
 FROM po JOIN qv USING (term) GROUP BY id HAVING sum((1 + ln(tf)) * idf * q) > 0)"""


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def tfidf_search_v0(spark, d):
    return S.search_raw(chunks(spark, d), RAW_QUESTION, 10)


def tfidf_search_v1(spark, d):
    return S.search(chunks(spark, d), QUESTION)


def keyword_search(spark, d):
    return S.keyword_search(chunks(spark, d), RAW_QUESTION, 10)


def token_stats(spark, d):
    """Per document: tokens and distinct tokens."""
    return chunks(spark, d).withColumn("t", tokens(F.col("text"))).select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def doc_frequency(spark, d):
    c = chunks(spark, d)
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    return S.frequencies(c).crossJoin(n).select("term", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def search_by_language(spark, d):
    c = chunks(spark, d)
    return S.top_per_group(S.similarities(c, QUESTION).join(c.select("id", "lang"), "id"), "lang", 6).select("lang", "id", "score", F.col("place").cast("long").alias("place"))


def prefix_expansion(spark, d):
    """Vocabulary terms that a question's word reaches by prefix."""
    terms = S.frequencies(chunks(spark, d))
    words = F.explode(F.array(*(F.lit(w) for w in S.words_of(QUESTION) if len(w) >= 3)))
    near = F.col("term").startswith(F.col("word")) & (F.length("term") <= F.length("word") + 4) & (F.col("term") != F.col("word"))
    return terms.select("term", words.alias("word")).where(near).select("word", "term")


def links(spark, d):
    """The next document of the same source; sure if the language is the same."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    n = docs.select(F.col("doc_id").alias("source"), F.lead("doc_id").over(w).alias("target"), F.when(F.lead("lang").over(w) == F.col("lang"), "high").otherwise("medium").alias("confidence"))
    return n.where("target IS NOT NULL")


def retrieve_expand(spark, d):
    return S.retrieve(chunks(spark, d), links(spark, d), QUESTION)


def synonym_search(spark, d):
    return S.synonym_search(chunks(spark, d), SYNONYM_QUESTION)


def path_confidence(spark, d):
    """Steps: turns of a conversation, linked if one role follows another."""
    turns = table(spark, d, "conversations")
    steps = turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.concat("role", F.lit("/"), F.length("text") % 7).alias("id"))
    known = turns.select(F.concat("role", F.lit("/"), F.length("text") % 7).alias("source"), F.col("role")).distinct()
    pairs = known.select("source", F.when(F.col("role") == "user", "assistant/3").otherwise("user/2").alias("target"), F.when(F.col("role") == "user", "high").otherwise("medium").alias("confidence"))
    return S.path_confidence(steps, pairs)


def language_table(spark, d):
    """Documents, lines and rounded percent of lines by language."""
    docs = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum(full_lines(F.col("text"))).alias("lines"))
    total = F.broadcast(docs.agg(F.sum("lines").alias("total")))
    return docs.crossJoin(total).select("lang", "files", "lines", F.bround(100 * F.col("lines") / F.col("total")).cast("long").alias("percent"))


SYN = " ".join([SYNONYM_QUESTION, *(s for w in SYNONYM_QUESTION.split() for s in S.synonyms_of(w))])
_RAW = {w: S.raw_words_of(RAW_QUESTION).count(w) for w in S.raw_words_of(RAW_QUESTION)}
RAW_TOKENS = """
rw AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*')) AS w FROM documents),
rt AS (SELECT id, w AS term FROM rw UNION ALL SELECT * FROM (SELECT id, unnest(string_split(w, '_')) AS term FROM rw) WHERE term <> '')"""
QUERIES = {
    "tfidf_search_v0": tfidf_search_v0,
    "tfidf_search_v1": tfidf_search_v1,
    "keyword_search": keyword_search,
    "token_stats": token_stats,
    "doc_frequency": doc_frequency,
    "search_by_language": search_by_language,
    "prefix_expansion": prefix_expansion,
    "retrieve_expand": retrieve_expand,
    "synonym_search": synonym_search,
    "path_confidence": path_confidence,
    "language_table": language_table,
}
ORACLES = {
    "tfidf_search_v0": f"""WITH {RAW_TOKENS}, po AS (SELECT id, term, count(*) AS tf FROM rt GROUP BY ALL),
fr AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM po GROUP BY term),
qv AS (SELECT term, idf, idf * CASE term {' '.join(f"WHEN '{w}' THEN {c}" for w, c in _RAW.items())} ELSE 0 END AS q FROM fr)
SELECT id, round(sum(tf * idf * q) / ((SELECT sqrt(sum(q * q)) FROM qv) * sqrt(sum((tf * idf) * (tf * idf)))), 6) AS score FROM po JOIN qv USING (term) GROUP BY id HAVING sum(tf * idf * q) > 0 ORDER BY score DESC, id LIMIT 10""",
    "tfidf_search_v1": f"WITH {_similar(QUESTION)} SELECT id, score FROM sm ORDER BY score DESC, id LIMIT 6",
    "keyword_search": f"WITH {RAW_TOKENS} SELECT id, count(*) AS score FROM rt WHERE term IN ({', '.join(repr(w) for w in _RAW)}) GROUP BY id ORDER BY score DESC, id LIMIT 10",
    "token_stats": f"WITH {TOKENS} SELECT doc_id AS id, count(term) AS n_tokens, count(DISTINCT term) AS n_distinct FROM documents LEFT JOIN tk ON doc_id = id GROUP BY doc_id",
    "doc_frequency": f"WITH {TOKENS} SELECT term, df, round(idf, 6) AS idf FROM fr",
    "search_by_language": f"WITH {_similar(QUESTION)}, r AS (SELECT lang, id, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, id) AS place FROM sm JOIN documents ON id = doc_id) SELECT * FROM r WHERE place <= 6",
    "prefix_expansion": f"WITH {TOKENS} SELECT word, term FROM fr, (SELECT unnest([{', '.join(repr(w) for w in S.words_of(QUESTION) if len(w) >= 3)}]) AS word) WHERE starts_with(term, word) AND term <> word AND length(term) <= length(word) + 4",
    "retrieve_expand": f"""WITH {_similar(QUESTION)},
lk AS (SELECT * FROM (SELECT doc_id AS s, lead(doc_id) OVER w AS t, CASE WHEN lead(lang) OVER w = lang THEN 'high' ELSE 'medium' END AS c FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE t IS NOT NULL),
tp6 AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sm ORDER BY score DESC, id LIMIT 6),
ht AS (SELECT * FROM tp6 WHERE score >= 0.35 * (SELECT max(score) FROM tp6)),
nb AS (SELECT s AS hit, t AS other, c, 'calls' AS how FROM lk UNION ALL SELECT t, s, c, 'called by' FROM lk),
pl AS (SELECT rank, ht.score AS hs, other, c, how, coalesce(sm.score, 0) AS own, row_number() OVER (PARTITION BY rank ORDER BY coalesce(sm.score, 0) DESC, c <> 'high', other, how) AS place FROM nb JOIN ht ON hit = ht.id LEFT JOIN sm ON other = sm.id),
kp AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY rank, place) AS nth FROM pl WHERE place <= CASE WHEN rank <= 2 THEN 4 ELSE 2 END AND (rank <= 2 OR own > 0) AND other NOT IN (SELECT id FROM ht)),
al AS (SELECT id, score, 'search' AS reason, false AS via_guess, 0 AS kind, rank, 0 AS place FROM ht UNION ALL SELECT other, round(hs * 0.5, 6), how || ' #' || rank, c <> 'high', 1, rank, place FROM kp WHERE nth = 1)
SELECT id, score, reason, via_guess FROM al ORDER BY kind, score DESC, rank, place LIMIT 12""",
    "synonym_search": f"WITH {_similar(SYN)}, t6 AS (SELECT * FROM sm ORDER BY score DESC, id LIMIT 6) SELECT * FROM t6 WHERE score >= 0.3 * (SELECT max(score) FROM t6) ORDER BY score DESC, id LIMIT 5",
    "path_confidence": """WITH s AS (SELECT conv_id AS path, turn AS pos, role || '/' || (length(text) % 7) AS id, role FROM conversations),
l AS (SELECT DISTINCT id AS a, CASE WHEN role = 'user' THEN 'assistant/3' ELSE 'user/2' END AS b, CASE WHEN role = 'user' THEN 2 ELSE 1 END AS r FROM s),
u AS (SELECT a, b, r FROM l UNION ALL SELECT b, a, r FROM l)
SELECT y.path, y.pos, CASE coalesce(max(r), 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS hop FROM s x JOIN s y ON x.path = y.path AND x.pos < y.pos LEFT JOIN u ON u.a = x.id AND u.b = y.id GROUP BY y.path, y.pos""",
    "language_table": """WITH x AS (SELECT lang, count(*) AS files, sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> ''))) AS lines FROM documents GROUP BY lang)
SELECT lang, files, CAST(lines AS BIGINT) AS lines, CAST(round_even(100 * lines / (SELECT sum(lines) FROM x), 0) AS BIGINT) AS percent FROM x""",
}
