"""Queries of the driver's catalogue: one for each operator, over the whole tables, with the SQL that says the same.

A document is a row of the index here: `row` is doc_id. Scores are rounded to six places before ties are broken by doc_id, so that both sides order alike.
Splits into a base and segments go by language, deletions and edits by labels; every document is in one of the parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..sources.cut import cut_lineage
from ..index.index import Index
from ..operators import batch, bm25, chunks, explain, postings, views
from ..sources import files
from ..sources.hadoop import Files
from ..sources.local import local_rows
from .routing import route_update

QUERY = "that therble, the heron of zzyzx"
WORDS = ["that", "therble", "heron"]
K, DIGITS, OTHER_K1, OTHER_B = 10, 6, 0.6, 0.4
PAGE, PAGE_ROWS, BROWSED = 3, 20, "src3"
FIRST, SECOND = "de", "es"
#: Terms of queries up to these numbers are counted within each document's row, and picked from the texts' tokens as literals.
FEW, PUSHED = 64, 10_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# what the queries share


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark, d) -> DataFrame:
    return table(spark, d, "documents").withColumn("row", F.col("doc_id"))


def labelled(spark, d) -> DataFrame:
    """Documents with `toxic` and `quality`, null where there is no label."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return docs_of(spark, d).join(marks, "doc_id", "left")


def tables_of(docs: DataFrame, k1: float = postings.K1, b: float = postings.B):
    """Postings of all terms, lexicon, numbers. Texts are tokenised twice, which is less than to write all postings: for the lexicon, which also adds up the lengths, and by whoever reads the postings."""
    posts = postings.counted(docs)
    lex = cut_lineage(posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")))
    total = lex.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    n = docs.count()
    return posts, lex.select("term", "df"), postings.Stats(n, n, total, k1, b)


def asked_tables(docs: DataFrame, terms: DataFrame, dead: DataFrame | None = None, k1: float = postings.K1, b: float = postings.B):
    """Postings of the query's terms only, their lexicon, numbers of the corpus: all from one pass over the texts, which leaves a row a document. `terms`: (qid, term)."""
    words = [r["term"] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(words) > FEW:
        posts = postings.postings(docs, terms=words) if len(words) <= PUSHED else postings.closed(postings.postings(docs), terms.select("term").distinct())
        # spread by document: what follows has many rows for each of these, and the planner would put so few into a task or two
        posts = cut_lineage(posts).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
        alive = posts if dead is None else postings.live(posts, dead)
        return alive, postings.lexicon(alive), postings.corpus_stats(postings.doc_lengths(docs), dead, k1, b)
    held = cut_lineage(postings.asked(docs, words))
    stats = postings.corpus_stats(held.select("row", "dl"), dead, k1, b)
    posts = postings.asked_postings(held)
    posts = posts if dead is None else postings.live(posts, dead)
    return posts, postings.lexicon(posts), stats


def one_query(spark) -> DataFrame:
    return bm25.terms_of(spark, [QUERY])


def scored_of(docs: DataFrame, terms: DataFrame, dead: DataFrame | None = None, **parameters) -> DataFrame:
    posts, lex, stats = asked_tables(docs, terms, dead, **parameters)
    return bm25.scores(posts, lex, terms, stats)


def one_scored(spark, d, **parameters) -> DataFrame:
    return scored_of(docs_of(spark, d), one_query(spark), **parameters)


def ranked(scored: DataFrame) -> DataFrame:
    return bm25.top_k(scored, K, digits=DIGITS).select(F.col("row").alias("doc_id"), "rank", "score")


def rounded(c) -> F.Column:
    return F.round(c, DIGITS)


def folder(spark) -> str:
    """A place for an index in the folder that all executors share; it goes when the driver ends, as results are read from it until then."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        cut_lineage(spark.range(1))  # sets the context's own folder where none is named
        base = context._jsc.sc().getCheckpointDir().get()
    place = f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"
    Files(spark).until_exit(place)
    return place


def as_texts(docs: DataFrame, text="text") -> DataFrame:
    """Rows for an index; docid is doc_id with leading zeros, so that its order is the numbers'."""
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 18, "0").alias("docid"), F.col("source").alias("file"), F.lit(1).alias("line"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"))


def is_base(lang="lang") -> F.Column:
    return F.coalesce(~F.col(lang).isin(FIRST, SECOND), F.lit(True))


def index_of(spark, docs: DataFrame) -> Index:
    return Index.create(spark, folder(spark), as_texts(docs))


def index_ranked(index: Index) -> DataFrame:
    """The best K of the index, with doc_id."""
    best = bm25.top_k(index.scores([QUERY]), K, digits=DIGITS)
    return best.join(index.all_chunks().select("row", "docid"), "row").select(F.col("docid").cast("long").alias("doc_id"), "rank", "score")


# SQL that the oracles share

_CJK = texts.CJK
_STRIP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_STRIP}+|{_STRIP}+$', '', 'g')"


def tokens_sql(x: str) -> str:
    units = rf"regexp_extract_all(lower(coalesce({x}, '')), '[{_CJK}]|[\p{{L}}\p{{N}}_]+')"
    both = f"regexp_full_match(x, '[{_CJK}]') AND regexp_full_match({units}[i - 1], '[{_CJK}]')"
    return f"CASE WHEN regexp_matches(coalesce({x}, ''), '[{_CJK}]') THEN flatten(list_transform({units}, lambda x, i: CASE WHEN i > 1 AND {both} THEN [x, {units}[i - 1] || x] ELSE [x] END)) ELSE {units} END"


def index_sql(docs: str = "SELECT doc_id, text FROM documents", live: str = "TRUE", vocabulary: str | None = None) -> str:
    """CTEs lens, post, lex and st of a corpus (doc_id, text and more); `live` filters its rows, `vocabulary` closes the terms to those of another corpus."""
    closed = f" AND term IN (SELECT unnest({tokens_sql('text')}) FROM ({vocabulary}))" if vocabulary else ""
    return f"""corpus AS ({docs}),
toks AS (SELECT doc_id AS doc, {tokens_sql("text")} AS toks FROM corpus WHERE {live}),
lens AS (SELECT doc, len(toks) AS dl FROM toks),
post AS (SELECT doc, term, count(*) AS tf, dl FROM (SELECT doc, len(toks) AS dl, unnest(toks) AS term FROM toks) WHERE TRUE{closed} GROUP BY doc, term, dl),
lex AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(dl), 0)::DOUBLE / greatest(count(*), 1) AS avgdl FROM lens)"""


IDF = "ln((n - df::DOUBLE + 0.5::DOUBLE) / (df::DOUBLE + 0.5::DOUBLE) + 1::DOUBLE)"


def weight_sql(k1: float = postings.K1, b: float = postings.B) -> str:
    return f"{IDF} * (tf::DOUBLE * {k1 + 1}::DOUBLE / (tf::DOUBLE + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl::DOUBLE / avgdl)))"


ONE = "q AS (SELECT DISTINCT 0 AS qid, unnest(" + tokens_sql(f"'{QUERY}'") + ") AS term)"


def scored_sql(queries: str = ONE, k1: float = postings.K1, b: float = postings.B) -> str:
    return f"{queries}, sc AS (SELECT qid, doc, sum(round({weight_sql(k1, b)} * {bm25.SCALE}::DOUBLE)::HUGEINT)::DOUBLE / {bm25.SCALE}::DOUBLE AS score FROM q JOIN post USING (term) JOIN lex USING (term), st GROUP BY qid, doc)"


def best_sql(qid: str = "", tie: str = "doc", more: str = "") -> str:
    return f"SELECT {qid}doc AS doc_id, rank, score FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {tie}) AS rank FROM (SELECT qid, doc, round(score, {DIGITS}) AS score FROM sc) {more}) WHERE score > 0 AND rank <= {K}"


#: documents with labels
MARKED = "SELECT d.doc_id, d.text, d.source, d.lang, l.toxic, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"
PART = f"CASE WHEN lang = '{FIRST}' THEN 1 WHEN lang = '{SECOND}' THEN 2 ELSE 0 END"
#: order of rows in an index of a base and segments
BY_ROW = "part, source NULLS FIRST, doc"
ROWS_OF = f"JOIN (SELECT doc_id AS doc, source, {PART} AS part FROM documents) USING (doc)"


# tokens, spans, chunks


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, d):
    return docs_of(spark, d).select("doc_id", F.array_join(texts.tokens("text"), " ").alias("tokens"))


@query(f"SELECT doc_id, len({tokens_sql('text')}) AS dl FROM documents")
def token_counts(spark, d):
    return postings.doc_lengths(docs_of(spark, d)).select(F.col("row").alias("doc_id"), "dl")


@query(r"""SELECT item_id, array_to_string(w, ' ') AS words, len(w) AS n FROM (SELECT item_id, list_filter(string_split_regex(text, '[\s，。；：、！？（）「」『』《》〈〉【】〔〕(){}\[\]''"“”‘’·…—\-~,.;:!?\\|/*+]+'), lambda x: x <> '') AS w FROM benchmark)""")
def query_tokens(spark, d):
    words = texts.query_tokens("text")
    return table(spark, d, "benchmark").select("item_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n"))


def _places_sql(w: str) -> str:
    """Places (from 0) of a word in the characters `c` of a text, overlapping ones too."""
    same = " AND ".join(f"c[i + {j + 1}] = '{x}'" for j, x in enumerate(w))
    return f"list_filter(range(0, len(c) - {len(w) - 1}), lambda i: {same})"


_CHARS = "SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents"


def _span_sql() -> str:
    starts = ", ".join(f"list_min({_places_sql(w)})" for w in WORDS)
    ends = ", ".join(f"list_max({_places_sql(w)}) + {len(w)}" for w in WORDS)
    return f"SELECT doc_id, least({starts}) AS span_start, greatest({ends}) AS span_end FROM ({_CHARS})"


@query(_span_sql())
def hit_span(spark, d):
    span = texts.hit_span("text", F.lit(", ".join(WORDS)))
    return docs_of(spark, d).select("doc_id", span["start"].cast("long").alias("span_start"), span["end"].cast("long").alias("span_end"))


@query(" UNION ALL ".join(f"SELECT doc_id, unnest(p) AS start, unnest(p) + {len(w)} AS stop, '{w}' AS tok FROM (SELECT doc_id, {_places_sql(w)} AS p FROM ({_CHARS}))" for w in WORDS))
def hit_ranges(spark, d):
    found = docs_of(spark, d).select("doc_id", F.explode(texts.hit_ranges("text", F.array(*(F.lit(w) for w in WORDS)))).alias("r"))
    return found.select("doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("stop"), F.col("r.tok").alias("tok"))


_LINES = r"SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', E'\n', 'g'), E'\n') AS l FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH lines AS ({_LINES}), marked AS (SELECT *, {strip_sql("content")} = '' AS blank FROM lines),
paras AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM marked),
bodies AS (SELECT doc_id, min(i) AS line, {strip_sql("string_agg(content, E'\n' ORDER BY i)")} AS body FROM paras WHERE NOT blank GROUP BY doc_id, para),
cut AS (SELECT doc_id, line, body, unnest(range(0, (length(body) - 1) // {chunks.MAX_CHARS} + 1)) AS w FROM bodies WHERE length(body) >= {chunks.MIN_CHARS})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, w) - 1 AS seq, line, substring(body, w * {chunks.MAX_CHARS} + 1, {chunks.MAX_CHARS}) AS text FROM cut""")
def chunk_prose(spark, d):
    return chunks.prose_chunks(docs_of(spark, d), "doc_id").select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("line").cast("long").alias("line"), "text")


@query(f"""WITH lines AS ({_LINES}), blocks AS (SELECT doc_id, (i - 1) // {chunks.CODE_LINES} AS block, {strip_sql("string_agg(content, E'\n' ORDER BY i)")} AS text FROM lines GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS seq, block * {chunks.CODE_LINES} + 1 AS line, text FROM blocks WHERE length(text) >= {chunks.MIN_CHARS}""")
def chunk_code(spark, d):
    return chunks.code_chunks(docs_of(spark, d), "doc_id").select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT doc_id, CASE WHEN length(t) > 150 THEN substring(t, 1, 150) || '…' ELSE t END AS snip FROM (SELECT doc_id, {strip_sql("translate(text, E'\r\n', '  ')")} AS t FROM documents)")
def chunk_snippet(spark, d):
    return docs_of(spark, d).select("doc_id", texts.snippet("text").alias("snip"))


# sources


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def content_hash(spark, d):
    return docs_of(spark, d).select("doc_id", texts.content_md5("text").alias("md5"))


def _ledgers(spark, d):
    """Before: all documents. After: toxic ones gone, poor ones changed, benchmark items added."""
    marked = labelled(spark, d)
    name = F.concat(F.lit("doc-"), F.col("doc_id")).alias("rel")
    before = marked.select(name, F.md5("text").alias("md5"))
    edited = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = marked.where("toxic is null or toxic <> 1").select(name, F.md5(edited).alias("md5"))
    items = table(spark, d, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id")).alias("rel"), F.md5("text").alias("md5"))
    return before, after.unionByName(items)


@query(f"""SELECT rel, change FROM (SELECT 'doc-' || doc_id AS rel, CASE WHEN toxic = 1 THEN 'removed' WHEN quality = 0 AND text IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS change FROM ({MARKED}))
UNION ALL SELECT 'item-' || item_id, 'added' FROM benchmark""")
def hash_diff(spark, d):
    return files.ledger_diff(*_ledgers(spark, d))


@query(f"""SELECT 'doc-' || doc_id AS rel, md5(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS md5 FROM ({MARKED}) WHERE (toxic IS NULL OR toxic <> 1) AND text IS NOT NULL
UNION ALL SELECT 'item-' || item_id, md5(text) FROM benchmark""")
def ledger_state(spark, d):
    before, after = _ledgers(spark, d)
    gone = before.join(after, "rel", "left_anti").select(F.lit(3).alias("seq"), "rel", F.lit(None).cast("string").alias("md5"))
    events = before.select(F.lit(1).alias("seq"), "rel", "md5").unionByName(after.select(F.lit(2).alias("seq"), "rel", "md5")).unionByName(gone)
    return files.ledger_state(events)


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


@query(rf"""SELECT page_id, NOT list_has_any(p[:-2], [{_quoted(files.EXCLUDE_DIRS)}]) AND p[-1] NOT IN ({_quoted(files.EXCLUDE_NAMES)})
AND lower(regexp_extract(p[-1], '[^.].*?(\.[^.]*)$', 1)) NOT IN ({_quoted(files.EXCLUDE_EXTENSIONS)}) AND octet_length(encode(html)) <= {files.MAX_BYTES} AS accepted
FROM (SELECT page_id, html, string_split(regexp_replace(url, '^[^:]*://', ''), '/') AS p FROM pages)""")
def scan_filter(spark, d):
    rel = F.regexp_replace("url", "^[^:]*://", "")
    return table(spark, d, "pages").select("page_id", files.accepted(rel, F.octet_length("html")).alias("accepted"))


# tables of an index


@query(f"WITH {index_sql()} SELECT doc AS doc_id, term, tf FROM post")
def term_freq(spark, d):
    return postings.postings(docs_of(spark, d)).select(F.col("row").alias("doc_id"), "term", "tf")


@query(f"WITH {index_sql()} SELECT term, df FROM lex")
def doc_freq(spark, d):
    return postings.document_frequencies(docs_of(spark, d))


@query(f"WITH {index_sql()} SELECT doc AS doc_id, dl FROM lens")
def doc_len(spark, d):
    return postings.doc_lengths(docs_of(spark, d)).select(F.col("row").alias("doc_id"), "dl")


@query(f"WITH {index_sql()} SELECT count(*) AS n_live, sum(dl)::BIGINT AS sum_dl, round(sum(dl)::DOUBLE / count(*), 6) AS avgdl FROM lens")
def corpus_stats(spark, d):
    s = postings.corpus_stats(postings.doc_lengths(docs_of(spark, d)))
    return local_rows(spark, [(s.n_live, s.sum_dl, round(s.avgdl, 6))], "n_live long, sum_dl long, avgdl double")


@query(f"WITH {index_sql()} SELECT term, df, round({IDF}, 6) AS idf FROM lex, st")
def idf_table(spark, d):
    docs = docs_of(spark, d)
    return postings.document_frequencies(docs).select("term", "df", rounded(postings.idf("df", postings.row_count(docs))).alias("idf"))


@query(f"SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM documents")
def vocab(spark, d):
    return postings.document_frequencies(docs_of(spark, d)).select("term")


@query(f"WITH {index_sql()} SELECT doc AS doc_id, round({postings.K1}::DOUBLE * ({1 - postings.B}::DOUBLE + {postings.B}::DOUBLE * dl::DOUBLE / avgdl), 6) AS dn FROM lens, st")
def norm_precompute(spark, d):
    lengths = cut_lineage(postings.doc_lengths(docs_of(spark, d)))
    return lengths.select(F.col("row").alias("doc_id"), rounded(postings.norm("dl", postings.corpus_stats(lengths))).alias("dn"))


@query(f"WITH {index_sql()} SELECT doc AS doc_id, term, round({weight_sql()}, 6) AS w FROM post JOIN lex USING (term), st")
def weights_materialized(spark, d):
    return postings.weights(*tables_of(docs_of(spark, d))).select(F.col("row").alias("doc_id"), "term", rounded("w").alias("w"))


# scores


@query(f"WITH {index_sql()}, {scored_sql()} SELECT doc AS doc_id, round(score, 6) AS score FROM sc")
def bm25_scores(spark, d):
    return one_scored(spark, d).select(F.col("row").alias("doc_id"), rounded("score").alias("score"))


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql()}")
def bm25_topk(spark, d):
    return ranked(one_scored(spark, d))


_ITEMS = f"q AS (SELECT DISTINCT item_id AS qid, unnest({tokens_sql('text')}) AS term FROM benchmark)"


@query(f"WITH {index_sql()}, {scored_sql(_ITEMS)} {best_sql('qid, ')}")
def bm25_topk_batch(spark, d):
    terms = bm25.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    return bm25.top_k(batch.best(batch.asked(docs_of(spark, d), terms), K), K, digits=DIGITS).select("qid", F.col("row").alias("doc_id"), "rank", "score")


_TURNS = f"q AS (SELECT DISTINCT conv_id || '-' || turn AS qid, unnest({tokens_sql('text')}) AS term FROM conversations WHERE role = 'user')"


@query(f"WITH {index_sql()}, {scored_sql(_TURNS)} {best_sql('qid, ')}")
def bm25_topk_conversations(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    return bm25.top_k(batch.best(batch.asked(docs_of(spark, d), bm25.query_terms(turns, "qid", "text")), K), K, digits=DIGITS).select("qid", F.col("row").alias("doc_id"), "rank", "score")


@query(f"WITH {index_sql()}, {scored_sql()} SELECT doc AS doc_id, round(coalesce(score, 0), 6) AS score FROM lens LEFT JOIN sc USING (doc) ORDER BY score DESC, doc LIMIT {K}")
def kernel_topk_zero_fill(spark, d):
    scored = one_scored(spark, d)
    return bm25.zero_filled(docs_of(spark, d), scored, K, DIGITS).select(F.col("row").alias("doc_id"), "score")


@query(f"WITH {index_sql()}, {scored_sql()} SELECT b.doc_id, rank, score, source AS file, text FROM ({best_sql()}) b JOIN documents USING (doc_id)")
def topk_with_text(spark, d):
    docs = docs_of(spark, d)
    rows = docs.select("row", F.col("doc_id").alias("docid"), F.col("source").alias("file"), F.lit(1).alias("line"), "text")
    found = bm25.hits(bm25.top_k(one_scored(spark, d), K, digits=DIGITS), rows)
    return found.select(F.col("docid").alias("doc_id"), "rank", "score", "file", "text")


@query(f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {PAGE_ROWS} OFFSET {PAGE * PAGE_ROWS}")
def browse_page(spark, d):
    return docs_of(spark, d).select("doc_id", "text").orderBy("doc_id").offset(PAGE * PAGE_ROWS).limit(PAGE_ROWS)


@query(f"SELECT doc_id, text FROM documents WHERE source = '{BROWSED}'")
def browse_by_file(spark, d):
    return docs_of(spark, d).where(F.translate("source", "\\", "/") == BROWSED).select("doc_id", "text")


@query("SELECT source AS file, count(*) AS n FROM documents GROUP BY source")
def list_files(spark, d):
    return docs_of(spark, d).groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n"))


@query(f"WITH {index_sql()}, {scored_sql(k1=OTHER_K1, b=OTHER_B)} {best_sql()}")
def retune_k1_b(spark, d):
    return ranked(one_scored(spark, d, k1=OTHER_K1, b=OTHER_B))


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql()}")
def weights_score(spark, d):
    return ranked(bm25.weighted_scores(postings.weights(*tables_of(docs_of(spark, d))), one_query(spark)))


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql()}")
def approx_topk(spark, d):
    scored = one_scored(spark, d).select("row", rounded("score").alias("score"))
    best = bm25.approximate_top_k(cut_lineage(scored), K)
    return bm25.top_k(best.withColumn("qid", F.lit(0)), K).select(F.col("row").alias("doc_id"), "rank", "score")


@query(f"SELECT lang, term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, lang, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY lang, term")
def df_by_lang(spark, d):
    docs = docs_of(spark, d)
    return postings.postings(docs).join(docs.select("row", "lang"), "row").groupBy("lang", "term").agg(F.count("*").alias("df"))


@query(f"WITH {index_sql()}, {scored_sql()} SELECT toxic, quality, count(*) AS n, round(avg(score), 4) AS mean_score FROM sc JOIN labels ON doc = doc_id GROUP BY toxic, quality")
def score_by_label(spark, d):
    joined = one_scored(spark, d).join(table(spark, d, "labels"), F.col("row") == F.col("doc_id"))
    return joined.groupBy("toxic", "quality").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


# explanations


@query(f"SELECT DISTINCT term FROM (SELECT unnest({tokens_sql('text')}) AS term FROM benchmark) WHERE term NOT IN (SELECT unnest({tokens_sql('text')}) FROM documents)")
def oov_terms(spark, d):
    asked = postings.postings(table(spark, d, "benchmark"), "item_id")
    return postings.unknown_terms(asked, postings.document_frequencies(docs_of(spark, d)))


_COUNTED = f"q AS (SELECT qid, term, count(*) AS q_count FROM (SELECT item_id AS qid, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY qid, term)"


def _diagnosed(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    _, lex, stats = asked_tables(docs_of(spark, d), bm25.query_terms(items, "qid", "text"))
    return explain.diagnose_terms(lex, explain.term_counts(items, "qid", "text"), stats)


_TERMS = f"SELECT qid, term, q_count, df IS NOT NULL AS in_vocab, coalesce(df, 0) AS df, round(coalesce(df, 0)::DOUBLE / n, 6) AS df_ratio, round({IDF}, 6) AS idf FROM q LEFT JOIN lex USING (term), st"


@query(f"WITH {index_sql()}, {_COUNTED} {_TERMS}")
def diagnose_terms(spark, d):
    return _diagnosed(spark, d)


@query(f"""WITH {index_sql()}, {scored_sql(_COUNTED)}, terms AS ({_TERMS}),
t AS (SELECT qid, sum(q_count)::BIGINT AS n_tokens, count(*) AS n_terms, count(*) FILTER (NOT in_vocab) AS n_oov FROM terms GROUP BY qid),
s AS (SELECT qid, count(*) AS n_positive, round(max(score), 6) AS max_score FROM sc WHERE score > 0 GROUP BY qid)
SELECT item_id AS qid, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_oov, 0) AS n_oov, coalesce(n_positive, 0) AS n_positive, coalesce(max_score, 0) AS max_score,
CASE WHEN coalesce(n_tokens, 0) = 0 THEN 'no_tokens' WHEN n_oov = n_terms THEN 'all_oov' WHEN coalesce(n_positive, 0) = 0 THEN 'no_positive' WHEN n_oov > 0 THEN 'partial_oov' ELSE 'ok' END AS status
FROM benchmark LEFT JOIN t ON item_id = t.qid LEFT JOIN s ON item_id = s.qid""")
def diagnose_status(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asked = batch.asked(docs_of(spark, d), bm25.query_terms(items, "qid", "text"))
    terms = explain.diagnose_terms(asked.lexicon, explain.term_counts(items, "qid", "text"), asked.stats)
    return explain.diagnose_status(items, terms, batch.positive(asked)).withColumn("max_score", rounded("max_score"))


def _explained(spark, d):
    posts, lex, stats = asked_tables(docs_of(spark, d), one_query(spark))
    counts = explain.term_counts(local_rows(spark, [(0, QUERY)], "qid int, query string"))
    scored = bm25.top_k(bm25.scores(posts, lex, one_query(spark), stats), K, digits=DIGITS)
    return scored, explain.explain(posts, lex, counts, scored, stats)


_ASKED = f"q AS (SELECT 0 AS qid, term, count(*) AS q_count FROM (SELECT unnest({tokens_sql(f"'{QUERY}'")}) AS term) GROUP BY term)"


@query(f"""WITH {index_sql()}, {scored_sql(_ASKED)}, best AS ({best_sql()})
SELECT doc_id, term, q_count, CASE WHEN df IS NULL THEN 'oov' WHEN tf IS NULL THEN 'no_tf' ELSE 'ok' END AS status, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, round(coalesce({IDF}, 0), 6) AS idf, round(coalesce({weight_sql()}, 0), 6) AS contribution
FROM best CROSS JOIN q LEFT JOIN lex USING (term) LEFT JOIN post ON post.doc = doc_id AND post.term = q.term, st""")
def explain_contrib(spark, d):
    rows = _explained(spark, d)[1]
    return rows.select(F.col("row").alias("doc_id"), "term", "q_count", "status", "tf", "df", rounded("idf").alias("idf"), rounded("contribution").alias("contribution"))


@query(f"WITH {index_sql()}, {scored_sql()}, best AS ({best_sql()}) SELECT doc_id, score, score AS explained FROM best")
def explain_sum_equals_score(spark, d):
    scored, rows = _explained(spark, d)
    return scored.join(explain.explained_scores(rows).select("row", rounded("score").alias("explained")), "row").select(F.col("row").alias("doc_id"), "score", "explained")


# deletions, additions


ALIVE = "toxic IS NULL OR toxic <> 1"


def _tombstoned(spark, d):
    marked = labelled(spark, d)
    return marked, marked.where("toxic = 1").select("row")


@query(f"WITH {index_sql(MARKED, ALIVE)}, v AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM documents) SELECT term, coalesce(df, 0) AS df, round(ln((n - coalesce(df, 0)::DOUBLE + 0.5::DOUBLE) / (coalesce(df, 0)::DOUBLE + 0.5::DOUBLE) + 1::DOUBLE), 6) AS idf FROM v LEFT JOIN lex USING (term), st")
def tombstone_stats(spark, d):
    """The lexicon of all documents less that of the dead, as the index keeps it."""
    marked, _ = _tombstoned(spark, d)
    gone = postings.document_frequencies(marked.where("toxic = 1")).select("term", (-F.col("df")).alias("df"))
    lex = postings.document_frequencies(marked).unionByName(gone).groupBy("term").agg(F.sum("df").alias("df"))
    return lex.select("term", "df", rounded(postings.idf("df", postings.row_count(marked.where("toxic is null or toxic <> 1")))).alias("idf"))


@query(f"WITH {index_sql(MARKED, ALIVE)}, {scored_sql()} {best_sql()}")
def tombstone_topk(spark, d):
    marked, dead = _tombstoned(spark, d)
    return ranked(scored_of(marked, one_query(spark), dead))


_BASE_DOCS = f"SELECT * FROM documents WHERE {PART} = 0"


@query(f"""WITH {index_sql(f"SELECT * FROM documents WHERE {PART} > 0", vocabulary=_BASE_DOCS)}
SELECT doc AS doc_id, l.dl, count(term) AS kept, coalesce(sum(tf), 0)::BIGINT AS kept_tokens FROM lens l LEFT JOIN post USING (doc) GROUP BY doc, l.dl""")
def append_closed_vocab(spark, d):
    docs = docs_of(spark, d)
    new = docs.where(~is_base())
    known = postings.document_frequencies(docs.where(is_base()))
    kept = postings.closed(postings.postings(new), known).groupBy("row").agg(F.count("*").alias("kept"), F.sum("tf").alias("kept_tokens"))
    return postings.doc_lengths(new).join(kept, "row", "left").na.fill(0).select(F.col("row").alias("doc_id"), "dl", "kept", "kept_tokens")


_UPSERTED = f"SELECT doc_id, source, coalesce(quality = 0, FALSE) AS changed, CASE WHEN quality = 0 THEN text || ' that heron zzyzx' ELSE text END AS text FROM ({MARKED})"


@query(f"WITH {index_sql(_UPSERTED, vocabulary='SELECT text FROM documents')}, {scored_sql()} {best_sql(tie='changed, source NULLS FIRST, doc', more='JOIN (SELECT doc_id AS doc, changed, source FROM corpus) USING (doc)')}")
def upsert_topk(spark, d):
    marked = labelled(spark, d)
    index = index_of(spark, marked)
    changed = marked.where("quality = 0")
    names = as_texts(changed).select("docid")
    rows = index.chunks().join(names, "docid", "left_semi").select("row")
    index.upsert(rows, as_texts(changed, F.concat("text", F.lit(" that heron zzyzx"))))
    return index_ranked(Index(spark, index.store.path))


# segments


def _mounted(spark, d) -> Index:
    docs = docs_of(spark, d)
    index = index_of(spark, docs.where(is_base()))
    for lang in (FIRST, SECOND):
        index.publish(as_texts(docs.where(F.col("lang") == lang)), tag=lang)
    return index


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql(tie=BY_ROW, more=ROWS_OF)}")
def segment_mounted_topk(spark, d):
    return index_ranked(_mounted(spark, d))


@query(f"WITH {index_sql(f'SELECT * FROM documents WHERE {PART} < 2')}, {scored_sql()} {best_sql(tie=BY_ROW, more=ROWS_OF)}")
def segment_unmounted_topk(spark, d):
    index = _mounted(spark, d)
    index.unmount(SECOND)
    return index_ranked(index)


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql(tie=BY_ROW, more=ROWS_OF)}")
def segments_folded_topk(spark, d):
    index = _mounted(spark, d)
    index.compact()
    return index_ranked(Index(spark, index.store.path))


@query(f"""WITH d AS (SELECT {PART} AS part, {tokens_sql("text")} AS toks FROM documents), t AS (SELECT DISTINCT part, unnest(toks) AS term FROM d),
n AS (SELECT part, count(*) AS rows FROM d GROUP BY part), f AS (SELECT term, min(part) AS part FROM t GROUP BY term)
SELECT CASE part WHEN 1 THEN '{FIRST}' ELSE '{SECOND}' END AS tag, (SELECT sum(m.rows) FROM n m WHERE m.part < n.part)::BIGINT AS row_base, rows AS n_rows, (SELECT count(*) FROM f WHERE f.part = n.part) AS new_terms FROM n WHERE part > 0""")
def segment_report(spark, d):
    return local_rows(spark, [(s["tag"], s["row_base"], s["rows"], s["new_terms"]) for s in _mounted(spark, d).segments()], "tag string, row_base long, n_rows long, new_terms long")


@query(f"WITH {index_sql(f'SELECT * FROM documents WHERE {PART} < 2')}, {scored_sql()} {best_sql(tie=BY_ROW, more=ROWS_OF)}")
def staged_publish_topk(spark, d):
    docs = docs_of(spark, d)
    index = index_of(spark, docs.where(is_base()))
    stage = index.stage_begin()
    stage.add_many(as_texts(docs.where(F.col("lang") == FIRST)))
    stage.publish(fold=True)
    return index_ranked(Index(spark, index.store.path))


@query(f"WITH {index_sql(f'SELECT * FROM ({MARKED}) WHERE {PART} < 2', ALIVE, _BASE_DOCS)}, {scored_sql()} {best_sql(tie=BY_ROW, more=ROWS_OF)}")
def delta_replay_topk(spark, d):
    docs = labelled(spark, d)
    index = index_of(spark, docs.where(is_base()))
    index.append(as_texts(docs.where(F.col("lang") == FIRST)))
    gone = as_texts(docs.where("toxic = 1")).select("docid")
    index.delete(index.chunks().join(gone, "docid", "left_semi").select("row"))
    return index_ranked(Index(spark, index.store.path))


@query(f"SELECT count(DISTINCT term) AS n_terms, 0::BIGINT AS n_different FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents)")
def reconcile_df(spark, d):
    index = _mounted(spark, d)
    index.fold_all()
    different = index.reconcile().count()
    return index.vocabulary().agg(F.count("*").alias("n_terms")).withColumn("n_different", F.lit(different).cast("long"))


@query(f"WITH {index_sql()} SELECT term, NULL::BIGINT AS stored_df, NULL::BIGINT AS stored_tf, count(*) AS df, sum(tf)::BIGINT AS tf FROM post WHERE term = 'that' GROUP BY term")
def reconcile_detects_corruption(spark, d):
    posts = cut_lineage(postings.postings(docs_of(spark, d)))
    return postings.reconcile(posts.where("term <> 'that'"), posts)


_GRID = {"n_added": (0, 3), "n_removed": (0, 2), "n_oov": (0, 1), "n_tomb_rows": (0, 2), "n_tomb_seg_rows": (0, 1), "n_segments": (0, 1), "n_blocks": (1, 7, 8, 9), "dense_on": (0, 1), "batch_nnz": (10, 11), "rebuild_batch_nnz": (10,)}


def _route_sql() -> str:
    grid = ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}]) AS {k})" for k, v in _GRID.items())
    return f"""SELECT {', '.join(_GRID)}, split_part(r, '/', 1) AS route, split_part(r, '/', 2) AS code, nullif(split_part(r, '/', 3), '') AS following FROM (SELECT *, CASE
WHEN n_added + n_removed = 0 THEN 'noop/noop/'
WHEN n_segments > 0 AND n_tomb_seg_rows > 0 THEN 'fold_first/fold_then_tomb_segment/' || CASE WHEN n_oov > 0 THEN 'staged' ELSE 'incremental' END
WHEN n_segments > 0 AND n_oov = 0 THEN 'fold_first/fold_then_incremental/incremental'
WHEN n_segments > 0 AND dense_on = 1 THEN 'fold_first/fold_then_rebuild_dense/rebuild'
WHEN n_segments > 0 AND n_blocks >= 8 THEN 'fold_first/fold_then_staged_blocks/staged'
WHEN n_oov = 0 THEN 'incremental/incremental/' WHEN dense_on = 1 THEN 'rebuild/rebuild_dense/' WHEN batch_nnz > rebuild_batch_nnz THEN 'rebuild/rebuild_batch_too_big/' ELSE 'staged/staged/' END AS r FROM {grid})"""


@query(_route_sql())
def route_decisions(spark, d):
    rows = []
    for values in product(*_GRID.values()):
        counts = dict(zip(_GRID, values, strict=True))
        r = route_update(**counts | {"dense_on": bool(counts["dense_on"])})
        rows.append((*values, r.route, r.code, r.then))
    return local_rows(spark, rows, ", ".join(f"{k} int" for k in _GRID) + ", route string, code string, following string")


# dense views


def _view(spark, d):
    """Vectors of documents that exist, and the query's: the vector of the smallest id."""
    docs = docs_of(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("vec"))
    asked = [float(x) for x in vectors.agg(F.min_by("vec", "row")).first()[0]]
    return docs, views.attach(vectors.join(docs.select("row"), "row", "left_semi"), docs), asked


_VIEW = """asked AS (SELECT min_by(embedding, vec_id)::DOUBLE[] AS a FROM embeddings),
view AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
cosine AS (SELECT doc, list_dot_product(v, a) / (greatest(sqrt(list_dot_product(v, v)), 1e-12) * greatest(sqrt(list_dot_product(a, a)), 1e-12)) AS cos FROM view, asked)"""
_FUSED = f"""{index_sql()}, {scored_sql()}, {_VIEW}, base AS (SELECT doc, coalesce(round(score, 6), 0) AS base FROM lens LEFT JOIN sc USING (doc)),
span AS (SELECT CASE WHEN max(base) > 0 THEN max(base) ELSE 1 END AS span FROM base),
fused AS (SELECT doc, base, cos, CASE WHEN cos IS NULL THEN base ELSE base + {views.ALPHA} * greatest(0, least(1, cos)) * span END AS fused FROM base LEFT JOIN cosine USING (doc), span)"""


def _fused(spark, d):
    docs, view, asked = _view(spark, d)
    scored = docs.select("row").join(one_scored(spark, d).select("row", rounded("score").alias("score")), "row", "left").na.fill(0.0, ["score"])
    return views.fuse(cut_lineage(scored), views.cosine(view, asked))


@query(f"WITH m AS ({MARKED}) SELECT count(*) FILTER ({ALIVE}) AS n_live, count(*) FILTER (({ALIVE}) AND vec_id IS NOT NULL) AS covered_live, count(vec_id) AS covered_total FROM m LEFT JOIN embeddings ON vec_id = doc_id")
def view_coverage(spark, d):
    marked = labelled(spark, d)
    return views.coverage(marked, marked.where("toxic = 1").select("row"), _view(spark, d)[1])


@query(f"WITH {_VIEW} SELECT doc AS doc_id, round(cos, 6) AS cos FROM cosine")
def view_cosine(spark, d):
    _, view, asked = _view(spark, d)
    return views.cosine(view, asked).select(F.col("row").alias("doc_id"), rounded("cos").alias("cos"))


@query(f"WITH {_FUSED} SELECT doc AS doc_id, round(base, 6) AS base, round(cos, 6) AS cos, round(fused, 6) AS fused FROM fused")
def fused_scores(spark, d):
    return _fused(spark, d).select(F.col("row").alias("doc_id"), rounded("base").alias("base"), rounded("cos").alias("cos"), rounded("fused").alias("fused"))


@query(f"WITH {_FUSED} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score FROM (SELECT doc AS doc_id, round(fused, 6) AS score FROM fused) QUALIFY rank <= {K}")
def fused_topk(spark, d):
    fused = _fused(spark, d).select(F.lit(0).alias("qid"), "row", F.col("fused").alias("score"))
    return bm25.top_k(fused, K, positive=False, digits=DIGITS).select(F.col("row").alias("doc_id"), "rank", "score")


@query(f"""WITH {index_sql()}, {scored_sql()}, {_VIEW}, cand AS (SELECT doc, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 6) DESC, doc LIMIT {max(10 * K, 100)}),
j AS (SELECT doc, score, coalesce(cos, 0) AS d FROM cand LEFT JOIN cosine USING (doc)), t AS (SELECT greatest(max(d), 1e-9) AS md, greatest(max(score), 1e-9) AS ms FROM j)
SELECT doc AS doc_id, score, round(0.6 * d / md + 0.4 * score / ms, 6) AS fused FROM j, t ORDER BY 0.6 * d / md + 0.4 * score / ms DESC, doc LIMIT {K}""")
def dense_rerank(spark, d):
    _, view, asked = _view(spark, d)
    scored = cut_lineage(one_scored(spark, d).select("row", rounded("score").alias("score")))
    return views.dense_rerank(scored, view, asked, K).select(F.col("row").alias("doc_id"), "score", rounded("fused").alias("fused"))


@query("SELECT count(*) FILTER (doc_id IS NOT NULL) AS matched, count(*) FILTER (doc_id IS NULL) AS unmatched FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def view_join_unmatched(spark, d):
    saved = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("docid"), F.col("embedding").alias("vec"))
    rows, unmatched = views.by_docid(saved, docs_of(spark, d).select(F.col("doc_id").cast("string").alias("docid"), "row"))
    return rows.agg(F.count("*").alias("matched")).crossJoin(unmatched.agg(F.count("*").alias("unmatched")))


# indexes of directories


def written(spark, docs: DataFrame, folder: str) -> None:
    """Texts as files of 50 documents each, with a blank line between two."""
    docs.select(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("value")).write.option("maxRecordsPerFile", 50).text(folder)


def chunk_scores(index: Index) -> DataFrame:
    """(text, score) of every chunk with a word of the query."""
    return index.scores([QUERY]).join(index.all_chunks(), "row").select("text", rounded("score").alias("score"))


def _chunked(where: str = "TRUE") -> str:
    """Prose chunks of documents, as a corpus."""
    return f"SELECT doc_id * 100000 + seq AS doc_id, text FROM ({ORACLES['chunk_prose'].replace('FROM documents WHERE', f'FROM (SELECT * FROM documents WHERE {where}) WHERE')})"


def _chunk_scores_sql(where: str = "TRUE") -> str:
    return f"WITH {index_sql(_chunked(where))}, {scored_sql()} SELECT text, round(score, 6) AS score FROM sc JOIN corpus ON doc = doc_id"


@query(_chunk_scores_sql())
def directory_scores(spark, d):
    """Files are listed and read through Hadoop, cut into paragraphs and indexed."""
    place = Files(spark).qualified(folder(spark))
    written(spark, docs_of(spark, d), f"{place}/root")
    return chunk_scores(Index.build(spark, f"{place}/root", f"{place}/index"))


@query(_chunk_scores_sql(f"{PART} <> 1"))
def updated_directory_scores(spark, d):
    """Two folders of files come, the first goes again: each update takes the route that the counts ask for, and the scores are those of a fresh index."""
    place, docs = Files(spark).qualified(folder(spark)), docs_of(spark, d)
    root = f"{place}/root"
    written(spark, docs.where(is_base()), f"{root}/base")
    index = Index.build(spark, root, f"{place}/index")
    for lang in (FIRST, SECOND):
        written(spark, docs.where(F.col("lang") == lang), f"{root}/{lang}")
        index.update()
    Files(spark).delete(f"{root}/{FIRST}")
    index.update()
    return chunk_scores(Index(spark, f"{place}/index"))


# what an index keeps


_FILE_ORDER = {"tie": "source NULLS FIRST, doc", "more": "JOIN (SELECT doc_id AS doc, source FROM documents) USING (doc)"}


@query(f"WITH {index_sql(MARKED, ALIVE)}, {scored_sql()} {best_sql(**_FILE_ORDER)}")
def saved_copy_topk(spark, d):
    marked = labelled(spark, d)
    index = index_of(spark, marked)
    gone = as_texts(marked.where("toxic = 1")).select("docid")
    index.delete(index.chunks().join(gone, "docid", "left_semi").select("row"))
    copy = index.save(f"{index.store.path}-copy", w_cache=True)
    return index_ranked(Index(spark, copy["path"]))


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql(**_FILE_ORDER)}")
def stored_weights_topk(spark, d):
    """Weights that one session stores and the next one finds."""
    index = index_of(spark, docs_of(spark, d))
    index.config(w_cache=True)
    index.weights()
    again = Index(spark, index.store.path)
    again.config(materialised=True)
    best = index_ranked(again)
    if again._weights != index._weights:
        raise RuntimeError("the stored weights were not found")
    return best


def _quarters(index: Index, docs: DataFrame, **settings) -> Index:
    """The index with the documents of the first segment's language appended in four commits."""
    index.config(**settings)
    for i in range(4):
        index.append(as_texts(docs.where((F.col("lang") == FIRST) & (F.col("doc_id") % 4 == i))))
    return Index(spark=index.spark, path=index.store.path)


_APPENDED = f"WITH {index_sql(f'SELECT * FROM documents WHERE {PART} < 2', vocabulary=_BASE_DOCS)}, {scored_sql()} {best_sql(tie='part, CASE part WHEN 1 THEN doc % 4 END, source NULLS FIRST, doc', more=ROWS_OF)}"


@query(_APPENDED)
def compaction_tiers_topk(spark, d):
    """Four deltas, merged into one each time two are there; the base is never rewritten."""
    docs = docs_of(spark, d)
    index = index_of(spark, docs.where(is_base()))
    base = index.state.parts[0]
    again = _quarters(index, docs, compact_commits=2, compact_ratio=10.0)
    if again.state.parts[0] != base or len(again.state.parts) != 2:
        raise RuntimeError("the deltas were not merged beside the base")
    return index_ranked(again)


@query(_APPENDED)
def snapshot_mode_topk(spark, d):
    docs = docs_of(spark, d)
    return index_ranked(_quarters(index_of(spark, docs.where(is_base())), docs, persist="snapshot"))


@query(f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS row FROM documents) SELECT row, doc_id FROM o WHERE row BETWEEN {PAGE * PAGE_ROWS} AND {(PAGE + 1) * PAGE_ROWS - 1}")
def row_range(spark, d):
    return index_of(spark, docs_of(spark, d)).rows(PAGE * PAGE_ROWS, PAGE_ROWS).select("row", F.col("docid").cast("long").alias("doc_id"))


@query(f"WITH {index_sql()}, {scored_sql()} {best_sql(**_FILE_ORDER)}")
def hits_without_text(spark, d):
    hits = index_of(spark, docs_of(spark, d)).search(QUERY, K, with_text=False)
    return local_rows(spark, [(int(h["docid"]), h["rank"], round(h["score"], DIGITS)) for h in hits], "doc_id long, rank long, score double")


@query(f"""WITH {index_sql()}, {scored_sql(_ASKED)}, best AS (SELECT doc AS doc_id FROM sc JOIN documents ON doc = doc_id WHERE contains(source, '{BROWSED}') AND score > 0 ORDER BY score DESC, source, doc LIMIT 1)
SELECT q.term AS term, q_count, CASE WHEN df IS NULL THEN 'oov' WHEN tf IS NULL THEN 'no_tf' ELSE 'ok' END AS status, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, round(coalesce({weight_sql()}, 0), 6) AS contribution
FROM best CROSS JOIN q LEFT JOIN lex USING (term) LEFT JOIN post ON post.doc = doc_id AND post.term = q.term, st""")
def explain_by_file(spark, d):
    rows = index_of(spark, docs_of(spark, d)).explain(QUERY, docid=BROWSED, top=100)
    return local_rows(spark, [(r["term"], r["q_count"], r["status"], r["tf"], r["df"], round(r["contribution"], DIGITS)) for r in rows], "term string, q_count long, status string, tf long, df long, contribution double")


@query(f"SELECT 'before' AS reader, count(*) FILTER ({PART} = 0) AS n_live FROM documents UNION ALL SELECT 'after', count(*) FROM documents WHERE {PART} < 2")
def snapshot_isolation(spark, d):
    """A reader sees the commit that it has opened, whatever is written meanwhile."""
    docs = docs_of(spark, d)
    index = index_of(spark, docs.where(is_base()))
    before = Index(spark, index.store.path)
    index.append(as_texts(docs.where(F.col("lang") == FIRST)))
    return local_rows(spark, [(n, x.chunks().count()) for n, x in (("before", before), ("after", Index(spark, index.store.path)))], "reader string, n_live long")


@query(f"""SELECT tag, status, generation FROM (VALUES ('{FIRST}', 'folded', NULL::BIGINT), ('{SECOND}', 'mounted', 7)) v(tag, status, generation)""")
def remount_report(spark, d):
    """Segments after a reopening: folded ones and mounted ones, with the caller's generation."""
    docs = docs_of(spark, d)
    index = index_of(spark, docs.where(is_base()))
    index.fold(index.publish(as_texts(docs.where(F.col("lang") == FIRST)), tag=FIRST)["tag"])
    index.publish(as_texts(docs.where(F.col("lang") == SECOND)), tag=SECOND, generation=7)
    again = Index(spark, index.store.path)
    known = {s["tag"]: s["generation"] for s in again.segments()}
    return local_rows(spark, [(r["tag"], r["status"], known.get(r["tag"])) for r in again.remount()], "tag string, status string, generation long")


@query("SELECT unnest(['append', 'repeated tag', 'save', 'stale reader', 'unknown tag', 'weights']) AS what, TRUE AS refused")
def publish_guards(spark, d):
    """What is refused while a segment is mounted, and to a writer that the log has left behind."""
    docs = docs_of(spark, d)
    index = index_of(spark, docs.where(is_base()))
    late = Index(spark, index.store.path)
    some = as_texts(docs.where(F.col("lang") == FIRST))
    index.publish(some, tag=FIRST)
    tries = {"append": lambda: index.append(some), "repeated tag": lambda: index.publish(some, tag=FIRST), "save": index.save, "stale reader": lambda: late.publish(some), "unknown tag": lambda: index.unmount(SECOND), "weights": index.weights}

    def refused(act) -> bool:
        try:
            act()
        except (RuntimeError, ValueError, KeyError):
            return True
        return False

    return local_rows(spark, [(n, refused(act)) for n, act in sorted(tries.items())], "what string, refused boolean")


@query("SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS covered FROM documents")
def saved_view_mask(spark, d):
    """Which chunks a view covers, after it was saved by docid and attached in another session."""
    docs = docs_of(spark, d)
    index = index_of(spark, docs)
    vectors = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 18, "0").alias("docid"), F.col("embedding").alias("vec"))
    index.attach_view("v", views.by_docid(vectors, index.chunks())[0])
    index.save_view("v")
    index.detach_view("v")
    again = Index(spark, index.store.path)
    again.load_views()
    return cut_lineage(again.covered("v").join(again.all_chunks().select("row", "docid"), "row").select(F.col("docid").cast("long").alias("doc_id"), "covered"))


@query("WITH v AS (SELECT doc_id, [length(text), length(text) - length(replace(text, 'e', ''))]::DOUBLE[] AS v FROM documents) SELECT doc_id, round(list_dot_product(v, [1, 1]::DOUBLE[]) / (greatest(sqrt(list_dot_product(v, v)), 1e-12) * sqrt(2)), 6) AS cos FROM v")
def encoded_view_cosine(spark, d):
    """A view from an encoder of texts."""
    index = index_of(spark, docs_of(spark, d))
    index.encode_view("v", lambda texts: [[len(t), t.count("e")] for t in texts])
    found = views.cosine(index._views["v"]["view"], [1.0, 1.0]).join(index.all_chunks().select("row", "docid"), "row")
    return cut_lineage(found.select(F.col("docid").cast("long").alias("doc_id"), rounded("cos").alias("cos")))


# doors for Python, routing of chunks


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term")
def custom_tokenizer_df(spark, d):
    import re

    words = texts.custom_tokens(lambda t: re.findall("[a-z]+", t.lower()))
    return postings.lexicon(postings.postings(docs_of(spark, d), tokenize=words))


@query(f"SELECT * FROM ({ORACLES['chunk_code']}) WHERE doc_id % 2 = 1 UNION ALL SELECT * FROM ({ORACLES['chunk_prose']}) WHERE doc_id % 2 = 0")
def routed_chunks(spark, d):
    named = docs_of(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 1, ".py").otherwise(".md")).alias("file"), "text")
    return chunks.chunk_files(named).select(F.substring_index("file", ".", 1).cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.col("line").cast("long").alias("line"), "text")


@query("SELECT 1::BIGINT AS calls, 1::BIGINT AS ways, TRUE AS counted")
def selection_paths(spark, d):
    """The counters of one approximate selection: one call, one way."""
    bm25.topk_stats(reset=True)
    bm25.approximate_top_k(cut_lineage(one_scored(spark, d).select("row", "score")), K)
    got = bm25.topk_stats(reset=True)
    return local_rows(spark, [(got["calls"], got["approx"] + got["exact"] + got["fallback"], got["exact"] == 1 or got["cand"] > 0)], "calls long, ways long, counted boolean")
