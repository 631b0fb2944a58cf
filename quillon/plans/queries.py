"""The retrieval and evaluation operators as registered queries over the whole tables, and their DuckDB SQL.

A document is five consecutive vectors of ``embeddings`` (vec_id div 5), its label that of the first. Searches take the
documents whose id is divisible by 50 as queries, against all documents. Binary codes use the first 48 dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import calibrator, filters
from quillon.functions.kernels import BITS, cosine_to, hamming_maxsim, normalized, register, text_tokens, words_of_bytes
from quillon.operators import bm25, metrics, postings, pruned, retrieval, sql, topk, triage
from quillon.operators.records import Clause, Filter
from quillon.sources import files, store
from quillon.sources.versioned import VersionedTable
from quillon.streaming import standing

K, PREFILTER = 10, retrieval.PREFILTER
#: Fixed query texts of the lexical lane: frequent and rarer words of the corpus.
LEXICAL = (("q1", "the heat ring"), ("q2", "of the the tion"), ("q3", "para el que"), ("q4", "keit und der schach"), ("q5", "les une eau"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def multivectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, fp16)."""
    each = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("doc_id"), "vec_id", "label", "embedding")
    own = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "embedding"))).alias("v"))
    return own.select("doc_id", F.element_at("v", 1)["label"].alias("label"), F.transform("v", lambda x: x["embedding"]).alias("fp16"))


def fitted(spark: SparkSession, sf_dir: str) -> calibrator.Calibrator:
    return calibrator.fit(table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, BITS).alias("v")), "v")


_indexes: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable):
    """What make() gives, made when the session first asks for it or the table's files have changed since."""
    key = (spark.sparkContext.applicationId, sf_dir, make.__qualname__, files.state(spark, f"{sf_dir}/{name}.parquet"))
    if key not in _indexes:
        _indexes[key] = make()
    return _indexes[key]


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, fp16, bin): the index that all vector lanes read, written in the shared folder once."""

    def codes() -> DataFrame:
        words = fitted(spark, sf_dir).words(F.transform("fp16", lambda v: F.slice(v, 1, BITS)))
        return files.stored(multivectors(spark, sf_dir).withColumn("bin", words), "index")

    return _once(spark, sf_dir, "embeddings", codes)


def lexical(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The postings of all documents, which all lexical lanes read, written in the shared folder once."""

    def built() -> postings.Index:
        return postings.build(table(spark, sf_dir, "documents"))

    return _once(spark, sf_dir, "documents", built)


def asked(docs: DataFrame) -> DataFrame:
    own = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id").withColumnRenamed("fp16", "q_fp16")
    return own.withColumnRenamed("bin", "q_bin") if "bin" in docs.columns else own


def scores(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Scores rounded for comparison, after ranking by the raw ones."""
    return frame.withColumns({c: F.round(c, digits) for c, kind in frame.dtypes if kind in ("double", "float")})


def lexical_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICAL), "query_id string, text string")


MV = f"""
vecs AS (SELECT vec_id // 5 AS doc_id, vec_id, label, embedding FROM embeddings),
thr AS (SELECT list(t ORDER BY dim) AS t FROM (SELECT dim, quantile_cont(x::DOUBLE, 0.5)::FLOAT AS t FROM (SELECT unnest(range(1, {BITS + 1})) AS dim, unnest(embedding[1:{BITS}]) AS x FROM embeddings) GROUP BY dim)),
mv AS (SELECT doc_id, arg_min(label, vec_id) AS label, list(embedding::DOUBLE[] ORDER BY vec_id) AS fp16,
  list(list_sum(list_transform(range(1, {BITS + 1}), lambda i: CASE WHEN embedding[i] > t[i] THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END))::BIGINT ORDER BY vec_id) AS bin FROM vecs, thr GROUP BY doc_id)"""
HAMMING = "list_sum(list_transform({q}, lambda a: 48 - list_min(list_transform({d}, lambda b: bit_count(xor(a, b))))))::DOUBLE"
COSINE = "list_sum(list_transform({q}, lambda a: list_max(list_transform({d}, lambda b: list_cosine_similarity(a, b)))))"
ALL_HAMMING = f"pairs AS (SELECT q.doc_id AS query_id, d.doc_id, {HAMMING.format(q='q.bin', d='d.bin')} AS score, d.label FROM mv q, mv d WHERE q.doc_id % 50 = 0)"
ALL_COSINE = f"pairs AS (SELECT q.doc_id AS query_id, d.doc_id, {COSINE.format(q='q.fp16', d='d.fp16')} AS score FROM mv q, mv d WHERE q.doc_id % 50 = 0)"


def _top(source: str, k: int = K, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


# Encoding and kernels --------------------------------------------------------------------------------------------------


def binary_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrator.thresholds(table(spark, sf_dir, "embeddings"), "embedding").select("dim", F.round(F.col("threshold").cast("double"), 6).alias("threshold"))


def binary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("doc_id", F.posexplode("bin").alias("pos", "word"))


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from rows of eight bytes, with the upper 16 bits set: orders' keys as bytes."""
    key = F.col("o_orderkey")
    row = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(key, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(6)), F.lit("FFFF")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(words_of_bytes(F.array(row)), 1).alias("word"))


def hamming_pairs_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function over the queries and all documents."""
    register(spark)
    encoded(spark, sf_dir).createOrReplaceTempView("quillon_mv")
    return spark.sql("SELECT q.doc_id AS query_id, a.doc_id, CAST(hamming_maxsim(q.bin, a.bin) AS DOUBLE) AS score FROM quillon_mv q CROSS JOIN quillon_mv a WHERE q.doc_id % 50 = 0")


def _searched(spark: SparkSession, sf_dir: str, allowed: str) -> DataFrame:
    docs = encoded(spark, sf_dir).select("doc_id", "bin", "label")
    sql.register_search(docs, name="quillon_hamming_topk", label="label")
    docs.where("doc_id % 50 = 0").createOrReplaceTempView("quillon_asked")
    return spark.sql(f"SELECT q.doc_id AS query_id, t.* FROM quillon_asked q, LATERAL quillon_hamming_topk(q.bin, {K}, {allowed}) t")


def hamming_topk_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function, for each query."""
    return _searched(spark, sf_dir, "NULL")


def hamming_topk_sql_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the documents of some labels."""
    return _searched(spark, sf_dir, "array(1, 5, 7)")


def hamming_bytes_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function over rows of eight bytes, with their upper 16 bits set: orders' keys against their customers'."""
    register(spark)
    as_bytes = lambda key: f"array(unhex(concat({', '.join(f'lpad(hex(shiftright({key}, {8 * k}) & 255), 2, {zero})' for k in range(6) for zero in [chr(39) + '0' + chr(39)])}, 'FFFF')))"
    score = F.expr(f"hamming_maxsim_bytes({as_bytes('o_orderkey')}, {as_bytes('o_custkey')})").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"))


def rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes after a rotation that turns the order of the dimensions round, against thresholds of zero."""
    turned = tuple(tuple(float(i + j == BITS - 1) for j in range(BITS)) for i in range(BITS))
    codes = calibrator.Calibrator((0.0,) * BITS, turned).words(F.array(F.slice("embedding", 1, BITS)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(codes, 1).alias("word"))


def reflected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes after a reflection that mixes all dimensions: at the plane across (1, 2, ..., 48)."""
    square = sum((i + 1) ** 2 for i in range(BITS))
    mirror = tuple(tuple(float(i == j) - 2 * (i + 1) * (j + 1) / square for j in range(BITS)) for i in range(BITS))
    codes = calibrator.Calibrator((0.0,) * BITS, mirror).words(F.array(F.slice("embedding", 1, BITS)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(codes, 1).alias("word"))


def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivectors(spark, sf_dir).select("doc_id", F.posexplode(normalized("fp16")).alias("pos", "v")).select("doc_id", "pos", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"), F.round(F.element_at("v", 1), 6).alias("first"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "documents").select("doc_id", text_tokens("text").alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


# Lanes -----------------------------------------------------------------------------------------------------------------


def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query with its code written into the plan."""
    docs = encoded(spark, sf_dir)
    code = list(docs.where("doc_id = 0").first()["bin"])
    return topk.first_k(docs.select("doc_id", hamming_maxsim(code, "bin").cast("double").alias("score")), K)


def hamming_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoded(spark, sf_dir)
    return retrieval.binary_lane(asked(docs), docs, K)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoded(spark, sf_dir)
    query = docs.where("doc_id = 0").first()["fp16"]
    return scores(topk.first_k(docs.select("doc_id", cosine_to(query, "fp16").alias("score")), K))


def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoded(spark, sf_dir)
    return scores(retrieval.cosine_lane(asked(docs), docs, K))


def hamming_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hamming_topk_batch by multi-index hashing."""
    docs = encoded(spark, sf_dir)
    lists = _once(spark, sf_dir, "embeddings", _binary_lists(spark, sf_dir))
    return pruned.binary_search(asked(docs), docs, K, postings=lists).hits


def cosine_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cosine_topk_batch by cluster bounds."""
    docs = encoded(spark, sf_dir)
    index = _once(spark, sf_dir, "embeddings", _clusters(spark, sf_dir))
    return scores(pruned.cosine_search(asked(docs), docs, K, index=index).hits)


def _binary_lists(spark: SparkSession, sf_dir: str) -> Callable:
    return lambda: files.stored(pruned.binary_postings(encoded(spark, sf_dir)), "lists")


def _clusters(spark: SparkSession, sf_dir: str) -> Callable:
    return lambda: pruned.clusters(encoded(spark, sf_dir).select("doc_id", normalized("fp16").alias("unit")))


def binary_then_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoded(spark, sf_dir)
    return scores(retrieval.binary_then_cosine(asked(docs), docs, K, PREFILTER))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical(spark, sf_dir)
    terms = sorted({w for _, t in LEXICAL for w in t.split()})
    return scores(index.terms().where(F.col("term").isin(terms)).crossJoin(index.corpus()))  # one row


def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term of the index, by its postings."""
    each = lexical(spark, sf_dir).postings().select("term", "n", F.explode(F.arrays_zip("tf", "length")).alias("p"), "impacts")
    own = each.select("term", F.col("p.tf").alias("tf"), F.col("p.length").alias("length"), F.exists("impacts", lambda i: (i["tf"] >= F.col("p.tf")) & (i["length"] <= F.col("p.length"))).alias("bounded"))
    return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"), F.min("length").alias("shortest"), F.min("bounded").alias("bounded"))


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(postings.scores(lexical(spark, sf_dir), lexical_queries(spark)))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(retrieval.bm25_lane(lexical_queries(spark), lexical(spark, sf_dir), K))


def hybrid_then_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all documents, then those candidates that have multivectors, which go by the same id; the query's vectors
    are those of document 0, 1, ... in turn."""
    vectors = encoded(spark, sf_dir).where(F.col("doc_id") < len(LEXICAL)).select(F.concat(F.lit("q"), (F.col("doc_id") + 1).cast("string")).alias("query_id"), F.col("fp16").alias("q_fp16"))
    coarse = retrieval.bm25_lane(lexical_queries(spark), lexical(spark, sf_dir), PREFILTER)
    return scores(retrieval.rerank(coarse, vectors, encoded(spark, sf_dir), K, "bm25_score"))


BM25_SQL = (
    r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {docs}),
corpus AS (SELECT count(*) AS n_docs, coalesce(avg(len(t)::DOUBLE), 0) AS avg_length FROM toks),
qs(query_id, text) AS (VALUES """
    + ", ".join(f"('{q}', '{t}')" for q, t in LEXICAL)
    + r"""),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qs) GROUP BY ALL),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM tf GROUP BY term),
found AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(avg_length, 1)))), 10) AS score, count(*) AS matched_terms
  FROM tf JOIN terms USING (term) JOIN df USING (term), corpus GROUP BY ALL)"""
)

# Filters ---------------------------------------------------------------------------------------------------------------

FILTERS: dict[str, tuple[Filter, str]] = {
    "eq": (Filter((Clause("label", "eq", 3),)), "label = 3"),
    "ne": (Filter((Clause("label", "ne", 3),)), "label <> 3"),
    "lt": (Filter((Clause("label", "lt", 4),)), "label < 4"),
    "lte": (Filter((Clause("label", "lte", 4),)), "label <= 4"),
    "gt": (Filter((Clause("label", "gt", 4),)), "label > 4"),
    "gte": (Filter((Clause("label", "gte", 4),)), "label >= 4"),
    "in": (Filter((Clause("label", "in", (1, 5, 7)),)), "label IN (1, 5, 7)"),
    "not_in": (Filter((Clause("label", "not_in", (1, 5, 7)),)), "label NOT IN (1, 5, 7)"),
    "and": (Filter((Clause("label", "gte", 2), Clause("label", "not_in", (4, 6)))), "label >= 2 AND label NOT IN (4, 6)"),
    "noop": (Filter(), "true"),
}


def _filtered(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = encoded(spark, sf_dir)
        return retrieval.binary_lane(asked(docs), docs, K, FILTERS[name][0])

    return query


def filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters over a wide table, pushed down to its scan."""
    wanted = Filter((Clause("o_orderstatus", "in", ("O", "P")), Clause("o_totalprice", "gte", 150000.0), Clause("o_orderpriority", "ne", "5-LOW")))
    return filters.apply(table(spark, sf_dir, "orders"), wanted).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# Metrics ---------------------------------------------------------------------------------------------------------------


def ranking_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoded(spark, sf_dir)
    hits = retrieval.binary_then_cosine(asked(docs), docs, K, PREFILTER)
    return scores(metrics.per_query_by_label(hits, asked(docs), docs, K))


def lane_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five lanes. The lexical ones ask the fixed texts in turn."""
    docs, texts = encoded(spark, sf_dir), lexical(spark, sf_dir)
    queries = asked(docs).withColumn("text", F.element_at(F.array(*(F.lit(t) for _, t in LEXICAL)), (F.expr("query_id div 50") % len(LEXICAL) + 1).cast("int")))
    # queries of one text have the same lexical candidates, which are looked for once
    words = lexical_queries(spark).join(queries.select("text", F.col("query_id").alias("own")), "text")
    coarse = files.stored(retrieval.bm25_lane(lexical_queries(spark), texts, PREFILTER), "lexical")
    coarse = words.join(coarse, "query_id").select(F.col("own").alias("query_id"), "doc_id", "score", "rank", "matched_terms")
    lanes = {
        "bm25": coarse.where(F.col("rank") <= K), "lance-mv": retrieval.cosine_lane(queries, docs, K), "hamming-udf-bin": retrieval.binary_lane(queries, docs, K),
        "binary-then-fp16-rerank": retrieval.binary_then_cosine(queries, docs, K, PREFILTER), "hybrid-bm25-then-fp16-rerank": retrieval.rerank(coarse, queries, docs, K, "bm25_score"),
    }
    out = None
    for name, hits in lanes.items():
        row = metrics.means(metrics.per_query_by_label(hits, queries, docs, K)).select(F.lit(name).alias("retriever"), "*")
        out = row if out is None else out.unionByName(row)
    return scores(out)


_QRELS_SQL = "qrels AS (SELECT q.doc_id AS query_id, d.doc_id FROM mv q JOIN mv d USING (label) WHERE q.doc_id % 50 = 0)"


def _metrics_sql(hits: str) -> str:
    return f"""(SELECT query_id, coalesce(n, 0) / expected AS recall, coalesce(gain, 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, least(expected, 10) + 1) t(r)) AS ndcg, coalesce(1 / first::DOUBLE, 0) AS reciprocal_rank
  FROM (SELECT query_id, count(*) AS expected FROM qrels GROUP BY query_id) LEFT JOIN (SELECT query_id, count(*) AS n, sum(1 / log2(rank + 1)) AS gain, min(rank) AS first FROM {hits} h JOIN qrels USING (query_id, doc_id) GROUP BY query_id) USING (query_id))"""


STAGED_SQL = f"""{MV}, {ALL_HAMMING}, coarse AS ({_top("pairs", PREFILTER)}),
fine AS (SELECT c.query_id, c.doc_id, c.score AS binary_score, {COSINE.format(q="q.fp16", d="d.fp16")} AS score FROM coarse c JOIN mv q ON q.doc_id = c.query_id JOIN mv d ON d.doc_id = c.doc_id),
staged AS ({_top("fine")})"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(metrics.percentiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled quality against a rule on the length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 1200, "1").otherwise("0").alias("pred"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("gold")).join(docs, "doc_id").select("gold", "pred")


PAIRS_SQL = "pairs AS (SELECT quality::VARCHAR AS gold, CASE WHEN n_chars >= 1200 THEN '1' ELSE '0' END AS pred FROM labels JOIN documents USING (doc_id))"
PER_LABEL_SQL = """per_label AS (SELECT label, (SELECT count(*) FROM pairs WHERE gold = label) AS support, CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * (tp / said) * (tp / true_n) / (tp / said + tp / true_n) END AS f1
  FROM (SELECT label, (SELECT count(*) FROM pairs WHERE gold = label AND pred = label)::DOUBLE AS tp, (SELECT count(*) FROM pairs WHERE pred = label)::DOUBLE AS said, (SELECT count(*) FROM pairs WHERE gold = label)::DOUBLE AS true_n
    FROM (SELECT gold AS label FROM pairs UNION SELECT pred FROM pairs)))"""


def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(metrics.weighted_f1(_pairs(spark, sf_dir)))


def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(metrics.cohens_kappa(_pairs(spark, sf_dir)))


def per_label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(metrics.per_label(_pairs(spark, sf_dir)))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_pairs(spark, sf_dir))


def gold_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against themselves by id: the check of both sides finds no lone id."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("string").alias("label"))
    other = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.col("toxic").cast("string").alias("label"))
    return metrics.aligned(own, other).groupBy("gold", "pred").agg(F.count("*").alias("n"))


# Triage ----------------------------------------------------------------------------------------------------------------

_QUERY_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'Phishing mail reported' WHEN 1 THEN 'odd CREDENTIAL use' WHEN 2 THEN 'Ransomware note, beacon seen' ELSE 'unusual sign-in' END"
_EVIDENCE_TEXT = "CASE l_returnflag WHEN 'A' THEN 'beacon to a known host' WHEN 'R' THEN 'credential dump' ELSE 'routine job' END"
_TARGETS = {
    "expected_action": "CASE WHEN o_orderkey % 5 < 2 THEN 'reset_credentials_and_scope_phishing' WHEN o_orderkey % 5 = 2 THEN 'isolate_host_and_block_beacon' ELSE 'collect_more_context' END",
    "expected_disposition": "CASE WHEN o_orderkey % 5 < 2 THEN 'credential_reset' WHEN o_orderkey % 5 = 2 THEN 'contain_host' ELSE 'needs_triage' END",
    "rationale_keyword": "CASE WHEN o_orderkey % 2 = 0 THEN 'Credential' ELSE 'containment' END",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries and their line items as evidence, the dearest first."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("score"), F.expr(_EVIDENCE_TEXT).alias("text"))
    own = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("line").cast("string").alias("alert_id"), "score", F.lit("fp16_maxsim").alias("stage"), "text"))).alias("v"))
    evidence = own.select("query_id", F.transform("v", lambda e: F.struct(e["alert_id"].alias("alert_id"), e["score"].alias("score"), e["stage"].alias("stage"), e["text"].alias("text"))).alias("evidence"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), F.expr(_QUERY_TEXT).alias("query_text"), *(F.expr(x).alias(c) for c, x in _TARGETS.items()), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN cast(array() AS array<string>) ELSE array('1', '2', '3') END").alias("expected_evidence_ids"))
    return orders.join(evidence, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(triage.EVIDENCE)))


def rule_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.decide(samples(spark, sf_dir)).select("query_id", *triage.DECISION[:4], F.array_join("cited_evidence_ids", ",").alias("cited"))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(triage.judge(triage.decide(samples(spark, sf_dir))).select("query_id", *triage.SCORES))


def mean_judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(triage.mean_scores(triage.judge(triage.decide(samples(spark, sf_dir)))), 5)


def replay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of scores replayed from a table of them by id."""
    decided = files.stored(triage.decide(samples(spark, sf_dir)), "decided")
    judged = triage.judge(decided)
    return scores(triage.mean_scores(triage.replay(decided.select("query_id", "evidence"), judged.select("query_id", *triage.SCORES), "judge")), 5)


def audit_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row; the judge's name is expected as another one, so that it is an orphan in every sample."""
    done = files.stored(triage.with_audit(triage.judge(triage.decide(samples(spark, sf_dir)))).select("query_id", "terminal_output_kind", "terminal_tool", "audit_records"), "audit")
    summary = triage.audit_summary(done, names=[triage.TRIAGER, "another judge"], roles=["triager", "judge"])
    return summary.crossJoin(triage.gates(done, names=[triage.TRIAGER, triage.JUDGE], roles=["triager", "judge"]))  # one row each


def audit_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_and_gates from records that are stored as VARIANT."""
    done = files.stored(triage.with_audit(triage.judge(triage.decide(samples(spark, sf_dir))), variant=True).select("query_id", "terminal_output_kind", "terminal_tool", "audit_records"), "audit")
    summary = triage.audit_summary(done, names=[triage.TRIAGER, "another judge"], roles=["triager", "judge"])
    return summary.crossJoin(triage.gates(done, names=[triage.TRIAGER, triage.JUDGE], roles=["triager", "judge"]))  # one row each


def replay_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions replayed from a table of them by id."""
    decided = files.stored(triage.decide(samples(spark, sf_dir)).select("query_id", "query_text", *triage.DECISION), "decided")
    return triage.replay(decided.select("query_id", "query_text"), decided.drop("query_text")).groupBy("action", "disposition").agg(F.count("*").alias("n"))


def _rules_sql() -> str:
    cases = {k: "" for k in range(4)}
    for where, words, *out in triage.RULES:
        place = "lower(query_text)" if where == "query" else "lower(evidence_text)"
        for k in range(4):
            value = f"'{out[k]}'" if isinstance(out[k], str) else f"{out[k]}::DOUBLE"
            cases[k] += f" WHEN contains({place}, '{words[0]}') OR contains({place}, '{words[1]}') THEN {value}"
    ends = [f"'{o}'" if isinstance(o, str) else f"{o}::DOUBLE" for o in triage.OTHERWISE]
    return ", ".join(f"CASE{cases[k]} ELSE {ends[k]} END AS {triage.DECISION[k]}" for k in range(4))


SAMPLES_SQL = f"""
ev AS (SELECT l_orderkey, list(l_linenumber::VARCHAR ORDER BY -l_extendedprice, l_linenumber::VARCHAR) AS ids, string_agg({_EVIDENCE_TEXT}, ' ') AS evidence_text FROM lineitem GROUP BY l_orderkey),
samples AS (SELECT o_orderkey::VARCHAR AS query_id, {_QUERY_TEXT} AS query_text, coalesce(ids, []::VARCHAR[]) AS ids, coalesce(evidence_text, '') AS evidence_text, {", ".join(f"{x} AS {c}" for c, x in _TARGETS.items())},
  CASE WHEN o_orderkey % 7 = 0 THEN []::VARCHAR[] ELSE ['1', '2', '3'] END AS expected FROM orders LEFT JOIN ev ON l_orderkey = o_orderkey),
decided AS (SELECT *, {_rules_sql()}, ids[1:2] AS cited FROM samples),
judged AS (SELECT *, CASE WHEN action = expected_action THEN 1.0::DOUBLE ELSE 0 END AS action_validity,
  CASE WHEN len(expected) = 0 THEN 0::DOUBLE ELSE len(list_filter(cited, lambda c: list_contains(expected, c)))::DOUBLE / len(expected) END AS evidence_grounding,
  CASE WHEN contains(lower(rationale), lower(rationale_keyword)) AND len(cited) > 0 THEN 1.0::DOUBLE ELSE 0 END AS specificity,
  greatest(0, 1 - abs(confidence - CASE WHEN action = expected_action AND disposition = expected_disposition THEN 1 ELSE 0 END))::DOUBLE AS calibration FROM decided)"""

# Stores ----------------------------------------------------------------------------------------------------------------


def _price_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(-1).cast("bigint").alias("seq"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), seq.alias("seq"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).alias("brand"))
    return parts, writes


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts, overwritten by each line item in the order of its key; missing values keep the old ones."""
    return store.upsert(*_price_changes(spark, sf_dir))


def _prices(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """The parts of store_upsert as a versioned table, to which the line items come in three batches, the latest first."""

    def made() -> VersionedTable:
        parts, writes = _price_changes(spark, sf_dir)
        found = VersionedTable.create(parts, files.join(files.new_folder(spark, "prices"), "table"))
        for third in (2, 1, 0):
            found.write(writes.where(F.expr("seq div 10 % 3") == third))
        return found

    return _once(spark, sf_dir, "lineitem", made)


def store_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_upsert by delta files that are merged when read."""
    return _prices(spark, sf_dir).read(4)


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a compaction."""
    found = _prices(spark, sf_dir)
    if len(found.manifest()["parts"]) > 1:
        found.compact()
    return found.read()


def _orders(spark: SparkSession, sf_dir: str) -> VersionedTable:
    def made() -> VersionedTable:
        rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("bigint").alias("seq"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
        return VersionedTable.create(rows, files.join(files.new_folder(spark, "orders"), "table"))

    return _once(spark, sf_dir, "orders", made)


def store_clustered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their keys from a table dealt to buckets and in order of them: those with a line item of 50 pieces."""
    ids = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id"))
    return _orders(spark, sf_dir).fetch(ids).drop("seq")


def store_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of orders by their key."""
    return store.row_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multivectors by a table of ids, some of them repeated and some missing."""
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("doc_id"))
    return store.fetch(multivectors(spark, sf_dir), ids, "doc_id").select("doc_id", "label", F.size("fp16").alias("tokens"))


def evidence_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = files.stored(retrieval.bm25_lane(lexical_queries(spark), lexical(spark, sf_dir), 3).withColumn("stage", F.lit("bm25")), "hits")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = triage.attach_evidence(hits, texts)
    return found.select("query_id", F.posexplode("evidence").alias("pos", "e")).select("query_id", "pos", F.col("e.alert_id").alias("alert_id"), F.round("e.score", 6).alias("score"), F.col("e.stage").alias("stage"), F.md5("e.text").alias("text_md5"))


_STREAMED = "o_orderkey * 31 + o_custkey * 1009"
_ASKED = "r_regionkey * 1000003"


def standing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' codes as standing queries, orders' codes as a stream of documents that is read to its end."""
    regions = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS STRING) AS query_id", f"array(cast({_ASKED} AS BIGINT)) AS q_bin")
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")  # a pattern, as it may be a file
    docs = orders.selectExpr("cast(o_orderkey AS STRING) AS doc_id", f"array(cast({_STREAMED} AS BIGINT)) AS bin")
    folder = files.new_folder(spark, "standing")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", standing.STORE)
    try:
        found = standing.standing(docs, regions, lambda: hamming_maxsim("q_bin", "bin"), K)
        write = lambda frame, batch: frame.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return standing.latest(spark.read.parquet(f"{folder}/out").drop("batch")).drop("latest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        binary_thresholds, binary_encode, packed_words, hamming_pairs_sql, hamming_topk_sql, hamming_topk_sql_filtered, normalized_tokens, tokenize_counts, hamming_topk, hamming_topk_batch, cosine_topk, cosine_topk_batch, hamming_topk_indexed, cosine_topk_indexed, binary_then_cosine,
        bm25_stats, bm25_terms, bm25_all, bm25_topk, hybrid_then_cosine, filter_orders, ranking_per_query, lane_comparison, latency_percentiles, weighted_f1, cohens_kappa, per_label_f1, confusion_matrix,
        gold_alignment, rule_triage, judge_scores, mean_judge_scores, audit_and_gates, audit_variant, replay_decisions, replay_scores, store_upsert, store_versioned, store_compacted, store_clustered_fetch, store_fetch, store_row_ids, standing_orders, evidence_attach, hamming_bytes_sql,
        rotated_codes, reflected_codes,
    )
} | {f"filter_{name}": _filtered(name) for name in FILTERS}

_DOC0 = "(SELECT {c} FROM mv WHERE doc_id = 0)"
_BM25 = BM25_SQL.replace("{docs}", "documents")
ORACLE_SQL: dict[str, str] = {
    "binary_thresholds": "SELECT (dim - 1)::INT AS dim, round(quantile_cont(x::DOUBLE, 0.5)::FLOAT::DOUBLE, 6) AS threshold FROM (SELECT unnest(range(1, 49)) AS dim, unnest(embedding[1:48]) AS x FROM embeddings) GROUP BY dim",
    "binary_encode": f"WITH {MV} SELECT doc_id, (unnest(range(len(bin))))::INT AS pos, unnest(bin) AS word FROM mv",
    "packed_words": "SELECT o_orderkey, o_orderkey & 281474976710655 AS word FROM orders",
    "hamming_pairs_sql": f"WITH {MV}, {ALL_HAMMING} SELECT query_id, doc_id, score FROM pairs",
    "normalized_tokens": "SELECT vec_id // 5 AS doc_id, (vec_id % 5)::INT AS pos, 1.0::DOUBLE AS square, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings",
    "tokenize_counts": "SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)",
    "hamming_topk": f"WITH {MV} SELECT doc_id, {HAMMING.format(q=_DOC0.format(c='bin'), d='bin')} AS score FROM mv ORDER BY score DESC, doc_id::VARCHAR LIMIT {K}",
    "hamming_topk_batch": f"WITH {MV}, {ALL_HAMMING} SELECT query_id, doc_id, score, rank::INT AS rank FROM ({_top('pairs')})",
    "cosine_topk": f"WITH {MV} SELECT doc_id, round({COSINE.format(q=_DOC0.format(c='fp16'), d='fp16')}, 6) AS score FROM mv ORDER BY {COSINE.format(q=_DOC0.format(c='fp16'), d='fp16')} DESC, doc_id::VARCHAR LIMIT {K}",
    "cosine_topk_batch": f"WITH {MV}, {ALL_COSINE} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({_top('pairs')})",
    "hamming_topk_indexed": f"WITH {MV}, {ALL_HAMMING} SELECT query_id, doc_id, score, rank::INT AS rank FROM ({_top('pairs')})",
    "cosine_topk_indexed": f"WITH {MV}, {ALL_COSINE} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({_top('pairs')})",
    "binary_then_cosine": f"WITH {STAGED_SQL} SELECT query_id, doc_id, binary_score, round(score, 6) AS score, rank::INT AS rank FROM staged",
    "bm25_stats": f"WITH {_BM25} SELECT term, df, tf, n_docs, round(avg_length, 6) AS avg_length FROM df, corpus",
    "bm25_terms": r"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), each AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM toks), own AS (SELECT doc_id, length, term, count(*) AS tf FROM each GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf)::INT AS most, min(length)::INT AS shortest, true AS bounded FROM own GROUP BY term""",
    "bm25_all": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, matched_terms FROM found WHERE score > 0",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank, matched_terms FROM ({_top('found', K, 'score > 0')})",
    "hybrid_then_cosine": f"""WITH {MV}, {_BM25}, coarse AS ({_top("found", PREFILTER, "score > 0")}),
fine AS (SELECT c.query_id, c.doc_id, c.score AS bm25_score, matched_terms, {COSINE.format(q="q.fp16", d="d.fp16")} AS score FROM coarse c JOIN mv q ON 'q' || (q.doc_id + 1) = c.query_id JOIN mv d ON d.doc_id = c.doc_id)
SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, matched_terms, round(score, 6) AS score, rank::INT AS rank FROM ({_top("fine")})""",
    "filter_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 150000 AND o_orderpriority <> '5-LOW' GROUP BY ALL",
    "ranking_per_query": f"WITH {STAGED_SQL}, {_QRELS_SQL} SELECT query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(reciprocal_rank, 6) AS reciprocal_rank FROM {_metrics_sql('staged')}",
    "lane_comparison": f"""WITH {STAGED_SQL}, {_QRELS_SQL}, cos_pairs AS (SELECT q.doc_id AS query_id, d.doc_id, {COSINE.format(q='q.fp16', d='d.fp16')} AS score FROM mv q, mv d WHERE q.doc_id % 50 = 0), ham AS ({_top('pairs')}), cosine AS ({_top('cos_pairs')}),
{_BM25}, lexical AS (SELECT m.doc_id AS query_id, c.doc_id, c.rank FROM mv m JOIN ({_top("found", PREFILTER, "score > 0")}) c ON c.query_id = 'q' || ((m.doc_id // 50) % {len(LEXICAL)} + 1) WHERE m.doc_id % 50 = 0),
words AS (SELECT * FROM lexical WHERE rank <= {K}), hybrid_pairs AS (SELECT l.query_id, l.doc_id, {COSINE.format(q='q.fp16', d='d.fp16')} AS score FROM lexical l JOIN mv q ON q.doc_id = l.query_id JOIN mv d ON d.doc_id = l.doc_id), hybrid AS ({_top("hybrid_pairs")})
"""
    + " UNION ALL ".join(f"SELECT '{name}' AS retriever, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(reciprocal_rank), 6) AS mrr, count(*) AS query_count FROM {_metrics_sql(hits)}" for name, hits in (("bm25", "words"), ("hamming-udf-bin", "ham"), ("lance-mv", "cosine"), ("binary-then-fp16-rerank", "staged"), ("hybrid-bm25-then-fp16-rerank", "hybrid"))),
    "latency_percentiles": "SELECT round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95, round(coalesce(quantile_cont(value, 0.99), 0), 6) AS p99 FROM events",
    "weighted_f1": f"WITH {PAIRS_SQL}, {PER_LABEL_SQL} SELECT round(coalesce(sum(f1 * support) / sum(support), 0), 6) AS weighted_f1 FROM per_label",
    "cohens_kappa": f"WITH {PAIRS_SQL}, s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (gold = pred)::DOUBLE AS same FROM pairs), c AS (SELECT sum(g * p)::DOUBLE AS bth FROM (SELECT gold AS label, count(*)::DOUBLE AS g FROM pairs GROUP BY gold) JOIN (SELECT pred AS label, count(*)::DOUBLE AS p FROM pairs GROUP BY pred) USING (label)) SELECT round((same / n - bth / (n * n)) / (1 - bth / (n * n)), 6) AS cohens_kappa FROM s, c",
    "per_label_f1": f"WITH {PAIRS_SQL}, {PER_LABEL_SQL} SELECT label, support, round(f1, 6) AS f1 FROM per_label",
    "confusion_matrix": f"WITH {PAIRS_SQL}, l AS (SELECT gold AS label FROM pairs UNION SELECT pred FROM pairs) SELECT g.label AS gold, p.label AS pred, (SELECT count(*) FROM pairs WHERE gold = g.label AND pred = p.label) AS n FROM l g, l p",
    "gold_alignment": "SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred, count(*) AS n FROM labels GROUP BY ALL",
    "rule_triage": f"WITH {SAMPLES_SQL} SELECT query_id, action, disposition, confidence, rationale, array_to_string(cited, ',') AS cited FROM decided",
    "judge_scores": f"WITH {SAMPLES_SQL} SELECT query_id, {', '.join(f'round({s}, 6) AS {s}' for s in triage.SCORES)} FROM judged",
    "mean_judge_scores": f"WITH {SAMPLES_SQL} SELECT {', '.join(f'round(avg({s}), 5) AS {s}' for s in triage.SCORES)} FROM judged",
    "audit_and_gates": f"""WITH {SAMPLES_SQL}, records AS (SELECT query_id, unnest([{{'kind': 'model_call', 'name': '{triage.TRIAGER}', 'role': 'triager'}}, {{'kind': 'model_call', 'name': '{triage.JUDGE}', 'role': 'judge'}}, {{'kind': 'tool_call', 'name': '{triage.TERMINAL_TOOL}', 'role': ''}}], recursive := true), unnest(range(3)) AS place FROM judged),
wanted(asks, kind, name, role) AS (VALUES ('summary', 'model_call', '{triage.TRIAGER}', NULL), ('summary', 'model_call', 'another judge', NULL), ('summary', 'model_call', NULL, 'triager'), ('summary', 'model_call', NULL, 'judge'), ('summary', 'tool_call', '{triage.TERMINAL_TOOL}', NULL),
  ('gate', 'model_call', '{triage.TRIAGER}', NULL), ('gate', 'model_call', '{triage.JUDGE}', NULL), ('gate', 'model_call', NULL, 'triager'), ('gate', 'model_call', NULL, 'judge'), ('gate', 'tool_call', '{triage.TERMINAL_TOOL}', NULL)),
met AS (SELECT w.asks, w.kind, w.name, w.role, count(DISTINCT r.query_id) AS n FROM wanted w LEFT JOIN records r ON r.kind = w.kind AND (r.name = w.name OR r.role = w.role) GROUP BY ALL),
missing AS (SELECT asks, kind, sum((SELECT count(*) FROM judged) - n)::BIGINT AS n FROM met GROUP BY ALL)
SELECT (SELECT n FROM missing WHERE asks = 'summary' AND kind = 'model_call') AS orphan_llm_calls, (SELECT n FROM missing WHERE asks = 'summary' AND kind = 'tool_call') AS orphan_tool_calls,
  (SELECT bool_and(kind = 'tool_call' AND name = '{triage.TERMINAL_TOOL}') FROM records WHERE place = 2) AS g_agent_terminality, (SELECT sum(n) = 0 FROM missing WHERE asks = 'gate') AS g_auditability""",
    "replay_scores": f"WITH {SAMPLES_SQL} SELECT {', '.join(f'round(avg({s}), 5) AS {s}' for s in triage.SCORES)} FROM judged",
    "store_row_ids": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR AS _rowid FROM orders",
    "hamming_bytes_sql": f"SELECT o_orderkey, ({BITS} - bit_count(xor(o_orderkey, o_custkey) & {(1 << BITS) - 1}))::DOUBLE AS score FROM orders",
    "rotated_codes": f"SELECT vec_id, list_sum(list_transform(range(1, {BITS + 1}), lambda i: CASE WHEN embedding[{BITS + 1} - i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END))::BIGINT AS word FROM embeddings",
    "reflected_codes": f"""WITH s AS (SELECT vec_id, embedding, list_sum(list_transform(range(1, {BITS + 1}), lambda i: i * embedding[i]::DOUBLE)) AS along FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(1, {BITS + 1}), lambda i: CASE WHEN embedding[i]::DOUBLE - 2.0::DOUBLE * i * along / {sum((i + 1) ** 2 for i in range(BITS))} > 0 THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END))::BIGINT AS word FROM s""",
    "replay_decisions": f"WITH {SAMPLES_SQL} SELECT action, disposition, count(*) AS n FROM decided GROUP BY ALL",
    "store_upsert": """WITH w AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 10 THEN l_extendedprice END AS price, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS brand FROM lineitem
  UNION ALL SELECT p_partkey, -1, p_retailprice, p_brand FROM part)
SELECT id, max(seq) AS seq, arg_max(price, seq) FILTER (price IS NOT NULL) AS price, arg_max(brand, seq) FILTER (brand IS NOT NULL) AS brand FROM w GROUP BY id""",
    "store_fetch": "WITH d AS (SELECT vec_id // 5 AS doc_id, arg_min(label, vec_id) AS label, count(*)::INT AS tokens FROM embeddings GROUP BY ALL) SELECT * FROM d WHERE doc_id IN (SELECT o_orderkey % 97 FROM orders)",
    "evidence_attach": f"WITH {_BM25} SELECT query_id, (rank - 1)::INT AS pos, h.doc_id::VARCHAR AS alert_id, round(score, 6) AS score, 'bm25' AS stage, md5(text) AS text_md5 FROM ({_top('found', 3, 'score > 0')}) h JOIN documents d ON d.doc_id = h.doc_id",
} | {f"filter_{name}": f"WITH {MV}, {ALL_HAMMING} SELECT query_id, doc_id, score, rank::INT AS rank FROM ({_top('pairs', K, sql)})" for name, (_, sql) in FILTERS.items()}

ORACLE_SQL |= {"audit_variant": ORACLE_SQL["audit_and_gates"], "hamming_topk_sql": ORACLE_SQL["hamming_topk_batch"], "hamming_topk_sql_filtered": ORACLE_SQL["filter_in"]}
ORACLE_SQL |= {name: ORACLE_SQL["store_upsert"] for name in ("store_versioned", "store_compacted")}
ORACLE_SQL["standing_orders"] = f"""WITH pairs AS (SELECT r_regionkey::VARCHAR AS query_id, o_orderkey::VARCHAR AS doc_id, ({BITS} - bit_count(xor(({_ASKED})::BIGINT, ({_STREAMED})::BIGINT) & {(1 << BITS) - 1}))::DOUBLE AS score FROM region, orders)
SELECT query_id, doc_id, score, rank::INT AS rank FROM ({_top('pairs')})"""
ORACLE_SQL["store_clustered_fetch"] = "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, codes, a typed filter, binary candidates and an exact rerank, for a batch of queries."""
    docs = encoded(spark, sf_dir)
    return retrieval.binary_then_cosine(asked(docs), docs, K, PREFILTER, Filter((Clause("label", "gte", 1),)))


