"""The operators as registered queries over the whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import align, chunks, decontaminate, html_text, langid, minhash, mixing, quality, repair, rules, tokens, url_filter, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), shingle_words=2)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id
  WHERE x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN named c USING (doc_id) LEFT JOIN sized s USING (doc_id)
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(column: str, parts: int):
    """The remainder of the CRC of an id as text."""
    return F.crc32(F.col(column).cast("string")) % parts


def held_out(column: str, parts: int, remainder: int):
    """Whether an id is in a fold; a null id is in none."""
    return F.coalesce(fold(column, parts) == remainder, F.lit(False)).alias("held_out")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs, fold("doc_id", 4) != 2))
    return found.select(F.col("doc").alias("doc_id"), held_out("doc", 4, 2), "lang_pred", "score", "entropy", "rejected")


#: Whole weights by level and child; other children weigh 1. Three fifths of all tokens are taken, in two epochs at most.
MIX = {"weights": {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}, "budget": (3, 5), "max_epochs": 2, "seed": 7}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), **MIX).drop("text_md5")


def _op5_level(depth: int, weight: str) -> str:
    """Common table expressions that hand a level's budgets down. A child is full where the level of water that fills it
    takes no more than the parent's budget from all siblings together."""
    keys = ["domain", "lang", "source"][: depth + 1]
    up, name, by = keys[:-1], keys[-1], ", ".join(keys)
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    siblings = " AND ".join(f"a.{k} = b.{k}" for k in up) or "true"
    source = f"supply s JOIN given{depth - 1} g USING ({', '.join(up)})" if depth else "supply s"
    budget = "any_value(g.given)" if depth else "any_value((SELECT least(wanted, most) FROM total))"
    return f"""
children{depth} AS (SELECT {by}, sum(s.supply)::HUGEINT AS supply, ({weight})::HUGEINT AS weight, {budget}::HUGEINT AS budget FROM {source} GROUP BY {by}),
filled{depth} AS (SELECT {", ".join(f"a.{k}" for k in keys)}, a.supply, a.weight, a.budget, sum(least(b.supply * a.weight, a.supply * b.weight)) AS needed
  FROM children{depth} a JOIN children{depth} b ON {siblings} GROUP BY ALL),
judged{depth} AS (SELECT *, needed <= budget * weight AS is_full FROM filled{depth}),
open{depth} AS (SELECT *, budget - coalesce(sum(supply) FILTER (is_full) OVER w, 0) AS water, sum(weight) FILTER (NOT is_full) OVER w AS weights, row_number() OVER (PARTITION BY {", ".join([*up, "is_full"])} ORDER BY {name}) AS turn FROM judged{depth} WINDOW w AS ({part})),
given{depth} AS (SELECT {by}, (CASE WHEN is_full THEN supply ELSE water * weight // weights + CASE WHEN turn <= water - sum(water * weight // weights) FILTER (NOT is_full) OVER w THEN 1 ELSE 0 END END)::BIGINT AS given FROM open{depth} WINDOW w AS ({part}))"""


OP5_SQL = (
    r"""
WITH rows_ AS (
  SELECT doc_id, left(coalesce(source, ''), 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens, md5(coalesce(text, '')) AS text_md5
  FROM documents
), supply AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (2 * sum(tokens))::BIGINT AS supply FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT (sum(tokens) * 3) // 5 AS wanted, sum(supply) AS most FROM supply),"""
    + ",".join([_op5_level(0, "1"), _op5_level(1, "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END"), _op5_level(2, "1")])
    + """,
plan AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS rest FROM supply JOIN given2 USING (domain, lang, source) WHERE given > 0),
runs AS (
  SELECT r.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '') || ':' || text_md5) ROWS UNBOUNDED PRECEDING) AS run
  FROM rows_ r JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, unnest(range(1, whole + 1))::BIGINT AS epoch FROM runs
UNION ALL
SELECT doc_id, domain, lang, source, tokens::BIGINT, (whole + 1)::BIGINT FROM runs WHERE rest > 0 AND run <= rest
"""
)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), ranked AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wavelet.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc", 3) != 1)
    return found.select(F.col("doc").alias("doc_id"), held_out("doc", 3, 1), "score", "predicted")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates learn from labels.quality: the first number in a path is the id of the document that the page shows."""
    _, path = url_filter.split_url(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(path, "[0-9]{1,18}", 0).try_cast("bigint").alias("shown"))
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy(F.col("doc_id").alias("shown")).agg((F.max("quality") == 0).alias("is_bad"))
    return url_filter.judge(pages.join(labels, "shown", "left"), rules=URL_RULES, bad=F.col("is_bad")).drop("badness")


def _op9_level(k: int) -> str:
    return f"""
child{k} AS MATERIALIZED (SELECT host, node, s[{k + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, any_value(purity) AS purity FROM tree{k} WHERE len(s) > {k} GROUP BY ALL),
named{k} AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER w > 16 AND n < 0.05::DOUBLE * sum(n) OVER w THEN '/*' ELSE segment END AS token FROM child{k} WINDOW w AS (PARTITION BY host, node)),
sums{k} AS (SELECT host, node, token, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad, any_value(purity) AS purity FROM named{k} GROUP BY ALL),
tested{k} AS (SELECT *, bad * sum(labelled) OVER w - sum(bad) OVER w * labelled AS apart, 3.841459::DOUBLE * labelled * sum(bad) OVER w * (sum(labelled) OVER w - sum(bad) OVER w) AS chance FROM sums{k} WINDOW w AS (PARTITION BY host, node)),
found{k} AS (SELECT *, CASE WHEN labelled < 5 THEN '/' || token WHEN apart * apart <= chance THEN '=' WHEN apart > 0 THEN '+' ELSE '-' END AS finding FROM tested{k}),
branch{k} AS MATERIALIZED (SELECT host, node, token, min(token) OVER g || CASE WHEN count(*) OVER g > 1 THEN '/+' ELSE '' END AS name, (sum(bad) OVER g + 4.0::DOUBLE * purity) / (sum(labelled) OVER g + 4.0::DOUBLE) AS purity FROM found{k} WINDOW g AS (PARTITION BY host, node, finding)),
tree{k + 1} AS MATERIALIZED (SELECT t.host, t.s, t.n, t.labelled, t.bad, CASE WHEN b.name IS NULL THEN t.node ELSE t.node || '/' || b.name END AS node, coalesce(b.purity, t.purity) AS purity
  FROM tree{k} t LEFT JOIN named{k} c ON c.host = t.host AND c.node = t.node AND c.segment = t.s[{k + 1}] LEFT JOIN branch{k} b ON b.host = c.host AND b.node = c.node AND b.token = c.token),"""


OP9_SQL = (
    r"""
WITH split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM split),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
good AS (SELECT doc_id, max(quality) = 0 AS is_bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
segments AS (SELECT p.*, is_bad, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS all_s
  FROM parts p LEFT JOIN good g ON g.doc_id = try_cast(regexp_extract(path, '[0-9]{1,18}') AS BIGINT)),
rows_ AS MATERIALIZED (SELECT page_id, host, path, is_bad, CASE WHEN len(all_s) > 8 THEN list_append(all_s[1:7], array_to_string(all_s[8:], '/')) ELSE all_s END AS s FROM segments),
counted AS MATERIALIZED (SELECT host, s, count(*) AS n, count(is_bad) AS labelled, count(*) FILTER (is_bad) AS bad FROM rows_ GROUP BY ALL),
prior AS (SELECT least((coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 10.0::DOUBLE), 0.25::DOUBLE) AS p FROM counted),
tree0 AS MATERIALIZED (SELECT *, '' AS node, (sum(bad) OVER w + 4.0::DOUBLE * (SELECT p FROM prior)) / (sum(labelled) OVER w + 4.0::DOUBLE) AS purity FROM counted WINDOW w AS (PARTITION BY host)),"""
    + "".join(_op9_level(k) for k in range(url_filter.DEPTH))
    + f"""
ruled AS (SELECT rows_.*, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM rows_)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, r.host || node AS template
FROM ruled r JOIN tree{url_filter.DEPTH} t ON t.host = r.host AND t.s = r.s
"""
)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


#: CRC-32 by bits; edits one row after the other, the best for each initial that the last row can have.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(key, lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier FROM placed
), convs AS (SELECT DISTINCT conv_id FROM conversations),
summed AS (
  SELECT c.conv_id, count(f.pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM convs c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), ins(before_, after_, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
act(letter, initial, before_, after_, cost) AS (
  VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)
  UNION ALL SELECT 'R', i, before_, after_, 1 FROM (VALUES ('s'), ('u'), ('a'), ('o')) i(i), (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) t(before_, after_)
  UNION ALL SELECT 'D', i, before_, before_, 2 FROM (VALUES ('s'), ('u'), ('a'), ('o')) i(i), range(4) t(before_)
), dp AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM convs
  UNION ALL
  SELECT conv_id, pos, state, cost, audit FROM (
    SELECT d.conv_id, f.pos, act.after_ AS state, d.cost + ins.cost + act.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END AS cost, d.audit || ins.letters || letter AS audit,
      row_number() OVER (PARTITION BY d.conv_id, act.after_ ORDER BY d.cost + ins.cost + act.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END, d.audit || ins.letters || letter) AS turn
    FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1 JOIN ins ON ins.before_ = d.state JOIN act ON act.before_ = ins.after_ AND act.initial = f.initial
    WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate')) WHERE turn = 1
), ends AS (
  SELECT s.*, d.cost + ins.cost AS cost, d.audit || ins.letters AS audit, row_number() OVER (PARTITION BY s.conv_id ORDER BY d.cost + ins.cost, d.audit || ins.letters) AS turn
  FROM summed s JOIN dp d ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND d.pos = s.n JOIN ins ON ins.before_ = d.state AND ins.after_ IN (0, 3)
), best AS (SELECT * EXCLUDE (turn) FROM ends WHERE turn = 1),
letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS i, audit FROM best),
edits AS (SELECT conv_id, i, audit[i] AS edit, length(replace(audit[1:i], 'I', '')) AS pos, length(replace(audit[1:i], 'D', '')) AS place_ FROM letters WHERE audit[i] <> 'D'),
rows_ AS (
  SELECT e.*, f.role, f.text, max(CASE WHEN place_ = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos AND e.edit <> 'I'
), texts AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (place_ - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired FROM rows_ GROUP BY conv_id
)
SELECT b.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256 FROM best b LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("doc", "doc_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sides = ("tokenizers", tokenizer_path()), ("sentencepiece", public_tokenizers.path("piece_bpe_32k.model"))
    return align.Alignment(table(spark, sf_dir, "documents"), *sides).scores().withColumnRenamed("doc", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_html_text": op10_html_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
}
