"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import chunks, messages, notes, retrieval
from ..sources.tables import table
from ..streaming.ingest import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BLANK = T.BLANKS
TALK = "(SELECT * FROM conversations WHERE role <> 'system')"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _wide(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{T.WIDE}', '', 'g')))"


def _est(x: str) -> str:
    return f"({_wide(x)} + ceil((length({x}) - {_wide(x)}) / 4.0)::BIGINT)"


def _any(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, m.replace("'", "''")) for m in marks) + ")"


def _fnv(x: str) -> str:
    octets = f"list_transform(range(1, 2 * strlen({x}) + 1, 2), lambda i: ('0x' || substr(hex(encode({x})), i, 2))::INT::HUGEINT)"
    return f"list_reduce(list_concat([14695981039346656037::HUGEINT], {octets}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


def _hash(x: str) -> str:
    return f"lower(printf('%016x', ({_fnv(x)})::UBIGINT))"


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}_]+')"
COMPOUND = r"list_filter(list_distinct(flatten(list_transform(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}_./-]+'), lambda u: lower(regexp_replace(u, '^[_./-]+|[_./-]+$', '', 'g'))), lambda u: list_concat([u], string_split_regex(u, '[_./-]+'))))), lambda x: x <> '')"
#: The same with repeats, in the order of the text.
EVERY = COMPOUND.replace("list_distinct(", "(", 1)
FOLDED = r"list_transform(regexp_extract_all(strip_accents({}), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"


# Messages


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system' ELSE 'conversation' END AS tier FROM conversations")
def p1_role_split(spark: SparkSession, sf: str) -> DataFrame:
    return messages.tiers(table(spark, sf, "conversations")).select("conv_id", "turn", "tier")


@query(f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM {TALK} WHERE coalesce({_trim('text')}, '') <> ''")
def p2_w4_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return messages.numbered(table(spark, sf, "conversations")).select("conv_id", "turn", "pos")


@query("SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS query FROM conversations GROUP BY conv_id")
def p3_last_query(spark: SparkSession, sf: str) -> DataFrame:
    return messages.last_query(table(spark, sf, "conversations"))


@query(f"SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE role <> 'system' AND coalesce({_trim('text')}, '') <> '' AND (last IS NULL OR turn <> last)")
def p4_extraction_middle(spark: SparkSession, sf: str) -> DataFrame:
    return messages.extraction_middle(table(spark, sf, "conversations")).select("conv_id", "turn")


@query(f"""
WITH s AS (SELECT conv_id, count(*) AS n_messages, sum({_est("coalesce(text, '')")})::BIGINT AS total, sum(CASE WHEN coalesce({_trim('text')}, '') = '' THEN 0 ELSE {_est("text")} END)::BIGINT AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, n_messages, total, 128 + 4 * n_messages + c AS prompt_tokens, total > 600 AS over, NOT total > 600 AND total > 150 AS warm FROM s""")
def p6_p7_a2_gates(spark: SparkSession, sf: str) -> DataFrame:
    return messages.gates(table(spark, sf, "conversations"), n_ctx=600)


INDEXED = f"""
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, {_est("coalesce(text, '')")} AS tok FROM {TALK}),
r AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i DESC) AS suffix, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
  sum(tok) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(max(CASE WHEN role <> 'tool' THEN i END) OVER (PARTITION BY conv_id ORDER BY i), 0) AS snap FROM m)"""


@query(INDEXED + """, c AS (SELECT conv_id, coalesce(min(CASE WHEN suffix <= 200 THEN i END), max(i)) AS i FROM r GROUP BY conv_id)
SELECT r.conv_id, snap::BIGINT AS cut FROM r JOIN c USING (conv_id, i)""")
def w1_w2_sliding_tail(spark: SparkSession, sf: str) -> DataFrame:
    return messages.sliding_tail(table(spark, sf, "conversations"), budget=200)


@query(INDEXED + """, k AS (SELECT DISTINCT conv_id, total, n, unnest(range(1, (total // 100)::BIGINT + 3)) AS k FROM r),
ik AS (SELECT k.conv_id, k.total, k.n, k.k, count(r.i) AS i FROM k LEFT JOIN r ON r.conv_id = k.conv_id AND r.pre < k.k * 100 GROUP BY ALL),
c AS (SELECT ik.*, max(r.snap) OVER (PARTITION BY ik.conv_id ORDER BY ik.k) AS cut FROM ik JOIN r ON r.conv_id = ik.conv_id AND r.i = least(ik.i, ik.n - 1)),
s AS (SELECT c.* FROM c JOIN r ON r.conv_id = c.conv_id AND r.i = c.cut WHERE c.total - r.pre <= 200 OR c.i = c.n)
SELECT conv_id, CASE WHEN max(total) <= 200 THEN 0 ELSE min_by(cut, k) END::BIGINT AS cut FROM s GROUP BY conv_id""")
def w3_stepped_tail(spark: SparkSession, sf: str) -> DataFrame:
    return messages.stepped_tail(table(spark, sf, "conversations"), budget=200, step=100)


NTH = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)"


@query(f"SELECT conv_id, turn, CASE WHEN nth > 1 AND role = 'system' THEN 'user' ELSE role END AS role, md5(CASE WHEN nth > 1 AND role = 'system' THEN '[system-note]' || chr(10) || coalesce(text, '') ELSE text END) AS text_md5 FROM {NTH}")
def f21_convert(spark: SparkSession, sf: str) -> DataFrame:
    return messages.convert_notes(table(spark, sf, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


SYSTEM = "s AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id), rest AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, text FROM conversations WHERE role <> 'system')"


@query(f"WITH {SYSTEM} SELECT conv_id, pos, role, md5(text) AS text_md5 FROM (SELECT conv_id, 0 AS pos, 'system' AS role, system AS text FROM s UNION ALL SELECT * FROM rest)")
def f22_hoist(spark: SparkSession, sf: str) -> DataFrame:
    return messages.hoist(table(spark, sf, "conversations")).select("conv_id", "pos", "role", F.md5("text").alias("text_md5"))


@query(f"""WITH {SYSTEM}, u AS (SELECT conv_id, min(pos) AS first FROM rest WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, pos, role, md5(text) AS text_md5 FROM (
  SELECT rest.conv_id, pos, role, CASE WHEN pos = first AND system IS NOT NULL THEN system || chr(10) || chr(10) || coalesce(text, '') ELSE text END AS text FROM rest LEFT JOIN u USING (conv_id) LEFT JOIN s USING (conv_id)
  UNION ALL SELECT s.conv_id, 0, 'user', system FROM s WHERE conv_id NOT IN (SELECT conv_id FROM u))""")
def f23_merge_into_user(spark: SparkSession, sf: str) -> DataFrame:
    return messages.merge_into_user(table(spark, sf, "conversations")).select("conv_id", "pos", "role", F.md5("text").alias("text_md5"))


# Rules


@query(f"""SELECT conv_id, turn, CASE WHEN {_any('lower(text)', [p.strip() for p in rules.GLOBAL_PATTERNS.split('|')])} THEN 'exhaustive' ELSE 'targeted' END AS route,
coalesce({_trim('text')}, '') <> '' AND NOT regexp_matches(text, '[A-Za-z]') AS blind,
octet_length(encode(lower({_trim('text')}))) < 2 OR {_any('lower(text)', rules.REFUSALS)} AS incomplete, {_any('lower(text)', rules.CALL_MARKS)} AS leaked FROM conversations WHERE text IS NOT NULL""")
def p10_p13_p14_p15_rules(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return rows.select("conv_id", "turn", rules.keyword_route(text).alias("route"), rules.is_blind(text).alias("blind"), rules.looks_incomplete(text).alias("incomplete"), rules.looks_like_call(text).alias("leaked"))


ROUTES = [(1, "How many ports?", "", "keyword", None), (2, "Which port?", "Exhaustive ", "keyword", None), (3, "Which port?", "auto", "classifier", "GLOBAL or lookup"), (4, "count it", "", "classifier", "a needle"), (5, "count it", "", "classifier", "?"), (6, "集計", "", "keyword", "global")]


@query("SELECT * FROM (VALUES (1, 'exhaustive', NULL), (2, 'exhaustive', NULL), (3, 'exhaustive', 'exhaustive'), (4, 'targeted', 'targeted'), (5, 'exhaustive', NULL), (6, 'targeted', 'exhaustive')) t(id, route, verdict)")
def p11_p12_route(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(ROUTES, "id int, q string, o string, m string, r string")
    return rows.select("id", rules.route(F.col("q"), F.col("o"), F.col("m"), F.col("r")).alias("route"), rules.verdict(F.col("r")).alias("verdict"))


ANSWERS = [(1, "", True), (2, "It is not specified.", False), (3, "<tool_call>{}", True), (4, "<function=x>", False), (5, "Port 8080.", True), (6, "It cannot be determined", True)]


@query("SELECT * FROM (VALUES (1, 'escalate'), (2, 'answer'), (3, 'escalate'), (4, 'no_fallback'), (5, 'answer'), (6, 'escalate')) t(id, decision)")
def p16_decision(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "id int, a string, e boolean").select("id", rules.decision(F.col("a"), F.col("e")).alias("decision"))


# Text functions


@query(f"SELECT conv_id, turn, {_hash('text')} AS content_hash FROM conversations WHERE text IS NOT NULL")
def f1_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", T.content_hash("text").alias("content_hash"))


@query(f"""SELECT doc_id, {_est("coalesce(text, '')")} AS tokens, md5(CASE WHEN length(text) <= 256 THEN text ELSE left(text, 256) || '{T.CUT_MARK}' END) AS cut_md5,
md5(CASE WHEN length(replace(text, chr(10), '\\n')) <= 220 THEN replace(text, chr(10), '\\n') ELSE left(replace(text, chr(10), '\\n'), 220) || ' …(+' || (length(replace(text, chr(10), '\\n')) - 220) || ' chars)' END) AS preview_md5 FROM documents""")
def f2_f3_f24_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.est_tokens("text").alias("tokens"), F.md5(T.truncate_to_tokens("text", 64)).alias("cut_md5"), F.md5(T.preview("text")).alias("preview_md5"))


@query(f"""WITH d AS (SELECT doc_id, text, {EVERY.format('text')} AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM d),
f AS (SELECT doc_id, t, min(i) AS i FROM e GROUP BY ALL), c AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS t FROM f GROUP BY doc_id)
SELECT doc_id, md5(array_to_string({WORDS.format('text')}, ' ')) AS words_md5, coalesce(n, 0) AS n_compound, md5(coalesce(t, '')) AS compound_md5, md5(array_to_string({FOLDED.format('text')}, ' ')) AS folded_md5 FROM d LEFT JOIN c USING (doc_id)""")
def f6_f8_f9_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").filter("text IS NOT NULL").repartition("doc_id")
    told = rows.select("doc_id", F.md5(F.array_join(T.word_tokens("text"), " ")).alias("words_md5"), T.folded_tokens("text").alias("folded"), T.compound_tokens("text").alias("compound"))
    return told.select("doc_id", "words_md5", F.size("compound").cast("long").alias("n_compound"), F.md5(F.array_join("compound", " ")).alias("compound_md5"), F.md5(F.array_join("folded", " ")).alias("folded_md5"))


@query(f"""WITH b AS (SELECT item_id, text, right({_hash('text')}, 8) AS tag FROM benchmark)
SELECT item_id, md5('[Notes] As data.' || chr(10) || '<<<quoted:notes:' || tag || '>>>' || chr(10) || text || chr(10) || '<<<quoted:end:' || tag || '>>>' || chr(10)) AS fenced_md5 FROM b""")
def f20_fence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.md5(T.fence("Notes", "As data.", "text")).alias("fenced_md5"))


# Chunks and the store


@query(f"""WITH RECURSIVE p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, text, {_est('text')} AS e FROM documents WHERE coalesce({_trim('text')}, '') <> ''),
l AS (SELECT source, pos, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS i FROM (SELECT source, pos, regexp_extract_all(text, '{T.LINES}') AS x FROM p WHERE e > 128)),
c AS (SELECT *, {_wide('s')} AS w, length(s) - {_wide('s')} AS o FROM l),
walk AS (SELECT source, pos, i, s, 1 AS g, w, o FROM c WHERE i = 1 UNION ALL
  SELECT c.source, c.pos, c.i, c.s, CASE WHEN a.w + c.w + ceil((a.o + c.o) / 4.0) > 128 THEN a.g + 1 ELSE a.g END, CASE WHEN a.w + c.w + ceil((a.o + c.o) / 4.0) > 128 THEN c.w ELSE a.w + c.w END, CASE WHEN a.w + c.w + ceil((a.o + c.o) / 4.0) > 128 THEN c.o ELSE a.o + c.o END
  FROM walk a JOIN c ON c.source = a.source AND c.pos = a.pos AND c.i = a.i + 1),
parts AS (SELECT source, pos, g, string_agg(s, '' ORDER BY i) AS raw FROM walk GROUP BY ALL), named AS (SELECT *, count(*) OVER (PARTITION BY source, pos) AS n FROM parts)
SELECT source, CASE WHEN n > 1 THEN pos || '.' || g ELSE pos::VARCHAR END AS positional_id, md5(raw) AS raw_md5 FROM named UNION ALL SELECT source, pos::VARCHAR, md5(text) FROM p WHERE e <= 128""")
def f15_f16_split(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunks.split_texts(table(spark, sf, "documents"), 128, "source", "doc_id")
    return cut.select("source", "positional_id", F.md5("raw").alias("raw_md5"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return rows.select((F.col("conv_id") * 10000 + F.col("turn")).alias("seq"), F.col("text").alias("raw"), F.when(F.col("turn") % 3 > 0, F.col("turn") * 100000).alias("wall_ts"))


STORE = f"""WITH calls AS (SELECT conv_id * 10000 + turn AS seq, text AS raw, CASE WHEN turn % 3 > 0 THEN turn * 100000 END AS wall_ts FROM conversations WHERE text IS NOT NULL),
store AS (SELECT {_hash('raw')} AS content_hash, min(seq) AS ts, count(*) - 1 AS hits, max(seq) AS last_used, min(wall_ts) AS wall_ts FROM calls GROUP BY raw)"""


@query(STORE + " SELECT * FROM store")
def a8_st1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.upsert(_calls(spark, sf)).select("content_hash", "ts", "hits", "last_used", "wall_ts")


@query(STORE + " SELECT content_hash, ts, hits, last_used FROM store")
def st1_merge(spark: SparkSession, sf: str) -> DataFrame:
    calls = _calls(spark, sf)
    cut = calls.agg(F.max("seq").alias("m"))
    both = calls.crossJoin(F.broadcast(cut))
    old, new = both.filter("seq <= m div 2").drop("m"), both.filter("seq > m div 2").drop("m")
    return chunks.merge(chunks.upsert(old), new).select("content_hash", "ts", "hits", "last_used")


@query(STORE + """, c AS (SELECT max(greatest(ts, last_used)) AS clock, count(*) AS n FROM store),
v AS (SELECT content_hash FROM store, c WHERE last_used < clock - 5000 QUALIFY row_number() OVER (ORDER BY last_used, content_hash) <= greatest(0, n - 100))
SELECT content_hash, last_used FROM store WHERE content_hash NOT IN (SELECT content_hash FROM v)""")
def st2_o3_evict(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.evict(chunks.upsert(_calls(spark, sf)), target=100, guard=5000).select("content_hash", "last_used")


@query(STORE + " SELECT content_hash, wall_ts FROM store WHERE wall_ts IS NULL OR wall_ts >= 1000000 - 5 * 86400")
def st3_expire(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.expire(chunks.upsert(_calls(spark, sf)), days=5, now=1_000_000).select("content_hash", "wall_ts")


# Retrieval


NEAR = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(least(1.0, greatest(0.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q JOIN embeddings v ON {} WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows


@query(NEAR.format("q.label = v.label"))
def o1_j3_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.nearest(*_vectors(spark, sf), 10, scope="label")


@query(NEAR.format("true"))
def o2_j5_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.nearest(*_vectors(spark, sf), 10)


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("raw"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""WITH t AS (SELECT doc_id, unnest({FOLDED.format('text')}) AS term FROM documents), f AS (SELECT term, doc_id FROM t GROUP BY ALL)
SELECT term, count(*) AS df, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS chunks_md5 FROM f GROUP BY term""")
def a3_a4_postings(spark: SparkSession, sf: str) -> DataFrame:
    # The list is asked for as such: it is as long as the term's document frequency.
    found = retrieval.postings(retrieval.term_counts(_corpus(spark, sf), T.folded_tokens("raw")))
    return found.select("term", "df", F.md5(F.array_join(F.col("chunks").cast("array<string>"), ",")).alias("chunks_md5"))


@query(f"""WITH d AS (SELECT doc_id AS idx, {FOLDED.format("coalesce(text, '')")} AS t FROM documents), size AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({FOLDED.format('text')}) AS term FROM benchmark), w AS (SELECT idx, len(t) AS l, unnest(t) AS term FROM d), c AS (SELECT idx, term, count(*) AS f, any_value(l) AS l FROM w GROUP BY idx, term),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT query_id, idx, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM c JOIN df USING (term) JOIN q USING (term), size GROUP BY query_id, idx)
SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def a7_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(_corpus(spark, sf), _questions(spark, sf), 10)


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest({COMPOUND.format('text')}) AS term FROM benchmark), qu AS (SELECT * FROM q WHERE strlen(term) >= 2 AND term NOT IN ({STOP})),
h AS (SELECT doc_id AS idx, unnest({COMPOUND.format('text')}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT query_id, idx, round(sum(ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score FROM h JOIN df USING (term) JOIN qu USING (term) GROUP BY query_id, idx)
SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM s QUALIFY rank <= 10""")
def a6_j7_rare_words(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rare_word_scores(_corpus(spark, sf), _questions(spark, sf), 10)


@query("""WITH l AS (SELECT doc_id AS idx, unnest(x) AS line, unnest(range(len(x))) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents)),
h AS (SELECT *, contains(lower(line), 'licensed') OR contains(lower(line), 'copyright') AS hit FROM l), k AS (SELECT *, hit OR coalesce(lag(hit) OVER (PARTITION BY idx ORDER BY line_no), false) AS keep FROM h)
SELECT idx, line_no, md5(line) AS line_md5, coalesce(line_no - lag(line_no) OVER (PARTITION BY idx ORDER BY line_no) > 1, false) AS gap FROM k WHERE keep""")
def w5_matching_lines(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.matching_lines(_corpus(spark, sf), ["licensed", "copyright"]).select("idx", "line_no", F.md5("line").alias("line_md5"), "gap")


@query(f"""WITH t AS (SELECT DISTINCT conv_id * 1000 + turn AS idx, unnest({COMPOUND.format('text')}) AS term FROM conversations), r AS (SELECT term FROM t GROUP BY term HAVING count(*) BETWEEN 2 AND 4), l AS (SELECT t.* FROM t JOIN r USING (term)),
d0 AS (SELECT idx FROM t WHERE idx % 100 = 0 GROUP BY idx), d1 AS (SELECT DISTINCT b.idx FROM d0 JOIN l a USING (idx) JOIN l b USING (term) WHERE b.idx NOT IN (SELECT idx FROM d0)),
d2 AS (SELECT DISTINCT b.idx FROM d1 JOIN l a USING (idx) JOIN l b USING (term) WHERE b.idx NOT IN (SELECT idx FROM d0 UNION ALL SELECT idx FROM d1))
SELECT idx, 0 AS depth FROM d0 UNION ALL SELECT idx, 1 FROM d1 UNION ALL SELECT idx, 2 FROM d2""")
def g1_j8_follow_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.explode(T.compound_tokens("text")).alias("term")).distinct()
    return retrieval.follow_terms(rows, rows.select("idx").filter("idx % 100 = 0").distinct(), max_df=4, hops=2)


# Notes, pools, counters


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS hot, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6 AS in_window, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch FROM conversations""")
def w8_w9_w11_pools(spark: SparkSession, sf: str) -> DataFrame:
    return notes.pools(table(spark, sf, "conversations"), "conv_id", "turn", hot=3, cap=6, batch=4)


@query("""WITH m AS (SELECT conv_id, turn, least(1500, sum(length(coalesce(text, '')) * 1000 // 400) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS s FROM conversations)
SELECT conv_id, turn, s - coalesce(lag(s) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS delay_ms FROM m""")
def w6_pace(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("piece"))
    return notes.pace(rows, "conv_id", "turn", 400, 1500).select("conv_id", "turn", "delay_ms")


NOTE_ROWS = f"""WITH h AS (SELECT conv_id AS group_id, turn, '[chunk ' || turn || '] ' || text || chr(10) || '---' || chr(10) AS line FROM conversations WHERE coalesce({_trim('text')}, '') <> ''),
r AS (SELECT *, sum({_wide('line')}) OVER w AS w, sum(length(line)) OVER w AS c, row_number() OVER w AS nth FROM h WINDOW w AS (PARTITION BY group_id ORDER BY turn))
SELECT group_id, md5(string_agg(line, '' ORDER BY turn)) AS notes_md5 FROM r WHERE nth = 1 OR w + ceil((c - w) / 4.0) <= 100 GROUP BY group_id"""


@query(NOTE_ROWS)
def f25_w7_seed_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("rank"), F.col("turn").cast("string").alias("positional_id"), F.col("text").alias("summary"), F.lit(1.0).alias("score"))
    return notes.seed_notes(rows, 100).select("group_id", F.md5("notes").alias("notes_md5"))


@query(f"""SELECT conv_id AS group_id, md5(coalesce(string_agg('[chunk ' || turn || '] ' || {_trim('text')}, chr(10) || '---' || chr(10) ORDER BY turn) FILTER (coalesce({_trim('text')}, '') NOT IN ('', 'none')), '{notes.NOTHING}')) AS notes_md5 FROM conversations GROUP BY conv_id""")
def f26_build_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("rank"), F.col("turn").cast("string").alias("positional_id"), F.col("text").alias("summary"))
    return notes.build_notes(rows).select("group_id", F.md5("notes").alias("notes_md5"))


@query("SELECT split_part(event_type, '.', 1) AS component, count(*) AS n FROM events GROUP BY ALL")
def a9_counters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.split_part("event_type", F.lit("."), F.lit(1)).alias("component")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def x1_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return event_counts(table(spark, sf, "events"))


@query()
def flagship_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes for each benchmark text: its best chunks by BM25, in a bounded block."""
    hits = retrieval.bm25(_corpus(spark, sf), _questions(spark, sf), 8)
    told = hits.join(_corpus(spark, sf), "idx").select(F.col("query_id").alias("group_id"), "rank", F.col("idx").cast("string").alias("positional_id"), T.truncate_to_tokens("raw", 60).alias("summary"), "score")
    return notes.seed_notes(told, 300)


from . import catalog_more  # noqa: E402, F401  registers the rest
