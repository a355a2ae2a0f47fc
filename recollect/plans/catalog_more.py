"""Further registered queries: contents, tool calls, line search, walks, the store's upkeep, and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content, rules
from ..functions import text as T
from ..operators import assemble, chunks, messages, notes, retrieval, walks
from ..sources.tables import clock, table
from .catalog import COMPOUND, FOLDED, ORACLE_SQL, QUERIES, STOP, STORE, WORDS, _any, _calls, _est, _fnv, _hash, _trim, _vectors, _wide, query  # noqa: F401

NL = "chr(10)"


# Text and content functions


@query("SELECT doc_id, md5(left(text, list_max(list_filter(range(0, 151), lambda k: strlen(left(text, k)) <= 150))::BIGINT)) AS cut_md5 FROM documents WHERE text IS NOT NULL")
def f4_truncate_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(T.truncate_to_bytes("text", 150)).alias("cut_md5"))


@query(f"""SELECT conv_id, turn, md5(CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || {NL} || '{content.IMAGE}' || {NL} || role || {NL} ELSE '' END) AS text_md5 FROM conversations WHERE text IS NOT NULL""")
def f5_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of five kinds made from the messages: a string, a list of parts, an object, a number and null."""
    said = F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("image_url").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text")), F.struct(F.lit("other").alias("type"), F.lit(None).cast("string").alias("text")))
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    made = F.when(F.col("turn") % 5 == 0, quoted).when(F.col("turn") % 5 == 1, F.to_json(said)).when(F.col("turn") % 5 == 2, F.to_json(F.struct("text"))).when(F.col("turn") % 5 == 3, "12")
    rows = table(spark, sf, "conversations").filter("text IS NOT NULL").withColumn("content", made)
    return rows.select("conv_id", "turn", F.md5(F.coalesce(content.flatten(F.col("content")), F.lit(""))).alias("text_md5"))


UPPER = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
MIXED = f"(lower(left(text, 4)) || {UPPER.format('substr(text, 5, 3)')} || replace(lower(substr(text, 8, 20)), ' ', '-') || {UPPER.format('substr(text, 28, 2)')} || lower(substr(text, 30, 8)) || '/' || left(text, 9) || ' ' || substr(text, 60, 40))"
PARTS = r"string_split_regex({}, '[./_-]+')"
CAMEL = r"string_split(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"


@query(f"""WITH u AS (SELECT conv_id, turn, unnest(x) AS u, unnest(range(len(x))) AS i FROM (SELECT conv_id, turn, regexp_extract_all({MIXED}, '[\\p{{L}}\\p{{N}}_./-]+') AS x FROM conversations WHERE text IS NOT NULL)),
p AS (SELECT conv_id, turn, i, unnest(x) AS p, unnest(range(len(x))) AS j FROM (SELECT conv_id, turn, i, list_filter({PARTS.format('u')}, lambda x: x <> '') AS x FROM u)),
w AS (SELECT conv_id, turn, i, -1 AS j, 0 AS k, u AS t FROM u UNION ALL SELECT conv_id, turn, i, j, 0, p FROM p UNION ALL SELECT conv_id, turn, i, j, unnest(range(1, len(x) + 1)), unnest(x) FROM (SELECT conv_id, turn, i, j, {CAMEL.format('p')} AS x FROM p)),
l AS (SELECT conv_id, turn, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, min((i, j, k)) AS first FROM w GROUP BY ALL)
SELECT conv_id, turn, md5(string_agg(t, ' ' ORDER BY first)) AS tokens_md5 FROM l GROUP BY ALL""")
def f7_code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("text IS NOT NULL").withColumn("mixed", F.expr(MIXED))
    return rows.select("conv_id", "turn", T.code_tokens("mixed").alias("t")).filter("size(t) > 0").select("conv_id", "turn", F.md5(F.array_join("t", " ")).alias("tokens_md5"))


CAP = 12
BLANK_CLASS = T.BLANKS
RUNS = f"regexp_extract_all(text, '{'[^' + BLANK_CLASS[1:]}*{BLANK_CLASS}|{'[^' + BLANK_CLASS[1:]}+')"
PIECES = f"""WITH RECURSIVE s AS (SELECT item_id, unnest(x) AS run, unnest(range(len(x))) AS i FROM (SELECT item_id, {RUNS} AS x FROM benchmark)),
h AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i, j) AS i, piece, hard FROM (
  SELECT item_id, i, 0 AS j, run AS piece, false AS hard FROM s WHERE length(run) <= {CAP}
  UNION ALL SELECT item_id, i, j, substr(run, j * {CAP} + 1, {CAP}), true FROM (SELECT *, unnest(range(0, (length(run) + {CAP - 1}) // {CAP})) AS j FROM s WHERE length(run) > {CAP}))),
w AS (SELECT item_id, i, piece, hard, 1 AS g, length(piece) AS n FROM h WHERE i = 1 UNION ALL
  SELECT h.item_id, h.i, h.piece, h.hard, CASE WHEN h.hard OR a.hard OR a.n + length(h.piece) > {CAP} THEN a.g + 1 ELSE a.g END, CASE WHEN h.hard OR a.hard OR a.n + length(h.piece) > {CAP} THEN length(h.piece) ELSE a.n + length(h.piece) END
  FROM w a JOIN h ON h.item_id = a.item_id AND h.i = a.i + 1),
pieces AS (SELECT item_id, g::BIGINT AS seq, string_agg(piece, '' ORDER BY i) AS piece FROM w GROUP BY ALL)"""


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    cut = table(spark, sf, "benchmark").select("item_id", F.posexplode(T.replay_pieces("text", F.lit(CAP))).alias("at", "piece"))
    return cut.select("item_id", (F.col("at") + 1).cast("long").alias("seq"), "piece")


@query(PIECES + " SELECT * FROM pieces")
def f14_replay_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


@query(PIECES + """, m AS (SELECT *, least(900, sum(length(piece) * 1000 // 100) OVER (PARTITION BY item_id ORDER BY seq))::BIGINT AS s FROM pieces),
d AS (SELECT item_id, seq, piece, s - coalesce(lag(s) OVER (PARTITION BY item_id ORDER BY seq), 0) AS delay_ms FROM m), n AS (SELECT item_id, max(seq) AS n FROM d GROUP BY ALL)
SELECT item_id, seq, 'content' AS kind, piece, delay_ms FROM d UNION ALL SELECT item_id, 0, 'role', NULL, 0 FROM n UNION ALL SELECT item_id, n + 1, 'finish', NULL, 0 FROM n UNION ALL SELECT item_id, n + 2, 'done', NULL, 0 FROM n""")
def s13_st10_frames(spark: SparkSession, sf: str) -> DataFrame:
    return notes.frames(notes.pace(_pieces(spark, sf), "item_id", "seq", 100, 900), "item_id")


TEXT_CALLS = [
    (1, 'Sure. <TOOL_CALL> {"name": "get_chunk", "arguments": {"id": "3"}} </tool_call><tool_call>{"name":"Search","arguments":"{\\"q\\":1}"}</tool_call>'),
    (2, 'x\n```json\n{"function": {"name": "search", "parameters": {"b": [1, "}"], "a": null}}}\n``` and ```{"name":"none"}```'),
    (3, 'I would {not} call {"name": "search", "arguments": {"q": "a } b"}} now'),
    (4, '<tool_call>{"name": "unknown"}</tool_call> {"name": "get_chunk"}'),
    (5, "plain prose { with braces"),
    (6, None),
]


@query("""SELECT * FROM (VALUES (1, 0, 'get_chunk', '{"id":"3"}'), (1, 1, 'Search', '{"q":1}'), (2, 0, 'search', '{"a":null,"b":[1,"}"]}'), (3, 0, 'search', '{"q":"a } b"}'), (4, 0, 'get_chunk', 'null')) t(id, nth, name, arguments)""")
def f28_text_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(TEXT_CALLS, "id int, text string")
    return rows.select("id", F.posexplode(content.text_calls(F.col("text"), ["search", "get_chunk"])).alias("nth", "call")).select("id", "nth", "call.name", "call.arguments")


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN ' Convert ' WHEN 1 THEN 'HOIST' WHEN 2 THEN 'merge-user0' WHEN 3 THEN 'auto' WHEN 4 THEN 'full' ELSE 'yes' END AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN lower(trim(v)) IN ('off', 'convert', 'hoist', 'merge-user0') THEN lower(trim(v)) ELSE 'verbatim' END AS repair, CASE v WHEN 'full' THEN 'full' WHEN 'yes' THEN 'summary' ELSE 'off' END AS level FROM c""")
def f30_parsed_settings(spark: SparkSession, sf: str) -> DataFrame:
    values = F.element_at(F.array(*map(F.lit, [" Convert ", "HOIST", "merge-user0", "auto", "full", "yes"])), (F.col("turn") % 6 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.repair(values).alias("repair"), rules.trace_level(values).alias("level"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(sqrt(list_inner_product(a, a)), 6) AS norm, 256 AS n_bytes, true AS same FROM p""")
def f29_a12_s7_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    raw = T.vector_bytes("embedding")
    return rows.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"), F.round(F.sqrt(T.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.octet_length(raw).alias("n_bytes"), (T.bytes_vector(F.concat(raw, F.lit(b"\x01"))) == F.col("embedding")).alias("same"))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS t FROM documents), h AS (SELECT t, ({_fnv('t')} % 256)::BIGINT AS bucket FROM (SELECT DISTINCT t FROM w)),
c AS (SELECT doc_id, bucket, count(*) AS n FROM w JOIN h USING (t) GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def a11_hashed_bag(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.hashed_bag(table(spark, sf, "documents"), T.word_tokens("text"), "doc_id")
    return found.select("doc_id", "bucket", F.round("value", 6).alias("value"))


# Messages, with tool calls made from conversations: even turns call a tool, odd turns are its results


LABELLED = """(SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND role <> 'system' THEN 'tool' ELSE role END AS role, text, 'c' || (turn - turn % 2) AS call,
  CASE WHEN turn % 2 = 0 THEN '[{"id":"c' || turn || '","name":"read_' || role || '"}]' END AS tool_calls FROM conversations)"""


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "conversations")
    call = F.concat(F.lit("c"), F.col("turn") - F.col("turn") % 2)
    told = rows.select("conv_id", "turn", F.when((F.col("turn") % 2 == 1) & (F.col("role") != "system"), "tool").otherwise(F.col("role")).alias("role"), "text", call.alias("tool_call_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('[{"id":"c'), "turn", F.lit('","name":"read_'), "role", F.lit('"}]'))).alias("tool_calls"))
    name = F.concat(F.lit("read_"), F.col("role"))
    calls = rows.filter("turn % 2 = 0").select("conv_id", F.col("turn").alias("seq"), F.concat(F.lit("c"), "turn").alias("id"), name.alias("name"), F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), F.substring("text", 1, 100).alias("about"))).alias("arguments"))
    return told, calls


@query(f"""WITH m AS {LABELLED}, l AS (SELECT conv_id, 'c' || turn AS call, '[read_' || role || ' ' || CASE WHEN length(a) > 200 THEN left(a, 200) || '…' ELSE a END || ']' AS label FROM (
  SELECT conv_id, turn, role, CASE WHEN text IS NULL THEN '' ELSE 'about=' || CASE WHEN length(left(text, 100)) > 80 THEN left(text, 80) || '…' ELSE text END || ' ' END || 'turn=' || turn AS a FROM conversations WHERE turn % 2 = 0))
SELECT conv_id, turn, md5(CASE WHEN role = 'tool' AND label IS NOT NULL AND coalesce({_trim('text')}, '') <> '' THEN label || {NL} || text ELSE coalesce(text, '') END) AS stored_md5 FROM m LEFT JOIN l USING (conv_id, call) WHERE role <> 'system' AND coalesce({_trim('text')}, '') <> ''""")
def p5_j1_f17_f18_stored(spark: SparkSession, sf: str) -> DataFrame:
    return notes.stored_texts(*_labelled(spark, sf)).select("conv_id", "turn", F.md5("stored").alias("stored_md5"))


@query(f"""WITH m AS {LABELLED}, k AS (SELECT conv_id, bool_or(tool_calls IS NOT NULL AND conv_id % 3 > 0) AS has_calls, bool_or(role = 'tool' AND conv_id % 5 > 0) AS has_results FROM m GROUP BY ALL)
SELECT conv_id, has_calls, has_results, CASE WHEN conv_id % 7 = 0 THEN 'extraction' WHEN conv_id % 15 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'compaction' ELSE 'extraction' END WHEN has_calls OR has_results OR conv_id % 2 = 0 THEN 'compaction' ELSE 'extraction' END AS strategy FROM k""")
def p8_p9_strategy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)[0].withColumn("tool_calls", F.when(F.col("conv_id") % 3 > 0, F.col("tool_calls")).otherwise("[]")).withColumn("role", F.when((F.col("conv_id") % 5 == 0) & (F.col("role") == "tool"), "user").otherwise(F.col("role")))
    mode = F.when(F.col("conv_id") % 7 == 0, " Extraction").otherwise("auto")
    return messages.markers(rows).withColumn("strategy", rules.strategy(mode, F.col("conv_id") % 2 == 0, F.col("has_calls"), F.col("has_results")))


@query(f"""WITH m AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN coalesce({_trim('s')}, '') = '' THEN 0 ELSE {_est('s')} END)::BIGINT AS said FROM (SELECT conv_id, coalesce(text, '') || coalesce({NL} || tool_calls, '') AS s FROM {LABELLED}) GROUP BY ALL)
SELECT conv_id, n AS n_messages, 128 + 4 * n + said + CASE WHEN conv_id % 4 = 0 THEN 0 ELSE 5 END AS prompt_tokens FROM m""")
def a2_tool_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)[0]
    return messages.prompt_tokens(rows, rows.select("conv_id", F.when(F.col("conv_id") % 4 > 0, '[{"name":"search"}]').alias("tools")).distinct())


TEMPLATE_ROWS = "(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 400 WHEN 1 THEN 401 ELSE 400 END AS status, coalesce(text, '') || CASE WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN ' Jinja: Conversation roles MUST alternate' ELSE '' END AS body FROM conversations)"


@query(f"SELECT conv_id, turn, status = 400 AND {_any('lower(body)', rules.TEMPLATE_MARKS)} AS template_error FROM {TEMPLATE_ROWS}")
def p17_template_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    status = F.when(F.col("turn") % 3 == 1, 401).otherwise(400)
    body = F.concat(F.coalesce("text", F.lit("")), F.when((F.col("turn") % 3 == 0) & (F.col("conv_id") % 2 == 0), " Jinja: Conversation roles MUST alternate").otherwise(""))
    return rows.select("conv_id", "turn", rules.is_template_error(status, body).alias("template_error"))


@query(f"SELECT conv_id, turn, NOT turn + 1 >= 4 AS offers, {_est('text')} > 512 AS long_floor, {_est('text')} > 1100 - 500 AS long FROM conversations WHERE text IS NOT NULL")
def p21_p22_turn_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return rows.select("conv_id", "turn", rules.offers_tools(F.col("turn"), 4, True).alias("offers"), rules.notes_too_long(F.col("text"), 600, 500).alias("long_floor"), rules.notes_too_long(F.col("text"), 1100, 500).alias("long"))


RUNG = """SELECT conv_id, NOT bool_or((role = 'system' AND nth > 1) OR coalesce(role = before, false)) AS fits FROM (SELECT conv_id, role, row_number() OVER w AS nth, lag(role) OVER w AS before FROM {} WINDOW w AS (PARTITION BY conv_id ORDER BY pos)) GROUP BY conv_id"""


@query(f"""WITH v AS ({RUNG.format('(SELECT conv_id, turn AS pos, role FROM conversations)')}),
c AS ({RUNG.format("(SELECT conv_id, turn AS pos, CASE WHEN role = 'system' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 'user' ELSE role END AS role FROM conversations)")}),
h AS ({RUNG.format("(SELECT conv_id, turn AS pos, role FROM conversations WHERE role <> 'system' UNION ALL SELECT DISTINCT conv_id, -1, 'system' FROM conversations WHERE role = 'system')")}),
u AS ({RUNG.format("(SELECT conv_id, turn AS pos, role FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, -1, 'user' FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system') AND NOT bool_or(role = 'user'))")})
SELECT conv_id, CASE WHEN v.fits THEN 'verbatim' WHEN c.fits THEN 'convert' WHEN h.fits THEN 'hoist' WHEN u.fits THEN 'merge-user0' ELSE 'verbatim' END AS repair, v.fits OR c.fits OR coalesce(h.fits, false) OR coalesce(u.fits, false) AS fits FROM v JOIN c USING (conv_id) LEFT JOIN h USING (conv_id) LEFT JOIN u USING (conv_id)""")
def st8_repair_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return messages.repair_ladder(table(spark, sf, "conversations"))


# Lines


KEPT = """k AS (SELECT *, hit OR coalesce(lag(hit) OVER (PARTITION BY idx ORDER BY line_no), false) AS keep FROM h),
g AS (SELECT idx, line_no, CASE WHEN coalesce(line_no - lag(line_no) OVER (PARTITION BY idx ORDER BY line_no) > 1, false) THEN '…' || chr(10) ELSE '' END || line || chr(10) AS piece FROM k WHERE keep),
b AS (SELECT *, coalesce(sum(""" + _wide("piece") + """) OVER w, 0) AS wide, coalesce(sum(length(piece)) OVER w, 0) AS chars FROM g WINDOW w AS (PARTITION BY idx ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT idx, regexp_replace(string_agg(piece, '' ORDER BY line_no), '\\s+$', '') AS found FROM b WHERE wide + ceil((chars - wide) / 4.0) <= {0} GROUP BY idx)
SELECT idx, md5(CASE WHEN length(found) <= 4 * {0} THEN found ELSE left(found, 4 * {0}) || '""" + T.CUT_MARK + """' END) AS found_md5 FROM o"""
LINES = "SELECT idx, {1}unnest(x) AS line, unnest(range(len(x))) AS line_no FROM (SELECT *, string_split(regexp_replace(raw, '\\n$', ''), chr(10)) AS x FROM {0} WHERE raw <> '')"


@query(f"WITH l AS ({LINES.format('(SELECT doc_id AS idx, text AS raw FROM documents)', '')}), h AS (SELECT *, contains(lower(line), 'licensed') OR contains(lower(line), 'copyright') AS hit FROM l), " + KEPT.replace('{0}', '60'))
def f12_grep(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.grep(table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("raw")), ["licensed", "copyright"], 60)
    return found.select("idx", F.md5("found").alias("found_md5"))


#: The benchmark text of a document's number stands for its query.
ASKED = "(SELECT doc_id AS idx, d.text AS raw, b.text AS query FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE doc_id % 10 = 0)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents").filter("doc_id % 10 = 0"), table(spark, sf, "benchmark")
    return docs.join(items.select("item_id", F.col("text").alias("query")), F.col("doc_id") % 40 == F.col("item_id")).select(F.col("doc_id").alias("idx"), F.col("text").alias("raw"), "query")


@query(f"""WITH l AS ({LINES.format(ASKED, 'query, ')}), t AS (SELECT idx, list_filter(list_distinct({WORDS.format('query')}), lambda t: strlen(t) >= 2 AND t NOT IN ({STOP})) AS terms FROM {ASKED}),
h AS (SELECT l.*, len(list_filter(terms, lambda t: contains(lower(line), t))) > 0 AS hit FROM l JOIN t USING (idx)), """ + KEPT.replace('{0}', '60'))
def f12_grep_query(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.grep_query(_asked(spark, sf), 60).select("idx", F.md5("found").alias("found_md5"))


@query(f"""WITH l AS ({LINES.format(ASKED, 'query, ')}), t AS (SELECT idx, list_filter(list_distinct({FOLDED.format('query')}), lambda t: strlen(t) >= 2 AND t NOT IN ({STOP})) AS terms FROM {ASKED}),
h AS (SELECT l.idx, line, line_no, len(list_filter({FOLDED.format('line')}, lambda w: len(list_filter(terms, lambda t: starts_with(w, t))) > 0)) > 0 AS hit FROM l JOIN t USING (idx)), """ + KEPT.replace('{0}', '60'))
def f13_grep_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.grep_prefix(_asked(spark, sf), 60).select("idx", F.md5("found").alias("found_md5"))


@query(f"""WITH l AS ({LINES.format(ASKED, 'query, ')}), h AS (SELECT idx, line_no, line FROM l WHERE list_has_any({COMPOUND.format('line')}, {COMPOUND.format('query')})), j AS (SELECT idx, string_agg(line, {NL} ORDER BY line_no) AS j FROM h GROUP BY idx)
SELECT idx, md5(left(j, list_max(list_filter(range(0, 65), lambda k: strlen(left(j, k)) <= 64))::BIGINT)) AS snippet_md5 FROM j WHERE j <> ''""")
def f11_j9_lines_matching(spark: SparkSession, sf: str) -> DataFrame:
    lines = retrieval.chunk_lines(_asked(spark, sf), "query")
    return retrieval.snippets(lines, T.compound_tokens("line"), T.compound_tokens("query"), ["idx"], 16).select("idx", F.md5("snippet").alias("snippet_md5"))


# The store


@query(STORE + " SELECT max(greatest(ts, last_used)) AS clock FROM store")
def s3_a14_clock(spark: SparkSession, sf: str) -> DataFrame:
    return clock(chunks.upsert(_calls(spark, sf)))


HALF = "(SELECT text AS raw, conv_id * 10000 + turn AS seq FROM conversations WHERE text IS NOT NULL)"
HALVES = f"""WITH c AS (SELECT raw, seq, seq <= max(seq) OVER () // 2 AS old FROM {HALF}), store AS (SELECT raw, {_hash('raw')} AS content_hash, CASE WHEN min(seq) % 2 = 0 THEN 'S:' || left(raw, 10) ELSE '' END AS summary FROM c WHERE old GROUP BY raw)"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A store of the first calls, some with a summary, and the other calls."""
    calls = _calls(spark, sf)
    both = calls.crossJoin(F.broadcast(calls.agg(F.max("seq").alias("m"))))
    store = chunks.upsert(both.filter("seq <= m div 2").drop("m"))
    told = store.filter("ts % 2 = 0").select("content_hash", F.concat(F.lit("S:"), F.substring("raw", 1, 10)).alias("summary"))
    return chunks.write_summaries(store, told), both.filter("seq > m div 2").drop("m")


@query(HALVES + " SELECT content_hash, summary FROM store")
def s5_write_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _halves(spark, sf)[0].select("content_hash", "summary")


@query(HALVES + f", n AS (SELECT seq, {_hash('raw')} AS content_hash FROM c WHERE NOT old) SELECT seq, n.content_hash, s.content_hash IS NOT NULL AS hit, s.summary FROM n LEFT JOIN store s USING (content_hash)")
def j2_lookup(spark: SparkSession, sf: str) -> DataFrame:
    store, calls = _halves(spark, sf)
    return chunks.lookup(calls.select("seq", T.content_hash("raw").alias("content_hash")), store).select("seq", "content_hash", "hit", "summary")


@query(HALVES + """, n AS (SELECT raw, count(*) AS n FROM c WHERE NOT old GROUP BY raw)
SELECT sum(CASE WHEN s.raw IS NULL THEN n - 1 ELSE n END)::BIGINT AS hits, count(*) FILTER (s.raw IS NULL) AS misses, 0::BIGINT AS hash_collisions FROM n LEFT JOIN store s USING (raw)""")
def a13_s14_call_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.call_counts(*_halves(spark, sf))


@query(HALVES + f", need AS (SELECT DISTINCT {_hash('raw')} AS content_hash FROM c WHERE NOT old) SELECT content_hash FROM need WHERE content_hash NOT IN (SELECT content_hash FROM store WHERE summary <> '')")
def st4_st5_u2_undigested(spark: SparkSession, sf: str) -> DataFrame:
    store, calls = _halves(spark, sf)
    return chunks.undigested(calls.withColumn("content_hash", T.content_hash("raw")), store).select("content_hash")


@query(HALVES + f" SELECT DISTINCT {_hash('raw')} AS content_hash FROM c WHERE NOT old INTERSECT SELECT content_hash FROM store")
def u3_known_chunks(spark: SparkSession, sf: str) -> DataFrame:
    store, calls = _halves(spark, sf)
    return calls.select(T.content_hash("raw").alias("content_hash")).intersect(store.select("content_hash"))


@query(HALVES + f", k AS (SELECT DISTINCT {_hash('raw')} AS content_hash, {_est('raw')} AS tokens FROM c WHERE NOT old AND coalesce({_trim('raw')}, '') <> '') SELECT * FROM k WHERE content_hash NOT IN (SELECT content_hash FROM store)")
def st9_token_cache(spark: SparkSession, sf: str) -> DataFrame:
    store, calls = _halves(spark, sf)
    return chunks.token_counts(calls.withColumnRenamed("raw", "text"), store, T.est_tokens("text"))


@query(STORE + """, t AS (SELECT * FROM store WHERE wall_ts IS NULL OR wall_ts >= 1000000 - 5 * 86400), c AS (SELECT max(greatest(ts, last_used)) AS clock, count(*) AS n FROM t),
v AS (SELECT content_hash FROM t, c WHERE last_used < clock - 5000 QUALIFY row_number() OVER (ORDER BY last_used, content_hash) <= greatest(0, n - 90)) SELECT content_hash FROM t WHERE content_hash NOT IN (SELECT content_hash FROM v)""")
def s15_u5_prune(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.prune(chunks.upsert(_calls(spark, sf)), cap=100, days=5, now=1_000_000, guard=5000).select("content_hash")


@query(HALVES + """, s AS (SELECT raw, max(seq) AS last_used FROM c GROUP BY raw), n AS (SELECT count(*) AS n, max(last_used) AS clock FROM s), h AS (SELECT """ + _hash("raw") + """ AS content_hash, last_used FROM s),
v AS (SELECT content_hash FROM h, n WHERE last_used < clock - 5000 AND n > 100 QUALIFY row_number() OVER (ORDER BY last_used, content_hash) <= greatest(0, n - 90)) SELECT * FROM h WHERE content_hash NOT IN (SELECT content_hash FROM v)""")
def s4_st1_capped(spark: SparkSession, sf: str) -> DataFrame:
    store, calls = _halves(spark, sf)
    return chunks.merge_capped(store, calls, cap=100, guard=5000).select("content_hash", "last_used")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 32 ELSE 64 END AS before, 64 AS after, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings WHERE vec_id % 3 < 2 UNION ALL SELECT vec_id, -1, 64, 0.0 FROM embeddings WHERE vec_id % 3 = 2")
def s6_s8_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a wrong length and missing ones are made again, here by zeros."""
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 32)).when(F.col("vec_id") % 3 == 1, F.col("embedding")))
    done = chunks.reconcile(rows.withColumn("before", F.coalesce(F.size("embedding"), F.lit(-1))), 64, F.array_repeat(F.lit(0.0).cast("float"), 64))
    return done.select("vec_id", F.when(F.col("before") < 0, -1).otherwise(F.col("before")).alias("before"), F.size("embedding").alias("after"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


# Walks: the messages of a conversation are its chunks, the last user message is the query


def _scopes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "conversations")
    queries = messages.last_query(rows).withColumnRenamed("conv_id", "scope")
    return messages.extraction_middle(rows).select(F.col("conv_id").alias("scope"), F.col("turn").alias("idx"), F.col("text").alias("raw")), queries


SCOPE = f"""m AS (SELECT conv_id AS scope, turn AS idx, text AS raw, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
ch AS (SELECT scope, idx, raw FROM m WHERE role <> 'system' AND coalesce({_trim('raw')}, '') <> '' AND (last IS NULL OR idx <> last)), q AS (SELECT scope, raw AS query FROM m WHERE idx = last)"""
USABLE = f"strlen(term) >= 2 AND term NOT IN ({STOP})"
TERMS_OF = COMPOUND.format("{}")


def _snippet(found: str) -> str:
    """Snippets of found rows (scope, idx, wanted)."""
    return f"""SELECT scope, idx, left(j, list_max(list_filter(range(0, 257), lambda k: strlen(left(j, k)) <= 256))::BIGINT) AS snippet FROM (
  SELECT f.scope, f.idx, string_agg(line, {NL} ORDER BY line_no) AS j FROM {found} f JOIN ln ON ln.scope = f.scope AND ln.idx = f.idx WHERE list_has_any(ln.words, f.wanted) GROUP BY ALL) WHERE j <> ''"""


def _hop(h: int, before: str, followed: str) -> str:
    return f""", fr{h} AS (SELECT DISTINCT scope, term FROM (SELECT scope, unnest({COMPOUND.format('snippet')}) AS term FROM p{h - 1}) JOIN rare USING (scope, term){followed}),
cl{h} AS (SELECT scope, idx, min(term) AS term FROM held JOIN rare USING (scope, term) JOIN fr{h} USING (scope, term) WHERE (scope, idx) NOT IN ({before}) GROUP BY ALL),
nx{h} AS (SELECT scope, idx, [term] AS wanted, mx + row_number() OVER (PARTITION BY scope ORDER BY term, idx) AS rank FROM cl{h} JOIN (SELECT scope, max(rank) AS mx FROM ({before.replace('scope, idx', 'scope, rank')}) GROUP BY scope) USING (scope) QUALIFY rank <= 4),
sn{h} AS ({_snippet(f'nx{h}')}), p{h} AS (SELECT scope, idx, rank, {h} AS depth, snippet FROM nx{h} JOIN sn{h} USING (scope, idx))"""


@query(f"""WITH {SCOPE}, ln AS (SELECT scope, idx, line, line_no, {COMPOUND.format('line')} AS words FROM (SELECT scope, idx, unnest(x) AS line, unnest(range(len(x))) AS line_no FROM (SELECT *, string_split(regexp_replace(raw, '\\n$', ''), {NL}) AS x FROM ch))),
held AS (SELECT DISTINCT scope, idx, term FROM (SELECT scope, idx, unnest(words) AS term FROM ln) WHERE {USABLE}), n AS (SELECT scope, greatest(2, ceil(0.15::FLOAT * count(*)::FLOAT)) AS lim FROM ch GROUP BY scope),
rare AS (SELECT scope, term FROM held JOIN n USING (scope) GROUP BY scope, term HAVING count(*) <= any_value(lim)),
s0 AS (SELECT scope, idx, list(term) AS wanted FROM held JOIN rare USING (scope, term) JOIN (SELECT DISTINCT scope, unnest({COMPOUND.format('query')}) AS term FROM q) USING (scope, term) GROUP BY ALL),
nx0 AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY idx) AS rank FROM s0 QUALIFY rank <= 4), sn0 AS ({_snippet('nx0')}), p0 AS (SELECT scope, idx, rank, 0 AS depth, snippet FROM nx0 JOIN sn0 USING (scope, idx))
{_hop(1, 'SELECT scope, idx FROM p0', '')}
{_hop(2, 'SELECT scope, idx FROM p0 UNION ALL SELECT scope, idx FROM p1', ' WHERE (scope, term) NOT IN (SELECT scope, term FROM fr1)')}
SELECT scope, idx, rank, depth, md5(snippet) AS snippet_md5 FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)""")
def g1_j8_token_follow(spark: SparkSession, sf: str) -> DataFrame:
    found = walks.follow_rare_words(*_scopes(spark, sf), max_df_frac=0.15, hops=2, max_chunks=4)
    return found.select("scope", "idx", "rank", "depth", F.md5("snippet").alias("snippet_md5"))


@query()
def g2_o4_o5_walk(spark: SparkSession, sf: str) -> DataFrame:
    return walks.best_first(*_scopes(spark, sf), hops=2, max_chunks=4, folded=False)


@query()
def g3_g5_walk(spark: SparkSession, sf: str) -> DataFrame:
    return walks.best_first(*_scopes(spark, sf), hops=2, max_chunks=4)


CHAIN = [
    (1, 1, "The billing endpoint is served by unit KESTREL-40."),
    (1, 2, "Unit KESTREL-40 keeps its rows in MARLIN_db."),
    (1, 3, "MARLIN_db was moved to rack Ödland7."),
    (1, 4, "Nothing of note was said about lunch."),
    (1, 5, "Rack Odland7 is cooled by water."),
    (2, 1, "alpha beta\nbeta gamma"),
    (2, 2, "gamma delta"),
]
ASKS = [(1, "Where does the billing endpoint end up?"), (2, "beta")]


@query("""SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 1::BIGINT, 0), (1, 2, 2, 1), (1, 3, 3, 2), (2, 1, 1, 0), (2, 2, 2, 1)) t(scope, rank, idx, depth)""")
def g3_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of facts: from the question over shared names, two hops and no further; marks are folded."""
    rows, asked = spark.createDataFrame(CHAIN, "scope long, idx long, raw string"), spark.createDataFrame(ASKS, "scope long, query string")
    return walks.best_first(rows, asked, hops=2, max_chunks=3).select("scope", "rank", "idx", "depth")


VECTOR_SCORE = "round(least(1.0, greatest(0.0, list_cosine_similarity({}.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6)"


def _vector_hop(h: int, before: str) -> str:
    return f""", sc{h} AS (SELECT v.label AS scope, p.rank AS "of", v.vec_id AS idx, {VECTOR_SCORE.format('a')} AS score FROM p{h - 1} p JOIN embeddings a ON a.vec_id = p.idx JOIN embeddings v ON v.label = p.scope),
bs{h} AS (SELECT *, row_number() OVER (PARTITION BY scope, "of" ORDER BY score DESC, idx) AS nth FROM sc{h} QUALIFY nth <= 4),
fi{h} AS (SELECT scope, idx, min(("of", nth)) AS found FROM bs{h} WHERE score >= 0.15 AND (scope, idx) NOT IN ({before}) GROUP BY ALL),
p{h} AS (SELECT scope, idx, mx + row_number() OVER (PARTITION BY scope ORDER BY found) AS rank, {h} AS depth FROM fi{h} JOIN (SELECT scope, max(rank) AS mx FROM ({before.replace('scope, idx', 'scope, rank')}) GROUP BY scope) USING (scope) QUALIFY rank <= 12)"""


@query(f"""WITH qs AS (SELECT label AS scope, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
p0 AS (SELECT scope, idx, row_number() OVER (PARTITION BY scope ORDER BY score DESC, idx) AS rank, 0 AS depth FROM (SELECT qs.scope, v.vec_id AS idx, {VECTOR_SCORE.format('qs')} AS score FROM qs JOIN embeddings v ON v.label = qs.scope) QUALIFY rank <= 3)
{_vector_hop(1, 'SELECT scope, idx FROM p0')}{_vector_hop(2, 'SELECT scope, idx FROM p0 UNION ALL SELECT scope, idx FROM p1')}
SELECT scope, idx, rank, depth FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)""")
def g4_j6_vector_walk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "scope")
    return walks.follow_vectors(rows.select(F.col("label").alias("scope"), F.col("vec_id").alias("idx"), "embedding"), first, top_k=3, fanout=3, hops=2, max_chunks=12)


@query("""WITH s AS (SELECT q.vec_id AS query_id, g.label, v.vec_id, round(least(1.0, greatest(0.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q, (SELECT DISTINCT label FROM embeddings) g JOIN embeddings v ON v.label = g.label WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label % 2 = query_id % 2 QUALIFY rank <= 10""")
def o1_j4_wide_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes of several groups: each query's candidates are the vectors of every label as odd or even as its id."""
    queries, rows = _vectors(spark, sf)
    return retrieval.nearest(queries.select("query_id", (F.col("query_id") % 2).alias("scope"), "embedding"), rows.select("vec_id", (F.col("label") % 2).cast("long").alias("scope"), "embedding"), 10, scope="scope")


# Prompts: the model's digest of a text is its first 40 characters


def _digest(text):  # noqa: ANN001, ANN202
    return F.substring(T.trimmed(text), 1, 40)


PIECES_OF = f"""{SCOPE}, nb AS (SELECT scope, idx, raw, row_number() OVER (PARTITION BY scope ORDER BY idx) AS pos FROM ch), ck AS (SELECT scope, pos, pos::VARCHAR AS positional_id, {_hash('raw')} AS content_hash, raw FROM nb)"""


def _cut(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, queries = _scopes(spark, sf)
    cut = chunks.split_texts(rows.select("scope", "idx", F.col("raw").alias("text")), 100_000, "scope", "idx")
    return cut, queries


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return _halves(spark, sf)[0]


DIGESTED = HALVES + f", {PIECES_OF}, dg AS (SELECT scope, pos, positional_id, content_hash, coalesce(nullif(s.summary, ''), left({_trim('k.raw')}, 40)) AS summary, count(*) OVER (PARTITION BY scope) AS n, k.raw FROM ck k LEFT JOIN store s USING (content_hash))"


@query(DIGESTED + " SELECT scope, pos, content_hash, summary, n > 3 AS capped FROM dg WHERE pos > n - 3")
def c1_c2_digests(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.digests(_cut(spark, sf)[0], _known(spark, sf), _digest, 3).select("scope", "pos", "content_hash", "summary", "capped")


def _fenced(label: str, rule: str, body: str) -> str:
    tag = f"right({_hash(body)}, 8)"
    return f"('[{label}] {rule}' || {NL} || '<<<quoted:notes:' || {tag} || '>>>' || {NL} || {body} || {NL} || '<<<quoted:end:' || {tag} || '>>>' || {NL})".replace("user's", "user''s")


@query(DIGESTED + f""", nt AS (SELECT scope, string_agg('[chunk ' || positional_id || '] ' || {_trim('summary')}, {NL} || '---' || {NL} ORDER BY pos) AS notes FROM dg GROUP BY scope)
SELECT scope, md5({_fenced(assemble.NOTES_LABEL, assemble.NOTES_RULE, 'notes')}) AS system_md5, md5(query) AS user_md5 FROM nt JOIN q USING (scope)""")
def c3_exhaustive(spark: SparkSession, sf: str) -> DataFrame:
    cut, queries = _cut(spark, sf)
    found = assemble.exhaustive(cut, queries.filter("query <> ''"), _known(spark, sf), _digest)
    return found.select("scope", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"))


SEED = f""", cw AS (SELECT scope, content_hash, any_value(raw) AS raw, max_by(positional_id, pos) AS positional_id FROM ck GROUP BY ALL), wd AS (SELECT scope, content_hash, unnest({WORDS.format('raw')}) AS t FROM cw), wq AS (SELECT scope, unnest({WORDS.format('query')}) AS t FROM q),
hs AS (SELECT t, ({_fnv('t')} % 256)::BIGINT AS b FROM (SELECT t FROM wd UNION SELECT t FROM wq)),
bc AS (SELECT scope, content_hash, b, n / sqrt(sum(n * n) OVER (PARTITION BY scope, content_hash)) AS v FROM (SELECT scope, content_hash, b, count(*) AS n FROM wd JOIN hs USING (t) GROUP BY ALL)),
bq AS (SELECT scope, b, n / sqrt(sum(n * n) OVER (PARTITION BY scope)) AS v FROM (SELECT scope, b, count(*) AS n FROM wq JOIN hs USING (t) GROUP BY ALL)),
dt AS (SELECT bc.scope, content_hash, sum(bc.v * bq.v) AS d FROM bc JOIN bq USING (scope, b) GROUP BY ALL),
hit AS (SELECT scope, content_hash, raw, positional_id, round(least(1.0, coalesce(d, 0.0)), 6) AS score, row_number() OVER (PARTITION BY scope ORDER BY round(least(1.0, coalesce(d, 0.0)), 6) DESC, content_hash) AS rank FROM cw JOIN q USING (scope) LEFT JOIN dt USING (scope, content_hash) QUALIFY rank <= 3)"""


@query(DIGESTED + SEED + " SELECT scope, content_hash, score, rank FROM hit")
def c6_o1_similar_chunks(spark: SparkSession, sf: str) -> DataFrame:
    cut, queries = _cut(spark, sf)
    return assemble.similar_chunks(cut, queries.filter("query <> ''"), 3).select("scope", "content_hash", "score", "rank")


@query()
def c5_c6_recap(spark: SparkSession, sf: str) -> DataFrame:
    cut, queries = _cut(spark, sf)
    return assemble.recap(cut, queries, _known(spark, sf), _digest, slots=2)


@query(DIGESTED + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos DESC) <= 2 AS hot FROM dg),
rc AS (SELECT scope, CASE WHEN count(*) FILTER (NOT hot) > 0 THEN '[' || count(*) FILTER (NOT hot) || ' earlier chunks summarized away — call search_chunks(query) or get_chunk("N") to recall them]' || {NL} || {NL} ELSE '' END || '[Recent context]' || {NL} || string_agg('[chunk ' || positional_id || '] ' || {_trim('summary')}, {NL} || '---' || {NL} ORDER BY pos) FILTER (hot) AS recap FROM rk GROUP BY scope)
SELECT scope, md5(recap) AS recap_md5 FROM rc""")
def c5_recap_without_seed(spark: SparkSession, sf: str) -> DataFrame:
    cut, queries = _cut(spark, sf)
    found = assemble.recap(cut, queries.limit(0), _known(spark, sf), _digest, slots=2, recap_tokens=100_000)
    return found.select("scope", F.md5("recap").alias("recap_md5"))


def _tail(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf)[0].select(F.col("conv_id").alias("scope"), "turn", "role", "text").filter("role <> 'system'")


TAIL = f"""tl AS (SELECT conv_id AS scope, turn, role, text, role = 'tool' AND text IS NOT NULL AND {_est("coalesce(text, '')")} > 40 AS big FROM {LABELLED} WHERE role <> 'system'),
tn AS (SELECT *, 'T' || sum(big::INT) OVER (PARTITION BY scope ORDER BY turn) AS id, array_to_string(list_slice(string_split(regexp_replace(text, '\\n$', ''), {NL}), 1, 6), {NL}) AS head FROM tl),
ex AS (SELECT scope, turn, role, CASE WHEN big THEN CASE WHEN length(head) <= 480 THEN head ELSE left(head, 480) || '{T.CUT_MARK}' END || {NL} || '…[tool output truncated — call get_chunk("' || id || '") for the full text]' ELSE text END AS text, CASE WHEN big THEN id END AS id, text AS whole FROM tn)"""


@query(f"WITH {TAIL} SELECT scope, turn, id, md5(text) AS text_md5 FROM ex")
def f27_externalize(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.externalize(_tail(spark, sf), 40).select("scope", "turn", "id", F.md5("text").alias("text_md5"))


@query(HALVES + f""", {PIECES_OF}, {TAIL}, ask AS (SELECT scope, 'T1' AS id, 'raw' AS part FROM ch UNION SELECT scope, '1', ' Summary ' FROM ch UNION SELECT scope, '2', 'BOTH' FROM ch UNION SELECT scope, '99', 'raw' FROM ch)
SELECT a.scope, a.id, md5(left(coalesce(e.whole, CASE lower(trim(part)) WHEN 'summary' THEN CASE WHEN k.raw IS NOT NULL THEN coalesce(s.summary, '') END WHEN 'both' THEN '[summary] ' || coalesce(s.summary, '') || {NL} || '[raw] ' || k.raw ELSE k.raw END, '(no such chunk)'), 8000)) AS content_md5
FROM ask a LEFT JOIN ex e ON e.scope = a.scope AND e.id = a.id LEFT JOIN ck k ON k.scope = a.scope AND k.positional_id = a.id LEFT JOIN store s USING (content_hash)""")
def j11_f19_recall(spark: SparkSession, sf: str) -> DataFrame:
    cut, _ = _cut(spark, sf)
    asks = cut.select("scope").distinct().withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("part")) for i, p in (("T1", "raw"), ("1", " Summary "), ("2", "BOTH"), ("99", "raw")))))).select("scope", "x.id", "x.part")
    outside = assemble.externalize(_tail(spark, sf), 40).filter("id IS NOT NULL").select("scope", "id", "full_text")
    return chunks.recall(asks, outside, cut, _known(spark, sf), "scope").select("scope", "id", F.md5("content").alias("content_md5"))


@query(f"WITH {PIECES_OF} SELECT scope, content_hash, max_by(positional_id, pos) AS positional_id FROM ck GROUP BY ALL")
def j10_positions(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.latest_positions(_cut(spark, sf)[0], "scope")


@query(f"""WITH sy AS (SELECT conv_id AS scope, 0 AS section, turn, role, text FROM conversations WHERE role = 'system'), rc AS (SELECT conv_id AS scope, 'sum of ' || count(*) AS recap FROM conversations WHERE conv_id % 3 > 0 GROUP BY ALL),
tl AS (SELECT conv_id AS scope, 2 AS section, turn, role, text FROM conversations WHERE role <> 'system' AND turn >= 2), al AS (SELECT * FROM sy UNION ALL SELECT scope, 1, 0, 'system', {_fenced(assemble.RECAP_LABEL, assemble.RECAP_RULE, 'recap')} FROM rc UNION ALL SELECT * FROM tl)
SELECT scope, sum({_est("coalesce(text, '')")})::BIGINT AS assembled, sum({_est("coalesce(text, '')")}) > 300 AS over, md5(string_agg(role || coalesce(text, ''), '|' ORDER BY section, turn)) AS prompt_md5 FROM al GROUP BY scope""")
def c7_u4_p23_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumnRenamed("conv_id", "scope")
    recaps = rows.filter("scope % 3 > 0").groupBy("scope").agg(F.concat(F.lit("sum of "), F.count(F.lit(1))).alias("recap"))
    told = assemble.splice(rows.filter("role = 'system'"), recaps, rows.filter("role <> 'system' AND turn >= 2"))
    joined = told.groupBy("scope").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "turn", F.concat("role", F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), "|")).alias("prompt_md5"))
    return assemble.over_window(told, 800, 500).join(joined, "scope")


@query(f"""WITH a AS (SELECT conv_id AS scope, max_by(CASE WHEN conv_id % 5 = 0 THEN '<tool_call>' || text WHEN conv_id % 5 = 1 THEN 'It is not specified.' ELSE text END, turn) AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY ALL),
d AS (SELECT scope, answer, {_any('lower(answer)', rules.CALL_MARKS)} OR octet_length(encode({_trim('answer')})) < 2 OR {_any('lower(answer)', rules.REFUSALS)} AS again FROM a)
SELECT scope, CASE WHEN again THEN 'escalate' ELSE 'answer' END AS decision, CASE WHEN again THEN 'notes' END AS system FROM d""")
def c8_p16_settle(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    text = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("<tool_call>"), "text")).when(F.col("conv_id") % 5 == 1, "It is not specified.").otherwise(F.col("text"))
    answers = rows.groupBy(F.col("conv_id").alias("scope")).agg(F.max_by(text, "turn").alias("answer"))
    return assemble.settle(answers, answers.select("scope", F.lit("notes").alias("system"), F.lit("q").alias("user")), True).select("scope", "decision", "system")


@query(DIGESTED + " SELECT scope, pos AS rank, '[chunk ' || positional_id || '] ' || summary AS line FROM dg WHERE pos BETWEEN 3 AND 4")
def o6_digest_page(spark: SparkSession, sf: str) -> DataFrame:
    told = assemble.digests(_cut(spark, sf)[0], _known(spark, sf), _digest, 0)
    return assemble.digest_page(told, page=1, size=2)


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 + 1")
def w10_st6_warm_set(spark: SparkSession, sf: str) -> DataFrame:
    return notes.warm_start(table(spark, sf, "conversations"), "conv_id", "turn", 2, allowance=1).select("conv_id", "turn")


@query(f"""WITH h AS (SELECT conv_id AS group_id, turn, '[chunk ' || turn || '] ' || text || {NL} || '---' || {NL} AS line FROM conversations WHERE coalesce({_trim('text')}, '') <> '' AND (turn % 4) / 4.0 >= 0.5)
SELECT group_id, md5(string_agg(line, '' ORDER BY turn)) AS notes_md5 FROM h GROUP BY group_id""")
def f25_p19_min_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("rank"), F.col("turn").cast("string").alias("positional_id"), F.col("text").alias("summary"), (F.col("turn") % 4 / 4).alias("score"))
    both = notes.seed_notes(rows, 1_000_000, min_score=0.5).unionByName(notes.seed_notes(rows, 1_000_000, mode=" Off"))
    return both.select("group_id", F.md5("notes").alias("notes_md5"))


@query()
def s11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by a tokenizer file, where the box has one; otherwise by estimate."""
    import importlib.util

    rows = table(spark, sf, "benchmark")
    if importlib.util.find_spec("public_tokenizers") is None:
        return rows.select("item_id", T.est_tokens("text").alias("tokens"))
    import public_tokenizers

    from ..functions.tokenizer import counter

    return rows.select("item_id", counter(public_tokenizers.path("byte_bpe_50k.json"))(F.col("text")).alias("tokens"))
