"""Evaluation queries over goldenset, nodes and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from .providers import map_concurrently, parsed_replies
from .registry import query, table


def _gold(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    return table(spark, d, "goldenset").where("quote <> ''").join(texts, "chunk_id")


def _quotes(spark, d):
    """Quote spans within their chunks."""
    found = _gold(spark, d).withColumn("at", T.find(F.col("text"), F.col("quote"))).where("at is not null")
    return found.select("chunk_id", F.col("quote_id").alias("a_id"), F.col("at").cast("long").alias("s"), (F.col("at") + F.length("quote")).cast("long").alias("e"))


def _cited(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    found = table(spark, d, "nodes").select("node_no", "chunk_id", "evidence_text").join(texts, "chunk_id").withColumn("at", T.find(F.col("text"), F.col("evidence_text"))).where("at is not null")
    return found.select("chunk_id", F.col("node_no").alias("b_id"), F.col("at").cast("long").alias("s"), (F.col("at") + F.length("evidence_text")).cast("long").alias("e"))


SPANS_SQL = """q AS (SELECT chunk_id, quote_id, strpos(text, quote) - 1 AS s, strpos(text, quote) - 1 + length(quote) AS e FROM goldenset JOIN chunks USING (chunk_id) WHERE quote <> '' AND strpos(text, quote) > 0),
  n AS (SELECT chunk_id, node_no, strpos(text, evidence_text) - 1 AS s, strpos(text, evidence_text) - 1 + length(evidence_text) AS e FROM nodes JOIN chunks USING (chunk_id) WHERE evidence_text <> '' AND strpos(text, evidence_text) > 0),
  o AS (SELECT quote_id, node_no, least(q.e, n.e) - greatest(q.s, n.s) AS shared FROM q JOIN n ON q.chunk_id = n.chunk_id
    AND least(q.e, n.e) > greatest(q.s, n.s) AND 2 * (least(q.e, n.e) - greatest(q.s, n.s)) >= least(q.e - q.s, n.e - n.s))"""


@query("str16_evidence_spans", """WITH l AS (SELECT quote_id, quote, c.text, string_split(c.text, chr(10)) AS ln, g.line_start AS ls, g.line_end AS le FROM goldenset g JOIN chunks c USING (chunk_id) WHERE quote <> ''),
  r AS (SELECT *, least(greatest(ls, 1), len(ln)) AS a, least(greatest(le, 1), len(ln)) AS b FROM l),
  i AS (SELECT *, CASE WHEN a > 1 THEN length(array_to_string(ln[1:a - 1], chr(10))) + 1 ELSE 0 END AS before, array_to_string(ln[a:greatest(a, b)], chr(10)) AS inside FROM r),
  s AS (SELECT *, CASE WHEN strpos(inside, quote) > 0 THEN before + strpos(inside, quote) - 1 WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 END AS start FROM i)
  SELECT quote_id, start, start + length(quote) AS "end" FROM s WHERE start IS NOT NULL""")  # fmt: skip
def evidence_spans(spark, d):
    found = _gold(spark, d).withColumn("s", E.evidence_span(F.col("text"), F.col("quote"), F.col("line_start"), F.col("line_end"))).where("s is not null")
    return found.select("quote_id", "s.start", "s.end")


@query("join08_overlapping_spans", f"WITH {SPANS_SQL} SELECT quote_id, node_no, shared FROM o")
def overlapping_spans(spark, d):
    pairs = E.overlap_pairs(_quotes(spark, d), _cited(spark, d), ["chunk_id"])
    return pairs.select(F.col("a_id").alias("quote_id"), F.col("b_id").alias("node_no"), "shared")


@query("join09_similarity_join", """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label = b.label
  WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND round(list_dot_product(a.v, b.v), 6) >= 0.3""")  # fmt: skip
def similarity_join(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    a = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "a_id")
    return E.similar_pairs(a, e.withColumnRenamed("vec_id", "b_id"), ["label"], 0.3).where("a_id <> b_id").select("a_id", "b_id", "score")


OUTCOME_SQL = f"""{SPANS_SQL}, item AS (SELECT g.quote_id, g.stem || '/' || g.id AS question_id, EXISTS (SELECT 1 FROM o WHERE o.quote_id = g.quote_id) AS cited,
    EXISTS (SELECT 1 FROM n WHERE n.chunk_id = g.chunk_id) AS in_graph FROM goldenset g WHERE quote <> ''),
  per AS (SELECT question_id, avg(CAST(cited AS INT)) AS recall, bool_or(NOT cited AND in_graph) AS held FROM item GROUP BY 1),
  qs AS (SELECT stem || '/' || id AS question_id, bool_or(answerable) AS answerable, min(question_type) AS question_type FROM goldenset GROUP BY 1),
  sc AS (SELECT qs.*, recall, CASE WHEN NOT answerable THEN 'unanswerable' WHEN recall IS NULL THEN 'unscorable' WHEN recall >= 0.5 THEN 'hit' WHEN held THEN 'retrieval_miss' ELSE 'extraction_miss' END AS outcome FROM qs LEFT JOIN per USING (question_id))"""


def scored_questions(spark, d):
    pairs = E.overlap_pairs(_quotes(spark, d), _cited(spark, d), ["chunk_id"]).select(F.col("a_id").alias("quote_id")).distinct().withColumn("hit", F.lit(True))
    held = _cited(spark, d).select("chunk_id").distinct().withColumn("held", F.lit(True))
    gold = table(spark, d, "goldenset").withColumn("question_id", F.concat_ws("/", "stem", "id"))
    items = gold.where("quote <> ''").join(pairs, "quote_id", "left").join(held, "chunk_id", "left").select("question_id", F.coalesce("hit", F.lit(False)).alias("cited"), F.coalesce("held", F.lit(False)).alias("in_graph"))
    questions = gold.groupBy("question_id").agg(F.bool_or("answerable").alias("answerable"), F.min("question_type").alias("question_type"))
    return E.question_outcomes(items, questions)


@query("agg09_question_outcomes", f"WITH {OUTCOME_SQL} SELECT question_id, round(recall, 6) AS recall, outcome FROM sc")
def question_outcomes(spark, d):
    return scored_questions(spark, d).select("question_id", F.round("recall", 6).alias("recall"), "outcome")


@query("agg06_outcome_summary", f"""WITH {OUTCOME_SQL} SELECT count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'retrieval_miss') AS retrieval_miss, count(*) FILTER (outcome = 'extraction_miss') AS extraction_miss,
  count(*) FILTER (outcome = 'unanswerable') AS unanswerable, count(*) FILTER (outcome = 'unscorable') AS unscorable, count(*) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')) AS scored,
  round(count(*) FILTER (outcome = 'hit') / nullif(count(*) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')), 0), 6) AS hit_rate,
  round(avg(recall) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')), 6) AS mean_recall FROM sc""")  # fmt: skip
def outcome_summary(spark, d):
    return E.outcome_summary(scored_questions(spark, d))


@query("agg06_by_question_type", f"""WITH {OUTCOME_SQL} SELECT coalesce(question_type, 'unknown') AS question_type, count(*) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')) AS scored, count(*) FILTER (outcome = 'hit') AS hits FROM sc GROUP BY 1""")
def by_question_type(spark, d):
    return E.by_question_type(scored_questions(spark, d))


@query("agg08_repeated_passages", """SELECT quote_id, (length(c.text) - length(replace(c.text, quote, ''))) // length(quote) AS n FROM goldenset JOIN chunks c USING (chunk_id) WHERE quote <> '' AND (length(c.text) - length(replace(c.text, quote, ''))) // length(quote) > 1""")
def repeated_passages(spark, d):
    return _gold(spark, d).select("quote_id", E.occurrences(F.col("text"), F.col("quote")).cast("long").alias("n")).where("n > 1")


ARM_SQL = "s AS (SELECT CASE WHEN quote_id % 4 < 2 THEN 'control' ELSE 'arm' || (quote_id % 4) END AS arm, quote_id % 4 AS run, stem || '/' || id AS question_id, bool_or(answerable) AS hit FROM goldenset GROUP BY ALL)"


@query("agg19_experiment_arms", f"""WITH {ARM_SQL}, r AS (SELECT arm, run, count(*) FILTER (hit) AS hits FROM s GROUP BY ALL),
  b AS (SELECT avg(hits) AS m, count(*) AS n FROM r WHERE arm = 'control'), a AS (SELECT question_id FROM s WHERE arm = 'control' AND hit GROUP BY 1 HAVING count(DISTINCT run) = (SELECT n FROM b)),
  l AS (SELECT arm, run, count(*) AS lost FROM s WHERE arm <> 'control' AND NOT hit AND question_id IN (SELECT question_id FROM a) GROUP BY ALL)
  SELECT r.arm, r.run, hits, round(hits - m, 6) AS gain, coalesce(lost, 0) AS lost, hits - m >= 4 AND coalesce(lost, 0) = 0 AS adopt FROM r CROSS JOIN b LEFT JOIN l USING (arm, run) WHERE r.arm <> 'control'""")  # fmt: skip
def experiment_arms(spark, d):
    run = F.col("quote_id") % 4
    arm = F.when(run < 2, "control").otherwise(F.concat(F.lit("arm"), run.cast("string")))
    scores = table(spark, d, "goldenset").groupBy(arm.alias("arm"), run.alias("run"), F.concat_ws("/", "stem", "id").alias("question_id")).agg(F.bool_or("answerable").alias("hit"))
    return E.arm_verdicts(scores)


@query("flt16_verified_answers", """SELECT stem, id, bool_or(answerable) AND count(*) FILTER (strpos(c.text, quote) > 0 AND quote <> '') > 0 AS answerable,
  count(*) FILTER (quote <> '' AND coalesce(strpos(c.text, quote), 0) = 0) AS n_unverified FROM goldenset g LEFT JOIN (SELECT chunk_id, text FROM chunks) c USING (chunk_id) GROUP BY ALL""")  # fmt: skip
def verified_answers(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    rows = table(spark, d, "goldenset").select("stem", "id", "answerable", "quote", "chunk_id").join(texts, "chunk_id", "left")
    given = F.coalesce(F.col("quote") != "", F.lit(False))
    good = F.coalesce(F.contains("text", "quote"), F.lit(False)) & given
    return rows.groupBy("stem", "id").agg((F.bool_or("answerable") & (F.count_if(good) > 0)).alias("answerable"), F.count_if(given & ~good).alias("n_unverified"))


@query("win07_renumbered_questions", """WITH k AS (SELECT stem, min(quote_id) AS quote_id FROM (SELECT stem, quote_id, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS key FROM goldenset WHERE question IS NOT NULL) GROUP BY stem, key)
  SELECT stem, quote_id, 'q' || CASE WHEN row_number() OVER w < 1000 THEN lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER w AS VARCHAR) END AS new_id FROM k WINDOW w AS (PARTITION BY stem ORDER BY quote_id)""")  # fmt: skip
def renumbered_questions(spark, d):
    rows = table(spark, d, "goldenset").where("question is not null").select("stem", "quote_id", "question")
    return E.renumbered(rows, ["stem"], "quote_id").select("stem", "quote_id", "new_id")


@query("win16_batch_windows", """WITH n AS (SELECT stem, sum(length(coalesce(text, ''))) AS chars FROM chunks GROUP BY stem), w AS (SELECT stem, CAST(greatest(1, ceil(chars / 12000)) AS BIGINT) AS windows, CAST(least(5, greatest(1, ceil(chars / 12000))) AS BIGINT) AS batches FROM n),
  b AS (SELECT stem, windows, batches, unnest(range(0, CAST(batches AS BIGINT))) AS batch FROM w)
  SELECT stem, batch, CAST(batch * windows // batches AS BIGINT) AS window_index, CAST(45 // batches AS BIGINT) + CASE WHEN batch < 45 % batches THEN 1 ELSE 0 END AS n_questions FROM b""")  # fmt: skip
def batch_windows(spark, d):
    """45 questions a document: batches of at most ten, no more than windows of text, spread evenly over the windows."""
    n = table(spark, d, "chunks").groupBy("stem").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    w = n.withColumn("windows", F.greatest(F.lit(1), F.ceil(F.col("chars") / 12000))).withColumn("batches", F.least(F.lit(5), F.col("windows")))
    b = w.select("stem", "windows", "batches", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"))
    extra = F.when(F.col("batch") < F.lit(45) % F.col("batches"), 1).otherwise(0)
    return b.select("stem", F.col("batch").cast("long").alias("batch"), F.floor(F.col("batch") * F.col("windows") / F.col("batches")).alias("window_index"), (F.floor(F.lit(45) / F.col("batches")) + extra).alias("n_questions"))


@query("join14_quotes_in_groups", """SELECT quote_id, count(DISTINCT c.chunk_id) AS n_chunks FROM goldenset g JOIN chunks c ON c.stem = g.stem WHERE g.quote_id % 20 = 0 AND g.quote <> '' AND contains(c.text, g.quote) GROUP BY quote_id""")
def quotes_in_groups(spark, d):
    g = table(spark, d, "goldenset").where("quote_id % 20 = 0").select("stem", F.col("quote_id").alias("part_id"), F.col("quote").alias("part"))
    texts = table(spark, d, "chunks").select("stem", F.col("chunk_id").alias("text_id"), "text")
    return E.containing_texts(g, texts, "stem").groupBy(F.col("part_id").alias("quote_id")).agg(F.count("*").alias("n_chunks"))


@query("msc07_answer_facts", """SELECT quote_id, CASE WHEN question_type = 'list' AND len(list_filter(string_split(coalesce(answer, ''), ','), lambda x: x <> '')) > 0 THEN array_to_string(list_filter(string_split(answer, ','), lambda x: x <> ''), ';')
  WHEN answer <> '' THEN answer ELSE '' END AS facts FROM goldenset""")  # fmt: skip
def answer_facts(spark, d):
    """Answers of list questions carry a fact for each part; other questions have no facts of their own."""
    g = table(spark, d, "goldenset")
    parts = F.transform(F.split("answer", ","), lambda x: F.struct(F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("predicate"), x.alias("object")))
    facts = F.when(F.col("question_type") == "list", parts)
    return g.select("quote_id", F.array_join(E.answer_facts(facts, F.col("answer")), ";").alias("facts"))


def _judge(prompt: str) -> str:
    """A deterministic stand-in for a judging model."""
    return '```json\n{"answerable": ' + ("true" if len(prompt) % 3 else "false") + ', "reason": "length"}\n```'


def _verdicts(asked):
    replies = map_concurrently(asked.withColumn("prompt", F.concat("question", F.lit("\n"), "context")), "key", "prompt", _judge)
    told = parsed_replies(replies, "key", ("answerable",))
    return told.select("key", F.get_json_object("value", "$.answerable").cast("boolean").alias("answerable"))


JUDGED_SQL = """j AS (SELECT quote_id, question_type, CASE WHEN coalesce(text, '') = '' THEN false ELSE length(coalesce(question, '') || chr(10) || text) % 3 <> 0 END AS judged FROM goldenset LEFT JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id))"""


def _judged(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", F.col("text").alias("context"))
    q = table(spark, d, "goldenset").select(F.col("quote_id").alias("key"), F.coalesce("question", F.lit("")).alias("question"), "question_type", "chunk_id").join(texts, "chunk_id", "left")
    return q.select("key", "question_type").join(E.judged(q, _verdicts), "key")


@query("msc08_judged", f"WITH {JUDGED_SQL} SELECT quote_id, judged FROM j")
def judged(spark, d):
    """Questions with the chunk of their quote as context, judged; without context they are not answerable and not asked."""
    return _judged(spark, d).select(F.col("key").alias("quote_id"), F.col("answerable").alias("judged"))


@query("agg10_judge_rate", f"WITH {JUDGED_SQL} SELECT question_type, count(*) AS scored, count(*) FILTER (judged) AS answerable, round(avg(CAST(judged AS INT)), 6) AS rate FROM j GROUP BY question_type")
def judge_rate(spark, d):
    return _judged(spark, d).groupBy("question_type").agg(F.count("*").alias("scored"), F.count_if("answerable").alias("answerable"), F.round(F.avg(F.col("answerable").cast("int")), 6).alias("rate"))


#: Nodes cite with the evidence verified in their chunk; a search returns those of high confidence.
READINGS_SQL = f"""{SPANS_SQL}, qs AS (SELECT stem || '/' || id AS question_id, bool_or(answerable) AS answerable, min(question_type) AS question_type FROM goldenset GROUP BY 1),
  told AS (SELECT node_no, chunk_id, lower(regexp_replace(coalesce(label, '') || ' ' || coalesce(detail, '') || ' ' || coalesce(evidence_text, ''), '\\s+', '', 'g')) AS t, coalesce(confidence, '') = 'HIGH' AS returned FROM nodes WHERE chunk_id IS NOT NULL),
  strict AS (SELECT g.stem || '/' || g.id AS question_id, g.quote_id AS part_id, coalesce(bool_or(told.returned), false) AS cited, count(told.node_no) > 0 AS in_graph FROM goldenset g JOIN q USING (quote_id) LEFT JOIN o USING (quote_id) LEFT JOIN told ON told.node_no = o.node_no GROUP BY ALL),
  fact AS (SELECT DISTINCT stem || '/' || id AS question_id, chunk_id, lower(regexp_replace(answer, '\\s+', '', 'g')) AS f FROM goldenset WHERE answer <> '' AND chunk_id IS NOT NULL),
  answer AS (SELECT question_id, hash(f) AS part_id, coalesce(bool_or(contains(t, f) AND returned), false) AS cited, coalesce(bool_or(contains(t, f)), false) AS in_graph FROM fact LEFT JOIN told USING (chunk_id) GROUP BY question_id, f),
  parts AS (SELECT 'strict' AS reading, * FROM strict UNION ALL SELECT 'answer', * FROM answer),
  per AS (SELECT reading, question_id, avg(CAST(cited AS INT)) AS recall, bool_or(NOT cited AND in_graph) AS held FROM parts GROUP BY ALL),
  sc AS (SELECT r.reading, qs.question_id, recall, CASE WHEN NOT answerable THEN 'unanswerable' WHEN recall IS NULL THEN 'unscorable' WHEN recall >= 0.5 THEN 'hit' WHEN held THEN 'retrieval_miss' ELSE 'extraction_miss' END AS outcome
    FROM qs CROSS JOIN (VALUES ('strict'), ('answer')) r(reading) LEFT JOIN per ON per.question_id = qs.question_id AND per.reading = r.reading)"""


def golden_readings(spark, d):
    """Every golden question under the strict reading (evidence of returned nodes overlaps its passages) and the answer reading (their text states its answer)."""
    g = table(spark, d, "goldenset").withColumn("question_id", F.concat_ws("/", "stem", "id"))
    questions = g.groupBy("question_id").agg(F.bool_or("answerable").alias("answerable"), F.min("question_type").alias("question_type"))
    nodes = table(spark, d, "nodes").where("chunk_id is not null")
    returned = F.coalesce(F.col("confidence") == "HIGH", F.lit(False))
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    told = nodes.select(F.col("node_no").alias("b_id"), "chunk_id", returned.alias("returned"), flat(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("detail", F.lit("")), F.coalesce("evidence_text", F.lit("")))).alias("t"))
    spans = _quotes(spark, d)
    cites = E.overlap_pairs(spans, _cited(spark, d), ["chunk_id"]).join(told.select("b_id", "returned"), "b_id").groupBy("a_id").agg(F.bool_or("returned").alias("cited"))
    passages = spans.select(F.col("a_id").alias("quote_id")).join(g.select("quote_id", "question_id"), "quote_id").join(cites.withColumnRenamed("a_id", "quote_id"), "quote_id", "left")
    strict = passages.select("question_id", F.lit("strict").alias("reading"), F.coalesce("cited", F.lit(False)).alias("cited"), F.col("cited").isNotNull().alias("in_graph"))
    fact = g.where("answer <> '' and chunk_id is not null").select("question_id", "chunk_id", flat("answer").alias("f")).distinct()
    stated = fact.join(told, "chunk_id", "left").withColumn("says", F.coalesce(F.contains("t", "f"), F.lit(False)))
    answer = stated.groupBy("question_id", "f").agg(F.coalesce(F.bool_or(F.col("says") & F.col("returned")), F.lit(False)).alias("cited"), F.bool_or("says").alias("in_graph"))
    parts = strict.union(answer.select("question_id", F.lit("answer"), "cited", "in_graph"))
    return E.score_readings(questions, parts, ["strict", "answer"])


@query("pipe07_golden_scores", f"WITH {READINGS_SQL} SELECT reading, question_id, round(recall, 6) AS recall, outcome FROM sc")
def golden_scores(spark, d):
    return golden_readings(spark, d).select("reading", "question_id", F.round("recall", 6).alias("recall"), "outcome")


@query("pipe07_golden_summary", f"""WITH {READINGS_SQL} SELECT reading, count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'retrieval_miss') AS retrieval_miss, count(*) FILTER (outcome = 'extraction_miss') AS extraction_miss,
  count(*) FILTER (outcome = 'unanswerable') AS unanswerable, count(*) FILTER (outcome = 'unscorable') AS unscorable, count(*) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')) AS scored,
  round(count(*) FILTER (outcome = 'hit') / nullif(count(*) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')), 0), 6) AS hit_rate,
  round(avg(recall) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')), 6) AS mean_recall FROM sc GROUP BY reading""")  # fmt: skip
def golden_summary(spark, d):
    return E.outcome_summary(golden_readings(spark, d), ["reading"])


@query("agg18_probe_summary", f"""WITH {READINGS_SQL}, miss AS (SELECT question_id FROM sc WHERE reading = 'strict' AND outcome = 'extraction_miss'),
  f AS (SELECT chunk_id, s, e FROM q WHERE (e - s) % 2 = 0),
  again AS (SELECT x.question_id, avg(CAST(EXISTS (SELECT 1 FROM f WHERE f.chunk_id = q.chunk_id AND least(f.e, q.e) > greatest(f.s, q.s) AND 2 * (least(f.e, q.e) - greatest(f.s, q.s)) >= least(f.e - f.s, q.e - q.s)) AS INT)) AS recall
    FROM miss x JOIN goldenset g ON g.stem || '/' || g.id = x.question_id JOIN q USING (quote_id) GROUP BY x.question_id)
  SELECT count(*) AS probed, count(*) FILTER (recall >= 0.5) AS recovered, count(*) FILTER (recall < 0.5) AS still_missed, count(*) FILTER (recall IS NULL) AS not_locatable FROM miss LEFT JOIN again USING (question_id)""")  # fmt: skip
def probe_summary(spark, d):
    """Questions missed in extraction asked of their chunks alone by a deterministic second extraction, which cites passages of even length."""
    missed = golden_readings(spark, d).where("reading = 'strict' and outcome = 'extraction_miss'").select("question_id")
    g = table(spark, d, "goldenset").select("quote_id", "quote", "chunk_id", F.concat_ws("/", "stem", "id").alias("question_id"))
    spans = _quotes(spark, d).withColumnRenamed("a_id", "quote_id").join(g.select("quote_id", "question_id", "quote"), "quote_id")
    found = spans.where(F.length("quote") % 2 == 0).select("chunk_id", F.col("quote_id").alias("b_id"), "s", "e")
    return E.probe_summary(missed, spans.select("question_id", "chunk_id", F.col("quote_id").alias("a_id"), "s", "e"), found)


@query("flt15_question_problems", """WITH q AS (SELECT stem, quote_id, question, question_type, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS key FROM goldenset)
  SELECT stem, NULL::BIGINT AS position, 'count' AS problem FROM q GROUP BY stem HAVING count(*) <> 5 UNION ALL SELECT stem, quote_id, 'text' FROM q WHERE coalesce(question, '') = ''
  UNION ALL SELECT stem, quote_id, 'type' FROM q WHERE question_type IS NULL OR question_type NOT IN ('entity', 'attribute', 'relation', 'multi_hop', 'list', 'boolean', 'unanswerable')
  UNION ALL SELECT stem, quote_id, 'duplicate' FROM q WHERE question <> '' AND quote_id > (SELECT min(x.quote_id) FROM q x WHERE x.stem = q.stem AND x.key = q.key AND x.question <> '')""")  # fmt: skip
def question_problems(spark, d):
    """All rows of a document as its generated questions, of which five are expected."""
    q = table(spark, d, "goldenset").select("stem", F.col("quote_id").alias("position"), "question", "question_type")
    return E.question_problems(q, q.select("stem").distinct().withColumn("n", F.lit(5)), ["stem"])


@query("join11_question_answers", """WITH a AS (SELECT stem, id, arg_max(coalesce(answer, ''), quote_id) AS answer FROM goldenset GROUP BY ALL), q AS (SELECT stem, id, arg_min(coalesce(question, ''), quote_id) AS question FROM goldenset GROUP BY ALL)
  SELECT q.stem, q.id, q.question, a.answer FROM q JOIN a USING (stem, id)""")  # fmt: skip
def question_answers(spark, d):
    """First questions with last answers; both sides must have the same ids."""
    g = table(spark, d, "goldenset")
    asked = g.groupBy("stem", "id").agg(F.min_by(F.coalesce("question", F.lit("")), "quote_id").alias("question"))
    return E.matched_answers(asked, g.select("stem", "id", F.coalesce("answer", F.lit("")).alias("answer"), "quote_id"), ["stem", "id"], "quote_id")


@query("msc05_scoring_report", f"""WITH {OUTCOME_SQL}, oc AS (SELECT outcome, count(*) AS k FROM sc GROUP BY outcome)
  SELECT 'outcome' AS part, outcome AS name, printf('%d (%.1f %%)', k, k * 100.0::DOUBLE / (SELECT sum(k) FROM oc)) AS line FROM oc
  UNION ALL SELECT 'type', coalesce(question_type, 'unknown'), count(*) FILTER (outcome = 'hit') || '/' || count(*) FILTER (outcome IN ('hit', 'retrieval_miss', 'extraction_miss')) FROM sc GROUP BY 2
  UNION ALL SELECT 'question', question_id, outcome || ' ' || CASE WHEN recall IS NULL THEN '-' ELSE printf('%.2f', recall::DOUBLE) END FROM sc""")  # fmt: skip
def scoring_report(spark, d):
    return E.scoring_report(scored_questions(spark, d))


@query("win04_latest_answers", """WITH v AS (SELECT stem, max(version) AS version FROM nodes GROUP BY stem), a AS (SELECT stem, id, quote_id, coalesce(answer, '') AS answer, CASE WHEN answerable THEN version ELSE 0 END AS version FROM goldenset JOIN v USING (stem))
  SELECT stem, id, arg_max(quote_id, quote_id) AS quote_id, arg_max(answer, quote_id) AS answer FROM a SEMI JOIN v USING (stem, version) GROUP BY ALL""")  # fmt: skip
def latest_answers(spark, d):
    """The answer appended last to each question under the active version; unanswerable ones were logged under another, documents without graph have none."""
    active = table(spark, d, "nodes").groupBy("stem").agg(F.max("version").alias("version"))
    log = table(spark, d, "goldenset").join(active, "stem").select("stem", F.when(F.col("answerable"), F.col("version")).otherwise(0).alias("version"), "id", "quote_id", F.coalesce("answer", F.lit("")).alias("answer"), F.col("quote_id").alias("seq"))
    return E.latest(log.join(active, ["stem", "version"], "left_semi"), ["stem", "id"], "seq", ["quote_id", "answer"])
