"""From pages to deduplicated candidate questions: flags, windows, segments, hashes, triage and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions import text
from scholia.functions.tables import TYPE_ALIASES
from scholia.operators import sets, windows
from scholia.plans.practice import playable
from scholia.registry import query
from scholia.session import stored
from scholia.sources.readers import needs_ocr, unit_rows, with_vectors

C = F.col
#: What opens a segment of the sample documents, which have no numbered questions.
START = "(?i)^[a-g]"


def pages(s: Source) -> DataFrame:
    """(doc_id, page_no, text): the lines of a page joined again."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return s.lines().groupBy("doc_id", "page_no").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


_PAGES = "pg AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)"


_MIMES = ("application/pdf", "text/plain; charset=utf-8", "text/markdown", "image/png", "", "application/x-markdown")


def reader(mime: Column) -> Column:
    """What reads a file of a type: pdf or text; null for types that are refused."""
    return F.when(F.contains(mime, F.lit("pdf")), "pdf").when(F.contains(mime, F.lit("text/plain")) | F.contains(mime, F.lit("markdown")), "text")


@query("src3_src5_mime", f"""SELECT doc_id, reader, CASE reader WHEN 'text' THEN 1 WHEN 'pdf' THEN (len(text) - len(replace(text, chr(10), ''))) // 10 + 1 END AS n_pages, CASE WHEN reader = 'text' THEN strlen(trim(text)) < 20 END AS needs_ocr FROM (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 5 THEN 'text' END AS reader FROM documents)""".replace("CASE reader WHEN 'text' THEN 1 ", "CASE reader WHEN 'text' THEN CAST(1 AS BIGINT) "))
def mime(s: Source) -> DataFrame:
    """Files by their types: a text or Markdown file is one page, whole; a PDF's pages hold ten lines each here; other types are refused."""
    d = s.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), reader(F.get(F.array(*map(F.lit, _MIMES)), (C("doc_id") % 6).cast("int"))).alias("reader"))
    pages = F.floor((F.size(F.split("text", "\n", -1)) - 1) / 10) + 1
    return d.select("doc_id", "reader", F.when(C("reader") == "text", F.lit(1).cast("long")).when(C("reader") == "pdf", pages).alias("n_pages"), F.when(C("reader") == "text", needs_ocr(C("text"))).alias("needs_ocr"))


@query("src8_unit_rows", """SELECT CAST(document_id AS VARCHAR) AS unit_id, id, question_no, anchor FROM directory WHERE document_id % 4 <> 1 AND document_id % 7 <> 2""")
def replayed(s: Source) -> DataFrame:
    """Rows replayed from the JSON output of completed units (documents); unfinished units and malformed outputs give none."""
    row = F.struct("id", "question_no", "anchor")
    u = s.directory().groupBy("document_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("items"))).alias("json"))  # one unit's
    status = F.when(C("document_id") % 4 == 1, "running").otherwise("completed")
    broken = F.when(C("document_id") % 7 == 2, F.concat(F.lit("oops "), "json")).otherwise(C("json"))
    return unit_rows(u.select(C("document_id").cast("string").alias("unit_id"), status.alias("status"), broken.alias("output_json")), "id:bigint,question_no:bigint,anchor:string").select("unit_id", "id", "question_no", "anchor")


@query("src9_ocr_text", f""", {_PAGES}, o AS (SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 3 = 0 THEN NULL ELSE 'read ' || doc_id END AS ocr, ((doc_id + page_no) % 10) / 10.0 AS confidence FROM pg WHERE strlen(trim(text)) < 20)
    SELECT doc_id, page_no, CASE WHEN o.doc_id IS NULL THEN 'text_layer' WHEN ocr IS NULL THEN 'ocr_failed' ELSE 'ocr' END AS source, CAST(strlen(CASE WHEN ocr IS NULL THEN text ELSE ocr END) AS BIGINT) AS text_len, CAST(CASE WHEN ocr IS NOT NULL THEN confidence END AS DOUBLE) AS confidence FROM pg LEFT JOIN o USING (doc_id, page_no)""".replace("CASE WHEN o.doc_id IS NULL", "CASE WHEN confidence IS NULL"))
def ocr_text(s: Source) -> DataFrame:
    """Pages with little text take what an outside reader found, with its confidence; where it failed they keep their own."""
    p = pages(s)
    found = p.where(needs_ocr(C("text"))).select("doc_id", "page_no", F.when((C("doc_id") + C("page_no")) % 3 > 0, F.concat(F.lit("read "), C("doc_id").cast("string"))).alias("ocr"), (((C("doc_id") + C("page_no")) % 10) / 10.0).alias("confidence"))
    j = p.join(found, ["doc_id", "page_no"], "left")
    source = F.when(C("confidence").isNull(), "text_layer").when(C("ocr").isNull(), "ocr_failed").otherwise("ocr")
    return j.select("doc_id", "page_no", source.alias("source"), F.octet_length(F.coalesce("ocr", "text")).cast("long").alias("text_len"), F.when(C("ocr").isNotNull(), C("confidence")).cast("double").alias("confidence"))


@query("src10_vectors", """SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS a, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS b FROM documents""")
def vectors(s: Source) -> DataFrame:
    """Texts through an embedding function, 64 at a time; the sample's counts characters."""
    v = with_vectors(s.table("documents").select("doc_id", "text"), lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return v.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("a"), F.get("vector", F.lit(1)).cast("double").alias("b"))


@query("src4_cor24_page_flags", f", {_PAGES} SELECT doc_id, page_no, CAST(strlen(text) AS BIGINT) AS text_len, strlen(trim(text)) < 20 AS needs_ocr FROM pg")
def page_flags(s: Source) -> DataFrame:
    return pages(s).select("doc_id", "page_no", F.octet_length("text").cast("long").alias("text_len"), (F.octet_length(F.trim("text")) < 20).alias("needs_ocr"))


@query("agg15_scanned", f", {_PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE strlen(trim(text)) < 20) AS bad, count(*) FILTER (WHERE strlen(trim(text)) < 20) >= greatest(1, 0.2 * count(*)) AS is_scanned FROM pg GROUP BY doc_id")
def scanned(s: Source) -> DataFrame:
    bad = F.count_if(F.octet_length(F.trim("text")) < 20)
    return pages(s).groupBy("doc_id").agg(F.count("*").alias("n_pages"), bad.alias("bad"), (bad >= F.greatest(F.lit(1.0), 0.2 * F.count("*"))).alias("is_scanned"))


@query("src7_hash_ingest", "SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def ingest(s: Source) -> DataFrame:
    """One row for each content, the first of its ids."""
    return s.table("documents").where("text is not null").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("cor1_page_windows", "SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(least(first + 3, n) AS INTEGER) AS last, CAST(least(first + 4, n) AS INTEGER) AS context_last FROM (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS first FROM (SELECT doc_id, max(page_no) AS n FROM lines GROUP BY doc_id))")
def page_windows(s: Source) -> DataFrame:
    """Four pages of its own and one of context for each window."""
    n = s.lines().groupBy("doc_id").agg(F.max("page_no").alias("n"))
    w = n.select("doc_id", "n", F.explode(F.sequence(F.lit(1), "n", F.lit(4))).alias("first"))
    return w.select("doc_id", "first", F.least(C("first") + 3, "n").alias("last"), F.least(C("first") + 4, "n").alias("context_last"))


def segmented(s: Source) -> DataFrame:
    lines = s.lines().where(F.trim("line") != "")
    return windows.segments(lines, ["doc_id"], ["line_no"], C("line").rlike(START))


@query("win12_cor2_candidates", f""", g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{START}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seg FROM lines WHERE trim(line) <> '')
    SELECT doc_id, CAST(seg AS BIGINT) AS segment, min(page_no) AS page_start, max(page_no) AS page_end, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS input_hash FROM g WHERE seg > 0 GROUP BY ALL""")
def candidates(s: Source) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    g = segmented(s).groupBy("doc_id", "segment").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("raw"))
    return g.select("doc_id", "segment", "page_start", "page_end", F.sha2("raw", 256).alias("input_hash"))


@query("win13_drop_repeats", """, l AS (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines) SELECT doc_id, count(*) AS n_lines FROM l WHERE NOT (line IS NOT DISTINCT FROM before AND strlen(trim(line)) >= 4) GROUP BY doc_id""")
def no_repeats(s: Source) -> DataFrame:
    return windows.drop_repeats(s.lines(), ["doc_id"], ["line_no"], "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("str1_clean_text", r"""SELECT doc_id, sha256(replace(array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1] OR strlen(trim(x)) < 4), chr(10)), '　', ' ')) AS cleaned FROM (SELECT doc_id, list_transform(string_split(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(10)),
    lambda x: CASE WHEN regexp_matches(rtrim(regexp_replace(x, '[ \t]+', ' ', 'g')), '^\s*(第\s*\d+\s*页|[-—–]?\s*\d+\s*[-—–]?|Page\s*\d+)\s*$') THEN '' ELSE rtrim(regexp_replace(x, '[ \t]+', ' ', 'g')) END) AS k
    FROM (SELECT doc_id, '第 ' || doc_id || ' 页' || chr(10) || coalesce(text, '') || chr(10) || ' 同一 行　 ' || chr(9) || ' x' || chr(10) || '同一 行　 x' || chr(10) || '- 3 -' || chr(10) || 'end' || chr(10) || 'end' AS t FROM documents))""")
def cleaned(s: Source) -> DataFrame:
    """Documents between page numbers, repeats and odd blanks."""
    t = F.concat(F.lit("第 "), C("doc_id").cast("string"), F.lit(" 页\n"), F.coalesce("text", F.lit("")), F.lit("\n 同一 行　 \t x\n同一 行　 x\n- 3 -\nend\nend"))
    return s.table("documents").select("doc_id", F.sha2(text.clean_page(t), 256).alias("cleaned"))


@query("str2_hsh1_hsh2_normalise", r"SELECT doc_id, sha256(lower(regexp_replace(text, '[ \t\n\r]', '', 'g'))) AS full_hash, substr(sha256(text), 1, 32) AS hash16 FROM documents")
def normalised(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", F.sha2(text.normalize(C("text")), 256).alias("full_hash"), text.hash16(C("text")).alias("hash16"))


_HASHED = r"h AS (SELECT d.doc_id, sha256(lower(regexp_replace(coalesce(text, ''), '[ \t\n\r]', '', 'g'))) AS k, coalesce(quality, 1) AS answer FROM documents d LEFT JOIN labels USING (doc_id))"


def hashed(s: Source) -> DataFrame:
    d = s.table("documents").join(s.table("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.sha2(text.normalize(F.coalesce("text", F.lit(""))), 256).alias("k"), F.coalesce("quality", F.lit(1)).alias("answer"))


@query("cor3_hash_dedup", f", {_HASHED} SELECT min(doc_id) AS doc_id, k, count(*) AS copies FROM h GROUP BY k")
def hash_dedup(s: Source) -> DataFrame:
    return hashed(s).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("cor6_cor8_join22_triage", f""", {_HASHED}, f AS (SELECT k, min(doc_id) AS first_id, arg_min(answer, doc_id) AS first_answer FROM h GROUP BY k)
    SELECT doc_id, first_id AS question_id, CASE WHEN doc_id = first_id THEN 'new' WHEN answer = first_answer THEN 'duplicate' ELSE 'conflict' END AS status FROM h JOIN f USING (k)""")
def triage(s: Source) -> DataFrame:
    """The first of equal texts is new; later ones are duplicates, or conflicts if their answer differs. The firsts come
    from a grouped minimum, so copies within a batch see one another and a large group of copies meets no window."""
    h = stored(hashed(s), "hashes")  # each text is hashed once
    first = h.groupBy("k").agg(F.min(F.struct("doc_id", "answer")).alias("f"))
    status = F.when(C("doc_id") == C("f.doc_id"), "new").when(C("answer") == C("f.answer"), "duplicate").otherwise("conflict")
    return h.join(first, "k").select("doc_id", C("f.doc_id").alias("question_id"), status.alias("status"))


@query("cor4_cor5_flt11_validation", """SELECT question_id, array_to_string(list_filter([CASE WHEN length(stem) < 11 THEN 'STEM_SHORT' END, CASE WHEN type IN ('single_choice', 'multiple_choice', 'true_false') AND NOT regexp_matches(options_json, '"key":"[^" ]+","content":"[^" ]+"') THEN 'OPTIONS_REQUIRED' END,
    CASE WHEN NOT regexp_matches(coalesce(answer_json, ''), '"[^" ]+"') THEN 'ANSWER_INVALID' END], lambda x: x IS NOT NULL), ',') AS issues FROM questions""")
def validation(s: Source) -> DataFrame:
    issues = F.array_compact(F.array(
        F.when(F.char_length("stem") < 11, "STEM_SHORT"), F.when(~playable(answer=False), "OPTIONS_REQUIRED"), F.when(~playable(options=False), "ANSWER_INVALID"),
    ))
    return s.questions().select("question_id", F.array_join(issues, ",").alias("issues"))


@query("set3_cor9_coverage", """, c AS (SELECT document_id, question_no, count(*) AS n FROM directory WHERE content_role = 'question' GROUP BY ALL), a AS (SELECT document_id, question_no, count(*) AS m FROM directory WHERE content_role = 'answer' GROUP BY ALL)
    SELECT document_id, question_no, unnest(range(1, n - coalesce(m, 0) + 1)) AS n FROM c LEFT JOIN a USING (document_id, question_no) WHERE n > coalesce(m, 0)""")
def coverage(s: Source) -> DataFrame:
    """Printed numbers without a catalogue entry, each as often as it is missing."""
    d = s.directory()
    return sets.multiset_difference(d.where("content_role = 'question'"), d.where("content_role = 'answer'"), ["document_id", "question_no"])


_PRINTED = ("{n}. ", "{n}.5 ", " {n}、《", "{n}（", "{n} ", "12{n}, ")


@query("str16_printed_markers", rf"""SELECT doc_id, CAST(len(m) AS INTEGER) AS n_markers, CAST(list_sum(list_transform(m, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM (SELECT doc_id, list_filter(regexp_extract_all(t, '(?m)^\s*([0-9]{{1,3}})\s*(?:[.、,，]\s+|[.、,，]《|[《（(])', 1), lambda x: CAST(x AS INTEGER) > 0) AS m
    FROM (SELECT doc_id, string_agg(replace([{", ".join(f"'{x}'" for x in _PRINTED)}][line_no % {len(_PRINTED)} + 1], '{{n}}', CAST(line_no AS VARCHAR)) || regexp_replace(line, '^[^a-zA-Z]+', ''), chr(10) ORDER BY line_no) AS t FROM lines GROUP BY doc_id))""")
def markers(s: Source) -> DataFrame:
    """Numbers printed before the lines of each document, in six spellings, three of which are markers."""
    mark = F.replace(F.get(F.array(*map(F.lit, _PRINTED)), (C("line_no") % len(_PRINTED)).cast("int")), F.lit("{n}"), C("line_no").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.concat(mark, F.regexp_replace("line", "^[^a-zA-Z]+", "")).alias("x"))))  # one document's
    d = s.lines().groupBy("doc_id").agg(text.printed_markers(F.array_join(F.transform(rows, lambda r: r["x"]), "\n")).alias("m"))
    return d.select("doc_id", F.size("m").alias("n_markers"), F.when(F.size("m") > 0, F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query("cor16_window_conservation", """, e AS (SELECT document_id, page_start // 4 AS w, section_scope, question_no FROM candidates), r AS (SELECT document_id, page_start // 4 AS w, section_scope, question_no FROM answers)
    SELECT document_id, w, count(*) FILTER (WHERE side = 'missing') AS missing, count(*) FILTER (WHERE side = 'unknown') AS unknown, CASE WHEN count(*) FILTER (WHERE side = 'unknown') > 0 THEN 'SOURCE_ID_MISMATCH' ELSE 'REREAD' END AS issue
    FROM (SELECT DISTINCT *, 'missing' AS side FROM e ANTI JOIN r USING (document_id, w, section_scope, question_no) UNION ALL SELECT DISTINCT *, 'unknown' FROM r ANTI JOIN e USING (document_id, w, section_scope, question_no)) GROUP BY ALL""")
def conservation(s: Source) -> DataFrame:
    """Windows of four pages whose returned identities are not the expected ones: missing ones are read again, unknown ones are an issue."""
    k = ["document_id", "w", "section_scope", "question_no"]
    e, r = (d.withColumn("w", F.floor(C("page_start") / 4)).select(*k).distinct() for d in (s.candidates(), s.answers()))
    both = e.join(r, k, "left_anti").withColumn("side", F.lit("missing")).unionByName(r.join(e, k, "left_anti").withColumn("side", F.lit("unknown")))
    unknown = F.count_if(C("side") == "unknown")
    return both.groupBy("document_id", "w").agg(F.count_if(C("side") == "missing").alias("missing"), unknown.alias("unknown"), F.when(unknown > 0, "SOURCE_ID_MISMATCH").otherwise("REREAD").alias("issue"))


@query("cor11_history_recovery", f""", {_HASHED}, best AS (SELECT k, arg_min(doc_id, (-n, doc_id)) AS source_id FROM (SELECT h.k, h.doc_id, count(l.line_no) AS n FROM h JOIN lines l USING (doc_id) GROUP BY ALL) GROUP BY k)
    SELECT h.doc_id, source_id FROM h JOIN best USING (k) WHERE h.doc_id <> source_id""".replace("arg_min(doc_id, (-n, doc_id))", "(list(doc_id ORDER BY n DESC, doc_id))[1]"))
def history(s: Source) -> DataFrame:
    """For each document the richest earlier import of the same content."""
    h = hashed(s)
    n = s.lines().groupBy("doc_id").agg(F.count("*").alias("n"))
    best = h.join(n, "doc_id").groupBy("k").agg(F.max(F.struct("n", (-C("doc_id")).alias("m"))).alias("b")).select("k", (-C("b.m")).alias("source_id"))
    return h.join(best, "k").where("doc_id <> source_id").select("doc_id", "source_id")


@query("cor14_span_dedup", "SELECT document_id, content_role, page_start, page_end, min(id) AS id, count(*) AS copies FROM directory WHERE set_no > 0 GROUP BY document_id, content_role, page_start, page_end")
def spans(s: Source) -> DataFrame:
    """Active spans (those of a set) by what they cover; of equal ones the first stays."""
    return s.directory().where("set_no > 0").groupBy("document_id", "content_role", "page_start", "page_end").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@query("cor15_provenance", """, d AS (SELECT document_id // 5 AS document_id, question_no, list({'id': id, 'page_start': page_start, 'page_end': page_end} ORDER BY id) AS spans FROM directory GROUP BY ALL)
    SELECT c.id, d.spans IS NOT NULL AS has_origin, coalesce(to_json(spans), '[]') AS spans FROM candidates c LEFT JOIN d USING (document_id, question_no)""".replace("coalesce(to_json(spans), '[]')", "coalesce(CAST(to_json(spans) AS VARCHAR), '[]')"))
def provenance(s: Source) -> DataFrame:
    """Each candidate with the spans that its place in the directory has, nested in order."""
    d = s.directory().groupBy(F.floor(C("document_id") / 5).alias("document_id"), "question_no").agg(F.sort_array(F.collect_list(F.struct("id", "page_start", "page_end"))).alias("spans"))
    j = s.candidates().select("id", "document_id", "question_no").join(d, ["document_id", "question_no"], "left")
    return j.select("id", C("spans").isNotNull().alias("has_origin"), F.coalesce(F.to_json("spans"), F.lit("[]")).alias("spans"))


@query("cor12_agg27_state_audit", """, n AS (SELECT o_orderkey, count(l_orderkey) AS counted, count(*) FILTER (WHERE l_linenumber <= 4) AS stored FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), t AS (SELECT max(o_orderdate) - INTERVAL 730 DAY AS cut FROM orders)
    SELECT 'counter' AS fault, o_orderkey AS id, counted AS found, stored AS held FROM n WHERE counted <> stored UNION ALL SELECT 'stale_run', o_orderkey, 0, 0 FROM orders, t WHERE o_orderstatus = 'P' AND o_orderdate < cut""")
def audit(s: Source) -> DataFrame:
    """Stored counters (of an earlier state: lines up to the fourth) that rows no longer give, and runs still open long after they began."""
    n = s.table("lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("found"), F.count_if(C("l_linenumber") <= 4).alias("held"))
    o = s.table("orders")
    counters = o.select("o_orderkey").join(n, "o_orderkey", "left").select(F.lit("counter").alias("fault"), C("o_orderkey").alias("id"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("held", F.lit(0)).alias("held")).where("found <> held")
    cut = F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 730 DAYS")).alias("cut")))  # one row
    stale = o.where("o_orderstatus = 'P'").join(cut).where("o_orderdate < cut").select(F.lit("stale_run").alias("fault"), C("o_orderkey").alias("id"), F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("held"))
    return counters.unionByName(stale)


@query("cor18_job_metrics", """SELECT l_orderkey AS job, count(*) AS expected, count(*) FILTER (WHERE l_linestatus = 'F') AS complete, count(*) FILTER (WHERE l_returnflag = 'R') AS issues, CASE WHEN count(*) = count(*) FILTER (WHERE l_linestatus = 'F') AND count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'draft_ready' WHEN count(*) FILTER (WHERE l_linestatus = 'F') = 0 THEN 'failed' ELSE 'needs_attention' END AS state FROM lineitem GROUP BY l_orderkey""")
def job_metrics(s: Source) -> DataFrame:
    """Units of each job by status: ready when all are complete and none has an issue, failed when none is complete."""
    done, issues = F.count_if(C("l_linestatus") == "F"), F.count_if(C("l_returnflag") == "R")
    state = F.when((F.count("*") == done) & (issues == 0), "draft_ready").when(done == 0, "failed").otherwise("needs_attention")
    return s.table("lineitem").groupBy(C("l_orderkey").alias("job")).agg(F.count("*").alias("expected"), done.alias("complete"), issues.alias("issues"), state.alias("state"))


@query("cor19_cor20_upsert", "SELECT section_scope, question_no, arg_max(value, id) AS value, max(confidence) FILTER (WHERE confidence > 0) AS confidence, count(*) AS revisions FROM answers GROUP BY ALL")
def upsert(s: Source) -> DataFrame:
    """The last value wins, a blank confidence keeps the best before, every write is a revision."""
    return s.answers().groupBy("section_scope", "question_no").agg(F.max_by("value", "id").alias("value"), F.max(F.when(C("confidence") > 0, C("confidence"))).alias("confidence"), F.count("*").alias("revisions"))


@query("cor13_default_subject", "SELECT p_partkey % 25 AS bank_id, (list(p_brand ORDER BY p_size, p_partkey))[1] AS subject FROM part GROUP BY 1")
def default_subject(s: Source) -> DataFrame:
    """The first subject of a bank by its place (here the size), then id."""
    return s.table("part").groupBy((C("p_partkey") % 25).alias("bank_id")).agg(F.min_by("p_brand", F.struct("p_size", "p_partkey")).alias("subject"))


_CHECKED = """c AS (SELECT question_id, bank_id, stem, unnest(list_filter([CASE WHEN length(stem) < 11 THEN 'STEM' END, CASE WHEN type IN ('single_choice', 'multiple_choice', 'true_false') AND NOT regexp_matches(options_json, '"key":"[^" ]+","content":"[^" ]+"') THEN 'OPTIONS_REQUIRED' END, CASE WHEN NOT regexp_matches(coalesce(answer_json, ''), '"[^" ]+"') THEN 'ANSWER_INVALID' END, ''], lambda x: x IS NOT NULL)) AS issue FROM questions)"""


def checked(s: Source) -> DataFrame:
    """Questions with the issues that block them; "" stands for the question itself."""
    issues = F.array_compact(F.array(F.when(F.char_length("stem") < 11, "STEM"), F.when(~playable(answer=False), "OPTIONS_REQUIRED"), F.when(~playable(options=False), "ANSWER_INVALID"), F.lit("")))
    return s.questions().select("question_id", "bank_id", "stem", F.explode(issues).alias("issue"))


@query("cor23_preview", f""", {_CHECKED}, b AS (SELECT bank_id, count(*) FILTER (WHERE issue <> '') AS blocking FROM c GROUP BY bank_id) SELECT question_id, issue, blocking = 0 AS can_commit, CASE WHEN blocking = 0 THEN 'verified' ELSE 'open' END AS coverage FROM c JOIN b USING (bank_id) WHERE issue <> ''""")
def preview(s: Source) -> DataFrame:
    """Each issue of a draft with its candidate, and whether its bank could be committed."""
    c = checked(s)
    b = c.groupBy("bank_id").agg(F.count_if(C("issue") != "").alias("blocking"))
    j = c.where("issue <> ''").join(b, "bank_id")
    return j.select("question_id", "issue", (C("blocking") == 0).alias("can_commit"), F.when(C("blocking") == 0, "verified").otherwise("open").alias("coverage"))


@query("cor22_draft_commit", rf""", {_CHECKED}, g AS (SELECT bank_id, count(*) FILTER (WHERE issue = '') AS n, count(DISTINCT question_id) FILTER (WHERE issue <> '') AS bad FROM c GROUP BY bank_id), q AS (SELECT question_id, bank_id, sha256(lower(regexp_replace(stem, '[ \t\n\r]', '', 'g'))) AS h FROM c WHERE issue = ''),
    ok AS (SELECT q.* FROM q JOIN g USING (bank_id) WHERE bad * 10 <= n * 9), f AS (SELECT h, min(question_id) AS first FROM ok GROUP BY h) SELECT question_id, first AS persisted_as, CASE WHEN question_id = first THEN 'persisted' ELSE 'duplicate' END AS state FROM ok JOIN f USING (h)""")
def commit(s: Source) -> DataFrame:
    """Banks whose blocked questions are at most nine in ten are committed: the first of equal stems in all of them is persisted, later ones are its duplicates."""
    c = checked(s)
    g = c.groupBy("bank_id").agg(F.count_if(C("issue") == "").alias("n"), F.count_distinct(F.when(C("issue") != "", C("question_id"))).alias("bad")).where("bad * 10 <= n * 9")
    ok = c.where("issue = ''").join(g, "bank_id").select("question_id", F.sha2(text.normalize(C("stem")), 256).alias("h"))
    f = ok.groupBy("h").agg(F.min("question_id").alias("persisted_as"))
    return ok.join(f, "h").select("question_id", "persisted_as", F.when(C("question_id") == C("persisted_as"), "persisted").otherwise("duplicate").alias("state"))


_SPELLED = tuple(x for alias in TYPE_ALIASES for x in (alias, f" {alias.upper().replace('_', '-')} "))


@query("str28_canonical_type", f"""SELECT p_partkey, CASE {' '.join(f"WHEN x IN ({', '.join(repr(a) for a in [k for k, v in TYPE_ALIASES.items() if v == kind])}) THEN '{kind}'" for kind in dict.fromkeys(TYPE_ALIASES.values()))} ELSE x END AS question_type FROM (SELECT p_partkey, replace(replace(lower(trim([{', '.join(repr(x) for x in _SPELLED)}, 'Other', 'x-y z'][p_partkey % {len(_SPELLED) + 2} + 1])), '-', '_'), ' ', '') AS x FROM part)""")
def types(s: Source) -> DataFrame:
    """Every alias in two spellings, and two that are none."""
    raw = F.get(F.array(*map(F.lit, (*_SPELLED, "Other", "x-y z"))), (C("p_partkey") % (len(_SPELLED) + 2)).cast("int"))
    return s.table("part").select("p_partkey", text.canonical_type(raw).alias("question_type"))


_WRITTEN = ("《{s}》（A·{n}）；x", "{s} : {n}，Y", "【{s}】{n}/ z。", "〈{s}〉•{n}　w", "{s}{n}")


def written(template: Column, word: Column, number: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{s}"), word), F.lit("{n}"), number.cast("string"))


@query("str4_str5_str13_keys", rf"""SELECT p_partkey, lower(regexp_replace(translate(x, '（）【】：，。；／·•', '()[]:,.;/'), '[\s　]', '', 'g')) AS compact, lower(regexp_replace(translate(x, '（）【】：，。；／·•', '()[]:,.;/'), '[\s　《》〈〉()\[\]:,.;]', '', 'g')) AS scope_key, regexp_replace(x, '[\s　]', '', 'g') AS name_key
    FROM (SELECT p_partkey, replace(replace([{', '.join(f"'{x}'" for x in _WRITTEN)}][p_partkey % {len(_WRITTEN)} + 1], '{{s}}', p_name), '{{n}}', CAST(p_partkey AS VARCHAR)) AS x FROM part)""")
def keys(s: Source) -> DataFrame:
    raw = written(F.get(F.array(*map(F.lit, _WRITTEN)), (C("p_partkey") % len(_WRITTEN)).cast("int")), C("p_name"), C("p_partkey"))
    return s.table("part").select("p_partkey", text.compact(raw).alias("compact"), text.scope_key(raw).alias("scope_key"), text.name_key(raw).alias("name_key"))


_PARTS = (("参考答案及解析·专题一教育法", "专题二", "答案及解析：专题3 教师 法", "教师法", "Part A"), ("单项选择题", "教师法", "专题十 学生", "判断题（一）"), ("选择题", "教师法", "其他", "/学生", "答案速查", "论 述 题", ""))


@query("str8_section_scope", rf"""SELECT p_partkey, array_to_string(list_filter(k, lambda v, i: i = 1 OR k[i - 1] <> v), '/') AS scope FROM (SELECT p_partkey, list_filter(list_transform(p, lambda x: regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(translate(x, '（）【】：，。；／·•', '()[]:,.;/'), '\s', '', 'g')), '^(参考答案及解析|答案及解析|参考答案|答案解析)', ''), '^[:：/·-]+', ''), '^专题[一二三四五六七八九十百千万0-9]+(.+)$', '\1')),
    lambda v: v <> '' AND NOT regexp_matches(v, '单项选择|单选题|多项选择|多选题|判断题|填空题|简答题|主观题|案例分析题|辨析题|论述题') AND v NOT IN ('选择题', '单选', '多选', '答案速查', '答案速查表')) AS k
    FROM (SELECT p_partkey, [{', '.join(f"[{', '.join(repr(x) for x in part)}][(p_partkey // {d}) % {len(part)} + 1]" for part, d in zip(_PARTS, (1, 5, 20)))}] AS p FROM part))""")
def scopes(s: Source) -> DataFrame:
    """Section paths of question and answer books under one scope."""
    part = lambda words, d: F.get(F.array(*map(F.lit, words)), (F.floor(C("p_partkey") / d) % len(words)).cast("int"))
    return s.table("part").select("p_partkey", text.section_scope(F.array(*(part(w, d) for w, d in zip(_PARTS, (1, 5, 20), strict=True)))).alias("scope"))


@query("set5_set6_arrays", """, w AS (SELECT question_id, string_split(stem || ' ', ' ') AS a, [' red', subject, '', chapter] AS b FROM questions), i AS (SELECT user_id, question_id, min(attempt_id) AS first FROM attempts GROUP BY ALL), ids AS (SELECT user_id, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY first) AS ids FROM i GROUP BY user_id)
    SELECT question_id AS id, 'points' AS kind, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(a, b), lambda x: trim(x)), lambda x: x <> ''))), ',') AS joined FROM w UNION ALL SELECT user_id, 'tried', ids FROM ids""")
def arrays(s: Source) -> DataFrame:
    """Two lists of points as one, trimmed, without repeats, sorted; and the questions each user has tried in the order of first tries."""
    q = s.questions().select(C("question_id").alias("id"), F.lit("points").alias("kind"), F.array_join(sets.sorted_union(F.split(F.concat("stem", F.lit(" ")), " ", -1), F.array(F.lit(" red"), "subject", F.lit(""), "chapter")), ",").alias("joined"))
    tried = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("attempt_id", "question_id"))), lambda r: r["question_id"].cast("string")))  # one user's
    return q.unionByName(s.attempts().groupBy(C("user_id").alias("id")).agg(F.lit("tried").alias("kind"), F.array_join(tried, ",").alias("joined")))


def coordinate(entries: DataFrame, sections: DataFrame, pages: DataFrame, window: int = 4) -> DataFrame:
    """Every entry (id, document_id, w, place, section_id, content_role, set_no, question_type, question_no, page_start, page_end) with its identity and the issue that
    keeps it out, null for those accepted: its section is unknown; it is a question on a page of answers, or on a blank, cover or index; its
    number, pages or role don't fit its window; another entry before it has its identity on other pages. Repeats of an accepted identity on the same pages go.

    Headings of entries without a scope of their own come from the last heading of their document and role before them."""
    j = entries.join(sections, ["document_id", "section_id"], "left").join(pages.select("document_id", C("page").alias("page_start"), "page_role"), ["document_id", "page_start"], "left")
    low, high = C("w") * window + 1, C("w") * window + window
    implicit = (C("content_role") == "question") & (text.canonical_type(C("question_type")) == "subjective")
    misfit = ((C("question_no") <= 0) & ~implicit) | (C("page_start") < low) | (C("page_start") > high) | (C("page_end") < C("page_start")) | (C("page_end") > high + 1) | ~C("content_role").isin("question", "answer", "explanation")
    refused = (C("content_role") == "question") & F.lower(F.trim(F.coalesce("page_role", F.lit("")))).isin("answer", "explanation", "blank", "cover", "index")
    issue = F.when(C("scope").isNull(), "CATALOG_SECTION_MISSING").when(refused, "DIRECTORY_ROLE_MISMATCH").when(misfit, "SOURCE_ID_MISMATCH")
    j = j.withColumn("issue", issue)
    stream = F.when(C("content_role") == "question", "question").otherwise("answer")
    carried = F.last(F.nullif("scope", F.lit("")), True).over(W.partitionBy("document_id", stream).orderBy("w", "place").rowsBetween(W.unboundedPreceding, W.currentRow))  # one document's headings
    good = j.where("issue is null").withColumn("scope", F.coalesce(carried, F.lit("")))
    good = good.withColumn("identity", F.concat_ws("|", "scope", "content_role", C("set_no").cast("string"), "question_type", C("question_no").cast("string")))
    first = good.groupBy("document_id", "identity").agg(F.min(F.struct("w", "place", "id", "page_start", "page_end")).alias("f"))
    k = good.join(first, ["document_id", "identity"])
    same = (C("page_start") == C("f.page_start")) & (C("page_end") == C("f.page_end"))
    k = k.withColumn("issue", F.when((C("id") != C("f.id")) & ~same, "DUPLICATE_SOURCE_IDENTITY")).where((C("id") == C("f.id")) | C("issue").isNotNull())
    return k.select("id", "document_id", "identity", "issue").unionByName(j.where("issue is not null").select("id", "document_id", F.lit(None).cast("string").alias("identity"), "issue"))


def catalogue(s: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, sections and page roles of forty documents' catalogues, from part."""
    k, start = C("p_partkey"), F.floor(C("p_partkey") / 40) % 12 + 1
    role = F.get(F.array(*map(F.lit, ("question", "question", "answer", "explanation", "note"))), (C("p_size") % 5).cast("int"))
    kind = F.get(F.array(F.lit("single"), F.lit("essay")), (k % 2).cast("int"))
    entries = s.table("part").select(
        k.alias("id"), (k % 40).alias("document_id"), F.floor((start - 1 + F.when(k % 11 == 0, 4).otherwise(0)) / 4).alias("w"), k.alias("place"), (C("p_size") % 7).alias("section_id"), role.alias("content_role"), (C("p_size") % 2).alias("set_no"), kind.alias("question_type"),
        (F.floor(k / 40) % 6).alias("question_no"), start.alias("page_start"), (start + F.when(k % 13 == 0, 7).otherwise(k % 2)).alias("page_end"),
    )
    ids = s.table("part").select((C("p_partkey") % 40).alias("document_id")).distinct()
    sections = ids.select("document_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("section_id")).withColumn("scope", F.when(C("section_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), C("section_id").cast("string"))))
    page_roles = F.get(F.array(*map(F.lit, ("question", "question", " Answer ", "blank", "question"))), ((C("document_id") + C("page")) % 5).cast("int"))
    pages = ids.select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("page")).withColumn("page_role", page_roles)
    return entries, sections, pages


_COORDINATED = """e AS (SELECT p_partkey AS id, p_partkey % 40 AS document_id, (((p_partkey // 40) % 12) + CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 0 END) // 4 AS w, p_size % 7 AS section_id, ['question', 'question', 'answer', 'explanation', 'note'][p_size % 5 + 1] AS role, p_size % 2 AS set_no, ['single', 'essay'][p_partkey % 2 + 1] AS kind,
    (p_partkey // 40) % 6 AS no, (p_partkey // 40) % 12 + 1 AS p1, (p_partkey // 40) % 12 + 1 + CASE WHEN p_partkey % 13 = 0 THEN 7 ELSE p_partkey % 2 END AS p2 FROM part),
  c AS (SELECT *, CASE WHEN section_id < 6 THEN CASE WHEN section_id % 3 = 0 THEN '' ELSE 's' || section_id END END AS scope, ['question', 'question', 'answer', 'blank', 'question'][(document_id + p1) % 5 + 1] AS page_role FROM e),
  i AS (SELECT *, CASE WHEN scope IS NULL THEN 'CATALOG_SECTION_MISSING' WHEN role = 'question' AND page_role IN ('answer', 'blank') THEN 'DIRECTORY_ROLE_MISMATCH'
    WHEN no <= 0 AND NOT (role = 'question' AND kind = 'essay') OR p1 < w * 4 + 1 OR p1 > w * 4 + 4 OR p2 < p1 OR p2 > w * 4 + 5 OR role = 'note' THEN 'SOURCE_ID_MISMATCH' END AS issue FROM c),
  g AS (SELECT *, coalesce(last_value(nullif(scope, '') IGNORE NULLS) OVER (PARTITION BY document_id, role = 'question' ORDER BY w, id ROWS UNBOUNDED PRECEDING), '') AS carried FROM i WHERE issue IS NULL),
  n AS (SELECT *, carried || '|' || role || '|' || set_no || '|' || kind || '|' || no AS identity FROM g),
  f AS (SELECT *, row_number() OVER x AS k, first_value(p1) OVER x AS f1, first_value(p2) OVER x AS f2 FROM n WINDOW x AS (PARTITION BY document_id, identity ORDER BY w, id)),
  coordinated AS (SELECT id, document_id, identity, CASE WHEN k > 1 THEN 'DUPLICATE_SOURCE_IDENTITY' END AS issue FROM f WHERE k = 1 OR p1 <> f1 OR p2 <> f2 UNION ALL SELECT id, document_id, NULL, issue FROM i WHERE issue IS NOT NULL)"""


@query("cor10_cor17_coordination", f", {_COORDINATED} SELECT id, document_id, identity, issue FROM coordinated")
def coordinated(s: Source) -> DataFrame:
    return coordinate(*catalogue(s))


@query("lnk22_directory_rebuild", f""", {_COORDINATED}, stored AS (SELECT p_partkey + 1000000 AS id, p_partkey % 40 AS document_id, 'old|' || p_brand AS identity FROM part WHERE p_size % 4 = 0),
    r AS (SELECT id, document_id, identity FROM coordinated WHERE issue IS NULL AND document_id % 6 <> 5),
    a AS (SELECT * FROM stored ANTI JOIN r USING (document_id, identity) WHERE document_id IN (SELECT document_id FROM r) QUALIFY row_number() OVER (PARTITION BY document_id, identity ORDER BY id) = 1)
    SELECT id, document_id, identity FROM r UNION ALL SELECT id, document_id, identity FROM a""")
def rebuilt(s: Source) -> DataFrame:
    """A directory made anew from the units' outputs: documents with a unit that isn't complete (every sixth) are left alone; entries are coordinated; rows of an
    earlier, verified import fill places that the new ones don't have, the first of equals only."""
    entries, sections, page_roles = catalogue(s)
    fresh = coordinate(entries.where("document_id % 6 <> 5"), sections, page_roles).where("issue is null").drop("issue")
    stored = s.table("part").where("p_size % 4 = 0").select((C("p_partkey") + 1_000_000).alias("id"), (C("p_partkey") % 40).alias("document_id"), F.concat(F.lit("old|"), "p_brand").alias("identity"))
    more = stored.join(fresh.select("document_id").distinct(), "document_id", "left_semi").join(fresh, ["document_id", "identity"], "left_anti")
    return fresh.unionByName(more.groupBy("document_id", "identity").agg(F.min("id").alias("id")).select("id", "document_id", "identity"))


@query("win1_win2_renumber", "SELECT id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_start, marker_top, id) AS INTEGER) AS seq FROM directory")
def renumber(s: Source) -> DataFrame:
    return windows.renumber(s.directory(), ["document_id"], ["page_start", "marker_top", "id"], "seq").select("id", "seq")
