"""Queries over filing texts built from the documents, with their SQL counterparts.

Every document becomes one filing: a table of contents, the whole text as
Item 1, again under a risk heading as Item 1A, and as bullets in Item 7. The
source is the company, the language the form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import changes as CH
from tallyfold.operators import filings as FL
from tallyfold.operators import sections as X
from tallyfold.operators import text_index as TI
from tallyfold.plans import jobs
from tallyfold.plans import mapping as MP

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


TOC = "Table of Contents\nItem 1. Business 3\nItem 1A. Risk Factors 9\nItem 7. Management's Discussion and Analysis 20\n\n"
H1, H1A, H7 = "## Item 1. Business\n\n", "\n\n## Item 1A. Risk Factors\n\nRisks related to ", "\nItem 7. Management's Discussion and Analysis\n\nOverview:\n- "


def texts(spark, d, led: bool = False):
    """``led``: every text begins with a sentence of its own, so that its first line has one."""
    docs = MP.table(spark, d, "documents")
    if led:
        docs = docs.withColumn("text", F.concat(F.lit("Note "), "doc_id", F.lit(". "), "text"))
    body = F.concat(
        F.lit(TOC + H1), c("text"), F.lit(H1A), c("source"), F.lit(":\n"), c("text"), F.lit(H7),
        F.replace(c("text"), F.lit("\n"), F.lit("\n- ")))
    return docs.select(
        F.concat_ws("-", F.substring(F.lpad(c("doc_id").cast("string"), 10, "0"), 1, 4), F.substring(F.lpad(c("doc_id").cast("string"), 10, "0"), 5, 6)).alias("accession_number"),
        c("source").alias("cik"), c("lang").alias("form_type"),
        F.date_add(F.lit("2000-01-01").cast("date"), c("n_chars").cast("int")).alias("filing_date"), body.alias("markdown"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


T_SQL = f"""txt as (select lpad(cast(doc_id as varchar), 10, '0')[1:4] || '-' || lpad(cast(doc_id as varchar), 10, '0')[5:10] as accession_number,
  source as cik, lang as form_type, date '2000-01-01' + cast(n_chars as integer) as filing_date, text as raw,
  {q(TOC + H1)} || text || {q(H1A)} || source || {q(':' + chr(10))} || text || {q(H7)} || replace(text, chr(10), chr(10) || '- ') as md from documents)"""
# The heading pattern in this engine's dialect; no other text of the filings can match it.
RE = r"(?im)^(?:#{1,6}\s*)?(item\s+(\d+(?:\.\d+)?[a-z]?)\.?(?:\s+([^\n]+?))?)\s*$"
SP = "regexp_replace({0}, '\\s+', ' ', 'g')"
WS = "chr(32) || chr(10) || chr(9) || chr(13)"
S_SQL = f"""{T_SQL},
pp as (select accession_number, cik, string_split(regexp_replace(md, '{RE}', chr(1) || '\\0', 'g'), chr(1)) as parts from txt),
hh as (select accession_number, cik, parts, i, parts[i] as part, upper(regexp_extract(parts[i], '{RE}', 2)) as code
  from (select *, unnest(range(2, len(parts) + 1)) as i from pp)),
kk as (select *, coalesce(lead(i) over (partition by accession_number order by i), len(parts) + 1) as j from (
  select *, max(i) over (partition by accession_number, code) as last_i from hh) where i = last_i),
ss as (select accession_number, cik, row_number() over (partition by accession_number order by i) as position, code as item_code,
  trim({SP.format(f"regexp_extract(part, '{RE}', 1)")}) as heading,
  nullif(trim(regexp_replace(trim({SP.format(f"regexp_extract(part, '{RE}', 3)")}, ' .:-'), '\\s+\\d+$', '')), '') as title,
  length(array_to_string(parts[1:i-1], '')) as start,
  length(array_to_string(parts[1:i-1], '')) - length(replace(array_to_string(parts[1:i-1], ''), chr(10), '')) + 1 as line_number,
  trim(array_to_string(parts[i:j-1], ''), {WS}) as content,
  trim(substr(array_to_string(parts[i:j-1], ''), length(regexp_extract(part, '{RE}', 0)) + 1), {WS}) as body from kk)"""


def short_sql(x: str, n: int) -> str:
    return (f"(case when length(trim({SP.format(x)})) <= {n} then trim({SP.format(x)}) "
            f"else rtrim(substr(trim({SP.format(x)}), 1, {n - 3})) || '...' end)")


@query("t1_sections", f"""with {S_SQL} select accession_number, position, item_code, heading, title, start, line_number,
  length(content) as text_length, md5(content) as content_md5, md5(body) as body_md5 from ss""")
def t1(spark, d):
    return X.sections(texts(spark, d)).select(
        "accession_number", "position", "item_code", "heading", "title", "start", "line_number", "text_length",
        F.md5("content").alias("content_md5"), F.md5("body").alias("body_md5"))


@query("t2_section_list", f"""with {S_SQL} select accession_number, item_code, heading, title, line_number, length(content) as text_length,
  {short_sql("coalesce(nullif(body, ''), content)", 280)} as preview from ss""")
def t2(spark, d):
    return X.section_list(texts(spark, d))


@query("t3_extract_section", f"""with {S_SQL} select accession_number, item_code, heading, line_number, md5(content) as content_md5
  from ss where item_code = '7'""")
def t3(spark, d):
    return X.extract_section(texts(spark, d), "MD&A").select(
        "accession_number", "item_code", "heading", "line_number", F.md5("content").alias("content_md5"))


SEARCH = "risks  related to SRC1"
M_SQL = f"""{S_SQL},
mm as (select accession_number, position, item_code, line_number, content,
   string_split(regexp_replace(content, '(?i)risks\\s+related\\s+to\\s+src1', chr(1) || '\\0' || chr(2), 'g'), chr(1)) as mp from ss),
m1 as (select *, replace(array_to_string(mp[1:k-1], ''), chr(2), '') as before, split_part(mp[k], chr(2), 1) as found
  from (select *, unnest(range(2, len(mp) + 1)) as k from mm)),
m2 as (select *, length(before) as st, length(before) + length(found) as en, greatest(length(before) - 40, 0) as lo,
  least(length(before) + length(found) + 40, length(content)) as hi from m1)"""


@query("t4_search", f"""with {M_SQL} select accession_number, item_code, trim({SP.format('found')}) as matched_text,
  case when lo > 0 then '...' else '' end || trim({SP.format('substr(content, lo + 1, hi - lo)')}) || case when hi < length(content) then '...' else '' end as excerpt,
  line_number + length(before) - length(replace(before, chr(10), '')) as line_number,
  row_number() over (partition by accession_number order by position, k) as match_number from m2
qualify row_number() over (partition by accession_number order by position, k) <= 5""")
def t4(spark, d):
    return X.search(texts(spark, d), SEARCH, max_matches=5, context_chars=40).select(
        "accession_number", "item_code", "matched_text", "excerpt", "line_number", "match_number")


@query("t4_search_in_section", f"""with {S_SQL} select accession_number, len(regexp_extract_all(content, '(?i)discussion')) as n from ss
  where item_code = '7'""")
def t4s(spark, d):
    hits = X.search(texts(spark, d), "discussion", section_name="Item 7")
    return hits.groupBy("accession_number").agg(F.count("*").alias("n"))


PHRASES = ["discussion and analysis", "Risks  related to", "item 1a. risk factors", "the", "management's", "no such phrase here"]


@query("t4_index_search", f"""with {S_SQL}, ph as (select unnest([{", ".join(q(x) for x in PHRASES)}]) as phrase union select 'to ' || source from documents where source is not null)
select phrase, accession_number, item_code, hits from (
  select phrase, accession_number, item_code, len(regexp_extract_all(content, '(?i)' || regexp_replace(replace(phrase, '.', '[.]'), ' +', '[[:space:]]+', 'g'))) as hits from ss, ph) where hits > 0""")
def t4_index(spark, d):
    """Six phrases and one per source, looked up in an index of all sections."""
    index = TI.TextIndex(spark, jobs.work_folder(spark))
    rows = texts(spark, d)
    index.add(rows, "b1")
    sources = MP.table(spark, d, "documents").where("source is not null").select(F.concat(F.lit("to "), "source").alias("phrase"))
    phrases = spark.createDataFrame([(x,) for x in PHRASES], "phrase string").union(sources)
    return index.search(phrases).select("phrase", "accession_number", "item_code", "hits")


def section_pairs(spark, d):
    pairs = FL.prior_comparable(texts(spark, d).drop("markdown"))
    return pairs.where(c("prior").isNotNull()).select(
        "accession_number", c("prior.accession_number").alias("previous_accession"))


@query("t5_section_pairs", f"""with {T_SQL} select accession_number, p as previous_accession from (
  select accession_number, lag(accession_number) over (partition by cik, form_type order by filing_date, accession_number) as p from txt)
  where p is not null""")
def t5p(spark, d):
    return section_pairs(spark, d)


T5_SQL = rf"""{S_SQL}, pr as (select accession_number as a, lag(accession_number) over (partition by cik, form_type order by filing_date, accession_number) as b from txt),
bl as (select accession_number as acc, pos, trim({SP.format('b')}) as b from (
  select accession_number, unnest(l) as b, unnest(range(1, len(l) + 1)) as pos from (
    select accession_number, regexp_split_to_array(content, '\n\s*\n') as l from ss where item_code = '7')) where trim({SP.format('b')}) <> ''),
nb as (select *, row_number() over (partition by acc, b order by pos) as k from bl),
pa as (select a, p.b as old from pr p join ss x on x.accession_number = p.a and x.item_code = '7' join ss y on y.accession_number = p.b and y.item_code = '7'),
n1 as (select pa.a, pa.old, nb.b, nb.k, nb.pos from pa join nb on nb.acc = pa.a), o1 as (select pa.a, pa.old, nb.b, nb.k, nb.pos from pa join nb on nb.acc = pa.old),
x as (select coalesce(n1.a, o1.a) as a, coalesce(n1.old, o1.old) as old, n1.pos as np, o1.pos as op, coalesce(n1.b, o1.b) as b
  from n1 full join o1 on n1.a = o1.a and n1.old = o1.old and n1.b = o1.b and n1.k = o1.k),
y as (select a, old, count(np) as n, count(op) as o, count(*) filter (op is null) as only_n, count(*) filter (np is null) as only_o,
  string_agg(case when op is null then b end, '|' order by np) as now_text, string_agg(case when np is null then b end, '|' order by op) as old_text from x group by all)"""


@query("t5_compare_sections", f"""with {T5_SQL} select a as accession_number, old as previous_accession, round((n + o - only_n - only_o) / (n + o), 6) as similarity_ratio,
  only_n as current_only_count, only_o as previous_only_count, md5(coalesce(now_text, '')) as now_md5, md5(coalesce(old_text, '')) as old_md5 from y""")
def t5(spark, d):
    """All changed blocks, whole: no limit of changes or characters."""
    rows = X.compare_sections(section_pairs(spark, d), texts(spark, d), "7", excerpt_chars=None)
    return rows.select("accession_number", "previous_accession", "similarity_ratio", "current_only_count", "previous_only_count",
                       F.md5(F.concat_ws("|", "current_only_excerpts")).alias("now_md5"), F.md5(F.concat_ws("|", "previous_only_excerpts")).alias("old_md5"))


# Lines as blocks: a longest rising run of their pairs is in order.
DIFF_SQL = T5_SQL.replace(r"'\n\s*\n'", r"'\n'")


@query("t5_block_diff", f"""with recursive {DIFF_SQL},
both_ as (select a, old, op as i, np as j from x where op is not null and np is not null),
runs as (select a, old, i, j, 1 as n from both_ where not exists (select 1 from both_ s where s.a = both_.a and s.old = both_.old and s.i < both_.i and s.j < both_.j)
  union select b.a, b.old, b.i, b.j, r.n + 1 from runs r join both_ b on b.a = r.a and b.old = r.old and b.i > r.i and b.j > r.j),
best as (select a, old, max(n) as eq from runs group by a, old)
select y.a as accession_number, y.old as previous_accession, coalesce(eq, 0) as equal, n - only_n - coalesce(eq, 0) as moved, only_n as added, only_o as removed,
  round(2 * coalesce(eq, 0) / (n + o), 6) as similarity_ratio from y left join best using (a, old)""")
def t5_diff(spark, d):
    rows = CH.block_changes(section_pairs(spark, d), texts(spark, d), "7", separator=CH.LINES)
    return CH.ordered_similarity(rows)


@query("t5_block_changes", f"""with {DIFF_SQL} select a as accession_number, old as previous_accession, count(*) filter (op is null) as added, count(*) filter (np is null) as removed,
  md5(coalesce(string_agg(case when op is null then b end, '|' order by np), '')) as added_md5, md5(coalesce(string_agg(case when np is null then b end, '|' order by op), '')) as removed_md5
from x group by a, old""")
def t5_changes(spark, d):
    rows = CH.block_changes(section_pairs(spark, d), texts(spark, d), "7", separator=CH.LINES)

    def listed(change: str, at: str):
        own = F.array_sort(F.collect_list(F.when(c("change") == change, F.struct(at, "block"))))
        return F.md5(F.concat_ws("|", F.transform(own, lambda x: x["block"])))

    return rows.groupBy("accession_number", "previous_accession").agg(
        F.count_if(c("change") == "added").alias("added"), F.count_if(c("change") == "removed").alias("removed"),
        listed("added", "current_position").alias("added_md5"), listed("removed", "previous_position").alias("removed_md5"))


LN = "list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("t6_risk_themes", f"""with {T_SQL}, s as (select accession_number, 'Risks related to ' || cik as h, {LN} as l from txt)
select accession_number, h as themes from s""")
def t6(spark, d):
    r = X.extract_section(texts(spark, d), "1A")
    return r.select("accession_number", F.concat_ws("|", X.risk_themes(c("content"))).alias("themes"))


LED_SQL = T_SQL.replace("from documents", "from (select * replace ('Note ' || doc_id || '. ' || text as text) from documents)")


@query("t7_risk_highlights", f"""with {LED_SQL}, s as (select accession_number, 'Risks related to ' || cik as h, {LN}[1] as l from txt)
select accession_number, {short_sql("h || ': ' || regexp_extract(l, '^(.*?[.!?])(\\s|$)', 1)", 320)} as highlights from s""")
def t7(spark, d):
    r = X.extract_section(texts(spark, d, led=True), "1A")
    return r.select("accession_number", F.concat_ws("|", X.risk_highlights(c("content"))).alias("highlights"))


@query("t8_narrative_highlights", f"""with {LED_SQL} select accession_number,
  {short_sql("'Overview: ' || trim(string_split(raw, chr(10))[1])", 320)} as highlights from txt""")
def t8(spark, d):
    r = X.extract_section(texts(spark, d, led=True), "7")
    return r.select(
        "accession_number", F.concat_ws("|", X.narrative_highlights(c("content"))).alias("highlights"))


@query("t9_pick_highlights", f"""with {T_SQL}, p as (select accession_number, list_filter(list_distinct(list_transform(
   string_split(raw, chr(10)), lambda x: cik || ': ' || trim(x))), lambda x: true) as d0, list_transform(string_split(raw, chr(10)), lambda x: cik || ': ' || trim(x)) as all_ from txt)
select accession_number, md5(all_[1] || '|' || coalesce(list_filter(all_, lambda x: x <> all_[1])[1], '')) as picked from p""")
def t9(spark, d):
    rows = texts(spark, d).select("accession_number", "cik", F.regexp_extract("markdown", r"(?s)Business\n\n(.*?)\n\n## Item 1A", 1).alias("raw"))
    cands = F.array_distinct(F.transform(F.split("raw", "\n"), lambda x: F.concat(c("cik"), F.lit(": "), F.trim(x))))
    rows = rows.withColumn("cands", cands)
    two = X.pick_highlights(c("cands"), 2)
    return rows.select("accession_number", F.md5(F.concat(two[0], F.lit("|"), F.coalesce(F.try_element_at(two, F.lit(2)), F.lit("")))).alias("picked"))


@query("t10_risk_excerpt", f"""with {T_SQL} select accession_number,
  md5('## Item 1A. Risk Factors' || chr(10) || chr(10) || 'Risks related to ' || cik || ':' || chr(10)
      || rtrim(raw || {q(H7)} || replace(raw, chr(10), chr(10) || '- '), {WS})) as risk_md5 from txt""")
def t10(spark, d):
    return texts(spark, d).select("accession_number", F.md5(X.risk_excerpt(c("markdown"))).alias("risk_md5"))


@query("t10_mda_excerpt", f"""with {T_SQL} select accession_number,
  md5(rtrim(substr(md, instr(md, 'Item 7. Management')), {WS})) as mda_md5 from txt""")
def t10m(spark, d):
    return texts(spark, d).select("accession_number", F.md5(X.mda_excerpt(c("markdown"))).alias("mda_md5"))


NOTE = q(X.NOTICE)


@query("t11_truncated_text", f"""with {S_SQL}, z as (select txt.accession_number, md, rtrim(substr(md, 1, 300), {WS}) as head, content
   from txt join ss on ss.accession_number = txt.accession_number and item_code = '1A')
select accession_number, md5(case when length(md) <= 2000 then md
  else rtrim(head || {q(chr(10) + chr(10) + X.SKIPS[0][1] + chr(10))} || rtrim(substr(content, 1, 2000 - {len(X.NOTICE)} - length(head) - {len(X.SKIPS[0][1]) + 3}), {WS}), {WS}) || {NOTE} end) as text_md5
from z where length(md) <= 2000 or not contains(head, content)""")
def t11(spark, d):
    return X.truncated_text(texts(spark, d), 2000, 300).select("accession_number", F.md5("truncated").alias("text_md5"))


@query("t13_texts_by_accession", f"""with {T_SQL} select accession_number, length(md) as n from txt where form_type = 'en'""")
def t13(spark, d):
    t = texts(spark, d)
    asked = t.where("form_type = 'en'").select(F.replace(c("accession_number"), F.lit("-"), F.lit("")).alias("accession_number"))
    return X.texts_by_accession(t, asked).select("accession_number", F.length("markdown").alias("n"))


@query("p20_text_keys", f"""with {T_SQL} select accession_number,
  nullif(regexp_replace(lower(trim(substr(raw, 1, position('.' in raw || '.')))), '[^a-z0-9]+', '', 'g'), '') as key from txt""")
def p20(spark, d):
    from tallyfold.functions.columns import alnum_key
    raw = F.regexp_extract("markdown", r"(?s)Business\n\n(.*?)\n\n## Item 1A", 1)
    first = F.substr(raw, F.lit(1), F.locate(".", F.concat(raw, F.lit("."))))
    return texts(spark, d).select("accession_number", alnum_key(first).alias("key"))
