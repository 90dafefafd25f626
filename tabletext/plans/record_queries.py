"""Queries of whole records over the given tables: rendering, splitting, people and masks, with DuckDB statements beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.functions import text
from tabletext.operators import documents, enrich, incidents, logs, masks, people, record_parts
from tabletext.plans import enrichment, rendering
from tabletext.plans.spec import ColumnSpec, TableSpec
from tabletext.session import scratch_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str) -> Callable:
    """Register a query and the DuckDB statement it must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


#: Estimated tokens of a text in DuckDB.
TOKENS_SQL = """((length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) * 33
  + (length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) - length(regexp_replace({0}, '[^0-9]', '', 'g'))
     - length(regexp_replace({0}, '[^!-/:-@\\[-`{{-~]', '', 'g'))) * 15
  + length(regexp_replace({0}, '[^!-/:-@\\[-`{{-~]', '', 'g')) * 30 + length(regexp_replace({0}, '[^0-9]', '', 'g')) * 10
  + len(regexp_extract_all({0}, '[0-9]+')) * 30 + 29) // 30)"""

DOCUMENT_SPEC = TableSpec("文書", [
    ColumnSpec("文書No", "doc", "code", "key"), ColumnSpec("言語", "lang", "string", "entity"), ColumnSpec("文字数(字)", "chars", "number", "measure", "字"),
    ColumnSpec("本文", "body", "text", "attribute"),
])


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of a list table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "n_chars")
    values = F.create_map(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"), F.lit("chars"), F.col("n_chars").cast("string"), F.lit("body"), F.col("text"))
    return docs.select(
        F.lit("documents").alias("file"), F.lit("").alias("sheet"), F.col("doc_id").alias("record_row"), F.col("doc_id").cast("string").alias("record_key"),
        F.lit(None).cast("string").alias("date_value"), values.alias("values"),
    )


_RECORD_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, n_chars FROM documents),
l AS (
  SELECT doc_id, lang, n_chars, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM d),
b AS (
  SELECT doc_id, array_to_string(list_filter(['- 文書No: ' || doc_id::VARCHAR, '- 言語: ' || lang, '- 文字数: ' || n_chars::VARCHAR || '字',
    CASE WHEN len(ls) = 1 THEN '- 本文: ' || ls[1]
      WHEN len(ls) > 1 THEN '- 本文:' || chr(10) || '  ' || array_to_string(list_transform(ls, lambda x:
        regexp_replace(regexp_replace(regexp_replace(x, '^(\\s{0,3})(#{1,6}(?:\\s|$)|[-*+](?:\\s|$)|>|```|~~~|\\|)', '\\1\\\\\\2'),
          '^(\\s{0,3}[0-9]{1,9})([.)](?:\\s|$))', '\\1\\\\\\2'), '^(\\s{0,3})([-*_=](?:\\s*[-*_=])+\\s*)$', '\\1\\\\\\2')), chr(10) || '  ') END,
    '- 出典: documents（文書No ' || doc_id::VARCHAR || '・' || doc_id::VARCHAR || '行目）'], lambda x: x IS NOT NULL), chr(10)) AS body,
    '## 【' || doc_id::VARCHAR || '】' || lang || CASE WHEN count(*) OVER (PARTITION BY doc_id, lang) > 1 THEN '（' || doc_id::VARCHAR || '行目）' ELSE '' END AS title
  FROM l)
"""


@query(
    "record_parts",
    _RECORD_SQL
    + f"""SELECT doc_id, md5(body) AS body_md5, {TOKENS_SQL.format("title || chr(10) || body")} > 400 AS is_split, title AS first_head, 0::BIGINT AS over_budget,
      0::BIGINT AS without_head, true AS enough_parts
    FROM (SELECT doc_id, body, title FROM b)""",
)
def record_parts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records over 400 tokens: what is left when repeats are taken out, and whether each part keeps the budget and says whose it is."""
    done = rendering.rendered(document_records(spark, sf_dir), DOCUMENT_SPEC)
    parts = done.withColumn("parts", record_parts.part_texts("lines")).withColumn("n", F.size("parts"))
    tokens = F.transform("parts", text.estimate_tokens)
    number = lambda i: F.concat(F.when(i > 0, "（続き").otherwise("（"), (i + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("）"))
    again = lambda i: F.when(i > 0, F.concat(F.lit("\n- 文書No: "), "record_key", F.lit("\n"))).otherwise(F.lit("\n"))
    headed = F.transform("parts", lambda p, i: p.startswith(F.concat("title", F.when(F.col("n") > 1, number(i)).otherwise(""), again(i))))
    whole = text.estimate_tokens(F.concat_ws("\n", F.array(F.col("title")), "body"))
    return parts.select(
        F.col("record_row").alias("doc_id"), F.md5(record_parts.restored("lines")).alias("body_md5"), (F.col("n") > 1).alias("is_split"),
        F.regexp_replace(F.substring_index(F.col("parts")[0], "\n", 1), "（1/[0-9]+）$", "").alias("first_head"),
        F.size(F.filter(tokens, lambda x: x > 400)).cast("bigint").alias("over_budget"), F.size(F.filter(headed, lambda x: ~x)).cast("bigint").alias("without_head"),
        (F.col("n") * 400 >= whole).alias("enough_parts"),
    )


@query(
    "record_titles",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '【' || o_orderkey::VARCHAR || '】' END
      || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '（C-' || o_custkey::VARCHAR || '）' ELSE '' END
      || CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END
      || '｜' || strftime(o_orderdate, '%Y-%m-%d') AS title FROM orders""",
)
def record_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of orders: with and without a key, an entity of two columns, and the first values where both are missing."""
    spec = TableSpec("注文", [
        ColumnSpec("注文No", "no", "code", "key"), ColumnSpec("顧客番号", "cust", "code", "entity"), ColumnSpec("優先度", "prio", "string", "entity_label"),
        ColumnSpec("状態", "status"), ColumnSpec("注文日", "day", "date", "date"),
    ])
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    about = lambda c: F.when(key % 3 == 0, c)
    values = F.create_map(
        F.lit("no"), F.when(key % 4 != 0, key.cast("string")), F.lit("cust"), about(F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))), F.lit("prio"), about(F.col("o_orderpriority")),
        F.lit("status"), F.col("o_orderstatus"), F.lit("day"), day,
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("orders").alias("file"), F.lit("").alias("sheet"), key.alias("record_row"), day.alias("date_value"), values.alias("values"))
    return rows.select("o_orderkey", rendering.spec_title(spec).alias("title"))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"


def _spans_sql(pattern: str, kind: str) -> str:
    """Places of all matches of a pattern: running lengths of what lies between them."""
    return f"""SELECT doc_id, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i])}})) AS s
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)"""


@query(
    "mask_places",
    f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
    names AS (SELECT DISTINCT regexp_extract(text, '([a-z]{{2,12}})[.][0-9]+@', 1) AS name FROM documents),
    mail AS ({_spans_sql(_MAIL, "email").replace("SELECT doc_id,", "SELECT r, doc_id,", 1).replace("(SELECT doc_id,", "(SELECT r, doc_id,")}),
    cuts AS (SELECT r, doc_id, t, name, string_split(t, name) AS g FROM d JOIN names ON name <> '' AND contains(t, name)),
    named AS (
      SELECT r, doc_id, name, t, unnest(list_transform(range(1, len(g)), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(name))) AS a FROM cuts),
    spans AS (
      SELECT r, doc_id, kind, s.a::BIGINT AS a, s.a::BIGINT + s.n AS e FROM mail
      UNION ALL SELECT r, doc_id, 'person', a::BIGINT, a::BIGINT + length(name) FROM named
      WHERE a + length(name) = length(t) OR contains(' ' || chr(9) || chr(10) || ':：、。,，)）】]→・', substr(t, a::INTEGER + length(name) + 1, 1))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY a, e DESC, kind) AS k FROM spans),
    kept(r, doc_id, k, kind, a, e, stop, taken) AS (
      SELECT r, doc_id, k, kind, a, e, e, true FROM ranked WHERE k = 1
      UNION ALL SELECT x.r, x.doc_id, x.k, x.kind, x.a, x.e, CASE WHEN x.a >= p.stop THEN x.e ELSE p.stop END, x.a >= p.stop
      FROM kept p JOIN ranked x ON x.r = p.r AND x.k = p.k + 1)
    SELECT doc_id, kind, a::INTEGER AS first_place, e::INTEGER AS last_place FROM kept WHERE taken""",
)
def mask_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of mail addresses and of people (named by the addresses) in every whole text, where both overlap the first and longest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = people.people_index(spark, docs.where(F.contains("text", F.lit("@"))).select(F.regexp_extract("text", "([a-z]{2,12})[.][0-9]+@", 1).alias("name")))
    # a file of few row groups is read by few tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = masks.find_masks(docs.repartition(parts, "doc_id"), "text", ("email", "person"), index)
    # an inner explode has texts without finds left out first, by a search of its own
    spans = found.select("doc_id", F.explode_outer("masks").alias("m")).where("m IS NOT NULL")
    return spans.select("doc_id", "m.kind", F.col("m.start").alias("first_place"), F.col("m.end").alias("last_place"))


@query(
    "people_authors",
    """WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, k::INTEGER AS id, '2026-04-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') AS date,
      CASE k % 4 WHEN 0 THEN CASE role WHEN 'user' THEN '佐藤 一' ELSE '田中' END WHEN 1 THEN '伊藤' WHEN 2 THEN '製造課' ELSE '田中' END AS author,
      CASE k % 4 WHEN 1 THEN 2 ELSE 1 END::INTEGER AS author_people, '確認' || k::VARCHAR AS body
    FROM c""",
)
def people_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation written as a log cell by people in several forms, and read again by one index.

    A surname one person has, one that two have, a group before the text, and a name in brackets behind a date at the end.
    """
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    cells = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def line(t, i):
        k = i + 1
        day = F.concat(F.lit("2026/4/"), (k % 28 + 1).cast("string"))
        said = F.concat(F.lit("確認"), k.cast("string"))
        own = F.when(t["role"] == "user", F.concat(F.lit("佐藤 "), said)).otherwise(F.concat(F.lit("田中→佐藤 "), said))
        return F.concat(day, F.lit(" "), F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(F.lit("伊藤 "), said)).when(k % 4 == 2, F.concat(F.lit("製造課: "), said)).otherwise(F.concat(said, F.lit("（"), day, F.lit(" 田中）"))))

    cells = cells.select("conv_id", F.array_join(F.transform("turns", line), "\n").alias("cell"))
    index = people.people_index(spark, None, [{"name": "佐藤 一"}, {"name": "田中"}, {"name": "伊藤 一"}, {"name": "伊藤 二"}], ["製造課"])
    segments = logs.parse_log(cells, "cell", people=index).select("conv_id", F.explode("log.segments").alias("s"))
    return segments.select("conv_id", "s.id", "s.date", "s.author", "s.author_people", "s.body")


def _answer(prompt: str) -> str:
    """A model that leaves some requests unanswered, some until they are repaired, and invents a number in others."""
    k = int(prompt.split("\n", 1)[0])
    if k % 7 == 0 or k % 5 == 0 and enrichment.REPAIR not in prompt:
        return "no answer"
    text = "部品 9 個" if k % 3 == 0 else "部品 3 個"
    return f'{{"entries": [{{"segments": [1], "type": "点検", "text": "{text}", "quote": ""}}]}}'


@query(
    "enrich_repair",
    """SELECT conv_id, turn, role, CASE WHEN k % 7 = 0 THEN 'error' WHEN k % 3 = 0 THEN 'flagged' ELSE 'ok' END AS status,
      CASE WHEN k % 7 = 0 OR k % 5 = 0 OR k % 3 = 0 THEN 2 ELSE 1 END AS attempts, count(*) AS n_rows
    FROM (SELECT conv_id, turn, role, (conv_id * 31 + turn) % 60 AS k FROM conversations) GROUP BY ALL""",
)
def enrich_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as requests, sixty distinct ones: answers from one call each, checked, and asked once more where they fail."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    k = (F.col("conv_id") * 31 + F.col("turn")) % 60
    works = rows.select(F.struct("conv_id", "turn", "role").alias("key"), k.cast("string").alias("prompt"), F.array(F.lit("部品 3 個を点検した")).alias("segments"))
    done = enrichment.execute(works, scratch_dir(spark), _answer, ["点検"])
    return done.groupBy("key.conv_id", "key.turn", "key.role", "status", "attempts").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "group_order",
    """WITH g AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS prio, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders)
    SELECT CASE WHEN prio = '' THEN '優先度なし' ELSE prio END || '_' || CASE WHEN month = '' THEN '日付なし' ELSE month END AS name,
      row_number() OVER (ORDER BY prio = '', prio, month = '', month) AS position FROM g""",
)
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places of the files of orders, by priority and month, groups without a value last in each column."""
    spec = TableSpec("注文", [ColumnSpec("注文日", "day", "date", "date"), ColumnSpec("優先度", "prio", "string", "category")], ["day", "prio"])
    key = F.col("o_orderkey")
    values = F.create_map(F.lit("day"), F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("prio"), F.when(key % 5 != 0, F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").select(values.alias("values"))
    order = rendering.group_order(spec)
    keys = [f"k{i}" for i in range(len(order))]
    groups = rows.select(rendering.group_name(spec).alias("name"), *[o.alias(k) for o, k in zip(order, keys, strict=True)]).distinct()
    return documents.positions(groups, [F.col(k) for k in keys]).select("name", "position")


@query(
    "ai_estimate",
    f"""WITH w AS (SELECT coalesce(c.text, '') AS t, c.turn, l.quality FROM conversations c LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = c.conv_id),
    r AS (SELECT *, CASE WHEN trim(t) = '' THEN 'skipped' WHEN length(t) >= 200 THEN 'ai' ELSE 'rule_only' END AS route,
      quality IS NULL OR quality = 0 OR turn % 4 = 0 AS asked, {TOKENS_SQL.format("t")}::BIGINT AS tokens FROM w),
    k AS (SELECT substr(t, 1, 2) AS k, count(*) AS n, min(tokens) AS tokens_in, min(least(2000, 400 + greatest(40 * (turn + 1), 2 * tokens))) AS max_tokens FROM r WHERE asked AND route = 'ai' GROUP BY 1),
    c AS (SELECT *, k IN (SELECT substr(coalesce(text, ''), 1, 2) FROM conversations WHERE turn = 3) AS held FROM k)
    SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FILTER (asked AND route = 'ai') FROM r) AS n_ai, (SELECT count(*) FILTER (asked AND route = 'rule_only') FROM r) AS n_rule_only,
      (SELECT count(*) FILTER (asked AND route = 'skipped') FROM r) AS n_skipped, (SELECT count(*) FILTER (NOT asked) FROM r) AS n_already,
      coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates, count(*) FILTER (held) AS n_cached, count(*) FILTER (NOT held) AS n_calls,
      coalesce(sum(tokens_in) FILTER (NOT held), 0)::BIGINT AS tokens_in, coalesce(sum(max_tokens) FILTER (NOT held), 0)::BIGINT AS tokens_out,
      count(*) FILTER (NOT held) * 8.0::DOUBLE / 60.0 / 4 AS minutes FROM c""",
)
def ai_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all turns would call: routes, results already there, shared requests, the cache, tokens and minutes."""
    items = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "conversations").join(items, "conv_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    status = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "error")
    tokens = text.estimate_tokens("text")
    works = rows.select(
        F.substring("text", 1, 2).alias("cache_key"), enrich.route("text", 200).alias("route"), status.alias("status"), (F.col("turn") % 4 == 0).alias("outdated"), tokens.alias("tokens_in"),
        enrichment.output_tokens(F.col("turn") + 1, tokens).alias("max_tokens"),
    )
    cache = table(spark, sf_dir, "conversations").where("turn = 3").select(F.substring(F.coalesce("text", F.lit("")), 1, 2).alias("cache_key"))
    return enrichment.estimate_import(works, cache)


@query(
    "incident_points",
    """WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size, p_type AS type FROM part)
    SELECT k, array_to_string(list_filter([
        CASE WHEN k % 4 <> 0 THEN '原因: ' || type || '（推定）' END, '暫定処置: 停止した、点検した',
        CASE WHEN k % 3 <> 0 THEN '使用部品: ' || brand || ' ' || size::VARCHAR || '個' END, CASE WHEN k % 7 <> 0 THEN '最終状態: 復旧' END], lambda x: x IS NOT NULL), chr(10)) AS lines,
      array_to_string(list_filter([CASE WHEN k % 4 = 0 THEN 'certainty' END, CASE WHEN k % 3 = 0 THEN 'quote' END, CASE WHEN k % 7 = 0 THEN 'state' END, CASE WHEN k % 5 = 0 THEN 'bad_source' END], lambda x: x IS NOT NULL), ',') AS codes
    FROM p""",
)
def incident_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about every part: points that their segments carry are written, others dropped with the reason."""
    k = F.col("p_partkey")
    qty = F.concat(F.col("p_size").cast("string"), F.lit("個"))
    src = lambda *n: F.array(*[F.lit(x) for x in n])
    cause = F.struct(F.col("p_type").alias("v"), F.when(k % 4 == 0, "多分").otherwise("推定").alias("certainty"), src(1).alias("src"))
    action = lambda text, source: F.struct(F.lit(text).alias("v"), source.alias("src"))
    actions = F.concat(F.array(action("停止した", src(1)), action("点検した", src(2))), F.when(k % 5 == 0, F.array(action("交換した", src(3)))).otherwise(F.array().cast("array<struct<v:string,src:array<int>>>")))
    parts = F.array(F.struct(F.col("p_brand").alias("name"), qty.alias("qty"), src(2).alias("src")))
    last = F.struct(F.when(k % 7 == 0, "完了").otherwise("復旧").alias("v"), src(2).alias("src"))
    incident = F.struct(cause.alias("root_cause"), actions.alias("temporary_actions"), parts.alias("parts"), last.alias("final_state"))
    second = F.concat(F.lit("点検した。"), F.col("p_brand"), F.lit("を"), F.when(k % 3 == 0, F.lit("数個")).otherwise(qty), F.lit("使い復旧"))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.to_json(F.struct(incident.alias("incident"))).alias("answer"), F.array(F.concat(F.lit("停止した。"), F.col("p_type")), second).alias("segments"))
    done = incidents.check_incident(rows, "answer", "segments")
    kinds = F.array(*[F.lit(x) for x in ("certainty", "quote", "state", "bad_source")])
    found = F.transform("points_issues", lambda x: x["code"])
    return done.select("k", F.array_join(incidents.point_lines("points"), "\n").alias("lines"), F.array_join(F.array_intersect(kinds, found), ",").alias("codes"))
