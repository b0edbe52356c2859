"""Run store, result grid, briefs and legacy sheets."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.operators import results as R
from contactlake.operators import runs as O
from contactlake.operators.ranked import ranked, ranked_page, write_ranked
from contactlake.sources.readers import decode_runs, legacy_rows, parse_briefs, region_label, regions, run_results
from contactlake.sources.runstore import create_store, read_store, upsert_store
from contactlake.session import shared_dir, spread
from workload.common import q, table


def _s(c):
    return F.col(c).cast("string")


def raw_runs(spark, sf_dir):
    """Orders as stored runs with their JSON columns."""
    o = spread(table(spark, sf_dir, "orders"))
    n = (F.col("o_custkey") % 4).cast("int")
    brief = F.to_json(F.struct(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise(" ").alias("operatorName"),
        F.concat(F.lit("Client "), _s("o_custkey")).alias("clientName"),
        F.concat(F.lit("https://www.C"), _s("o_custkey"), F.lit(".example.com/x")).alias("clientSite"),
        F.repeat(F.lit("n"), n * 50).alias("niche"),
        F.when(n > 1, "A, B").otherwise("").alias("regions"),
        F.when(n > 0, "one\ntwo,one").otherwise("").alias("queries")))
    results = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.concat(F.lit("s"), i.cast("string"), F.lit("-"), _s("o_custkey")).alias("site"),
        F.when(i % 2 == 0, F.concat(F.lit("7495"), F.lpad(_s("o_custkey"), 7, "0"))).alias("p1")))
    pipeline = F.when(n != 3, F.to_json(F.struct(
        F.when(n == 1, "done").otherwise("running").alias("analyze"), (n == 2).alias("sources_reviewed"))))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "stopped").otherwise("running")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")
    return o.select(
        _s("o_orderkey").alias("id"), status.alias("status"), brief.alias("brief_json"), pipeline.alias("pipeline_json"),
        F.when(n != 0, F.to_json(results)).alias("results_json"), F.lit(None).cast("string").alias("error"),
        F.when(n == 1, 1).otherwise(0).alias("is_demo"), day.alias("created_at"), day.alias("updated_at"))


def runs(spark, sf_dir):
    return decode_runs(raw_runs(spark, sf_dir))


def q_runs_decode(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "id", "status", F.col("brief.clientName").alias("client"), F.col("pipeline.analyze").alias("analyze"),
        F.size("results").alias("n_results"), "is_demo", F.year("created_at").alias("year"))


def q_run_results(spark, sf_dir):
    return run_results(runs(spark, sf_dir)).select("run_id", "ord", "site", "p1")


def q_run_summary(spark, sf_dir):
    return O.summarize_runs(runs(spark, sf_dir)).select(
        "id", "status_label", "operator_name", "client_name", "client_site", "niche",
        F.array_join("queries", "|").alias("queries"), "queries_count", F.array_join("regions", "|").alias("regions"),
        "regions_count", "region_mode", "sites_count", "phones_count", "is_demo")


def q_run_list(spark, sf_dir):
    mine = O.of_operator(O.summarize_runs(runs(spark, sf_dir)), " 1-urgent ")
    return O.latest_runs(mine, 50).select("id", "status", "operator_name", "sites_count")


def q_run_count(spark, sf_dir):
    rows = O.summarize_runs(runs(spark, sf_dir))
    return O.count_runs(O.of_operator(rows, "")).withColumn("scope", F.lit("blank")).unionByName(
        O.count_runs(rows).withColumn("scope", F.lit("all")))


def q_run_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}"
    write_ranked(o, path, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return ranked_page(spark, path, 3)


def q_run_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by_year = o.select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("y"))
    return O.compare_runs(by_year.where("y = 1996").select("site"), by_year.where("y = 1997").select("site"))


def q_resumable(spark, sf_dir):
    return runs(spark, sf_dir).select("id", O.can_resume(F.col("is_demo")).alias("resumable"))


def q_same_client(spark, sf_dir):
    return O.same_client(O.summarize_runs(runs(spark, sf_dir)), ("stopped", "running"), newest=1000).select("client_key", "id")


def q_same_client_all(spark, sf_dir):
    """Over all runs; q_same_client keeps to the newest 1000 of its SQL."""
    return O.same_client(O.summarize_runs(runs(spark, sf_dir)), ("stopped", "running")).select("client_key", "id")


def q_run_upsert(spark, sf_dir):
    raw = raw_runs(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    updates = e.select(
        F.when(F.col("event_type") == "signup", F.concat(F.lit("new-"), _s("user_id"))).otherwise(_s("user_id")).alias("id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit("s"), _s("event_id"))).alias("status"),
        F.lit(None).cast("string").alias("brief_json"), F.when(F.col("event_type") == "view", F.col("props")).alias("pipeline_json"),
        F.lit(None).cast("string").alias("results_json"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.lit(None).cast("int").alias("is_demo"))
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    create_store(raw, path)
    upsert_store(spark, path, updates, F.lit("2026-01-01T00:00:00"))
    return read_store(spark, path).select(
        "id", "status", "pipeline_json", F.coalesce("error", F.lit("-")).alias("error"), "is_demo", "created_at", "updated_at")


# --- progress -----------------------------------------------------------------------------------

def _steps(spark, sf_dir):
    """Latest event of each (run, step); the step comes from the event's own number."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(s) for s in V.STEPS])
    step = F.element_at(names, (F.col("event_id") % len(V.STEPS)).cast("int") + 1)
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "view", "running").otherwise("pending")
    return e.groupBy(F.col("user_id").alias("run_id"), step.alias("step")).agg(F.max_by(kind, "event_id").alias("status"))


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "click", "skip").otherwise("pending")
    return e.select(F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").alias("site"),
                    "ts", "event_id", kind.alias("status"))


def q_site_status(spark, sf_dir):
    return O.latest_site_status(_log(spark, sf_dir), "ts", "event_id")


def q_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "signup", "stopped").otherwise("running")
    states = e.groupBy("run_id").agg(F.max_by(state, "event_id").alias("status"))
    probes = e.groupBy("run_id").agg(F.count_if(F.col("event_type") == "view").alias("checked"), F.count("*").alias("total"))
    return O.progress(states, _steps(spark, sf_dir), O.latest_site_status(_log(spark, sf_dir), "ts", "event_id"), probes)


def q_reset_running(spark, sf_dir):
    return O.reset_running(_steps(spark, sf_dir)).groupBy("step", "status").agg(F.count("*").alias("n"))


def q_newest_version(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return O.newest_version(e, "user_id", "event_id")


# --- result grid ---------------------------------------------------------------------------------

def grid(spark, sf_dir):
    """Customers as result rows; nations are regions."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    status = F.when(F.col("c_mktsegment") == "BUILDING", V.STATUS_EXCLUDED).when(
        F.col("c_mktsegment") == "MACHINERY", V.STATUS_AGGREGATOR).otherwise(V.STATUS_FOUND)
    has = F.col("c_acctbal") > 2000
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("C"), _s("c_custkey"), F.lit(".example.com")).alias("site"),
        F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("offer"),
        F.when(F.col("c_nationkey") != 7, F.col("n_name")).otherwise("").alias("region"),
        F.when(has, F.concat(F.lit("7495"), F.lpad(_s("c_custkey"), 7, "0"))).alias("p1"),
        F.when(F.col("c_acctbal") > 8000, F.concat(F.lit("7900"), F.lpad(_s("c_custkey"), 7, "0"))).alias("p2"),
        F.when(has, "city").alias("p1_type"), F.when(F.col("c_acctbal") > 8000, "mobile").alias("p2_type"),
        F.lit("s").alias("source"), status.alias("status"), (F.col("c_acctbal") > 9000).alias("for_definition"))


def q_result_filter(spark, sf_dir):
    g = grid(spark, sf_dir)
    test = R.matches(status=V.STATUS_FOUND, phone_type="mobile", marked=False, search="C1")
    return g.where(test | R.matches(region="NATION_3", phone_type="city")).select("ord", "site", "region", "p1", "p2")


def q_result_sort(spark, sf_dir):
    return ranked(grid(spark, sf_dir), *R.grid_order("offer", descending=True)).select("ord", "offer", "rank")


def q_result_stats(spark, sf_dir):
    return R.result_stats(grid(spark, sf_dir), "offer")


def q_region_groups(spark, sf_dir):
    return R.region_groups(grid(spark, sf_dir))


def q_with_district(spark, sf_dir):
    """Customers spread over the packaged regions by nation, counted per district."""
    dim = regions(spark)
    g = grid(spark, sf_dir).groupBy(F.regexp_extract("region", r"(\d+)$", 1).try_cast("int").alias("k")).agg(F.count("*").alias("n"))
    named = g.join(dim.select(F.col("ord").alias("k"), F.col("name").alias("region")), "k")
    return R.with_district(named, dim.select("name", "district_id", "label"), "region").groupBy(
        "district_id").agg(F.sum("n").alias("n"), F.max("label").alias("last_label"))


def q_district_rollup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("district"))
    chosen = grid(spark, sf_dir).where("p2 is not null and offer = 'furniture'").select(F.col("region").alias("name"))
    return R.district_totals(dim, chosen).select("district", "selected", "total", F.col("is_total").cast("int").alias("is_total"), "state")


def _updates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit(" c"), _s("user_id"), F.lit(".EXAMPLE.com ")).alias("site"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("for_definition"),
        F.when(F.col("event_type").isin("view", "purchase"), F.concat(F.lit("st"), _s("event_id"))).alias("status"))


def q_annotate(spark, sf_dir):
    return R.annotate(grid(spark, sf_dir), _updates(spark, sf_dir)).select(
        "ord", "site", "for_definition", "status", "changes")


def q_annotate_counts(spark, sf_dir):
    return R.annotate_counts(R.annotate(grid(spark, sf_dir), _updates(spark, sf_dir)))


def q_mark_visible(spark, sf_dir):
    marked = R.mark_visible(grid(spark, sf_dir), R.matches(phone_type="city"), True)
    return marked.groupBy("status").agg(
        F.count_if("for_definition").alias("marked"), F.count("*").alias("n")).unionByName(
        R.clear_marks(marked).groupBy(F.lit("cleared").alias("status")).agg(
            F.count_if("for_definition").alias("marked"), F.count("*").alias("n")))


# --- briefs and sheets ------------------------------------------------------------------------------

def q_briefs(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders"))
    text = F.concat(
        F.lit("Brief\nЭкспорт: 1.1.2025, 10:00\n# note: x\n\nКлиент: Client "), _s("o_custkey"),
        F.lit("\r\nСайт клиента: see https://c"), _s("o_custkey"), F.lit(".example.com/a.\nПоисковые запросы:\n---\none "),
        _s("o_orderkey"), F.lit("\ntwo: x\n---\nmaxSites: "), F.regexp_extract("o_orderpriority", r"(\d)", 1),
        F.lit("0\nПроверка живого сайта: "), F.when(F.col("o_orderstatus") == "F", "нет").otherwise("Да"),
        F.lit("\nИсточники: serp; site,catalog\nГлубина обхода: x\n"))
    json = F.to_json(F.struct(F.struct(
        F.concat(F.lit("Client "), _s("o_custkey")).alias("clientName"),
        F.concat(F.lit("c"), _s("o_custkey"), F.lit(".example.com")).alias("clientSite"),
        F.lit(7).alias("crawlDepth"), F.lit("secret").alias("apiKey")).alias("brief")))
    files = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", json).otherwise(text).alias("value"))
    b = F.col("brief")
    return parse_briefs(files).select(
        "o_orderkey", b["clientName"].alias("client"), b["clientSite"].alias("site"), b["queries"].alias("queries"),
        b["maxSites"].alias("max_sites"), b["checkAlive"].alias("check_alive"), b["crawlDepth"].alias("depth"),
        F.array_join(b["sources"], "|").alias("sources"), b["regionMode"].alias("region_mode"))


def q_legacy_sheet(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.lpad(_s("c_custkey"), 7, "0")
    contacts = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("8 (495) "), key)).otherwise(
        F.concat(F.lit("8495"), key, F.lit(", 7900"), key, F.lit("; 7495"), key))

    def cell(x):
        return F.concat(F.lit('<Cell><Data Type="String">'), x, F.lit("</Data></Cell>"))

    row = F.concat(F.lit("<Row>"), cell(F.concat(F.lit("c"), _s("c_custkey"))), cell(F.col("c_name")), cell(F.lit("R")),
                   cell(contacts), F.when(F.col("c_nationkey") > 5, cell(F.lit("src"))).otherwise(""), F.lit("</Row>"))
    parsed = F.from_xml(row, "Cell ARRAY<STRUCT<Data: STRING>>")["Cell"]
    rows = c.select("c_custkey", F.transform(parsed, lambda x: x["Data"]).alias("cells"))
    return legacy_rows(rows).select("c_custkey", "site", "name", "region", F.array_join("phones", ",").alias("phones"), "source", "status")


QUERIES = {f.__name__: f for f in (
    q_runs_decode, q_run_results, q_run_summary, q_run_list, q_run_count, q_run_page, q_run_compare, q_resumable,
    q_same_client, q_same_client_all, q_run_upsert, q_site_status, q_progress, q_reset_running, q_newest_version, q_result_filter,
    q_result_sort, q_result_stats, q_region_groups, q_with_district, q_district_rollup, q_annotate,
    q_annotate_counts, q_mark_visible, q_briefs, q_legacy_sheet)}

_N = "CAST(o_custkey % 4 AS INTEGER)"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'stopped' ELSE 'running' END"
_OPERATOR = f"CASE WHEN o_orderpriority = '5-LOW' THEN {q(V.NO_OPERATOR)} ELSE o_orderpriority END"
_LABEL = "CASE o_orderstatus " + " ".join(
    f"WHEN '{k}' THEN {q(V.STATUS_LABELS[s])}" for k, s in (("F", "done"), ("O", "stopped"))) + f" ELSE {q(V.STATUS_LABELS['running'])} END"
_DAY = "strftime(o_orderdate, '%Y-%m-%dT00:00:00')"
_GRID = f"""g AS (SELECT c_custkey AS ord, 'C' || c_custkey || '.example.com' AS site, c_name AS name, lower(c_mktsegment) AS offer,
  CASE WHEN c_nationkey <> 7 THEN n_name ELSE '' END AS region,
  CASE WHEN c_acctbal > 2000 THEN '7495' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS p1,
  CASE WHEN c_acctbal > 8000 THEN '7900' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS p2,
  CASE WHEN c_acctbal > 2000 THEN 'city' END AS p1_type, CASE WHEN c_acctbal > 8000 THEN 'mobile' END AS p2_type, 's' AS source,
  CASE c_mktsegment WHEN 'BUILDING' THEN {q(V.STATUS_EXCLUDED)} WHEN 'MACHINERY' THEN {q(V.STATUS_AGGREGATOR)} ELSE {q(V.STATUS_FOUND)} END AS status,
  c_acctbal > 9000 AS for_definition FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_HAY = "lower(" + " || ' ' || ".join(f"coalesce({c}, '')" for c in R.SEARCHED) + ")"
_STEP_CASE = "CASE CAST(event_id % 6 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(V.STEPS)) + " END"
_STEPS = f"""st AS (SELECT user_id AS run_id, {_STEP_CASE} AS step,
  arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running' ELSE 'pending' END, event_id) AS status
  FROM events GROUP BY 1, 2)"""
_SITES = """si AS (SELECT user_id AS run_id, json_extract_string(props, '$.k') AS site,
  arg_max(CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'error' WHEN 'click' THEN 'skip' ELSE 'pending' END,
          (ts, event_id)) AS status FROM events GROUP BY 1, 2)"""
_UPDATES = """u AS (SELECT 'c' || user_id || '.example.com' AS k,
  arg_max(CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END, event_id) FILTER (WHERE event_type IN ('purchase', 'error')) AS mark,
  arg_max('st' || event_id, event_id) FILTER (WHERE event_type IN ('view', 'purchase')) AS st,
  count(*) FILTER (WHERE event_type IN ('purchase', 'error')) + count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS n
  FROM events GROUP BY 1),
a AS (SELECT g.ord, g.site, coalesce(mark, for_definition) AS for_definition, coalesce(st, status) AS status, coalesce(n, 0) AS changes
      FROM g LEFT JOIN u ON u.k = lower(g.site))"""
_DIM = ", ".join(
    f"({i}, {q(name)}, {q(did)}, {q(region_label(name))})" for i, (name, did) in enumerate(
        sorted((name, d[0]) for d in V.DISTRICTS for name in d[3])))

SQL = {
    "q_runs_decode": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, {_STATUS} AS status, 'Client ' || o_custkey AS client,
        CASE {_N} WHEN 1 THEN 'done' WHEN 3 THEN NULL ELSE 'running' END AS analyze,
        CASE WHEN {_N} = 0 THEN 0 ELSE {_N} + 1 END AS n_results, {_N} = 1 AS is_demo, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
    "q_run_results": f"""WITH r AS (SELECT *, unnest(range(0, {_N} + 1)) AS i FROM orders WHERE {_N} <> 0)
        SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(i AS INTEGER) AS ord, 's' || i || '-' || o_custkey AS site,
        CASE WHEN i % 2 = 0 THEN '7495' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS p1 FROM r""",
    "q_run_summary": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, {_LABEL} AS status_label, {_OPERATOR} AS operator_name,
        'Client ' || o_custkey AS client_name, 'https://www.C' || o_custkey || '.example.com/x' AS client_site,
        substring(repeat('n', {_N} * 50), 1, 120) AS niche, CASE WHEN {_N} > 0 THEN 'one|two' ELSE '' END AS queries,
        CASE WHEN {_N} > 0 THEN 2 ELSE 0 END AS queries_count, CASE WHEN {_N} > 1 THEN 'A|B' ELSE '' END AS regions,
        CASE WHEN {_N} > 1 THEN 2 ELSE 0 END AS regions_count, 'include' AS region_mode,
        CASE WHEN {_N} = 0 THEN 0 ELSE {_N} + 1 END AS sites_count,
        CASE WHEN {_N} = 0 THEN 0 ELSE {_N} // 2 + 1 END AS phones_count, {_N} = 1 AS is_demo FROM orders""",
    "q_run_list": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, {_STATUS} AS status, o_orderpriority AS operator_name,
        CASE WHEN {_N} = 0 THEN 0 ELSE {_N} + 1 END AS sites_count FROM orders WHERE o_orderpriority = '1-URGENT'
        ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50""",
    "q_run_count": """SELECT count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS total, 'blank' AS scope FROM orders
        UNION ALL SELECT count(*), 'all' FROM orders""",
    "q_run_page": """SELECT o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders QUALIFY rank BETWEEN 101 AND 150""",
    "q_run_compare": """WITH a AS (SELECT DISTINCT o_custkey AS site FROM orders WHERE year(o_orderdate) = 1996),
        b AS (SELECT DISTINCT o_custkey AS site FROM orders WHERE year(o_orderdate) = 1997)
        SELECT coalesce(a.site, b.site) AS site, CASE WHEN a.site IS NULL THEN 'new' WHEN b.site IS NULL THEN 'removed'
        ELSE 'common' END AS change FROM a FULL JOIN b ON a.site = b.site""",
    "q_resumable": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN false
        WHEN 'O' THEN {_N} <> 0 ELSE {_N} <> 1 END AS resumable FROM orders""",
    "q_same_client": f"""WITH r AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1000)
        SELECT 'c' || o_custkey || '.example.com' AS client_key, arg_max(id, (o_orderdate, id)) AS id FROM r
        WHERE o_orderstatus <> 'F' GROUP BY 1""",
    "q_same_client_all": """SELECT 'c' || o_custkey || '.example.com' AS client_key,
        arg_max(CAST(o_orderkey AS VARCHAR), (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS id FROM orders
        WHERE o_orderstatus <> 'F' GROUP BY 1""",
    "q_run_upsert": f"""WITH u AS (SELECT CASE WHEN event_type = 'signup' THEN 'new-' ELSE '' END || user_id AS id,
          arg_max('s' || event_id, event_id) FILTER (WHERE event_type IN ('purchase', 'signup')) AS status,
          arg_max(props, event_id) FILTER (WHERE event_type = 'view') AS pipeline_json,
          arg_max(props, event_id) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1),
        r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, {_STATUS} AS status, {_N} AS n, {_DAY} AS day FROM orders)
        SELECT coalesce(r.id, u.id) AS id, coalesce(u.status, r.status, 'pending') AS status,
          coalesce(u.pipeline_json, CASE n WHEN 3 THEN NULL WHEN 1 THEN '{{"analyze":"done","sources_reviewed":false}}'
            WHEN 2 THEN '{{"analyze":"running","sources_reviewed":true}}' WHEN 0 THEN '{{"analyze":"running","sources_reviewed":false}}'
            ELSE '{{}}' END) AS pipeline_json,
          coalesce(u.error, '-') AS error, CASE WHEN n = 1 THEN 1 ELSE 0 END AS is_demo,
          coalesce(day, '2026-01-01T00:00:00') AS created_at, CASE WHEN u.id IS NULL THEN day ELSE '2026-01-01T00:00:00' END AS updated_at
        FROM r FULL JOIN u ON r.id = u.id""",
    "q_site_status": f"WITH {_SITES} SELECT run_id, site, status FROM si",
    "q_progress": f"""WITH {_STEPS}, {_SITES},
        r AS (SELECT user_id AS run_id, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error'
                WHEN 'signup' THEN 'stopped' ELSE 'running' END, event_id) AS status,
              count(*) FILTER (WHERE event_type = 'view') AS checked, count(*) AS total FROM events GROUP BY 1),
        b AS (SELECT run_id, sum(CASE status WHEN 'done' THEN 16 WHEN 'running' THEN 8 ELSE 0 END) AS base,
              arg_max(step, array_position([{', '.join(q(s) for s in V.STEPS)}], step)) FILTER (WHERE status = 'running') AS current,
              bool_or(status = 'running' AND step = 'filter') AS f, bool_or(status = 'running' AND step = 'crawl') AS c FROM st GROUP BY 1),
        d AS (SELECT run_id, count(*) FILTER (WHERE status IN ('success', 'error', 'skip')) AS done, count(*) AS n FROM si GROUP BY 1)
        SELECT r.run_id, r.status, CAST(CASE WHEN r.status = 'done' THEN 100 ELSE least(coalesce(base, 0)
          + CASE WHEN f THEN floor(12.0::DOUBLE * checked / total) ELSE 0 END + CASE WHEN c THEN floor(8.0::DOUBLE * done / n) ELSE 0 END,
          CASE WHEN r.status IN ('running', 'pending') THEN 99 ELSE 100 END) END AS INTEGER) AS progress,
          CASE WHEN r.status = 'done' THEN '' ELSE coalesce(current, '') END AS current_step
        FROM r LEFT JOIN b USING (run_id) LEFT JOIN d USING (run_id)""",
    "q_reset_running": f"""WITH {_STEPS} SELECT step, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status,
        count(*) AS n FROM st GROUP BY 1, 2""",
    "q_newest_version": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "q_result_filter": f"""WITH {_GRID} SELECT ord, site, region, p1, p2 FROM g WHERE
        (status = {q(V.STATUS_FOUND)} AND p2_type = 'mobile' AND NOT for_definition AND contains({_HAY}, 'c1'))
        OR (region = 'NATION_3' AND p1_type = 'city')""",
    "q_result_sort": f"WITH {_GRID} SELECT ord, offer, row_number() OVER (ORDER BY lower(offer) DESC, ord) AS rank FROM g",
    "q_result_stats": f"""WITH {_GRID} SELECT offer, count(*) AS total, count(*) FILTER (WHERE p1 IS NOT NULL OR p2 IS NOT NULL) AS with_phone,
        count(*) FILTER (WHERE for_definition) AS marked, count(*) FILTER (WHERE status <> {q(V.STATUS_FOUND)}) AS excluded FROM g GROUP BY 1""",
    "q_region_groups": f"WITH {_GRID} SELECT coalesce(nullif(region, ''), {q(V.NO_REGION)}) AS region, count(*) AS n FROM g GROUP BY 1",
    "q_with_district": f"""WITH {_GRID}, dim(k, name, district_id, label) AS (VALUES {_DIM}),
        k AS (SELECT TRY_CAST(regexp_extract(region, '([0-9]+)$', 1) AS INTEGER) AS k, count(*) AS n FROM g GROUP BY 1)
        SELECT district_id, CAST(sum(n) AS BIGINT) AS n, max(label) AS last_label FROM k JOIN dim USING (k) GROUP BY 1""",
    "q_district_rollup": f"""WITH {_GRID}, d AS (SELECT n_name AS name, r_name AS district,
          n_name IN (SELECT region FROM g WHERE p2 IS NOT NULL AND offer = 'furniture') AS sel
          FROM nation JOIN region ON n_regionkey = r_regionkey),
        t AS (SELECT district, count(*) FILTER (WHERE sel) AS selected, count(*) AS total, 0 AS is_total FROM d GROUP BY 1
              UNION ALL SELECT NULL, count(*) FILTER (WHERE sel), count(*), 1 FROM d)
        SELECT *, CASE WHEN selected = 0 THEN 'none' WHEN selected = total THEN 'all' ELSE 'partial' END AS state FROM t""",
    "q_annotate": f"WITH {_GRID}, {_UPDATES} SELECT * FROM a",
    "q_annotate_counts": f"""WITH {_GRID}, {_UPDATES} SELECT CAST(sum(changes) AS BIGINT) AS changed,
        count(*) FILTER (WHERE for_definition) AS marked, count(*) AS n_rows FROM a""",
    "q_mark_visible": f"""WITH {_GRID} SELECT status, count(*) FILTER (WHERE for_definition
          OR (p1_type = 'city' AND status = {q(V.STATUS_FOUND)})) AS marked, count(*) AS n FROM g GROUP BY 1
        UNION ALL SELECT 'cleared', 0, count(*) FROM g""",
    "q_briefs": """SELECT o_orderkey, 'Client ' || o_custkey AS client,
        'https://c' || o_custkey || '.example.com/' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'a' END AS site,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'one ' || o_orderkey || '\ntwo: x' END AS queries,
        CASE WHEN o_orderstatus = 'P' THEN 50 ELSE CAST(left(o_orderpriority, 1) AS INTEGER) * 10 END AS max_sites,
        o_orderstatus <> 'F' AS check_alive, CASE WHEN o_orderstatus = 'P' THEN 7 ELSE 2 END AS depth,
        'serp|site|catalog' AS sources, 'include' AS region_mode FROM orders""",
    "q_legacy_sheet": """WITH c AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS key FROM customer)
        SELECT c_custkey, 'c' || c_custkey AS site, c_name AS name, 'R' AS region,
        CASE WHEN c_mktsegment = 'BUILDING' THEN '7495' || key ELSE '7495' || key || ',7900' || key END AS phones,
        CASE WHEN c_nationkey > 5 THEN 'src' ELSE '' END AS source, '' AS status FROM c""",
}
