"""The registered queries of the code-graph operators, each over its whole tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import scoring, text
from codeweft.operators import cache, changes, extract, graph, knowledge, postings, reports, search, semantics
from codeweft.operators.lineage import cut
from codeweft.plans import questions, retrieve
from codeweft.plans.demo_graph import EDGES_SQL, NODES_SQL, edges, key, nodes, table
from codeweft.sources import files
from codeweft.streaming.incremental import counted_windows, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the part of source files."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.octet_length("text").alias("bytes"), "text", F.sha2("text", 256).alias("content_hash"))


SOURCES_SQL = "files as (select doc_id, 'src/' || lang || '/' || source || '/' || doc_id || '.txt' as path, strlen(text) as bytes, text, sha256(text) as content_hash from documents)"

# -- sources, scalar functions, filters


@query(f"""with {SOURCES_SQL} select path, bytes, case
  when path = 'src/fr/src3' or path like 'src/fr/src3/%' or list_contains(string_split(path, '/'), 'src5') then 'excluded'
  when bytes > 8000 then 'too_large' else 'admitted' end as status from files""")
def scan_admission(spark, sf_dir):
    return files.admission(sources(spark, sf_dir), [".txt"], ["src/fr/src3", "src5"], most_bytes=8000).select("path", "bytes", "status")


@query(f"with {SOURCES_SQL} select path, sha256(path) as path_hash, content_hash, sha256(path || '|' || content_hash || '|v1') as cache_key from files")
def content_hashes(spark, sf_dir):
    s = sources(spark, sf_dir)
    return s.select("path", text.path_hash(F.col("path")).alias("path_hash"), "content_hash", text.cache_key(F.col("path"), F.col("content_hash"), "v1").alias("cache_key"))


@query("""with k as (select doc_id, 'class:' || replace(replace(text, chr(10), ''), chr(13), '') as k from documents),
c as (select doc_id, k, list_max(list_filter(range(1, 191), lambda n: strlen(left(k, n)) <= 190)) as n from k)
select doc_id, case when strlen(k) <= 250 then k else left(k, n) || '#' || substr(sha256(k), 1, 16) end as node_key from c""")
def key_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.normalized_key(F.concat(F.lit("class:"), "text")).alias("node_key"))


@query("select doc_id, sha256(array_to_string(string_split_regex(text, '\\r\\n|\\n|\\r')[2:4], chr(10))) as lines_hash from documents")
def line_range_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_range_hash(F.col("text"), 2, 4).alias("lines_hash"))


@query("""select doc_id, case when doc_id % 3 = 0 then source || '.' || doc_id when doc_id % 3 = 1 then lang || '.' || doc_id else null end as view_name from documents""")
def view_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tail = F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".blade.php"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("resources/views/components/"), "source", tail)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("resources\\views\\"), "lang", tail)).otherwise(F.concat(F.lit("app/"), "lang", tail))
    return d.select("doc_id", text.view_name(path).alias("view_name"))


@query("""with t as (select doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^\\pL\\pN]+'), lambda w: w <> '')[1:12] as w from documents)
select doc_id, array_to_string(list_sort(list_distinct(w)), ' ') as terms from t""")
def terms_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.terms(F.col("text"))), " ").alias("terms"))


@query("""with q as (select p_partkey, p_name, p_type, list_distinct(string_split(lower(p_name), ' ')) as a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as h, ['red widget', 'small ring', 'economy'] as qs from part),
e as (select p_partkey, p_name, p_type, h, unnest(qs) as query from q),
r as (select *, list_distinct(string_split(query, ' ')) as t from e)
select p_partkey, query, cast(round(60 * len(list_intersect(t, h)) / len(t)) as int) + case when lower(p_name) = query or lower(p_type) = query then 80 else 0 end as relevance from r""")
def relevance_score(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("query", F.explode(F.array(*map(F.lit, ("red widget", "small ring", "economy")))))
    return rows.select("p_partkey", "query", text.relevance(F.col("query"), [F.col("p_name"), F.col("p_type")]).alias("relevance"))


@query("select conv_id, turn, cast(ceil(strlen(text) / 4.0) as int) as tokens from conversations")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


@query("""select doc_id, sha256(regexp_replace(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(11)), '\\s+', ' ', 'g')) as fingerprint from documents""")
def text_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_fingerprint(F.col("text")).alias("fingerprint"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring') or contains(lower(p_name), 'red')")
def like_contains_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").where(search.contains_any(["ring", "red"], ["p_name"])).select("p_partkey", "p_name")


@query("select c_custkey, c_name from customer where starts_with(c_name, 'Customer#00000001')")
def prefix_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where json_extract_string(props, '$.k') is not null and cast(json_extract_string(props, '$.k') as int) < 20")
def json_predicate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null and k < 20")


@query("select event_id, user_id from events where ts + interval 10 day > timestamp '2024-01-20' or event_type = 'error'")
def not_expired(spark, sf_dir):
    expires = F.when(F.col("event_type") != "error", F.col("ts") + F.expr("interval 10 days"))
    return table(spark, sf_dir, "events").where(knowledge.not_expired(expires, F.lit("2024-01-20").cast("timestamp_ntz"))).select("event_id", "user_id")


@query("select event_id, event_type from events where ts >= timestamp '2024-01-30' - interval 7 day")
def ttl_prune(spark, sf_dir):
    return changes.pruned(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 7).select("event_id", "event_type")


@query("""select o_orderkey, case when o_orderstatus in ('F', 'O') and o_orderpriority <> '5-LOW' then 'a' when o_totalprice > 200000 then 'b' else 'c' end as kind from orders where o_orderstatus <> 'P' or o_totalprice is not null""")
def nested_predicates(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW"), "a").when(F.col("o_totalprice") > 200000, "b").otherwise("c")
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "P") | F.col("o_totalprice").isNotNull()).select("o_orderkey", kind.alias("kind"))


@query("""select p_partkey, case when ends_with(p_name, 'ring') then 'policy' when ends_with(p_name, 'widget') then 'listener' when p_size > 40 then 'job' when ends_with(p_name, 'gear') then 'event' else 'class' end as role,
 case when p_type = 'ECONOMY' then 'economies' when p_type = 'PROMO' then 'promos' else lower(p_type) || 's' end as many from part""")
def class_role_ladder(spark, sf_dir):
    name = F.col("p_name")
    for end, of in (("ring", "Policy"), ("widget", "Listener"), ("gear", "Event")):
        name = F.regexp_replace(name, f"{end}$", of)
    role = scoring.class_role(F.lit("class"), name, F.col("p_size") > 40)
    return table(spark, sf_dir, "part").select("p_partkey", role.alias("role"), text.plural(F.lower("p_type")).alias("many"))


@query("""with g as (select p_partkey, lower(p_type) as t from part), a as (select unnest([struct_pack(action := 'index', verb := 'GET', tail := ''), struct_pack(action := 'create', verb := 'GET', tail := '/create'), struct_pack(action := 'store', verb := 'POST', tail := ''), struct_pack(action := 'show', verb := 'GET', tail := '/{id}'), struct_pack(action := 'edit', verb := 'GET', tail := '/{id}/edit'), struct_pack(action := 'update', verb := 'PUT', tail := '/{id}'), struct_pack(action := 'destroy', verb := 'DELETE', tail := '/{id}')]) as a),
b as (select p_partkey, t, case when t = 'economy' then 'economies' else t || 's' end as many, a from g, a)
select p_partkey, a.action as action, a.verb as verb, many || replace(a.tail, '{id}', '{' || t || '}') as uri, many || '.' || a.action as route from b""")
def resource_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("resource"))
    out = extract.resource_routes(rows.select("resource").distinct(), "resource")
    return rows.join(out, "resource").select("p_partkey", "action", "verb", "uri", "route")


@query("""select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') as links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), ' ') as tags from pages""")
def template_captures(spark, sf_dir):
    cap = lambda p: F.array_join(F.array_sort(extract.distinct_captures(F.col("html"), p)), " ")
    return table(spark, sf_dir, "pages").select("page_id", cap('href="([^"]*)"').alias("links"), cap("<([a-z][a-z0-9]*)").alias("tags"))


def _asked(name: str) -> str:
    return f"regexp_matches(t, '{scoring.TASK_WORDS[name]}') as {name}"


@query(f"""with c as (select conv_id, turn, trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(11)) as t from conversations),
b as (select *, {', '.join(map(_asked, scoring.TASK_WORDS))} from c),
a as (select *, symbol or root or (change and name) as app, symbol or inspect as ins from b),
s as (select *, app or (not documentation and not framework) as idx, list_filter([case when app or (not documentation and not framework) then 'index' end, case when framework and (documentation or app) then 'laravel_boost' end, case when ins or app then 'source_inspection' end], lambda x: x is not null) as f from a)
select conv_id, turn, case when len(f) > 0 then array_to_string(f, ',') else 'source_inspection' end as sources,
 case when not idx then '' else 'index_status' || case when impact then ',impact_analysis' else '' end || case when symbol then ',symbol_lookup' else ',module_context' end || case when symbol and not impact then ',impact_analysis' else '' end end as tools,
 case when app and framework then '{scoring.REASONS[0]}' when framework and documentation then '{scoring.REASONS[1]}' when app then '{scoring.REASONS[2]}' else '{scoring.REASONS[3]}' end as reason from s""")
def route_task(spark, sf_dir):
    r = scoring.routed(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(r["sources"], ",").alias("sources"), F.array_join(r["tools"], ",").alias("tools"), r["reason"].alias("reason"))


# -- joins


@query(f"""with {NODES_SQL}, {EDGES_SQL} select e.source_key, e.target_key, e.relationship, s.node_type as source_type, t.node_type as target_type, s.symbol_name as source_symbol, t.symbol_name as target_symbol
 from edges e left join nodes s on e.source_key = s.node_key left join nodes t on e.target_key = t.node_key""")
def edge_endpoints_left(spark, sf_dir):
    out = graph.endpoints(edges(spark, sf_dir), nodes(spark, sf_dir))
    return out.select("source_key", "target_key", "relationship", "source_type", "target_type", "source_symbol", "target_symbol")


@query(f"""with {NODES_SQL} select r.r_name as module_name, coalesce(c.n, 0) as symbols from region r left join (select module_key, count(*) as n from nodes group by 1) c on c.module_key = 'region-' || r.r_regionkey""")
def count_by_module(spark, sf_dir):
    counts = nodes(spark, sf_dir).groupBy("module_key").agg(F.count(F.lit(1)).alias("n"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("module_key"), F.col("r_name").alias("module_name"))
    return region.join(counts, "module_key", "left").select("module_name", F.coalesce("n", F.lit(0)).alias("symbols"))


@query("""with m as (select 'lang-en' as module_key, 'src/en' as prefix union all select 'en-src1', 'src/en/src1' union all select 'all-src', 'src' union all select 'fr-src2', 'src/fr/src2'),
f as (select doc_id, 'src/' || lang || '/' || source || '/' || doc_id || '.txt' as path from documents)
select doc_id, arg_max(module_key, length(prefix)) as module_key from f join m on path = prefix or starts_with(path, prefix || '/') group by doc_id""")
def longest_prefix_module(spark, sf_dir):
    modules = [("lang-en", ["src/en"]), ("en-src1", ["src/en/src1"]), ("all-src", ["src"]), ("fr-src2", ["src/fr/src2"])]
    return files.module_of(sources(spark, sf_dir), modules).select("doc_id", "module_key")


@query("""with p as (select distinct 'src/' || lang || '/' || source as prefix, 'm-' || lang || '-' || source as module_key from documents where lang <> 'de')
select doc_id, coalesce(p.module_key, 'src-' || lang) as module_key from documents d left join p on p.prefix = 'src/' || lang || '/' || source""")
def longest_prefix_module_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang != 'de'").select(F.concat_ws("/", F.lit("src"), "lang", "source").alias("prefix"), F.concat_ws("-", F.lit("m"), "lang", "source").alias("module_key")).distinct()
    return files.module_of_rows(sources(spark, sf_dir), d).select("doc_id", "module_key")


@query("select a.p_partkey, b.p_partkey as same_as from part a join (select min(p_partkey) as p_partkey, upper(p_name) as n from part group by 2) b on lower(a.p_name) = lower(b.n)")
def case_insensitive_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = p.groupBy(F.lower(F.upper("p_name")).alias("n")).agg(F.min("p_partkey").alias("same_as"))
    return p.join(first, F.lower("p_name") == F.col("n")).select("p_partkey", "same_as")


@query("select sha256(text) as identity, count(distinct doc_id) as owners from documents group by 1 having count(distinct doc_id) > 1")
def duplicate_declarations(spark, sf_dir):
    return changes.duplicate_declarations(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@query(f"with {NODES_SQL} select node_key, 'nation:' || regexp_extract(file_path, 'nation-([0-9]+)', 1) as owner_key, n_name as owner from nodes join nation on n_nationkey = cast(regexp_extract(file_path, 'nation-([0-9]+)', 1) as int) where node_type = 'method'")
def owner_of_member(spark, sf_dir):
    n = nodes(spark, sf_dir)
    owner = F.concat(F.lit("nation:"), F.regexp_extract("file_path", "nation-([0-9]+)", 1))
    owners = n.where("node_type = 'class'").select(F.col("node_key").alias("owner_key"), F.col("symbol_name").alias("owner"))
    return n.where("node_type = 'method'").withColumn("owner_key", owner).join(owners, "owner_key").select("node_key", "owner_key", "owner")


@query(f"""with {NODES_SQL}, {EDGES_SQL}, paths as (select o_orderkey, unnest(['order:' || o_orderkey, 'customer:' || o_custkey, 'part:' || (o_orderkey % 3000)]) as k from orders)
select o_orderkey, bool_and(node_key is not null) as complete, count(node_key) as n from paths left join nodes on k = node_key group by 1""")
def unnest_refs_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    refs = F.array(key("order", "o_orderkey"), key("customer", "o_custkey"), F.concat(F.lit("part:"), (F.col("o_orderkey") % 3000).cast("string")))
    seen = o.select("o_orderkey", F.explode_outer(refs).alias("node_key")).join(nodes(spark, sf_dir).select("node_key", F.lit(1).alias("there")), "node_key", "left")
    return seen.groupBy("o_orderkey").agg(F.bool_and(F.col("there").isNotNull()).alias("complete"), F.count("there").alias("n"))


@query(f"""with {NODES_SQL}, {EDGES_SQL}, e as (select * from edges where relationship <> 'uses_model' or target_key like '%7')
select node_key from nodes where file_path is null and node_key not in (select source_key from e) and node_key not in (select target_key from e)""")
def orphans(spark, sf_dir):
    """Parts without a file lose their last edge if only those to keys that end with 7 are left."""
    left = edges(spark, sf_dir).where("relationship != 'uses_model' or target_key like '%7'")
    return changes.orphans(nodes(spark, sf_dir), left).select("node_key")


@query(f"""with {NODES_SQL}, {EDGES_SQL}, gone as (select node_key from nodes where node_type in ('table', 'route') and substr(content_hash, 1, 1) in ('0', '1')),
used as (select source_key as k from edges union select target_key from edges)
select node_key, case when k is not null then 'stub' else 'deleted' end as outcome from gone left join used on node_key = k""")
def referenced_retire(spark, sf_dir):
    gone = nodes(spark, sf_dir).where(F.col("node_type").isin("table", "route") & F.substring("content_hash", 1, 1).isin("0", "1"))
    return changes.retired(gone, edges(spark, sf_dir))


@query("""with e as (select user_id, cast(ts as date) as d, sha256(array_to_string(list_sort(array_agg(event_type || ':' || value)), ',')) as h from events group by 1, 2),
o as (select * from e where d = date '2024-01-10'), n as (select * from e where d = date '2024-01-11')
select coalesce(o.user_id, n.user_id) as user_id, case when o.user_id is null then 'added' when n.user_id is null then 'removed' when o.h = n.h then 'same' else 'changed' end as change from o full join n on o.user_id = n.user_id""")
def snapshot_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    daily = e.groupBy("user_id", "d").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", F.col("value").cast("string")))), ","), 256).alias("h"))
    return changes.difference(daily.where("d = date'2024-01-10'"), daily.where("d = date'2024-01-11'"), "user_id", "h")


@query("""with o as (select p_partkey, p_size, p_retailprice from part where p_size <= 25), n as (select p_partkey, p_size + 1 as p_size, p_retailprice * 2 as p_retailprice from part where p_size >= 10)
select coalesce(n.p_partkey, o.p_partkey) as p_partkey, coalesce(n.p_size, o.p_size) as p_size, coalesce(o.p_retailprice, n.p_retailprice) as p_retailprice from o full join n on o.p_partkey = n.p_partkey""")
def keyed_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    new = p.where("p_size >= 10").selectExpr("p_partkey", "p_size + 1 as p_size", "p_retailprice * 2 as p_retailprice")
    return changes.upserted(p.where("p_size <= 25"), new, ["p_partkey"], kept=["p_retailprice"])


@query("""select p_partkey, p_size from part where p_size <= 25 union all select p_partkey, p_size + 100 from part where p_size > 25""")
def insert_or_ignore(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return changes.inserted(p.where("p_size <= 25"), p.where("p_size >= 10").selectExpr("p_partkey", "p_size + 100 as p_size"), "p_partkey")


@query("""select 'order:' || l_orderkey as source_key, 'part:' || l_partkey as target_key, 'uses_model' as relationship, max(cast(1 - l_discount as decimal(3,2))) as confidence from lineitem group by 1, 2""")
def edge_combine_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(key("order", "l_orderkey").alias("source_key"), key("part", "l_partkey").alias("target_key"), F.lit("uses_model").alias("relationship"), (1 - F.col("l_discount")).cast("decimal(3,2)").alias("confidence"), "l_linenumber")
    return changes.combined_edges(raw, ["l_linenumber"]).drop("l_linenumber")


@query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def node_last_wins(spark, sf_dir):
    return changes.last_of_each(table(spark, sf_dir, "events"), "user_id", F.col("event_id"), ["event_type", "value"])


@query("""select l_partkey, array_to_string(list_sort(array_agg(distinct l_suppkey)), ',') as suppliers from lineitem group by 1""")
def collect_bindings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("suppliers"))


@query("""with s as (select 'table:' || p_brand as k, list_sort(array_agg(distinct p_type)) as sources, list_sort(array_agg(distinct p_name)) as members from part group by 1)
select k as node_key, array_to_string(sources, ',') as sources, len(members) as n, sha256(array_to_string(sources, ',') || '|' || array_to_string(members, ',')) as content_hash from s""")
def shared_table_reconcile(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("node_key", F.concat(F.lit("table:"), "p_brand"))
    out = changes.shared_rows(rows, "node_key", "p_type", F.col("p_name"))
    return out.select("node_key", F.array_join("sources", ",").alias("sources"), F.size("members").cast("long").alias("n"), "content_hash")


# -- aggregates, windows, sets


@query("select o_orderstatus as state, count(*) as n from orders group by 1")
def count_by_state(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as runs, round(avg(value), 2) as mean_latency, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as characters, cast(ceil(sum(cast(json_extract_string(props, '$.k') as bigint)) / 4.0) as bigint) as tokens from events")
def telemetry_summary(spark, sf_dir):
    return reports.telemetry(table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), "value", "k")


@query("""select event_type, count(*) as n, array_to_string(list_sort(array_agg(event_id))[1:3], ',') as examples from events group by 1""")
def category_histogram_examples(spark, sf_dir):
    out = reports.histogram(table(spark, sf_dir, "events"), "event_type", "event_id")
    return out.select("event_type", "n", F.array_join("examples", ",").alias("examples"))


@query("""with l as (select doc_id as path, sha256(text) as h from documents where doc_id % 10 <> 0), i as (select doc_id as path, case when doc_id % 7 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 9 <> 0)
select case when l.path is null then 'missing' when i.path is null then 'not_indexed' when l.h = i.h then 'fresh' else 'changed' end as status, count(*) as n from l full join i on l.path = i.path group by 1""")
def health_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return reports.health(d.where("path % 10 != 0"), d.where("path % 9 != 0").withColumn("content_hash", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("content_hash"))))


@query("select event_type, median(value) as median_value, max(event_id) as high_water from events group by 1")
def median_latency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median_value"), F.max("event_id").alias("high_water"))


@query("select event_id, event_type from events order by event_id desc limit 25")
def latest_n(spark, sf_dir):
    return reports.latest(table(spark, sf_dir, "events"), "event_id", 25).select("event_id", "event_type")


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role from conversations group by 1")
def latest_row(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("""select conv_id, turn, row_number() over w as version, lag(conv_id || '-' || turn) over w as previous_key, lead(conv_id || '-' || turn) over w as superseded_by from conversations window w as (partition by conv_id order by turn)""")
def version_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return changes.versions(c, "conv_id", "turn", "k").select("conv_id", "turn", F.col("version").cast("long").alias("version"), "previous_key", "superseded_by")


@query("""with a as (select distinct l_partkey as k from lineitem where l_quantity > 25), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'R')
select 'both' as kind, k from (select k from a intersect select k from b) union all select 'only_a', k from (select k from a except select k from b) union all select 'either', k from (select k from a union select k from b)""")
def set_ops(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = li.where("l_quantity > 25").select(F.col("l_partkey").alias("k")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    named = lambda df, n: df.select(F.lit(n).alias("kind"), "k")
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "only_a")).unionByName(named(a.union(b).distinct(), "either"))


@query("""select event_type, cast(cast(ts as date) as timestamp) as start, count(*) as n from events group by 1, 2""")
def tumbling_windows(spark, sf_dir):
    return counted_windows(table(spark, sf_dir, "events"), "ts", "event_type").select("event_type", "start", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as first from events),
s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, session""")
def session_windows(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "ts", "user_id")


# -- search, ranking, packing


@query("""with s as (select p_partkey, p_name, 3 * (contains(lower(p_name), 'ring')::int + contains(lower(p_name), 'red')::int) + 2 * (contains(lower(p_type), 'ring')::int + contains(lower(p_type), 'red')::int) + contains(lower(p_brand), 'ring')::int + contains(lower(p_brand), 'red')::int as score from part)
select p_partkey, p_name, score from s where score > 0 order by score desc, p_name, p_partkey limit 40""")
def lexical_topk(spark, sf_dir):
    return search.lexical_top(table(spark, sf_dir, "part"), ["ring", "red"], {"p_name": 3, "p_type": 2, "p_brand": 1}, ["p_name", "p_partkey"], 40).select("p_partkey", "p_name", "score")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packets, their turns as items; what the same role says in the same words is one item's text."""
    c = table(spark, sf_dir, "conversations")
    compact = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return c.select("conv_id", F.concat("role", F.lit("-"), F.length("text").cast("string")).alias("id"), (F.length("text") % 7).cast("int").alias("score"), "text", compact.alias("compact"), "turn")


PACKETS_SQL = "p as (select conv_id, role || '-' || length(text) as id, cast(length(text) % 7 as int) as score, text, case when turn % 2 = 0 then 'turn ' || turn end as compact, turn from conversations)"


@query(f"""with recursive {PACKETS_SQL}, d as (select distinct conv_id, id, score, text, sha256(regexp_replace(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(11)), '\\s+', ' ', 'g')) as fp, sha256(text) as h from p),
r as (select *, row_number() over (partition by conv_id order by score desc, id, h) as rn from d),
fold as (select conv_id, 0::bigint as rn, []::varchar[] as ids, []::varchar[] as fps, []::bigint[] as kept from (select distinct conv_id from r)
  union all
  select f.conv_id, r.rn, case when seen then f.ids else list_append(f.ids, r.id) end, case when seen then f.fps else list_append(f.fps, r.fp) end, case when seen then f.kept else list_append(f.kept, r.rn) end
  from (select f.*, r.id, r.fp, r.rn as at, list_contains(f.ids, r.id) or list_contains(f.fps, r.fp) as seen from fold f join r on r.conv_id = f.conv_id and r.rn = f.rn + 1) f join r on r.conv_id = f.conv_id and r.rn = f.at),
last as (select conv_id, kept from fold qualify row_number() over (partition by conv_id order by rn desc) = 1)
select r.conv_id, r.id, r.score, r.text from r join last l on l.conv_id = r.conv_id and list_contains(l.kept, r.rn)""")
def rank_dedupe(spark, sf_dir):
    return search.deduplicated(packets(spark, sf_dir), "conv_id").select("conv_id", "id", "score", "text")


@query(f"""with recursive {PACKETS_SQL}, i as (select conv_id, row_number() over (partition by conv_id order by score desc, turn) as rn, turn as id, strlen(text) as full_size, strlen(compact) as small from p),
fold as (
  select conv_id, 0::bigint as rn, 6::bigint as used, ''::varchar as ids, 0::bigint as omitted, 0::bigint as compacted from (select distinct conv_id from i)
  union all
  select f.conv_id, i.rn,
    case when f.used + 1 + i.full_size <= 240 then f.used + 1 + i.full_size when i.small is not null and f.used + 1 + i.small <= 240 then f.used + 1 + i.small else f.used end,
    case when f.used + 1 + i.full_size <= 240 or (i.small is not null and f.used + 1 + i.small <= 240) then f.ids || i.id || ',' else f.ids end,
    f.omitted + case when f.used + 1 + i.full_size <= 240 or (i.small is not null and f.used + 1 + i.small <= 240) then 0 else 1 end,
    f.compacted + case when f.used + 1 + i.full_size > 240 and i.small is not null and f.used + 1 + i.small <= 240 then 1 else 0 end
  from fold f join i on i.conv_id = f.conv_id and i.rn = f.rn + 1)
select conv_id, used, ids, omitted, compacted from (select *, row_number() over (partition by conv_id order by rn desc) as last from fold) where last = 1""")
def budget_pack(spark, sf_dir):
    out = search.packed(packets(spark, sf_dir).withColumn("id", F.col("turn")), "conv_id", "packet", 60)
    ids = F.concat(F.array_join("ids", ","), F.when(F.size("ids") > 0, ",").otherwise(""))
    return out.select("conv_id", F.col("used").cast("long").alias("used"), ids.alias("ids"), F.col("omitted").cast("long").alias("omitted"), F.col("compacted").cast("long").alias("compacted"))


# -- graph

IMPACT_SQL = f"""with {NODES_SQL}, {EDGES_SQL},
e as (select target_key as near, source_key as far, relationship, cast(confidence as double) as c, 'incoming' as direction from edges where relationship not in ('contains', 'defines')
  union all select source_key, target_key, relationship, cast(confidence as double), 'outgoing' from edges join nodes on node_key = source_key where relationship in ('contains', 'defines') and node_type in ('class', 'listener')),
v0 as (select 'nation:3' as k, cast(1 as double) as c),
l1 as (select far as k, relationship, direction, e.c as edge, least(v0.c, e.c) as c from e join v0 on near = v0.k where far not in (select k from v0) qualify row_number() over (partition by far order by e.c desc, near, relationship) = 1),
l2 as (select far as k, e.relationship, e.direction, e.c as edge, least(l1.c, e.c) as c from e join l1 on near = l1.k where far not in (select k from v0 union all select k from l1) qualify row_number() over (partition by far order by e.c desc, near, e.relationship) = 1),
f as (select *, 1 as distance from l1 union all select *, 2 from l2)
select f.k as node_key, node_type, f.relationship, f.direction, f.distance, least(f.c, f.edge) as confidence,
  case when node_type in ('route', 'policy', 'migration', 'table') then 'high' when node_type in ('listener', 'event', 'job') or relationship = 'calls' then 'medium' else 'low' end as risk,
  greatest(1, 100 - 15 * f.distance) as score from f join nodes on node_key = f.k"""


@query(IMPACT_SQL)
def impact_bfs(spark, sf_dir):
    found, _ = graph.impact(edges(spark, sf_dir), nodes(spark, sf_dir), "nation:3", depth=2)
    return found.select("node_key", "node_type", "relationship", "direction", "distance", "confidence", "risk", "score")


@query(f"""with {NODES_SQL}, {EDGES_SQL},
e as (select target_key as near, source_key as far, relationship, cast(confidence as double) as c from edges where relationship not in ('contains', 'defines')
  union all select source_key, target_key, relationship, cast(confidence as double) from edges join nodes on node_key = source_key where relationship in ('contains', 'defines') and node_type in ('class', 'listener')),
v0 as (select 'nation:3' as k, cast(1 as double) as c),
f1 as (select far as k, relationship, e.c as edge, least(v0.c, e.c) as c from e join v0 on near = v0.k where far not in (select k from v0) qualify row_number() over (partition by far order by e.c desc, near, relationship) = 1),
l1 as (select * from f1 qualify row_number() over (order by edge desc, k) <= 30),
f2 as (select far as k, e.relationship, e.c as edge, least(l1.c, e.c) as c from e join l1 on near = l1.k where far not in (select k from v0 union all select k from l1) qualify row_number() over (partition by far order by e.c desc, near, e.relationship) = 1),
l2 as (select * from f2 qualify row_number() over (order by edge desc, k) <= 30 - (select count(*) from l1)),
f as (select *, 1 as distance from l1 union all select *, 2 from l2)
select f.k as node_key, f.relationship, f.distance, least(f.c, f.edge) as confidence from f join nodes on node_key = f.k""")
def impact_bfs_capped(spark, sf_dir):
    found, _ = graph.impact(edges(spark, sf_dir), nodes(spark, sf_dir), "nation:3", depth=2, most=30)
    return found.select("node_key", "relationship", "distance", "confidence")


@query(f"with {NODES_SQL} select node_key, node_type from nodes where module_key = 'region-2' and node_type <> 'file' order by node_type, node_key limit 51")
def impact_module_members(spark, sf_dir):
    return graph.module_members(nodes(spark, sf_dir), "region-2", 50).select("node_key", "node_type")


@query(f"""with {NODES_SQL}, {EDGES_SQL}, s as (select node_key from nodes where node_key in ('customer:7', 'customer:11', 'nation:3')),
b as (select *, target_key in (select node_key from s) as incoming from edges where relationship not in ('contains', 'defines') and (target_key in (select node_key from s) or source_key in (select node_key from s)))
select source_key, target_key, relationship, confidence, incoming from b order by confidence desc, source_key, target_key, relationship limit 80""")
def neighborhood(spark, sf_dir):
    seeds = nodes(spark, sf_dir).where(F.col("node_key").isin("customer:7", "customer:11", "nation:3"))
    return graph.neighborhood(edges(spark, sf_dir), seeds).select("source_key", "target_key", "relationship", "confidence", "incoming")


@query("""with recursive e as (select 'c:' || o_custkey as s, 'o:' || o_orderkey as t from orders union all select 'o:' || l_orderkey, 'p:' || l_partkey from lineitem union all select 'p:' || p_partkey, 'b:' || p_brand from part),
h as (select 'c:7' as k, 0 as depth union select t, depth + 1 from h join e on s = k where depth < 4)
select k as node_key, min(depth) as depth from h where k <> 'c:7' group by 1""")
def include_hops(spark, sf_dir):
    made = lambda df, s, t: df.select(s.alias("source_key"), t.alias("target_key"), F.lit("renders_view").alias("relationship"))
    e = made(table(spark, sf_dir, "orders"), key("c", "o_custkey"), key("o", "o_orderkey")).union(made(table(spark, sf_dir, "lineitem"), key("o", "l_orderkey"), key("p", "l_partkey"))).union(made(table(spark, sf_dir, "part"), key("p", "p_partkey"), key("b", "p_brand")))
    found, _ = graph.hops(e, spark.range(1).select(F.lit("c:7").alias("node_key")), ("renders_view", "uses_component"))
    return found.select("node_key", "depth")


@query(f"""with {NODES_SQL}, m as (select *, row_number() over (order by node_key) as rn from nodes where symbol_name = 'small ring'),
c as (select *, row_number() over (order by symbol_name, node_key) as rn from nodes where node_type <> 'file' and contains(lower(symbol_name), 'customer#00000001'))
select 'Supplier:3' as target, 'similar' as step, null as node_key where false
union all select 'supplier:3', 'key', node_key from nodes where node_key = 'supplier:3'
union all select 'small ring', 'symbol', node_key from m where rn <= 6
union all select 'CUSTOMER#00000001', 'similar', node_key from c where rn <= 6
union all select 'ASIA', 'module', 'region-' || r_regionkey from region where r_name = 'ASIA'""")
def resolve_symbol(spark, sf_dir):
    """Targets that different steps find: a key, a symbol that several nodes have, a part of symbols, a module's name, and none."""
    n = cut(nodes(spark, sf_dir))
    modules = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("module_key"), F.col("r_name").alias("name"))
    found = [graph.resolve_target(n, t, modules).select(F.lit(t).alias("target"), "step", "node_key") for t in ("supplier:3", "small ring", "CUSTOMER#00000001", "ASIA", "nobody at all")]
    return reduce(DataFrame.unionByName, found)


@query("""with recursive p as (select p_partkey as k, p_size = 50 as adapts, p_partkey % 5 = 0 as declares, p_size = 3 as private from part),
w as (select k as start, k as spot, 0 as lvl from p
  union all select w.start, w.spot // 2, lvl + 1 from w join p on p.k = w.spot where not p.declares and not p.adapts and w.spot > 0),
l as (select start, max(lvl) as lvl from w group by 1),
o as (select w.start, w.spot, w.lvl, p.k, p.adapts, p.declares, p.private from l join w using (start, lvl) left join p on p.k = w.spot),
s as (select start, spot, case when k is null then 'unknown' when declares then case when private and lvl > 0 then 'unknown' else 'resolved' end when adapts then 'unknown' else 'none' end as state from o)
select 'class:' || start as class_key, case when state = 'resolved' then 'method:' || spot end as method_key, state from s""")
def inherited_resolution(spark, sf_dir):
    """Parts as classes: each extends the part of half its key or uses it as a trait; every class is asked for a method."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    c = lambda col: F.concat(F.lit("class:"), col.cast("string"))
    classes = p.select(c(F.col("p_partkey")).alias("class_key"), (F.col("p_size") == 50).alias("adapts"))
    methods = p.where("p_partkey % 5 = 0").select(c(F.col("p_partkey")).alias("class_key"), F.lit("run").alias("name"), F.concat(F.lit("method:"), F.col("p_partkey").cast("string")).alias("method_key"), (F.col("p_size") == 3).alias("private"))
    parents = p.where("p_partkey > 0").select(c(F.col("p_partkey")).alias("class_key"), c(F.floor(F.col("p_partkey") / 2)).alias("parent_key"), F.when(F.col("p_partkey") % 3 == 0, "trait").otherwise("extends").alias("kind"))
    return graph.inherited_methods(classes, methods, parents, classes.select("class_key", F.lit("Run").alias("name"))).select("class_key", "method_key", "state")


@query("""with f as (select o_orderkey, case o_orderkey % 13 when 0 then 'facade_accessor' when 1 then 'container_binding' when 2 then 'unresolved_method' when 3 then 'namespace_fallback' when 4 then 'global_fallback' when 5 then 'framework_type' when 6 then 'eloquent_builder_forward' end as res,
 case o_orderkey % 7 when 0 then 'ambiguous' when 1 then 'nonsense' end as given, case o_orderkey % 11 when 0 then 'app' when 1 then 'new' end as via,
 o_orderstatus = 'F' as stub, o_custkey % 2 = 0 as app, o_custkey % 3 = 0 as cls, o_custkey % 5 = 0 as meth, o_custkey % 19 = 0 as facade, o_custkey % 17 = 0 as ext, o_orderpriority = '1-URGENT' as fl from orders),
c as (select case when facade or res = 'facade_accessor' then 'laravel_facade' when res = 'container_binding' or via = 'app' then 'service_container' when res = 'eloquent_builder_forward' or (fl and stub) then 'fluent_chain' when res = 'unresolved_method' then 'inheritance_or_trait'
 when res = 'namespace_fallback' then 'php_namespace_fallback' when res = 'global_fallback' then 'php_global_fallback' when res = 'framework_type' or (ext and stub) then 'external_vendor'
 when not stub then 'resolved' when app and cls then 'missing_scan' when app and meth then 'analyzer_limitation' when app then 'missing_receiver_type' else 'external_vendor' end as category, given from f),
s as (select category, case when category in ('laravel_facade', 'service_container', 'fluent_chain') then case when given = 'ambiguous' then given else 'partially_resolved' end
 when category = 'inheritance_or_trait' then case when given = 'ambiguous' then given else 'unresolved' end when category like 'php_%' then 'partially_resolved' when category = 'external_vendor' then 'external' when category = 'resolved' then 'resolved' else 'unresolved' end as state from c)
select category, state, count(*) as n from s group by 1, 2""")
def classify_calls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one_of = lambda column, names: reduce(lambda a, b: a.when(*b), [(column == i, n) for i, n in list(enumerate(names))[1:]], F.when(column == 0, names[0]))
    res = one_of(F.col("o_orderkey") % 13, ("facade_accessor", "container_binding", "unresolved_method", "namespace_fallback", "global_fallback", "framework_type", "eloquent_builder_forward"))
    urgent, customer = F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")
    facts = {"resolution": res, "resolution_state": one_of(F.col("o_orderkey") % 7, ("ambiguous", "nonsense")), "via": one_of(F.col("o_orderkey") % 11, ("app", "new")), "facade": customer % 19 == 0, "eloquent": urgent, "fluent": urgent, "target_stub": F.col("o_orderstatus") == "F", "external_prefix": customer % 17 == 0, "application": customer % 2 == 0, "class_stub": customer % 3 == 0, "method_indexed": customer % 5 == 0}
    return o.select(scoring.call_category(facts).alias("c")).groupBy("c.category", "c.state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {EDGES_SQL} select source_key, target_key, 70 + cast(round(20 * confidence) as int) + case when source_key = 'order:7' then 40 else 0 end + case when relationship = 'uses_model' then 15 else 0 end as score from edges where relationship not in ('contains')""")
def edge_scores(spark, sf_dir):
    e = edges(spark, sf_dir).where("relationship != 'contains'")
    return e.select("source_key", "target_key", scoring.edge_score(F.col("confidence"), F.col("source_key") == "order:7", F.col("relationship"), F.lit(True)).alias("score"))


# -- knowledge, evaluation


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assertions about the documents after them."""
    d = table(spark, sf_dir, "documents")
    k = lambda c: F.concat(F.lit("doc:"), c.cast("string"))
    refs = F.array(k(F.col("doc_id")), k(F.col("doc_id") + 1))
    hashes = F.create_map(k(F.col("doc_id")), F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.sha2("text", 256)), k(F.col("doc_id") + 1), F.lit("next"))
    expires = F.when(F.col("doc_id") % 13 == 0, F.lit("2024-01-01").cast("timestamp_ntz"))
    state = F.when(F.col("doc_id") % 6 == 0, "archived").when(F.col("doc_id") % 2 == 0, "draft").otherwise("active")
    return d.select(k(F.col("doc_id")).alias("knowledge_key"), state.alias("state"), expires.alias("expires_at"), refs.alias("source_refs"), F.when(F.col("doc_id") % 5 != 0, hashes).alias("source_hashes"))


@query("""with k as (select doc_id, case when doc_id % 13 = 0 then 'expired' when doc_id % 5 <> 0 and doc_id % 10 = 8 then 'removed: doc:' || doc_id
  when doc_id % 5 <> 0 and doc_id % 10 = 3 then 'changed: doc:' || doc_id
  when doc_id % 5 <> 0 and (doc_id + 1) % 10 = 8 then 'removed: doc:' || (doc_id + 1) when doc_id % 5 <> 0 and (doc_id + 1) % 10 = 3 then 'changed: doc:' || (doc_id + 1) end as reason, doc_id % 6 = 0 as closed from documents)
select 'doc:' || doc_id as knowledge_key, reason from k where not closed and reason is not null""")
def knowledge_invalidate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1)).where("doc_id % 10 in (3, 8)")
    changed = d.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_key"), F.when(F.col("doc_id") % 10 == 3, "new").alias("new_hash"))
    return knowledge.invalidated(assertions(spark, sf_dir), changed, F.lit("2024-06-01").cast("timestamp_ntz"))


@query("""select case when doc_id % 6 = 0 then 'closed' when doc_id % 5 = 0 then 'unverified' else 'evidence' end as review, count(*) as n from documents group by 1""")
def knowledge_review(spark, sf_dir):
    return knowledge.reviewed(assertions(spark, sf_dir)).groupBy("review").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'customer:' || c_custkey as knowledge_key, c_custkey % 2 = 0 and c_custkey % 3 <> 0 and c_custkey % 5 <> 0 as valid from customer where c_custkey % 7 <> 0""")
def knowledge_usable(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), nodes(spark, sf_dir).where("node_type = 'method'").select(F.col("node_key").alias("ref"), "content_hash")
    rows = c.select("c_custkey", key("customer", "c_custkey").alias("knowledge_key")).join(n, F.col("knowledge_key") == F.col("ref"))
    k = rows.select("knowledge_key", F.when(F.col("c_custkey") % 2 == 0, "active").otherwise("draft").alias("state"), F.when(F.col("c_custkey") % 7 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("expires_at"), F.array(F.when(F.col("c_custkey") % 5 == 0, F.lit("nowhere")).otherwise(F.col("ref"))).alias("source_refs"), F.create_map("ref", F.when(F.col("c_custkey") % 3 == 0, F.lit("old")).otherwise(F.col("content_hash"))).alias("source_hashes"))
    return knowledge.usable(k, nodes(spark, sf_dir), F.lit("2024-01-01").cast("timestamp_ntz")).select("knowledge_key", "valid")


@query(f"""with {NODES_SQL}, a as (select distinct p_name as name from part union select 'customer:' || c_custkey from customer where c_custkey < 50 union select n_name from nation union select 'nobody'),
s as (select symbol_name, count(*) as n, min(node_key) as k from nodes group by 1)
select a.name, case when x.node_key is not null then x.node_key when s.n = 1 then s.k end as node_key, case when x.node_key is not null then 'key' when s.n = 1 then 'symbol' when s.n > 1 then 'ambiguous' else 'unverified' end as how
from a left join nodes x on x.node_key = a.name left join s on s.symbol_name = a.name""")
def evidence_resolution(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    asked = t("part").select(F.col("p_name").alias("name")).union(t("customer").where("c_custkey < 50").select(key("customer", "c_custkey"))).union(t("nation").select("n_name")).union(spark.range(1).select(F.lit("nobody"))).distinct()
    return knowledge.evidence(asked, nodes(spark, sf_dir))


@query("""with r as (select source as scenario, doc_id as item_id, row_number() over (partition by source order by n_chars desc, doc_id) as position from documents qualify position <= 20),
x as (select source as scenario, 'doc/' || d.doc_id as item, d.doc_id from documents d join labels l using (doc_id) where quality = 1 and d.n_chars > 4000),
p as (select x.scenario, x.item, r.position from x left join r on r.scenario = x.scenario and r.item_id = x.doc_id),
a as (select scenario, round(avg(case when position <= 8 then 1.0 else 0.0 end), 4) as recall_at_k, round(avg(case when position is not null then 1.0 else 0.0 end), 4) as recall_in_packet, min(case when position <= 8 then position end) as first, count(case when position <= 8 then 1 end) as hits from p group by 1),
k as (select scenario, least(count(*), 8) as n from r group by 1)
select a.scenario, recall_at_k, recall_in_packet, round(hits / cast(n as double), 4) as precision_at_k, case when first is null then 0.0 else round(1.0 / first, 4) end as reciprocal_rank from a join k using (scenario)""")
def evaluate_retrieval(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    retrieved = d.withColumn("position", F.row_number().over(order)).where("position <= 20").select(F.col("source").alias("scenario"), "position", F.concat(F.lit("Corpus\\doc\\"), F.col("doc_id").cast("string")).alias("identity"))
    good = d.where("n_chars > 4000").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    expected = good.select(F.col("source").alias("scenario"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item"))
    return reports.evaluated(retrieved, expected)


# -- retrieval: the items that each public operation gathers


def memory(spark: SparkSession, sf_dir: str) -> retrieve.Memory:
    """The demo graph, regions as modules, suppliers as rules about themselves and conversations as changes."""
    n = nodes(spark, sf_dir)
    modules = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("module_key"), F.col("r_name").alias("name"), F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("root_path"))
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    held = s.join(n.select("node_key", "content_hash"), key("supplier", "s_suppkey") == F.col("node_key"))
    rules = held.select(
        F.concat(F.lit("rule-"), F.lpad(k.cast("string"), 9, "0")).alias("knowledge_key"), F.lit("architectural_rule").alias("kind"), F.col("s_name").alias("title"), F.lit("stays where it is").alias("body"),
        F.when(k % 3 == 0, "draft").otherwise("active").alias("state"), ((k % 11) / 10).alias("confidence"), F.when(k % 7 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"),
        F.array("node_key").alias("source_refs"), F.create_map("node_key", F.when(k % 5 == 0, F.lit("old")).otherwise(F.col("content_hash"))).alias("source_hashes"),
    )
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("intent"), F.max_by("role", "turn").alias("validation"), F.lit(None).cast("string").alias("lessons"))
    return retrieve.Memory(n, edges(spark, sf_dir), modules, rules, c)


def gathered(spark: SparkSession, sf_dir: str, operation: str, **asked) -> DataFrame:  # noqa: ANN003
    return retrieve.gather(memory(spark, sf_dir), operation, **asked).items.select("id", "score", "text")


RULES_SQL = """rules as (select 'rule-' || lpad(cast(s_suppkey as varchar), 9, '0') as k, s_suppkey, s_name, least(1.0, (s_suppkey % 11) / 10.0) as confidence, 'region-' || n_regionkey as module_key from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0 and s_suppkey % 7 <> 0),
top_rules as (select * from rules order by k limit 160),
rule_items as (select 'knowledge:' || k as id, cast(120 + round(10 * confidence) as int) as score, 'Rule [active] architectural_rule: ' || s_name || '. stays where it is' as text from top_rules where s_suppkey % 5 <> 0)"""


@query(f"""with {NODES_SQL}, {EDGES_SQL}, {RULES_SQL},
c as (select (select count(*) from nodes) as n, (select count(*) from edges) as e, (select count(*) from region) as m, (select count(*) from supplier where s_suppkey % 3 <> 0) as r)
select 'overview-counts' as id, 180 as score, 'Nodes: ' || n || '. Edges: ' || e || '. Modules: ' || m || '. Active stored rules: ' || r || '. Last run: never.' as text from c
union all select 'module:region-' || r_regionkey, 80, 'Module region-' || r_regionkey || ' (' || r_name || ') root region-' || r_regionkey || ' symbols ' || coalesce(n, 0) || '.' from region left join (select module_key, count(*) as n from nodes where node_type <> 'file' group by 1) on module_key = 'region-' || r_regionkey
union all select * from rule_items""")
def project_overview(spark, sf_dir):
    return gathered(spark, sf_dir, "project_overview")


@query(f"with {RULES_SQL} select * from rule_items")
def architecture_rules(spark, sf_dir):
    return gathered(spark, sf_dir, "architecture_rules")


@query("""select 'change:' || conv_id as id, 70 as score, trim('Change #' || conv_id || ' ' || arg_min(text, turn) || ' validation ' || arg_max(role, turn) || ' lessons none') as text from conversations group by conv_id order by conv_id desc limit 10""")
def change_history(spark, sf_dir):
    return gathered(spark, sf_dir, "change_history")


def _edge_items_sql(seeds: str, owned: str = "false") -> str:
    return f"""near as (select *, target_key in (select node_key from {seeds}) as incoming from edges where relationship not in ('contains', 'defines') and (target_key in (select node_key from {seeds}) or source_key in (select node_key from {seeds})) order by confidence desc, source_key, target_key, relationship limit 80),
edge_items as (select 'edge:' || source_key || '>' || relationship || '>' || target_key as id, 70 + cast(round(20 * confidence) as int) + case when {owned} then 40 else 0 end + case when relationship = 'uses_model' then 15 else 0 end as score,
  case when incoming then 'incoming ' else 'outgoing ' end || relationship || ' ' || case when incoming then s.symbol_name else t.symbol_name end || ' confidence ' || confidence || ' file ' || coalesce(case when incoming then s.file_path else t.file_path end, 'unresolved') as text
  from near join nodes s on s.node_key = source_key join nodes t on t.node_key = target_key)"""


@query(f"""with {NODES_SQL}, {EDGES_SQL}, own as (select * from nodes where module_key = 'region-1' and (contains(lower(symbol_name), 'customer') or contains(lower(file_path), 'customer'))),
top as (select * from own order by case when contains(lower(symbol_name), 'customer') then 3 else 0 end + case when contains(lower(file_path), 'customer') then 1 else 0 end desc, node_type, symbol_name, node_key limit 160),
seeds as (select node_key from top order by node_type, symbol_name, node_key limit 8), {_edge_items_sql('seeds')}, {RULES_SQL},
own_rules as (select * from rules where module_key = 'region-1' order by k limit 160)
select 'module-header:region-1' as id, 180 as score, 'Module region-1 ' || r_name || ' root region-1. No stored summary.' as text from region where r_regionkey = 1
union all select node_key, case when node_type = 'method' then 140 else 150 end, node_type || ' ' || symbol_name || ' at ' || file_path || ':?. ' || node_type from top
union all select * from edge_items
union all select 'knowledge:' || k, cast(110 + round(10 * confidence) as int), 'Rule [active] architectural_rule: ' || s_name || '. stays where it is' from own_rules where s_suppkey % 5 <> 0""")
def module_context(spark, sf_dir):
    return gathered(spark, sf_dir, "module_context", module="region-1", query="Customer")


@query(f"""with {NODES_SQL}, {EDGES_SQL}, found as (select * from nodes where node_key = 'customer:7'), {_edge_items_sql('found', "source_key = 'customer:7' or target_key = 'customer:7'")}
select node_key as id, 180 as score, node_type || ' ' || symbol_name || ' at ' || file_path || ':?. ' || node_type as text from found union all select * from edge_items""")
def symbol_lookup(spark, sf_dir):
    return gathered(spark, sf_dir, "symbol_lookup", symbol="customer:7")


@query(f"""with {NODES_SQL}, {EDGES_SQL},
e as (select target_key as near, source_key as far, relationship, cast(confidence as double) as c from edges where relationship not in ('contains', 'defines')),
l1 as (select far as k, relationship, c as edge, c from e where near = 'customer:7' qualify row_number() over (partition by far order by c desc, relationship) = 1)
select 'impact-subject' as id, 180 as score, 'Subject ' || node_type || ' ' || symbol_name || ' ' || node_key as text from nodes where node_key = 'customer:7'
union all select k || ':' || relationship || ':incoming', 85, 'd1 incoming ' || relationship || ' ' || symbol_name || ' confidence ' || printf('%.2f', c) || ' risk high file ' || file_path || '. Incoming ' || relationship || ' relationship.' from (select * from l1 order by edge desc, k limit 30) join nodes on k = node_key""")
def impact_analysis(spark, sf_dir):
    return gathered(spark, sf_dir, "impact_analysis", target="customer:7", depth=1)


# -- cache, versions, overlays


@query("""select doc_id, case when doc_id % 5 = 0 then null when doc_id % 7 = 0 then null else lang end as lang from documents""")
def cache_verified(spark, sf_dir):
    """Entries for all documents but every fifth; every seventh is corrupt and counts as a miss."""
    d = table(spark, sf_dir, "documents")
    k = F.sha2(F.col("doc_id").cast("string"), 256)
    payload = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    held = cache.entries(d.where("doc_id % 5 != 0"), k, payload, F.lit("2024-01-01").cast("timestamp_ntz"))
    bad = d.where("doc_id % 7 = 0").select(k.alias("_key"))
    held = held.join(bad, F.col("cache_key") == F.col("_key"), "left").withColumn("artifact_hash", F.when(F.col("_key").isNotNull(), "x").otherwise(F.col("artifact_hash"))).drop("_key")
    return cache.hits(held, d.select("doc_id", k.alias("cache_key"))).select("doc_id", F.element_at("payload", "lang").alias("lang"))


@query("""select p_partkey, '{"brand":"' || p_brand || '","size":"' || case when p_size > 20 then 'big' else cast(p_size as varchar) end || '"}' as meta from part""")
def map_overlay(spark, sf_dir):
    under = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    over = F.when(F.col("p_size") > 20, F.create_map(F.lit("size"), F.lit("big"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_json(text.overlaid(under, over)).alias("meta"))


@query("""select p_partkey, p_retailprice, true as truncated from part order by p_retailprice desc, p_partkey limit 50""")
def limit_probe(spark, sf_dir):
    return search.limited(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 50)


@query("""select 'k' || c_custkey as knowledge_key, 'l' || c_custkey as lineage_key, 1 as version, case when c_custkey % 4 = 0 then 'archived' else 'active' end as state, c_name as body from customer
union all select 'r' || c_custkey, 'l' || c_custkey, 2, 'active', c_mktsegment from customer where c_custkey % 4 = 0""")
def knowledge_revise(spark, sf_dir):
    c, name = table(spark, sf_dir, "customer"), lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    k = c.select(name("k").alias("knowledge_key"), name("l").alias("lineage_key"), F.lit(1).alias("version"), F.lit("active").alias("state"), F.col("c_name").alias("body"))
    r = c.where("c_custkey % 4 = 0").select(name("k").alias("previous_key"), name("r").alias("knowledge_key"), F.col("c_mktsegment").alias("body"))
    return knowledge.revised(k, r)


@query(f"""with {NODES_SQL} select node_key, case when node_type = 'class' then true when file_path is null then false else substr(content_hash, 1, 1) <> '0' end as fresh from nodes""")
def node_freshness(spark, sf_dir):
    """Every node rests on its own path; live hashes of nodes other than classes whose hash begins with 0 have moved on."""
    n = nodes(spark, sf_dir)
    moved = (F.substring("content_hash", 1, 1) == "0") & (F.col("node_type") != "class")
    live = n.where("file_path is not null").select(F.col("file_path").alias("path"), F.when(moved, "new").otherwise(F.col("content_hash")).alias("live_hash"))
    return reports.fresh_nodes(n, live, F.array_compact(F.array("file_path"))).select("node_key", "fresh")


@query("""with c as (select c_custkey, c_mktsegment as k from customer), b as (select p_type as k, count(distinct p_brand) as n, min(p_brand) as one from part group by 1)
select o_orderkey, case when n is null then 'external' when n > 1 then 'ambiguous' else 'partially_resolved' end as state from (select o_orderkey, ['ECONOMY', 'LARGE', 'NOWHERE'][1 + o_orderkey % 3] as k from orders) o left join b using (k)""")
def facade_bindings(spark, sf_dir):
    """Calls through an accessor: the set of what is bound to it decides the state."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(F.lit("ECONOMY"), F.lit("LARGE"), F.lit("NOWHERE")), (F.col("o_orderkey") % 3).cast("int")).alias("k"))
    bound = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("k")).agg(F.collect_set("p_brand").alias("concretes"))
    state = F.when(F.col("concretes").isNull(), "external").when(F.size("concretes") > 1, "ambiguous").otherwise("partially_resolved")
    return o.join(bound, "k", "left").select("o_orderkey", state.alias("state"))


@query("""with b as (select p_type as accessor, count(distinct p_brand) as n, min(p_brand) as one from part group by 1),
a as (select distinct p_type as accessor, length(p_type) % 2 = 0 as is_class from part union all select 'NOWHERE', true union all select 'CART', false),
s as (select accessor, is_class, coalesce(n, 0) as n, one, case when is_class then case when n = 1 then 'partially_resolved' else 'external' end when n > 1 then 'ambiguous' else 'partially_resolved' end as state from a left join b using (accessor)),
c as (select o_orderkey, case o_orderkey % 4 when 0 then 'NOWHERE' when 1 then 'CART' when 2 then 'OTHER' else (select min(p_type) from part) end as f, case when o_orderkey % 3 = 0 then 'declared_method' end as r from orders)
select o_orderkey, case when r is null and accessor is not null then 'facade_accessor' else r end as resolution, case when r is null then state end as resolution_state, case when r is null then accessor end as facade_accessor, case when r is null and n = 1 then one end as bound_concrete from c left join s on f = accessor""")
def facade_calls(spark, sf_dir):
    """Static calls through facades: by what is bound to their accessors, whether those are declared, and what is settled already."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    least = p.agg(F.min("p_type")).first()[0]
    named = F.when(F.col("o_orderkey") % 4 == 0, "NOWHERE").when(F.col("o_orderkey") % 4 == 1, "CART").when(F.col("o_orderkey") % 4 == 2, "OTHER").otherwise(F.lit(least))
    calls = o.select("o_orderkey", F.concat(F.lit("method:Front\\"), named, F.lit("::go")).alias("target_key"), F.when(F.col("o_orderkey") % 3 == 0, "declared_method").alias("resolution"))
    types = p.select("p_type").distinct().select("p_type", F.when(F.length("p_type") % 2 == 0, "class").otherwise("container_key").alias("kind"))
    types = types.union(spark.createDataFrame([("NOWHERE", "class"), ("CART", "container_key")], "p_type string, kind string"))
    accessors = types.select(F.concat(F.lit("class:front\\"), "p_type").alias("class_key"), F.col("p_type").alias("facade_accessor"), F.col("kind").alias("accessor_kind"))
    out = semantics.facade_calls(calls, accessors, p.select(F.col("p_type").alias("abstract"), F.col("p_brand").alias("concrete")), spark.createDataFrame([], "class_key string"))
    return out.select("o_orderkey", "resolution", "resolution_state", "facade_accessor", "bound_concrete")


@query("""select 'm' || n_nationkey as module_key, case when n_nationkey % 2 = 0 then n_name else 'old' end as name, case when n_nationkey % 2 = 0 then 'src/' || n_nationkey else 'was' end as root_path,
  case when n_nationkey % 2 = 0 then 'note=kept paths=src/' || n_nationkey else 'note=kept paths=was' end as metadata from nation where n_nationkey < 20
union all select 'm' || n_nationkey, n_name, 'src/' || n_nationkey, 'paths=src/' || n_nationkey from nation where n_nationkey >= 20 and n_nationkey % 2 = 0""")
def modules_ensured(spark, sf_dir):
    n, name = table(spark, sf_dir, "nation"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))
    old = n.where("n_nationkey < 20").select(name.alias("module_key"), F.lit("old").alias("name"), F.lit("was").alias("root_path"), F.create_map(F.lit("note"), F.lit("kept"), F.lit("paths"), F.lit("was")).alias("metadata"))
    root = F.concat(F.lit("src/"), F.col("n_nationkey").cast("string"))
    new = n.where("n_nationkey % 2 = 0").select(name.alias("module_key"), F.col("n_name").alias("name"), root.alias("root_path"), F.create_map(F.lit("paths"), root).alias("metadata"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    return changes.modules_ensured(old, new.union(new)).select("module_key", "name", "root_path", shown.alias("metadata"))


# -- many questions at once, the index over symbols, nested JSON


@query("""with a as (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by 'order:' || o_orderkey || ':') as n, unnest([2, 1]) as before from customer join orders on o_custkey = c_custkey),
s as (select case when before = 2 then 'lookup-' else 'impact-' end || c_custkey as scenario, o_orderkey, n + before as position, n + before <= 8 as top, before from a),
x as (select *, o_orderkey % 3 = 0 as wanted from s),
r as (select scenario, any_value(before) as before, count(*) as n, avg(case when top then 1.0 else 0.0 end) filter (where wanted) as recall, sum(case when top and wanted then 1 else 0 end) as hits, min(position) filter (where wanted and top) as first from x group by 1 having bool_or(wanted))
select scenario, round(recall, 4) as recall_at_k, cast(1 as double) as recall_in_packet, round(hits / cast(least(8, n + before) as double), 4) as precision_at_k, case when first is null then 0.0 else round(1.0 / first, 4) end as reciprocal_rank, true as within_budget, false as truncated from r""")
def evaluate_by_retrieval(spark, sf_dir):
    """For each customer a lookup and an impact analysis, answered together and judged by how many of the customer's orders they show."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.create_map(F.lit("lookup"), F.lit("symbol_lookup"), F.lit("impact"), F.lit("impact_analysis"))).alias("kind", "operation"))
    asked = asked.select(F.concat_ws("-", "kind", F.col("c_custkey").cast("string")).alias("question"), "operation", key("customer", "c_custkey").alias("asked"), "c_custkey")
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("item"))
    m = memory(spark, sf_dir)
    # no sources are compared here, so hashes of contents aren't read; edges aren't written, as each step makes only those of the kinds that it asks for
    m = retrieve.Memory(cut(m.nodes.drop("content_hash")), m.edges, m.modules)
    out = questions.evaluated(m, asked.drop("c_custkey"), asked.join(wanted, "c_custkey").select("question", "item"), budget=8000, max_nodes=200)
    return out.drop("estimated_context_tokens")


@query(f"""with {NODES_SQL}, w as (select distinct lower(unnest([n_name, n_name[2:5], n_name[1:2], n_name[3:3]])) as word from nation union select distinct lower(p_name) from part),
h as (select node_key, unnest([struct_pack(field := 'symbol_name', t := lower(symbol_name)), struct_pack(field := 'file_path', t := lower(file_path))]) as f from nodes)
select word, f.field as field, count(*) as n, min(node_key) as first from h join w on contains(f.t, word) group by 1, 2""")
def symbols_containing(spark, sf_dir):
    """Words of all lengths out of the tables, each in all symbols and paths that contain it."""
    names = table(spark, sf_dir, "nation").select(F.explode(F.array("n_name", F.substring("n_name", 2, 4), F.substring("n_name", 1, 2), F.substring("n_name", 3, 1))).alias("w"))
    words = names.union(table(spark, sf_dir, "part").select("p_name")).select(F.lower("w").alias("word"))
    return postings.counted(nodes(spark, sf_dir), words)


@query(f"""with {NODES_SQL}, s as (select node_key, list_sum([3 * contains(lower(symbol_name), w)::int + coalesce(contains(lower(file_path), w)::int, 0) for w in ['ring', 'red', 'customer', '7']]) as score from nodes)
select node_key, cast(score as bigint) as score from s where score > 0 order by score desc, node_key limit 200""")
def indexed_topk(spark, sf_dir):
    return postings.indexed_top(postings.postings(nodes(spark, sf_dir)), ["ring", "red", "customer", "7"], 200)


@query("""select event_id, '{"a":{"b":[' || event_id || ',{"x":"' || event_type || '","y":' || json(props)::varchar || '}],"c":null},"z":true}' as canonical, sha256('{"a":{"b":[' || event_id || ',{"x":"' || event_type || '","y":' || json(props)::varchar || '}],"c":null},"z":true}') as artifact_hash from events""")
def nested_canonical_json(spark, sf_dir):
    written = F.format_string('{ "z": true, "a": {"c": null, "b": [%d, {"y": %s, "x": "%s"}]}}', "event_id", "props", "event_type")
    rows = table(spark, sf_dir, "events").select("event_id", text.canonical_text(written).alias("canonical"))
    return rows.withColumn("artifact_hash", F.sha2("canonical", 256))
