"""Dependency, lineage and privacy queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import graph as G
from ..operators import privacy as P
from ..registry import query


def _seeds(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "seed long")


REACH = "with recursive r(seed, node, depth) as (select s, dst, 1 from {seeds} join v_edges on src = s union select seed, dst, depth + 1 from r join v_edges on src = node), c as (select seed, node, min(depth) as depth from r group by 1, 2) "
SEED = lambda *n: "(select unnest([" + ", ".join(map(str, n)) + "]) as s)"
ALL = "(select distinct p_partkey as s from part)"


@query(REACH.format(seeds=SEED(5, 7)) + "select * from c")
def graph_downstream(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(fx.edges(spark, sf), _seeds(spark, 5, 7))


@query(REACH.format(seeds=SEED(300, 155)).replace("select s, dst, 1 from", "select s, src, 1 from").replace("on src = s", "on dst = s").replace("select seed, dst, depth + 1", "select seed, src, depth + 1").replace("on src = node", "on dst = node") + "select * from c")
def graph_upstream(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(fx.edges(spark, sf), _seeds(spark, 300, 155), "up")


@query("with recursive r(node, level) as (select src, 0 from v_edges where src not in (select dst from v_edges) union select dst, level + 1 from r join v_edges on src = node) select node, max(level) as level from r group by 1")
def graph_levels(spark: SparkSession, sf: str) -> DataFrame:
    return G.levels(fx.edges(spark, sf))


@query("with recursive e as (select * from v_edges union all select 40, 5), r(node) as (select dst from (select 40 as src, 5 as dst) union select e.dst from r join e on e.src = r.node) select distinct node from r")
def graph_cyclic_nodes(spark: SparkSession, sf: str) -> DataFrame:
    back = spark.createDataFrame([(40, 5)], "src long, dst long")
    return G.cyclic_nodes(fx.edges(spark, sf).union(back))


CYCLES = "with recursive e as (select src, dst from v_edges union select dst, src from v_edges where dst % 7 = 0 and src > 3 union all select 5, 5), r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on e.src = r.b) "


@query(CYCLES + "select least(x.a, min(x.b)) as component, x.a as node from r x join r y on y.a = x.b and y.b = x.a group by x.a")
def graph_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the dependencies when every seventh node's edges also lead back, and node 5 depends on itself."""
    e = fx.edges(spark, sf)
    back = e.where("dst % 7 = 0 and src > 3").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.cycles(e.union(back).union(spark.createDataFrame([(5, 5)], "src long, dst long")))


@query(REACH.format(seeds=ALL) + "select * from c")
def graph_reach_all(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that depends on each node."""
    return G.closure_all(fx.edges(spark, sf))


@query(REACH.format(seeds=SEED(10, 11, 250)) + ", n as (select node, min(seed) filter (depth = 1) as parent, min(seed) as ancestor from c group by 1) select coalesce(n.node, o.node) as node, coalesce(own, 'downstream of ' || coalesce(parent, ancestor)) as reason from n full join (select 10 as node, 'changed' as own union all select 11, 'changed' union all select 250, 'new') o on o.node = n.node")
def graph_affected(spark: SparkSession, sf: str) -> DataFrame:
    return G.affected(fx.edges(spark, sf), _seeds(spark, 10, 11).withColumnRenamed("seed", "node"), _seeds(spark, 250).withColumnRenamed("seed", "node"))


CHANGES = [(5, "C2", "REMOVE", None, None, None), (7, "c1", "TYPE_CHANGE", "Integer", "bigint", None), (7, "c0", "ADD", None, None, None), (9, "c2", "TYPE_CHANGE", "string", "varchar", None), (11, "c0", "RENAME", None, None, "c1"), (12, "c1", "TYPE_CHANGE", "DATE", "timestamp", None)]
PROMISED = ["BIGINT", "INT", "DOUBLE"]


@query(REACH.format(seeds=SEED(5, 7, 9, 11, 12)) + f""", ch as (select "table" as t, lower("column") as col, kind, case when kind = 'REMOVE' or kind = 'RENAME' or "column" = 'c2' then 2 when kind = 'TYPE_CHANGE' then 1 else 0 end as r, new_type, new_name from {fx.values(CHANGES, '"table", "column", kind, old_type, new_type, new_name')}),
  nm as (select t, col, r from ch union all select t, new_name, r from ch where new_name is not null),
  u as (select c.node, max(r) as r, list_sort(list(distinct nm.col)) as columns from c join nm on nm.t = seed where (c.node + nm.t + ascii(nm.col[2])) % 2 = 0 group by 1),
  w as (select c.node, case when kind = 'REMOVE' then 'COLUMN_REMOVED' when kind = 'RENAME' then 'COLUMN_RENAMED' when kind = 'TYPE_CHANGE' and not (upper(new_type) = 'BIGINT' and c.node % 3 < 2) then 'TYPE_CHANGED' end as what, ch.col from c join ch on ch.t = seed where c.node % 7 < 3 and ch.col = 'c' || (c.node % 7)),
  v as (select node, list_sort(list(distinct col || ' ' || what)) as violations from w where what is not null group by 1), g as (select node, min(depth) as depth from c group by 1)
  select g.node, g.depth, coalesce(columns, []) as columns, coalesce(violations, []) as violations, case when violations is not null or r = 2 then 'BREAKING' when r = 1 then 'WARNING' else 'INFO' end as severity from g left join u using (node) left join v using (node)""")
def impact_column_change(spark: SparkSession, sf: str) -> DataFrame:
    """Six changes; nodes read columns by a rule and promise one of three with one of three types."""
    changes = spark.createDataFrame(CHANGES, "table long, column string, kind string, old_type string, new_type string, new_name string")
    nodes = fx.lineage(spark, sf).select(F.col("table").alias("node")).distinct()
    refs = nodes.withColumn("table", F.explode(F.array(*map(F.lit, (5, 7, 9, 11, 12))).cast("array<long>"))).withColumn("column", F.explode(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2")))).where("(node + table + ascii(substring(column, 2, 1))) % 2 = 0")
    contracts = nodes.where("node % 7 < 3").select("node", F.concat(F.lit("C"), (F.col("node") % 7).cast("string")).alias("column"), F.element_at(F.array(*map(F.lit, PROMISED)), (F.col("node") % 3 + 1).cast("int")).alias("data_type"))
    return G.impact(fx.edges(spark, sf), refs, contracts, changes)


@query(REACH.format(seeds=SEED(6)) + "select node, depth, node not in (select dst from v_edges where src <> 6) as orphan from c")
def impact_removal(spark: SparkSession, sf: str) -> DataFrame:
    return G.removal(fx.edges(spark, sf), 6)


@query("""with recursive l as (select "table"::varchar as t, "column" as c, source_table::varchar as st, source_column as sc, transform as x, case transform when 'direct' then 0 when 'cast' then 1 when 'expression' then 3 else 5 end as k from v_lineage),
  r(t, c, depth, path, kinds, k) as (select st, sc, 1, [st || '.' || sc], [x], k from l where t = '300' and c = 'c0' union all select st, sc, depth + 1, list_append(path, st || '.' || sc), list_append(kinds, x), greatest(r.k, l.k) from r join l using (t, c))
  select t as "table", c as "column", min(depth)::int as depth, t not in (select t from l) as terminal, arg_min(path, struct_pack(a := depth, b := path)) as path, arg_min(kinds, struct_pack(a := depth, b := path)) as transforms, arg_min(['direct', 'cast', '', 'expression', '', 'aggregate'][k + 1], struct_pack(a := depth, b := path)) as transform from r group by t, c""")
def lineage_trace(spark: SparkSession, sf: str) -> DataFrame:
    return G.lineage_trace(fx.lineage(spark, sf), 300, "c0")


def _probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), ((F.col("p_size") % 10) / 10).alias("p"))


@query(REACH.format(seeds=ALL) + """, p as (select p_partkey as node, (p_size % 10) / 10 as p from part), u as (select c.node, max(p * pow(0.8::double, depth)) as ur, min(p) as weakest from c join p on p.node = seed group by 1), d as (select seed as node, count(*) as dn from c group by 1),
  j as (select p.node, p, coalesce(ur, 0) as ur, weakest, least(1, coalesce(dn, 0) * p / (select count(*) from p)) as cascade from p left join u using (node) left join d using (node)) select node, round(ur, 6) as upstream_risk, round(cascade, 6) as cascade, round(least(10 * (0.4::double * p + 0.3::double * least(ur, 1) + 0.3::double * cascade), 10), 2) as score, p > 0.3 and coalesce(weakest, 1) > 0.3 as critical from j""")
def fragility(spark: SparkSession, sf: str) -> DataFrame:
    return G.fragility(fx.edges(spark, sf), _probabilities(spark, sf))


@query("select distinct src from v_edges where src not in (select p_partkey from part where p_partkey % 3 <> 0)")
def unknown_refs(spark: SparkSession, sf: str) -> DataFrame:
    known = fx.table(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("src"))
    return fx.edges(spark, sf).select("src").distinct().join(known, "src", "left_anti")


@query("select distinct src, dst from (select src, dst from v_edges union all select dst % 50, dst from v_edges) where src <> dst")
def edges_union(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.edges(spark, sf)
    return e.union(e.select((F.col("dst") % 50).alias("src"), "dst")).where("src <> dst").distinct()


@query(REACH.format(seeds=ALL) + """, d as (select seed as node, max(depth) as depth, count(*) filter (node % 20 = 0) as sla, count(*) filter (node % 30 = 7) as dash, count(*) filter (node % 11 = 0) as crit from c group by 1), s as (select node, (p_size % 10) / 10 as p, least(1.5 * depth, 6) + case when sla > 0 then 3 else 0 end + case when dash > 0 then 2 else 0 end + case when (p_size % 10) / 10 > 0.05 then 1 else 0 end + 0.5 * crit as raw from d join part on p_partkey = node)
  select node, round(least(10, raw), 2)::double as score, least(10, raw) >= 3 as needs_approval, least(10, raw) >= 7 as critical from s""")
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    """0 to 10 from the depth and the tags of what lies downstream, and the node's own failure rate. Needs all pairs of nodes that are connected."""
    p = _probabilities(spark, sf)
    d = G.closure_all(fx.edges(spark, sf)).join(p.select(F.col("node").alias("seed")), "seed", "left_semi").groupBy(F.col("seed").alias("node")).agg(F.max("depth").alias("depth"), F.count_if(F.col("node") % 20 == 0).alias("sla"), F.count_if(F.col("node") % 30 == 7).alias("dash"), F.count_if(F.col("node") % 11 == 0).alias("crit"))
    raw = F.least(1.5 * F.col("depth"), F.lit(6.0)) + F.when(F.col("sla") > 0, 3).otherwise(0) + F.when(F.col("dash") > 0, 2).otherwise(0) + F.when(F.col("p") > 0.05, 1).otherwise(0) + 0.5 * F.col("crit")
    return d.join(p, "node").withColumn("s", F.least(F.lit(10.0), raw)).select("node", F.round("s", 2).alias("score"), (F.col("s") >= 3).alias("needs_approval"), (F.col("s") >= 7).alias("critical"))


def _replaced(c: str, rules: list[tuple[str, str]]) -> str:
    """The rules one after another as DuckDB text. It has no look-ahead, so where a rule asks for one, what it excludes is set apart by a mark before the rule and freed after it."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    for pattern, to in rules:
        if not (ahead := re.search(r"\(\?!(.*?)\)", pattern)):
            c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(to)}, 'g')"
            continue
        before, after = pattern[: ahead.start()], pattern[ahead.end() :]
        names = re.search(r"\(\?:(.*?)\)(.*)", before)
        marked = f"{before[: names.start()]}({names[1]})({names[2]}{ahead[1]})"
        c = f"replace(regexp_replace(regexp_replace({c}, {quoted(marked)}, '\\1' || chr(1) || '\\2', 'g'), {quoted(before + after)}, {quoted(to)}, 'g'), chr(1), '')"
    return c


NAMED = "(select p_partkey, 'select * from t where full_name = ''' || p_name || ''' and mail = ''a' || p_partkey || '@x.org'' and id = ' || (1000000 + p_partkey) || ' and note = ''it''''s'' and ip <> 10.0.0.' || (p_partkey % 256) as text from part)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = F.concat(F.lit("select * from t where full_name = '"), "p_name", F.lit("' and mail = 'a"), k.cast("string"), F.lit("@x.org' and id = "), (k + 1000000).cast("string"), F.lit(" and note = 'it''s' and ip <> 10.0.0."), (k % 256).cast("string"))
    return fx.table(spark, sf, "part").select("p_partkey", s.alias("text"))


@query(f"select doc_id, {_replaced('text', P.PROFILES['telemetry'])} as text from documents")
def pii_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return P.scrub(fx.table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query(f"select doc_id, {_replaced('text', P.PROFILES['prompt'])} as text from documents")
def pii_scrub_llm(spark: SparkSession, sf: str) -> DataFrame:
    return P.scrub(fx.table(spark, sf, "documents").select("doc_id", "text"), ["text"], "prompt")


@query("select doc_id, " + " or ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in [*[p for p, _ in P.PROMPT], P.PROMPT_LITERAL]) + " as has_pii from documents")
def pii_flag(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", P.contains_pii(F.col("text")).alias("has_pii"))


@query(f"select p_partkey, {_replaced('text', P.PROFILES['sql'])} as text from {NAMED}")
def sql_literal_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return P.scrub(_named(spark, sf), ["text"], "sql")


@query(f"select p_partkey, {_replaced('text', P.PROFILES['prompt_sql'])} as text from {NAMED}")
def sql_prompt_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return P.scrub(_named(spark, sf), ["text"], "prompt_sql")


@query("select substr(sha256('salt' || user_id), 1, 16) as user_id, count(*) as n from events group by 1")
def anonymize_ids(spark: SparkSession, sf: str) -> DataFrame:
    return P.anonymize(fx.events(spark, sf).select("user_id"), ["user_id"], "salt").groupBy("user_id").agg(F.count("*").alias("n"))


@query("select event_id, case when user_id % 3 = 1 then substr(sha256('salt' || user_id), 1, 16) else user_id::varchar end as user_id from events where user_id % 3 <> 0")
def consent_filter(spark: SparkSession, sf: str) -> DataFrame:
    consent = F.when(F.col("user_id") % 3 == 1, "anonymized").when(F.col("user_id") % 3 == 2, "full")
    return P.apply_consent(fx.events(spark, sf).withColumn("consent", consent), "consent", ["user_id"], ["event_type"], "salt").select("event_id", "user_id")


@query("select event_id, ts from events where ts >= timestamp '2024-01-31' - interval 10 day")
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    return P.purge(fx.events(spark, sf).select("event_id", "ts"), "ts", 10, fx.NOW)


@query("""select * from (select 'telemetry' as "table", count(*) filter (captured_at >= timestamp '2024-01-31' - interval 15 day) as kept, count(*) filter (captured_at < timestamp '2024-01-31' - interval 15 day) as purged from v_telemetry
  union all select 'audit', count(*) filter (ts >= timestamp '2024-01-31' - interval 10 day), count(*) filter (ts < timestamp '2024-01-31' - interval 10 day) from events
  union all select 'outbox', count(*) filter (created_at >= timestamp '2024-01-31' - interval 24 hour), count(*) filter (created_at < timestamp '2024-01-31' - interval 24 hour) from v_outbox)""")
def retention_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.purge_counts({"telemetry": (fx.telemetry(spark, sf), "captured_at", "15 days"), "audit": (fx.events(spark, sf), "ts", "10 days"), "outbox": (fx.outbox(spark, sf), "created_at", "24 hours")}, fx.NOW)


@query("select event_id, case when user_id = 3 then '[REDACTED]' else user_id::varchar end as user_id, case when user_id <> 3 then props end as props, user_id = 3 as is_anonymized from events")
def gdpr_erase(spark: SparkSession, sf: str) -> DataFrame:
    return P.erase(fx.events(spark, sf).select("event_id", "user_id", "props"), "user_id", 3, "props")


@query("select event_id, sha256(event_id || '|' || user_id || '|' || event_type || '|' || replace(props, ' ', '')) as hash from events")
def audit_hash(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf).withColumn("metadata", P.sorted_json(F.col("props")))
    return e.select("event_id", P.audit_hash(["event_id", "user_id", "event_type", "metadata"]).alias("hash"))


@query("select user_id, user_id <> 3 or count(*) < 25 as valid, case user_id when 3 then least(24, count(*)) when 4 then count(*) - (count(*) >= 10)::int else count(*) end as checked from events group by 1")
def audit_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of all events of each user; user 3's 25th row was altered, user 4's 10th anonymised: that one isn't verified."""
    log = P.audit_chain(fx.events(spark, sf).select("user_id", "ts", "event_id", "event_type", "props"), "user_id", ["ts", "event_id"], ["event_type", "props"])
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    log = log.withColumn("at", at).withColumn("is_anonymized", (F.col("user_id") == 4) & (F.col("at") == 10))
    altered = F.when(((F.col("user_id") == 3) & (F.col("at") == 25)) | F.col("is_anonymized"), "altered").otherwise(F.col("event_type"))
    return P.audit_verify(log.withColumn("event_type", altered).drop("at"), "user_id", ["ts", "event_id"], ["event_type", "props"])
