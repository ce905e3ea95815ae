"""The queries of the graph engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import context, extract, model, neighbors, search, sync, traverse
from weftgraph.sources import files, generated
from weftgraph.sources.entities import entity_edges, entity_nodes, table
from weftgraph.snapshots import snapshots

#: The entity graph's edges in SQL.
E = """e AS (
  SELECT DISTINCT src, dst, type FROM (
    SELECT concat('N', n_nationkey) AS src, concat('R', n_regionkey) AS dst, 'INHERITS' AS type FROM nation
    UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey), 'IMPLEMENTS' FROM supplier
    UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey), 'INJECTS' FROM customer
    UNION ALL SELECT concat('C', o_custkey), concat('O', o_orderkey), 'CONTAINS' FROM orders
    UNION ALL SELECT concat('O', l_orderkey), concat('P', l_partkey), CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'REFERENCES' ELSE 'RETURNS' END FROM lineitem
    UNION ALL SELECT concat('O', l_orderkey), concat('S', l_suppkey), CASE l_linestatus WHEN 'O' THEN 'CALLS' ELSE 'REFERENCES' END FROM lineitem
  )
)"""
OWN = "own AS (SELECT dst AS member, min(src) AS owner FROM e WHERE type = 'CONTAINS' GROUP BY 1)"
NODES = """nodes AS (
  SELECT concat('R', r_regionkey) AS id, 'Interface' AS kind, '/region' AS file, r_name AS name FROM region
  UNION ALL SELECT concat('N', n_nationkey), 'Interface', '/nation', n_name FROM nation
  UNION ALL SELECT concat('S', s_suppkey), 'Class', '/supplier', s_name FROM supplier
  UNION ALL SELECT concat('C', c_custkey), 'Class', '/customer', c_name FROM customer
  UNION ALL SELECT concat('P', p_partkey), 'Class', '/part', p_name FROM part
  UNION ALL SELECT concat('O', o_orderkey), 'Method', '/orders', NULL FROM orders
)"""

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None):
    def add(f):
        _FOUND[name] = (f, sql)
        return f

    return add


@_query("graph_nodes", f"WITH {NODES} SELECT id, kind, file, name FROM nodes")
def graph_nodes(spark, sf_dir):
    return entity_nodes(spark, sf_dir)


@_query("graph_edges", f"WITH {E} SELECT src, dst, type FROM e")
def graph_edges(spark, sf_dir):
    return entity_edges(spark, sf_dir)


@_query("graph_counts", f"WITH {E}, {NODES} SELECT kind AS what, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*) FROM e GROUP BY 1")
def graph_counts(spark, sf_dir):
    kinds = entity_nodes(spark, sf_dir).groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(entity_edges(spark, sf_dir).groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@_query("graph_owners", f"WITH {E}, {OWN} SELECT member, owner FROM own")
def graph_owners(spark, sf_dir):
    return model.owners(entity_edges(spark, sf_dir))


@_query("neighbors_all", f"""WITH {E}, {OWN},
x AS (SELECT e.type, coalesce(so.owner, e.src) AS s, coalesce(d.owner, e.dst) AS d
      FROM e LEFT JOIN own so ON so.member = e.src LEFT JOIN own d ON d.member = e.dst WHERE e.type <> 'CONTAINS')
SELECT s AS node_id, d AS neighbor_id, 'out' AS direction, type AS edge_kind, count(*) AS n FROM x WHERE s <> d GROUP BY ALL
UNION ALL SELECT d, s, 'in', type, count(*) FROM x WHERE s <> d GROUP BY ALL""")
def neighbors_all(spark, sf_dir):
    return neighbors.all_types(entity_edges(spark, sf_dir))


def _neighbors_sql(scope: str) -> str:
    """rank: the order in which entries are met, out before in, the node before its members, edges in order of their ends and type."""
    return f"""WITH {E}, {OWN}, scope AS ({scope}),
x AS (SELECT false AS entering, s.turn, s.pl, e.src, e.dst, e.type, coalesce(o.owner, e.dst) AS far FROM e JOIN scope s ON s.id = e.src LEFT JOIN own o ON o.member = e.dst
      WHERE e.dst NOT IN (SELECT id FROM scope) AND type <> 'CONTAINS'
      UNION ALL SELECT true, s.turn, s.pl, e.src, e.dst, e.type, coalesce(o.owner, e.src) FROM e JOIN scope s ON s.id = e.dst LEFT JOIN own o ON o.member = e.src
      WHERE e.src NOT IN (SELECT id FROM scope) AND type <> 'CONTAINS'),
y AS (SELECT *, row_number() OVER (ORDER BY entering, turn, pl, src, dst, type) AS rn FROM x),
z AS (SELECT *, min(rn) OVER (PARTITION BY far, entering) AS first FROM y)
SELECT far AS neighbor_id, CASE WHEN entering THEN 'in' ELSE 'out' END AS direction, type AS edge_kind, count(*) AS n, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS rank
FROM z GROUP BY far, entering, type, first"""


def _neighbors(spark, sf_dir, node):
    rows = neighbors.of(entity_edges(spark, sf_dir), node)
    return rows.withColumn("rank", (F.dense_rank().over(Window.orderBy("place")) - 1).cast("long")).drop("place")  # one node's neighbors


for _name, _id in (("neighbors_one", "S5"), ("neighbors_customer", "C7"), ("neighbors_member", "O10")):
    _scope = f"SELECT '{_id}' AS id, 0 AS turn, NULL AS pl" + ("" if _id[0] == "O" else f" UNION ALL SELECT member, 1, member FROM own WHERE owner = '{_id}'")
    _query(_name, _neighbors_sql(_scope))(lambda spark, sf_dir, _id=_id: _neighbors(spark, sf_dir, _id))


@_query("neighbors_listed", _neighbors_sql("SELECT 'C7' AS id, 0 AS turn, NULL AS pl UNION ALL SELECT member, 1, member FROM own WHERE owner = 'C7'").replace("WITH ", f"WITH {NODES}, ", 1).replace("SELECT far AS", "SELECT l.neighbor_id AS id, n.kind, l.direction, string_agg(l.edge_kind || ':' || l.n, ',' ORDER BY l.edge_kind) AS edge_kinds, n.file FROM (SELECT far AS", 1) + ") l LEFT JOIN nodes n ON n.id = l.neighbor_id GROUP BY ALL")
def neighbors_listed(spark, sf_dir):
    rows = neighbors.listed(entity_edges(spark, sf_dir), entity_nodes(spark, sf_dir), "C7")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("edge_kinds")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return rows.select("id", "kind", "direction", kinds.alias("edge_kinds"), "file")


@_query("implementors", f"WITH {E} SELECT src AS id FROM e WHERE type = 'IMPLEMENTS' AND dst = 'N3'")
def implementors(spark, sf_dir):
    return neighbors.implementors(entity_edges(spark, sf_dir), "N3").select("id")


@_query("interfaces", f"WITH {E} SELECT dst AS id FROM e WHERE type = 'IMPLEMENTS' AND src = 'S5'")
def interfaces(spark, sf_dir):
    return neighbors.implemented(entity_edges(spark, sf_dir), "S5").select("id")


#: Levels that the SQL of an impact is written out for; this graph has fewer.
LEVELS = 7


def _impact_sql(seed: str, tail: str) -> str:
    """The queue level by level, with the rank of each first visit. Right on this graph, where interfaces own no members and a caller's owner is the same however the caller is met."""
    parts = [f"WITH {E}, {OWN}", "eo AS (SELECT *, row_number() OVER (ORDER BY src, dst, type) AS seq FROM e)", "typed AS (SELECT * FROM eo WHERE type IN ('CALLS', 'INJECTS', 'REFERENCES', 'RETURNS', 'INHERITS'))"]
    parts.append(f"""s0 AS (SELECT '{seed}' AS node, 0 AS a, 0 AS b WHERE EXISTS (SELECT 1 FROM e WHERE '{seed}' IN (src, dst)) UNION ALL SELECT member, 1, seq FROM own JOIN eo ON eo.src = owner AND eo.dst = member AND type = 'CONTAINS' WHERE owner = '{seed}'
  UNION ALL SELECT dst, 2, seq FROM eo WHERE src = '{seed}' AND type = 'IMPLEMENTS')""")
    parts.append("f0 AS (SELECT node, row_number() OVER (ORDER BY a, b) AS rank, true AS hidden, false AS told FROM (SELECT node, min(a) AS a, min(b) AS b FROM s0 GROUP BY node))")
    parts.append("v0 AS (SELECT node FROM f0)")
    for k in range(1, LEVELS + 1):
        f = f"f{k - 1}"
        parts.append(f"""p{k} AS (SELECT * FROM (
  SELECT eo.dst AS node, {f}.rank AS r, 0 AS phase, seq, 0 AS sub FROM {f} JOIN eo ON eo.src = {f}.node AND type = 'IMPLEMENTS'
  UNION ALL SELECT eo.src, {f}.rank, 1, seq, 0 FROM {f} JOIN eo ON eo.dst = {f}.node AND type = 'IMPLEMENTS'
  UNION ALL SELECT t.src, {f}.rank, 2, seq, 0 FROM {f} JOIN typed t ON t.dst = {f}.node) WHERE node NOT IN (SELECT node FROM v{k - 1}))""")
        parts.append(f"""q{k} AS (SELECT * FROM p{k} UNION ALL SELECT owner, r, phase, seq, 1 FROM p{k} JOIN own ON member = node WHERE phase = 2 AND owner NOT IN (SELECT node FROM v{k - 1}))""")
        parts.append(f"w{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r, phase, seq, sub) AS k FROM q{k}) WHERE k = 1)")
        parts.append(f"f{k} AS (SELECT node, row_number() OVER (ORDER BY r, phase, seq, sub) AS rank, phase = 0 AS hidden, phase > 0 AND sub = 0 AS told FROM w{k})")
        parts.append(f"v{k} AS (SELECT node FROM v{k - 1} UNION ALL SELECT node FROM f{k})")
    parts.append("vis AS (" + " UNION ALL ".join(f"SELECT *, {k} AS level FROM f{k}" for k in range(LEVELS + 1)) + ")")
    parts.append("told AS (SELECT coalesce(owner, node) AS id, min(CAST(level AS BIGINT) * 1000000000 + rank) AS since_told FROM vis LEFT JOIN own ON member = node WHERE told GROUP BY 1)")
    parts.append("hid AS (SELECT node AS id, CAST(level AS BIGINT) * 1000000000 + rank AS since FROM vis WHERE hidden)")
    parts.append("hit AS (SELECT told.id, CAST(row_number() OVER (ORDER BY since_told) - 1 AS BIGINT) AS rank FROM told LEFT JOIN hid ON hid.id = told.id WHERE since IS NULL OR since > since_told)")
    return ",\n".join(parts) + "\n" + tail


for _name, _id in (("impact_part", "P7"), ("impact_supplier", "S5"), ("impact_region", "R1"), ("impact_nation", "N3")):
    _query(_name, _impact_sql(_id, "SELECT id, rank FROM hit"))(lambda spark, sf_dir, _id=_id: traverse.impact(entity_edges(spark, sf_dir), _id))


@_query("impact_files", _impact_sql("N3", "SELECT h.id, n.file FROM hit h JOIN nodes n ON n.id = h.id").replace("WITH ", f"WITH {NODES}, ", 1))
def impact_files(spark, sf_dir):
    found = traverse.impact(entity_edges(spark, sf_dir), "N3")
    return found.join(entity_nodes(spark, sf_dir).select("id", "file").filter("file is not null"), "id").select("id", "file")


def _path_sql(source: str, target: str) -> str:
    """The length cap is safe because no path of this graph has more than four edges."""
    return f"""WITH RECURSIVE {E}, o AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst, type) AS seq FROM e),
w(node, path, ords) AS (
  SELECT '{source}', ['{source}'], []::BIGINT[]
  UNION ALL SELECT o.dst, list_append(path, o.dst), list_append(ords, o.seq) FROM w JOIN o ON o.src = w.node
  WHERE NOT list_contains(path, o.dst) AND w.node <> '{target}' AND len(path) <= 6),
best AS (SELECT path FROM w WHERE node = '{target}' ORDER BY len(path), ords LIMIT 1)
SELECT CAST(step - 1 AS BIGINT) AS step, id FROM (SELECT unnest(path) AS id, generate_subscripts(path, 1) AS step FROM best)"""


for _name, _from, _to in (("path_customer_region", "C1", "R1"), ("path_customer_part", "C7", "P39"), ("path_none", "P1", "C1"), ("path_self", "S5", "S5")):
    _query(_name, _path_sql(_from, _to))(lambda spark, sf_dir, _from=_from, _to=_to: traverse.path(entity_edges(spark, sf_dir), _from, _to))


def _part_candidates(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit(".cs")).alias("file"))
    files = parts.groupBy("file").agg(F.min("p_partkey").alias("file_seq"))
    own = files.select("file", "file_seq", F.lit(0).alias("is_method"), F.lit(-1).cast("long").alias("method_seq"), search.stem("file").alias("name"))
    methods = parts.join(files, "file").select("file", "file_seq", F.lit(1).alias("is_method"), F.col("p_partkey").alias("method_seq"), F.col("p_name").alias("name"))
    return own.unionByName(methods)


def _search_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH p AS (SELECT p_partkey, p_name, '/' || p_brand || '/' || p_type || '.cs' AS file, p_type FROM part),
q(term) AS (SELECT unnest([{listed}])),
f AS (SELECT file, min(p_type) AS stem, min(p_partkey) AS file_seq FROM p GROUP BY file),
cand AS (SELECT file, file_seq, 0 AS is_method, -1 AS method_seq, stem AS name FROM f
         UNION ALL SELECT p.file, f.file_seq, 1, p.p_partkey, p.p_name FROM p JOIN f USING (file)),
hit AS (SELECT cand.*, CASE WHEN bool_or(lower(name) = lower(term)) THEN 0 ELSE 1 END AS pass FROM cand JOIN q ON contains(lower(name), lower(term)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY pass, file_seq, is_method, method_seq) AS rn, count(*) OVER () AS total FROM hit)
SELECT file, is_method, method_seq, rn, total > 50 AS truncated FROM r WHERE rn <= 50"""


for _name, _terms in (("search_truncated", ["widget", "GEAR", "promo"]), ("search_parts", ["brass", "Small"]), ("search_no_match", ["zzzzz"])):
    _query(_name, _search_sql(_terms))(lambda spark, sf_dir, _terms=_terms: search.search(_part_candidates(spark, sf_dir), _terms))


def _snapshot(spark, sf_dir, current: bool):
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % (11 if current else 10) != (5 if current else 3))
    words = F.when((F.col("doc_id") % 7 == 0) & F.lit(current), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.select(F.col("source").alias("project"), F.col("doc_id").alias("path"), text.checksum(words).alias("checksum"))


_SNAPS = """a AS (SELECT source AS project, doc_id AS path, upper(sha256(text)) AS checksum FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT source AS project, doc_id AS path, upper(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END)) AS checksum FROM documents WHERE doc_id % 11 <> 5)"""


@_query("freshness_diff", f"""WITH {_SNAPS}
SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path,
       CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.project = b.project AND a.path = b.path WHERE a.checksum IS DISTINCT FROM b.checksum""")
def freshness_diff(spark, sf_dir):
    return snapshots.freshness(_snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True))


@_query("stage_merge", f"WITH {_SNAPS} SELECT project, path, checksum FROM b")
def stage_merge(spark, sf_dir):
    old, new = _snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True)
    diff = snapshots.freshness(old, new)
    upserts = new.join(diff.filter("status <> 'removed'"), ["project", "path"], "left_semi")
    return snapshots.stage(old, diff.filter("status = 'removed'"), upserts)


@_query("invalidation_closure", """WITH RECURSIVE seen(id) AS (
  SELECT n_nationkey FROM nation WHERE n_nationkey IN (2, 7)
  UNION SELECT n.n_nationkey FROM seen s JOIN nation n ON n.n_nationkey // 2 = s.id AND n.n_nationkey > 0)
SELECT id FROM seen""")
def invalidation_closure(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey").filter("n_nationkey > 0")
    links = nations.select(F.expr("n_nationkey div 2").cast("int").alias("src"), F.col("n_nationkey").alias("dst"))
    return traverse.closure(links, nations.filter("n_nationkey in (2, 7)").select(F.col("n_nationkey").alias("id")))


@_query("coverage_report", """SELECT source AS project, count(*) AS total, count(*) FILTER (l.doc_id IS NOT NULL) AS loaded, count(*) FILTER (l.doc_id IS NULL) AS skipped,
  count(*) FILTER (lang <> 'en') AS unsupported, CASE WHEN count(l.doc_id) = 0 THEN 'empty' WHEN count(l.doc_id) < count(*) THEN 'partial' ELSE 'complete' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def coverage_report(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    return model.loaded(joined.select(F.col("source").alias("project"), F.coalesce("known", F.lit(False)).alias("loaded"), (F.col("lang") == "en").alias("supported")), "project")


@_query("source_filter", r"SELECT page_id, url FROM pages WHERE url <> '' AND NOT regexp_matches(lower(replace(url, '\', '/')), '\.g\.cs$|/obj/|/bin/')")
def source_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(text.is_source(F.col("url"))).select("page_id", "url")


@_query("ctor_argmax", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def ctor_argmax(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return model.first_largest(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", order, order)


@_query("signature_format", """WITH m AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'public' WHEN 'F' THEN 'internal' ELSE 'private' END AS access FROM orders)
SELECT o_orderkey, access, CASE WHEN access = 'public' THEN '' ELSE access || ' ' END || 'Order' || o_orderkey || '(key:' || o_custkey || ', priority:' || o_orderpriority || '): ' || o_orderstatus AS signature FROM m""")
def signature_format(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    modifier = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("static"), F.lit("public"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("internal"))).otherwise(F.array().cast("array<string>"))
    level = text.access(modifier, "private")
    params = F.array(F.struct(F.lit("key").alias("name"), s("o_custkey").alias("type")), F.struct(F.lit("priority").alias("name"), s("o_orderpriority").alias("type")))
    return table(spark, sf_dir, "orders").select("o_orderkey", level.alias("access"), text.signature(level, F.concat(F.lit("Order"), s("o_orderkey")), params, F.col("o_orderstatus")).alias("signature"))


#: What the generated sources hold, in SQL: nodes with their file, kind, search name and namespace.
CODE = """sup AS (SELECT count(*) AS n FROM supplier),
ords AS (SELECT o_orderkey, o_custkey, concat('Sales.Customer', o_custkey, '.Order', o_orderkey, '()') AS id, concat('Trade.Supplier', o_orderkey % n) AS callee FROM orders JOIN customer ON c_custkey = o_custkey CROSS JOIN sup),
cn AS (
  SELECT concat('Geo.Region', r_regionkey) AS id, 'Interface' AS kind, concat('/Geo/Region', r_regionkey, '.cs') AS file, concat('Region', r_regionkey) AS name, 'Geo' AS namespace FROM region
  UNION ALL SELECT concat('Geo.Nation', n_nationkey), 'Interface', concat('/Geo/Nation', n_nationkey, '.cs'), concat('Nation', n_nationkey), 'Geo' FROM nation
  UNION ALL SELECT concat('Geo.Nation', n_nationkey, '.Name'), 'Property', concat('/Geo/Nation', n_nationkey, '.cs'), 'Name', 'Geo' FROM nation
  UNION ALL SELECT unnest([concat('Trade.Supplier', s_suppkey), concat('Trade.Supplier', s_suppkey, '.Supplier', s_suppkey, '()'), concat('Trade.Supplier', s_suppkey, '.Name'), concat('Trade.Supplier', s_suppkey, '.Ship(int, string?)')]),
    unnest(['Class', 'Method', 'Property', 'Method']), concat('/Trade/Supplier', s_suppkey, '.cs'), unnest([concat('Supplier', s_suppkey), concat('Supplier', s_suppkey), 'Name', 'Ship']), 'Trade' FROM supplier
  UNION ALL SELECT unnest([concat('Sales.Customer', c_custkey), concat('Sales.Customer', c_custkey, '.Customer', c_custkey, '(Geo.Nation', c_nationkey, ')'), concat('Sales.Customer', c_custkey, '.Place()')]),
    unnest(['Class', 'Method', 'Method']), concat('/Sales/Customer', c_custkey, '.cs'), unnest([concat('Customer', c_custkey), concat('Customer', c_custkey), 'Place']), 'Sales' FROM customer
  UNION ALL SELECT id, 'Method', concat('/Sales/Customer', o_custkey, '.cs'), concat('Order', o_orderkey), 'Sales' FROM ords
),
ce AS (
  SELECT concat('Geo.Nation', n_nationkey) AS src, concat('Geo.Region', n_regionkey) AS dst, 'IMPLEMENTS' AS type FROM nation
  UNION ALL SELECT concat('Geo.Nation', n_nationkey), concat('Geo.Nation', n_nationkey, '.Name'), 'CONTAINS' FROM nation
  UNION ALL SELECT concat('Trade.Supplier', s_suppkey), concat('Geo.Nation', s_nationkey), 'IMPLEMENTS' FROM supplier
  UNION ALL SELECT concat('Trade.Supplier', s_suppkey), concat('Trade.Supplier', s_suppkey, unnest([concat('.Supplier', s_suppkey, '()'), '.Name', '.Ship(int, string?)'])), 'CONTAINS' FROM supplier
  UNION ALL SELECT concat('Trade.Supplier', s_suppkey, '.Ship(int, string?)'), concat('Trade.Supplier', s_suppkey, '.Ship(int, string?)'), 'CALLS' FROM supplier
  UNION ALL SELECT concat('Sales.Customer', c_custkey), concat('Geo.Nation', c_nationkey), 'INJECTS' FROM customer
  UNION ALL SELECT concat('Sales.Customer', c_custkey), concat('Sales.Customer', c_custkey, unnest([concat('.Customer', c_custkey, '(Geo.Nation', c_nationkey, ')'), '.Place()'])), 'CONTAINS' FROM customer
  UNION ALL SELECT concat('Sales.Customer', c_custkey, '.Place()'), concat('Geo.Nation', c_nationkey, '.Name'), 'REFERENCES' FROM customer
  UNION ALL SELECT concat('Sales.Customer', o_custkey), id, 'CONTAINS' FROM ords
  UNION ALL SELECT id, concat(callee, '.Ship(int, string?)'), 'CALLS' FROM ords
)"""


def _code(spark, sf_dir):
    """The documents, written once: nodes, edges and files are all read from them."""
    return extract.settled(generated.sources(spark, sf_dir))


@_query("code_edges", f"WITH {CODE} SELECT src, dst, type FROM ce")
def code_edges(spark, sf_dir):
    return model.edges(_code(spark, sf_dir)).select("src", "dst", "type")


@_query("code_nodes", f"WITH {CODE} SELECT id, kind, file, name, namespace FROM cn")
def code_nodes(spark, sf_dir):
    return model.nodes(_code(spark, sf_dir)).select("id", "kind", "file", "name", "namespace")


@_query("code_neighbors", f"""WITH {CODE}, cown AS (SELECT dst AS member, min(src) AS owner FROM ce WHERE type = 'CONTAINS' GROUP BY 1)
SELECT coalesce(so.owner, ce.src) AS node_id, coalesce(d.owner, ce.dst) AS neighbor_id, 'out' AS direction, type AS edge_kind, count(*) AS n
FROM ce LEFT JOIN cown so ON so.member = ce.src LEFT JOIN cown d ON d.member = ce.dst WHERE type <> 'CONTAINS' AND coalesce(so.owner, ce.src) <> coalesce(d.owner, ce.dst) GROUP BY ALL""")
def code_neighbors(spark, sf_dir):
    return neighbors.all_types(model.edges(_code(spark, sf_dir)).select("src", "dst", "type", "seq")).filter("direction = 'out'")


@_query("code_contracts", """SELECT concat('/Trade/Supplier', s_suppkey, '.cs') AS file, concat('Supplier', s_suppkey) AS name, 'class' AS kind, 'public' AS access, concat('Nation', s_nationkey) AS base, '' AS implements, 1 AS methods, 1 AS properties, 'Serializable' AS attributes, 'units:int, note:string?' AS parameters, '' AS dependencies FROM supplier
UNION ALL SELECT concat('/Geo/Nation', n_nationkey, '.cs'), concat('Nation', n_nationkey), 'interface', 'public', NULL, concat('Region', n_regionkey), 0, 1, '', '', '' FROM nation
UNION ALL SELECT concat('/Geo/Region', r_regionkey, '.cs'), concat('Region', r_regionkey), 'interface', 'public', NULL, '', 0, 0, '', '', '' FROM region
UNION ALL SELECT concat('/Sales/Customer', c_custkey, '.cs'), concat('Customer', c_custkey), 'class', 'public', NULL, '', 1 + count(o_orderkey), 0, '', '', concat('home:Nation', c_nationkey) FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey""")
def code_contracts(spark, sf_dir):
    rows = files.type_rows(files.contracts(generated.sources(spark, sf_dir)))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    named = lambda c: F.coalesce(F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ", "), F.lit(""))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return rows.select("file", "name", "kind", "access", "base", listed("implements").alias("implements"), n("methods").alias("methods"), n("properties").alias("properties"), listed("attributes").alias("attributes"), named(F.col("methods")[0]["parameters"]).alias("parameters"), named("constructor_dependencies").alias("dependencies"))


@_query("code_search", """WITH cand AS (
  SELECT s_suppkey AS k, 0 AS is_method, 0 AS pos, concat('Supplier', s_suppkey) AS name FROM supplier
  UNION ALL SELECT s_suppkey, 1, unnest([1, 3]), unnest([concat('Supplier', s_suppkey), 'Ship']) FROM supplier),
hit AS (SELECT *, CASE WHEN lower(name) IN ('supplier1', 'ship') THEN 0 ELSE 1 END AS pass FROM cand WHERE contains(lower(name), 'supplier1') OR contains(lower(name), 'ship')),
r AS (SELECT *, row_number() OVER (ORDER BY pass, k, is_method, pos) AS rn, count(*) OVER () AS total FROM hit),
g AS (SELECT k, min(rn) AS first, bool_or(is_method = 0) AS file_matched, string_agg(name, ',' ORDER BY rn) FILTER (is_method = 1) AS methods, bool_or(total > 50) AS truncated FROM r WHERE rn <= 50 GROUP BY k)
SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS rank, concat('/Trade/Supplier', k, '.cs') AS file, 'Trade' AS namespaces, file_matched, coalesce(methods, '') AS methods, truncated FROM g""")
def code_search(spark, sf_dir):
    rows = search.grouped(_code(spark, sf_dir), [" supplier1 ", "Ship"])
    return rows.select("rank", "file", F.array_join("namespaces", ",").alias("namespaces"), "file_matched", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"), "truncated")


@_query("code_impact", """SELECT concat('Sales.Customer', o_custkey) AS id, CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS rank
FROM (SELECT DISTINCT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % (SELECT count(*) FROM supplier) = 5)""")
def code_impact(spark, sf_dir):
    """What a change of one method reaches: the types of the methods that call it, in document order."""
    return traverse.impact(model.edges(_code(spark, sf_dir)), "Trade.Supplier5.Ship(int, string?)")


@_query("context_references", """SELECT s_suppkey AS context, concat('Supplier', s_suppkey) AS "from", concat('Nation', s_nationkey) AS "to", 'implements' AS via, concat('/Geo/Nation', s_nationkey, '.cs') AS resolved_file, '' AS unresolved FROM supplier
UNION ALL SELECT s_suppkey, concat('Nation', s_nationkey), concat('Region', n_regionkey), 'implements', NULL, concat('Region', n_regionkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def context_references(spark, sf_dir):
    """One context for each supplier: its file and its nation's, without the region's."""
    rows = generated.sources(spark, sf_dir).select("path", "content")
    suppliers = table(spark, sf_dir, "supplier")
    path = lambda i, at, key: suppliers.select(F.col("s_suppkey").alias("context"), F.lit(i).alias("pos"), F.concat(F.lit(at), F.col(key).cast("string"), F.lit(".cs")).alias("path"))
    asked = path(0, "/Trade/Supplier", "s_suppkey").unionByName(path(1, "/Geo/Nation", "s_nationkey"))
    found = context.inspect(asked.join(rows, "path")).select("context", F.explode("references").alias("r"), "unresolved")
    return found.select("context", "r.from", "r.to", "r.via", "r.resolved_file", F.when(F.array_contains("unresolved", F.col("r.to")), F.col("r.to")).otherwise("").alias("unresolved"))


def _each_nation(values: str, columns: str, numbers: str = "") -> str:
    """SQL of rows that every nation's file gives; ``@k`` in their texts is its key. numbers: columns that aren't texts."""
    texts = [c for c in columns.split(", ") if c not in numbers.split(", ")]
    chosen = ", ".join([f"replace({c}, '@k', CAST(n_nationkey AS VARCHAR)) AS {c}" for c in texts] + ([numbers] if numbers else []))
    return f"SELECT concat('/Rich/', n_nationkey, '.cs') AS file, {chosen} FROM nation CROSS JOIN (VALUES {values}) v({columns})"


@_query("code_types", _each_nation("""
('Thing@k<T>', 'abstract-class', 'public', 'Base@k', 'IThing|IDisposable', 'Serializable|Obsolete("n@k")', 'int a|string b', '', 'where T : class, new()', true),
('Color', 'enum', 'public', '', '', '', '', 'Red|Green', '', false), ('Point@k', 'record', 'public', '', '', '', '', '', '', false), ('Line@k', 'record', 'public', '', '', '', '', '', '', false),
('Fold@k', 'delegate', 'public', '', '', '', '', '', '', false), ('IThing', 'interface', 'internal', '', '', '', '', '', '', false), ('Always@k', 'static-class', 'internal', '', '', '', '', '', '', false)""",
"name, kind, access, base, implements, attributes, dependencies, members, constraints, is_partial", "is_partial"))
def code_types(spark, sf_dir):
    rows = files.type_rows(files.contracts(generated.rich(spark, sf_dir)))
    listed = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    deps = F.transform("constructor_dependencies", lambda p: F.concat(p["type"], F.lit(" "), p["name"]))
    return rows.select("file", "name", "kind", "access", F.coalesce("base", F.lit("")).alias("base"), listed("implements").alias("implements"), listed("attributes").alias("attributes"), listed(deps).alias("dependencies"), listed("members").alias("members"), listed("generic_constraints").alias("constraints"), F.coalesce("is_partial", F.lit(False)).alias("is_partial"))


@_query("code_members", _each_nation("""
('Thing@k<T>', 'method', 'Run', 'Task<int>', 'internal', 'int x|string[] rest', 'static|async', 14, 18), ('Thing@k<T>', 'method', 'IThing.Clear', 'void', 'public', '', '', 19, 19),
('Thing@k<T>', 'property', 'Name', 'string', 'public', 'get; private set;', 'required', 0, 0), ('Thing@k<T>', 'property', 'Twice', 'int', 'public', '', '', 0, 0),
('Thing@k<T>', 'property', 'Max', 'int', 'public', '', '', 0, 0), ('Thing@k<T>', 'property', 'Tag', 'string', 'public', '', '', 0, 0),
('Thing@k<T>', 'event', 'Moved', 'Action', 'public', '', '', 0, 0), ('Thing@k<T>', 'event', 'Gone', 'Action', 'public', '', '', 0, 0),
('Point@k', 'property', 'X', 'int', 'public', 'get; init;', '', 0, 0), ('Point@k', 'property', 'Y', 'int', 'public', 'get; init;', '', 0, 0),
('Line@k', 'property', 'From', 'int', 'public', 'get; init;', '', 0, 0), ('Line@k', 'property', 'Note', 'string', 'public', 'get; init;', '', 0, 0),
('Fold@k', 'method', 'Fold@k', 'int', 'public', 'int a|int b', '', 25, 25), ('IThing', 'property', 'Count', 'int', 'public', 'get; set;', '', 0, 0), ('IThing', 'method', 'Clear', 'void', 'public', '', '', 26, 26)""",
"owner, word, name, type, access, detail, modifiers, first_line, last_line", "first_line, last_line"))
def code_members(spark, sf_dir):
    """Methods with parameters and lines, properties and events with accessors, of all types."""
    rows = files.type_rows(files.contracts(generated.rich(spark, sf_dir))).select("file", F.col("name").alias("owner"), "methods", "properties", "events")
    listed = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    m = rows.select("file", "owner", F.explode("methods").alias("m"))
    params = F.transform("m.parameters", lambda p: F.concat(p["type"], F.lit(" "), p["name"]))
    out = m.select("file", "owner", F.lit("method").alias("word"), "m.name", F.col("m.return_type").alias("type"), "m.access", listed(params).alias("detail"), listed("m.modifiers").alias("modifiers"), F.col("m.start_line").alias("first_line"), F.col("m.end_line").alias("last_line"))
    for word, column in (("property", "properties"), ("event", "events")):
        p = rows.select("file", "owner", F.explode(column).alias("p"))
        out = out.unionByName(p.select("file", "owner", F.lit(word).alias("word"), "p.name", "p.type", "p.access", F.coalesce("p.accessors", F.lit("")).alias("detail"), F.when(F.col("p.is_required"), "required").otherwise("").alias("modifiers"), F.lit(0).alias("first_line"), F.lit(0).alias("last_line")))
    return out


@_query("cold_selection", """WITH RECURSIVE old AS (SELECT n_nationkey AS k, false AS fp, CASE WHEN n_nationkey > 0 AND (n_nationkey // 2) % 6 <> 5 THEN n_nationkey // 2 END AS ref FROM nation WHERE n_nationkey % 6 <> 5),
new AS (SELECT n_nationkey AS k, n_nationkey % 8 = 1 AS fp, CASE WHEN n_nationkey > 0 AND (n_nationkey // 2) % 7 <> 6 THEN n_nationkey // 2 END AS ref FROM nation WHERE n_nationkey % 7 <> 6),
changed AS (SELECT new.k FROM new LEFT JOIN old USING (k) WHERE old.k IS NULL OR new.fp <> old.fp OR new.ref IS DISTINCT FROM old.ref UNION SELECT k FROM old WHERE k NOT IN (SELECT k FROM new)),
links AS (SELECT k, ref FROM old WHERE ref IS NOT NULL UNION SELECT k, ref FROM new WHERE ref IS NOT NULL),
seen(k) AS (SELECT k FROM changed UNION SELECT links.k FROM seen JOIN links ON links.ref = seen.k)
SELECT CAST(k AS VARCHAR) AS project FROM new WHERE k IN (SELECT k FROM seen)""")
def cold_selection(spark, sf_dir):
    """Projects to read anew, of two evaluations in which nations stand for projects."""
    keys = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # as many as projects

    def evaluation(there, fingerprint):
        have = {k for k in keys if there(k)}
        projects = [{"key": str(k), "filePath": f"/{k}", "language": "C#", "fingerprint": fingerprint(k), "projectReferences": [str(k // 2)] if k and k // 2 in have else [], "documents": [], "additionalFiles": []} for k in sorted(have)]
        return {"projects": projects}

    found = sync.cold(evaluation(lambda k: k % 6 != 5, lambda k: "a"), evaluation(lambda k: k % 7 != 6, lambda k: "b" if k % 8 == 1 else "a"))
    return spark.createDataFrame([(k,) for k in found], "project string")


@_query("path_order", """SELECT path FROM (SELECT '/' || p_type || '/' || p_brand || '.cs' AS path FROM part) WHERE NOT contains(path, '/obj/') GROUP BY path""")
def path_order(spark, sf_dir):
    """Different paths, in order of their bytes."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand", F.lit(".cs")).alias("path"))
    return parts.filter(text.is_source(F.col("path"))).distinct().orderBy("path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}
