"""The engine's operators bound to the test tables, each with independent SQL.

``documents`` stand for source files and their lines, ``events`` of a user for
the instructions of a function (event types are basic blocks, consecutive ones
edges), ``lineitem`` and ``part`` for findings and rules, ``pages`` for files
with imports, suppliers and parts for a contract graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import traits
from .functions.scales import severity_ord
from .operators import dataflow, findings as fd, graph, line_taint, spans
from .plans import report
from .sources import project, scan

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- bindings ---

    def sources(self) -> DataFrame:
        return self.documents.select("doc_id", "text")

    def lines(self) -> DataFrame:
        return scan.lines_of(self.sources(), "doc_id", "text")

    def steps(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select(F.col("user_id").alias("func"), F.row_number().over(order).cast("long").alias("idx"), F.col("event_type").alias("node"), "value").select("*", F.concat("node", F.lit("-"), F.expr("(idx - 1) div 8")).alias("block"))

    def nodes(self) -> DataFrame:
        """Blocks: a user's event types, apart for every eight events, so that later blocks lie behind earlier ones; ``kind`` is the type."""
        return self.steps().select("func", F.col("block").alias("node"), F.col("node").alias("kind")).distinct()

    def edges(self) -> DataFrame:
        """Flow between the blocks of all events of a user."""
        then = F.lead("block").over(Window.partitionBy("func").orderBy("idx"))
        return self.steps().select("func", F.col("block").alias("src"), then.alias("dst")).where("dst is not null").distinct()

    def entry(self) -> DataFrame:
        return self.steps().where("idx = 1").select("func", F.col("block").alias("node"))

    def exits(self) -> DataFrame:
        """Blocks in which a user's events end."""
        return self.steps().groupBy("func").agg(F.max_by("block", "idx").alias("node"))

    def blocks(self) -> DataFrame:
        defines = F.when(F.col("kind").isin("click", "error"), "cart").when(F.col("kind") == "purchase", "total").when(F.col("kind") == "signup", "user")
        uses = F.when(F.col("kind") == "purchase", "cart").when(F.col("kind") == "view", "user").when(F.col("kind") == "error", "total")
        return self.nodes().select("func", "node", defines.alias("defines"), uses.alias("uses"))

    def contract_edges(self) -> DataFrame:
        folded = self.lineitem.select((F.col("l_suppkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst"))
        return folded.where("src <> dst").distinct()

    def imports(self) -> DataFrame:
        """Files import a file with a higher number but for a few, which close cycles."""
        base = self.documents.where("doc_id > 0").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 3).alias("dst"))
        back = self.documents.where("doc_id % 97 = 5").select(F.floor(F.col("doc_id") / 3).alias("src"), F.col("doc_id").alias("dst"))
        return base.union(back)

    def inherits(self) -> DataFrame:
        """Region <- nation <- supplier, by name."""
        nations = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
        suppliers = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("child"), F.col("n_name").alias("parent"))
        return nations.union(suppliers)

    def found(self) -> DataFrame:
        """Line items as findings of rules (parts) in contracts (orders)."""
        severity = F.element_at(F.array(*map(F.lit, ("Info", "Low", "Medium", "High", "Critical"))), (F.col("l_partkey") % 5 + 1).cast("int"))
        confidence = F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High", "Confirmed"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
        return self.lineitem.select((F.col("l_partkey") % 20).alias("detector_id"), (F.col("l_orderkey") % 500).alias("file"), (F.col("l_quantity").cast("long") * 3 + F.col("l_linenumber")).alias("line"), severity.alias("severity"), confidence.alias("confidence"), F.col("l_orderkey").alias("emit_ord"), F.col("l_linenumber").alias("ord"), "l_extendedprice")


# Fixed fragments of the oracle: the same bindings, written independently.
LINES = r"""lines AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\r?\n$', ''), '\r\n', chr(10), 'g'), chr(10))) AS text,
         generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\r?\n$', ''), '\r\n', chr(10), 'g'), chr(10)), 1) AS line_no
  FROM documents)"""
FLOW = """steps AS (
  SELECT user_id AS func, row_number() OVER w AS idx, event_type AS node, value, event_type || '-' || ((row_number() OVER w - 1) // 8) AS block FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), nodes AS MATERIALIZED (SELECT DISTINCT func, block AS node, node AS kind FROM steps),
edges AS MATERIALIZED (SELECT DISTINCT func, src, dst FROM (SELECT func, block AS src, lead(block) OVER (PARTITION BY func ORDER BY idx) AS dst FROM steps) WHERE dst IS NOT NULL),
entry AS (SELECT func, block AS node FROM steps WHERE idx = 1),
exits AS (SELECT func, max_by(block, idx) AS node FROM steps GROUP BY func),
blocks AS MATERIALIZED (SELECT func, node,
  CASE WHEN kind IN ('click', 'error') THEN 'cart' WHEN kind = 'purchase' THEN 'total' WHEN kind = 'signup' THEN 'user' END AS defines,
  CASE kind WHEN 'purchase' THEN 'cart' WHEN 'view' THEN 'user' WHEN 'error' THEN 'total' END AS uses FROM nodes)"""
REACH = """reach AS (SELECT func, node FROM entry UNION SELECT r.func, e.dst FROM reach r JOIN edges e ON e.func = r.func AND e.src = r.node)"""
AVOID = """avoid AS (SELECT n.func, n.node AS without, t.node FROM nodes n JOIN entry t ON t.func = n.func AND t.node <> n.node
  UNION SELECT a.func, a.without, e.dst FROM avoid a JOIN edges e ON e.func = a.func AND e.src = a.node WHERE e.dst <> a.without)"""
DOM = """dom AS (SELECT r.func, n.node AS dominator, r.node FROM reach r JOIN reach n ON n.func = r.func
  WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.func = r.func AND a.without = n.node AND a.node = r.node))"""
DEFS = """reaching AS (SELECT b.func, b.node AS def_node, b.defines AS var, e.dst AS node FROM blocks b JOIN edges e ON e.func = b.func AND e.src = b.node WHERE b.defines IS NOT NULL
  UNION SELECT r.func, r.def_node, r.var, e.dst FROM reaching r JOIN blocks b ON b.func = r.func AND b.node = r.node JOIN edges e ON e.func = r.func AND e.src = r.node
  WHERE b.defines IS NULL OR b.defines <> r.var),
chains AS (SELECT r.func, r.def_node, r.node AS use_node, r.var FROM reaching r JOIN blocks b ON b.func = r.func AND b.node = r.node AND b.uses = r.var)"""
LIVE = """live AS (SELECT func, node, uses AS var FROM blocks WHERE uses IS NOT NULL
  UNION SELECT l.func, e.src, l.var FROM live l JOIN edges e ON e.func = l.func AND e.dst = l.node JOIN blocks b ON b.func = l.func AND b.node = e.src WHERE b.defines IS NULL OR b.defines <> l.var)"""
FOUND = """found AS (SELECT l_partkey % 20 AS detector_id, l_orderkey % 500 AS file, CAST(l_quantity AS BIGINT) * 3 + l_linenumber AS line,
  (['Info', 'Low', 'Medium', 'High', 'Critical'])[CAST(l_partkey % 5 + 1 AS INT)] AS severity, (['Low', 'Medium', 'High', 'Confirmed'])[CAST(l_suppkey % 4 + 1 AS INT)] AS confidence,
  l_orderkey AS emit_ord, l_linenumber AS ord, l_extendedprice, l_partkey % 5 AS sev, l_suppkey % 4 AS conf FROM lineitem)"""
CONTRACTS = """pairs AS (SELECT DISTINCT l_suppkey % 50 AS src, l_partkey % 50 AS dst FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50)"""
IMPORTS = """imports AS (SELECT doc_id AS src, doc_id // 3 AS dst FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id // 3, doc_id FROM documents WHERE doc_id % 97 = 5)"""
INHERITS = """inherits AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
up AS (SELECT child, parent AS ancestor, 1 AS depth FROM inherits UNION SELECT u.child, i.parent, u.depth + 1 FROM up u JOIN inherits i ON i.child = u.ancestor)"""


def query(sql: str | None = None, *fragments: str):
    def register(f):
        name = f.__name__.rstrip("_")
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = ("WITH RECURSIVE " + ", ".join(fragments) + "\n" if fragments else "") + sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scans, literals, gates ---------------------------------------------------


@query("SELECT doc_id, line_no, text FROM lines WHERE contains(text, 'icense') OR contains(text, 'worthless')", LINES)
def line_scan_literal(t):
    return spans.matching(t.lines(), "text", ["icense", "worthless"])


@query(
    """SELECT doc_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes,
  count(*) FILTER (starts_with(ltrim(text, E' \\t'), 'The ') OR starts_with(ltrim(text, E' \\t'), 'La ')) AS n_contracts, count(*) FILTER (starts_with(ltrim(text, E' \\t'), 'And ')) AS n_functions FROM lines GROUP BY doc_id""",
    LINES,
)
def file_stats(t):
    return scan.file_stats(t.lines(), "doc_id", ["The ", "La "], ["And "])


@query(r"SELECT doc_id, line_no, regexp_extract(text, '^\s*(Licensed|Released) +(\w+)', 1) AS kind, regexp_extract(text, '^\s*(Licensed|Released) +(\w+)', 2) AS name FROM lines WHERE regexp_extract(text, '^\s*(Licensed|Released) +(\w+)', 1) <> ''", LINES)
def contract_metadata_scan(t):
    return scan.declarations(t.lines(), "doc_id", ["Licensed", "Released"])


@query("SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents")
def content_hash(t):
    return t.sources().select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("n"))


@query("SELECT l.doc_id, l.line_no FROM lines l WHERE contains(l.text, ' the ') AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND contains(d.text, 'icense'))", LINES)
def gate_semi(t):
    gate = spans.matching(t.sources(), "text", ["icense"])
    return spans.gated(spans.matching(t.lines(), "text", [" the "]), gate, "doc_id").select("doc_id", "line_no")


@query("SELECT l.doc_id, l.line_no FROM lines l WHERE contains(l.text, '| ') AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND contains(d.text, 'the'))", LINES)
def gate_anti(t):
    gate = spans.matching(t.sources(), "text", ["the"])
    return spans.gated(spans.matching(t.lines(), "text", ["| "]), gate, "doc_id", keep=False).select("doc_id", "line_no")


@query("SELECT doc_id FROM documents WHERE (contains(text, ' der ') OR contains(text, ' la ')) AND contains(text, 'en ') AND contains(text, '.') AND NOT (contains(text, '%%%') OR contains(text, '!!'))")
def all_of_any_of_none_of(t):
    return spans.matching(t.sources(), "text", [" der ", " la "], ["en ", "."], ["%%%", "!!"]).select("doc_id")


@query(
    """SELECT doc_id, line_no AS line, CAST(sum(length(p) + 6) OVER (PARTITION BY doc_id, line_no ORDER BY i) - 6 + 1 AS INT) AS "column", 6 AS length
  FROM (SELECT doc_id, line_no, unnest(ps[:-2]) AS p, generate_subscripts(ps[:-2], 1) AS i FROM (SELECT doc_id, line_no, string_split(text, 'icense') AS ps FROM lines WHERE contains(text, 'icense')))""",
    LINES,
)
def literal_positions(t):
    return spans.positions(t.lines(), "doc_id", "line_no", "text", "icense")


# --- findings -----------------------------------------------------------------


@query("SELECT file, detector_id, line, emit_ord, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY sev DESC, conf DESC, line, detector_id, emit_ord, ord, l_extendedprice) AS rank FROM found)", FOUND)
def ranked_findings(t):
    return fd.ranked(t.found(), ["file"], ["line", "detector_id", "emit_ord", "ord", "l_extendedprice"]).select("file", "detector_id", "line", "emit_ord", "ord", "rank")


@query("SELECT p_partkey FROM part WHERE list_has_all(['red', 'ring', 'blue', 'bolt', 'gear'], string_split(p_name, ' '))")
def capability_gate(t):
    return fd.capable(t.part.withColumn("requires", F.split("p_name", " ")), ["red", "ring", "blue", "bolt", "gear"]).select("p_partkey")


@query("SELECT detector_id, file, line, severity, confidence FROM found WHERE sev >= 3 AND conf >= 1", FOUND)
def severity_filter(t):
    return fd.at_least(t.found(), "High", "Medium").select("detector_id", "file", "line", "severity", "confidence")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring'])")
def category_overlap(t):
    return fd.of_categories(t.part.withColumn("categories", F.split("p_name", " ")), ["red", "ring"]).select("p_partkey")


@query("SELECT file, count(*) AS n FROM found WHERE detector_id IN (1, 2, 3, 5, 8) AND detector_id NOT IN (3, 4) GROUP BY file", FOUND)
def enabled_rules(t):
    ids = lambda *x: t.spark.createDataFrame([(i,) for i in x], "detector_id long")
    return fd.enabled(t.found(), ids(1, 2, 3, 5, 8), ids(3, 4)).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT detector_id, file, line, emit_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY detector_id, file ORDER BY emit_ord, ord, line, l_extendedprice) AS k FROM found) WHERE k <= 3", FOUND)
def cap_per_group(t):
    return fd.capped(t.found(), ["detector_id", "file"], ["emit_ord", "ord", "line", "l_extendedprice"]).select("detector_id", "file", "line", "emit_ord", "ord")


@query("SELECT detector_id, file, line, emit_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY detector_id, file, line ORDER BY emit_ord, ord, l_extendedprice) AS k FROM found) WHERE k = 1", FOUND)
def dedup_first(t):
    return fd.first_of(t.found(), ["detector_id", "file", "line"], ["emit_ord", "ord", "l_extendedprice"]).select("detector_id", "file", "line", "emit_ord", "ord")


@query("SELECT file, line, severity, emit_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY file, line // 10 ORDER BY sev DESC, emit_ord, ord, l_extendedprice) AS k FROM found) WHERE k = 1", FOUND)
def dedup_bucket(t):
    return fd.first_of_bucket(t.found(), ["file"], "line", severity_ord(F.col("severity")), ["emit_ord", "ord", "l_extendedprice"]).select("file", "line", "severity", "emit_ord", "ord")


@query(
    """SELECT l_orderkey, l_linenumber, o_orderkey FROM (
  SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey, row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber, l.l_shipdate, l.l_suppkey ORDER BY o.o_orderdate, o.o_orderkey) AS k
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate, l_suppkey FROM lineitem) l JOIN orders o ON o.o_custkey % 100 = l.l_suppkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 DAY) WHERE k = 1"""
)
def enclosing_span_join(t):
    points = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_suppkey").alias("key")).distinct()
    held = t.orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("key"), F.col("o_orderdate").alias("first"), F.expr("o_orderdate + interval 30 days").alias("last"))
    return spans.enclosing(points, held, "key", "l_shipdate", "first", "last", ["first", "o_orderkey"], F.lit(30 * 86400), lambda x: x.cast("timestamp").cast("long")).select("l_orderkey", "l_linenumber", "o_orderkey")


@query("SELECT s.severity, count(f.file) AS n FROM (VALUES ('Info'), ('Low'), ('Medium'), ('High'), ('Critical')) s(severity) LEFT JOIN (SELECT * FROM found WHERE sev IN (1, 3) AND conf = 0) f ON f.severity = s.severity GROUP BY s.severity", FOUND)
def severity_counts(t):
    domain = t.spark.createDataFrame([(s,) for s in ("Info", "Low", "Medium", "High", "Critical")], "severity string")
    return fd.counts_with_zeros(t.found().where("severity in ('Low', 'High') and confidence = 'Low'"), "severity", domain)


@query(
    """SELECT file, risk, CASE WHEN risk = 0 THEN 'none' WHEN risk < 3 THEN 'low' WHEN risk < 6 THEN 'medium' ELSE 'high' END AS band FROM (
  SELECT file, least(10.0, 5.0 * count(*) FILTER (sev = 4) + 3.0 * count(*) FILTER (sev = 3) + 1.5 * count(*) FILTER (sev = 2) + 0.5 * count(*) FILTER (sev = 1))::DOUBLE AS risk FROM found GROUP BY file)""",
    FOUND,
)
def risk_score(t):
    return fd.risk_score(t.found(), ["file"]).select("file", F.col("risk").cast("double").alias("risk"), "band")


@query("SELECT file, count(DISTINCT detector_id) AS n_detectors, count(*) AS n FROM found GROUP BY file", FOUND)
def distinct_detectors(t):
    return fd.distinct_rules(t.found(), ["file"])


@query("SELECT CASE WHEN file % 7 = 0 THEN 'dep' ELSE 'src' END AS origin, severity, count(*) AS n FROM found GROUP BY ALL", FOUND)
def source_dependency_split(t):
    return fd.by_origin(t.found(), F.col("file") % 7 == 0)


@query(
    """SELECT lang, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM (
    SELECT d.lang, count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn
    FROM (SELECT doc_id, lang, contains(text, '%%%') OR contains(text, '!!') AS hit FROM documents) d JOIN (SELECT doc_id, quality = 0 AS bad FROM labels) l ON l.doc_id = d.doc_id GROUP BY d.lang))"""
)
def precision_recall(t):
    hit = t.documents.select("doc_id", "lang", spans.contains_any(F.col("text"), ["%%%", "!!"]).alias("hit"))
    return fd.precision_recall(hit.join(t.labels.select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id"), ["lang"], "hit", "bad")


@query("SELECT a.detector_id, e.emit_ord AS exp_id, a.emit_ord AS act_id, a.line FROM found a JOIN found e ON a.detector_id = e.detector_id AND a.file = e.file AND a.line BETWEEN e.line - 5 AND e.line + 2 + 5 WHERE e.ord = 1 AND e.conf = 3 AND a.ord = 2", FOUND)
def range_match_tolerance(t):
    f = t.found()
    expected = f.where("ord = 1 and confidence = 'Confirmed'").select("detector_id", "file", F.col("emit_ord").alias("exp_id"), F.col("line").alias("line_lo"), (F.col("line") + 2).alias("line_hi"))
    actual = f.where("ord = 2").select("detector_id", "file", F.col("emit_ord").alias("act_id"), "line")
    return fd.matched_with_tolerance(expected, actual, ["detector_id", "file"]).select("detector_id", "exp_id", "act_id", "line")


@query()
def greedy_match(t):
    f = t.found()
    expected = f.where("ord = 1").select("detector_id", "file", F.col("emit_ord").alias("exp_id"), F.col("line").alias("line_lo"), F.col("line").alias("line_hi"))
    return fd.greedy_matches(expected, f.where("ord = 2").select("detector_id", "file", F.col("emit_ord").alias("act_id"), "line"), ["detector_id", "file"])


@query("SELECT file, detector_id, min(line) AS line, count(*) AS sites, string_agg(severity, '; ' ORDER BY line, severity) AS messages FROM found GROUP BY file, detector_id", FOUND)
def rollup_listagg(t):
    return fd.rolled_up(t.found(), ["file", "detector_id"], "line", "severity")


@query("SELECT coalesce(file, -1) AS file, coalesce(detector_id, -1) AS detector_id, CAST(grouping_id(file, detector_id) AS BIGINT) AS level, count(*) AS n FROM found GROUP BY ROLLUP (file, detector_id)", FOUND)
def report_rollup(t):
    return t.found().rollup("file", "detector_id").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n")).select(F.coalesce("file", F.lit(-1)).alias("file"), F.coalesce("detector_id", F.lit(-1)).alias("detector_id"), "level", "n")


@query("""SELECT file, '{"file":' || file || ',"n":' || count(*) || ',"worst":' || max(sev) || '}' AS report FROM found GROUP BY file""", FOUND)
def json_report(t):
    grouped = t.found().groupBy("file").agg(F.count("*").alias("n"), F.max(severity_ord(F.col("severity"))).alias("worst"))
    return report.as_json(grouped.select("file", "n", "worst")).select(F.get_json_object("value", "$.file").cast("long").alias("file"), F.col("value").alias("report"))


# --- windows ------------------------------------------------------------------


@query(r"SELECT doc_id, line_no, last_value(CASE WHEN s <> '' THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM lines)", LINES)
def prev_nonblank(t):
    return spans.previous_non_blank(t.lines(), "doc_id").select("doc_id", "line_no", "previous")


@query("SELECT doc_id, line_no, CAST(sum((length(text) - length(replace(text, '.', ''))) - (length(text) - length(replace(text, ',', '')))) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS depth FROM lines", LINES)
def brace_depth(t):
    return spans.running_depth(t.lines(), "doc_id", "line_no", "text", ".", ",").select("doc_id", "line_no", "depth")


@query("SELECT doc_id, line_no, coalesce(bool_or(contains(text, 'icense')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM lines", LINES)
def suffix_containment(t):
    return spans.in_rest(t.lines(), "doc_id", "line_no", F.col("text").contains("icense"), "later").select("doc_id", "line_no", "later")


@query("SELECT func, min(idx) FILTER (node = 'click') AS first_at, max(idx) FILTER (node = 'purchase') AS then_at FROM steps GROUP BY func HAVING min(idx) FILTER (node = 'click') < max(idx) FILTER (node = 'purchase')", FLOW)
def call_before_write(t):
    return spans.before_after(t.steps(), ["func"], "idx", F.col("node") == "click", F.col("node") == "purchase")


@query("SELECT * FROM (SELECT doc_id, line_no, string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM lines) c WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = c.doc_id AND l.line_no = c.line_no AND contains(l.text, 'icense'))", LINES)
def context_lines(t):
    return spans.with_context(t.lines(), "doc_id", "line_no", "text", 2).where(F.col("text").contains("icense")).select("doc_id", "line_no", "context")


@query("SELECT func, idx, coalesce(last_value(CASE WHEN node = 'signup' THEN idx END IGNORE NULLS) OVER (PARTITION BY func ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS since FROM steps", FLOW)
def containing_function(t):
    return spans.last_before(t.steps(), "func", "idx", F.col("node") == "signup", F.col("idx"), "since").select("func", "idx", F.coalesce("since", F.lit(0)).alias("since"))


@query("SELECT func, node, n FROM (SELECT func, node, count(*) AS n, row_number() OVER (PARTITION BY func ORDER BY count(*) DESC, node) AS k FROM steps GROUP BY func, node) WHERE k <= 2", FLOW)
def top_k_blocks(t):
    return fd.capped(t.steps().groupBy("func", "node").agg(F.count("*").alias("n")), ["func"], [F.desc("n"), "node"], 2)


@query("SELECT func, count(*) FILTER (node = 'click') AS click, count(*) FILTER (node = 'error') AS error, count(*) FILTER (node = 'purchase') AS purchase FROM steps GROUP BY func", FLOW)
def instruction_mix(t):
    return dataflow.instruction_mix(t.steps(), ["click", "error", "purchase"], ["func"], "node")


# --- control flow -------------------------------------------------------------


@query("SELECT func, node FROM reach", FLOW, REACH)
def reachability(t):
    return graph.reachable(t.edges(), t.entry(), ["func"])


@query("SELECT func, node FROM nodes EXCEPT SELECT func, node FROM reach", FLOW, REACH)
def unreachable(t):
    return graph.unreachable(t.nodes(), t.edges(), t.entry(), ["func"])


@query(
    """SELECT func, count(*) AS n_nodes, CAST(sum(o) AS BIGINT) AS n_edges, count(*) FILTER (o > 1) AS decisions, CAST(greatest(0, sum(o) - count(*) + 2) AS BIGINT) AS cyclomatic, pow(2.0, count(*) FILTER (o > 1))::DOUBLE AS paths
  FROM (SELECT n.func, n.node, count(e.dst) AS o FROM nodes n LEFT JOIN edges e ON e.func = n.func AND e.src = n.node GROUP BY n.func, n.node) GROUP BY func""",
    FLOW,
)
def cfg_degree_metrics(t):
    return graph.metrics(t.nodes(), t.edges(), ["func"])


@query("SELECT func, dominator, node FROM dom", FLOW, REACH, AVOID, DOM)
def dominators(t):
    return graph.dominators(t.nodes(), t.edges(), t.entry(), ["func"])


@query("SELECT func, dominator AS idom, node FROM (SELECT d.*, row_number() OVER (PARTITION BY d.func, d.node ORDER BY c.n DESC) AS k FROM dom d JOIN (SELECT func, node, count(*) AS n FROM dom GROUP BY func, node) c ON c.func = d.func AND c.node = d.dominator WHERE d.dominator <> d.node) WHERE k = 1", FLOW, REACH, AVOID, DOM)
def immediate_dominators(t):
    return graph.immediate_dominators(t.nodes(), t.edges(), t.entry(), ["func"])


@query("SELECT DISTINCT d.func, d.dominator AS node, e.dst AS frontier FROM dom d JOIN edges e ON e.func = d.func AND e.src = d.node WHERE NOT EXISTS (SELECT 1 FROM dom s WHERE s.func = d.func AND s.dominator = d.dominator AND s.node = e.dst AND s.dominator <> s.node)", FLOW, REACH, AVOID, DOM)
def dominance_frontier(t):
    return graph.dominance_frontier(t.nodes(), t.edges(), t.entry(), ["func"])


@query("SELECT e.func, e.src, e.dst FROM edges e JOIN dom d ON d.func = e.func AND d.dominator = e.dst AND d.node = e.src", FLOW, REACH, AVOID, DOM)
def back_edges(t):
    return graph.back_edges(t.nodes(), t.edges(), t.entry(), ["func"])


_LOOPS = """back AS (SELECT e.func, e.src, e.dst AS header FROM edges e JOIN dom d ON d.func = e.func AND d.dominator = e.dst AND d.node = e.src),
loops AS (SELECT func, header, src AS node FROM back UNION SELECT l.func, l.header, e.src FROM loops l JOIN edges e ON e.func = l.func AND e.dst = l.node JOIN reach r ON r.func = e.func AND r.node = e.src WHERE l.node <> l.header)"""


@query("SELECT DISTINCT func, header, node FROM (SELECT * FROM loops UNION ALL SELECT func, header, header FROM back)", FLOW, REACH, AVOID, DOM, _LOOPS)
def natural_loops(t):
    return graph.natural_loops(t.nodes(), t.edges(), t.entry(), ["func"])


@query("SELECT func, node, count(DISTINCT header) AS depth FROM (SELECT * FROM loops UNION ALL SELECT func, header, header FROM back) GROUP BY func, node", FLOW, REACH, AVOID, DOM, _LOOPS)
def loop_nesting_depth(t):
    return graph.loop_depth(graph.natural_loops(t.nodes(), t.edges(), t.entry(), ["func"]), ["func"])


@query("SELECT p.func, p.src AS node, min(p.dst) AS scc FROM path p JOIN path q ON q.func = p.func AND q.src = p.dst AND q.dst = p.src GROUP BY p.func, p.src", FLOW, "path AS (SELECT func, src, dst FROM edges UNION SELECT p.func, p.src, e.dst FROM path p JOIN edges e ON e.func = p.func AND e.src = p.dst)")
def strongly_connected(t):
    return graph.strongly_connected(t.edges(), ["func"])


@query(
    """SELECT e.func, e.dst AS node FROM edges e JOIN deg d ON d.func = e.func AND d.node = e.dst AND d.i = 1 AND d.o <= 1 JOIN deg s ON s.func = e.func AND s.node = e.src AND s.o = 1
  WHERE NOT EXISTS (SELECT 1 FROM entry t WHERE t.func = e.func AND t.node = e.dst)""",
    FLOW,
    "deg AS (SELECT n.func, n.node, (SELECT count(*) FROM edges e WHERE e.func = n.func AND e.src = n.node) AS o, (SELECT count(*) FROM edges e WHERE e.func = n.func AND e.dst = n.node) AS i FROM nodes n)",
)
def mergeable_blocks(t):
    return graph.mergeable(t.nodes(), t.edges(), t.entry(), ["func"])


_BACK = """back_reach AS (SELECT func, node FROM exits UNION SELECT r.func, e.src FROM back_reach r JOIN edges e ON e.func = r.func AND e.dst = r.node),
back_avoid AS (SELECT n.func, n.node AS without, t.node FROM nodes n JOIN exits t ON t.func = n.func AND t.node <> n.node
  UNION SELECT a.func, a.without, e.src FROM back_avoid a JOIN edges e ON e.func = a.func AND e.dst = a.node WHERE e.src <> a.without),
pdom AS (SELECT r.func, n.node AS dominator, r.node FROM back_reach r JOIN back_reach n ON n.func = r.func
  WHERE NOT EXISTS (SELECT 1 FROM back_avoid a WHERE a.func = r.func AND a.without = n.node AND a.node = r.node))"""


@query("SELECT func, dominator, node FROM pdom", FLOW, _BACK)
def post_dominators(t):
    return graph.post_dominators(t.nodes(), t.edges(), t.exits(), ["func"])


@query("SELECT DISTINCT p.func, p.dominator AS node, e.src AS \"on\" FROM pdom p JOIN edges e ON e.func = p.func AND e.dst = p.node WHERE NOT EXISTS (SELECT 1 FROM pdom s WHERE s.func = p.func AND s.dominator = p.dominator AND s.node = e.src AND s.dominator <> s.node)", FLOW, _BACK)
def control_dependence(t):
    return graph.control_dependence(t.nodes(), t.edges(), t.exits(), ["func"])


@query(
    "SELECT n.func, NOT EXISTS (SELECT 1 FROM path p WHERE p.func = n.func AND p.src = p.dst) AS reducible FROM (SELECT DISTINCT func FROM entry) n",
    FLOW,
    REACH,
    AVOID,
    DOM,
    """forward AS (SELECT e.func, e.src, e.dst FROM edges e JOIN reach r ON r.func = e.func AND r.node = e.src WHERE NOT EXISTS (SELECT 1 FROM dom d WHERE d.func = e.func AND d.dominator = e.dst AND d.node = e.src)),
path AS (SELECT func, src, dst FROM forward UNION SELECT p.func, p.src, f.dst FROM path p JOIN forward f ON f.func = p.func AND f.src = p.dst)""",
)
def reducibility(t):
    return graph.reducible(t.nodes(), t.edges(), t.entry(), ["func"])


@query(
    """SELECT func, count(*) AS n_dominated, max(depth) AS height, (SELECT max(n) FROM (SELECT count(*) AS n FROM up u WHERE u.func = up.func GROUP BY idom)) AS max_children FROM up GROUP BY func""",
    FLOW,
    REACH,
    AVOID,
    DOM,
    """deep AS (SELECT func, node, count(*) - 1 AS depth FROM dom GROUP BY func, node),
up AS (SELECT func, node, depth, idom FROM (SELECT d.func, d.node, x.depth, d.dominator AS idom, row_number() OVER (PARTITION BY d.func, d.node ORDER BY y.depth DESC) AS k FROM dom d JOIN deep x ON x.func = d.func AND x.node = d.node JOIN deep y ON y.func = d.func AND y.node = d.dominator WHERE d.node <> d.dominator) WHERE k = 1)""",
)
def dominator_statistics(t):
    return graph.dominator_statistics(graph.immediate_dominators(t.nodes(), t.edges(), t.entry(), ["func"]), ["func"])


# --- data flow ----------------------------------------------------------------


@query("SELECT func, def_node, var, node FROM reaching", FLOW, DEFS)
def reaching_defs(t):
    return dataflow.reaching_definitions(t.blocks(), t.edges(), ["func"])


@query("SELECT func, node, var FROM live", FLOW, LIVE)
def live_vars(t):
    return dataflow.live_variables(t.blocks(), t.edges(), ["func"])


def _chains(t):
    reaching = dataflow.reaching_definitions(t.blocks(), t.edges(), ["func"])
    return reaching, dataflow.def_use(t.blocks(), reaching, ["func"])


@query("SELECT func, def_node, use_node, var FROM chains", FLOW, DEFS)
def def_use(t):
    return _chains(t)[1]


@query("SELECT func, def_node, use_node, min(hops) AS hops FROM walk GROUP BY func, def_node, use_node", FLOW, DEFS, "walk AS (SELECT func, def_node, use_node, 1 AS hops FROM chains UNION SELECT w.func, w.def_node, c.use_node, w.hops + 1 FROM walk w JOIN chains c ON c.func = w.func AND c.def_node = w.use_node WHERE w.hops < 30)")
def def_use_paths(t):
    return dataflow.def_use_paths(_chains(t)[1], ["func"])


@query(
    """SELECT b.func, b.n_defs, b.n_uses, coalesce(c.n, 0) AS n_chains, b.n_defs - coalesce(c.used, 0) AS n_dead, coalesce(c.most, 0) AS max_uses FROM (SELECT func, count(defines) AS n_defs, count(uses) AS n_uses FROM blocks GROUP BY func) b
  LEFT JOIN (SELECT func, CAST(sum(n) AS BIGINT) AS n, count(*) AS used, max(n) AS most FROM (SELECT func, def_node, count(*) AS n FROM chains GROUP BY func, def_node) GROUP BY func) c ON c.func = b.func""",
    FLOW,
    DEFS,
)
def def_use_statistics(t):
    return dataflow.def_use_statistics(t.blocks(), _chains(t)[1], ["func"])


@query("SELECT func, use_node, var, count(DISTINCT def_node) AS n_defs FROM chains GROUP BY func, use_node, var HAVING count(DISTINCT def_node) > 1", FLOW, DEFS)
def multiply_defined_uses(t):
    return dataflow.multiply_defined(_chains(t)[1], ["func"])


@query("SELECT b.func, b.node AS def_node, b.defines AS var FROM blocks b WHERE b.defines IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chains c WHERE c.func = b.func AND c.def_node = b.node)", FLOW, DEFS)
def dead_defs(t):
    return dataflow.dead_definitions(t.blocks(), _chains(t)[1], ["func"])


@query("SELECT b.func, b.node, b.uses AS var FROM blocks b WHERE b.uses IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reaching r WHERE r.func = b.func AND r.node = b.node AND r.var = b.uses)", FLOW, DEFS)
def uninitialized_uses(t):
    return dataflow.uninitialized_uses(t.blocks(), _chains(t)[0], ["func"])


@query("SELECT DISTINCT a.func, a.var, b.var AS other FROM live a JOIN live b ON a.func = b.func AND a.node = b.node AND a.var < b.var", FLOW, LIVE)
def interference(t):
    return dataflow.interference(dataflow.live_variables(t.blocks(), t.edges(), ["func"]), ["func"])


@query("SELECT func, max(n) AS pressure FROM (SELECT func, node, count(*) AS n FROM live GROUP BY func, node) GROUP BY func", FLOW, LIVE)
def register_pressure(t):
    return dataflow.register_pressure(dataflow.live_variables(t.blocks(), t.edges(), ["func"]), ["func"])


_TAINT = """taint AS (SELECT func, node AS source, node, 0 AS hops FROM nodes WHERE kind = 'click'
  UNION SELECT x.func, x.source, c.use_node, x.hops + 1 FROM taint x JOIN chains c ON c.func = x.func AND c.def_node = x.node WHERE x.hops < 30 AND NOT starts_with(c.use_node, 'view-'))"""


def _taint(t):
    n = t.nodes()
    return dataflow.tainted(_chains(t)[1], n.where("kind = 'click'"), n.where("kind = 'view'"), ["func"])


@query("SELECT func, source, node, min(hops) AS hops, round(pow(0.9, min(hops)), 9) AS confidence FROM taint GROUP BY func, source, node", FLOW, DEFS, _TAINT)
def taint_paths(t):
    return _taint(t)


@query("SELECT func, node AS sink, max(c) AS confidence, count(*) AS n_sources FROM (SELECT func, source, node, round(pow(0.9, min(hops)), 9) AS c FROM taint GROUP BY func, source, node) WHERE starts_with(node, 'purchase-') OR starts_with(node, 'error-') GROUP BY func, node", FLOW, DEFS, _TAINT)
def taint_severity(t):
    return dataflow.violations(_taint(t), t.nodes().where("kind in ('purchase', 'error')"), ["func"])


@query("SELECT doc_id, line_no, CASE WHEN contains(text, '@') THEN 'source' WHEN contains(text, 'icense') THEN 'sink' WHEN contains(text, '%%%') THEN 'sanitizer' END AS role FROM lines WHERE contains(text, '@') OR contains(text, 'icense') OR contains(text, '%%%')", LINES)
def line_taint_classify(t):
    return line_taint.roles(t.lines(), (("source", ("@",)), ("sink", ("icense",)), ("sanitizer", ("%%%",)))).select("doc_id", "line_no", "role")


@query("SELECT func, round(greatest(0.01, least(0.9, (0.1 + CASE WHEN count(*) > 60 THEN 0.2 ELSE 0 END) * pow(0.5, count(*) FILTER (node = 'view' AND idx < 4)))), 9)::DOUBLE AS likelihood FROM steps GROUP BY func", FLOW)
def fp_likelihood(t):
    steps = t.steps().groupBy("func").agg(F.count("*").alias("n"), F.count_if((F.col("node") == "view") & (F.col("idx") < 4)).alias("k"))
    return steps.select("func", F.round(dataflow.false_positive_likelihood(F.when(F.col("n") > 60, 11).otherwise(1), F.array_repeat(F.lit(0.5), F.col("k").cast("int"))), 9).alias("likelihood"))


@query(
    """SELECT func, round(exp(sum(ln(f))), 9) AS remaining FROM (SELECT func, CASE op WHEN '+' THEN 0.9 WHEN '*' THEN 0.8 WHEN '==' THEN 0.3 ELSE 1.0 END AS f
  FROM (SELECT func, CASE node WHEN 'click' THEN '+' WHEN 'view' THEN '*' WHEN 'error' THEN '==' ELSE 'other' END AS op FROM steps)) GROUP BY func""",
    FLOW,
)
def taint_attenuation(t):
    op = F.when(F.col("node") == "click", "+").when(F.col("node") == "view", "*").when(F.col("node") == "error", "==").otherwise("other")
    return line_taint.remaining(t.steps().select("func", op.alias("op")), ["func"], "op")


@query(
    """SELECT l_orderkey, l_linenumber, kind, sink, CASE WHEN kind = 'UserInput' AND sink = 'ExternalCall' THEN 'Unvalidated External Call' WHEN kind = 'UserInput' AND sink = 'StateModification' THEN 'Unvalidated State Change'
    WHEN kind = 'ExternalCall' AND sink = 'StateModification' THEN 'External Data State Change' WHEN kind = 'TimeDependent' AND sink = 'StateModification' THEN 'Time-dependent State Change'
    WHEN kind = 'UserInput' AND sink = 'EtherTransfer' THEN 'Unvalidated Ether Transfer' ELSE 'Data Flow Vulnerability' END AS vulnerability,
  CASE WHEN kind = 'UserInput' AND sink = 'SelfDestruct' THEN 'Critical' WHEN kind = 'UserInput' AND sink = 'ExternalCall' OR kind = 'ExternalCall' AND sink = 'StateModification' THEN 'High'
    WHEN kind = 'UserInput' AND sink = 'EtherTransfer' OR kind = 'TimeDependent' THEN 'Medium' ELSE 'Low' END AS severity
  FROM (SELECT l_orderkey, l_linenumber, (['UserInput', 'ExternalCall', 'TimeDependent'])[CAST(l_partkey % 3 + 1 AS INT)] AS kind, (['ExternalCall', 'StateModification', 'EtherTransfer', 'SelfDestruct'])[CAST(l_suppkey % 4 + 1 AS INT)] AS sink FROM lineitem)"""
)
def taint_decision_table(t):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    flows = t.lineitem.select("l_orderkey", "l_linenumber", pick(("UserInput", "ExternalCall", "TimeDependent"), "l_partkey").alias("kind"), pick(("ExternalCall", "StateModification", "EtherTransfer", "SelfDestruct"), "l_suppkey").alias("sink"))
    return line_taint.named(flows)


@query(
    """SELECT path, line, source, sink FROM (SELECT 'c/' || l_orderkey || '.sol' AS path, n, kind FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n, l_partkey % 4 AS kind FROM lineitem)) i
  JOIN LATERAL (SELECT * FROM (VALUES (0, 1, 'TransactionOrigin', NULL), (1, 1, 'MessageSender', 'ExternalCall'), (1, 2, 'MessageSender', 'StateModification')) r(k, shift, source, sink) WHERE r.k = i.kind AND sink IS NOT NULL) x ON true
  JOIN LATERAL (SELECT CAST(5 + 5 * (i.n - 1) + x.shift AS BIGINT) AS line) y ON true"""
)
def taint_lines(t):
    sources = contract_sources(t)
    lines = line_taint.classified(scan.lines_of(sources, "file_id", "content")).where("source is not null and sink is not null")
    return lines.join(sources.select("file_id", "path"), "file_id").select("path", F.col("line_no").alias("line"), "source", "sink")


@query("SELECT 'c/' || l_orderkey || '.sol' AS path, bool_or(l_partkey % 4 = 0) AS uses_tx_origin, false AS is_amm FROM lineitem GROUP BY l_orderkey")
def contract_traits(t):
    return traits.with_traits(contract_sources(t), "content").select("path", "uses_tx_origin", "is_amm")


@query(
    """SELECT rule, file, line, emit_ord, ord FROM once WHERE class IS NULL UNION ALL
SELECT rule, file, line, emit_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY file, class, line // 10 ORDER BY sev DESC, emit_ord, ord, l_extendedprice, rule) AS k FROM once WHERE class IS NOT NULL) WHERE k = 1""",
    FOUND,
    """ruled AS (SELECT *, (['mev-a', 'parameter-b', 'other'])[CAST(detector_id % 3 + 1 AS INT)] || detector_id AS rule FROM found),
once AS (SELECT *, CASE WHEN contains(rule, 'mev') THEN 'mev' WHEN contains(rule, 'parameter') THEN 'validation' END AS class FROM (SELECT *, row_number() OVER (PARTITION BY rule, file, line ORDER BY emit_ord, ord, l_extendedprice, rule) AS first FROM ruled) WHERE first = 1)""",
)
def dedup_enhanced(t):
    ruled = t.found().withColumn("detector_id", F.concat(F.element_at(F.array(F.lit("mev-a"), F.lit("parameter-b"), F.lit("other")), (F.col("detector_id") % 3 + 1).cast("int")), F.col("detector_id").cast("string")))
    return fd.deduplicated_enhanced(ruled, "file", ["emit_ord", "ord", "l_extendedprice", "detector_id"]).select(F.col("detector_id").alias("rule"), "file", "line", "emit_ord", "ord")


@query("SELECT user_id AS func, event_type AS callee, count(*) AS n FROM events WHERE value > 20 AND event_type IN ('click', 'view') GROUP BY ALL")
def call_graph(t):
    instructions = t.events.where("value > 20").select(F.col("user_id").alias("func"), F.col("event_type").alias("opcode"), F.col("event_type").alias("callee"))
    return dataflow.call_graph(instructions, ["click", "view"], ["func"])


# --- names, files, contracts --------------------------------------------------


@query("SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor", INHERITS)
def ancestors(t):
    return graph.ancestors(t.inherits())


@query("SELECT ancestor AS parent, count(*) AS n_descendants, max(depth) AS depth FROM (SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor) GROUP BY ancestor", INHERITS)
def descendants(t):
    return graph.descendants(graph.ancestors(t.inherits()))


@query(
    """SELECT (SELECT count(*) FROM names) AS n_contracts, (SELECT count(*) FROM inherits) AS n_edges, (SELECT count(*) FROM names WHERE n NOT IN (SELECT child FROM inherits)) AS n_roots,
  (SELECT count(*) FROM names WHERE n NOT IN (SELECT parent FROM inherits)) AS n_leaves, (SELECT max(depth) FROM up) AS max_depth""",
    INHERITS,
    "names AS (SELECT child AS n FROM inherits UNION SELECT parent FROM inherits)",
)
def inheritance_statistics(t):
    return graph.inheritance_statistics(t.inherits(), graph.ancestors(t.inherits()))


_OVERLOADS = """symbols AS (SELECT p_partkey AS symbol_id, split_part(p_name, ' ', 1) AS name, (['uint8', 'uint256', 'bytes'])[CAST(p_partkey % 3 + 1 AS INT)] AS a, (['uint8', 'uint256'])[CAST(p_size % 2 + 1 AS INT)] AS b FROM part),
calls AS (SELECT o.s_suppkey AS call_id, split_part(p.p_name, ' ', 1) AS name, (['uint8', 'bytes'])[CAST(o.s_suppkey % 2 + 1 AS INT)] AS a, (['uint8', 'uint256'])[CAST(o.s_nationkey % 2 + 1 AS INT)] AS b FROM supplier o JOIN part p ON p.p_partkey = o.s_suppkey),
priced AS (SELECT call_id, symbol_id, CASE WHEN c.a = s.a THEN 0 WHEN c.a = 'uint8' AND s.a = 'uint256' THEN 1 END + CASE WHEN c.b = s.b THEN 0 WHEN c.b = 'uint8' AND s.b = 'uint256' THEN 1 END AS cost FROM calls c JOIN symbols s ON s.name = c.name)"""


@query("SELECT call_id, min(symbol_id) AS symbol_id, CAST(cost AS BIGINT) AS cost, count(*) > 1 AS ambiguous FROM priced p WHERE cost = (SELECT min(cost) FROM priced q WHERE q.call_id = p.call_id) GROUP BY call_id, cost", _OVERLOADS)
def overload_resolution(t):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    name = F.split("p_name", " ")[0].alias("name")
    candidates = t.part.select(F.col("p_partkey").alias("symbol_id"), name, F.array(pick(("uint8", "uint256", "bytes"), "p_partkey"), pick(("uint8", "uint256"), "p_size")).alias("parameters"))
    calls = t.supplier.join(t.part.select(F.col("p_partkey").alias("s_suppkey"), name), "s_suppkey")
    calls = calls.select(F.col("s_suppkey").alias("call_id"), "name", F.array(pick(("uint8", "bytes"), "s_suppkey"), pick(("uint8", "uint256"), "s_nationkey")).alias("arguments"))
    return dataflow.resolved_overloads(calls, candidates, t.spark.createDataFrame([("uint8", "uint256")], "source string, target string"))


@query("SELECT child, array_to_string(list_concat([child], list_sort(list(DISTINCT ancestor))), ' ') AS chain FROM up GROUP BY child", INHERITS)
def linearized_inheritance(t):
    return graph.linearized(graph.ancestors(t.inherits())).select("child", F.array_join("chain", " ").alias("chain"))


@query(
    """SELECT a, b, lca FROM (SELECT p.a, p.b, x.ancestor AS lca, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.depth + y.depth, x.ancestor) AS k
  FROM (SELECT s.s_name AS a, u.s_name AS b FROM supplier s JOIN supplier u ON u.s_suppkey = s.s_suppkey + 1) p JOIN up x ON x.child = p.a JOIN up y ON y.child = p.b AND y.ancestor = x.ancestor) WHERE k = 1""",
    INHERITS,
)
def lca(t):
    s = t.supplier.select("s_suppkey", F.col("s_name").alias("a"))
    pairs = s.join(t.supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("b")), "s_suppkey").select("a", "b")
    return graph.lowest_common_ancestor(graph.ancestors(t.inherits()), pairs)


@query(
    """SELECT importer, path, coalesce(f1.path2, f2.path2, f3.path2) AS imported FROM (SELECT DISTINCT p.url AS importer, unnest(regexp_extract_all(p.html, 'href="(/[^"]*)"', 1)) AS path FROM pages p) i
  LEFT JOIN files f1 ON f1.path2 = CASE WHEN starts_with(i.path, '/th') THEN 'lib/' || substr(i.path, 4) WHEN starts_with(i.path, '/t') THEN 'src/' || substr(i.path, 3) END
  LEFT JOIN files f2 ON f2.path2 = 'lib/' || i.path LEFT JOIN files f3 ON f3.path2 = i.path""",
    "files AS (SELECT DISTINCT CASE page % 3 WHEN 0 THEN 'lib/' || substr(path, 4) WHEN 1 THEN 'src/' || substr(path, 3) ELSE path END AS path2 FROM (SELECT page_id AS page, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS path FROM pages))",
)
def import_resolution(t):
    links = t.pages.select("page_id", F.col("url").alias("importer"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("path"))
    files = links.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("lib/"), F.substring("path", 4, 10000))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("src/"), F.substring("path", 3, 10000))).otherwise(F.col("path")).alias("path")).distinct()
    remappings = t.spark.createDataFrame([("/t", "src/"), ("/th", "lib/")], "prefix string, target string")
    return project.resolve_imports(links.select("importer", "path").distinct(), files, remappings, ["lib"], "").select("importer", "path", "imported")


@query(
    """SELECT doc_id AS node, level FROM (SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.node = d.doc_id) THEN NULL ELSE (SELECT max(h) FROM chain c WHERE c.node = d.doc_id) END AS level FROM documents d) WHERE level IS NOT NULL""",
    IMPORTS,
    "reach AS (SELECT src, dst FROM imports UNION SELECT r.src, i.dst FROM reach r JOIN imports i ON i.src = r.dst), bad AS (SELECT DISTINCT r.src AS node FROM reach r WHERE r.src = r.dst OR EXISTS (SELECT 1 FROM reach c WHERE c.src = c.dst AND c.src = r.dst)), "
    "chain AS (SELECT doc_id AS node, doc_id AS low, 0 AS h FROM documents UNION SELECT c.node, i.dst, c.h + 1 FROM chain c JOIN imports i ON i.src = c.low WHERE c.h < 30 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.node = c.low))",
)
def topo_levels(t):
    return graph.topological_levels(t.documents.select(F.col("doc_id").alias("node")), t.imports()).select("node", F.col("level").cast("int").alias("level"))


_FILE_REACH = "reach AS (SELECT src, dst FROM imports UNION SELECT r.src, i.dst FROM reach r JOIN imports i ON i.src = r.dst)"


@query("SELECT r.src AS node, min(r.dst) AS scc FROM reach r JOIN reach b ON b.src = r.dst AND b.dst = r.src GROUP BY r.src", IMPORTS, _FILE_REACH)
def file_components(t):
    return graph.strongly_connected(t.imports(), [])


@query("SELECT node, hops, row_number() OVER (ORDER BY hops, node) AS place FROM (SELECT node, min(hops) AS hops FROM inv GROUP BY node)", IMPORTS, "inv AS (SELECT doc_id AS node, 0 AS hops FROM documents WHERE doc_id % 50 = 7 UNION SELECT i.src, v.hops + 1 FROM inv v JOIN imports i ON i.dst = v.node WHERE v.hops < 40)")
def reanalysis_queue(t):
    return graph.reanalysis_queue(t.imports(), t.documents.where("doc_id % 50 = 7").select(F.col("doc_id").alias("node")))


@query("SELECT DISTINCT src AS node FROM reach WHERE src = dst", IMPORTS, "reach AS (SELECT src, dst FROM imports UNION SELECT r.src, i.dst FROM reach r JOIN imports i ON i.src = r.dst)")
def file_cycles(t):
    return graph.strongly_connected(t.imports(), []).select("node")


@query("SELECT node FROM (SELECT doc_id AS node FROM documents WHERE doc_id % 50 = 7) UNION SELECT node FROM inv", IMPORTS, "inv AS (SELECT doc_id AS node FROM documents WHERE doc_id % 50 = 7 UNION SELECT i.src FROM inv v JOIN imports i ON i.dst = v.node)")
def invalidated_files(t):
    return graph.invalidated(t.imports(), t.documents.where("doc_id % 50 = 7").select(F.col("doc_id").alias("node")))


@query("SELECT node, min(hops) AS hops FROM walk GROUP BY node", CONTRACTS, "walk AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT p.dst, w.hops + 1 FROM walk w JOIN pairs p ON p.src = w.node WHERE w.hops < 50)")
def shortest_path(t):
    return graph.shortest_paths(t.contract_edges(), t.spark.createDataFrame([(0,)], "node long"), [])


@query(
    "SELECT a.src || ' ' || a.dst AS path, 2 AS length FROM pairs a JOIN pairs b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || ' ' || a.dst || ' ' || b.dst, 3 FROM pairs a JOIN pairs b ON b.src = a.dst JOIN pairs c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst",
    CONTRACTS,
)
def cycle_enum(t):
    return graph.simple_cycles(t.contract_edges(), 3).select(F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), "length")


@query(
    """SELECT CAST(max(hops) AS INT) AS diameter FROM (SELECT origin, node, min(hops) AS hops FROM walk GROUP BY origin, node) WHERE origin <> node""",
    CONTRACTS,
    "walk AS (SELECT src AS origin, dst AS node, 1 AS hops FROM pairs UNION SELECT w.origin, p.dst, w.hops + 1 FROM walk w JOIN pairs p ON p.src = w.node WHERE w.hops < 12)",
)
def graph_diameter(t):
    return graph.diameter(t.contract_edges())


@query("SELECT p_partkey, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN p_type = 'STANDARD' THEN 0.2 ELSE 0 END - CASE WHEN p_size > 30 THEN 0.3 ELSE 0 END - CASE WHEN contains(p_name, 'ring') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS trust FROM part")
def trust_score(t):
    return t.part.select("p_partkey", graph.trust_score(F.col("p_type") == "STANDARD", F.col("p_size") > 30, F.col("p_name").contains("ring")).alias("trust"))


@query("SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b, a.l_partkey AS name FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = a.l_partkey AND p.p_type = 'PROMO')")
def shared_state(t):
    loud = t.part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("name"))
    held = t.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name")).join(loud, "name", "left_anti")
    return graph.shared_names(held, held)


@query("SELECT n AS n_nodes, e AS n_edges, round(e::DOUBLE / (n * (n - 1)), 9) AS density, round(2.0::DOUBLE * e / n, 9) AS avg_degree FROM (SELECT (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM pairs UNION ALL SELECT dst FROM pairs)) AS n, (SELECT count(*) FROM pairs) AS e)", CONTRACTS)
def graph_metrics(t):
    e = t.contract_edges()
    return graph.interaction_metrics(e.select("src").union(e.select("dst")).distinct(), e)


@query(
    """SELECT scope_id, name, symbol_id FROM (SELECT u.own AS scope_id, s.p_name AS name, s.p_partkey AS symbol_id, row_number() OVER (PARTITION BY u.own, s.p_name ORDER BY u.depth, s.p_partkey) AS k FROM chain u JOIN (SELECT p_partkey % 40 AS scope_id, p_name, p_partkey FROM part) s ON s.scope_id = u.here) WHERE k = 1""",
    "chain AS (SELECT v AS own, v AS here, 0 AS depth FROM (SELECT unnest(range(40)) AS v) UNION ALL SELECT own, here // 2, depth + 1 FROM chain WHERE here > 0)",
)
def symbol_resolution(t):
    scopes = t.spark.range(40).select(F.col("id").alias("scope_id"), F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("parent_id"))
    symbols = t.part.select((F.col("p_partkey") % 40).alias("scope_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("symbol_id"))
    return dataflow.visible_symbols(scopes, symbols)


# --- rules over sources ---------------------------------------------------------

# Fixed texts: one function for each kind of line item, five lines each.
_BODIES = (
    "function f{n}() public {{\n        require(tx.origin == owner);\n        total = 1;\n    }}\n",
    'function f{n}(uint a) external {{\n        msg.sender.call("");\n        balances[msg.sender] = a;\n    }}\n',
    "function f{n}() external view returns (uint) {{\n        uint x = 1;\n        return total;\n    }}\n",
    "function setValue{n}(uint a) external {{\n        // the value\n        total = a;\n    }}\n",
)


def contract_sources(t: Tables) -> DataFrame:
    """A contract for each order, with a function for each line item."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    items = t.lineitem.select("l_orderkey", F.row_number().over(order).alias("n"), (F.col("l_partkey") % 4).alias("kind"))
    body = F.lit("")
    for kind, text in enumerate(_BODIES):
        first, *rest = text.replace("{{", "{").replace("}}", "}").split("{n}")
        body = F.when(F.col("kind") == kind, F.concat(F.lit("    " + first), F.col("n").cast("string"), F.lit("".join(rest)))).otherwise(body)
    grouped = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("body")))), lambda x: x["body"]), "\n").alias("bodies"))
    head = F.concat(F.lit("pragma solidity ^0.8.0;\ncontract C"), F.col("l_orderkey").cast("string"), F.lit(" {\n    uint total;\n    mapping(address => uint) balances;\n"))
    files = grouped.select(F.concat(F.lit("c/"), F.col("l_orderkey").cast("string"), F.lit(".sol")).alias("path"), F.concat(head, "bodies", F.lit("}\n")).alias("content"))
    return scan.as_sources(files)


@query(
    """SELECT 'c/' || l_orderkey || '.sol' AS path, CAST(5 + 5 * (n - 1) + shift AS INT) AS line, detector_id, severity FROM (
  SELECT i.*, r.*, row_number() OVER (PARTITION BY i.l_orderkey, r.detector_id ORDER BY i.n) AS k
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n, l_partkey % 4 AS kind FROM lineitem) i
  JOIN (VALUES (0, 'tx-origin-authentication', 'Critical', 0), (1, 'classic-reentrancy', 'High', 0), (1, 'unchecked-external-call', 'Medium', 1), (3, 'missing-access-modifiers', 'Critical', 0)) r(kind, detector_id, severity, shift) ON r.kind = i.kind) WHERE k <= 3"""
)
def rule_findings(t):
    from .plans.planner import Options, analyze

    ids = ("tx-origin-authentication", "classic-reentrancy", "unchecked-external-call", "missing-access-modifiers")
    return analyze(contract_sources(t), Options(enable=ids)).select("path", "line", "detector_id", "severity")


@query(
    """SELECT 'c/' || l_orderkey || '.sol' AS path, CASE kind WHEN 3 THEN 'setValue' ELSE 'f' END || n AS name
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n, l_partkey % 4 AS kind FROM lineitem) WHERE kind <> 2"""
)
def function_predicate(t):
    from .plans.planner import Facts, open_functions

    sources = contract_sources(t)
    return open_functions(Facts(sources).functions).join(sources.select("file_id", "path"), "file_id").select("path", "name")


@query()
def all_rules(t):
    from .plans.planner import Options, analyze

    return analyze(contract_sources(t), Options(lint=True))


@query(
    """SELECT 'circular-dependency' AS detector_id, 'High' AS severity, a AS contract, a || ' > ' || b || ' > ' || c || ' > ' || d AS message FROM rings WHERE a < b AND a < c AND a < d
UNION ALL SELECT 'state-inconsistency', 'Medium', x.contract, y.contract || ': ' || x.name FROM names x JOIN names y ON x.name = y.name AND x.contract < y.contract""",
    "contracts AS (SELECT 'N' || n_nationkey AS contract, 'N' || ((7 * n_nationkey + 3) % 25) AS callee, n_regionkey FROM nation)",
    "names AS (SELECT contract, 'next' AS name FROM contracts UNION ALL SELECT contract, 'total' || n_regionkey FROM contracts)",
    "rings AS (SELECT w.contract AS a, x.contract AS b, y.contract AS c, z.contract AS d FROM contracts w JOIN contracts x ON x.contract = w.callee JOIN contracts y ON y.contract = x.callee JOIN contracts z ON z.contract = y.callee AND z.callee = w.contract WHERE w.contract <> x.contract)",
)
def cross_contract_rules(t):
    from .plans import cross_contract
    from .plans.planner import Facts

    number = lambda c: c.cast("string")
    text = F.concat(F.lit("contract N"), number(F.col("n_nationkey")), F.lit(" {\n    N"), number((7 * F.col("n_nationkey") + 3) % 25), F.lit(" next;\n    uint total"), number(F.col("n_regionkey")), F.lit(";\n    function go() external { next.go(); }\n}\n"))
    files = t.nation.select(F.concat(F.lit("n/"), number(F.col("n_nationkey")), F.lit(".sol")).alias("path"), text.alias("content"))
    return cross_contract.findings(Facts(scan.as_sources(files)))


@query(
    """SELECT 'c/' || l_orderkey || '.sol' AS path, count(*) AS n_functions, count(*) FILTER (l_partkey % 4 = 2) AS n_view, CAST(count(*) * 2 AS BIGINT) - count(*) FILTER (l_partkey % 4 = 3) AS n_statements FROM lineitem GROUP BY l_orderkey"""
)
def parsed_contracts(t):
    from .plans.fixpoint import written
    from .sources import parser

    sources = contract_sources(t)
    stream = written(parser.facts(sources))
    counted = stream.groupBy("file_id").agg(F.count_if(F.col("kind") == "function").alias("n_functions"), F.count_if((F.col("kind") == "function") & (F.col("mutability") == "view")).alias("n_view"), F.count_if(F.col("kind") == "statement").alias("n_statements"))
    return counted.join(sources.select("file_id", "path"), "file_id").select("path", "n_functions", "n_view", "n_statements")


@query("SELECT strftime(date_trunc('minute', ts) - INTERVAL (minute(ts) % 5) MINUTE, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(t):
    from .streaming.reanalysis import windowed_counts as counts

    return counts(t.events).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A rule from end to end: files that mention licences and no noise, their lines, findings, one each, counted by severity."""
    t = Tables(spark, folder)
    gate = spans.matching(t.sources(), "text", ["icense"], none_of=["%%%"])
    hits = spans.gated(spans.matching(t.lines(), "text", ["icense", "the "]), gate, "doc_id")
    severity = F.when(F.col("text").contains("icense"), "High").otherwise("Info")
    found = hits.select(F.lit("license-mention").alias("detector_id"), F.col("doc_id").alias("file"), F.col("line_no").alias("line"), severity.alias("severity"), F.lit("Medium").alias("confidence"))
    once = fd.first_of(fd.at_least(found), ["detector_id", "file", "line"], ["severity"])
    domain = spark.createDataFrame([(s,) for s in ("Info", "Low", "Medium", "High", "Critical")], "severity string")
    return fd.counts_with_zeros(once, "severity", domain)
