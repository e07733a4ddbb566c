"""Tree and search queries: the trade tables as a folder tree, papers as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.operators import search as S
from lectorium.operators import tree as T
from lectorium.plans.library import _ANN, _BLK, blocks, current, notes
from lectorium.plans.registry import query
from lectorium.sources.tables import table

_NODES = (
    "WITH RECURSIVE nodes AS (SELECT 'w' id, NULL::VARCHAR parent, 0 ord, 'world' AS name UNION ALL SELECT 'r' || r_regionkey, 'w', r_regionkey, r_name FROM region "
    "UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation), "
)
_CLOSURE = "c(ancestor, id, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT c.ancestor, n.id, c.depth + 1 FROM c JOIN nodes n ON n.parent = c.id) "


def nodes(spark, root):
    r, n = table(spark, root, "region"), table(spark, root, "nation")
    top = spark.range(1).select(F.lit("w").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("ord"), F.lit("world").alias("name"))
    a = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("name"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("name"))
    return top.unionByName(a).unionByName(b)


@query("tre_01_tree", _NODES + "t(id, depth, path) AS (SELECT id, 0, id FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.id FROM t JOIN nodes n ON n.parent = t.id) SELECT id, depth, path FROM t")
def _(spark, root):
    return T.tree(nodes(spark, root)).select("id", "depth", F.array_join("path", "/").alias("path"))


@query("tre_02_children", "SELECT 'n' || n_nationkey id, n_name AS name FROM nation WHERE n_regionkey = 1")
def _(spark, root):
    return T.children(nodes(spark, root), "r1").select("id", "name")


@query("tre_03_descendants", _NODES + _CLOSURE + "SELECT ancestor, id, depth FROM c")
def _(spark, root):
    return T.descendants(nodes(spark, root))


@query("tre_04_paths", _NODES + _CLOSURE + "SELECT id, string_agg(ancestor, '/' ORDER BY depth DESC) path FROM c GROUP BY 1")
def _(spark, root):
    return T.ancestor_paths(nodes(spark, root)).select("id", F.array_join("path", "/").alias("path"))


@query("tre_05_cycles", _NODES + _CLOSURE + "SELECT n.id, m.id new_parent, EXISTS (SELECT 1 FROM c WHERE c.ancestor = n.id AND c.id = m.id) AS cycle FROM nodes n JOIN nodes m ON m.ord = n.ord")
def _(spark, root):
    n = nodes(spark, root)
    moves = n.select("id", "ord").join(n.select(F.col("id").alias("new_parent"), "ord"), "ord").select("id", "new_parent")
    return T.would_cycle(n, moves)


@query("tre_06_next_order", "SELECT (max(n_nationkey) + 1)::INT ord FROM nation WHERE n_regionkey = 2")
def _(spark, root):
    return T.next_order(nodes(spark, root), "r2")


@query("tre_07_reorder", _NODES[:-2] + " SELECT id, parent, (row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN ord % 2 = 1 THEN 100 - ord ELSE 2147483647 END, ord, name, id) - 1)::INT ord FROM nodes")
def _(spark, root):
    return T.reordered(nodes(spark, root), F.when(F.col("ord") % 2 == 1, 100 - F.col("ord"))).select("id", "parent", "ord")


@query("tre_08_delete", _NODES + _CLOSURE + "SELECT id, parent FROM nodes WHERE id NOT IN (SELECT id FROM c WHERE ancestor = 'r3')")
def _(spark, root):
    return T.without_subtree(nodes(spark, root), "r3")[0].select("id", "parent")


@query("lib_09_subtree_members", _NODES + _CLOSURE + "SELECT DISTINCT c.ancestor node, cu.c_custkey member FROM c JOIN customer cu ON c.id = 'n' || cu.c_nationkey WHERE cu.c_acctbal > 5000")
def _(spark, root):
    m = table(spark, root, "customer", "c_custkey", "c_nationkey", "c_acctbal").where("c_acctbal > 5000").select(F.concat(F.lit("n"), "c_nationkey").alias("node"), F.col("c_custkey").alias("member"))
    return T.members_below(nodes(spark, root), m)


@query("lib_10_subtree_counts", _NODES + _CLOSURE + "SELECT c.ancestor node, count(DISTINCT o.o_orderkey) n FROM c JOIN customer cu ON c.id = 'n' || cu.c_nationkey JOIN orders o ON o.o_custkey = cu.c_custkey GROUP BY 1")
def _(spark, root):
    cu = table(spark, root, "customer", "c_custkey", "c_nationkey")
    o = table(spark, root, "orders", "o_orderkey", "o_custkey")
    m = o.join(cu, o.o_custkey == cu.c_custkey).select(F.concat(F.lit("n"), "c_nationkey").alias("node"), F.col("o_orderkey").alias("member"))
    return T.subtree_counts(nodes(spark, root), m)


def docs(spark, root):
    return table(spark, root, "documents", "doc_id", "text").where("text IS NOT NULL")


@query(
    "sch_01_documents",
    _BLK + ", " + _ANN + ", cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) rn FROM papers) WHERE rn = 1 AND deleted_at IS NULL), "
    "bo AS (SELECT paper_id, string_agg(text, ' ' ORDER BY block_order, block_id) body FROM blk WHERE text IS NOT NULL GROUP BY 1), "
    "an AS (SELECT paper_id, string_agg(concat_ws(' ', nullif(note, ''), nullif(selected_text, '')), ' ' ORDER BY id) t FROM ann GROUP BY 1) "
    "SELECT id, concat_ws(' ', title_original, title_translated) title, md5(coalesce(body, '')) body, md5(coalesce(t, '')) annotations FROM cur LEFT JOIN bo ON bo.paper_id = cur.id LEFT JOIN an ON an.paper_id = cur.id",
)
def _(spark, root):
    d = S.search_documents(current(spark, root, "title_original", "title_translated", "authors"), blocks(spark, root, "block_order", "text"), notes(spark, root, "paper_id", "note", "selected_text"))
    return d.select("id", "title", F.md5("body").alias("body"), F.md5("annotations").alias("annotations"))


_TERMS = "terms AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) term FROM documents WHERE text IS NOT NULL) "


@query("sch_02_index", "WITH " + _TERMS + "SELECT term, count(DISTINCT doc_id) n_docs, count(*) n FROM terms WHERE term <> '' GROUP BY 1")
def _(spark, root):
    return S.inverted_index(docs(spark, root), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@query("sch_03_match_all", "WITH " + _TERMS + "SELECT doc_id, count(*)::BIGINT tf FROM terms WHERE term IN ('wage', 'growth') GROUP BY 1 HAVING count(DISTINCT term) = 2 ORDER BY tf DESC, doc_id LIMIT 50")
def _(spark, root):
    return S.match_all(S.inverted_index(docs(spark, root), "doc_id", F.col("text")), "doc_id", "Wage growth")


@query("sch_04_match_like", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%cloud_cover%' OR lower(source) LIKE '%cloud_cover%' ORDER BY doc_id LIMIT 50")
def _(spark, root):
    return S.match_like(table(spark, root, "documents", "doc_id", "text", "source"), "doc_id", ["text", "source"], "cloud_cover%")


@query(
    "sch_05_hits",
    _BLK + "SELECT paper_id, block_id, CASE WHEN lo > 1 THEN '…' ELSE '' END || substring(text, lo, hi - lo) || CASE WHEN hi <= length(text) THEN '…' ELSE '' END snippet FROM ("
    "SELECT *, greatest(pos - 30, 1) lo, least(pos + 12 + 50, length(text) + 1) hi FROM (SELECT *, instr(lower(text), 'participants') AS pos FROM blk WHERE block_role NOT IN ('heading', 'reference')) WHERE pos > 0) "
    "ORDER BY paper_id, block_order, block_id LIMIT 50",
)
def _(spark, root):
    return S.hits_in_paper(blocks(spark, root, "block_role", "block_order", "text"), "participants").select("paper_id", "block_id", "snippet")
