"""DuckDB SQL with the results of the registered queries, written from the tables and not from the engine's code."""

from __future__ import annotations

# Lineitem rows as alignments; p_order is the order of a query's lines.
GAF = """
gaf AS (
  SELECT 'q' || l_orderkey AS query_name, CAST(100 * l_quantity AS BIGINT) AS qlen, CAST(90 * l_quantity AS BIGINT) AS block,
    CAST(90 * l_quantity - round(100 * l_discount) AS BIGINT) AS matches, CAST(round(100 * l_discount) AS INTEGER) AS nm,
    CAST(least(60, 10 * round(100 * l_tax)) AS INTEGER) AS mapping_quality, l_returnflag = 'A' AS has_as,
    '>p' || l_partkey || '<p' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN '>p' || l_partkey ELSE '' END AS path,
    CASE WHEN l_linenumber % 2 = 0 THEN ['p' || l_partkey, 'p' || l_suppkey, 'p' || l_partkey] ELSE ['p' || l_partkey, 'p' || l_suppkey] END AS nodes,
    CASE l_suppkey % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unhealthy' ELSE 'combined' END AS graph_class, 'g' || l_partkey % 3 AS gene,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS line_no
  FROM lineitem),
m AS (
  SELECT *, matches / block AS identity, block / qlen AS coverage, CAST(matches + has_as::INT AS DOUBLE) AS alignment_score, (matches + has_as::INT) / qlen AS normalized_score FROM gaf)"""

BEST = "row_number() OVER (PARTITION BY {by} ORDER BY normalized_score DESC, identity DESC, coverage DESC, mapping_quality DESC, line_no)"

QUERY = """
qry AS (
  SELECT 'q' || o_orderkey AS query_name, 'g' || o_custkey % 3 AS gene, CASE WHEN o_orderpriority LIKE '1%' THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS truth,
    CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders)"""

COMPOSITE = "0.45 * identity + 0.35 * coverage + 0.15 * least(mapping_quality / 60, 1) + 0.05 * least(normalized_score, 1)"

CLASSES = f"""
b AS (SELECT * FROM (SELECT *, {BEST.format(by="query_name, graph_class")} AS r FROM m) WHERE r = 1),
cls AS (
  SELECT query_name, coalesce(max({COMPOSITE}) FILTER (graph_class = 'healthy'), 0) AS h, coalesce(max({COMPOSITE}) FILTER (graph_class = 'unhealthy'), 0) AS u,
    coalesce(max(normalized_score) FILTER (graph_class = 'healthy'), 0) AS hn, coalesce(max(normalized_score) FILTER (graph_class = 'unhealthy'), 0) AS un,
    coalesce(max(mapping_quality) FILTER (graph_class = 'combined'), 0) AS mapq, coalesce(max(alignment_score) FILTER (graph_class = 'combined'), 0) AS score,
    coalesce(max(block) FILTER (graph_class = 'combined'), 0) AS block, coalesce(max(coverage) FILTER (graph_class = 'combined'), 0) AS coverage,
    coalesce(max(identity) FILTER (graph_class = 'combined'), 0) AS identity, coalesce(max(nm) FILTER (graph_class = 'combined'), 0) AS nm,
    coalesce(max(nodes) FILTER (graph_class = 'combined'), []) AS nodes
  FROM b GROUP BY query_name)"""

JUDGED = f"""
{GAF}, {QUERY}, {CLASSES},
j AS (
  SELECT query_name, gene, split, truth, CASE WHEN h >= u THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS label, round(u / greatest(h + u, 1e-9), 9) AS score, h, u, abs(h - u) < 1e-6 AS tie_like, mapq
  FROM cls JOIN qry USING (query_name))"""

SEQ = """
seq AS (
  SELECT doc_id, upper(lang) || CASE WHEN coalesce(quality, 1) = 1 THEN '_H_' ELSE '_U_' END || doc_id AS sequence_id, upper(lang) AS gene,
    CASE WHEN coalesce(quality, 1) = 1 THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS label, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS sequence
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene, label, sequence ORDER BY doc_id) AS r FROM seq WHERE sequence <> '') WHERE r = 1),
halved AS (
  SELECT *, 0.2 * count(*) OVER (PARTITION BY gene, label) AS want, count(*) OVER (PARTITION BY gene, label) AS n,
    row_number() OVER (PARTITION BY gene, label ORDER BY md5('42|' || sequence_id), sequence_id) AS place FROM kept),
split AS (
  SELECT *, CASE WHEN place <= least(greatest(CASE WHEN want - floor(want) = 0.5 THEN 2 * round(want / 2) ELSE round(want) END, 1), n - 1) THEN 'test' ELSE 'train' END AS split FROM halved)"""

LINKS = """
ln AS (
  SELECT a.l_orderkey AS graph_id, 'n' || a.l_partkey % 5 AS src, 'n' || b.l_partkey % 5 AS dst, a.l_linenumber AS line_no,
    CASE WHEN a.l_returnflag = 'A' THEN '-' ELSE '+' END AS src_orient, CASE WHEN b.l_returnflag = 'A' THEN '-' ELSE '+' END AS dst_orient
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
e AS (SELECT DISTINCT graph_id, src, dst FROM ln),
seg AS (SELECT DISTINCT l_orderkey AS graph_id, 'n' || l_partkey % 5 AS node FROM lineitem)"""

REACH = """
reach AS (SELECT graph_id, src, dst FROM e UNION SELECT r.graph_id, r.src, e.dst FROM reach r JOIN e ON e.graph_id = r.graph_id AND e.src = r.dst)"""

WEAK = """
und AS (SELECT graph_id, src, dst FROM e UNION SELECT graph_id, dst, src FROM e),
walk AS (SELECT graph_id, src, dst FROM und UNION SELECT r.graph_id, r.src, u.dst FROM walk r JOIN und u ON u.graph_id = r.graph_id AND u.src = r.dst),
weak AS (SELECT s.graph_id, s.node, least(s.node, coalesce(min(w.dst), s.node)) AS component FROM seg s LEFT JOIN walk w ON w.graph_id = s.graph_id AND w.src = s.node GROUP BY s.graph_id, s.node)"""

STRONG = """
strong AS (
  SELECT s.graph_id, s.node, least(s.node, coalesce(min(r.dst), s.node)) AS scc FROM seg s
  LEFT JOIN (SELECT a.graph_id, a.src, a.dst FROM reach a JOIN reach b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src) r ON r.graph_id = s.graph_id AND r.src = s.node
  GROUP BY s.graph_id, s.node)"""

# Edges within a strong component that do not climb by hops from its smallest node.
BACK = """
i AS (SELECT e.*, a.scc FROM e JOIN strong a ON a.graph_id = e.graph_id AND a.node = e.src JOIN strong b ON b.graph_id = e.graph_id AND b.node = e.dst WHERE a.scc = b.scc),
      h AS (SELECT DISTINCT graph_id, scc, scc AS node, 0 AS hops FROM i UNION SELECT h.graph_id, h.scc, i.dst, h.hops + 1 FROM h JOIN i ON i.graph_id = h.graph_id AND i.scc = h.scc AND i.src = h.node WHERE h.hops < 5),
      d AS (SELECT graph_id, scc, node, min(hops) AS depth FROM h GROUP BY ALL),
bk AS (SELECT i.graph_id, i.src, i.dst FROM i JOIN d a ON a.graph_id = i.graph_id AND a.scc = i.scc AND a.node = i.src JOIN d b ON b.graph_id = i.graph_id AND b.scc = i.scc AND b.node = i.dst WHERE a.depth > b.depth OR (a.depth = b.depth AND i.src >= i.dst))"""

DEGREE = "dg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, src AS node FROM e UNION ALL SELECT graph_id, dst FROM e) GROUP BY ALL)"

# The fixed graph of twelve nodes, its distances, and lineitem rows as anchors with their precedence pairs and gaps.
CHAIN = """
mini AS (
  SELECT i AS src, i + s AS dst FROM range(1, 12) t(i), (VALUES (1), (3)) v(s) WHERE i + s <= 12 UNION SELECT 7, 4),
hop AS (
  SELECT i AS src, i AS dst, 0 AS hops FROM range(1, 13) t(i)
  UNION SELECT h.src, mini.dst, h.hops + 1 FROM hop h JOIN mini ON mini.src = h.dst WHERE h.hops < 12),
far AS (SELECT src, dst, min(hops) AS hops FROM hop GROUP BY src, dst),
a AS (
  SELECT *, y_ - 1 + x AS y, c + y_ - 1 AS d, 2 * y_ AS weight FROM (
    SELECT l_orderkey AS query_id, CAST(l_partkey % 12 + 1 AS BIGINT) AS vertex, 1 + l_suppkey % 4 AS x, 1 + CAST(l_quantity AS BIGINT) % 8 AS y_, 8 * l_linenumber + l_partkey % 2 AS c,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INTEGER) AS anchor_id
    FROM lineitem)),
pre AS (
  SELECT l.query_id, l.anchor_id AS left_id, r.anchor_id AS right_id, l.vertex AS lv, r.vertex AS rv, l.y AS ly, r.x AS rx, r.weight AS rw, greatest(0, r.c - l.d - 1) AS query_gap, far.hops
  FROM a l JOIN a r ON l.query_id = r.query_id AND l.anchor_id <> r.anchor_id AND l.d < r.c JOIN far ON far.src = l.vertex AND far.dst = r.vertex
  WHERE l.vertex <> r.vertex OR l.y < r.x OR l.vertex BETWEEN 4 AND 7),
gap AS (
  SELECT *, query_gap + graph_gap AS gap FROM (
    SELECT *, CASE WHEN lv = rv THEN greatest(0, rx - ly - 1) ELSE hops + greatest(0, least(2, 4 - ly)) + greatest(0, least(2, rx - 1)) END AS graph_gap FROM pre)),
it AS (
  SELECT query_id, anchor_id, 0 AS iter, CAST(weight AS DOUBLE) AS score, weight FROM a
  UNION ALL
  SELECT i.query_id, g.right_id, i.iter + 1, i.score + g.rw - g.gap, g.rw FROM it i JOIN gap g ON g.query_id = i.query_id AND g.left_id = i.anchor_id)"""

BEST_CHAIN = """
sc AS (SELECT i.query_id, i.anchor_id, i.score, a.weight, a.ord FROM (SELECT query_id, anchor_id, max(score) AS score FROM it GROUP BY ALL) i
  JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c, d, anchor_id) AS ord FROM a) a USING (query_id, anchor_id)),
pred AS (
  SELECT query_id, right_id, left_id FROM (
    SELECT g.query_id, g.right_id, g.left_id, row_number() OVER (PARTITION BY g.query_id, g.right_id ORDER BY l.ord) AS r
    FROM gap g JOIN sc l ON l.query_id = g.query_id AND l.anchor_id = g.left_id JOIN sc x ON x.query_id = g.query_id AND x.anchor_id = g.right_id
    WHERE x.score > x.weight AND l.score + g.rw - g.gap = x.score) WHERE r = 1),
ends AS (SELECT query_id, anchor_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r FROM sc) WHERE r = 1),
back AS (
  SELECT query_id, anchor_id, score AS chain_score, 0 AS back FROM ends
  UNION ALL SELECT b.query_id, p.left_id, b.chain_score, b.back + 1 FROM back b JOIN pred p ON p.query_id = b.query_id AND p.right_id = b.anchor_id),
bc AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY back DESC) - 1 AS INTEGER) AS pos, anchor_id, chain_score FROM back)"""

# Layers of a graph's nodes by longest paths (0 in graphs with a cycle), and the nodes on cycles.
LAYERS = """
cyc AS (SELECT graph_id, src AS node FROM reach WHERE src = dst),
own AS (SELECT graph_id, src AS node FROM e UNION SELECT graph_id, dst FROM e),
pl AS (SELECT graph_id, node, 0 AS layer FROM own UNION SELECT p.graph_id, e.dst, p.layer + 1 FROM pl p JOIN e ON e.graph_id = p.graph_id AND e.src = p.node WHERE p.graph_id NOT IN (SELECT graph_id FROM cyc)),
ly AS (SELECT graph_id, node, max(layer) AS layer FROM pl GROUP BY ALL)"""

SAMPLE_WALK = """
home AS (SELECT graph_id, min(node) AS home FROM cyc GROUP BY graph_id),
      w AS (SELECT h.graph_id, home, e.dst AS cur, [e.dst] AS path FROM home h JOIN e ON e.graph_id = h.graph_id AND e.src = home
        UNION ALL SELECT w.graph_id, home, e.dst, list_append(path, e.dst) FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.cur WHERE w.cur <> home AND len(path) < 6),
      c AS (SELECT graph_id, list_prepend(home, path)[1:9] AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY len(path), path) AS r FROM w WHERE cur = home) WHERE r = 1),
sw AS (SELECT graph_id, CAST(unnest(range(0, len(nodes))) AS INTEGER) AS pos, unnest(nodes) AS node FROM c
      UNION ALL SELECT * FROM (SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY layer, node) - 1 AS INTEGER) AS pos, node FROM ly WHERE graph_id NOT IN (SELECT graph_id FROM cyc)) WHERE pos < 8)"""

REPRESENTATIVE = f"""
{DEGREE}, k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node) AS r FROM dg),
      p AS (SELECT a.graph_id, a.node AS cur, b.node AS goal, [a.node] AS path FROM k a JOIN k b ON a.graph_id = b.graph_id AND a.r = 1 AND b.r = 2
        UNION ALL SELECT p.graph_id, e.dst, goal, list_append(path, e.dst) FROM p JOIN e ON e.graph_id = p.graph_id AND e.src = p.cur WHERE p.cur <> goal AND len(path) < 5),
      s AS (SELECT graph_id, unnest(path) AS node FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY len(path), path) AS r FROM p WHERE cur = goal) WHERE r = 1),
      c AS (SELECT graph_id, node, min(cl) AS cl FROM (SELECT graph_id, node, 0 AS cl FROM k WHERE r <= 2 UNION ALL SELECT graph_id, node, 1 FROM s) GROUP BY ALL),
rp AS (SELECT graph_id, node FROM (SELECT ly.graph_id, ly.node, row_number() OVER (PARTITION BY ly.graph_id ORDER BY coalesce(cl, 2), layer, ly.node) AS pick FROM ly LEFT JOIN c ON c.graph_id = ly.graph_id AND c.node = ly.node) WHERE pick <= 4)"""

# Bases made from a node's name.
BASES = "translate(md5({name}), '0123456789abcdef', 'ACGTACGTACGTACGT')"

WALK = """
walk AS (
  SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY first, node) - 1 AS pos FROM (
    SELECT l_orderkey AS query_id, CAST(l_partkey % 12 + 1 AS INTEGER) AS node, min(l_linenumber) AS first FROM lineitem GROUP BY ALL))"""

FEATURES = f"""
{GAF}, {QUERY}, {CLASSES},
nb AS (SELECT DISTINCT nodes[i] AS src, nodes[i + 1] AS dst FROM gaf, (VALUES (1), (2)) v(i) WHERE i < len(nodes)),
deg AS (SELECT node, sum(i) AS ind, sum(o) AS outd FROM (SELECT src AS node, 0 AS i, 1 AS o FROM nb UNION ALL SELECT dst, 1, 0 FROM nb) GROUP BY node),
pf AS (
  SELECT query_name, count(*) AS uniq, count(*) FILTER (ind > 1 OR outd > 1) AS branching, sum(ind + outd) / count(*) AS mean_degree
  FROM (SELECT query_name, unnest(list_distinct(nodes)) AS node FROM cls) JOIN deg USING (node) GROUP BY query_name),
ft AS (
  SELECT query_name AS sequence_id, split, gene, truth AS label_name, CASE WHEN truth = 'UNHEALTHY' THEN 1 ELSE 0 END AS label,
    round(coalesce(score, 0), 9) AS alignment_score, round(CAST(coalesce(mapq, 0) AS DOUBLE), 9) AS mapq, round(CAST(coalesce(block, 0) AS DOUBLE), 9) AS alignment_length, round(coalesce(coverage, 0), 9) AS query_coverage,
    CAST(coalesce(uniq, 0) AS DOUBLE) AS matched_graph_nodes, CAST(coalesce(len(nodes), 0) AS DOUBLE) AS traversed_graph_paths,
    round(coalesce(hn, 0), 9) AS healthy_overlap_score, round(coalesce(un, 0), 9) AS unhealthy_overlap_score, round(coalesce(hn, 0) / greatest(coalesce(un, 0), 1e-9), 3) AS healthy_unhealthy_score_ratio,
    CAST(coalesce(nm, 0) AS DOUBLE) AS mismatches, CAST(coalesce(branching, 0) AS DOUBLE) AS graph_branches_traversed, round(coalesce(mean_degree, 0), 9) AS graph_path_complexity,
    round(coalesce(identity, 0) * 100, 9) AS identity_percentage, round(CASE WHEN uniq > 0 THEN len(nodes) / uniq ELSE 0 END, 9) AS path_traversal_frequency, CAST(coalesce(len(nodes) - uniq, 0) AS DOUBLE) AS node_revisit_count
  FROM qry LEFT JOIN cls USING (query_name) LEFT JOIN pf USING (query_name))"""

METRICS = "round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"

KMERS = "SELECT gene, label, unnest(list_transform(range(1, len(sequence) - {k} + 2), lambda i: substr(sequence, i, {k}))) AS kmer FROM seq WHERE len(sequence) >= {k}"


def _doubled(name: str, rounds: int) -> str:
    """``name``0 (id, pred, step, low) after so many rounds of pointer doubling; a path's first node is its own pred."""
    return ", ".join(f"{name}{r} AS MATERIALIZED (SELECT x.id, y.pred, x.step + y.step AS step, least(x.low, y.low) AS low FROM {name}{r - 1} x JOIN {name}{r - 1} y ON y.id = x.pred)" for r in range(1, rounds + 1))


# The graph of 31-mers of each gene's kept sequences: spot (id, head, step) places every k-mer in its segment.
UNITIGS = f"""
k1 AS (SELECT DISTINCT gene, unnest(list_transform(range(1, len(sequence) - 29), lambda i: substr(sequence, i, 31))) AS node FROM kept WHERE len(sequence) >= 31),
kn AS MATERIALIZED (SELECT gene, node, row_number() OVER (ORDER BY gene, node) AS id FROM k1 WHERE regexp_full_match(node, '[ACGTN]+')),
k2 AS (SELECT DISTINCT gene, unnest(list_transform(range(1, len(sequence) - 30), lambda i: substr(sequence, i, 32))) AS pair FROM kept WHERE len(sequence) >= 32),
ke AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM k2 JOIN kn a ON a.gene || a.node = k2.gene || k2.pair[1:31] JOIN kn b ON b.gene || b.node = k2.gene || k2.pair[2:32]),
un AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, count(*) OVER (PARTITION BY a) AS o, count(*) OVER (PARTITION BY b) AS i FROM ke) WHERE o = 1 AND i = 1 AND a <> b),
pt0 AS MATERIALIZED (SELECT id, coalesce(a, id) AS pred, CAST(a IS NOT NULL AS BIGINT) AS step, least(id, coalesce(a, id)) AS low FROM kn LEFT JOIN un ON b = id),
{_doubled("pt", 15)},
ring AS MATERIALIZED (SELECT id, low FROM pt15 WHERE pred IN (SELECT b FROM un)),
qt0 AS MATERIALIZED (SELECT id, CASE WHEN id = low THEN id ELSE a END AS pred, CAST(id <> low AS BIGINT) AS step, low FROM ring JOIN un ON b = id),
{_doubled("qt", 15)},
spot AS MATERIALIZED (SELECT id, pred AS head, step FROM pt15 WHERE id NOT IN (SELECT id FROM ring) UNION ALL SELECT id, pred, step FROM qt15)"""


ORACLES: dict[str, str] = {
    "alignment_rollup": f"""WITH {GAF}, {QUERY}, b AS (SELECT * FROM (SELECT *, {BEST.format(by="query_name")} AS r FROM m) WHERE r = 1)
      SELECT coalesce(qry.gene, 'ALL') AS gene, count(*) AS queries, count(b.identity) AS aligned, round(count(b.identity) / count(*), 9) AS alignment_rate, round(coalesce(avg(identity), 0), 9) AS mean_identity,
        round(coalesce(avg(coverage), 0), 9) AS mean_coverage, round(coalesce(avg(mapping_quality), 0), 9) AS mean_mapq, round(coalesce(avg(alignment_score), 0), 9) AS mean_score
      FROM qry LEFT JOIN b USING (query_name) GROUP BY ROLLUP (qry.gene)""",
    "gaf_metrics": f"""WITH {GAF} SELECT query_name, path, round(identity, 9) AS identity, round(coverage, 9) AS coverage, block AS path_span, alignment_score, round(normalized_score, 9) AS normalized_score,
        CAST(len(nodes) AS INTEGER) AS n_nodes, mapping_quality FROM m""",
    "gaf_tag_map": f"WITH {GAF} SELECT query_name, path, CAST(2 + has_as::INT AS INTEGER) AS n_tags, 'P' AS tp, nm, CASE WHEN has_as THEN CAST(matches + 1 AS VARCHAR) END AS as_tag FROM gaf",
    "best_alignment": f"""WITH {GAF} SELECT query_name, path, graph_class, round(identity, 9) AS identity, round(coverage, 9) AS coverage, round(normalized_score, 9) AS normalized_score, mapping_quality
      FROM (SELECT *, {BEST.format(by="query_name")} AS r FROM m) WHERE r = 1""",
    "composite_breakdown": f"""WITH {GAF} SELECT query_name, round(0.45 * identity, 9) AS identity_part, round(0.35 * coverage, 9) AS coverage_part, round(0.15 * least(mapping_quality / 60, 1), 9) AS mapq_part,
        round(0.05 * least(normalized_score, 1), 9) AS score_part, round({COMPOSITE}, 9) AS total FROM (SELECT *, {BEST.format(by="query_name")} AS r FROM m) WHERE r = 1""",
    "rule_classify": f"""WITH {GAF}, {CLASSES} SELECT query_name, round(h, 9) AS healthy_score, round(u, 9) AS unhealthy_score, CASE WHEN h >= u THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS label,
        round(least(1, abs(h - u) / (h + u + 1e-9)), 9) AS confidence, abs(h - u) < 1e-6 AS tie_like, round(u / greatest(h + u, 1e-9), 9) AS unhealthy_probability, true AS any_available, CAST(len(nodes) AS INTEGER) AS matched_nodes FROM cls""",
    "gene_detect": f"""WITH {GAF}, b AS (SELECT * FROM (SELECT *, {BEST.format(by="query_name, gene")} AS r FROM m WHERE graph_class = 'combined') WHERE r = 1)
      SELECT query_name, rank, gene, normalized_score FROM (SELECT query_name, CAST(row_number() OVER (PARTITION BY query_name ORDER BY normalized_score DESC, identity DESC, coverage DESC, mapping_quality DESC, gene) AS INTEGER) AS rank, gene, round(normalized_score, 9) AS normalized_score FROM b) WHERE rank <= 3""",
    "analyze_queries": f"""WITH {GAF}, c AS (SELECT query_name, gene FROM (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY normalized_score DESC, identity DESC, coverage DESC, mapping_quality DESC, gene) AS r FROM
        (SELECT *, {BEST.format(by="query_name, gene")} AS r0 FROM m WHERE graph_class = 'combined') WHERE r0 = 1) WHERE r = 1),
      b AS (SELECT * FROM (SELECT m.*, {BEST.format(by="query_name, graph_class")} AS r FROM m JOIN c USING (query_name, gene)) WHERE r = 1),
      x AS (SELECT query_name, gene, coalesce(max({COMPOSITE}) FILTER (graph_class = 'healthy'), 0) AS h, coalesce(max({COMPOSITE}) FILTER (graph_class = 'unhealthy'), 0) AS u FROM b GROUP BY ALL)
      SELECT query_name, gene, CASE WHEN h >= u THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS label, round(h, 9) AS healthy_score, round(u, 9) AS unhealthy_score, 'aligned' AS note FROM x""",
    "classifier_confusion": f"""WITH {JUDGED}, t AS (SELECT gene, count(*) FILTER (truth = 'UNHEALTHY' AND label = 'UNHEALTHY') AS tp, count(*) FILTER (truth = 'HEALTHY' AND label = 'HEALTHY') AS tn,
        count(*) FILTER (truth = 'HEALTHY' AND label = 'UNHEALTHY') AS fp, count(*) FILTER (truth = 'UNHEALTHY' AND label = 'HEALTHY') AS fn FROM j GROUP BY gene) SELECT gene, tp, tn, fp, fn, {METRICS} FROM t""",
    "classifier_auc": f"""WITH {JUDGED}, l AS (SELECT score, count(*) FILTER (truth = 'UNHEALTHY') AS p, count(*) FILTER (truth = 'HEALTHY') AS n FROM j GROUP BY score),
      r AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below FROM l) SELECT round(coalesce(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 0), 9) AS auc FROM r""",
    "roc_points": f"""WITH {JUDGED}, l AS (SELECT score, count(*) FILTER (truth = 'UNHEALTHY') AS p, count(*) FILTER (truth = 'HEALTHY') AS n FROM j GROUP BY score)
      SELECT score AS threshold, round(sum(n) OVER w / sum(n) OVER (), 9) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 9) AS tpr FROM l WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 'infinity'::DOUBLE, 0, 0""",
    "class_report": f"""WITH {JUDGED}, k AS (SELECT unnest(['HEALTHY', 'UNHEALTHY']) AS class), t AS (SELECT class, count(*) FILTER (truth = class AND label = class) AS tp, count(*) FILTER (label = class) AS pred, count(*) FILTER (truth = class) AS support FROM j, k GROUP BY class),
      r AS (SELECT class, coalesce(tp / nullif(pred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pred + support, 0), 0) AS f1, support FROM t),
      o AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)
      SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM o""",
    "accuracy_by_gene": f"WITH {JUDGED} SELECT gene, count(*) AS total, count(*) FILTER (truth = label) AS correct FROM j GROUP BY gene",
    "score_summary": f"WITH {JUDGED} SELECT count(*) AS total, count(*) FILTER (tie_like) AS tie_like, round(avg(greatest(h, u)), 9) AS mean_score, round(avg(mapq), 9) AS mean_mapq FROM j",
    "class_distribution": f"WITH {QUERY} SELECT s.split, l.label, count(q.query_name) AS n FROM (VALUES ('train'), ('test')) s(split) CROSS JOIN (VALUES ('HEALTHY'), ('UNHEALTHY')) l(label) LEFT JOIN qry q ON q.split = s.split AND q.truth = l.label GROUP BY ALL",
    "prob_histogram": f"""WITH {JUDGED}, d AS (SELECT truth, min(score) AS lo, CASE WHEN max(score) > min(score) THEN (max(score) - min(score)) / 12 ELSE 1 / 12 END AS width, count(*) AS total FROM j GROUP BY truth),
      h AS (SELECT truth, lo, width, total, CAST(least(floor((score - lo) / width), 11) AS INTEGER) AS bin, count(*) AS n FROM j JOIN d USING (truth) GROUP BY ALL)
      SELECT truth, bin, round(lo + bin * width, 9) AS low, round(lo + (bin + 1) * width, 9) AS high, n, round(n / (total * width), 9) AS density FROM h""",
    "feature_table": f"WITH {FEATURES} SELECT * FROM ft",
    "feature_summary": f"WITH {QUERY} SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM qry",
    "path_features": f"WITH {FEATURES} SELECT sequence_id, matched_graph_nodes, traversed_graph_paths, graph_branches_traversed, graph_path_complexity, path_traversal_frequency, node_revisit_count FROM ft",
    "alignment_overlay": f"""WITH {GAF}, f AS (SELECT DISTINCT unnest(nodes) AS node FROM gaf WHERE line_no = 1)
      SELECT 0 AS graph_id, 'p' || p_partkey AS node, f.node IS NOT NULL AS highlighted FROM part LEFT JOIN f ON f.node = 'p' || p_partkey""",
    "segment_resolve": """WITH s AS (SELECT p_partkey % 4 AS sn, p_partkey AS node, p_partkey // 4 * 50 AS a, p_partkey // 4 * 50 + 2 * p_size AS b FROM part WHERE p_size > 0),
      i AS (SELECT o_orderkey AS interval_id, o_orderkey % 4 AS sn, o_custkey * 3 AS "start", o_custkey * 3 + 20 + o_orderkey % 100 AS "end" FROM orders)
      SELECT interval_id, i.sn, "start", "end", node, greatest("start", a) AS "from", least("end", b) AS "to" FROM i JOIN s ON i.sn = s.sn AND "start" < b AND a < "end" """,
    "fasta_normalize": r"""WITH n AS (SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'SS')), '[ \t\n\x0B\f\r]', '', 'g') AS s FROM documents)
      SELECT doc_id, CAST(length(s) AS INTEGER) AS length, md5(s) AS digest, regexp_replace(s, '[^ACGT]', '', 'g') <> '' AS valid, regexp_full_match(s, '[ACGTN]+') AS raw_valid FROM n""",
    "header_parse": """WITH h AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'R' WHEN o_custkey % 7 = 0 THEN 'B' ELSE 'P' END AS kind, o_custkey % 10 AS g, o_orderkey % 2 = 0 AS healthy, o_orderkey % 4 AS a FROM orders),
      r AS (SELECT *, CASE a WHEN 0 THEN 'NC_000021.9' WHEN 1 THEN 'NC_000014.9' WHEN 2 THEN 'NC_000001.11' ELSE 'XX_1' END AS acc, CASE WHEN kind <> 'R' THEN 'UNKNOWN' WHEN a = 0 THEN 'APP' WHEN a = 1 THEN 'PSEN1' WHEN a = 2 THEN 'PSEN2' ELSE 'UNKNOWN' END AS reference_gene FROM h)
      SELECT o_orderkey, CASE kind WHEN 'R' THEN 'ref|' || acc || '|:1-' || o_orderkey WHEN 'P' THEN 'Gene' || g || CASE WHEN healthy THEN '_H_' ELSE '_U_' END || o_orderkey END AS sequence_id,
        CASE kind WHEN 'R' THEN reference_gene WHEN 'P' THEN 'GENE' || g END AS gene, CASE WHEN kind = 'R' THEN 'REFERENCE' WHEN kind = 'P' THEN CASE WHEN healthy THEN 'HEALTHY' ELSE 'UNHEALTHY' END END AS label,
        CASE kind WHEN 'R' THEN true WHEN 'P' THEN false END AS is_reference, reference_gene, CASE WHEN kind = 'P' AND NOT healthy THEN 1 ELSE 0 END AS y FROM r""",
    "dedup_first_seen": f"WITH {SEQ} SELECT gene, label, sequence_id, CAST(length(sequence) AS INTEGER) AS length, md5(sequence) AS digest FROM kept",
    "preprocess_summary": f"""WITH {SEQ} SELECT gene, label, count(*) AS records, count(*) FILTER (sequence = '') AS invalid_skipped, count(*) FILTER (sequence <> '') - count(DISTINCT sequence) FILTER (sequence <> '') AS duplicates_skipped,
        count(DISTINCT sequence) FILTER (sequence <> '') AS kept FROM seq GROUP BY gene, label""",
    "stratified_split": f"WITH {SEQ} SELECT gene, label, sequence_id, split FROM split",
    "split_counts": f"WITH {SEQ} SELECT gene, label, count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM split GROUP BY gene, label",
    "split_rollup": f"""WITH {SEQ} SELECT coalesce(gene, 'Overall') AS gene, count(*) AS total, count(*) FILTER (label = 'HEALTHY' AND split = 'train') AS healthy_train, count(*) FILTER (label = 'HEALTHY' AND split = 'test') AS healthy_test,
        count(*) FILTER (label = 'UNHEALTHY' AND split = 'train') AS unhealthy_train, count(*) FILTER (label = 'UNHEALTHY' AND split = 'test') AS unhealthy_test FROM split GROUP BY ROLLUP (gene)""",
    "sequence_checks": f"""WITH {SEQ} SELECT DISTINCT 'references' AS "check", gene, '' AS label, 0::BIGINT AS n FROM seq
      UNION ALL SELECT 'splittable', gene, label, count(*) FROM seq GROUP BY gene, label HAVING count(*) < 2""",
    "fasta_wrap": f"""WITH {SEQ}, w AS (SELECT sequence_id, list_transform(range(0, length(sequence), 80), lambda i: substr(sequence, i + 1, 80)) AS l FROM seq WHERE sequence <> '')
      SELECT sequence_id, CAST(len(l) AS INTEGER) AS lines, md5(array_to_string(l, chr(10))) AS digest FROM w""",
    "kmer_counts": f"WITH {SEQ}, k AS ({KMERS.format(k=31)}) SELECT gene, label, kmer, count(*) AS n FROM k GROUP BY ALL",
    "kmer_edges": f"WITH {SEQ}, k AS ({KMERS.format(k=32)}) SELECT gene, label, kmer[1:31] AS src, kmer[2:32] AS dst, count(*) AS n FROM k GROUP BY ALL",
    "unitigs": f"""WITH {SEQ}, {UNITIGS}, sg AS (SELECT h.gene, h.node, string_agg(CASE WHEN step = 0 THEN n.node ELSE right(n.node, 1) END, '' ORDER BY step) AS sequence
      FROM spot JOIN kn n ON n.id = spot.id JOIN kn h ON h.id = spot.head GROUP BY h.gene, h.node)
      SELECT gene, node, CAST(len(sequence) AS INTEGER) AS length, md5(sequence) AS digest FROM sg""",
    "unitig_links": f"""WITH {SEQ}, {UNITIGS} SELECT DISTINCT h.gene, h.node AS src, g.node AS dst FROM ke JOIN spot x ON x.id = ke.a JOIN spot y ON y.id = ke.b JOIN kn h ON h.id = x.head JOIN kn g ON g.id = y.head
      WHERE NOT (x.head = y.head AND y.step = x.step + 1)""",
    "seed_hits": f"""WITH {SEQ}, k AS (SELECT gene, label, sequence_id, unnest(list_transform(range(1, len(sequence) - 29), lambda i: substr(sequence, i, 31))) AS kmer FROM kept WHERE len(sequence) >= 31)
      SELECT g.gene, lower(g.label) AS graph_class, k.sequence_id, g.sequence_id AS node, count(*) AS hits FROM k JOIN k g USING (gene, kmer) GROUP BY ALL""",
    "edge_collapse": f"WITH {LINKS} SELECT graph_id, src, dst, src_orient, dst_orient FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY line_no DESC, src_orient DESC, dst_orient DESC) AS r FROM ln) WHERE r = 1",
    "degree": f"""WITH {LINKS} SELECT graph_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree
      FROM (SELECT graph_id, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT graph_id, dst, 1, 0 FROM e) GROUP BY graph_id, node""",
    "topk_subgraph": f"""WITH {LINKS}, d AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, src AS node FROM e UNION ALL SELECT graph_id, dst FROM e) GROUP BY ALL),
      k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node) AS r FROM d) WHERE r <= 3)
      SELECT e.* FROM e JOIN k a ON a.graph_id = e.graph_id AND a.node = e.src JOIN k b ON b.graph_id = e.graph_id AND b.node = e.dst""",
    "weak_components": f"WITH RECURSIVE {LINKS}, {WEAK} SELECT graph_id, node, component FROM weak",
    "reachability": f"WITH RECURSIVE {LINKS}, {REACH} SELECT graph_id, src, dst FROM reach UNION SELECT graph_id, src, src FROM e UNION SELECT graph_id, dst, dst FROM e",
    "strong_components": f"WITH RECURSIVE {LINKS}, {REACH}, {STRONG} SELECT graph_id, node, scc FROM strong",
    "cyclic_nodes": f"WITH RECURSIVE {LINKS}, {REACH} SELECT graph_id, src AS node FROM reach WHERE src = dst",
    "graph_stats": f"""WITH RECURSIVE {LINKS}, {REACH}, {STRONG}, {WEAK},
      w AS (SELECT graph_id, count(*) AS wcc, max(n) AS largest_wcc FROM (SELECT graph_id, component, count(*) AS n FROM weak GROUP BY ALL) GROUP BY graph_id),
      s AS (SELECT graph_id, count(*) AS scc, max(n) AS largest_scc FROM (SELECT graph_id, scc, count(*) AS n FROM strong GROUP BY ALL) GROUP BY graph_id),
      n AS (SELECT graph_id, count(*) AS nodes FROM seg GROUP BY graph_id), l AS (SELECT graph_id, count(*) AS edges, count(*) FILTER (src = dst) AS self_loops FROM e GROUP BY graph_id)
      SELECT graph_id, nodes, coalesce(edges, 0) AS edges, coalesce(self_loops, 0) AS self_loops, wcc, largest_wcc, scc, largest_scc, largest_scc > 1 OR coalesce(self_loops, 0) > 0 AS has_cycle FROM n JOIN w USING (graph_id) JOIN s USING (graph_id) LEFT JOIN l USING (graph_id)""",
    "hop_distance": f"""WITH RECURSIVE {LINKS}, h AS (SELECT graph_id, src, src AS dst, 0 AS hops FROM e UNION SELECT graph_id, dst, dst, 0 FROM e UNION SELECT h.graph_id, h.src, e.dst, h.hops + 1 FROM h JOIN e ON e.graph_id = h.graph_id AND e.src = h.dst WHERE h.hops < 5)
      SELECT graph_id, src, dst, min(hops) AS hops FROM h GROUP BY ALL""",
    "topological_layers": f"""WITH RECURSIVE {LINKS}, p AS (SELECT graph_id, node, 0 AS layer FROM seg UNION SELECT p.graph_id, e.dst, p.layer + 1 FROM p JOIN e ON e.graph_id = p.graph_id AND e.src = p.node WHERE e.src < e.dst)
      SELECT graph_id, node, max(layer) AS layer FROM p GROUP BY ALL""",
    "back_edges": f"WITH RECURSIVE {LINKS}, {REACH}, {STRONG}, {BACK} SELECT graph_id, src, dst FROM bk",
    "dag_after_break": f"""WITH RECURSIVE {LINKS}, {REACH}, {STRONG}, {BACK} SELECT graph_id, src, dst FROM e EXCEPT SELECT graph_id, src, dst FROM bk""",
    "sample_walk": f"WITH RECURSIVE {LINKS}, {REACH}, {LAYERS}, {SAMPLE_WALK} SELECT graph_id, pos, node FROM sw",
    "representative_nodes": f"WITH RECURSIVE {LINKS}, {REACH}, {LAYERS}, {REPRESENTATIVE} SELECT graph_id, node FROM rp",
    "synthetic_cycles": f"""WITH RECURSIVE {LINKS}, g AS (SELECT * FROM e WHERE src < dst), n AS (SELECT graph_id, src AS node FROM g UNION SELECT graph_id, dst FROM g),
      p AS (SELECT graph_id, node, 0 AS layer FROM n UNION SELECT p.graph_id, g.dst, p.layer + 1 FROM p JOIN g ON g.graph_id = p.graph_id AND g.src = p.node),
      o AS (SELECT graph_id, list(node ORDER BY layer, node) AS l FROM (SELECT graph_id, node, max(layer) AS layer FROM p GROUP BY ALL) GROUP BY graph_id HAVING count(*) >= 4),
      c AS (SELECT graph_id, l[-1] AS src, l[2] AS dst FROM o UNION SELECT graph_id, l[-2], l[1] FROM o)
      SELECT c.graph_id, c.src, c.dst, true AS synthetic FROM c ANTI JOIN g ON g.graph_id = c.graph_id AND g.src = c.src AND g.dst = c.dst""",
    "precedence": f"WITH RECURSIVE {CHAIN} SELECT query_id, left_id, right_id FROM gap",
    "gap_cost": f"WITH RECURSIVE {CHAIN} SELECT query_id, left_id, right_id, query_gap, graph_gap, gap FROM gap",
    "chain_scores": f"WITH RECURSIVE {CHAIN} SELECT query_id, anchor_id, max(score) AS score FROM it GROUP BY ALL",
    "best_chain": f"WITH RECURSIVE {CHAIN}, {BEST_CHAIN} SELECT query_id, pos, anchor_id, chain_score FROM bc",
    "chain_gaps": f"""WITH RECURSIVE {CHAIN}, {BEST_CHAIN}, st AS (SELECT query_id, pos, anchor_id AS left_id, lead(anchor_id) OVER (PARTITION BY query_id ORDER BY pos) AS right_id FROM bc)
      SELECT query_id, pos, left_id, right_id, query_gap, graph_gap, gap FROM st JOIN gap USING (query_id, left_id, right_id)""",
    "chain_convergence": f"""WITH RECURSIVE {CHAIN}, top AS (SELECT query_id, anchor_id, max(score) AS s FROM it GROUP BY ALL),
      last AS (SELECT max(first) AS k FROM (SELECT min(iter) AS first FROM it JOIN top USING (query_id, anchor_id) WHERE score = s GROUP BY query_id, anchor_id)),
      by_iter AS (SELECT query_id, iter, max(score) AS best FROM it GROUP BY ALL), n AS (SELECT CAST(unnest(range(0, k + 1)) AS INTEGER) AS iter FROM last)
      SELECT query_id, n.iter AS iter, max(best) AS best_score FROM by_iter JOIN n ON by_iter.iter <= n.iter GROUP BY ALL""",
    "anchor_offsets": f"""WITH {WALK}, s AS (SELECT *, least(8, node * 2) AS span FROM walk), c AS (SELECT *, CAST(coalesce(sum(span + CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS c FROM s)
      SELECT query_id, 'A' || (pos + 1) AS anchor_id, node AS vertex, 1 AS x, CAST(span AS INTEGER) AS y, c, c + span - 1 AS d, CAST(span AS INTEGER) AS weight FROM c""",
    "distractors": f"""WITH {WALK}, l AS (SELECT query_id, CAST(sum(least(8, node * 2)) AS INTEGER) AS qlen FROM walk GROUP BY query_id), f AS (SELECT l.query_id, CAST(t.node AS INTEGER) AS node, qlen FROM l, range(1, 13) t(node) ANTI JOIN walk ON walk.query_id = l.query_id AND walk.node = t.node),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY node) AS INTEGER) AS i, CAST(least(6, node * 2) AS INTEGER) AS span FROM f)
      SELECT query_id, 'N' || i AS anchor_id, node AS vertex, 1 AS x, span AS y, greatest(1, qlen - 4 * i) AS c, greatest(1, qlen - 4 * i + span - 1) AS d, greatest(3, span - 2) AS weight FROM r WHERE i <= 2""",
    "branching_nodes": f"""WITH {LINKS} SELECT graph_id, node FROM (SELECT graph_id, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT graph_id, dst, 1, 0 FROM e) GROUP BY graph_id, node HAVING sum(i) > 1 OR sum(o) > 1""",
    "all_nodes": f"""WITH {LINKS} SELECT graph_id, node FROM seg WHERE node <> 'n0' UNION SELECT graph_id, src FROM e UNION SELECT graph_id, dst FROM e""",
    "cover_check": "SELECT true AS covers",
    "walk_sequence": f"""WITH RECURSIVE {LINKS}, {REACH}, {LAYERS}, {SAMPLE_WALK}, sq AS (SELECT graph_id, pos, substr({BASES.format(name="node")}, 1, 10) AS s, max(pos) OVER (PARTITION BY graph_id) AS last FROM sw)
      SELECT graph_id, string_agg(s || CASE WHEN pos % 2 = 0 AND pos < last THEN 'N' ELSE '' END, '' ORDER BY pos) AS sequence FROM sq GROUP BY graph_id""",
    "context_snapshot": f"""WITH RECURSIVE {LINKS}, {REACH}, {LAYERS}, {REPRESENTATIVE}, pe AS (SELECT e.* FROM e JOIN rp a ON a.graph_id = e.graph_id AND a.node = e.src JOIN rp b ON b.graph_id = e.graph_id AND b.node = e.dst),
      pr AS (SELECT graph_id, src, dst FROM pe UNION SELECT r.graph_id, r.src, p.dst FROM pr r JOIN pe p ON p.graph_id = r.graph_id AND p.src = r.dst),
      po AS (SELECT graph_id, src AS node FROM pe UNION SELECT graph_id, dst FROM pe),
      pp AS (SELECT graph_id, node, 0 AS layer FROM po WHERE graph_id NOT IN (SELECT graph_id FROM pr WHERE src = dst) UNION SELECT p.graph_id, e.dst, p.layer + 1 FROM pp p JOIN pe e ON e.graph_id = p.graph_id AND e.src = p.node),
      ol AS (SELECT graph_id, list(node ORDER BY layer, node) AS l FROM (SELECT graph_id, node, max(layer) AS layer FROM pp GROUP BY ALL) GROUP BY graph_id HAVING count(*) >= 4),
      ce AS (SELECT graph_id, src, dst FROM pe UNION SELECT graph_id, l[-1], l[2] FROM ol UNION SELECT graph_id, l[-2], l[1] FROM ol),
      st AS (SELECT 'original' AS stage, * FROM e UNION ALL SELECT 'representative', * FROM pe UNION ALL SELECT 'cyclic', * FROM ce),
      nl AS (SELECT stage, graph_id, list(node ORDER BY node) AS nodes FROM (SELECT stage, graph_id, src AS node FROM st UNION SELECT stage, graph_id, dst FROM st) GROUP BY ALL)
      SELECT st.graph_id, st.stage, CAST(len(nodes) AS BIGINT) AS nodes, count(*) AS edges, array_to_string(nodes, ',') AS node_list FROM st JOIN nl USING (stage, graph_id) GROUP BY ALL""",
    "anchors_per_node": f"WITH {WALK} SELECT query_id, CAST(t.node AS INTEGER) AS node, count(walk.node) AS anchors FROM (SELECT DISTINCT query_id FROM walk) q CROSS JOIN range(1, 13) t(node) LEFT JOIN walk USING (query_id, node) GROUP BY ALL",
    "anchor_order": f"WITH RECURSIVE {CHAIN} SELECT query_id, anchor_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c, d, anchor_id) AS INTEGER) AS ord FROM a",
    "explanations": f"""WITH {GAF}, {CLASSES} SELECT query_name, CASE WHEN abs(h - u) < 1e-6 THEN 'Evidence is balanced: healthy ' ELSE CASE WHEN h >= u THEN 'HEALTHY' ELSE 'UNHEALTHY' END || ' is better supported: healthy ' END
        || CAST(round(CAST(CAST(h AS VARCHAR) AS DECIMAL(20, 17)), 4)::DECIMAL(18, 4) AS VARCHAR) || ', unhealthy ' || CAST(round(CAST(CAST(u AS VARCHAR) AS DECIMAL(20, 17)), 4)::DECIMAL(18, 4) AS VARCHAR) || '.' AS explanation FROM cls""",
    "fasta_files": f"WITH {SEQ} SELECT sequence_id, gene, label, CAST(length(sequence) AS INTEGER) AS length, md5(sequence) AS digest, true AS valid FROM seq WHERE sequence <> ''",
    "combined_fasta": f"""WITH {SEQ} SELECT gene, sequence_id, CAST(row_number() OVER (PARTITION BY gene ORDER BY label, doc_id) AS INTEGER) AS place FROM seq WHERE sequence <> ''""",
    "gfa_segments": f"""SELECT 'all' AS graph_id, 'p' || p_partkey AS node, CAST(10 + p_partkey % 20 AS INTEGER) AS length, md5(substr({BASES.format(name="'p' || p_partkey")}, 1, CAST(10 + p_partkey % 20 AS INTEGER))) AS digest,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'chr' || p_partkey % 4 END AS sn, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey * 40 END AS so, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 0 END AS sr FROM part""",
    "gfa_links": "SELECT 'all' AS graph_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, '+' AS src_orient, CASE WHEN l_returnflag = 'A' THEN '-' ELSE '+' END AS dst_orient, count(*) AS n FROM lineitem GROUP BY ALL",
    "gaf_files": f"""WITH {GAF} SELECT graph_class AS source, query_name, CASE WHEN nm = 3 THEN NULL ELSE path END AS path, CASE WHEN nm = 3 THEN NULL ELSE matches END AS residue_matches, nm = 3 AS corrupt FROM
      (SELECT graph_class, nm, path, matches, CASE WHEN nm = 3 THEN NULL ELSE query_name END AS query_name FROM gaf)""",
    "gaf_json": f"WITH {GAF} SELECT query_name, round(block / qlen, 9) AS coverage, round(matches / block, 9) AS identity, CAST(matches + has_as::INT AS DOUBLE) AS alignment_score, array_to_string(nodes, ',') AS traversed_nodes FROM gaf",
    "manifest_files": f"""WITH {SEQ} SELECT gene, lower(label) AS bucket, sequence_id, 'seq/' || sequence_id || '.fa' AS path FROM kept
      UNION ALL SELECT gene, 'reference', NULL, 'ref/' || gene || '.fa' FROM (SELECT DISTINCT gene FROM kept)""",
    "feature_files": f"WITH {FEATURES} SELECT * FROM ft",
    "unknown_genes": f"WITH {SEQ} SELECT sequence_id, gene FROM seq WHERE gene NOT IN (SELECT DISTINCT gene FROM seq WHERE label = 'UNHEALTHY' AND doc_id % 7 = 0)",
    "missing_samples": f"""WITH {SEQ} SELECT g.gene, c.graph_class FROM (SELECT DISTINCT gene FROM seq) g CROSS JOIN (VALUES ('healthy'), ('unhealthy'), ('combined'), ('other')) c(graph_class)
      WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.gene = g.gene AND (lower(k.label) = c.graph_class OR c.graph_class = 'combined'))""",
    "graph_samples": f"WITH {SEQ} SELECT gene, lower(label) AS graph_class, sequence_id FROM kept UNION ALL SELECT gene, 'combined', sequence_id FROM kept",
    "sequence_lookup": f"WITH {SEQ} SELECT sequence_id, md5(sequence) AS digest FROM seq WHERE doc_id IN (SELECT doc_id FROM labels)",
    "split_in_order": f"WITH {SEQ} SELECT gene, label, sequence_id, split, CAST(row_number() OVER (PARTITION BY gene, label, split ORDER BY doc_id) AS INTEGER) AS place FROM split",
    "rule_records": f"WITH {JUDGED} SELECT query_name AS sequence_id, gene, truth AS label_name, label AS predicted, score AS probability FROM j WHERE split = 'test'",
}
