"""DuckDB SQL of the iterative graph measures, as common tables over e(source, target) and at a WITH RECURSIVE.

The rounds of an iteration carry their whole state, so that a round sees only the one before it.
"""

COMMUNITIES = """n AS MATERIALIZED (SELECT DISTINCT unnest([source, target]) AS node FROM e),
s AS MATERIALIZED (SELECT source AS node, target AS other FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target),
l AS (
  SELECT 0 AS turn, node, node AS label, 0 AS moves FROM n
  UNION ALL
  SELECT turn + 1, node, CASE WHEN wants AND (least IS NULL OR rank < least) THEN best ELSE label END, moves + (wants AND (least IS NULL OR rank < least))::INTEGER FROM (
    SELECT *, bool_or(wants) OVER () AS live FROM (
      SELECT w.*, (SELECT min(x.rank) FROM s JOIN (
        SELECT l.node, CASE WHEN l.turn < 32 THEN lpad(moves::VARCHAR, 9, '0') ELSE md5(l.turn || ':' || l.node) END || l.node AS rank FROM l JOIN (SELECT node, arg_min(label, (-k, label)) AS best FROM (SELECT s.node, l.label, count(*) AS k FROM s JOIN l ON l.node = s.other GROUP BY 1, 2) GROUP BY 1) v USING (node) WHERE v.best <> l.label
      ) x ON x.node = s.other WHERE s.node = w.node) AS least
      FROM (SELECT l.turn, l.node, l.label, l.moves, v.best, coalesce(v.best <> l.label, false) AS wants, CASE WHEN l.turn < 32 THEN lpad(moves::VARCHAR, 9, '0') ELSE md5(l.turn || ':' || l.node) END || l.node AS rank FROM l
            LEFT JOIN (SELECT node, arg_min(label, (-k, label)) AS best FROM (SELECT s.node, l.label, count(*) AS k FROM s JOIN l ON l.node = s.other GROUP BY 1, 2) GROUP BY 1) v USING (node)) w
    )
  ) WHERE live
),
cm AS (SELECT node, min(node) OVER (PARTITION BY label) AS community FROM l WHERE turn = (SELECT max(turn) FROM l))"""

CENTRALITY = """ce AS (SELECT n.node, round(CASE WHEN (SELECT count(*) FROM n) > 1 THEN count(DISTINCT other) / ((SELECT count(*) FROM n) - 1) ELSE 0.0 END, 6) AS centrality FROM n LEFT JOIN s ON s.node = n.node GROUP BY 1)"""

BETWEENNESS = """st AS MATERIALIZED (SELECT node FROM n ORDER BY node LIMIT (SELECT CASE WHEN count(*) < 50 THEN count(*) ELSE 20 END FROM n)),
f AS (
  SELECT 0 AS turn, node AS start, node, 0 AS depth, 1.0::DOUBLE AS paths FROM st
  UNION ALL
  SELECT turn + 1, start, node, depth, paths FROM (
    SELECT *, bool_or(fresh) OVER () AS live FROM (
      SELECT turn, start, node, depth, paths, false AS fresh FROM f
      UNION ALL
      SELECT g.*, true FROM (SELECT max(f.turn) AS turn, f.start, s.other AS node, max(f.depth) + 1 AS depth, sum(f.paths) AS paths FROM f JOIN s ON s.node = f.node WHERE f.depth = f.turn GROUP BY f.start, s.other) g
      WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.start = g.start AND f.node = g.node)
    )
  ) WHERE live
),
sp AS MATERIALIZED (SELECT start, node, depth, paths FROM f WHERE turn = (SELECT max(turn) FROM f)),
z AS (
  SELECT depth, start, node, paths, 0.0::DOUBLE AS gain FROM sp WHERE depth = (SELECT max(depth) FROM sp)
  UNION ALL
  SELECT p.depth, p.start, p.node, p.paths, coalesce(sum(p.paths / q.paths * (1 + q.gain)), 0.0)
  FROM (SELECT * FROM sp WHERE depth = (SELECT max(depth) - 1 FROM z)) p LEFT JOIN (SELECT s.node, z.start, z.paths, z.gain FROM s JOIN z ON z.node = s.other) q ON q.node = p.node AND q.start = p.start GROUP BY 1, 2, 3, 4
),
sc AS (SELECT CASE WHEN n > 2 THEN n / (CASE WHEN n < 50 THEN n ELSE 20 END) / 2 * (2 / ((n - 1) * (n - 2))) ELSE 0.0 END AS scale FROM (SELECT count(*) AS n FROM n)),
bt AS (SELECT n.node, round(coalesce(sum(gain) FILTER (z.node <> z.start), 0.0) * (SELECT scale FROM sc), 6) AS betweenness FROM n LEFT JOIN z ON z.node = n.node GROUP BY 1)"""


#: With every node as a source. Neighbours of a level's nodes are of it, the one before or the next one, so a round carries two.
BETWEENNESS_EXACT = f"""f AS (
  SELECT 0 AS turn, node AS start, node, 0 AS depth, 1.0::DOUBLE AS paths FROM n
  UNION ALL
  SELECT turn + 1, start, node, depth, paths FROM (
    SELECT *, bool_or(fresh) OVER () AS live FROM (
      SELECT turn, start, node, depth, paths, false AS fresh FROM f WHERE depth = turn
      UNION ALL
      SELECT g.*, true FROM (SELECT max(f.turn) AS turn, f.start, s.other AS node, max(f.depth) + 1 AS depth, sum(f.paths) AS paths FROM f JOIN s ON s.node = f.node WHERE f.depth = f.turn GROUP BY f.start, s.other) g
      WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.start = g.start AND f.node = g.node)
    )
  ) WHERE live
),
sp AS MATERIALIZED (SELECT start, node, depth, paths FROM f WHERE turn = depth),
{BETWEENNESS[BETWEENNESS.index("z AS (") : BETWEENNESS.index("sc AS (")]}sc AS (SELECT CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 0.0 END AS scale FROM (SELECT count(*) AS n FROM n)),
{BETWEENNESS[BETWEENNESS.index("bt AS (") :]}"""
