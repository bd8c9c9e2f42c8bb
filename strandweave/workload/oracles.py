"""SQL statements over the same tables that must give the same rows as the queries."""

from __future__ import annotations

from strandweave.functions.sequence import single
from strandweave.workload.fixtures import _ALPHABET, _BASES

ORACLES: dict[str, str] = {}

_RATIO = f"CAST('{single(0.8)!r}' AS DOUBLE)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


# --- virtual reads and alignments ------------------------------------------------------

READS = """
cnt AS (SELECT count(*) AS n FROM part),
reads AS (
  SELECT p_partkey AS id, 'r' || p_partkey AS name, (p_partkey * 7919) % (500 * n) AS g0,
         2000 + (p_partkey * 104729) % 6000 AS len, p_partkey % 2 AS rc,
         (p_partkey * 7919) % (500 * n) + 2000 + (p_partkey * 104729) % 6000 AS g1
  FROM part, cnt)
"""

ALN = READS + """,
hit AS (
  SELECT 0 AS kind, a.id AS a, b.id AS b, greatest(a.g0, b.g0) AS s, least(a.g1, b.g1) AS e
  FROM reads a JOIN reads b ON a.id < b.id AND least(a.g1, b.g1) - greatest(a.g0, b.g0) >= 500),
across AS (
  SELECT a.id AS a, b.id AS b, a.len AS alen, b.len AS blen
  FROM reads a, cnt, reads b WHERE b.id = (a.id + n // 2) % n),
spots AS (
  SELECT kind, a, b,
    CASE WHEN ra.rc = 0 THEN s - ra.g0 ELSE ra.g1 - e END AS qstart,
    CASE WHEN ra.rc = 0 THEN e - ra.g0 ELSE ra.g1 - s END AS qend,
    CASE WHEN rb.rc = 0 THEN s - rb.g0 ELSE rb.g1 - e END AS tstart,
    CASE WHEN rb.rc = 0 THEN e - rb.g0 ELSE rb.g1 - s END AS tend,
    CASE WHEN ra.rc = rb.rc THEN '+' ELSE '-' END AS strand,
    e - s AS block_len, ((e - s) * (80 + (a * b) % 20)) // 100 AS nmatch
  FROM hit JOIN reads ra ON ra.id = a JOIN reads rb ON rb.id = b
  UNION ALL
  SELECT 1, a, b, alen - 2000, alen, 0, 2000, '+', 2000, 1700 FROM across WHERE a % 20 = 0
  UNION ALL
  SELECT 2, a, b, 2000, 4000, 2000, 4000, '+', 2000, 1700 FROM across
  WHERE a % 20 = 7 AND alen >= 6000 AND blen >= 6000
  UNION ALL
  SELECT 3, id, id, 0, 2000, 0, 2000, '+', 2000, 2000 FROM reads WHERE id % 50 = 3),
aln AS (
  SELECT (kind * n + a) * n + b AS line_no, ra.name AS qname, ra.len AS qlen, qstart, qend, strand,
         rb.name AS tname, rb.len AS tlen, tstart, tend, nmatch, block_len, CAST(60 AS SMALLINT) AS mapq
  FROM spots, cnt, reads ra, reads rb WHERE ra.id = a AND rb.id = b)
"""


def _reason(min_identity: float) -> str:
    return f"""CASE WHEN qname = tname THEN 'self'
      WHEN qend - qstart < 2000 OR tend - tstart < 2000 THEN 'short'
      WHEN block_len = 0 OR CAST(CAST(CAST(nmatch AS FLOAT) / CAST(block_len AS FLOAT) AS FLOAT)
           * CAST(100 AS FLOAT) AS FLOAT) < CAST({min_identity} AS FLOAT) THEN 'identity'
      ELSE 'pass' END"""


IDENT = """CAST(CAST(CAST(CAST(nmatch AS FLOAT) / CAST(block_len AS FLOAT) AS FLOAT)
    * CAST(100 AS FLOAT) AS FLOAT) AS DOUBLE)"""

PASSED = ALN + f""",
passed AS (SELECT * FROM aln WHERE {_reason(5.0)} = 'pass')
"""

SIDES = """
sides AS (
  SELECT qname AS name, qlen AS length, qstart AS s, qend AS e, line_no FROM passed
  UNION ALL SELECT tname, tlen, tstart, tend, line_no FROM passed)
"""


def _depth(source: str) -> str:
    """Depth steps of ``source(name, s, e)``: running depth from pos to stop."""
    return f"""
ev AS (
  SELECT name, pos, sum(d) AS d FROM (
    SELECT name, s AS pos, 1 AS d FROM {source} WHERE s < e
    UNION ALL SELECT name, e, -1 FROM {source} WHERE s < e)
  GROUP BY name, pos HAVING sum(d) <> 0),
steps AS (
  SELECT name, pos, d, CAST(sum(d) OVER (PARTITION BY name ORDER BY pos) AS BIGINT) AS depth,
         lead(pos) OVER (PARTITION BY name ORDER BY pos) AS stop FROM ev)
"""


def _regions(above: int) -> str:
    return f"""
flips AS (
  SELECT name, pos, depth, lead(pos) OVER (PARTITION BY name ORDER BY pos) AS stop
  FROM steps WHERE (depth > {above}) <> (depth - d > {above})),
longest AS (
  SELECT * FROM (
    SELECT name, pos AS cov_start, stop AS cov_end,
           row_number() OVER (PARTITION BY name ORDER BY stop - pos DESC, pos) AS k
    FROM flips WHERE depth > {above}) WHERE k = 1),
deepest AS (SELECT name, max(depth) AS max_depth FROM steps GROUP BY name)
"""


REGIONS = (
    PASSED
    + ","
    + SIDES
    + ","
    + _depth("sides")
    + ","
    + _regions(3)
    + """,
lens AS (SELECT name, arg_min(length, line_no) AS length FROM sides GROUP BY name),
regions AS (
  SELECT lens.name, length, coalesce(cov_start, 0) AS cov_start, coalesce(cov_end, 0) AS cov_end,
         coalesce(max_depth, 0) AS max_depth
  FROM lens LEFT JOIN longest USING (name) LEFT JOIN deepest USING (name))
"""
)

BEST = """
best AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY least(qname, tname), greatest(qname, tname)
                                 ORDER BY block_len DESC, line_no) AS k FROM passed) WHERE k = 1)
"""

_CLIP = {
    "observed": """
clipped AS (
  SELECT best.*, q.cov_start AS qcs, q.cov_end AS qce, t.cov_start AS tcs, t.cov_end AS tce,
    greatest(qstart, q.cov_start) AS b1, least(qend, q.cov_end) AS e1,
    greatest(tstart, t.cov_start) AS ts, least(tend, t.cov_end) AS te
  FROM best JOIN regions q ON q.name = qname JOIN regions t ON t.name = tname)
""",
    "coclip": """
trims AS (
  SELECT best.*, q.cov_start AS qcs, q.cov_end AS qce, t.cov_start AS tcs, t.cov_end AS tce,
    greatest(0, q.cov_start - qstart,
      CASE WHEN strand = '+' THEN t.cov_start - tstart ELSE tend - t.cov_end END) AS l,
    greatest(0, qend - q.cov_end,
      CASE WHEN strand = '+' THEN tend - t.cov_end ELSE t.cov_start - tstart END) AS r
  FROM best JOIN regions q ON q.name = qname JOIN regions t ON t.name = tname),
clipped AS (
  SELECT * EXCLUDE (l, r), qstart + l - qcs AS b1, qend - r - qcs AS e1,
    tstart + CASE WHEN strand = '+' THEN l ELSE r END - tcs AS ts,
    tend - CASE WHEN strand = '+' THEN r ELSE l END - tcs AS te FROM trims)
""",
}


def _classes(coords: str) -> str:
    return (
        BEST
        + ","
        + _CLIP[coords]
        + f""",
placed AS (
  SELECT *, qce - qcs AS l1, tce - tcs AS l2,
    CASE WHEN strand = '+' THEN ts ELSE (tce - tcs) - te END AS b2,
    CASE WHEN strand = '+' THEN te ELSE (tce - tcs) - ts END AS e2 FROM clipped),
hung AS (SELECT *, least(b1, b2) + least(l1 - e1, l2 - e2) AS hang FROM placed),
classified AS (
  SELECT *, CASE
    WHEN hang > CAST(ceil(CAST(greatest(e1 - b1, e2 - b2) AS DOUBLE) * {_RATIO}) AS BIGINT) THEN 'internal'
    WHEN b1 <= b2 AND l1 - e1 <= l2 - e2 THEN 'first_contained'
    WHEN b1 >= b2 AND l1 - e1 >= l2 - e2 THEN 'second_contained'
    WHEN least(e1 - b1, e2 - b2) + hang < 2000 THEN 'too_short'
    ELSE 'proper' END AS class FROM hung)
"""
    )


EDGES = f"""
proper AS (
  SELECT *, qname || ':' || qcs || '-' || qce AS qk, tname || ':' || tcs || '-' || tce AS tk,
    CASE WHEN strand = '+' THEN '-' ELSE '+' END AS flipped, {IDENT} AS ident
  FROM classified WHERE class = 'proper'),
ovl AS (
  SELECT qname, tname,
    CASE WHEN b1 > b2 THEN qk || '+' ELSE tk || strand END AS source,
    CASE WHEN b1 > b2 THEN tk || strand ELSE qk || '+' END AS sink,
    CASE WHEN b1 > b2 THEN tk || flipped ELSE qk || '-' END AS rc_source,
    CASE WHEN b1 > b2 THEN qk || '-' ELSE tk || flipped END AS rc_sink,
    abs(b1 - b2) AS edge_len,
    CASE WHEN b1 > b2 THEN (l2 - e2) - (l1 - e1) ELSE (l1 - e1) - (l2 - e2) END AS rc_edge_len,
    greatest(e1 - b1, e2 - b2) AS overlap_len, round(ident, 4) AS identity
  FROM proper),
inside AS (
  SELECT DISTINCT CASE WHEN class = 'first_contained' THEN qname ELSE tname END AS name
  FROM classified WHERE class IN ('first_contained', 'second_contained')),
kept AS (
  SELECT * FROM ovl WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT name FROM inside UNION SELECT name FROM regions WHERE max_depth < 3) x
    WHERE x.name = qname OR x.name = tname))
"""

GRAPH = """
rkeys AS (
  SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx FROM (
    SELECT source[:-2] AS k FROM kept UNION SELECT sink[:-2] FROM kept)),
nodes AS (
  SELECT 2 * idx + o AS nid, k || CASE WHEN o = 0 THEN '+' ELSE '-' END AS node_id,
    split_part(k, ':', 1) AS read,
    CAST(split_part(split_part(k, ':', 2), '-', 1) AS BIGINT) AS cov_start,
    CAST(split_part(split_part(k, ':', 2), '-', 2) AS BIGINT) AS cov_end,
    CASE WHEN o = 0 THEN '+' ELSE '-' END AS ori
  FROM rkeys, (SELECT unnest([0, 1]) AS o)),
two AS (
  SELECT source AS s, sink AS t, edge_len, overlap_len, identity FROM kept
  UNION ALL SELECT rc_source, rc_sink, rc_edge_len, overlap_len, identity FROM kept),
edges AS (
  SELECT a.nid AS src, b.nid AS dst, edge_len, overlap_len, identity
  FROM two JOIN nodes a ON a.node_id = s JOIN nodes b ON b.node_id = t)
"""


def _transitive(source: str, into: str, fuzz: int = 10) -> str:
    """Fold over the middle nodes of each start, shortest first, skipping eliminated ones."""
    return f"""
far AS (SELECT src, max(edge_len) AS longest, min(edge_len) AS nearest FROM {source} GROUP BY src),
hops AS (
  SELECT x.src AS n1, x.dst AS n2, y.dst AS n3, x.edge_len AS len12, y.edge_len AS len23, z.edge_len AS len13,
    x.edge_len + y.edge_len <= f1.longest + {fuzz} AS by_path,
    y.edge_len < {fuzz} OR y.edge_len = f2.nearest AS by_step
  FROM {source} x JOIN {source} y ON y.src = x.dst JOIN {source} z ON z.src = x.src AND z.dst = y.dst
  JOIN far f1 ON f1.src = x.src JOIN far f2 ON f2.src = x.dst),
mids AS (
  SELECT n1, n2, any_value(len12) AS len12, list(n3) AS t FROM hops WHERE by_path GROUP BY n1, n2),
folds AS (
  SELECT n1, list_reduce(list({{'n2': n2, 't': t}} ORDER BY len12, n2),
    lambda acc, m: CASE WHEN list_contains(acc.t, m.n2) THEN acc
                        ELSE {{'n2': m.n2, 't': list_concat(acc.t, m.t)}} END,
    {{'n2': CAST(-1 AS BIGINT), 't': CAST([] AS BIGINT[])}}) AS acc
  FROM mids GROUP BY n1),
doomed AS (
  SELECT n1 AS s, unnest(acc.t) AS t FROM folds
  UNION SELECT n1, n3 FROM hops WHERE by_step),
{into} AS (
  SELECT * FROM {source} e WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT s, t FROM doomed UNION SELECT xor(t, 1), xor(s, 1) FROM doomed) d
    WHERE d.s = e.src AND d.t = e.dst))
"""


def _short(source: str, into: str) -> str:
    return f"""
tops AS (SELECT src, max(overlap_len) AS longest, count(*) AS n_out FROM {source} GROUP BY src),
brief AS (
  SELECT e.src AS s, e.dst AS t FROM {source} e JOIN tops USING (src)
  WHERE n_out >= 2 AND overlap_len < CAST(floor(CAST(longest AS DOUBLE) * CAST(0.8 AS DOUBLE) + CAST(0.499 AS DOUBLE)) AS BIGINT)),
{into} AS (
  SELECT * FROM {source} e WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT s, t FROM brief UNION SELECT xor(t, 1), xor(s, 1) FROM brief) d
    WHERE d.s = e.src AND d.t = e.dst))
"""


def _chains(source: str) -> str:
    """Chains of ``source`` over ``nodes(nid)``: walk links from heads, then around cycles."""
    return f"""
outs AS (SELECT src, count(*) AS n FROM {source} GROUP BY src),
ins AS (SELECT dst, count(*) AS n FROM {source} GROUP BY dst),
links AS (
  SELECT e.src, e.dst, e.edge_len FROM {source} e JOIN outs o ON o.src = e.src JOIN ins i ON i.dst = e.dst
  WHERE o.n = 1 AND i.n = 1),
walk AS (
  SELECT nid, nid AS head, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS off FROM nodes
  WHERE nid NOT IN (SELECT dst FROM links)
  UNION ALL
  SELECT l.dst, w.head, w.pos + 1, w.off + l.edge_len FROM walk w JOIN links l ON l.src = w.nid),
ring AS (SELECT nid FROM nodes WHERE nid NOT IN (SELECT nid FROM walk)),
lap AS (
  SELECT nid, nid AS cur FROM ring
  UNION SELECT r.nid, l.dst FROM lap r JOIN links l ON l.src = r.cur),
low AS (SELECT nid, min(cur) AS low FROM lap GROUP BY nid),
turn AS (
  SELECT nid, nid AS head, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS off FROM low WHERE nid = low
  UNION ALL
  SELECT l.dst, w.head, w.pos + 1, w.off + l.edge_len FROM turn w JOIN links l ON l.src = w.nid
  WHERE l.dst <> w.head),
chain AS (
  SELECT *, false AS cyclic FROM walk UNION ALL SELECT *, true FROM turn)
"""


def _unitigs(source: str) -> str:
    return (
        _chains(source)
        + f""",
tails AS (
  SELECT head, any_value(cyclic) AS cyclic, max(pos) AS last_pos, arg_max(nid, pos) AS tail FROM chain GROUP BY head),
starts AS (
  SELECT head, CAST(NULL AS BIGINT) AS lead_node, CAST(0 AS BIGINT) AS lead_len, false AS closed, 'l' AS topology
  FROM tails LEFT JOIN ins ON dst = head WHERE NOT cyclic AND coalesce(n, 0) <> 1 AND last_pos > 0
  UNION ALL
  SELECT head, e.src, e.edge_len, e.src = tail, 'l' FROM tails JOIN ins ON ins.dst = head AND n = 1
  JOIN {source} e ON e.dst = head WHERE NOT cyclic AND e.src <> head
  UNION ALL
  SELECT head, NULL, 0, false, 'c' FROM tails WHERE cyclic),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(lead_node, head), head) - 1 AS unitig_id FROM starts),
raw_members AS (
  SELECT unitig_id, pos + CASE WHEN lead_node IS NULL THEN 0 ELSE 1 END AS pos, nid AS node,
    CASE WHEN closed AND l.dst = lead_node THEN NULL ELSE l.dst END AS next,
    CASE WHEN closed AND l.dst = lead_node THEN NULL ELSE l.edge_len END AS edge_len,
    off + lead_len AS off
  FROM chain JOIN numbered USING (head) LEFT JOIN links l ON l.src = nid
  WHERE NOT (closed AND nid = lead_node)
  UNION ALL
  SELECT unitig_id, 0, lead_node, head, lead_len, 0 FROM numbered WHERE lead_node IS NOT NULL),
members AS (
  SELECT unitig_id, CAST(pos AS BIGINT) AS pos, node, next, edge_len, CAST(off AS BIGINT) AS off FROM raw_members),
utgs AS (
  SELECT unitig_id, count(*) AS n_members, arg_min(node, pos) AS first, any_value(topology) AS topology
  FROM members JOIN numbered USING (unitig_id) GROUP BY unitig_id),
holders AS (
  SELECT node // 2 AS read_idx, unitig_id,
    row_number() OVER (PARTITION BY node // 2 ORDER BY n_members DESC, unitig_id) AS k
  FROM members JOIN utgs USING (unitig_id)),
keepers AS (SELECT DISTINCT unitig_id FROM holders WHERE k = 1)
"""
    )


F1 = REGIONS + "," + _classes("observed")
F1C = REGIONS + "," + _classes("coclip")
F1G = F1 + "," + EDGES + "," + GRAPH
_CLEAN = "," + _transitive("edges", "slim") + "," + _short("slim", "clean") + "," + _unitigs("clean")
F1U = F1G + _CLEAN
F1CU = F1C + "," + EDGES + "," + GRAPH + _CLEAN
LAYOUT = """
layout AS (
  SELECT unitig_id, pos, read, cov_start, cov_end, ori, off AS utg_start,
    off + coalesce(edge_len, cov_end - cov_start) AS utg_end
  FROM members SEMI JOIN keepers USING (unitig_id) JOIN nodes ON nid = node)
"""
GENOME = """
genome AS (
  SELECT string_agg(translate(md5(CAST(x AS VARCHAR))[1], '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY x) AS g
  FROM (SELECT unnest(range(0, 500 * n + 8000)) AS x FROM cnt)),
seqs AS (
  SELECT id, name, rc, len, CASE WHEN rc = 0 THEN substring(g, g0 + 1, len)
    ELSE translate(reverse(substring(g, g0 + 1, len)), 'ACGT', 'TGCA') END AS seq
  FROM reads, genome)
"""

# --- graphs --------------------------------------------------------------------------------

_LEAD = """lead(l_partkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"""

STEPS = f"""
pairs AS (SELECT l_partkey AS p, l_quantity AS qty, l_discount AS disc, {_LEAD} AS q FROM lineitem),
one_way AS (
  SELECT p * 2 + p % 2 AS src, q * 2 + q % 2 AS dst, 1 + (p * 31 + q * 17) % 60 AS edge_len,
    CAST(floor(qty) AS BIGINT) AS overlap_len, round(100.0 - 100.0 * disc, 6) AS identity
  FROM pairs WHERE q IS NOT NULL AND q <> p),
steps2 AS (
  SELECT * FROM one_way
  UNION ALL SELECT xor(dst, 1), xor(src, 1), edge_len, overlap_len, identity FROM one_way)
"""
PARTG = STEPS + """,
edges AS MATERIALIZED (
  SELECT src, dst, edge_len, overlap_len, identity FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY overlap_len DESC, identity DESC, edge_len) AS k
    FROM steps2) WHERE k = 1),
nodes AS (SELECT src AS nid FROM edges UNION SELECT dst FROM edges)
"""
SUCC = f"""
cons AS (SELECT l_partkey AS p, {_LEAD} AS q FROM lineitem),
nearest AS (
  SELECT p, q, l FROM (
    SELECT p, q, 1 + (p * 31 + q * 17) % 60 AS l,
      row_number() OVER (PARTITION BY p ORDER BY 1 + (p * 31 + q * 17) % 60, q) AS k
    FROM (SELECT DISTINCT p, q FROM cons WHERE q IS NOT NULL AND q <> p)) WHERE k = 1),
fw AS (
  SELECT p * 2 + p % 2 AS src, q * 2 + q % 2 AS dst, l AS edge_len,
    100 + (p * 13 + q * 7) % 900 AS overlap_len, CAST(90 + (p + q) % 10 AS DOUBLE) AS identity FROM nearest),
edges AS (
  SELECT * FROM fw UNION ALL SELECT xor(dst, 1), xor(src, 1), edge_len, overlap_len, identity FROM fw),
nodes AS (SELECT src AS nid FROM edges UNION SELECT dst FROM edges)
"""
ITEMS = """
cnt AS (SELECT count(*) AS n FROM part),
ords AS (
  SELECT o_orderkey AS o, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx
  FROM orders),
items AS (
  SELECT l_orderkey AS o, l_partkey AS p, max(CAST(floor(l_quantity) AS BIGINT)) AS qty,
    max(CAST(floor(l_extendedprice) AS BIGINT)) AS price, min(round(100.0 - 100.0 * l_discount, 6)) AS ident
  FROM lineitem GROUP BY 1, 2),
parts AS (
  SELECT ords.o, nx, p, qty, price, ident, (ords.o * n + p) * 4 + 2 AS item,
    CAST(price AS DOUBLE) * 1.0e0 + ident * 2.0e2 + 3.0e0 AS sf,
    CAST(qty * 1000 AS DOUBLE) * 1.0e0 + ident * 2.0e2 + 3.0e0 AS sm
  FROM items JOIN ords ON ords.o = items.o, cnt WHERE nx IS NOT NULL)
"""


def _bubble_round(source: str, into: str) -> str:
    """One round: losers of both views of each bubble, the view whose turn is first winning."""
    return f"""
{into}_top AS (
  SELECT o, arg_max(item, (sf, -item)) AS tf, max(sf) AS bf, arg_max(item, (sm, -item)) AS tm, max(sm) AS bm
  FROM {source} GROUP BY o),
{into}_x AS (
  SELECT s.*, tf, tm, item <> tf AND bf > sf AND sf * 1.1e0 <= bf AS xf, item <> tm AND bm > sm AND sm * 1.1e0 <= bm AS xm,
    ((((4 * o) % 1000003) * 7919) % 1000003, 4 * o) < ((((4 * nx + 1) % 1000003) * 7919) % 1000003, 4 * nx + 1) AS ff
  FROM {source} s JOIN {into}_top USING (o)),
{into}_y AS (
  SELECT o AS oo, bool_or(xf) AS any_f, bool_or(xm) AS any_m, bool_or(xf AND item = tm) AS f_on_m,
    bool_or(xm AND item = tf) AS m_on_f FROM {into}_x GROUP BY o),
{into} AS (
  SELECT o, nx, p, item, sf, sm FROM {into}_x JOIN {into}_y ON oo = o
  WHERE NOT CASE WHEN ff THEN xf OR (xm AND NOT f_on_m AND NOT (item = tf AND any_f))
                 ELSE xm OR (xf AND NOT m_on_f AND NOT (item = tm AND any_m)) END)
"""


BUBBLED = ITEMS + "".join(
    "," + _bubble_round("parts" if i == 0 else f"left{i}", f"left{i + 1}") for i in range(6)
)

COMPONENTS = """
sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
comps(nid, comp) USING KEY (nid) AS (
  SELECT nid, nid FROM nodes
  UNION
  SELECT s.dst, min(c.comp) FROM comps c JOIN sym s ON s.src = c.nid JOIN recurring.comps r ON r.nid = s.dst
  WHERE c.comp < r.comp GROUP BY s.dst)
"""
BUBBLE_EDGES = """
edges AS (
  SELECT 4 * o AS src, item AS dst FROM parts UNION ALL SELECT item, 4 * nx FROM parts
  UNION ALL SELECT item + 1, 4 * o + 1 FROM parts UNION ALL SELECT 4 * nx + 1, item + 1 FROM parts),
nodes AS (SELECT src AS nid FROM edges UNION SELECT dst FROM edges)
"""
DEGREES = """
deg AS (
  SELECT nid, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, only_dst FROM nodes
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = nid
  LEFT JOIN (SELECT src, count(*) AS n, min(dst) AS only_dst FROM edges GROUP BY src) o ON o.src = nid)
"""
CLASSES = DEGREES + """,
cls AS (
  SELECT *, CASE WHEN n_out = 1 AND n_in = 0 THEN 'tip' WHEN n_out = 1 AND n_in = 1 THEN 'mergeable'
    ELSE 'other' END AS class FROM deg)
"""
BRIDGES = ALN + """,
hits AS (
  SELECT qname, 'u' || (CAST(tname[2:] AS BIGINT) // 16) AS tname, qend - qstart AS len,
    CAST(nmatch AS DOUBLE) / CAST(qend - qstart AS DOUBLE) AS ident, line_no
  FROM aln WHERE qend - qstart >= 2000 AND CAST(nmatch AS DOUBLE) / CAST(qend - qstart AS DOUBLE) >= CAST(0.8 AS DOUBLE)),
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname, tname ORDER BY line_no) AS k FROM hits) WHERE k = 1),
support AS (
  SELECT a.tname AS from_node, b.tname AS to_node, count(*) AS support_reads, max(least(a.len, b.len)) AS edge_len,
    max(least(a.len, b.len)) AS overlap_len, max((a.ident + b.ident) / 2.0e0) AS identity
  FROM once a JOIN once b ON a.qname = b.qname AND a.tname < b.tname GROUP BY 1, 2),
strong AS (
  SELECT * FROM support WHERE support_reads >= 2 OR edge_len >= 4000
    OR (edge_len >= 2000 AND identity >= CAST(0.8 AS DOUBLE) + CAST(0.05 AS DOUBLE)))
"""
DOCS = "docs AS (SELECT doc_id AS rec_no, n_chars AS len FROM documents)"

# bytes of the UTF-8 form of each letter, less 33 each
_BYTES = """CASE WHEN unicode(c) < 128 THEN greatest(unicode(c) - 33, 0)
  WHEN unicode(c) < 2048 THEN 192 + unicode(c) // 64 + 128 + unicode(c) % 64 - 66
  WHEN unicode(c) < 65536 THEN 224 + unicode(c) // 4096 + 128 + unicode(c) // 64 % 64 + 128 + unicode(c) % 64 - 99
  ELSE 240 + unicode(c) // 262144 + 128 + unicode(c) // 4096 % 64 + 128 + unicode(c) // 64 % 64 + 128 + unicode(c) % 64 - 132 END"""
QUALITY = f"""
q AS (
  SELECT doc_id AS rec_no, 'd' || doc_id AS name, CAST(strlen(text) AS BIGINT) AS len,
    CAST(CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: {_BYTES})), 0) AS FLOAT)
      / CAST(nullif(strlen(text), 0) AS FLOAT) AS FLOAT) AS mean_q
  FROM documents)
"""


def _n50(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}," if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {lead} max(len) AS n50 FROM (
  SELECT {lead} n_chars AS len, sum(n_chars) OVER ({part} ORDER BY n_chars DESC) AS so_far,
    sum(n_chars) OVER ({part}) AS total FROM documents) WHERE so_far * 2 >= total {group}"""


_CLASS_COLS = "qname, tname, line_no, b1, e1, l1, b2, e2, l2, class"
_EDGE_COLS = "src, dst, edge_len, overlap_len, identity"
_NAMED = "SELECT a.node_id AS source, b.node_id AS sink, edge_len, overlap_len, identity FROM {} JOIN nodes a ON a.nid = src JOIN nodes b ON b.nid = dst"

_LINKS = (
    """home AS (SELECT node AS nid, min(unitig_id) AS u FROM members GROUP BY node),
ends AS (SELECT nid, u, CASE WHEN nid = first THEN '+' ELSE '-' END AS ori FROM home JOIN utgs ON unitig_id = u),
ulinks AS (
  SELECT a.u AS from_id, b.u AS to_id, a.ori AS from_ori, b.ori AS to_ori, min(edge_len) AS edge_len,
    max(overlap_len) AS overlap_len, max(identity) AS identity
  FROM edges JOIN ends a ON a.nid = src JOIN ends b ON b.nid = dst WHERE a.u <> b.u GROUP BY 1, 2, 3, 4)"""
)
_RINGS = """span AS (SELECT count(*) AS n FROM part),
have AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
rings AS (SELECT s, min(p) AS p0, max(p) AS p1, count(*) AS k FROM have GROUP BY s HAVING count(*) > 1),
turned AS (
  SELECT (s * n + p0) * 2 AS first, (s * n + p1) * 2 AS last, k FROM rings, span
  UNION ALL
  SELECT (s * n + p0) * 2 + 1, (s * n + (SELECT min(p) FROM have h WHERE h.s = rings.s AND h.p > p0)) * 2 + 1, k FROM rings, span)"""

ORACLES.update(
    read_stats=_with(QUALITY) + "SELECT rec_no, name, len, round(CAST(mean_q AS DOUBLE), 4) AS mean_q FROM q",
    read_filter=_with(QUALITY) + "SELECT rec_no, name, len FROM q WHERE len >= 1000 AND mean_q >= CAST(60 AS FLOAT)",
    longest_budget=_with(DOCS) + """SELECT rec_no, len FROM (
  SELECT *, sum(len) OVER (ORDER BY len DESC, rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM docs)
WHERE before IS NULL OR before < (SELECT sum(len) // 2 FROM docs)""",
    longest_budget_reads=_with(READS) + """SELECT id AS rec_no, name, len FROM (
  SELECT *, sum(len) OVER (ORDER BY len DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM reads)
WHERE before IS NULL OR before < (SELECT 2500 * n FROM cnt)""",
    coverage_estimate=_with(ALN) + """SELECT CAST(sum(ql) AS BIGINT) AS total_bases, CAST(sum(al) AS BIGINT) AS total_aligned,
  round(CAST(sum(al) AS DOUBLE) / CAST(sum(ql) AS DOUBLE), 4) AS coverage,
  CAST(floor(CAST(sum(ql) AS DOUBLE) / (CAST(sum(al) AS DOUBLE) / CAST(sum(ql) AS DOUBLE))) AS BIGINT) AS genome_size
FROM (SELECT arg_min(qlen, line_no) AS ql, sum(qend - qstart) AS al FROM aln GROUP BY qname)""",
    bernoulli_depth=_with(DOCS) + """SELECT rec_no, len FROM docs
WHERE CAST(rec_no * 7919 % 1000 AS DOUBLE) < least(1.0e0, CAST((SELECT sum(len) // 10 FROM docs) AS DOUBLE) * 3.5e0 / CAST((SELECT sum(len) FROM docs) AS DOUBLE)) * 1.0e3""",
    fastq_records=_with(READS, GENOME) + "SELECT id AS rec_no, name, len, md5(seq) AS seq_md5 FROM seqs",
    paf_rows=_with(ALN) + "SELECT * EXCLUDE (line_no) FROM aln",
    fastq_texts=f"""SELECT name, length(seq) AS len, md5(seq) AS seq_md5, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc_md5,
  CASE WHEN seq = '' THEN '' WHEN rec % 3 = 0 THEN '@' ELSE 'I' END AS first_qual
FROM (SELECT doc_id AS rec, 'd' || doc_id AS name,
  regexp_replace(translate(coalesce(text, ''), '{_ALPHABET}', '{_BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents)""",
    last_sequences="SELECT source AS name, md5(arg_max(text, doc_id)) AS seq_md5 FROM documents GROUP BY source",
    paf_rows_loose=_with(ALN) + """SELECT qname, qstart, qend, tname, nmatch FROM aln
UNION ALL SELECT name, 0, 0, 'x', 0 FROM reads""",
    paf_spans=_with(ALN) + "SELECT qname, qlen, qstart, qend FROM aln",
    contig_lengths="SELECT n_chars AS length, count(*) AS n_contigs FROM documents WHERE n_chars > 0 GROUP BY 1",
    n50_by_lang=_n50("lang"),
    n50_overall=_n50(""),
    largest_contig="SELECT source, max(n_chars) AS largest FROM documents GROUP BY source",
    alignment_filter=_with(ALN) + f"SELECT * FROM aln WHERE {_reason(90.0)} = 'pass'",
    filter_reasons=_with(ALN) + f"SELECT {_reason(90.0)} AS reason, count(*) AS n_rows FROM aln GROUP BY 1",
    read_lengths=_with(PASSED, SIDES) + "SELECT name, arg_min(length, line_no) AS length FROM sides GROUP BY name",
    best_per_pair=_with(PASSED, BEST) + "SELECT * FROM best",
    interval_depth=_with(PASSED, SIDES, _depth("sides"))
    + 'SELECT name, pos AS start, stop AS "end", depth FROM steps WHERE depth > 0',
    interval_depth_suppliers=_with(
        """days AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s,
  CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem)""",
        _depth("days"),
    )
    + 'SELECT name, pos AS start, stop AS "end", depth FROM steps WHERE depth > 0',
    covered_region=_with(REGIONS) + "SELECT * FROM regions",
    covered_region_users=_with(
        """mins AS (SELECT CAST(user_id AS VARCHAR) AS name, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS s,
  CAST(floor(epoch(ts)) AS BIGINT) // 60 + 1 + event_id % 500 AS e FROM events)""",
        _depth("mins"),
        _regions(1),
    )
    + """SELECT d.name, coalesce(cov_start, 0) AS cov_start, coalesce(cov_end, 0) AS cov_end, max_depth
FROM deepest d LEFT JOIN longest USING (name)""",
    max_depth=_with(
        """days AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s,
  CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem)""",
        _depth("days"),
    )
    + "SELECT name, max(depth) AS max_depth FROM steps GROUP BY name",
    overlap_class=_with(F1) + f"SELECT {_CLASS_COLS} FROM classified",
    overlap_class_coclip=_with(F1C) + f"SELECT {_CLASS_COLS} FROM classified",
    overlap_class_counts=_with(F1) + "SELECT class, count(*) AS n_pairs FROM classified GROUP BY class",
    overlap_edges=_with(F1, EDGES) + "SELECT * FROM ovl",
    contained_reads=_with(F1, EDGES) + "SELECT name FROM inside",
    kept_overlaps=_with(F1, EDGES) + "SELECT * FROM kept",
    stored_overlaps=_with(F1, EDGES) + "SELECT * FROM kept",
    reads_in_overlaps=_with(F1, EDGES)
    + "SELECT count(*) AS n_reads FROM (SELECT qname FROM kept UNION SELECT tname FROM kept)",
    bigraph_edges=_with(F1G) + _NAMED.format("edges"),
    graph_stats=_with(F1G)
    + """SELECT n_nodes, n_edges, round(CAST(n_nodes AS DOUBLE) / n_edges, 4) AS nodes_per_edge
FROM (SELECT count(*) AS n_nodes FROM nodes), (SELECT count(*) AS n_edges FROM edges)""",
    symmetry_violations=_with(SUCC, "rest AS (SELECT * FROM edges WHERE NOT (overlap_len < 300 AND src < dst))")
    + """SELECT 'edge' AS kind, src, dst FROM rest e
WHERE NOT EXISTS (SELECT 1 FROM rest m WHERE m.src = xor(e.dst, 1) AND m.dst = xor(e.src, 1))""",
    delete_nodes=_with(PARTG)
    + f"""SELECT {_EDGE_COLS} FROM edges WHERE src // 2 NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < (SELECT avg(p_retailprice) FROM part))
AND dst // 2 NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < (SELECT avg(p_retailprice) FROM part))""",
    add_bridge_edges=_with(
        PARTG.replace("edges AS", "part_edges AS").replace("FROM edges UNION SELECT dst FROM edges", "FROM part_edges UNION SELECT dst FROM part_edges").replace("nodes AS", "part_nodes AS"),
        SUCC,
    )
    + """SELECT src, dst, edge_len FROM part_edges WHERE edge_len > 30
UNION SELECT src, dst, edge_len FROM edges""",
    ranked_edges=_with(PARTG)
    + "SELECT src, dst, edge_len, row_number() OVER (PARTITION BY src ORDER BY edge_len, dst) AS edge_rank FROM edges",
    transitive_candidates=_with(PARTG)
    + """, hops AS MATERIALIZED (
  SELECT x.src AS n1, x.dst AS n2, y.dst AS n3, x.edge_len AS len12, y.edge_len AS len23
  FROM edges x JOIN edges y ON y.src = x.dst)
SELECT n1, n2, n3, len12, len23, edge_len AS len13 FROM hops JOIN edges ON src = n1 AND dst = n3""",
    transitive_reduce=_with(F1G, _transitive("edges", "slim")) + _NAMED.format("slim"),
    transitive_reduce_dense=_with(PARTG, _transitive("edges", "slim")) + f"SELECT {_EDGE_COLS} FROM slim",
    multi_edge_dedup=_with(PARTG) + f"SELECT {_EDGE_COLS} FROM edges",
    short_edge_removal=_with(PARTG, _short("edges", "rest")) + f"SELECT {_EDGE_COLS} FROM rest",
    weak_edge_removal=_with(
        PARTG,
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY identity DESC, edge_len, dst) AS k FROM edges),
weak AS (SELECT src AS s, dst AS t FROM ranked WHERE k > 1)""",
    )
    + f""", doomed AS MATERIALIZED (SELECT s, t FROM weak UNION SELECT xor(t, 1), xor(s, 1) FROM weak)
SELECT {_EDGE_COLS} FROM edges LEFT JOIN doomed ON s = src AND t = dst WHERE s IS NULL""",
    weak_edge_removal_one_sided=_with(
        PARTG,
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY identity DESC, edge_len, dst) AS k FROM edges),
weak AS (SELECT src AS s, dst AS t FROM ranked WHERE k > 1)""",
    )
    + f""", doomed AS MATERIALIZED (SELECT s, t FROM weak UNION SELECT t, s FROM weak)
SELECT {_EDGE_COLS} FROM edges LEFT JOIN doomed ON s = src AND t = dst WHERE s IS NULL""",
    degree_histogram=_with(PARTG, DEGREES)
    + """SELECT 'in' AS direction, n_in AS degree, count(*) AS n_nodes FROM deg GROUP BY n_in
UNION ALL SELECT 'out', n_out, count(*) FROM deg GROUP BY n_out""",
    compressible_fraction=_with(SUCC, DEGREES)
    + """SELECT count(*) FILTER (n_in = 1 AND n_out = 1) AS n_compressible, count(*) AS n_nodes,
  round(CAST(count(*) FILTER (n_in = 1 AND n_out = 1) AS DOUBLE) / count(*), 4) AS fraction FROM deg""",
    branching_topk=_with(PARTG, DEGREES)
    + "SELECT nid, n_in, n_out FROM deg WHERE n_in > 1 OR n_out > 1 ORDER BY n_in + n_out DESC, nid LIMIT 20",
    node_class=_with(SUCC, CLASSES) + "SELECT nid, n_in, n_out, class FROM cls",
    tip_trim=_with(
        SUCC, CLASSES,
        """gone AS (SELECT c.nid // 2 AS r FROM cls c JOIN cls d ON d.nid = c.only_dst WHERE c.class = 'tip' AND d.class <> 'mergeable')""",
    )
    + f"SELECT {_EDGE_COLS} FROM edges WHERE src // 2 NOT IN (SELECT r FROM gone) AND dst // 2 NOT IN (SELECT r FROM gone)",
    tip_trim_documented=_with(
        SUCC, CLASSES,
        """trail AS (
  SELECT nid AS tip, nid, only_dst AS nx, 1 AS k FROM cls WHERE class = 'tip'
  UNION ALL SELECT t.tip, c.nid, c.only_dst, k + 1 FROM trail t JOIN cls c ON c.nid = t.nx WHERE c.class = 'mergeable')""",
    )
    + "SELECT nid FROM trail WHERE tip IN (SELECT tip FROM trail GROUP BY tip HAVING count(*) <= 4)",
    tip_lengths=_with(
        SUCC, DEGREES,
        """stroll AS (
  SELECT nid AS start, nid, 0 AS len, false AS stop FROM deg WHERE n_in = 0
  UNION ALL
  SELECT s.start, d.nid, len + 1, d.n_in <> 1 FROM stroll s JOIN deg o ON o.nid = s.nid AND o.n_out = 1
  JOIN deg d ON d.nid = o.only_dst WHERE NOT s.stop AND len < 1000)""",
    )
    + "SELECT start AS nid, CAST(max(len) AS BIGINT) AS length FROM stroll GROUP BY start",
    components=_with(SUCC, COMPONENTS) + "SELECT nid, comp FROM comps",
    component_sizes=_with(ITEMS, BUBBLE_EDGES, COMPONENTS)
    + "SELECT comp, count(*) AS n_nodes FROM comps GROUP BY comp",
    small_component_removal=_with(
        SUCC,
        """left_edges AS (SELECT * FROM edges WHERE overlap_len > 300),
used AS (SELECT p AS x FROM cons WHERE q IS NOT NULL AND q <> p UNION SELECT q FROM cons WHERE q IS NOT NULL AND q <> p),
all_nodes AS (SELECT unnest([x * 2, x * 2 + 1]) AS nid FROM used),
alone AS (SELECT nid FROM all_nodes WHERE nid NOT IN (SELECT src FROM left_edges UNION SELECT dst FROM left_edges))""",
    )
    + "SELECT nid FROM all_nodes WHERE nid // 2 NOT IN (SELECT nid // 2 FROM alone)",
    chains=_with(SUCC, _chains("edges")) + 'SELECT nid, head, pos, off AS "offset" FROM chain',
    unitig_members=_with(SUCC, _unitigs("edges"))
    + """SELECT f.node AS first, f.next AS second, m.pos, m.node, m.edge_len, m.off AS "offset"
FROM members m JOIN members f ON f.unitig_id = m.unitig_id AND f.pos = 0""",
    circular_unitigs=_with(
        """span AS (SELECT count(*) AS n FROM part),
have AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
around AS (
  SELECT s, p, coalesce(lead(p) OVER (PARTITION BY s ORDER BY p), min(p) OVER (PARTITION BY s)) AS q FROM have),
rings AS (
  SELECT s, min(p) AS p0, count(*) AS k, CAST(sum(1 + (p * 31 + q * 17) % 60) AS BIGINT) AS len
  FROM around GROUP BY s HAVING count(*) > 1)""",
    )
    + """SELECT (s * n + p0) * 2 + o AS first, k AS n_members, len AS length, 'c' AS topology
FROM rings, span, (SELECT unnest([0, 1]) AS o)""",
    unitig_twins=_with(SUCC, _unitigs("edges"))
    + "SELECT unitig_id, first, n_members FROM utgs SEMI JOIN keepers USING (unitig_id)",
    unitig_edges=_with(
        SUCC, _unitigs("edges"),
        """home AS (SELECT node AS nid, min(unitig_id) AS u FROM members GROUP BY node),
ends AS (SELECT nid, u, CASE WHEN nid = first THEN '+' ELSE '-' END AS ori FROM home JOIN utgs ON unitig_id = u)""",
    )
    + """SELECT a.u AS from_id, b.u AS to_id, a.ori AS from_ori, b.ori AS to_ori, min(edge_len) AS edge_len,
  max(overlap_len) AS overlap_len, max(identity) AS identity
FROM edges JOIN ends a ON a.nid = src JOIN ends b ON b.nid = dst WHERE a.u <> b.u GROUP BY 1, 2, 3, 4""",
    kept_unitig_edges=_with(SUCC, _unitigs("edges"), _LINKS)
    + """SELECT * FROM ulinks WHERE from_id IN (SELECT unitig_id FROM keepers) AND to_id IN (SELECT unitig_id FROM keepers)""",
    gfa_links=_with(SUCC, _unitigs("edges"), _LINKS, _RINGS)
    + """SELECT concat_ws(chr(9), 'L', 'unitig_' || from_id || '_l', from_ori, 'unitig_' || to_id || '_l', to_ori, overlap_len || 'M') AS value
FROM ulinks
UNION ALL SELECT concat_ws(chr(9), 'L', 'unitig_' || u || '_c', o, 'unitig_' || u || '_c', o, '0M')
FROM (SELECT row_number() OVER (ORDER BY first) - 1 AS u FROM turned), (SELECT unnest(['+', '-']) AS o)""",
    unitig_topology=_with(
        SUCC, _unitigs("edges"), _RINGS,
        """tops AS (SELECT unitig_id, max(pos) AS pos FROM members GROUP BY unitig_id),
lasts AS (SELECT unitig_id, node AS last, next AS onward FROM members JOIN tops USING (unitig_id, pos))""",
    )
    + """SELECT first, last, k AS n_members, 'c' AS topology FROM turned
UNION ALL SELECT first, t.last, n_members, CASE WHEN n_members > 1 AND onward IS NOT NULL AND (onward = first OR EXISTS (
  SELECT 1 FROM edges e WHERE (e.src = first AND e.dst = onward) OR (e.dst = first AND e.src = onward))) THEN 'c' ELSE 'l' END
FROM utgs JOIN lasts t USING (unitig_id)""",
    unitig_layout=_with(F1U, LAYOUT) + "SELECT * EXCLUDE (unitig_id) FROM layout",
    assemble_unitigs=_with(F1U, LAYOUT)
    + """SELECT unitig_id, max(utg_end) AS length, any_value(topology) AS topology, any_value(n_members) AS n_members
FROM layout JOIN utgs USING (unitig_id) GROUP BY unitig_id""",
    unitig_sequence=_with(
        F1CU, LAYOUT, GENOME,
        """whole AS (
  SELECT unitig_id, string_agg(CASE WHEN ori = '+' THEN substring(seq, cov_start + 1, utg_end - utg_start)
    ELSE translate(reverse(substring(seq, cov_end - (utg_end - utg_start) + 1, utg_end - utg_start)), 'ACGT', 'TGCA') END,
    '' ORDER BY pos) AS text
  FROM layout JOIN seqs ON name = read GROUP BY unitig_id)""",
    )
    + """SELECT unitig_id, c AS chunk, substring(text, c * 10000 + 1, 10000) AS seq
FROM (SELECT unitig_id, text, unnest(range(0, (length(text) + 9999) // 10000)) AS c FROM whole)""",
    gfa_text=_with(
        F1CU, LAYOUT, GENOME,
        """whole AS (
  SELECT unitig_id, string_agg(CASE WHEN ori = '+' THEN substring(seq, cov_start + 1, utg_end - utg_start)
    ELSE translate(reverse(substring(seq, cov_end - (utg_end - utg_start) + 1, utg_end - utg_start)), 'ACGT', 'TGCA') END,
    '' ORDER BY pos) AS text
  FROM layout JOIN seqs ON name = read GROUP BY unitig_id)""",
        """sized AS (
  SELECT unitig_id, 'unitig_' || unitig_id || '_' || any_value(topology) AS u, max(utg_end) AS len
  FROM layout JOIN utgs USING (unitig_id) GROUP BY unitig_id)""",
    )
    + """SELECT 0 AS section, 0 AS a, 0 AS part, 'H' || chr(9) || 'VN:Z:1.0' AS value, false AS open
UNION ALL SELECT 1, unitig_id, -1, 'S' || chr(9) || u || chr(9), true FROM sized
UNION ALL SELECT 1, unitig_id, c, substring(text, c * 10000 + 1, 10000), true
FROM (SELECT unitig_id, text, unnest(range(0, (length(text) + 9999) // 10000)) AS c FROM whole)
UNION ALL SELECT 1, unitig_id, 4611686018427387904, '', false FROM sized
UNION ALL SELECT 4, unitig_id, 0, concat_ws(chr(9), 'a', u, utg_start, read || ':' || cov_start || '-' || cov_end, ori, utg_end), false
FROM layout JOIN sized USING (unitig_id)""",
    fasta_text=_with(
        F1CU, LAYOUT, GENOME,
        """whole AS (
  SELECT unitig_id, string_agg(CASE WHEN ori = '+' THEN substring(seq, cov_start + 1, utg_end - utg_start)
    ELSE translate(reverse(substring(seq, cov_end - (utg_end - utg_start) + 1, utg_end - utg_start)), 'ACGT', 'TGCA') END,
    '' ORDER BY pos) AS text
  FROM layout JOIN seqs ON name = read GROUP BY unitig_id)""",
    )
    + """SELECT unitig_id, -1 AS chunk, '>unitig_' || unitig_id || ' len=' || length(text) || 'bp topology=' || topology AS value
FROM whole JOIN utgs USING (unitig_id)
UNION ALL SELECT unitig_id, c, substring(text, c * 10000 + 1, 10000)
FROM (SELECT unitig_id, text, unnest(range(0, (length(text) + 9999) // 10000)) AS c FROM whole)""",
    gfa_lengths=_with(
        F1U, LAYOUT,
        """sized AS (
  SELECT unitig_id, 'unitig_' || unitig_id || '_' || any_value(topology) AS u, max(utg_end) AS len
  FROM layout JOIN utgs USING (unitig_id) GROUP BY unitig_id)""",
    )
    + """SELECT 'H' || chr(9) || 'VN:Z:1.0' AS value
UNION ALL SELECT concat_ws(chr(9), 'S', u, '*', 'LN:i:' || len) FROM sized
UNION ALL SELECT concat_ws(chr(9), 'a', u, utg_start, read || ':' || cov_start || '-' || cov_end, ori, utg_end)
FROM layout JOIN sized USING (unitig_id)""",
    dot_text=_with(F1G, DEGREES)
    + """SELECT '  "' || node_id || '" [style=filled fillcolor=' || CASE WHEN n_out = 0 THEN 'gray' WHEN n_out = 1 THEN 'black'
  WHEN n_out = 2 THEN 'blue' WHEN n_out <= 5 THEN 'orange' ELSE 'red' END || ' ];' AS value FROM nodes JOIN deg USING (nid)
UNION ALL SELECT '  "' || a.node_id || '" -> "' || b.node_id || '";' FROM edges JOIN nodes a ON a.nid = src JOIN nodes b ON b.nid = dst
UNION ALL SELECT unnest(['digraph overlaps {', '  graph [rankdir=LR, splines=true];', '  node [shape=ellipse, fontsize=10];', '}'])""",
    node_id_parse=_with(F1G)
    + 'SELECT node_id, read, cov_start AS "start", cov_end AS "end", ori, cov_start < cov_end AS valid FROM nodes',
    reverse_complement_reads=_with(READS, GENOME)
    + "SELECT name, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc_md5 FROM seqs",
    bubble_paths=_with(ITEMS, "forked AS (SELECT o FROM parts GROUP BY o HAVING count(*) > 1)")
    + """SELECT 4 * o AS u, item AS a, 4 * nx AS m, 1 AS depth, 2 AS n_reads, price AS bases, round(ident, 3) AS identity, round(sf, 3) AS score
FROM parts SEMI JOIN forked USING (o)
UNION ALL SELECT 4 * nx + 1, item + 1, 4 * o + 1, 1, 2, qty * 1000, round(ident, 3), round(sm, 3) FROM parts SEMI JOIN forked USING (o)""",
    bubble_arms=_with(
        """cnt AS (SELECT count(*) AS n FROM part),
ords AS (
  SELECT o_orderkey AS o, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx
  FROM orders),
items AS (
  SELECT l_orderkey AS o, l_partkey AS p, max(CAST(floor(l_quantity) AS BIGINT)) AS qty,
    max(CAST(floor(l_extendedprice) AS BIGINT)) AS price, min(round(100.0 - 100.0 * l_discount, 6)) AS ident
  FROM lineitem GROUP BY 1, 2),
arms AS (
  SELECT ords.o, nx, p, qty, price, CAST(ident AS DOUBLE) AS ident, ((ords.o * n + p) * 16 + 1) * 2 AS base, p % 4 + 2 AS size
  FROM items JOIN ords USING (o), cnt WHERE nx IS NOT NULL),
forked AS (SELECT o FROM arms GROUP BY o HAVING count(*) > 1),
sides AS (
  SELECT 32 * o AS u, base AS a, 32 * nx AS m, size, qty, price, ident,
    list_transform(range(size), lambda j: base + 2 * j) AS nodes,
    list_transform(range(size), lambda j: price + 17 * j) AS ov,
    list_transform(range(size), lambda j: ident - 0.5 * j) AS id
  FROM arms SEMI JOIN forked USING (o)
  UNION ALL
  SELECT 32 * nx + 1, base + 2 * (size - 1) + 1, 32 * o + 1, size, qty, price, ident,
    list_transform(range(size), lambda j: base + 2 * (size - 1 - j) + 1),
    list_transform(range(size), lambda j: CASE WHEN j = size - 1 THEN qty * 1000 ELSE price + 17 * (size - 2 - j) END),
    list_transform(range(size), lambda j: CASE WHEN j = size - 1 THEN ident ELSE ident - 0.5 * (size - 2 - j) END)
  FROM arms SEMI JOIN forked USING (o)),
scored AS (
  SELECT *, CAST(list_sum(ov) AS BIGINT) AS bases,
    list_sum(list_transform(list_zip(ov, id), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / list_sum(ov) AS identity
  FROM sides)"""
    )
    + """SELECT u, a, m, size AS depth, size + 1 AS n_reads, bases, round(identity, 3) AS identity,
  round(bases + identity * 200.0 + (size + 1) * 1.5, 3) AS score, array_to_string(list_append(nodes, m), ' ') AS path FROM scored""",
    bubble_removal=_with(BUBBLED)
    + """SELECT unnest([4 * o, 4 * o + 1]) AS nid FROM parts UNION SELECT unnest([4 * nx, 4 * nx + 1]) FROM parts
UNION SELECT unnest([item, item + 1]) FROM left6""",
    bridge_support=_with(BRIDGES) + "SELECT * EXCLUDE (identity), round(identity, 6) AS identity FROM support",
    strong_bridges=_with(BRIDGES) + "SELECT * EXCLUDE (identity), round(identity, 6) AS identity FROM strong",
    bridge_ranks=_with(BRIDGES)
    + """SELECT * EXCLUDE (identity), round(identity, 6) AS identity,
  row_number() OVER (ORDER BY support_reads DESC, edge_len DESC, from_node, to_node) - 1 AS rank FROM strong""",
    bridge_edges=_with(
        BRIDGES, PARTG,
        """ends AS (SELECT 'u' || (p_partkey // 16) AS target, max(p_partkey) * 2 AS o, min(p_partkey) * 2 AS i FROM part GROUP BY 1),
raw AS (
  SELECT a.o AS src, b.i AS dst, s.edge_len, s.overlap_len, s.identity * 1.0e2 AS identity FROM strong s
  JOIN ends a ON a.target = from_node JOIN ends b ON b.target = to_node WHERE a.o <> b.i
  AND a.o IN (SELECT nid FROM nodes) AND b.i IN (SELECT nid FROM nodes)),
twins AS (SELECT * FROM raw UNION ALL SELECT xor(dst, 1), xor(src, 1), edge_len, overlap_len, identity FROM raw)""",
    )
    + """SELECT src, dst, edge_len, overlap_len, round(identity, 4) AS identity FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY overlap_len DESC, identity DESC, edge_len) AS k FROM twins) b
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = b.src AND e.dst = b.dst)""",
)

ORACLES.update(
    simplify_metrics=_with(F1U)
    + """SELECT iteration, step, nn AS n_nodes, CASE WHEN tick < 1 THEN m0 WHEN tick < 3 THEN m1 ELSE m2 END AS n_edges,
  0 AS removed_nodes, CASE tick WHEN 1 THEN m0 - m1 WHEN 3 THEN m1 - m2 ELSE 0 END AS removed_edges
FROM (SELECT count(*) AS m0 FROM edges), (SELECT count(*) AS m1 FROM slim), (SELECT count(*) AS m2 FROM clean),
  (SELECT count(*) AS nn FROM nodes),
  (SELECT 0 AS iteration, 'start' AS step, 0 AS tick
   UNION ALL SELECT i, s, (i - 1) * 6 + k FROM (SELECT unnest([1, 2, 3]) AS i),
     (SELECT unnest(['transitive', 'multi', 'short', 'bubbles', 'components', 'tips']) AS s, unnest([1, 2, 3, 4, 5, 6]) AS k))""",
    internal_chain_cut=_with(
        SUCC, DEGREES,
        """hike AS (
  SELECT e.dst AS target, e.dst AS cur, 0 AS k FROM edges e JOIN deg d ON d.nid = e.src AND d.n_out >= 2
  UNION
  SELECT h.target, d.only_dst, k + 1 FROM hike h JOIN deg d ON d.nid = h.cur AND n_in = 1 AND n_out = 1 WHERE k < 10),
fin AS (SELECT target, max(k) AS far, arg_max(cur, k) AS last FROM hike GROUP BY target),
cut AS (SELECT target, far FROM fin JOIN deg ON nid = last WHERE far >= 1 AND n_out >= 2)""",
    )
    + "SELECT cur AS nid FROM hike JOIN cut USING (target) WHERE k < far",
    biloop_cut=_with(
        SUCC.replace("edges AS (\n  SELECT * FROM fw", "step AS (\n  SELECT * FROM fw").replace(
            "nodes AS (SELECT src AS nid FROM edges UNION SELECT dst FROM edges)",
            "nodes AS (SELECT src AS nid FROM step UNION SELECT dst FROM step)",
        ),
        """jump AS (
  SELECT a.src, b.dst, a.edge_len, abs(a.overlap_len - b.overlap_len) + 100 AS overlap_len, a.identity
  FROM step a JOIN step b ON b.src = a.dst WHERE a.src NOT IN (SELECT dst FROM step) AND a.src <> b.dst),
edges AS (
  SELECT src, dst, overlap_len FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY overlap_len DESC, identity DESC, edge_len) AS k
    FROM (SELECT * FROM step UNION ALL SELECT * FROM jump)) WHERE k = 1),
lone AS (SELECT src, min(dst) AS dst FROM edges GROUP BY src HAVING count(*) = 1),
way AS (
  SELECT src AS v, dst AS x, 1 AS k, [src, dst] AS seen FROM lone
  UNION ALL
  SELECT w.v, l.dst, k + 1, list_append(seen, l.dst) FROM way w JOIN lone l ON l.src = w.x
  WHERE k < 3 AND NOT list_contains(seen, l.dst))""",
    )
    + """SELECT DISTINCT p.src, p.dst FROM way JOIN edges n ON n.dst = v JOIN edges p ON p.src = n.src AND p.dst = x
WHERE n.overlap_len > p.overlap_len""",
)
