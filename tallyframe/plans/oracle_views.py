"""The test views of ``views.py`` written once more as DuckDB SQL (CTE bodies).

Oracle queries name the views they need; ``with_views`` prepends them in
dependency order.
"""

from __future__ import annotations

_BASE = """
  SELECT l.* REPLACE (CASE WHEN l.l_suppkey % 10 <> 0 AND l.l_partkey % 50 = 0 AND l.l_orderkey % 20 <> 0
                           THEN l.l_partkey - 1 ELSE l.l_partkey END AS l_partkey),
         s.s_nationkey,
         (l.l_suppkey % 10 = 0) AS is_control,
         CAST(CASE WHEN l.l_suppkey % 10 <> 0 AND s.s_nationkey % 11 = 2 THEN 1
                   WHEN l.l_suppkey % 10 <> 0 AND s.s_nationkey % 7 = 1 AND l.l_orderkey % 3 + 1 = 3 THEN 2
                   ELSE l.l_orderkey % 3 + 1 END AS INTEGER) AS k,
         lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') AS site,
         CAST(year(l.l_shipdate) AS VARCHAR) AS yyyy,
         CASE l.l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS biol
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""

_READS = """
  SELECT l_linenumber AS run,
         CASE WHEN is_control THEN 'Kangaroo.' || CAST(k AS VARCHAR)
              ELSE site || '_' || yyyy || '01' || biol || '.' || CAST(k AS VARCHAR) END AS sample,
         CAST(l_partkey AS VARCHAR) AS hash,
         CAST(l_quantity AS BIGINT) AS n_reads
  FROM base_rows
"""

_DIRTY = """
  SELECT DISTINCT CASE WHEN is_control THEN
           CASE WHEN l_orderkey % 6 = 3 THEN 'Ostrich' || CAST(k AS VARCHAR)
                WHEN l_orderkey % 6 = 4 THEN 'Kangaroo.4'
                ELSE 'Kangaroo.' || CAST(k AS VARCHAR) END
         ELSE
           CASE WHEN l_orderkey % 6 = 0 THEN site || '_' || yyyy || '0115' || biol || '.' || CAST(k AS VARCHAR)
                WHEN l_orderkey % 6 = 1 THEN site || '_' || yyyy || '01_' || biol || '.' || CAST(k AS VARCHAR)
                WHEN l_orderkey % 6 = 2 THEN translate(site, '0123456789', 'ABCDEFGHIJ') || yyyy || '01' || biol || '.' || CAST(k AS VARCHAR)
                ELSE site || '_' || yyyy || '01' || biol || '.' || CAST(k AS VARCHAR) END
         END AS sample
  FROM base_rows
"""

_TAXONOMY = """
  SELECT CAST(p_partkey AS VARCHAR) AS hash,
         CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE 'K' || CAST(p_size // 10 AS VARCHAR) END AS kingdom,
         CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE 'P' || CAST(p_size AS VARCHAR) END AS phylum,
         CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE p_brand END AS family,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS genus,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS species
  FROM part
"""

_TRAITS = """
  SELECT DISTINCT
         CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 <> 0 THEN p_name || ' var' ELSE p_name END AS species,
         CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 <> 0 THEN p_type || ' var' ELSE p_type END AS genus,
         CASE WHEN p_partkey % 3 <> 0 THEN p_brand || ' var' ELSE p_brand END AS family,
         'T' || CAST(p_size % 4 AS VARCHAR) AS trait_a,
         'L' || CAST(p_size % 3 AS VARCHAR) AS trait_b
  FROM part
"""

_ENV = """
  SELECT g.site, make_date(CAST(g.yyyy AS INTEGER), 1, 1) AS date, r.r_name AS area,
         g.temperature,
         CASE WHEN g.s_nationkey % 9 = 4 THEN NULL ELSE g.ph END AS ph,
         g.salinity
  FROM (SELECT s_nationkey, site, yyyy,
               avg(l_discount) * 200 AS temperature,
               8.5 - avg(l_tax) * 10 AS ph,
               avg(l_quantity) AS salinity
        FROM base_rows WHERE NOT is_control GROUP BY s_nationkey, site, yyyy) g
  JOIN nation n ON g.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
"""

_HASH_KEY = """
  SELECT CAST(doc_id AS VARCHAR) AS hash,
         'A' || translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT') AS sequence
  FROM documents
"""

_LINEAGE = """
  SELECT key, rank, name FROM (
    SELECT hash AS key, 'kingdom' AS rank, kingdom AS name, 1 AS o FROM taxonomy
    UNION ALL SELECT hash, 'phylum', phylum, 2 FROM taxonomy
    UNION ALL SELECT hash, 'family', family, 3 FROM taxonomy
    UNION ALL SELECT hash, 'genus', genus, 4 FROM taxonomy
    UNION ALL SELECT hash, 'species', species, 5 FROM taxonomy
    UNION ALL SELECT hash, 'no rank', 'cellular organisms', 6 FROM taxonomy
  ) WHERE name IS NOT NULL
"""


def _classifier(thr: float, m: int) -> str:
    return f"""
  SELECT CAST(p_partkey AS VARCHAR) AS hash,
         CASE WHEN p_partkey % {m} = 0 THEN p_brand ELSE '' END AS family,
         CASE WHEN p_partkey % {m} = 0 AND p_partkey % 4 <> 0 THEN p_name ELSE '' END AS species,
         CAST({thr} AS DOUBLE) AS threshold
  FROM part
"""


_COEF = """
  SELECT taxon, area,
         (CAST(taxon AS BIGINT) % 7 - 3) / 2.0 AS intercept,
         (CAST(taxon AS BIGINT) % 5 - 2) / 10.0 AS b_t,
         (CAST(taxon AS BIGINT) % 3 - 1) / 2.0 + length(area) / 100.0 AS b_ph
  FROM (SELECT DISTINCT r.hash AS taxon, e.area
        FROM (SELECT DISTINCT hash, split_part(sample, '_', 1) AS site FROM reads
              WHERE NOT starts_with(sample, 'Kangaroo')) r
        JOIN (SELECT DISTINCT site, area FROM env) e ON r.site = e.site)
"""

VIEWS: dict[str, tuple[str, list[str]]] = {
    "base_rows": (_BASE, []),
    "reads": (_READS, ["base_rows"]),
    "dirty_ids": (_DIRTY, ["base_rows"]),
    "taxonomy": (_TAXONOMY, []),
    "traits": (_TRAITS, []),
    "env": (_ENV, ["base_rows"]),
    "hash_key": (_HASH_KEY, []),
    "lineage": (_LINEAGE, ["taxonomy"]),
    "classifier_0": (_classifier(0.95, 2), []),
    "classifier_1": (_classifier(0.9, 3), []),
    "classifier_2": (_classifier(0.85, 5), []),
    "classifier_3": (_classifier(0.8, 7), []),
    "coef": (_COEF, ["reads", "env"]),
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` (a SELECT) with the named views and extra ``(name, body)`` CTEs."""
    parts = [f"{n} AS ({VIEWS[n][0]})" for n in _order(list(names))]
    parts += [f"{n} AS ({body})" for n, body in (ctes or [])]
    body = sql.strip()
    if body[:4].upper() == "WITH" and parts:
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
