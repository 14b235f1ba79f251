"""SQL mirrors of ``chain.py`` for the DuckDB oracle (registered as extra views)."""

from __future__ import annotations

from .oracle_views import VIEWS

POS_RE = r"Kangaroo|K\+|k\+|Ostrich"

VIEWS.update({
    "collapsed": (f"""
      SELECT run, sample, hash, CAST(sum(n_reads) AS BIGINT) AS n_reads,
             CASE WHEN regexp_matches(sample, '{POS_RE}') THEN 'Positives' ELSE 'Samples' END AS source
      FROM reads GROUP BY run, sample, hash""", ["reads"]),
    "vec": ("""
      SELECT run, hash, max(n_reads / tot) AS vector_contamination
      FROM (SELECT *, sum(n_reads) OVER (PARTITION BY run, sample) AS tot
            FROM collapsed WHERE source = 'Positives')
      GROUP BY run, hash""", ["collapsed"]),
    "step1": ("""
      SELECT run, sample, hash, n_reads FROM (
        SELECT s.run, s.sample, s.hash,
               CAST(CASE WHEN v.vector_contamination IS NOT NULL
                         THEN s.n_reads - ceil(v.vector_contamination * s.tot)
                         ELSE s.n_reads END AS BIGINT) AS n_reads
        FROM (SELECT *, sum(n_reads) OVER (PARTITION BY run, sample) AS tot
              FROM collapsed WHERE source = 'Samples') s
        LEFT JOIN vec v ON s.run = v.run AND s.hash = v.hash)
      WHERE n_reads > 0""", ["collapsed", "vec"]),
    "low_reads": ("""
      SELECT sample, tot FROM (SELECT sample, CAST(sum(n_reads) AS BIGINT) AS tot FROM step1 GROUP BY sample) t
      WHERE tot < (SELECT avg(tot) + (-1.4395314709384557) * stddev_pop(tot)
                   FROM (SELECT sum(n_reads) AS tot FROM step1 GROUP BY sample))
        AND tot < (SELECT avg(tot) FROM (SELECT sum(n_reads) AS tot FROM step1 GROUP BY sample))""", ["step1"]),
    "step2": ("""
      SELECT * FROM step1 WHERE sample NOT IN (SELECT sample FROM low_reads)""", ["step1", "low_reads"]),
    "origin_stats": ("""
      WITH x AS (SELECT *, n_reads / sum(n_reads) OVER (PARTITION BY sample) AS prop
                 FROM collapsed WHERE hash IN (SELECT hash FROM collapsed WHERE source = 'Positives')),
      st AS (SELECT hash,
        max(CASE WHEN source='Positives' THEN prop END) AS max_p, max(CASE WHEN source='Samples' THEN prop END) AS max_s,
        avg(CASE WHEN source='Positives' THEN prop END) AS mean_p, avg(CASE WHEN source='Samples' THEN prop END) AS mean_s,
        CAST(sum(CASE WHEN source='Positives' THEN n_reads END) AS DOUBLE) AS tot_p,
        CAST(sum(CASE WHEN source='Samples' THEN n_reads END) AS DOUBLE) AS tot_s
        FROM x GROUP BY hash),
      lg AS (SELECT hash, 'max' AS stat, coalesce(max_p, 0.0) AS positives, coalesce(max_s, 0.0) AS samples FROM st
             UNION ALL SELECT hash, 'mean', coalesce(mean_p, 0.0), coalesce(mean_s, 0.0) FROM st
             UNION ALL SELECT hash, 'tot', coalesce(tot_p, 0.0), coalesce(tot_s, 0.0) FROM st),
      o AS (SELECT *, CASE WHEN positives > samples THEN 'Positive.control' ELSE 'Environment' END AS origin FROM lg)
      SELECT *, CAST(count(DISTINCT origin) OVER (PARTITION BY hash) AS INTEGER) AS n_origins FROM o""", ["collapsed"]),
    "unanimous": ("""
      SELECT hash FROM origin_stats GROUP BY hash
      HAVING count(DISTINCT origin) = 1 AND min(origin) = 'Positive.control'""", ["origin_stats"]),
    "fate": ("""
      SELECT coalesce(o.hash, u.hash) AS hash, o.positives, o.samples,
             coalesce(o.hash IS NOT NULL, false) AS by_occurrence, u.hash IS NOT NULL AS by_stats
      FROM (SELECT hash, CAST(count_if(source = 'Positives') AS BIGINT) AS positives, CAST(count_if(source = 'Samples') AS BIGINT) AS samples
            FROM collapsed GROUP BY hash HAVING count_if(source = 'Positives') >= count_if(source = 'Samples')) o
      FULL JOIN unanimous u ON o.hash = u.hash""", ["collapsed", "unanimous"]),
    "step3": ("""
      SELECT * FROM step2 WHERE hash NOT IN (SELECT hash FROM fate)""", ["step2", "fate"]),
})

VIEWS.update({
    "singles": ("""
      SELECT sample FROM (SELECT DISTINCT sample FROM step3)
      WHERE split_part(sample, '.', 1) IN (
        SELECT b FROM (SELECT DISTINCT sample, split_part(sample, '.', 1) AS b FROM step3)
        GROUP BY b HAVING count(*) = 1)""", ["step3"]),
    "step3b": ("SELECT * FROM step3 WHERE sample NOT IN (SELECT sample FROM singles)", ["step3", "singles"]),
    "norm": ("""
      SELECT sample, hash, sum(p / mx) AS value, split_part(sample, '.', 1) AS bottle FROM (
        SELECT sample, hash, p, max(p) OVER (PARTITION BY hash) AS mx FROM (
          SELECT sample, hash, n_reads / sum(n_reads) OVER (PARTITION BY sample) AS p FROM step3b))
      GROUP BY sample, hash""", ["step3b"]),
    "bpairs": ("""
      SELECT ta.bottle, ta.sample AS a, tb.sample AS b,
             1.0 - 2.0 * coalesce(s.S, 0.0) / (ta.t + tb.t) AS bray
      FROM (SELECT bottle, sample, sum(value) AS t FROM norm WHERE value > 0 GROUP BY bottle, sample) ta
      JOIN (SELECT bottle, sample, sum(value) AS t FROM norm WHERE value > 0 GROUP BY bottle, sample) tb
        ON ta.bottle = tb.bottle AND ta.sample < tb.sample
      LEFT JOIN (SELECT l.bottle, l.sample AS a, r.sample AS b, sum(least(l.value, r.value)) AS S
                 FROM norm l JOIN norm r ON l.bottle = r.bottle AND l.hash = r.hash AND l.sample < r.sample
                 WHERE l.value > 0 AND r.value > 0 GROUP BY l.bottle, l.sample, r.sample) s
        ON s.bottle = ta.bottle AND s.a = ta.sample AND s.b = tb.sample""", ["norm"]),
    "centroid": ("""
      WITH m AS (SELECT DISTINCT bottle, sample FROM norm),
      n AS (SELECT bottle, count(*) AS n FROM m GROUP BY bottle),
      r AS (SELECT bottle, i, sum(d * d) AS r FROM (SELECT bottle, a AS i, bray AS d FROM bpairs
                                                   UNION ALL SELECT bottle, b, bray FROM bpairs) GROUP BY bottle, i),
      t AS (SELECT bottle, 2 * sum(bray * bray) AS t FROM bpairs GROUP BY bottle)
      SELECT m.bottle, m.sample,
             sqrt(abs(coalesce(r.r, 0.0) / n.n - 0.5 * coalesce(t.t, 0.0) / (n.n * n.n))) AS distance
      FROM m JOIN n USING (bottle) LEFT JOIN r ON r.bottle = m.bottle AND r.i = m.sample
      LEFT JOIN t ON t.bottle = m.bottle""", ["norm", "bpairs"]),
    "discarded": ("""
      SELECT sample, distance AS distance_to_centroid FROM centroid
      WHERE distance > (SELECT avg(distance) + 1.6448536269514715 * stddev_pop(distance) FROM centroid)
      UNION ALL SELECT sample, CAST(NULL AS DOUBLE) FROM singles""", ["centroid", "singles"]),
    "step4": ("SELECT * FROM step3 WHERE sample NOT IN (SELECT sample FROM discarded)", ["step3", "discarded"]),
})
