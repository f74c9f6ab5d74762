"""SQL that finds optimal matchings by trying all of them, one ground truth after another: the twin of the assignment kernel."""

from __future__ import annotations


def best_matching(pairs: str, by: str, weight: str = "w") -> str:
    """CTEs that end in ``best`` (by..., g, d, weight): of the rows ``pairs`` (by..., g, d, weight over 0) the heaviest one-to-one matching per ``by``.

    A state is the set of detections that are used; of equal sets the heaviest is kept, so a group of few boxes has few states.
    """
    own = ", ".join(f"f.{c.strip()}" for c in by.split(","))
    return f"""
bg AS (SELECT {by}, g, row_number() OVER (PARTITION BY {by} ORDER BY g) AS k, list({{'d': d, 'w': {weight}}} ORDER BY d) AS c FROM {pairs} GROUP BY {by}, g),
bl AS (SELECT {by}, max(k) AS top FROM bg GROUP BY {by}),
f AS (
  SELECT {by}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(0 AS DOUBLE) AS total, CAST([] AS STRUCT(g BIGINT, d BIGINT, w DOUBLE)[]) AS found FROM bl
  UNION ALL
  SELECT {by}, k, used, max(total) AS total, arg_max(found, total) AS found FROM (
    SELECT {own}, bg.k, CASE WHEN x IS NULL THEN used ELSE list_sort(list_append(used, x.d)) END AS used, total + CASE WHEN x IS NULL THEN 0 ELSE x.w END AS total,
      CASE WHEN x IS NULL THEN found ELSE list_append(found, {{'g': bg.g, 'd': x.d, 'w': x.w}}) END AS found
    FROM (SELECT f.*, unnest(generate_series(0, len(c))) AS i, c, bg.k AS next, bg.g AS ng FROM f JOIN bg USING ({by}) WHERE bg.k = f.k + 1) f
    JOIN bg USING ({by}), LATERAL (SELECT CASE WHEN i = 0 THEN NULL ELSE f.c[i] END AS x) WHERE bg.k = f.next AND (x IS NULL OR NOT list_contains(used, x.d)))
  GROUP BY ALL),
best AS (SELECT {by}, unnest(found, recursive := true) FROM (SELECT {by}, arg_max(found, total) AS found FROM f JOIN bl USING ({by}) WHERE f.k = bl.top GROUP BY {by}))
"""
