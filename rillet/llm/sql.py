"""SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

SQL = {
    "op3_exact_dedup": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
