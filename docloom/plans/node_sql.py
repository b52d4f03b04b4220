"""DuckDB SQL for the node table of ``pages``: a second parser, token by token, to check the first by.

Tags, texts and whole script and style elements are tokens; a recursive query
carries each page's stack of open elements from token to token.
"""

from __future__ import annotations

from docloom.operators.html import CLOSED_BY_OWN_KIND, VOID


def _set(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(names)) + ")"


_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&')"
_RAW = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"

#: Common table expressions up to ``nodes`` (page_id, node_id, parent_id, tag, attrs, depth, nth, children, text).
NODES = f"""WITH RECURSIVE tokens AS (
  SELECT page_id, unnest(list) AS t, generate_subscripts(list, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '{_RAW}|<[^>]*>|[^<]+') AS list FROM pages)
), kinds AS (
  SELECT page_id, i, t, CASE WHEN NOT starts_with(t, '<') THEN 'text' WHEN starts_with(t, '</') THEN 'end' WHEN regexp_full_match(t, '{_RAW}') THEN 'raw' ELSE 'start' END AS kind,
    lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM tokens
), counted AS (
  SELECT *, CAST(count(*) FILTER (kind IN ('start', 'raw')) OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS node_id FROM kinds
), walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id INT, tag VARCHAR)[]) AS stack, CAST(NULL AS INT) AS parent_id, CAST(NULL AS INT) AS depth FROM pages
  UNION ALL
  SELECT c.page_id, c.i,
    CASE c.kind WHEN 'start' THEN CASE WHEN c.tag IN {_set(VOID)} THEN b.stack ELSE list_append(b.stack, {{'id': c.node_id, 'tag': c.tag}}) END
      WHEN 'end' THEN CASE WHEN list_contains(list_transform(b.stack, lambda x: x.tag), c.tag) THEN b.stack[1:len(b.stack) - list_position(list_reverse(list_transform(b.stack, lambda x: x.tag)), c.tag)] ELSE b.stack END
      ELSE b.stack END,
    CASE WHEN c.kind <> 'end' THEN coalesce(b.stack[-1].id, -1) END, CAST(len(b.stack) AS INT)
  FROM (SELECT w.page_id, w.i, CASE WHEN k.kind = 'start' AND k.tag IN {_set(CLOSED_BY_OWN_KIND)} AND w.stack[-1].tag = k.tag THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END AS stack
        FROM walk w JOIN counted k ON k.page_id = w.page_id AND k.i = w.i + 1) b
  JOIN counted c ON c.page_id = b.page_id AND c.i = b.i + 1
), opened AS (
  SELECT c.page_id, c.node_id, w.parent_id, c.tag, w.depth, c.i,
    map(list_transform(regexp_extract_all(regexp_extract(c.t, '^<[^>]*>'), '\\s([a-zA-Z:-]+)="[^"]*"', 1), lambda x: lower(x)), regexp_extract_all(regexp_extract(c.t, '^<[^>]*>'), '\\s[a-zA-Z:-]+="([^"]*)"', 1)) AS attrs,
    CASE WHEN c.kind = 'raw' THEN regexp_replace(regexp_replace(c.t, '^<[^>]*>', ''), '</[a-zA-Z]+>$', '') END AS raw
  FROM counted c JOIN walk w USING (page_id, i) WHERE c.kind IN ('start', 'raw')
), texts AS (
  SELECT c.page_id, w.parent_id AS node_id, string_agg({_UNESCAPED.format(x='c.t')}, '' ORDER BY c.i) AS text FROM counted c JOIN walk w USING (page_id, i) WHERE c.kind = 'text' GROUP BY ALL
), nodes AS MATERIALIZED (
  SELECT o.page_id, o.node_id, o.parent_id, o.tag, o.attrs, o.depth, CAST(row_number() OVER (PARTITION BY o.page_id, o.parent_id, o.tag ORDER BY o.node_id) AS INT) AS nth,
    CAST((SELECT count(*) FROM opened c WHERE c.page_id = o.page_id AND c.parent_id = o.node_id) AS INT) AS children, coalesce(o.raw, t.text, '') AS text
  FROM opened o LEFT JOIN texts t ON t.page_id = o.page_id AND t.node_id = o.node_id
)"""
