"""DuckDB expressions for the key policies, used only in oracle texts."""

from ..functions.text import SPACE_RANGES as SPACE_CHARS

SPACES = f"[{SPACE_CHARS}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACES}', ' ', 'g'))"


def comma_chunks(source: str) -> str:
    """CTEs ending in c (doc_id, chunk_index, chunk): the pieces of `source` (doc_id, text) between commas that
    stand outside brackets and not between two digits, character by character."""
    return f"""
ch AS (SELECT doc_id, unnest(p) AS ch, generate_subscripts(p, 1) AS i
       FROM (SELECT doc_id, list_append(string_split(text, ''), '') AS p FROM {source})),
sums AS (SELECT *, sum(CASE WHEN ch IN ('(', '[') THEN 1 WHEN ch IN (')', ']') THEN -1 ELSE 0 END) OVER w AS s,
           coalesce(lag(ch) OVER w, '') AS a, coalesce(lead(ch) OVER w, '') AS z
         FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cuts AS (SELECT *, ch = ',' AND s = least(0, min(s) OVER w)
           AND NOT (regexp_matches(a, '^[0-9]$') AND regexp_matches(z, '^[0-9]$')) AS cut
         FROM sums WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, (sum(cut::INT) OVER w - cut::INT)::INT AS chunk_index FROM cuts
             WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, chunk_index, coalesce(string_agg(ch, '' ORDER BY i) FILTER (WHERE NOT cut), '') AS chunk
      FROM numbered GROUP BY ALL)"""


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{SPACES}', '', 'g')"


def registry_key(x: str) -> str:
    return f"translate({squeeze(f'lower({clean(x)})')}, '‐–—·ㆍ,./', '---')"


def retrieval_key(x: str) -> str:
    return f"regexp_replace(lower({clean(x)}), '[{SPACE_CHARS}\\-/·,()]+', '', 'g')"


def item_key(x: str) -> str:
    return squeeze(f"lower({x})")


def fold(x: str) -> str:
    """NFKC + case fold of text that is NFKC already and whose only special letter is sharp s."""
    return f"replace(lower({x}), 'ß', 'ss')"


def dictionary_key(x: str) -> str:
    return squeeze(fold(x))


def rule_key(x: str) -> str:
    bare = f"regexp_replace({fold(f'coalesce({x}, {chr(39)*2})')}, '\\([^)]*\\)', '', 'g')"
    return f"regexp_replace({bare}, '[{SPACE_CHARS}_\\-./]+', '', 'g')"
