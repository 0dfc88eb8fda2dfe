"""The results of queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, license_scan

def escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*(?:{chat.REST}))', '\1\\\2', 'g')"


OP4_CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.TRAINED_ROLE}'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.TRAINED_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length({escaped("text")}) + CASE WHEN opens THEN {len(chat.START)} + length({escaped("role")}) + {len(chat.SEP)} ELSE {len(chat.TURN)} END + CASE WHEN closes THEN {len(chat.END)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""


def _sections(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: string_split(s, chr(10)))"


def _leaves(sections: str) -> str:
    return rf"list_transform({sections}, lambda s: list_transform(s, lambda p: list_transform(regexp_extract_all(p, '[ \t\x0b\f\r]*(?:[^ \t\x0b\f\r]{{1,32}}[ \t\x0b\f\r]*){{1,4}}|[ \t\x0b\f\r]+'), lambda x: sha256(x))))"


def _root(leaves: str) -> str:
    return f"sha256('r' || array_to_string(list_transform({leaves}, lambda s: sha256('s' || array_to_string(list_transform(s, lambda p: sha256('p' || array_to_string(p, ''))), ''))), ''))"


def _near(a: str, b: str) -> str:
    return f"CAST(2 * (len(list_intersect({a}leaves, {b}leaves)) + CASE WHEN {a}root = {b}root THEN 1 ELSE 0 END) AS DOUBLE) / (len({a}leaves) + len({b}leaves) + 2)"


def _lacking(x: str, y: str) -> str:
    """Places in x, from 0, of what y lacks."""
    return f"list_filter(range(len({x})), lambda i: NOT list_contains({y}, {x}[i + 1]))"


def _between(x: str) -> str:
    return f"range(front, len({x}) - least(back, least(len(a), len(b)) - front))"


def _common(x: str, y: str) -> str:
    """How many first elements two lists share."""
    return f"coalesce(list_filter(range(least(len({x}), len({y}))), lambda i: {x}[i + 1] <> {y}[i + 1])[1], least(len({x}), len({y})))"


def _opened(x: str, places: str) -> str:
    return f"flatten(list_transform({places}, lambda i: list_transform(range(len({x}[i + 1])), lambda j: {{'s': i, 'p': j, 't': {x}[i + 1][j + 1]}})))"


OP6_MERKLE = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)),
texts AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM following),
cut AS (SELECT *, {_sections("text")} AS a, {_sections("edited")} AS b, {_sections("next_text")} AS c FROM texts),
trees AS (SELECT *, {_leaves("a")} AS a_tree, {_leaves("b")} AS b_tree, {_leaves("c")} AS c_tree FROM cut),
roots AS (SELECT *, {_root("a_tree")} AS a_root, {_root("b_tree")} AS b_root, {_root("c_tree")} AS c_root, list_distinct(flatten(flatten(a_tree))) AS a_leaves, list_distinct(flatten(flatten(b_tree))) AS b_leaves, list_distinct(flatten(flatten(c_tree))) AS c_leaves,
  {_lacking("a", "b")} AS a_new, {_lacking("b", "a")} AS b_new, {_common("a", "b")} AS front, {_common("list_reverse(a)", "list_reverse(b)")} AS back FROM trees),
opened AS (SELECT *, CASE WHEN len(a_new) + len(b_new) = 0 THEN {_opened("a", _between("a"))} ELSE {_opened("a", "a_new")} END AS a_open, CASE WHEN len(a_new) + len(b_new) = 0 THEN {_opened("b", _between("b"))} ELSE {_opened("b", "b_new")} END AS b_open FROM roots),
texts_of AS (SELECT *, list_transform(a_open, lambda x: x.t) AS a_texts, list_transform(b_open, lambda x: x.t) AS b_texts FROM opened),
fresh AS (SELECT *, {_lacking("a_texts", "b_texts")} AS a_fresh, {_lacking("b_texts", "a_texts")} AS b_fresh FROM texts_of),
changed AS (SELECT *, CASE WHEN len(a_fresh) + len(b_fresh) = 0 THEN len(a_open) ELSE len(a_fresh) END AS removed, CASE WHEN len(a_fresh) + len(b_fresh) = 0 THEN len(b_open) ELSE len(b_fresh) END AS added, CASE WHEN len(a_fresh) + len(b_fresh) = 0 THEN b_open[1] ELSE b_open[b_fresh[1] + 1] END AS first FROM fresh)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a_root AS fingerprint, b_root AS edited_fingerprint, {_near("a_", "b_")} AS near_edited, {_near("a_", "c_")} AS near_next,
  CAST(removed AS BIGINT) AS n_removed_paragraphs, CAST(added AS BIGINT) AS n_added_paragraphs, first.s AS first_added_section, first.p AS first_added_paragraph FROM changed"""


def _pairs() -> str:
    rows = []
    for number, (text, label, base) in enumerate([*((t, x, True) for t, x in license_scan.PHRASES), *((t, x, False) for t, x in license_scan.TEMPLATES)]):
        words = text.split()
        rows += [f"({number}, '{label}', {str(base).lower()}, {len(words) - 1}, {at}, '{a} {b}')" for at, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return ", ".join(rows)


_APART = license_scan.APART
OP10_LICENSES = rf"""WITH templates AS (SELECT * FROM (VALUES {_pairs()}) t(template, label, base, pairs, place, pair)),
docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
pairs AS (SELECT r, i - 1 AS place, words[i] || ' ' || words[i + 1] AS pair FROM (SELECT r, words, unnest(range(1, len(words))) AS i FROM docs)),
votes AS (SELECT p.r, p.place, t.template, t.label, t.base, t.pairs, t.place AS spot, p.place - t.place AS diagonal FROM pairs p JOIN templates t USING (pair)),
diagonals AS (SELECT r, template, label, base, pairs, diagonal, count(*) AS votes, min(place) AS lo, max(place) AS hi, min(spot) AS from_at, max(spot) AS to_at FROM votes GROUP BY ALL HAVING base OR count(*) >= least({license_scan.LEAST_VOTES}, pairs)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY lo, diagonal) AS span FROM (SELECT *, CASE WHEN base OR abs(diagonal - lag(diagonal) OVER w) > {_APART} OR lo > lag(hi) OVER w + {1 + _APART} OR lag(lo) OVER w IS NULL THEN 1 ELSE 0 END AS apart FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY lo, diagonal))),
merged AS (SELECT r, template, label, base, pairs, span, sum(votes) AS votes, min(lo) AS lo, max(hi) AS hi, min(from_at) AS from_at, max(to_at) AS to_at FROM numbered GROUP BY ALL),
verified AS (SELECT *, least(CAST(votes AS DOUBLE) / pairs, 1.0) AS cover FROM merged WHERE CASE WHEN base THEN votes = pairs ELSE least(CAST(votes AS DOUBLE) / pairs, 1.0) >= {license_scan.LEAST_COVER} AND abs((hi - lo) - (to_at - from_at)) <= {2 * _APART} END)
SELECT doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(lo) FILTER (base) AS BIGINT) AS first_word, CAST(max(lo) FILTER (base) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label IS NOT NULL), '') AS labels, coalesce(max(cover), 0.0) AS score, count(label) AS n_spans FROM docs LEFT JOIN verified USING (r) GROUP BY r, doc_id"""
