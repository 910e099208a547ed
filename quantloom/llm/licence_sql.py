"""DuckDB SQL of the licence scan, by another way: runs of line pieces are joined with the known sentences."""

from __future__ import annotations

from .licences import ALONE, RULES, SENTENCES, longer


def _words(sentence: str) -> str:
    """The sentence as the SQL's normalised text has it."""
    low = sentence.lower().replace("(c)", "c").replace("v. ", "v ")
    return " ".join("".join(c if c.isalnum() or c in "<*>" else " " for c in low).split())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL of ``licences.scan`` over documents."""
    fixed = {_words(s): n for n, s in SENTENCES if "<" not in s}
    free = [(n, _words(s).replace(" <year>", " (19|20)[0-9][0-9]").replace("<*> ", "(.* )?").replace(" <*>", "( .*)?")) for n, s in SENTENCES if "<" in s]
    values = ", ".join(f"({_quoted(n)}, {_quoted(s)})" for s, n in fixed.items())
    slots = "".join(f"WHEN regexp_full_match(s, {_quoted(p)}) THEN {_quoted(n)} " for n, p in free)
    line = lambda seq: _quoted("% " + " % ".join(seq) + " %")
    spaced = "line LIKE {0}"
    case = "".join(f"WHEN {spaced.format(line(seq))} THEN '{name}' " if seq else f"ELSE '{name}' " for name, seq in RULES)


    def without(seq: tuple[str, ...], name: str) -> str:
        """The line, one space between identifiers, without the sentences that longer rules use."""
        out = "' ' || array_to_string(ids, ' ') || ' '"
        for own in longer(seq, name):
            out = f"regexp_replace({out}, {_quoted(' ' + ' (.*? )??'.join(own) + ' ')}, {_quoted(' ' + ''.join(f'{chr(92)}{i}' for i in range(1, len(own))))}, 'g')"
        return f"replace({out}, ' ', '  ')"

    held = lambda alone: ", ".join(f"CASE WHEN {without(seq, name)} LIKE {line(seq)} THEN '{name}' END" for name, seq in RULES if seq and (name in ALONE) == alone)
    name = "[A-Za-z0-9][A-Za-z0-9.+-]*"
    tag = rf"(?:SPDX|spdx)-[Ll]icense-[Ii]dentifier:[ \t]*(\(*{name}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{name}\)*)*)"
    steps = (
        (r"([^ \t\n])[ \t]+[-|\x{2012}-\x{2015}][ \t]+([^ \t\n])", r"\1 ; \2"), (r"([^ \t\n])[ \t]+[(<]", r"\1 ; "),
        (r"[/|\x{A0}\x{AB}\x{BB}\x{2010}-\x{2027}]", " "),
        (r"\x{A9}", " c "), (r"\r\n?", "\n"), (r"(^|[^0-9a-z])v\.[ \n]", r"\1v "),
        (r"(^|[\n:;])([\x00-\x09\x0B-\x2F\x3C-\x60\x7B-\x7F]*)([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)][ \t]", r"\1\2 \3 ; "),
        (r"[.!?]+[\x22\x27)\]*]*([\t\n\v\f\r ]|$)", r" | \1"), (r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B\x7D-\x7F]*\n)+", " | "),
        (r"[\n:;]", " / "), (r"[\x00-\x2E\x3A-\x60\x7B\x7D-\x7F]+", " "),
    )
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, by in steps:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by) if by != chr(10) else 'chr(10)'}, 'g')"
    return f"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS raw, string_split({text}, '|') AS s FROM documents),
q AS (SELECT doc_id, pos, [trim(x) for x in string_split(s, '/') if trim(x) <> ''] AS pieces FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM n)),
a AS (SELECT doc_id, pos, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM q),
r AS (SELECT doc_id, pos, pieces, i, unnest(range(i, least(len(pieces), i + 120) + 1)) AS j FROM a),
t AS (SELECT doc_id, pos, i, j, array_to_string(pieces[i:j], ' ') AS s FROM r),
k(n, s) AS (VALUES {values}),
m AS (SELECT doc_id, pos, i, j, n IS NULL AS open, coalesce(n, CASE {slots}END) AS id FROM t LEFT JOIN k USING (s)),
e AS (SELECT doc_id, pos, i, id, CASE WHEN open THEN min(j) ELSE max(j) END AS j FROM m WHERE id IS NOT NULL GROUP BY doc_id, pos, i, id, open),
l AS (SELECT doc_id, pos, i, max(j) AS j, arg_max(id, j) AS id FROM e GROUP BY doc_id, pos, i),
o AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l AS e WHERE e.doc_id = l.doc_id AND e.pos = l.pos AND e.i < l.i AND l.i <= e.j)),
ids AS (SELECT doc_id, list(id ORDER BY pos, i) AS ids FROM o GROUP BY doc_id),
g AS (SELECT doc_id, coalesce(ids, []) AS ids, [x for x in flatten([regexp_extract_all(y, '{name}') for y in regexp_extract_all(raw, {_quoted(tag)}, 1)]) if x NOT IN ('AND', 'OR', 'WITH')] AS tags FROM n LEFT JOIN ids USING (doc_id)),
w AS (SELECT *, '  ' || array_to_string(ids, '  ') || '  ' AS line, list_concat(tags, [x for x in [{held(False)}] if x IS NOT NULL]) AS named FROM g)
SELECT doc_id, CASE WHEN len(tags) > 0 THEN tags[1] WHEN len(ids) = 0 THEN NULL {case}END AS licence,
  array_to_string(list_sort(list_distinct(CASE WHEN len(named) > 0 THEN named ELSE [x for x in [{held(True)}] if x IS NOT NULL] END)), ',') AS licences, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids FROM w"""
