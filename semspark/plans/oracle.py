"""Pieces of SQL that the oracles are put together from.

``with_(final)`` puts the common table expressions that ``final`` needs, directly
or by way of others, before it.  They are materialised: several are read more than
once, and a join of texts and buckets must not be reordered to one of buckets alone.
"""

from __future__ import annotations

import re

from semspark.sources import catalogue

# The white space of the text functions, as this dialect spells it.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({trim(x)}, '{SPACE}+'), lambda w_: w_ <> '')"


def strip(x: str) -> str:
    return trim(f"replace(regexp_replace({x}, '```[A-Za-z]*\\n?', '', 'g'), '```', '')")


def normal(x: str) -> str:
    out = trim(x)
    for pattern, flags in ((f"^```[A-Za-z]*{SPACE}*", ""), ("```$", ""), (rf"^{SPACE}*(?:[-*]|\d+[).\]:-]){SPACE}*", ""), (rf"^candidate{SPACE}*\d*{SPACE}*[:.-]{SPACE}*", "i"), ("""^["''`]+|["''`]+$""", "g"), ("^<|>$", "g")):
        out = f"regexp_replace({out}, '{pattern}', '', '{flags}')" if flags else f"regexp_replace({out}, '{pattern}', '')"
    return trim(out)


def parsed(x: str, k: int | str | None = None) -> str:
    """The candidates of a completion: all, or the first ``k``."""
    lines = rf"string_split_regex({strip(x)}, '\r?\n')"
    every = f"list_filter(list_transform({lines}, lambda l_: {normal('l_')}), lambda c_: c_ <> '')"
    return every if k is None else f"list_slice({every}, 1, {k})"


def draw(*parts: str, seed: int = 42) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({joined}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def upper(x: str) -> str:
    return f"translate({x}, '{LOWER}', '{UPPER}')"


def joined(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda p_: p_ IS NOT NULL), ' ')"


def base(candidate: str, copies: str, current: str, target: str | None) -> str:
    n = f"len({words(candidate)})"
    aim = f"WHEN coalesce({target}, '') <> '' AND lower({candidate}) = lower({target}) THEN 'literal_copy_target'" if target else ""
    return f"CASE WHEN {n} < 2 OR {n} > 8 THEN 'invalid_length' WHEN lower({candidate}) = lower({current}) THEN 'literal_copy_current' {aim} WHEN {copies} > 1 THEN 'duplicate_output' ELSE 'valid' END"


def influence(reason: str, sim: str, gain: str) -> str:
    return f"CASE WHEN {reason} <> 'valid' THEN {reason} WHEN {sim} >= 0.94 THEN 'semantic_copy_target' WHEN {gain} > 0 THEN 'valid' ELSE 'insufficient_semantic_progress' END"


def turbulence(reason: str, sim: str) -> str:
    return f"CASE WHEN {reason} <> 'valid' THEN {reason} WHEN {sim} < 0.55 THEN 'too_distant_from_current' WHEN {sim} > 0.9 THEN 'too_close_to_current' ELSE 'valid' END"


def buckets(source: str) -> str:
    """(t, bucket, n) of the texts ``t`` in ``source``."""
    return f"SELECT t, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 384)::INTEGER AS bucket, count(*) AS n FROM (SELECT t, unnest({words('lower(t)')}) AS w FROM {source}) GROUP BY ALL"


def similar(name: str, pairs: str) -> dict[str, str]:
    """CTEs that end in ``name`` (a, b, sim): cosines, to nine decimals, of the distinct pairs (a, b) in ``pairs``."""
    return {
        f"{name}_p": f"SELECT DISTINCT a, b FROM {pairs}",
        f"{name}_t": f"SELECT a AS t FROM {name}_p UNION SELECT b FROM {name}_p",
        f"{name}_b": buckets(f"{name}_t"),
        f"{name}_n": f"SELECT t, sqrt(sum(n * n)::DOUBLE) AS len FROM {name}_b GROUP BY t",
        f"{name}_x": f"SELECT p.a, p.b, x.bucket, x.n FROM {name}_p p JOIN {name}_b x ON x.t = p.a",
        f"{name}_d": f"SELECT x.a, x.b, sum(x.n * y.n)::DOUBLE AS d FROM {name}_x x JOIN {name}_b y ON y.t = x.b AND y.bucket = x.bucket GROUP BY x.a, x.b",
        name: f"SELECT p.a, p.b, round(least(1.0, greatest(-1.0, coalesce(d, 0.0) / (x.len * y.len))), 9) AS sim FROM {name}_p p LEFT JOIN {name}_d USING (a, b) JOIN {name}_n x ON x.t = p.a JOIN {name}_n y ON y.t = p.b",
    }


def _influence_lines(c: str, t: str, doc: str) -> list[str]:
    first = joined(f"{t}[1]", *(f"{c}[{i}]" for i in (2, 3, 4, 5)))
    two = joined(f"{t}[1]", f"{t}[2]", *(f"{c}[{i}]" for i in (3, 4, 5)))
    four = joined(*(f"{t}[{i}]" for i in (1, 2, 3, 4)), f"{c}[5]")
    back = lambda x: f"array_to_string(list_reverse({x}), ' ')"
    return [first, two, four, back(t), back(c), upper(f"array_to_string({c}, ' ')"), f"array_to_string({t}, ' ')", f"{t}[1]", f"CASE WHEN {doc} % 2 = 0 THEN {upper(first)} END"]


def _turbulence_lines(c: str, o: str, doc: str) -> list[str]:
    first = joined(f"{o}[1]", *(f"{c}[{i}]" for i in (2, 3, 4, 5)))
    two = joined(f"{o}[1]", f"{o}[2]", *(f"{c}[{i}]" for i in (3, 4, 5)))
    three = joined(f"{o}[1]", f"{o}[2]", f"{o}[3]", f"{c}[4]", f"{c}[5]")
    return [first, two, three, f"array_to_string(list_reverse({c}), ' ')", upper(f"array_to_string({c}, ' ')"), f"{c}[1]", f"CASE WHEN {doc} % 2 = 0 THEN {upper(first)} END"]


def answer(operator: str, current: str, other: str, doc: str) -> str:
    """The fixture's answer: ``other`` is the target, or the component that follows."""
    c, o = words(current), words(other)
    lines = _influence_lines("cw", "ow", doc) if operator == "influence" else _turbulence_lines("cw", "ow", doc)
    shown = []
    for j, line in enumerate(lines, 1):
        form = (f"'{j}) <' || ({line}) || '>'", f"""'- "' || ({line}) || '"'""", f"'Candidate {j}: ' || ({line})")[(j - 1) % 3]
        shown.append(form)
    body = f"array_to_string(list_filter([{', '.join(shown)}], lambda s_: s_ IS NOT NULL), chr(10))"
    body = f"CASE WHEN {doc} % 10 = 9 THEN '' WHEN {doc} % 5 = 0 THEN '```text' || chr(10) || {body} || chr(10) || '```' ELSE {body} END"
    return f"(SELECT {body} FROM (SELECT {c} AS cw, {o} AS ow))"


KEYS = {1: "rol", 2: "topico", 3: "accion"}
NAMES = {k: n for _, k, n, _ in catalogue.COMPONENTS}


def _own(prefix: str) -> str:
    return "CASE k.key " + " ".join(f"WHEN '{k}' THEN {prefix}{k}" for k in KEYS.values()) + " END"


def others(key: str, prefix: str = "") -> str:
    said = {k: f"'{NAMES[k]} = ' || {prefix}{k}" for k in KEYS.values()}
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + " || '; ' || ".join(v for x, v in said.items() if x != k) for k in KEYS.values()) + " END"


CTES: dict[str, str] = {
    "runs": "SELECT conv_id AS job_id, turn + 1 AS run_number, text AS raw FROM conversations WHERE role = 'assistant'",
    "run_lists": f"SELECT job_id, run_number, {parsed('raw')} AS cs FROM runs",
    "run_candidates": "SELECT job_id, run_number, i AS ordinal, cs[i] AS candidate, cs, len(list_filter(cs, lambda c_: lower(c_) = lower(cs[i]))) AS copies FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM run_lists)",
    "vector_pairs": "SELECT a.vec_id // 2 AS pair_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0",
    "anchors": "SELECT label, min(vec_id) AS anchor_id FROM embeddings GROUP BY label",
    "anchored": "SELECT e.vec_id, e.label, a.anchor_id, round(least(1.0, greatest(-1.0, list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]))))), 6) AS similarity FROM embeddings e JOIN anchors a USING (label) JOIN embeddings x ON x.vec_id = a.anchor_id",
    "doc_words": f"SELECT doc_id, lang, {words('text')} AS w FROM documents",
    "doc_parts": "SELECT doc_id, lang, part, len(w) AS n, row_number() OVER (ORDER BY doc_id, part) - 1 AS position, array_to_string(w[15 * part + 1:15 * part + 5], ' ') AS rol, array_to_string(w[15 * part + 6:15 * part + 10], ' ') AS topico, array_to_string(w[15 * part + 11:15 * part + 15], ' ') AS accion FROM (SELECT *, unnest(range(greatest(1, ceil(len(w) / 15))::BIGINT)) AS part FROM doc_words)",
    "leaders": "SELECT lang, arg_min(rol, doc_id) AS l_rol, arg_min(topico, doc_id) AS l_topico, arg_min(accion, doc_id) AS l_accion FROM doc_parts WHERE part = 0 AND n >= 15 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
    "individuals": "SELECT a.position, a.doc_id, a.part, 'ind-' || a.doc_id || '-' || a.part AS id, a.rol, a.topico, a.accion, b.rol AS p_rol, b.topico AS p_topico, b.accion AS p_accion, l_rol, l_topico, l_accion FROM doc_parts a LEFT JOIN doc_parts b ON b.doc_id = a.doc_id + 1 AND b.part = a.part LEFT JOIN leaders l ON l.lang = a.lang",
    "checked": "SELECT *, " + " AND ".join(f"coalesce({trim(c)}, '') <> ''" for c in ["id", *(p + k for p in ("", "p_", "l_") for k in KEYS.values())]) + " AS valid FROM individuals",
    "people": "SELECT * FROM checked WHERE valid",
    "components": "SELECT * FROM (VALUES " + ", ".join(f"({o}, {text(k)}, {text(n)}, {text(d)})" for o, k, n, d in catalogue.COMPONENTS) + ") t(component_ord, key, prompt_name, definition)",
    "draws": f"SELECT i.*, k.*, {draw('id', 'key', text('change'))} AS change_draw, {draw('id', 'key', text('source'))} AS source_draw FROM people i, components k",
    "text_docs": "SELECT a.doc_id AS pair_id, a.text AS text_a, CASE WHEN a.doc_id % 7 = 0 THEN ' ' || chr(9) ELSE b.text END AS text_b FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1",
    "calls": "SELECT event_id, user_id AS job_id, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS elapsed_ms, CASE WHEN event_type = 'error' THEN 'timeout' END AS error FROM events",
    "jobs": "SELECT position AS job_id, rol AS current, p_rol AS target FROM people",
    "job_raws": "SELECT j.*, r.run_number, CASE r.run_number WHEN 1 THEN array_to_string(ls[1:4], chr(10)) WHEN 2 THEN array_to_string(ls[5:8], chr(10)) WHEN 3 THEN '' END AS raw, CASE WHEN r.run_number = 4 THEN 'timeout' END AS error FROM (SELECT *, [" + ", ".join(_influence_lines("cw", "tw", "job_id")[:8]) + f"] AS ls FROM (SELECT *, {words('current')} AS cw, {words('target')} AS tw FROM jobs)) j, (VALUES (1), (2), (3), (4)) r(run_number)",
    "job_lists": f"SELECT job_id, current, target, run_number, {parsed('raw', 9)} AS cs FROM job_raws WHERE error IS NULL",
    "job_candidates": "SELECT job_id, current, target, run_number, i AS ordinal, cs[i] AS candidate, len(list_filter(cs, lambda c_: lower(c_) = lower(cs[i]))) AS copies FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM job_lists)",
    "job_pairs": "SELECT candidate AS a, target AS b FROM job_candidates UNION ALL SELECT current, target FROM jobs",
    **similar("job_sim", "job_pairs"),
    "job_based": "SELECT c.*, z.sim AS baseline FROM job_candidates c JOIN job_sim z ON z.a = c.current AND z.b = c.target",
    "job_scored": f"SELECT c.* EXCLUDE (baseline), s.sim AS similarity, round(s.sim - baseline, 9) AS improvement, {influence('(' + base('c.candidate', 'c.copies', 'c.current', 'c.target') + ')', 's.sim', 'round(s.sim - baseline, 9)')} AS reason FROM job_based c JOIN job_sim s ON s.a = c.candidate AND s.b = c.target",
    "job_best": "SELECT * FROM job_scored WHERE reason = 'valid' QUALIFY row_number() OVER (PARTITION BY job_id, run_number ORDER BY similarity DESC, ordinal) = 1",
    "job_counts": "SELECT job_id, run_number, count(*) AS candidate_count, count(*) FILTER (reason = 'valid') AS valid_count FROM job_scored GROUP BY ALL",
    "job_results": "SELECT r.job_id, r.run_number, coalesce(candidate_count, 0) AS candidate_count, coalesce(valid_count, 0) AS valid_count, b.candidate AS best, b.similarity AS best_similarity, b.improvement AS best_improvement, CASE WHEN error IS NULL AND candidate_count IS NULL THEN 'sin candidatos parseables' END AS status, error FROM job_raws r LEFT JOIN job_counts USING (job_id, run_number) LEFT JOIN job_best b USING (job_id, run_number)",
}


def _movements(op: str) -> dict[str, str]:
    """CTEs <op>_plan, <op>_mv (bound to the first positions), <op>_cand, <op>_scored, <op>_chosen, <op>_result; and the staged pass."""
    pick = "CASE WHEN source_draw < 0.5 THEN 'pbest' ELSE 'lider' END" if op == "influence" else "'turbulence'"
    aim = f"CASE source WHEN 'pbest' THEN {_own('p_')} WHEN 'lider' THEN {_own('l_')} END" if op == "influence" else "NULL::VARCHAR"
    out = {
        f"{op}_plan": f"SELECT position, id AS individual_id, component_ord, key, prompt_name, definition, source, change_draw AS random_value, {aim} AS target, row_number() OVER (ORDER BY position, component_ord) AS number FROM (SELECT *, {pick} AS source FROM draws WHERE change_draw > 0.7) k",
    }

    def stage(plan: str, position: str, tag: str) -> dict[str, str]:
        following = "CASE k.key WHEN 'rol' THEN p.topico WHEN 'topico' THEN p.accion ELSE p.rol END"
        other = "target" if op == "influence" else "following"
        against = "target" if op == "influence" else "current"
        reason = base("c.candidate", "c.copies", "c.current", "c.target" if op == "influence" else None)
        ctes = {
            f"{tag}_mv": f"SELECT k.*, {_own('p.')} AS current, {others('k.key', 'p.')} AS other_components, {following} AS following FROM {plan} k JOIN {position} p ON p.id = k.individual_id",
            f"{tag}_raw": f"SELECT *, CASE WHEN position % 17 = 3 THEN 'timeout' END AS error, CASE WHEN position % 17 <> 3 THEN {answer(op, 'current', other, 'position')} END AS raw FROM {tag}_mv",
            f"{tag}_list": f"SELECT *, {parsed('raw', 9)} AS cs FROM {tag}_raw",
            f"{tag}_cand": f"SELECT * EXCLUDE (cs, raw, i), i AS ordinal, cs[i] AS candidate, len(list_filter(cs, lambda c_: lower(c_) = lower(cs[i]))) AS copies FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM {tag}_list)",
            f"{tag}_pairs": f"SELECT candidate AS a, {against} AS b FROM {tag}_cand" + (f" UNION ALL SELECT current, target FROM {tag}_mv" if op == "influence" else ""),
            **similar(f"{tag}_sim", f"{tag}_pairs"),
        }
        if op == "influence":
            gain = "round(s.sim - baseline, 9)"
            ctes[f"{tag}_based"] = f"SELECT c.*, z.sim AS baseline FROM {tag}_cand c JOIN {tag}_sim z ON z.a = c.current AND z.b = c.target"
            ctes[f"{tag}_scored"] = f"SELECT c.*, s.sim AS similarity, {gain} AS improvement, NULL::DOUBLE AS diversity, {influence('(' + reason + ')', 's.sim', gain)} AS reason FROM {tag}_based c JOIN {tag}_sim s ON s.a = c.candidate AND s.b = c.target"
            order = "similarity DESC, ordinal"
        else:
            ctes[f"{tag}_scored"] = f"SELECT c.*, NULL::DOUBLE AS baseline, s.sim AS similarity, NULL::DOUBLE AS improvement, round(1 - s.sim, 9) AS diversity, {turbulence('(' + reason + ')', 's.sim')} AS reason FROM {tag}_cand c JOIN {tag}_sim s ON s.a = c.candidate AND s.b = c.current"
            order = "md5('42|' || number || '|' || ordinal), ordinal"
        ctes[f"{tag}_chosen"] = f"SELECT * FROM {tag}_scored WHERE reason = 'valid' QUALIFY row_number() OVER (PARTITION BY number ORDER BY {order}) = 1"
        return ctes

    out |= stage(f"{op}_plan", "people", op)
    none = "sin candidato con progreso semántico" if op == "influence" else "sin candidato en rango de turbulencia"
    out[f"{op}_count"] = f"SELECT number, count(*) AS candidate_count, count(*) FILTER (reason = 'valid') AS valid_count FROM {op}_scored GROUP BY number"
    out[f"{op}_result"] = f"SELECT m.number, m.individual_id, m.source, m.error, CASE WHEN m.error IS NULL THEN m.number % 500 ELSE 1000 + m.number % 7 END::DOUBLE AS elapsed_ms, coalesce(candidate_count, 0) AS candidate_count, coalesce(valid_count, 0) AS valid_count, c.candidate AS selected, c.similarity AS selected_similarity, c.candidate IS NOT NULL AS applied, CASE WHEN m.error IS NOT NULL THEN 'error de ejecución' WHEN c.candidate IS NOT NULL THEN NULL WHEN candidate_count IS NULL THEN 'sin candidatos parseables' ELSE '{none}' END AS failure_reason FROM {op}_raw m LEFT JOIN {op}_count USING (number) LEFT JOIN {op}_chosen c USING (number)"
    before = "people"
    for s in KEYS:
        out[f"{op}_plan{s}"] = f"SELECT * FROM {op}_plan WHERE component_ord = {s}"
        out |= stage(f"{op}_plan{s}", before, f"{op}{s}")
        moved = ", ".join(f"CASE WHEN c.key = '{k}' THEN c.candidate ELSE p.{k} END AS {k}" for k in KEYS.values())
        out[f"{op}_pos{s}"] = f"SELECT p.id, {moved} FROM {before} p LEFT JOIN {op}{s}_chosen c ON c.individual_id = p.id"
        before = f"{op}_pos{s}"
    out[f"{op}_applied"] = " UNION ALL ".join(f"SELECT {s} AS stage, number, individual_id, key, current, candidate, similarity, other_components FROM {op}{s}_chosen" for s in KEYS)
    return out


CTES |= _movements("influence") | _movements("turbulence")


def with_(final: str) -> str:
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\w+", re.sub(r"'(?:[^']|'')*'", "''", sql))):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(final)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed) + "\n" if needed else "") + final
