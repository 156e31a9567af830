"""Personal data in texts: candidate spans, scored by boosted trees. SQL functions only.

Four base kinds follow fixed patterns with checks and are always redacted. Five high-recall generators propose
further spans, which may overlap base spans and one another; features of a candidate's format and context go
through boosted trees, and a threshold per kind, calibrated on held-out candidates, selects what is redacted. Candidates that
lie within base spans are left out.

Positions come from splitting a text at the same pattern: what stands between matches, and the matches, are as long
as the text, so running sums of their lengths are places. The sums are taken in blocks, so that a text with very many
matches does not cost their square. Patterns that could scan a run of characters again from each of its places begin
where the run begins (or where the match before ends) and do not give back what they have taken; they match the same spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pii_trees import THRESHOLDS, TREES

BLOCK = 64
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "{t} rlike '[0-9]\\\\.[0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", "{t} rlike '[0-9][\\\\x20-]?[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')"),
    "address": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:\x20?(?:[(\[]\x20?at\x20?[)\]]|@)\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\x20?(?:[(\[]\x20?dot\x20?[)\]]|\.)\x20?|\x20(?:dot|DOT)\x20)[A-Za-z]{{2,24}}+){{1,3}}+", "{t} rlike '@|[(\\\\[]\\\\x20?at\\\\x20?[)\\\\]]| (at|AT) [A-Za-z0-9-]+( dot | DOT |[.])'"),
    "number": (r"(?<![0-9A-Za-z.+,-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,17}(?![\x20().-]{0,2}[0-9])(?![A-Za-z])", "{t} rlike '[0-9][\\\\x20().-]{{0,2}}[0-9]'"),
    "secret": (r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}+", "{t} rlike '[0-9]'"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?+[A-Z0-9]{4}(?![a-z])){2,7}+(?:[\x20-]?+[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])", "{t} rlike '[A-Z][A-Z][0-9][0-9]'"),
    "token": (r"(?<=/)(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])", "contains({t}, '/')"),
}
BASE = ("email", "ip", "card", "phone")
EXTRA = ("address", "number", "secret", "account", "token")
_LUHN = "aggregate(sequence(0, length({d}) - 1), 0L, (a, i) -> a + (CAST(substring({d}, length({d}) - i, 1) AS int) * (1 + i % 2)) div 10 + (CAST(substring({d}, length({d}) - i, 1) AS int) * (1 + i % 2)) % 10) % 10 = 0"
# The remainder by 97 of an account number's check: its first four places go last, letters count from 10.
_REMAINDER = "aggregate(split(regexp_replace(concat(substring({d}, 5), substring({d}, 1, 4)), '[^A-Z0-9]', ''), ''), 0, (a, x) -> IF(x rlike '[0-9]', a * 10 + CAST(x AS int), IF(x = '', a, a * 100 + ascii(x) - 55)) % 97)"
CHECKS = {
    "email": "true",
    "ip": "forall(split(s.match, '[.]'), x -> try_cast(x AS double) <= 255)",
    "card": _LUHN.format(d="regexp_replace(s.match, '[^0-9]', '')"),
    "phone": "length(regexp_replace(s.match, '[^0-9]', '')) BETWEEN 9 AND 15",
}
FEATURES = {
    "length": "length(c.match)",
    "digits": "length(regexp_replace(c.match, '[^0-9]', ''))",
    "upper": "length(regexp_replace(c.match, '[^A-Z]', ''))",
    "lower": "length(regexp_replace(c.match, '[^a-z]', ''))",
    "hex_share": "(100 * length(regexp_replace(c.match, '[^0-9a-fA-F]', ''))) div length(c.match)",
    "separators": "length(regexp_replace(c.match, '[A-Za-z0-9]', ''))",
    "distinct": "size(array_distinct(split(c.match, '')))",
    "changes": "length(regexp_replace(regexp_replace(c.match, '[0-9]+', '#'), '[^#]', ''))",
    "bracket": "IF(c.match rlike '[(\\\\[]', 1, 0)",
    "secret_cue": "IF(c.before rlike '(?i)(token|secret|passw|pwd|api|key|auth|bearer|credential)[^\\\\n]{0,12}$', 1, 0)",
    "number_cue": "IF(c.before rlike '(?i)(tel|phone|call|mobile|fax|contact|ssn|social|dial|reach)[^\\\\n]{0,14}$', 1, 0)",
    "opened": "IF(c.before rlike '[=:\"\\'] ?$', 1, 0)",
    "other_cue": "IF(c.before rlike '(?i)(order|invoice|isbn|item|ref|page|year|version|serial|lot|part|id|no[.:]?|nr[.:]?|#)[^A-Za-z0-9\\\\n]{0,4}$', 1, 0)",
    "first_group": "length(regexp_extract(c.match, '[0-9]+', 0))",
    "second_group": "length(regexp_extract(c.match, '[0-9]+[^0-9]+([0-9]+)', 1))",
    "last_group": "length(regexp_extract(c.match, '([0-9]+)[^0-9]*$', 1))",
    "zero_first": "IF(c.match rlike '^[^0-9]?0', 1, 0)",
    "dots": "length(regexp_replace(c.match, '[^.]', ''))",
    "hyphens": "length(regexp_replace(c.match, '[^-]', ''))",
    "stop_inside": "IF(c.match rlike '[.] ', 1, 0)",
    "last_label": "length(regexp_extract(c.match, '([A-Za-z]+)$', 1))",
    "at_sign": "IF(contains(c.match, '@'), 1, 0)",
    "spelled": "IF(c.match rlike ' (at|AT) ', 1, 0) + IF(c.match rlike ' (dot|DOT) ', 1, 0)",
    "checksum": f"IF(c.kind = 'account' AND {_REMAINDER.format(d="regexp_replace(c.match, '[^A-Z0-9]', '')")} = 1, 1, 0)",
    "account_cue": "IF(c.before rlike '(?i)(iban|account|acct|konto|bank|transfer)[^\\n]{0,14}$', 1, 0)",
    "hash_cue": "IF(c.before rlike '(?i)(commit|sha|md5|hash|digest|checksum|revision|blob|tree|etag)[^A-Za-z\\n]{0,8}$', 1, 0)",
    "slashes": "length(regexp_replace(c.match, '[^/]', ''))",
    "words": "size(regexp_extract_all(c.match, '[a-z]{3,}', 0))",
}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(rows: DataFrame, kinds: tuple[str, ...], text: str, passed: list[str]) -> DataFrame:
    """passed, and for each kind k an array __k_k of (kind, start, end, match, before): all matches of its pattern, in order."""
    conditions = {k: PATTERNS[k][1].format(t=text) for k in kinds}
    rows = rows.select(*passed, *(F.expr(f"IF({conditions[k]}, regexp_extract_all({text}, {_literal(PATTERNS[k][0])}, 0), CAST(array() AS array<string>))").alias(f"__m_{k}") for k in kinds))
    have = [f"__m_{k}" for k in kinds]
    rows = rows.select(*passed, *have, *(F.expr(f"IF(size(__m_{k}) > 0, split({text}, {_literal(PATTERNS[k][0])}), CAST(array() AS array<string>))").alias(f"__p_{k}") for k in kinds))
    have += [f"__p_{k}" for k in kinds]
    rows = rows.select(*passed, *have, *(F.expr(f"transform(__m_{k}, (m, i) -> CAST(length(m) + length(get(__p_{k}, i)) AS bigint))").alias(f"__s_{k}") for k in kinds))
    have += [f"__s_{k}" for k in kinds]
    blocks = "transform(sequence(0, CAST(size(__s_{k}) div {b} AS int)), b -> aggregate(slice(__s_{k}, 1, b * {b}), 0L, (a, x) -> a + x))"
    rows = rows.select(*passed, *have, *(F.expr(blocks.format(k=k, b=BLOCK)).alias(f"__b_{k}") for k in kinds))
    end = f"get(__b_{{k}}, CAST(i div {BLOCK} AS int)) + aggregate(slice(__s_{{k}}, CAST(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, x) -> a + x)"
    span = f"transform(__m_{{k}}, (m, i) -> named_struct('kind', '{{k}}', 'start', {end} - length(m), 'end', {end}, 'match', m, 'before', right(get(__p_{{k}}, i), 24)))"
    return rows.select(*passed, *(F.expr(span.format(k=k)).alias(f"__k_{k}") for k in kinds))


def candidates(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep, __text, base (array of checked spans) and extra (array of candidates with their features as field ``f``, an array of int).

    What is kept travels in one struct, so its columns may have any names but those three.
    """
    taken = {"__text", "base", "extra", "added"} & set(keep)
    if taken:
        raise ValueError(f"names of the result: {sorted(taken)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = _spans(rows, (*BASE, *EXTRA), "__text", ["__keep", "__text"])
    checked = ", ".join(f"filter(__k_{k}, s -> {CHECKS[k]})" for k in BASE)
    rows = rows.select("__keep", "__text", F.expr(f"concat({checked})").alias("base"), F.expr(f"concat({', '.join(f'__k_{k}' for k in EXTRA)})").alias("__extra"))
    values = ", ".join(f"CAST({f} AS int)" for f in FEATURES.values())
    free = "filter(__extra, c -> NOT exists(base, s -> s.start <= c.start AND c.end <= s.end))"
    rows = rows.select("__keep", "__text", "base", F.expr(free).alias("__extra"))
    featured = F.expr(f"transform(__extra, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'f', array({values})))").alias("extra")
    return rows.select(*[F.col(f"__keep.`{c}`").alias(c) for c in keep], "__text", "base", featured)


def score_sql(trees: list[tuple], features: str) -> str:
    """The sum of the trees' leaves (integers) as SQL. A tree is (feature, threshold, left, right); a leaf is an integer."""
    names = list(FEATURES)

    def walk(node) -> str:
        if isinstance(node, int):
            return str(node)
        feature, threshold, left, right = node
        return f"IF(get({features}, {names.index(feature)}) <= {threshold}, {walk(left)}, {walk(right)})"

    return " + ".join(walk(t) for t in trees) or "0"


def detect(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, __text (null as ""), base and added: arrays of (kind, start, end) in order of kind as listed, then start.

    Every row is judged by itself, so repeated rows give repeated results; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = candidates(docs, text_col, keep)
    chosen = " OR ".join(f"(c.kind = '{k}' AND {score_sql(TREES[k], 'c.f')} > {THRESHOLDS[k]})" for k in EXTRA)
    plain = "named_struct('kind', s.kind, 'start', s.start, 'end', s.end)"
    return rows.select(*[F.col(f"`{c}`") for c in keep], "__text", F.expr(f"transform(base, s -> {plain})").alias("base"), F.expr(f"transform(filter(extra, c -> {chosen}), s -> {plain})").alias("added"))


def listed(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, joined by commas."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets, spans that touch the same characters by the first of them.

    Null texts stay null, and all other columns, whatever their names, stay as they are; every row is judged by itself.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.col(f"`{text_col}`").isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("__row"), F.col(f"`{text_col}`").alias("__source"))
    rows = detect(packed, "__source", ["__row"])
    rows = rows.select("__row", "__text", F.expr("array_sort(transform(concat(base, added), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))").alias("__all"))
    rows = rows.select("__row", "__text", "__all", F.expr("transform(__all, s -> s.end)").alias("__ends"))
    blocks = f"transform(sequence(0, CAST(size(__ends) div {BLOCK} AS int)), b -> coalesce(array_max(slice(__ends, 1, b * {BLOCK})), 0L))"
    rows = rows.select("__row", "__text", "__all", "__ends", F.expr(blocks).alias("__tops"))
    upto = f"transform(__all, (s, i) -> greatest(get(__tops, CAST(i div {BLOCK} AS int)), coalesce(array_max(slice(__ends, CAST(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK})), 0L)))"
    rows = rows.select("__row", "__text", "__all", "__ends", F.expr(upto).alias("__upto"))
    parts = "transform(__all, (s, i) -> IF(s.start >= get(__upto, i), concat(substring(__text, CAST(get(__upto, i) + 1 AS int), CAST(s.start - get(__upto, i) AS int)), '[', upper(s.kind), ']'), ''))"
    done = F.expr(f"IF(__row.null, NULL, IF(size(__all) = 0, __text, concat(array_join({parts}, ''), substring(__text, CAST(array_max(__ends) + 1 AS int)))))")
    return rows.select(*(done.alias(c) if c == text_col else F.col(f"__row.c{others.index(c)}").alias(c) for c in docs.columns))
