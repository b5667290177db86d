"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover, license_scan, maxent, oddsketch, piece_bpe, raking, recipes, suffix, urlrules, weaksup
from .util import LOWER, UPPER, table

#: Words of unwanted sites. Rules of two words are made from the lists: some hundreds.
VICES = ("pills", "casino", "poker", "viagra", "porn", "xxx", "warez")
LURES = ("cheap", "free", "best", "online", "instant", "bonus", "discount", "hot", "win", "buy", "spam", "fast", "easy")
LEADS = ("offer", "deal", "login", "verify", "download", "crack", "jackpot", "slots", "replica", "loan", "meds", "prize", "gift", "click", "promo", "en", "de", "685")
URL_RULES = [
    urlrules.host_rule("org/", "allow"),
    urlrules.host_rule("example.org/es/", "block"),
    urlrules.host_rule("example.org/en/1", "block"),
    urlrules.host_rule("com/fr/", "allow"),
    urlrules.host_rule("com/de/", "block"),
    *[urlrules.word_rule((t,)) for t in VICES],
    *[urlrules.word_rule(path=(t,)) for t in ("phishing", "malware")],
    *[urlrules.word_rule((a, b)) for a in LURES for b in (*VICES, "farm")],
    *[urlrules.word_rule((a,), (b,)) for a in ("spam", *LURES) for b in LEADS],
    *[urlrules.word_rule(path=(a, b)) for a in LURES for b in LEADS],
]


def tokenizer_path() -> str:
    """The vocabulary file that each machine has."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raking.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "margin_error")})


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaksup.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.dedup_windows(table(spark, sf_dir, "documents"))


def op10_maximum_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_arrays, op2_source_mixing, op3_license_scan, op4_piece_encoding, op5_chunk_recipes, op6_weak_quality, op7_odd_sketches, op8_url_rules, op9_cover_anchors, op10_maximum_entropy)}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op2_sql(rows: str = "documents", final: str | None = None) -> str:
    """Raking with each step of each round as one window sum."""
    w = "CAST(tokens AS DOUBLE)"
    axes = ("source", "lang", "topic")
    aims = ", ".join(f"CASE WHEN own_{a} > 0 THEN pow(own_{a}, {p}) ELSE 0 END AS pw_{a}" for a, p in zip(axes, raking.POWERS, strict=True))
    own = ", ".join(f"CAST(sum(tokens) OVER (PARTITION BY {a}) AS DOUBLE) AS own_{a}" for a in axes)
    want = ", ".join(f"pw_{a} / (SELECT sum(x) FROM (SELECT any_value(pw_{a}) AS x FROM raised GROUP BY {a})) * total AS aim_{a}" for a in axes)
    steps, last = [], "aimed"
    for r in range(raking.ROUNDS):
        for a in axes:
            name = f"r{r}_{a}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {a}) > 0 THEN w * (aim_{a} / sum(w) OVER (PARTITION BY {a})) ELSE 0 END AS w) FROM {last})")
            last = name
    return f"""
WITH said AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'toxic' WHEN min(quality) = 0 THEN 'junk' ELSE 'clean' END AS said FROM labels GROUP BY doc_id),
rows_ AS (SELECT d.*, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '')) AS n_tokens, coalesce(said, '{raking.UNLABELLED}') AS topic FROM {rows} d LEFT JOIN said USING (doc_id)),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM rows_ GROUP BY ALL),
owned AS (SELECT *, {own}, CAST(sum(tokens) OVER () AS DOUBLE) AS total FROM cells),
raised AS MATERIALIZED (SELECT *, {aims} FROM owned),
aimed AS MATERIALIZED (SELECT *, {w} AS w, {want} FROM raised),
{", ".join(steps)},
errors AS (SELECT greatest({", ".join(f"(SELECT max(abs(w - aim) / aim) FROM (SELECT sum(w) AS w, any_value(aim_{a}) AS aim FROM {last} GROUP BY {a}) WHERE aim > 0)" for a in axes)}) AS margin_error),
ratios AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM {last}),
cuts AS MATERIALIZED (SELECT *, coalesce(sum(tokens) OVER before, 0) AS cut, (SELECT sum(w) FROM ratios) - coalesce(sum(w) OVER before, 0) AS rest
  FROM ratios WINDOW before AS (ORDER BY ratio DESC, source NULLS FIRST, lang NULLS FIRST, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scales AS (SELECT ({raking.BUDGET} * total - cut) / rest AS scale, ratio, cut FROM cuts WHERE rest > 0),
scale AS (SELECT coalesce(arg_min(scale, cut), 1e300) AS scale FROM scales WHERE scale * ratio <= 1),
rates AS (SELECT source, lang, topic, CASE WHEN ratio > 0 THEN least(1.0, greatest(scale, 0) * ratio) WHEN tokens > 0 THEN 0.0 ELSE 1.0 END AS rate FROM ratios, scale),
drawn AS (SELECT d.*, r.rate, CAST(('0x' || substr(md5('{raking.SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0 < r.rate AS kept
  FROM rows_ d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic)
{final or "SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, round(margin_error, 6) AS margin_error, kept FROM drawn, errors"}"""


def op3_sql() -> str:
    def canonical(c: str) -> str:
        x = f"regexp_replace(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '\\r\\n?', chr(10), 'g')"
        x = f"regexp_replace({x}, {quoted(license_scan.COPYRIGHT_LINE)}, '\\1', 'g')"
        x = f"' ' || trim(regexp_replace({x}, '[\\x00-/:-@\\[-`{{-~\\x7f©®™“”‘’–—«»…]+', ' ', 'g')) || ' '"
        for a, b in license_scan.SPELLINGS:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"trim({x})"

    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in license_scan.KNOWN)
    return f"""
WITH known AS (SELECT sha256({canonical("t")}) AS digest, min(id) AS license_id FROM (VALUES {known}) k(id, t) GROUP BY 1),
c AS (SELECT doc_id, {canonical("text")} AS c FROM documents)
SELECT doc_id, sha256(c) AS canonical_sha256, CAST(length(c) AS BIGINT) AS n_canonical, CASE WHEN length(c) > 0 THEN license_id END AS license_id
FROM c LEFT JOIN known ON digest = sha256(c)"""


OP5_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(s) AS text_sha256
FROM n WINDOW w AS (PARTITION BY s ORDER BY c DESC, doc_id)"""


def op6_parts(rows: str = "documents") -> str:
    """WITH parts up to `judged`: all columns of rows, the counts, base_failed, posterior, kept."""
    names = list(weaksup.RULES)
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{k}" for k, (bad, good) in weaksup.RULES.items())
    cols = ", ".join(f"v_{k}" for k in names)
    n_bad = " + ".join(f"(v_{k} = -1)::INT" for k in names)
    s, n_classes = weaksup.SMOOTH, len(names) + 2
    lists = f"[{cols}]"
    disliked = f"CASE WHEN ({n_bad}) = 0 THEN [{len(names) + 1}] ELSE list_filter(range(1, {len(names) + 1}), lambda j: {lists}[j] = -1) END"
    steps, source = [], "w0"
    for r in range(weaksup.ROUNDS):
        steps.append(f"""size{r} AS MATERIALIZED (SELECT c, sum(coalesce(x * n, 0)) AS size FROM classes LEFT JOIN {source} USING (c) GROUP BY c),
share{r} AS MATERIALIZED (SELECT c, size, ln((size + {s}) / (sum(size) OVER () + {s * n_classes})) AS share FROM size{r}),
rate{r} AS MATERIALIZED (SELECT g.c, g.j, g.v, ln((coalesce(t.given, 0) + {s}) / (sh.size + {3 * s})) AS rate
  FROM grid g JOIN share{r} sh USING (c) LEFT JOIN (SELECT c, j, v, sum(x * n) AS given FROM {source} JOIN long USING (pid) GROUP BY ALL) t ON g.c = t.c AND g.j = t.j AND g.v = t.v),
fit{r} AS MATERIALIZED (SELECT pid, label, n, c, any_value(share) + sum(rate) AS f FROM long JOIN rate{r} USING (j, v) JOIN share{r} USING (c) JOIN patterns USING (pid) GROUP BY ALL)""")
        if r < weaksup.ROUNDS - 1:
            steps.append(f"w{r + 1} AS MATERIALIZED (SELECT pid, c, n, exp(f - most) / sum(exp(f - most)) OVER p AS x FROM (SELECT *, max(f) OVER (PARTITION BY pid) AS most FROM fit{r} WHERE label IS NULL OR (c = 0) = (label = 1)) WINDOW p AS (PARTITION BY pid))")
            source = f"w{r + 1}"
    last = f"fit{weaksup.ROUNDS - 1}"
    return f"""
texts AS (SELECT *, coalesce(text, '') AS t_, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w_ FROM {rows}),
lined AS (SELECT *, list_filter(string_split(t_, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l_ FROM texts),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(w_) - 3, 1))) AS i, w_ FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w_[i:i + 4], ' ') AS x FROM starts),
doubled AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM doubled) GROUP BY doc_id),
counts AS MATERIALIZED (SELECT l.* EXCLUDE (w_, l_), CAST(len(w_) AS BIGINT) AS n_words, CAST(length(regexp_replace(t_, '[ \\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t_) - length(regexp_replace(t_, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l_) - len(list_distinct(l_)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l_) AS n_lines, len(list_distinct(w_)) AS n_distinct,
  length(t_) - length(regexp_replace(t_, '\\p{{Lu}}', '', 'g')) AS n_upper, length(t_) - length(regexp_replace(t_, '[!?]', '', 'g')) AS n_shouts
  FROM lined l LEFT JOIN covered c USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {vote} FROM counts),
told AS (SELECT doc_id, CAST(min(quality) AS INTEGER) AS label FROM labels GROUP BY doc_id),
apart AS (SELECT DISTINCT t_, {cols}, label FROM voted LEFT JOIN told USING (doc_id)),
patterns AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (SELECT {cols}, label, CAST(count(*) AS DOUBLE) AS n FROM apart GROUP BY ALL)),
long AS MATERIALIZED (SELECT pid, unnest(range(1, {len(names) + 1})) AS j, unnest({lists}) AS v FROM patterns),
classes AS MATERIALIZED (SELECT unnest(range({n_classes})) AS c),
grid AS MATERIALIZED (SELECT c, j, v FROM classes, (SELECT unnest(range(1, {len(names) + 1})) AS j), (SELECT unnest([-1, 0, 1]) AS v)),
known AS MATERIALIZED (SELECT coalesce(bool_or(label = 1) AND bool_or(label = 0), false) AS both_ FROM patterns),
begun AS (SELECT pid, n, {disliked} AS bad, CASE WHEN both_ THEN CAST(label AS DOUBLE) WHEN ({n_bad}) = 0 THEN 1.0 WHEN ({n_bad}) = 1 THEN 0.5 ELSE 0.0 END AS good FROM patterns, known WHERE NOT both_ OR label IS NOT NULL),
w0 AS MATERIALIZED (SELECT pid, 0 AS c, n, good AS x FROM begun UNION ALL SELECT pid, unnest(bad) AS c, n, (1 - good) / len(bad) AS x FROM begun),
{", ".join(steps)},
good AS MATERIALIZED (SELECT {cols}, any_value(p) AS posterior FROM (SELECT pid, sum(CASE WHEN c = 0 THEN e ELSE 0 END) / sum(e) AS p FROM (SELECT pid, c, exp(f - max(f) OVER (PARTITION BY pid)) AS e FROM {last}) GROUP BY pid) JOIN patterns USING (pid) GROUP BY {cols}),
judged AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM voted JOIN good USING ({cols}))"""


OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM q),
m AS (SELECT * FROM (VALUES RULE_ROWS) m(name, on_host, on_path, rank)),
f AS (SELECT host AS h, path AS p, min({'r': -rank, 'n': name}).n AS pattern_rule FROM (SELECT DISTINCT host, path FROM q), m
  WHERE (on_host = '' OR regexp_matches(host, on_host)) AND (on_path = '' OR regexp_matches(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), on_path)) GROUP BY ALL)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN pattern_rule END AS pattern_rule FROM r LEFT JOIN f ON host = h AND path = p"""


def op8_sql() -> str:
    rows = ", ".join(f"({quoted(r.name)}, {quoted(r.host)}, {quoted(r.path)}, {r.rank})" for r in URL_RULES if r.fold)
    return OP8_SQL.replace("RULE_ROWS", rows)


WORDS_SQL = "list_filter(regexp_split_to_array({}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS s FROM w),
sized AS MATERIALIZED (SELECT doc_id, len(s) AS n, s FROM sets),
flat AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sized JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id"""

OP9_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM (SELECT s.doc_id, i FROM s JOIN (SELECT x, min(doc_id) AS least FROM s GROUP BY x) m USING (x) WHERE s.doc_id > least)),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed, CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(js, i)), lambda i: ws[i]) END AS kept FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""


def oracle_sql() -> dict[str, str]:
    op6 = f"WITH {op6_parts()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(posterior, 6) AS posterior, NOT base_failed AND posterior >= {weaksup.THRESHOLD} AS kept FROM judged"
    return {"op2_source_mixing": op2_sql(), "op3_license_scan": op3_sql(), "op5_chunk_recipes": OP5_SQL, "op6_weak_quality": op6, "op7_odd_sketches": OP7_SQL, "op8_url_rules": op8_sql(), "op9_cover_anchors": OP9_SQL}
