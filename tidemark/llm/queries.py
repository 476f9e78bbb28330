"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bbit, chat, decontaminate, hostgraph, language, lines, phrases, prefixtrie, quality, recipes, secret_scan, simhash, unigram
from tidemark.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def fold(doc_id: str, n: int) -> Column:
    """CRC-32 of the id as text, modulo ``n``: decides what is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, learnable=fold("doc_id", 5) != 0)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs, learnable=fold("doc_id", 3) != 1)
    return language.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


#: Rows that every run of op4 formats besides the table: control strings inside contents.
PLANTED_TURNS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def _chat_sql(template: chat.ChatTemplate) -> str:
    escaped = lambda c: f"regexp_replace({c}, '\\\\|" + "|".join(template.guarded()) + "', '\\\\\\0', 'g')"
    known = " ".join(f"WHEN '{r}' THEN {len(template.opening.format(r))}" for r in template.roles)
    other = f"{len(template.other) + len(template.role_end)} + length({escaped('role')})"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PLANTED_TURNS[0][3]}'), (-7, 1, 'assistant', '{PLANTED_TURNS[1][3]}')),
m AS (SELECT *, CASE WHEN role IN ({", ".join(f"'{r}'" for r in template.learn)}) THEN text ELSE '' END AS learned,
  CASE role {known} ELSE {other} END + length({escaped("text")}) + {len(template.closing)} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""


@query(_chat_sql(chat.ChatTemplate()))
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_TURNS, "conv_id bigint, turn bigint, role string, text string")
    vocabulary = chat.Vocabulary.load()
    return chat.digest_conversations(chat.read_turns(chat.format_turns(turns.unionByName(planted), vocabulary), vocabulary))


@query()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(read_table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query()
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("span_text").alias("spans"), "n_novel")


@query(r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(read_table(spark, sf_dir, "documents"))


URL_RULES = (
    hostgraph.UrlRule("com", "/", "allow"),
    hostgraph.UrlRule("example.com", "/en/", "block"),
    hostgraph.UrlRule("www.example.com", "/en/", "allow"),
    hostgraph.UrlRule("net", "/es/", "block"),
    hostgraph.UrlRule("net", "/fr/", "block"),
)


def _url_sql(rules: tuple[hostgraph.UrlRule, ...], rule: hostgraph.SpreadRule) -> str:
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    case = lambda get: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{get(r)}'" for r in order) + " END"
    lower = lambda x: f"translate({x}, '{hostgraph.UPPER}', '{hostgraph.LOWER}')"
    parts = [f"""
p0 AS (SELECT page_id, url, html, coalesce({lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, url, html, host, path, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p0),
l0 AS (SELECT host AS a, {lower("unnest(regexp_extract_all(html, '(?is)\\bhref\\s*=\\s*[\"'']?\\s*(?:https?:)?//([^/?#\"''\\s>]+)', 1))")} AS b FROM p),
links AS (SELECT a, b, count(*) AS n FROM l0 WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b)"""]
    for name, verdict, a, b in (("trust", "allow", "a", "b"), ("distrust", "block", "b", "a")):
        parts.append(f"""
{name}_s AS (SELECT host, count(*) / sum(count(*)) OVER () AS seed FROM p WHERE ruled = '{verdict}' AND host <> '' GROUP BY host),
{name}_w AS (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM links),
{name}_0 AS (SELECT host, seed AS rank FROM {name}_s)""")
        for k in range(rule.rounds):
            parts.append(f"""
{name}_{k + 1} AS (SELECT host, sum(part) AS rank FROM (
  SELECT w.b AS host, r.rank * w.share * {rule.damping} AS part FROM {name}_{k} r JOIN {name}_w w ON r.host = w.a
  UNION ALL SELECT host, seed * CASE WHEN (SELECT count(*) FROM links) = 0 THEN 1 ELSE {1 - rule.damping} END FROM {name}_s) GROUP BY host)""")
    n = rule.rounds
    return "WITH " + ",".join(parts) + f"""
SELECT page_id, p.host, path, rule, coalesce(ruled,
  CASE WHEN coalesce(t.rank, 0) + coalesce(d.rank, 0) > {rule.floor} AND coalesce(d.rank, 0) > {rule.threshold} * (coalesce(t.rank, 0) + coalesce(d.rank, 0))
  THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN trust_{n} t ON t.host = p.host LEFT JOIN distrust_{n} d ON d.host = p.host"""


@query(_url_sql(URL_RULES, hostgraph.SpreadRule()))
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostgraph.judge_pages(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(read_table(spark, sf_dir, "documents"), unigram.load_model())


def _leak_sql(rule: decontaminate.Containment) -> str:
    upper, lower = hostgraph.UPPER, hostgraph.LOWER
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    own = lambda size: f"unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size} + 2), lambda i: list_slice(w, i, i + {size} - 1)) ELSE [] END)"
    return f"""
WITH iw AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(w), {rule.words}) AS size, {own(f"least(len(w), {rule.words})")} AS s FROM iw WHERE len(w) > 0),
sizes AS (SELECT item_id, size, count(*) AS n_item FROM i GROUP BY item_id, size),
dw AS (SELECT doc_id, {words} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, z.size, {own("z.size")} AS s FROM dw, (SELECT DISTINCT size FROM sizes) z),
hits AS (SELECT d.doc_id, i.item_id, count(*) AS n_shared FROM d JOIN i ON d.size = i.size AND d.s = i.s GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM hits JOIN sizes USING (item_id) WHERE n_shared >= greatest(1, ceil({rule.threshold} * n_item - 1e-9))"""


@query(_leak_sql(decontaminate.Containment()))
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _trie_sql(rule: prefixtrie.TrieRule) -> str:
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    words = r"length(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    return f"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS pos,
  sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS d, {words} AS words FROM t0),
n AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % {rule.every} AS base, {crc} % {rule.heads} AS h FROM n),
k AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS lent, n.n AS own FROM c JOIN n USING (conv_id) LEFT JOIN n b ON b.conv_id = c.base),
turns AS (SELECT k.conv_id, t.pos AS depth, t.d, t.words FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.lent
  UNION ALL SELECT k.conv_id, t.pos - k.h + k.lent, t.d, t.words FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
paths AS (SELECT conv_id, depth, words, sha256(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
p AS (SELECT a.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths a),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY node, depth),
children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
pairs AS (SELECT DISTINCT a.node, a.depth, b.node AS lower_node, b.depth AS lower_depth FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
below AS (SELECT pairs.node, pairs.depth, sum(saved) AS saved, count(*) FILTER (children.n IS NULL) AS leaves
  FROM pairs JOIN nodes ON nodes.node = lower_node AND nodes.depth = lower_depth LEFT JOIN children ON children.node = lower_node GROUP BY pairs.node, pairs.depth)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(children.n, 0) AS n_children, below.leaves AS n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below ON below.node = x.node AND below.depth = x.depth
LEFT JOIN nodes u ON u.node = x.up AND u.depth = x.depth - 1 LEFT JOIN children ON children.node = x.node"""


@query(_trie_sql(prefixtrie.TrieRule()))
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


@query()
def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(read_table(spark, sf_dir, "documents"))


def _phrase_sql(rule: phrases.PhraseRule) -> str:
    upper, lower = hostgraph.UPPER, hostgraph.LOWER
    grams = "unnest(range(1, len(w) + 1))"
    return rf"""
WITH d AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
starts AS (SELECT lang, w, {grams} AS pos FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS phrase FROM starts, range(1, {rule.longest + 1}) r(k) WHERE pos + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {rule.least}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
longer AS (SELECT lang, a, w, unnest(range(2, k)) AS len FROM c),
inside AS (SELECT lang, a, w, len, unnest(range(1, len(w) - len + 2)) AS pos FROM longer),
over AS (SELECT lang, array_to_string(list_slice(w, pos, pos + len - 1), ' ') AS phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN over USING (lang, phrase) WHERE most IS NULL OR most < a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
s AS (SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, n.n, cut, CAST((CAST(1000 AS HUGEINT) * x.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, len(w)), ' ') JOIN n ON n.lang = x.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {rule.top}"""


@query(_phrase_sql(phrases.PhraseRule()))
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))
