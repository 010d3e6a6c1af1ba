"""Queries over annotation labels, corpus files and record joins."""

from __future__ import annotations

import json

import pyarrow.fs
from pyspark.sql import Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonoframe import schemas
from phonoframe import tables as K
from phonoframe.bindings import views as V
from phonoframe.bindings.records import POS, sig, with_verdicts
from phonoframe.functions import scalar as S
from phonoframe.operators import content as X
from phonoframe.operators import labels as L
from phonoframe.operators import records as R
from phonoframe.operators import splits as SP
from phonoframe.operators.storage import scratch, store
from phonoframe.sources import corpora as C
from phonoframe.sources import files as T
from phonoframe.sources import registry

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def pick(values: list[str], index: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"CAST({index} AS INT)"))


def pick_sql(values: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INT)])"


def values_sql(name: str, table: dict) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in table.items())
    return f"{name}(k, v) AS (VALUES {rows})"


ARPA = ["DH", "AH0", "Z", "EH1", "SIL", "IY2", "XX", "sp", "K", "ER*", "NG", "OW1", "", "ZH"]
TIER = ["AA*", "ER)", "V8", "Z_", "R*", "Ah", "ɫ", "dʒ", "sil", "err", "qq", "ə", "r", "IY0", "uh", "RH", "*", "SP", "dh2"]
AUTHORED = ["ˈiː", "g", "r", "tʃ", "ʧ", "x", "ɜː", " ð ", "e.", "", "ˌoʊ", "a/", "ɪɹ", "Q"]
SAMPA = ["p", "tS", "{", "i:", "_", "#", "@U", "END", "zz", "N", "3:", "?", "", "D"]
TAGS = ["DH,Z,s", "AH0", "DH,D,S", "T,sil,d", "IY,,d.", "sil,AH,a", "Z,S,sd", "K,G,x", "DH,err,s", "sil",
        "sp,IY,s", "qq,Z,s", "W,V", "ɹ,l,s", "D,T,", "qq", "N,AH,as", "ER)"]
MARKED = ["\\well", "`/please|", "/now", "`go,||", "=flat#", "plain", "<\\deep", ">`/high,", "<>=x", "END", ", odd ,|"]
CONTRASTS = ["ð:z,d,v", "θ:s, t ,f", " l : ɹ", "s:", "i:ɪ,,ɛ"]


def tags(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def tag_cte(values: list[str], name: str = "tag") -> str:
    return (f"{name} AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
            f"{pick_sql(values, f'1 + l_partkey % {len(values)}')} AS label FROM lineitem)")


def with_label(spark, sf, values):
    return tags(spark, sf).withColumn("label", pick(values, f"1 + l_partkey % {len(values)}"))


def counted(df, *cols):
    """Rows per distinct combination: the whole table, small output."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


# -- B: labels ----------------------------------------------------------------------------

ARPA_SQL = "regexp_replace(trim({0}), '[012*]$', '')"
ARPA_OK = "trim({0}) NOT IN ('', 'SIL', 'SP', 'SPN', 'sil', 'sp', 'spn', 'err')"


@query(f"""WITH {tag_cte(ARPA)}, {values_sql('a', K.ARPABET)}
  SELECT label, CASE WHEN {ARPA_OK.format('label')} THEN a.v END AS phone,
    CASE WHEN NOT ({ARPA_OK.format('label')}) THEN 'not a phone label' WHEN a.v IS NULL THEN 'unknown phone' END AS reason,
    count(*) AS n FROM tag LEFT JOIN a ON a.k = {ARPA_SQL.format('label')} GROUP BY ALL""")
def b1_map_arpabet(spark, sf):
    return counted(L.map_arpabet(with_label(spark, sf, ARPA), "label"), "label", "phone", "reason")


SILENT = "(lower({0}) IN ('', 'sil', 'sp', 'err', 'spn'))"


def tier_sql(source: str, column: str) -> str:
    """source(.., column) -> distinct labels with their phone, computed by joins."""
    authored = {**K.ALIASES, **{p: p for p in K.CANONICAL}}
    clean = f"CASE WHEN length(rtrim(trim({column}), '012*)_`8')) = 0 THEN left(trim({column}), 1) ELSE rtrim(trim({column}), '012*)_`8') END"
    return f"""{values_sql('a', K.ARPABET)}, {values_sql('au', authored)},
  cl AS (SELECT DISTINCT {column} AS raw, {clean} AS c FROM {source}),
  ba AS (SELECT raw, c, CASE WHEN left(c, 1) = 'R' THEN 'R' ELSE c END AS b FROM cl),
  tierphone AS (SELECT raw, CASE WHEN {SILENT.format('trim(raw)')} OR {SILENT.format('c')} THEN NULL ELSE
     coalesce(CASE WHEN {ARPA_OK.format('b')} THEN a1.v END, CASE WHEN {ARPA_OK.format('upper(b)')} THEN a2.v END, au.v,
       CASE WHEN b = 'ɫ' THEN 'l' END) END AS phone,
     {SILENT.format('trim(raw)')} OR {SILENT.format('c')} AS silent
   FROM ba LEFT JOIN a a1 ON a1.k = {ARPA_SQL.format('b')} LEFT JOIN a a2 ON a2.k = {ARPA_SQL.format('upper(b)')}
   LEFT JOIN au ON au.k = translate(trim(b), 'ˈˌː./ ', ''))"""


@query(f"""WITH {tag_cte(TIER)}, {tier_sql('tag', 'label')}
  SELECT label, phone, CASE WHEN phone IS NULL AND NOT silent THEN 'unmappable label' END AS reason, count(*) AS n
  FROM tag JOIN tierphone ON raw = label GROUP BY ALL""")
def b2_map_tier_label(spark, sf):
    return counted(L.map_tier_label(with_label(spark, sf, TIER), "label"), "label", "phone", "reason")


@query(f"""WITH {tag_cte(AUTHORED)}, {values_sql('au', {**K.ALIASES, **{p: p for p in K.CANONICAL}})}
  SELECT label, v AS phone, count(*) AS n FROM tag LEFT JOIN au ON k = translate(trim(label), 'ˈˌː./ ', '') GROUP BY ALL""")
def b3_normalize_phone(spark, sf):
    rows = with_label(spark, sf, AUTHORED).withColumn("phone", S.normalize_phone("label"))
    return counted(rows, "label", "phone")


@query(f"""WITH {tag_cte(SAMPA)}, {values_sql('sa', {k: v for k, v in K.SAMPA.items() if k not in K.SAMPA_STRUCTURAL})}
  SELECT label, v AS phone, count(*) AS n FROM tag JOIN sa ON k = label GROUP BY ALL""")
def b4_map_sampa(spark, sf):
    return counted(L.map_sampa(with_label(spark, sf, SAMPA), "label"), "label", "phone")


VOCAB = {"<pad>": 3, "[PAD]": 1, "pad": 9}


def vocabulary(spark, sf):
    """A vocabulary with holes: one token per part key, and the blank spellings."""
    phones = sorted(set(K.STRESSLESS_VOCABULARY.values()))
    table = K.STRESSLESS_VOCABULARY
    parts = V.table(spark, sf, "part")
    tokens = parts.filter(f"p_partkey % 11 <> 4 AND p_partkey < {len(phones)}").select(
        pick(phones, "1 + p_partkey").alias("token"), (F.col("p_partkey") + 10).alias("token_id"))
    blanks = parts.filter("p_partkey < 3").select(
        pick(list(VOCAB), "1 + p_partkey").alias("token"),
        pick([str(v) for v in VOCAB.values()], "1 + p_partkey").cast("bigint").alias("token_id"))
    names = list(table)
    rows = parts.filter(f"p_partkey < {len(names)}").select(
        pick(names, "1 + p_partkey").alias("canonical"),
        pick(list(table.values()), "1 + p_partkey").alias("token"), F.col("p_partkey").alias("position"))
    required = parts.filter("p_partkey < 30").select(
        pick(K.CANONICAL[:30] if len(K.CANONICAL) >= 30 else K.CANONICAL, "1 + p_partkey").alias("canonical"))
    extra = parts.filter("p_partkey < 2").select(pick(["ə", "other"], "1 + p_partkey").alias("canonical"))
    return rows, tokens.unionByName(blanks), required.unionByName(extra)


def _vocab_cte() -> str:
    table = K.STRESSLESS_VOCABULARY
    phones = sorted(set(table.values()))
    tokens = ", ".join(f"('{p}', {i + 10})" for i, p in enumerate(phones) if i % 11 != 4)
    blanks = ", ".join(f"('{k}', {v})" for k, v in VOCAB.items())
    req = ", ".join(f"('{p}')" for p in [*K.CANONICAL[:30], "ə", "other"])
    tab = ", ".join(f"('{c}', '{t}', {i})" for i, (c, t) in enumerate(table.items()))
    return (f"tab(canonical, token, position) AS (VALUES {tab}), voc(token, token_id) AS (VALUES {tokens}, {blanks}), "
            f"req(canonical) AS (VALUES {req})")


@query(f"""WITH {_vocab_cte()}
  SELECT 'missing phone' AS kind, canonical AS item, CAST(NULL AS BIGINT) AS token_id FROM req WHERE canonical NOT IN (SELECT canonical FROM tab)
  UNION ALL SELECT DISTINCT 'absent token', token, NULL FROM tab WHERE token NOT IN (SELECT token FROM voc)
  UNION ALL SELECT 'shared token', token, NULL FROM req JOIN tab USING (canonical) GROUP BY token HAVING count(*) > 1
  UNION ALL SELECT 'blank', '', token_id FROM voc WHERE token = '<pad>'""")
def b5_bind_vocab(spark, sf):
    return L.bind_vocab(*vocabulary(spark, sf))


@query(f"""WITH {_vocab_cte()} SELECT token, (SELECT canonical FROM tab WHERE tab.token = voc.token ORDER BY position LIMIT 1)
  AS canonical, token_id FROM voc""")
def b5_inverse_lookup(spark, sf):
    rows, tokens, _ = vocabulary(spark, sf)
    return L.phone_of_token(rows, tokens)


TABLE_VOCAB_CTE = """tab AS (SELECT 'c' || (l_partkey % 200) AS canonical, min({'k': l_orderkey * 10 + l_linenumber, 't': 't' || (l_suppkey % 90)}).t AS token,
    min(l_orderkey) AS position FROM lineitem GROUP BY 1),
  voc AS (SELECT 't' || (p_partkey % 97) AS token, min(p_partkey) + 10 AS token_id FROM part WHERE p_partkey % 97 % 11 <> 4 GROUP BY 1
    UNION ALL SELECT '[PAD]', max(p_partkey) FROM part),
  req AS (SELECT DISTINCT 'c' || (s_suppkey % 230) AS canonical FROM supplier UNION SELECT DISTINCT 'c' || (195 + c_custkey % 12) FROM customer)"""


def table_vocabulary(spark, sf):
    """Phones and tokens of lineitem, a vocabulary of part, required phones of supplier and customer."""
    spelled = lambda mark, c, n: F.concat(F.lit(mark), (F.col(c) % n).cast("string"))
    rows = V.table(spark, sf, "lineitem").groupBy(spelled("c", "l_partkey", 200).alias("canonical")).agg(
        F.min(F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), spelled("t", "l_suppkey", 90).alias("t")))["t"].alias("token"),
        F.min("l_orderkey").alias("position"))
    parts = V.table(spark, sf, "part")
    tokens = parts.filter("p_partkey % 97 % 11 <> 4").groupBy(spelled("t", "p_partkey", 97).alias("token")).agg(
        (F.min("p_partkey") + 10).alias("token_id")).unionByName(
        parts.agg(F.max("p_partkey").alias("token_id")).select(F.lit("[PAD]").alias("token"), "token_id"))
    required = V.table(spark, sf, "supplier").select(spelled("c", "s_suppkey", 230).alias("canonical")).union(
        V.table(spark, sf, "customer").select(F.concat(F.lit("c"), (195 + F.col("c_custkey") % 12).cast("string")))).distinct()
    return rows, tokens, required


@query(f"""WITH {TABLE_VOCAB_CTE}
  SELECT 'missing phone' AS kind, canonical AS item, CAST(NULL AS BIGINT) AS token_id FROM req WHERE canonical NOT IN (SELECT canonical FROM tab)
  UNION ALL SELECT DISTINCT 'absent token', token, NULL FROM tab WHERE token NOT IN (SELECT token FROM voc)
  UNION ALL SELECT 'shared token', token, NULL FROM req JOIN tab USING (canonical) GROUP BY token HAVING count(*) > 1
  UNION ALL SELECT 'blank', '', token_id FROM voc WHERE token = '[PAD]'""")
def b5_bind_vocab_tables(spark, sf):
    return L.bind_vocab(*table_vocabulary(spark, sf))


@query(f"""WITH {TABLE_VOCAB_CTE}, f AS (SELECT token, canonical FROM tab QUALIFY row_number() OVER (PARTITION BY token ORDER BY position, canonical) = 1)
  SELECT voc.token, f.canonical, token_id FROM voc LEFT JOIN f USING (token)""")
def b5_inverse_lookup_tables(spark, sf):
    rows, tokens, _ = table_vocabulary(spark, sf)
    return L.phone_of_token(rows.withColumn("position", F.struct("position", "canonical")), tokens)


def tag_rows(spark, sf):
    return L.parse_tags(with_label(spark, sf, TAGS).withColumnRenamed("label", "text"), "text")


TAG_CTE = f"""{tag_cte(TAGS)}, sp AS (SELECT *, trim(label) AS raw0, length(label) - length(replace(label, ',', '')) AS commas,
   trim(string_split(label, ',')[1]) AS t, trim(string_split(label, ',')[2]) AS r, lower(trim(string_split(label, ',')[3])) AS c FROM tag),
  cd AS (SELECT *, CASE WHEN c IN ('s', 'sd') THEN 's' WHEN c IN ('d', 'd.') THEN 'd' WHEN c IN ('a', 'as') THEN 'a' END AS code FROM sp),
  words AS (SELECT raw0 AS w FROM cd UNION SELECT t FROM cd UNION SELECT r FROM cd WHERE r IS NOT NULL),
  {tier_sql('words', 'w')},
  ph AS (SELECT cd.*, CASE WHEN commas = 2 THEN p1.phone ELSE p0.phone END AS ph0, p2.phone AS real0 FROM cd
    LEFT JOIN tierphone p0 ON p0.raw = raw0 LEFT JOIN tierphone p1 ON p1.raw = t LEFT JOIN tierphone p2 ON p2.raw = r),
  st AS (SELECT *, {SILENT.format('raw0')} OR (commas = 2 AND code IS NOT NULL AND (code = 'a' OR lower(t) IN ('sil', 'sp'))) AS dropped,
    CASE WHEN {SILENT.format('raw0')} THEN NULL WHEN commas > 0 AND commas <> 2 THEN 'error: unparsable annotation'
      WHEN commas = 2 AND code IS NULL THEN 'unparsable tag code'
      WHEN commas = 2 AND NOT (code = 'a' OR lower(t) IN ('sil', 'sp')) AND ph0 IS NULL THEN 'error: tag target is not a phone'
      WHEN commas <> 2 AND ph0 IS NULL THEN 'unmappable label' END AS reason FROM ph),
  tg AS (SELECT *, CASE WHEN dropped THEN 'dropped' WHEN reason IS NOT NULL THEN 'bad' ELSE 'kept' END AS state FROM st)"""


@query(f"""WITH {TAG_CTE} SELECT label AS text, state, CASE WHEN state = 'kept' THEN ph0 END AS phone,
  CASE WHEN state = 'kept' THEN CASE WHEN commas <> 2 THEN 'correct' WHEN code = 's' THEN 'substituted' ELSE 'deleted' END END AS label,
  CASE WHEN state = 'kept' AND code = 's' THEN real0 END AS substituted_with, reason, count(*) AS n FROM tg GROUP BY ALL""")
def b6_parse_tags(spark, sf):
    return counted(tag_rows(spark, sf), "text", "state", "phone", "label", "substituted_with", "reason")


@query(f"""WITH {TAG_CTE} SELECT l_orderkey, ph0 AS phone, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS token_index FROM tg WHERE state = 'kept'""")
def b6_token_index(spark, sf):
    tagged = tag_rows(spark, sf).withColumn(
        "pos", F.expr("(l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey"))
    return L.token_sequence(tagged, "l_orderkey", "pos").select("l_orderkey", "phone", "token_index")


@query(f"""WITH {TAG_CTE} SELECT l_orderkey AS source, label AS raw, reason FROM tg WHERE state = 'bad'""")
def b16_quarantine(spark, sf):
    tagged = tag_rows(spark, sf)
    _, held = L.quarantine(tagged, F.col("state") == "bad", "l_orderkey", "text", F.col("reason"))
    return held


@query(f"""WITH {TAG_CTE} SELECT count(*) AS rows, count(*) FILTER (state = 'bad') AS held, count(*) FILTER (state <> 'bad') AS written FROM tg""")
def b16_quarantine_counts(spark, sf):
    """What a write of the good rows observes on its way."""
    seen = Observation("quarantine")
    good, _ = L.quarantine(tag_rows(spark, sf), F.col("state") == "bad", "l_orderkey", "text", F.col("reason"), seen)
    good.write.parquet(path := scratch(spark, "good"))
    counts = seen.get
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select(
        F.lit(counts["rows"]).cast("bigint").alias("rows"), F.lit(counts["held"]).cast("bigint").alias("held"), "written")


@query(f"""WITH {tag_cte(MARKED)}, b AS (SELECT label, regexp_replace(label, '^[<>]+', '') AS s FROM tag),
  m AS (SELECT *, CASE WHEN s LIKE '`/%' THEN 'fall_rise' WHEN left(s, 1) IN (chr(92), '`') THEN 'fall'
     WHEN left(s, 1) = '/' THEN 'rise' WHEN left(s, 1) = '=' THEN 'level' END AS tone,
     CASE WHEN s LIKE '`/%' THEN substr(s, 3) WHEN left(s, 1) IN (chr(92), '`', '/', '=') THEN substr(s, 2) ELSE s END AS rest FROM b)
  SELECT label, tone, trim(trim(replace(replace(rest, '|', ''), '#', ''), ', ')) AS text, count(*) AS n FROM m GROUP BY ALL""")
def b8_tone_mark(spark, sf):
    rows = with_label(spark, sf, MARKED).withColumn("m", S.tone_mark("label"))
    return counted(rows.select("label", "m.tone", "m.text"), "label", "tone", "text")


@query("""WITH p AS (SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, (1 + l_partkey % 9) / 10.0e0 AS t, (1 + l_suppkey % 9) / 10.0e0 AS z,
    (1 + l_linenumber % 3) / 10.0e0 AS d FROM lineitem)
  SELECT l_partkey % 9 AS a, l_suppkey % 9 AS b, l_linenumber AS c, round(ln((greatest(z, d) + 1e-12) / (t + 1e-12)), 6) AS score,
    CASE WHEN z >= d THEN 'z' ELSE 'd' END AS best, count(*) AS n FROM p GROUP BY ALL
  UNION ALL SELECT NULL, NULL, NULL, 0.0e0, NULL, count(*) FROM p""")
def b10_raw_score(spark, sf):
    part = lambda c, n: (1 + F.col(c) % n) / 10.0
    base = V.table(spark, sf, "lineitem")
    rows = base.select(
        (F.col("l_partkey") % 9).alias("a"), (F.col("l_suppkey") % 9).alias("b"), F.col("l_linenumber").alias("c"),
        F.create_map(F.lit("ð"), part("l_partkey", 9), F.lit("z"), part("l_suppkey", 9),
                     F.lit("d"), part("l_linenumber", 3)).alias("post"))
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    bare = base.select(none("a"), none("b"), none("c"), F.create_map(F.lit("ð"), F.lit(1.0)).alias("post"))
    scored = rows.unionByName(bare).withColumn("s", S.raw_score("post", F.lit("ð")))
    return counted(scored.select("a", "b", "c", F.round("s.score", 6).alias("score"), "s.best"),
                   "a", "b", "c", "score", "best")


@query(f"""WITH {tag_cte(CONTRASTS)} SELECT label, trim(split_part(label, ':', 1)) AS target,
  array_to_string(list_filter(list_transform(string_split(split_part(label, ':', 2), ','), lambda x: trim(x)), lambda x: x <> ''), '+') AS confusions,
  count(*) AS n FROM tag GROUP BY ALL""")
def b14_parse_contrast(spark, sf):
    rows = with_label(spark, sf, CONTRASTS).withColumn("c", S.parse_contrast("label"))
    return counted(rows.select("label", "c.target", F.array_join("c.confusions", "+").alias("confusions")),
                   "label", "target", "confusions")


# -- DOCW: documents as score files --------------------------------------------------------

PHONE_LIST = list(K.ARPABET)[:20]


FORMS = 60
"""Words whose lengths are equal modulo this have the same phones and expert strings."""


def spelled(length: int, expert: int | None = None) -> list[str] | str:
    """The phones of a word of some length, or the string that an expert writes for them."""
    phones = [PHONE_LIST[(length * 7 + i * 3) % len(PHONE_LIST)] for i in range(length % 3 + 1)]
    if expert is None:
        return phones
    marked = [f"{{{p}}}" if (length + i + expert) % 3 == 0 else p for i, p in enumerate(phones)]
    return " ".join(marked[:-1] if length % 5 == 0 and expert == 4 else marked)


def spread(table) -> int:
    """Partitions for rows that grow many times over: one for each 2 MB of the table's files, beyond the session's number of
    shuffle partitions one for each 16 MB."""
    size = int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return max(1, min(-(-size // (2 << 20)), max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (16 << 20))))


def score_files(spark, sf):
    """Every document rendered as two JSON lines: canonical phones and five expert strings."""
    forms = F.transform(F.split("text", " "), lambda w: (F.length(w) % FORMS).cast("tinyint"))
    table = V.table(spark, sf, "documents")
    docs = table.select("doc_id", forms.alias("forms")).repartition(spread(table), "doc_id")
    key = F.coalesce(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.raise_error(F.lit("a document without an id")).cast("string"))

    def as_json(per_word):
        lines = F.array(*[F.lit(json.dumps({"text": "w", "phones": per_word(n)}, separators=(",", ":"))) for n in range(FORMS)])
        words = F.array_join(F.transform("forms", lambda n: F.element_at(lines, n + F.lit(1))), ",")
        return docs.select(F.concat(
            F.lit('{"'), key, F.lit('":{'), F.coalesce(F.concat(F.lit('"words":['), words, F.lit("]")), F.lit("")), F.lit("}}")).alias("value"))

    return as_json(spelled), as_json(lambda n: [spelled(n, e) for e in range(5)])


DOCW_CTE = f"""wd AS (SELECT doc_id, length(w) AS len, w_i, unnest(range(length(w) % 3 + 1)) AS pos
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS w_i FROM documents)),
  tok AS (SELECT *, {pick_sql(PHONE_LIST, f"1 + (len * 7 + pos * 3) % {len(PHONE_LIST)}")} AS label,
    row_number() OVER (PARTITION BY doc_id ORDER BY w_i, pos) - 1 AS token_index,
    CAST((len + pos) % 3 = 0 AS INT) + CAST((len + pos + 1) % 3 = 0 AS INT) + CAST((len + pos + 2) % 3 = 0 AS INT)
      + CAST((len + pos + 3) % 3 = 0 AS INT) + CASE WHEN len % 5 <> 0 THEN CAST((len + pos + 4) % 3 = 0 AS INT) ELSE 0 END AS votes FROM wd)"""


def score_tokens(spark, sf):
    paths = []
    for name, lines in zip(("scores", "detail"), score_files(spark, sf)):
        paths.append(scratch(spark, name))
        lines.select("value").write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(paths[-1])
    return C.read_phone_scores(spark, *paths, lines=True)


@query(f"""WITH {DOCW_CTE} SELECT 'doc' || doc_id AS utterance_id, count(*) AS tokens, max(token_index) AS last_index,
  CAST(sum(token_index * (1 + w_i) + length(label) * pos) AS BIGINT) AS checksum FROM tok GROUP BY doc_id""")
def a3_phone_scores(spark, sf):
    rows = score_tokens(spark, sf)
    check = F.col("token_index").cast("bigint") * (1 + F.col("word_index")) + F.length("label") * F.col("position")
    return rows.groupBy("utterance_id").agg(
        F.count("*").alias("tokens"), F.max("token_index").alias("last_index"), F.sum(check).alias("checksum"))


@query(f"""WITH {DOCW_CTE} SELECT 'doc' || doc_id AS utterance_id, CAST(sum(votes) AS BIGINT) AS votes,
  count(*) FILTER (votes >= 3) AS errors FROM tok GROUP BY doc_id""")
def b7_expert_votes(spark, sf):
    votes = L.expert_votes(F.col("experts"), F.col("position"))
    rows = score_tokens(spark, sf).withColumn("votes", votes)
    return rows.groupBy("utterance_id").agg(
        F.sum("votes").alias("votes"), S.count_if(L.is_error(F.col("votes"))).alias("errors"))


# -- A: files -------------------------------------------------------------------------------


def long_files(spark, sf):
    g = V.grid(spark, sf)
    line = F.struct("idx", F.concat(
        F.lit("        intervals ["), (F.col("idx") + 1).cast("string"), F.lit("]:\n            xmin = "),
        F.col("xmin").cast("string"), F.lit("\n            xmax = "), F.col("xmax").cast("string"),
        F.lit('\n            text = "'), F.col("text"), F.lit('"\n')).alias("s"))
    files = g.groupBy("path").agg(F.sort_array(F.collect_list(line)).alias("l"), F.count("*").alias("n"))
    tier = lambda no, name: F.concat(
        F.lit(f'    item [{no}]:\n        class = "IntervalTier"\n        name = "{name}"\n        xmin = 0\n        xmax = 9\n'
              "        intervals: size = "), F.col("n").cast("string"), F.lit("\n"),
        F.array_join(F.transform("l", lambda x: x["s"]), ""))
    return files.select("path", F.concat(
        F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 9\ntiers? <exists>\nsize = 2\nitem []:\n'),
        tier(1, "words"), tier(2, "copy")).alias("value"))


@query(f"""WITH {V.GRID_CTE} SELECT path, tier, idx, xmin, xmax, text FROM grid, (SELECT unnest(['words', 'copy']) AS tier)""")
def a1_textgrid_long(spark, sf):
    return C.parse_textgrid_long(long_files(spark, sf))


FILES = 64
"""Files that the rows of a table are written to."""


def write_files(rows, order: list[str], path: str) -> str:
    """Write ``value`` lines of each ``file`` in the given order to one gzipped text file of its own."""
    rows.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.partitionBy(
        "file").option("compression", "gzip").text(path)
    return path


def file_number():
    return F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file")


def grid_rows(spark, sf):
    return V.grid(spark, sf).withColumn("file", F.col("l_orderkey") % FILES)


def heads(rows, *lines):
    """The first lines of every file."""
    return rows.groupBy("file").agg(F.countDistinct("l_orderkey").alias("orders")).select(
        "file", F.lit(-1).cast("bigint").alias("l_orderkey"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("idx"),
        F.concat_ws("\n", *lines).alias("value"))


@query(f"""WITH {V.GRID_CTE} SELECT l_orderkey % {FILES} AS file, path AS tier, idx, xmin, xmax, text FROM grid""")
def a1_textgrid_files(spark, sf):
    """Every order is a tier of one of the files."""
    rows = grid_rows(spark, sf)
    tier = F.concat(F.lit('    item [1]:\n        class = "IntervalTier"\n        name = "'), "path", F.lit(
        '"\n        xmin = 0\n        xmax = 9\n        intervals: size = 1\n'))
    interval = F.concat(
        F.lit("        intervals ["), (F.col("idx") + 1).cast("string"), F.lit("]:\n            xmin = "),
        F.col("xmin").cast("string"), F.lit("\n            xmax = "), F.col("xmax").cast("string"),
        F.lit('\n            text = "'), F.col("text"), F.lit('"'))
    body = rows.select("file", "l_orderkey", F.lit(1).alias("part"), "idx", F.concat(
        F.when(F.col("idx") == 0, tier).otherwise(""), interval).alias("value"))
    top = heads(rows, F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 9\ntiers? <exists>\nsize = 1\nitem []:'))
    folder = write_files(body.unionByName(top), ["l_orderkey", "part", "idx"], scratch(spark, "textgrid"))
    return T.read_textgrid_long(spark, folder).select(file_number(), "tier", "idx", "xmin", "xmax", "text")


@query(f"""WITH {V.GRID_CTE} SELECT l_orderkey % {FILES} AS file, 'interval' AS kind, path AS tier, idx, xmin, xmax, text FROM grid
  UNION ALL SELECT l_orderkey % {FILES}, 'point', 'm' || path, idx, xmin, xmin, 'M' FROM grid""")
def a2_textgrid_files(spark, sf):
    """Every order is an interval tier and a point tier of one of the files."""
    rows = grid_rows(spark, sf)
    sized = rows.withColumn("n", F.count("*").over(W.partitionBy("path")).cast("string"))

    def tier(kind: str, mark: str):
        return F.when(F.col("idx") == 0, F.concat(
            F.lit(f'"{kind}"\n"{mark}'), "path", F.lit('"\n0\n9\n'), "n", F.lit("\n"))).otherwise("")

    low, high = F.col("xmin").cast("string"), F.col("xmax").cast("string")
    wide = F.concat(tier("IntervalTier", ""), F.concat_ws("\n", low, high, F.concat(F.lit('"'), "text", F.lit('"'))))
    thin = F.concat(tier("TextTier", "m"), F.concat_ws("\n", low, F.lit('"M"')))
    parts = F.explode(F.array(F.struct(F.lit(1).alias("part"), wide.alias("value")), F.struct(F.lit(2).alias("part"), thin.alias("value"))))
    body = sized.select("file", "l_orderkey", "idx", parts.alias("p")).select("file", "l_orderkey", "p.part", "idx", "p.value")
    top = heads(rows, F.lit('File type = "ooTextFile short"\n"TextGrid"\n\n0\n9\n<exists>'), (2 * F.col("orders")).cast("string"))
    folder = write_files(body.unionByName(top), ["l_orderkey", "part", "idx"], scratch(spark, "textgrid"))
    return T.read_textgrid_short(spark, folder).select(file_number(), "kind", "tier", "idx", "xmin", "xmax", "text")


def short_files(spark, sf):
    g = V.grid(spark, sf)
    row = F.struct("idx", F.concat_ws("\n", F.col("xmin").cast("string"), F.col("xmax").cast("string"),
                                      F.concat(F.lit('"'), "text", F.lit('"'))).alias("s"),
                   F.concat_ws("\n", F.col("xmin").cast("string"), F.lit('"M"')).alias("p"))
    files = g.groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("l"), F.count("*").alias("n"))
    tier = lambda kind, name, field: F.concat(
        F.lit(f'"{kind}"\n"{name}"\n0\n9\n'), F.col("n").cast("string"), F.lit("\n"),
        F.array_join(F.transform("l", lambda x: x[field]), "\n"), F.lit("\n\n"))
    return files.select("path", F.concat(
        F.lit('File type = "ooTextFile short"\n"TextGrid"\n\n0\n9\n<exists>\n3\n'),
        tier("IntervalTier", "Text", "s"), tier("TextTier", "Intsint", "p"), tier("IntervalTier", "UI", "s"),
    ).alias("value"))


@query(f"""WITH {V.GRID_CTE} SELECT path, 'interval' AS kind, tier, idx, xmin, xmax, text FROM grid,
    (SELECT unnest(['Text', 'UI']) AS tier) UNION ALL SELECT path, 'point', 'Intsint', idx, xmin, xmin, 'M' FROM grid""")
def a2_textgrid_short(spark, sf):
    return C.parse_textgrid_short(short_files(spark, sf))


@query("SELECT 'wav' || doc_id AS key, source || '/' || lang AS value FROM documents")
def a4_kv_exact(spark, sf):
    lines = V.table(spark, sf, "documents").select(F.concat(
        F.lit(" wav"), "doc_id", F.lit("   "), "source", F.lit("/"), "lang", F.lit(" ")).alias("value"))
    lines.write.text(path := scratch(spark, "wav"))
    return C.read_kv_text(spark, path, exact=True)


@query("SELECT 'wav' || doc_id AS key, source || ' ' || lang || ' ' || n_chars AS value FROM documents")
def a4_kv_text(spark, sf):
    lines = V.table(spark, sf, "documents").select(
        F.concat_ws(" ", F.concat(F.lit("wav"), "doc_id"), "source", "lang", "n_chars").alias("value"))
    lines.write.text(path := scratch(spark, "text"))
    return C.read_kv_text(spark, path, exact=False)


@query("""SELECT lpad(CAST(doc_id % 1000 AS VARCHAR), 3, 'A') AS block, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, 'A')
  || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS passage, n_chars / 100.0e0 AS duration, doc_id AS ord FROM documents""")
def a5_durations(spark, sf):
    key = (F.col("doc_id") % 1000).cast("string")
    lines = V.table(spark, sf, "documents").select("doc_id", F.concat(
        F.lpad(key, 3, "A"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("B.SIG\t"),
        (F.col("n_chars") / 100.0).cast("string"), F.lit(" 16000")).alias("value"))
    return C.parse_durations(lines, F.col("doc_id"))


@query(f"""SELECT doc_id % {FILES} AS file, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, 'A') AS block, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, 'A')
  || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS passage, n_chars / 100.0e0 AS duration,
  row_number() OVER (PARTITION BY doc_id % {FILES} ORDER BY doc_id) - 1 AS ord FROM documents""")
def a5_duration_files(spark, sf):
    key = (F.col("doc_id") % 1000).cast("string")
    lines = V.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % FILES).alias("file"), F.concat(
        F.lpad(key, 3, "A"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("B.SIG\t"),
        (F.col("n_chars") / 100.0).cast("string"), F.lit(" 16000")).alias("value"))
    folder = write_files(lines, ["doc_id"], scratch(spark, "durations"))
    return T.read_durations(spark, folder).select(file_number(), "block", "passage", "duration", "ord")


@query("SELECT 'documents' AS key, true AS has_file UNION ALL SELECT 'lineitem', true UNION ALL SELECT 'events', true")
def a6_scan_media(spark, sf):
    files = C.scan_media(spark, sf, "{documents,lineitem,events}.parquet")
    return files.select("key", (F.col("length") > 0).alias("has_file"))


def recordings(rows, root: str) -> str:
    """Write a file below ``root`` for each (key, length); executors write to the shared folder."""
    def write(batches):
        fs, place = pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for key, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(f"{place}/{length % 7}", recursive=True)
                with fs.open_output_stream(f"{place}/{length % 7}/{key}.wav") as out:
                    out.write(b"0" * length)
            yield batch.slice(0, 0)

    rows.select("key", "length").mapInArrow(write, "key string, length bigint").count()
    return root


@query("""SELECT 'spk' || s_suppkey AS key, CASE WHEN s_suppkey % 5 <> 2 THEN 40 + s_suppkey % 300 END AS length, s_suppkey % 5 = 2 AS missing FROM supplier""")
def a6_recordings(spark, sf):
    """A file for four of five speakers, in several folders; the others' are missing."""
    speakers = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("spk"), F.col("s_suppkey").cast("string")).alias("key"), (40 + F.col("s_suppkey") % 300).alias("length"), "s_suppkey")
    root = recordings(speakers.filter("s_suppkey % 5 <> 2"), scratch(spark, "media"))
    media = C.scan_media(spark, root, "*.wav")
    missing = C.missing_media(speakers.select("key"), media, "key")
    return media.select("key", "length", F.lit(False).alias("missing")).unionByName(
        missing.select("key", F.lit(None).cast("bigint").alias("length"), F.lit(True).alias("missing")))


@query(f"WITH {V.LI_INDEXED_SPLIT_CTE} SELECT split, label, count(*) AS n, count(score) AS scored, "
       f"round(sum(score), 4) AS total, count(*) FILTER (audio_problem) AS problems FROM lis GROUP BY ALL")
def a7_read_records(spark, sf):
    lines = with_verdicts(V.li_split(spark, sf, indexed=True)).select(
        F.to_json(F.struct(*[f.name for f in schemas.TOKEN_RECORD])).alias("value"))
    rows = C.records_from_json(lines)
    return rows.groupBy("split", "label").agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.round(F.sum("score"), 4).alias("total"),
        S.count_if(F.col("audio_problem")).alias("problems"))


@query("""SELECT 'c' || doc_id AS id, source AS client_id, lang AS text, CAST(n_chars AS VARCHAR) AS tokens,
  source || '/' || doc_id || '.wav' AS audio_path FROM documents""")
def a11_drop_repeated_headers(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        F.concat(F.lit("c"), "doc_id").alias("id"), F.col("source").alias("client_id"), F.col("lang").alias("text"),
        F.col("n_chars").cast("string").alias("tokens"), F.concat("source", F.lit("/"), "doc_id", F.lit(".wav")).alias("audio_path"))
    heads = V.table(spark, sf, "documents").select(*[F.lit(c).alias(c) for c in docs.columns])
    docs.unionByName(heads).write.csv(path := scratch(spark, "manifest"), header=True)
    return C.read_manifest(spark, path)


# -- C: joins -------------------------------------------------------------------------------


def utterance_rows(spark, sf):
    return V.li(spark, sf).groupBy("utterance_id").agg(*[
        F.min(c).alias(c) for c in ("l1", "corpus", "speaker", "native_split")])


def speaker_roster(spark, sf):
    return utterance_rows(spark, sf).filter("speaker IS NOT NULL AND l1 IS NOT NULL").select("speaker", "l1").distinct()


@query(f"""WITH {V.LI_INDEXED_SPLIT_CTE}, ph AS (SELECT a.utterance_id, a.token_index, string_agg(b.token_index || ':' || b.phone ||
    CASE WHEN b.token_index = a.token_index THEN '*z+d+v' ELSE '' END, ' ' ORDER BY b.token_index) AS phones
    FROM lis a JOIN lis b ON b.utterance_id = a.utterance_id WHERE a.phone = 'ð' GROUP BY ALL)
  SELECT utterance_id, token_index, label, l1, corpus, speaker, split, phones FROM lis JOIN ph USING (utterance_id, token_index)""")
def c1_collect_tokens(spark, sf):
    tokens = V.li_indexed(spark, sf).select("utterance_id", "token_index", "phone", "label")
    found = R.collect_tokens(utterance_rows(spark, sf), tokens, "ð", V.CONFUSIONS, speaker_roster(spark, sf))
    text = F.transform("phones", lambda p: F.concat(
        p["index"].cast("string"), F.lit(":"), p["ph"], F.when(p["focus"], F.concat(
            F.lit("*"), F.array_join(p["confusions"], "+"))).otherwise("")))
    return found.select("utterance_id", "token_index", "label", "l1", "corpus", "speaker", "split", F.array_join(text, " ").alias("phones"))


@query(f"""WITH {V.LI_INDEXED_CTE} SELECT utterance_id, string_agg(token_index || ':' || phone || CASE WHEN phone = 'ð'
   THEN '*z+d+v' ELSE '' END, ' ' ORDER BY token_index) AS phones FROM li GROUP BY utterance_id""")
def b17_expected_phones(spark, sf):
    packed = R.expected_phones(V.li_indexed(spark, sf), "ð", V.CONFUSIONS)
    text = F.transform("phones", lambda p: F.concat(
        p["index"].cast("string"), F.lit(":"), p["ph"], F.when(p["focus"], F.concat(
            F.lit("*"), F.array_join(p["confusions"], "+"))).otherwise("")))
    return packed.select("utterance_id", F.array_join(text, " ").alias("phones"))


@query(f"""WITH {V.LI_INDEXED_CTE} SELECT utterance_id, token_index FROM li GROUP BY utterance_id, token_index
   HAVING count(*) FILTER (alignment = 'ok') = 0""")
def c2_pending(spark, sf):
    rows = V.li_indexed(spark, sf).select("utterance_id", "token_index", "alignment")
    return R.pending(rows, rows.filter("alignment = 'ok'"), ["utterance_id", "token_index"]).drop("alignment")


@query("SELECT s_suppkey, n_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey "
       "JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def c3_lookup(spark, sf):
    suppliers = V.table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    named = R.lookup(suppliers, V.table(spark, sf, "nation"), "n_nationkey", "n_name")
    rows = V.table(spark, sf, "lineitem").join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return counted(rows, "s_suppkey", "n_name")


@query(f"""WITH {V.LI_INDEXED_SPLIT_CTE} SELECT utterance_id, token_index, phone, score FROM lis
  WHERE split = 'train' AND label = 'correct' AND score IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY score DESC, utterance_id, token_index) <= 1000""")
def c8_restrict(spark, sf):
    # numbered once: the keys and the rows both come from a table of the few columns that either needs
    rows = store(V.li_split(spark, sf, indexed=True).select(
        "utterance_id", "token_index", "phone", "label", "split", "score"))
    keys = SP.hard_negatives(rows, 1000)
    return R.restrict(rows, keys, ["utterance_id", "token_index"]).select(
        "utterance_id", "token_index", "phone", "score")


@query("""WITH plan AS (SELECT p_partkey AS item_id, p_name AS text, r AS rep, p_partkey || '_' || r AS take FROM part, (SELECT unnest([1, 2, 3]) AS r))
  SELECT item_id, text, rep, take, CASE WHEN item_id % 13 = rep THEN 'excluded' WHEN item_id % 3 <> rep % 3 THEN 'present' ELSE 'missing' END AS status FROM plan""")
def c9_plan_takes(spark, sf):
    parts = V.table(spark, sf, "part")
    items = parts.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    takes = parts.select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("r"))
    take = F.concat_ws("_", "p_partkey", "r").alias("take")
    have = takes.filter("p_partkey % 3 <> r % 3").select(take)
    drop = takes.filter("p_partkey % 13 = r").select(take)
    return R.plan_takes(items, 3, have, drop)


def exercises(spark, sf):
    return V.view(spark, sf, X.PART_SQL, "part").select(*X.shaped())


@query(X.PART_CTE + """ SELECT id, 'pair_with matches no exercise' AS rule FROM ex WHERE pair_with IS NOT NULL AND pair_with NOT IN (SELECT id FROM ex)
  UNION ALL SELECT id, 'duplicate id' FROM ex GROUP BY id HAVING count(*) > 1""")
def c10_check_refs(spark, sf):
    return R.check_refs(exercises(spark, sf))


@query(X.PART_CTE + X.RULES_SQL)
def k3_validate_exercises(spark, sf):
    return X.validate_exercises(exercises(spark, sf))


@query(X.PART_CTE + """ SELECT p_partkey, id, reference_audio, coalesce(reference_audio IN ('audio/a.wav', 'audio/../a.wav'), false) AS has_reference_audio,
  '0:ð' || CASE WHEN n_focus >= 1 THEN '*' ELSE '' END || ' 1:ɡ' || CASE WHEN n_focus >= 2 THEN '*' ELSE '' END || CASE WHEN odd = 'Q' THEN ' 2:-' ELSE ' 2:i' END AS phones FROM ex""")
def k4_exercise_detail(spark, sf):
    rows = V.view(spark, sf, X.PART_SQL, "part").select("p_partkey", *X.shaped())
    media = rows.filter(F.col("reference_audio").isin("audio/a.wav", "audio/../a.wav")).select(F.col("reference_audio").alias("path"))
    text = F.transform("phones", lambda p: F.concat(
        p["index"].cast("string"), F.lit(":"), F.coalesce(p["ph"], F.lit("-")), F.when(p["focus"], "*").otherwise("")))
    return X.exercise_detail(rows, media).select("p_partkey", "id", "reference_audio", "has_reference_audio", F.array_join(text, " ").alias("phones"))


@query(X.PART_CTE + """ SELECT id, type, title, text, focus AS focus_phone FROM ex""")
def k4_exercise_catalog(spark, sf):
    return X.exercise_catalog(exercises(spark, sf)).select("id", "type", "title", "text", "focus_phone")


@query(f"""WITH {V.LI_INDEXED_CTE} SELECT utterance_id, token_index, CASE WHEN token_index <= l_linenumber AND gop IS NOT NULL
   THEN gop END AS phone_gop, CASE WHEN gop IS NULL THEN 'token not aligned' END AS reason FROM li""")
def c12_join_aligned(spark, sf):
    rows = V.li_indexed(spark, sf)
    phones = rows.filter(F.col("gop").isNotNull()).select(
        "utterance_id", "token_index",
        F.when(F.col("token_index") <= F.col("l_linenumber"), F.col("gop")).alias("phone_gop"))
    return R.join_aligned(rows.select("utterance_id", "token_index"), phones)


@query(f"""WITH {V.LI_CTE} SELECT audio_path, CASE WHEN l_quantity < 2 THEN 'failed' WHEN l_quantity = 5 THEN 'failed' WHEN l_quantity = 6 THEN 'failed'
    WHEN 1 - l_quantity / 50.0e0 < 0.3e0 THEN 'failed' WHEN 1 - l_quantity / 50.0e0 < 0.55e0 THEN 'low_confidence' ELSE 'ok' END AS status,
  CASE WHEN l_quantity < 2 THEN '{K.NO_SPEECH}' WHEN l_quantity = 5 THEN 'clipping' WHEN l_quantity = 6 THEN '{K.NO_SIGNAL}'
    WHEN 1 - l_quantity / 50.0e0 < 0.3e0 THEN '{K.BELOW_FLOOR}' END AS reason FROM li0""")
def b13_alignment_status(spark, sf):
    q = F.col("l_quantity")
    status = R.alignment_status(q >= 2, q == 5, q == 6, 1 - q / 50.0)
    return V.li(spark, sf).withColumn("s", status).select("audio_path", "s.status", "s.reason")


@query("""WITH u AS (SELECT doc_id, 'read' AS corpus, lang AS l1, text AS transcript FROM documents WHERE lang = 'en'
   UNION ALL SELECT doc_id, 'wild', NULL, text FROM documents WHERE lang <> 'en'
   UNION ALL SELECT conv_id, 'talk', NULL, text FROM conversations)
  SELECT corpus, l1, count(*) AS n, CAST(sum(length(transcript)) AS BIGINT) AS chars FROM u WHERE trim(coalesce(transcript, '')) <> '' GROUP BY ALL""")
def j1_union_corpora(spark, sf):
    rows = load_registered(spark, sf)
    return rows.groupBy("corpus", "l1").agg(F.count("*").alias("n"), F.sum(F.length("transcript")).alias("chars"))


def load_registered(spark, sf):
    text = F.col("text").alias("transcript")
    registry.register_corpus("read", lambda s, r: V.table(s, r, "documents").filter("lang = 'en'").select(
        F.col("doc_id").alias("utterance_id"), F.lit("read").alias("corpus"), F.col("lang").alias("l1"), text))
    registry.register_corpus("wild", lambda s, r: V.table(s, r, "documents").filter("lang <> 'en'").select(
        F.col("doc_id").alias("utterance_id"), F.lit("wild").alias("corpus"), text))
    registry.register_corpus("talk", lambda s, r: V.table(s, r, "conversations").select(
        F.col("conv_id").alias("utterance_id"), F.lit("talk").alias("corpus"), text))
    return registry.load_corpora(spark, {"read": sf, "wild": sf, "talk": sf})


@query("SELECT corpus, n FROM (SELECT 'read' AS corpus, count(*) FILTER (lang = 'en' AND trim(text) <> '') AS n FROM documents UNION ALL "
       "SELECT 'wild', count(*) FILTER (lang <> 'en' AND trim(text) <> '') FROM documents UNION ALL "
       "SELECT 'talk', count(*) FILTER (trim(text) <> '') FROM conversations)")
def m1_registered_corpora(spark, sf):
    return counted(load_registered(spark, sf), "corpus")


@query(f"""WITH {tag_cte(MARKED)}, {values_sql('au', {**K.ALIASES, **{p: p for p in K.CANONICAL}})},
  b AS (SELECT label, {pick_sql(AUTHORED, f'1 + l_suppkey % {len(AUTHORED)}')} AS authored,
    {pick_sql(CONTRASTS, f'1 + l_linenumber % {len(CONTRASTS)}')} AS spec, l_suppkey FROM tag)
  SELECT label, authored, CASE WHEN regexp_replace(label, '^[<>]+', '') LIKE '`/%' THEN 'fall_rise'
      WHEN left(regexp_replace(label, '^[<>]+', ''), 1) IN (chr(92), '`') THEN 'fall'
      WHEN left(regexp_replace(label, '^[<>]+', ''), 1) = '/' THEN 'rise'
      WHEN left(regexp_replace(label, '^[<>]+', ''), 1) = '=' THEN 'level' END AS tone,
    v AS phone, CASE WHEN {V.bucket_sql('authored')} < 5 THEN 'val' ELSE 'train' END AS client,
    trim(split_part(spec, ':', 1)) AS target, round({sig('1.5e0', '0.25e0', 'length(label)')}, 6) AS p, count(*) AS n
  FROM b LEFT JOIN au ON k = translate(trim(authored), 'ˈˌː./ ', '') GROUP BY ALL""")
def m2_sql_functions(spark, sf):
    S.register_functions(spark)
    rows = with_label(spark, sf, MARKED).withColumns({
        "authored": pick(AUTHORED, f"1 + l_suppkey % {len(AUTHORED)}"),
        "spec": pick(CONTRASTS, f"1 + l_linenumber % {len(CONTRASTS)}")})
    return spark.sql(
        "SELECT label, authored, tone_of(label) AS tone, normalize_phone(authored) AS phone, client_split(authored) AS client, "
        "contrast_target(spec) AS target, round(platt_prob(CAST(length(label) AS DOUBLE), 1.5D, 0.25D), 6) AS p, count(*) AS n "
        "FROM {rows} GROUP BY ALL", rows=rows)
