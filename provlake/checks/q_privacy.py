"""Checks of redaction and language."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks.registry import query
from provlake.checks.sqlviews import lit, pick, register
from provlake.functions.fields import pack
from provlake.operators import privacy as P

A = lambda ch, n: ch * n
NL = "' || CHR(10) || '"
PLANTS = [  # planted text, what must stand in its place, ledger kind
    ("key AKIA" + A("Q", 16) + " end", "key [REDACTED:aws-access-key-id] end", "credential"),
    ("(sk-" + A("a1", 12) + ")", "([REDACTED:api-key])", "credential"),
    ("ghp_" + A("z", 36) + " rk-" + A("b", 20), "[REDACTED:github-token] [REDACTED:api-key]", "credential"),
    ("auth eyJhbGci.eyJzdWIi.c2lnbmF0 x", "auth [REDACTED:jwt] x", "credential"),
    ("-----BEGIN RSA PRIVATE KEY-----" + NL + "MIIabc@def.com" + NL + "-----END RSA PRIVATE KEY-----" + NL + "after",
     "[REDACTED:private-key-block]after", "credential"),
    ("see C:\\Users\\alice smith\\m.bin, ok", "see [OUT-OF-SCOPE-PATH], ok", "absolute_path"),
    ("at \\\\srv\\share\\x ok; D:/a", "at [OUT-OF-SCOPE-PATH] ok; [OUT-OF-SCOPE-PATH]", "absolute_path"),
    ("mail bob.b+x@ex-ample.co.uk. and a@b and c@d.x1", "mail [REDACTED:email]. and a@b and c@d.x1", "email_address"),
    ("xoxb-" + A("1", 10) + " my_hf_" + A("k", 40), "[REDACTED:slack-token] my_hf_" + A("k", 40), "credential"),
    ("hf_" + A("k", 20) + " sk-short", "hf_" + A("k", 20) + " sk-short", None),
    ("plain words", "plain words", None),
]


def planted(col: int) -> str:
    arms = " ".join(f"WHEN {i} THEN {lit(p[col]).replace(lit(NL)[1:-1], NL)}" for i, p in enumerate(PLANTS))
    return f"CASE doc_id % 11 {arms} END"


def plant_sql(col: int) -> str:
    """Backslashes are written with CHR so that both dialects read the same text."""
    return planted(col).replace("\\", "' || CHR(92) || '")


register("v_text", f"SELECT source AS case_id, doc_id, {plant_sql(0)} || ' ' || text AS text, text AS body, {plant_sql(1)} AS expected FROM {{documents}}")
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[.][A-Za-z]{{2,24}}"
BODY = f"REGEXP_REPLACE(body, '({MAIL})([.]*(?:[^A-Za-z0-9.-]|$))', '[REDACTED:email]\\2', 'g')"
N_MAIL = f"LEN(REGEXP_EXTRACT_ALL(body, '({MAIL})([.]*(?:[^A-Za-z0-9.-]|$))', 1))"


@query("scrub_text", f"SELECT doc_id, expected || ' ' || {BODY} AS scrubbed FROM {{v_text}}")
def scrub_text(get):
    return get("v_text").select("doc_id", P.scrub_text(F.col("text")).alias("scrubbed"))


N_PLANT = pick("doc_id % 11", [1, 1, 2, 1, 1, 1, 2, 1, 1, 0, 0])
PLANT_KIND = pick("doc_id % 11", [p[2] for p in PLANTS])
register("o_hit", f"""SELECT case_id, {PLANT_KIND} AS kind, {N_PLANT} AS n FROM {{v_text}}
UNION ALL SELECT case_id, 'email_address', {N_MAIL} FROM {{v_text}}""")


@query("redaction_ledger", """SELECT case_id, CASE kind WHEN 'absolute_path' THEN 'CL-PRIV-003' ELSE 'CL-PRIV-001' END AS rule_id, kind, CAST(SUM(n) AS BIGINT) AS redactions
FROM {o_hit} WHERE kind IS NOT NULL AND n > 0 GROUP BY case_id, kind""")
def redaction_ledger(get):
    return P.redaction_ledger(get("v_text"))


HITS = [(0, "AKIA"), (1, "sk-"), (2, "ghp_"), (2, "rk-"), (8, "xoxb-")]


@query("token_hits", " UNION ALL ".join(f"SELECT doc_id, '{s}' AS shape, 1 AS hits FROM {{v_text}} WHERE doc_id % 11 = {m}" for m, s in HITS))
def token_hits(get):
    return P.token_hits(get("v_text"), "doc_id")


register("v_keyed", f"""SELECT doc_id, source AS case_id, {pick('doc_id % 9', ['api_key', 'Tokenizer_class', 'key_dim', 'DB_PASSWORD', 'public_key', 'x', 'conn_str', 'session_id', 'note'])} AS key,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ' ' || doc_id END AS value FROM {{documents}}""")
SENS = "doc_id % 9 IN (0, 1, 3, 6, 7) AND value <> ''"


@query("sensitive_keys", f"SELECT doc_id, key, CASE WHEN {SENS} THEN '{V.REDACTED_BY_KEY}' ELSE value END AS shown FROM {{v_keyed}}")
def sensitive_keys(get):
    return get("v_keyed").select("doc_id", "key", P.scrub_field(F.col("key"), F.col("value")).alias("shown"))


@query("full_ledger", f"""
SELECT case_id, 'CL-PRIV-001' AS rule_id, 'sensitive_key_value' AS kind, COUNT(*) AS redactions FROM {{v_keyed}} WHERE {SENS} GROUP BY case_id
UNION ALL SELECT case_id, 'CL-PRIV-004', 'submitter_exclusion', COUNT(*) FROM {{v_keyed}} WHERE doc_id % 5 = 0 GROUP BY case_id
UNION ALL SELECT case_id, CASE kind WHEN 'absolute_path' THEN 'CL-PRIV-003' ELSE 'CL-PRIV-001' END, kind, CAST(SUM(n) AS BIGINT)
FROM {{o_hit}} WHERE kind IS NOT NULL AND n > 0 GROUP BY case_id, kind""")
def full_ledger(get):
    return P.full_ledger(get("v_text"), get("v_keyed"), get("v_keyed").where("doc_id % 5 = 0").select("case_id"))


@query("email_hits", f"""SELECT doc_id, UNNEST(REGEXP_EXTRACT_ALL(text, '({MAIL})(?:[.]*(?:[^A-Za-z0-9.-]|$))', 1)) AS email FROM {{documents}}""")
def email_hits(get):
    return P.email_hits(get("documents"), "doc_id")


# every document gives a path with its first word of nine letters or more as the account, so a case has many names, which stand in many texts
register("v_home", """SELECT source AS case_id, CASE doc_id % 4 WHEN 0 THEN 'C:' || CHR(92) || 'Users' || CHR(92) || 'User' || source || CHR(92) || 'x'
  WHEN 1 THEN '/home/al/' || source WHEN 2 THEN '/mnt/home/' || REGEXP_EXTRACT(text, '[A-Za-z0-9_]{{9,}}', 0) ELSE 'D:/Users/' || REGEXP_EXTRACT(text, '[A-Za-z0-9_]{{9,}}', 0) || '/y' END AS path FROM {documents}""")
register("v_said", "SELECT source AS case_id, doc_id, text AS body, text || ' by USER' || source || ', not user' || source || 'x or al' AS text FROM {documents}")
register("o_name", """SELECT case_id, LIST(DISTINCT name) AS names FROM (SELECT source AS case_id, LOWER(REGEXP_EXTRACT(text, '[A-Za-z0-9_]{{9,}}', 0)) AS name FROM {documents} WHERE doc_id % 4 > 1
  UNION ALL SELECT source, LOWER('user' || source) FROM {documents} WHERE doc_id % 4 = 0) t WHERE name <> '' GROUP BY case_id""")


@query("username_alias", f"""SELECT s.case_id, doc_id, ARRAY_TO_STRING(LIST_TRANSFORM(REGEXP_EXTRACT_ALL({BODY} || ' by USER' || s.case_id || ', not user' || s.case_id || 'x or al', '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda x: CASE WHEN LIST_CONTAINS(names, LOWER(x)) THEN '[USER]' ELSE x END), '') AS text FROM {{v_said}} s LEFT JOIN {{o_name}} n ON n.case_id = s.case_id""")
def username_alias(get):
    return P.username_alias(get("v_said").drop("body"), get("v_home"))


register("v_claim", f"""SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {pick('doc_id % 7', ['a vendor-supplied note. ', 'It is Certified; never lied. ', 'Authentication works. ', '100% accurate, 99% sure. ', 'We have PROOF THAT x. ', 'scam_x and a-scam-b. ', 'guaranteed fraud. '])} END || text AS said FROM {{documents}}""")
WORD_CASES = " ".join(f"WHEN REGEXP_MATCHES(l, '(^|[^a-z0-9_A-Z]){w}($|[^a-z0-9_A-Z])') THEN '{w}'" for w in V.FORBIDDEN_WORDS)
PHRASE_CASES = " ".join(f"WHEN CONTAINS(l, '{p}') THEN '{p}'" for p in V.FORBIDDEN_PHRASES)


@query("forbidden_language", f"SELECT doc_id, CASE {WORD_CASES} {PHRASE_CASES} END AS word FROM (SELECT doc_id, LOWER(said) AS l FROM {{v_claim}}) t")
def forbidden_language(get):
    return get("v_claim").select("doc_id", P.forbidden_language(F.col("said")).alias("word"))


SECRETS = ["AKIA" + A("Q", 16), "sk-" + A("a1", 12), "bob.b+x@ex-ample.co.uk", "alice smith", "MIIabc"]


@query("leak_check", "SELECT 0 AS leaking_rows, COUNT(*) AS planted_rows FROM {v_text} WHERE doc_id % 11 IN (0, 1, 4, 5, 7)")
def leak_check(get):
    t = get("v_text")
    after = t.withColumn("text", P.scrub_text(F.col("text")))
    mark = lambda df, a, b: P.leak_check(df, ["text"], SECRETS).select(F.lit(a).alias("a"), F.lit(b).alias("b"))
    return (mark(after, 1, 0).unionByName(mark(t, 0, 1))
            .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("leaking_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("planted_rows")))


@query("field_scrub", f"""SELECT doc_id, CASE WHEN {SENS} THEN '{V.REDACTED_BY_KEY}' ELSE value END AS named, '[OUT-OF-SCOPE-PATH]' AS token_path, '{V.REDACTED_BY_KEY}' AS tokenizer_class,
   doc_id AS size, expected AS note FROM (SELECT k.*, t.expected FROM {{v_keyed}} k JOIN {{v_text}} t ON t.doc_id = k.doc_id) x""")
def field_scrub(get):
    t = get("v_keyed").join(get("v_text").select("doc_id", F.expr("substr(text, 1, length(text) - length(body) - 1)").alias("plant")), "doc_id")
    facts = t.select("doc_id", "key", F.map_concat(F.map_from_arrays(F.array("key"), F.array(F.expr(
        "named_struct('i', cast(null as bigint), 'num', cast(null as string), 's', value, 'b', cast(null as boolean), 'l', cast(null as array<string>))"))),
        pack({"token_path": ("s", "concat('C:/m/', doc_id)"), "tokenizer_kind": ("s", "'Llama'"), "size": ("i", "doc_id"), "remark": ("s", "plant")})).alias("fields"))
    f = P.field_scrub(facts)
    at = lambda k: F.try_element_at("fields", k)
    return f.select("doc_id", at(F.col("key"))["s"].alias("named"), at(F.lit("token_path"))["s"].alias("token_path"),
                    at(F.lit("tokenizer_kind"))["s"].alias("tokenizer_class"), at(F.lit("size"))["i"].alias("size"), at(F.lit("remark"))["s"].alias("note"))


