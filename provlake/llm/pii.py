"""Personal data: patterns propose spans, validators confirm them, context words adjust a score.

Only DataFrame functions are used.  ``split`` gives what lies between the matches of a pattern and
``regexp_extract_all`` the matches, so running sums of their lengths give every span.  The patterns are written with
possessive repeats and begin only where a run begins (or where the last match ended), which finds
the same matches as the plain forms in one pass over any text.

Kinds with a fixed rule (email, ip, card, phone) are kept whenever their check holds.  Further kinds (bank account
numbers by mod-97, national numbers, secrets) start from a score for the form, gain by a passed checksum and by a
context word of their kind shortly before, and are kept from ``keep_from`` on.

Edge cases: a null text is an empty text and has no spans; matches that fail their check are dropped and not tried
again; spans of different kinds may overlap and are all listed; repeated rows are judged each; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import let

# fixed values: the patterns of the contract, in linear-time form
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,64})(?![A-Za-z0-9])"

KINDS = ["email", "ip", "card", "phone", "iban", "national", "secret"]
CONTEXT = {
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "national": r"(?i)\b(?:ssn|social security|sozialversicherung|sécurité sociale|seguridad social)\b",
    "secret": r"(?i)(?:token|password|passwd|secret|key|passwort|contraseña|mot de passe)[\x20:=\"']*$",
}
CONTEXT_CHARS = 40


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    digits = F.reverse(F.filter(F.split(value, ""), lambda d: d != ""))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        let(d.cast("int") * 2, lambda x: F.when(x > 9, x - 9).otherwise(x)))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Does an account number pass the mod-97 check?  Letters count as two digits, the first four characters go last."""
    bare = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    parts = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int"))
                        .otherwise(F.ascii(c) - 55))
    return F.aggregate(parts, F.lit(0), lambda a, d: F.when(d > 9, (a * 100 + d) % 97).otherwise((a * 10 + d) % 97)) == 1


def octets(value: Column) -> Column:
    """Are all parts at most 255?  Leading zeros do not count."""
    return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda b: (F.length(b) < 3) | (
        (F.length(b) == 3) & (b <= "255"))))


def found(text: Column, pattern: str, needs: Column) -> Column:
    """``array<struct<start, value>>`` of the leftmost non-overlapping matches; ``needs`` is a cheap test that all matches pass."""
    spans = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")),
                lambda x: F.aggregate(
                    F.arrays_zip(x["m"], F.slice(x["g"], F.lit(1), F.size(x["m"]))),
                    F.struct(F.lit(0).alias("at"), none_spans().alias("out")),
                    lambda a, e: F.struct(
                        (a["at"] + F.length(e["1"]) + F.length(e["m"])).alias("at"),
                        F.concat(a["out"], F.array(F.struct((a["at"] + F.length(e["1"])).alias("start"), e["m"].alias("value")))).alias("out")))["out"])
    return F.when(needs, spans).otherwise(none_spans())


def none_spans() -> Column:
    return F.array().cast("array<struct<start:int,value:string>>")


def checked(kind: str, value: Column) -> Column:
    """The kind's own check of a match."""
    n = F.length(digits_of(value))
    return {"email": F.lit(True), "ip": octets(value), "card": n.between(14, 19) & luhn(digits_of(value)),
            "phone": n.between(10, 15), "iban": mod97(value), "national": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
            "secret": value.rlike("[0-9]") & value.rlike("[A-Za-z]")}[kind]


def score(kind: str, text: Column, start: Column, value: Column) -> Column:
    """Score of a match of one of the further kinds that passed its check, from 0 to 1."""
    begin = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = F.substr(text, begin + 1, start - begin).rlike(CONTEXT[kind]).cast("double")
    form = {"iban": F.lit(0.6), "national": F.lit(0.2), "secret": F.when(value.startswith("AKIA"), 0.7).otherwise(0.1)}[kind]
    return form + 0.4 * near


def with_spans(docs: DataFrame, text: str = "text", keep_from: float = 0.5, name: str = "pii") -> DataFrame:
    """Add ``name``: ``array<struct<start, kind_no, end, score>>`` in code points, end exclusive, by start and then kind."""
    t = F.col("_text")
    needs = {"email": F.contains(t, F.lit("@")), "ip": F.contains(t, F.lit(".")), "card": F.lit(True), "phone": F.contains(t, F.lit("+")),
             "iban": F.lit(True), "national": F.contains(t, F.lit("-")), "secret": F.lit(True)}
    patterns = dict(zip(KINDS, [EMAIL, IP, CARD, PHONE, IBAN, NATIONAL, SECRET], strict=True))
    out = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    # texts without a digit can hold an e-mail address only
    out = out.withColumn("_digit", t.rlike("[0-9]"))
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", found(t, patterns[kind], needs[kind] if kind == "email" else F.col("_digit") & needs[kind]))

    def kept(no, kind):
        def rate(m):
            s = F.lit(1.0) if no < 4 else score(kind, t, m["start"], m["value"])
            return F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), (m["start"] + F.length(m["value"])).alias("end"), s.alias("score"))

        sound = F.transform(F.filter(f"_{kind}", lambda m: checked(kind, m["value"])), rate)
        return F.filter(sound, lambda m: m["score"] >= keep_from)

    spans = F.sort_array(F.concat(*[kept(i, k) for i, k in enumerate(KINDS)]))
    return out.withColumn(name, spans).drop("_text", "_digit", *[f"_{k}" for k in KINDS])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the place."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind_no"])))
        .otherwise(a["out"]).alias("out")))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(
        let(done, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    marked = with_spans(docs, name="_pii").withColumn("_clean", redacted(F.col("text"), F.col("_pii")))
    return marked.select(*[F.col("_clean").alias("text") if c == "text" else
                           F.when(F.size("_pii") > 0, F.length("_clean").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
                           for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def of_kind(i):
        return F.filter("pii", lambda s: s["kind_no"] == i)

    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    base = joined(F.filter("pii", lambda s: s["kind_no"] < 4))
    return docs.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
