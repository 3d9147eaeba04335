"""PII: keyed, type-consistent surrogates with collision checks over the whole corpus.

Native: DataFrame functions only. One pattern finds the entities; the text between them stays. A surrogate is made
from a keyed SHA-256 stream of the entity's canonical form, so one entity gets one surrogate everywhere
(coreference). All distinct entities of the corpus are then checked: two with the same surrogate, or a surrogate
that is itself an entity of the corpus, go on to another attempt until none is left (distinctness); collisions that
are left after the last attempt are an error.

Limits: a name is found where a title announces it; names without a title, postal addresses and dates of birth are no
entities. Who has the key can make the surrogates of guessed values, so it is the caller's to keep.
"""

from __future__ import annotations

import secrets as _random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.common import BROADCAST_ROWS, join_checked, written

#: Where queries look for the key; without one, a run draws its own.
KEY_SETTING = "spark.lectern.surrogates.key"
ATTEMPTS = 40
#: Titles that announce a name, by gender (fixed values).
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof")
#: Syllables and gendered endings of made-up names, by script.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "la", "me", "ni", "ro", "sa", "te", "vi", "lo", "ka", "re", "mi", "du"),
    "cyrillic": ("ба", "де", "фи", "го", "ла", "ме", "ни", "ро", "са", "те", "ви", "ло", "ка", "ре", "ми", "ду"),
    "greek": ("βα", "δε", "φι", "γο", "λα", "με", "νι", "ρο", "σα", "τε", "βι", "λο", "κα", "ρε", "μι", "δου"),
}
ENDINGS = {"latin": {"f": "na", "m": "nor", "n": "lin"}, "cyrillic": {"f": "на", "m": "нор", "n": "лин"}, "greek": {"f": "να", "m": "νος", "n": "λις"}}

_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9A-Za-z])"
#: Each kind's pattern; the first that matches at a place wins. A card ends before a group that starts an ssn or a
#: phone, so it can't take them along in a row of numbers.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": _SSN,
    "phone": _PHONE,
    "card": rf"(?<![0-9A-Za-z])[2-6](?:[ -]?(?!{_SSN}|{_PHONE})[0-9]){{12,18}}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? (?:{_NAME} ){{0,2}}{_NAME}",
}
KINDS = tuple(PATTERNS)
#: Every entity holds one of these; most texts hold none, and skip the patterns.
QUICK = rf"[0-9@]|(?<!\p{{L}})[{''.join(sorted({t[0] for t in FEMALE + MALE + NEUTRAL}))}](?:{'|'.join(t[1:] for t in FEMALE + MALE + NEUTRAL)})\.? \p{{Lu}}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(value: Column) -> Column:
    """The kind of a found string; number: not an entity after all."""
    out = F.lit("name")
    for k in reversed(KINDS[:-1]):
        # a long number that fails the check sum is no card, and stays
        kind = F.when(_luhn(_digits(value)) == 0, k).otherwise("number") if k == "card" else F.lit(k)
        out = F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), kind).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity share."""
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "phone", F.right(_digits(value), F.lit(10)))
        .when(kind.isin("card", "ssn"), _digits(value))
        .otherwise(value)
    )


def _gender(value: Column) -> Column:
    title = F.regexp_replace(F.get(F.split(value, " "), 0), r"\.", "")
    return F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")


def _name_words(value: Column) -> Column:
    words = F.split(value, " ")
    return F.slice(words, 2, F.size(words) - 1)


def _let(body, **fields: Column) -> Column:
    """body over a struct of the fields, each of which is computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])), body), F.lit(0))


def parts(kind: Column, value: Column) -> Column:
    """array of struct(kind, canon): one for an entity, one a word for a name (the last is the surname)."""
    words = _name_words(value)
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), _gender(value))).alias("kind"), F.lower(w).alias("canon")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canonical(kind, value).alias("canon"))))


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(F.lit("0"), seed), 256), F.sha2(F.concat(F.lit("1"), seed), 256))


def _number(stream: Column, i, modulus) -> Column:
    """A keyed number below the modulus, by place."""
    return F.pmod(F.conv(F.substring(stream, F.pmod(F.lit(3) * i, F.lit(120)) + 1, F.lit(6)), 16, 10).cast("int"), modulus)


def _swap(text: Column, stream: Column, first: int = 0) -> Column:
    """Letters become letters of the same case and digits digits, from place `first` on; the rest stays."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda s, i: F.substring(F.lit(s), _number(stream, i, F.lit(len(s))) + 1, F.lit(1))
    one = lambda c, i: F.when(i < first, c).when(c.rlike("[a-z]"), pick(low, i)).when(c.rlike("[A-Z]"), pick(up, i)).when(c.rlike("[0-9]"), pick(num, i)).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum mod 10."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    weighed = F.transform(each, lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(weighed, F.lit(0), lambda a, x: a + x), F.lit(10))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _made_name(kind: Column, canon: Column, stream: Column, attempt: Column) -> Column:
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        table = F.array(*[F.lit(x) for x in syllables])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.get(table, _number(stream, i, F.lit(len(syllables))))), "")
        end = F.lit("")
        for g, e in ENDINGS[script].items():
            end = F.when(kind == f"given_{g}", F.lit(e)).otherwise(end)
        out = F.when(_script(canon) == script, F.concat(stem, end)).otherwise(out)
    return F.initcap(out)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form's replacement, of the same type."""
    domain = F.substring_index(canon, "@", -1)
    return _let(_made, kind=kind, canon=canon, attempt=attempt, s=_stream(kind, canon, attempt, key), d=F.when(kind == "email", _stream(F.lit("domain"), domain, F.lit(0), key)))


def _made(p) -> Column:
    kind, canon, s = p["kind"], p["canon"], p["s"]
    domain = F.substring_index(canon, "@", -1)
    top = F.regexp_extract(domain, r"([a-z]+)$", 1)
    host = _swap(F.regexp_extract(domain, r"^([^.]+)", 1), p["d"])
    email = F.concat(_swap(F.substring_index(canon, "@", 1), s), F.lit("@"), host, F.when(top.isin("com", "net", "org"), F.concat(F.lit(".example."), top)).otherwise(F.lit(".example")))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _number(s, i, F.lit(254)) + 1), ".")
    phone = _let(lambda r: F.concat(_number(s, F.lit(30), F.lit(8)) + 2, F.substring(r["raw"], 2, 2), _number(s, F.lit(31), F.lit(8)) + 2, F.substring(r["raw"], F.lit(5), F.length(canon) - 4)), raw=_swap(canon, s))
    # the last digit gives the sum that the original has, so validity is kept
    card = _let(lambda r: F.concat(r["stem"], F.pmod(_luhn(canon) - _luhn(F.concat(r["stem"], F.lit("0"))), F.lit(10))), stem=F.concat(_swap(F.substring(canon, F.lit(1), F.length(canon) - 1), s, 1)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when((kind == "phone") & (F.length(canon) >= 7), phone)
        .when(kind == "card", card)
        .when(kind == "iban", _swap(canon, s, 2))
        .when(kind.isin("ssn", "phone"), _swap(canon, s))
        .otherwise(_made_name(kind, canon, s, p["attempt"]))
    )


def _render(kind: Column, value: Column, made: Column) -> Column:
    """The surrogates of an entity's parts (array) in the entity's own format."""

    def spread(r):
        def place(c, i):
            before = F.substring(value, F.lit(1), i)
            at = F.length(F.regexp_replace(before, r["skip"], F.lit(""))) - (F.length(F.regexp_replace(value, r["skip"], F.lit(""))) - F.length(r["first"]))
            return F.when(~F.regexp_like(c, r["skip"]) & (at >= 0), F.substring(r["first"], at + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), place), "")

    first = F.get(made, 0)
    upper = (F.upper(value) == value) & (F.lower(value) != value)
    formed = _let(spread, first=first, skip=F.when(kind == "iban", " ").otherwise("[^0-9]"))
    title = F.get(F.split(value, " "), 0)
    return F.when(kind == "number", value).when(kind == "name", F.concat_ws(" ", title, F.concat_ws(" ", made))).when(kind == "email", F.when(upper, F.upper(first)).otherwise(first)).when(kind == "ip", first).otherwise(formed)


def _found(text: Column) -> Column:
    """array of struct(value, kind) in the text's order."""
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    found = F.transform(values, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    return F.when(F.regexp_like(text, F.lit(QUICK)), found).otherwise(F.array().cast("array<struct<value:string,kind:string>>"))


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate isn't distinct; the others stay at attempt 0.

    entities: distinct (kind, canon). Of those that share a surrogate the smallest canon keeps it.
    """
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        made = now.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        # given names of any gender and surnames are one space of words
        space = F.when(F.col("kind").rlike("^(given|surname)"), F.lit("name")).otherwise(F.col("kind"))
        made = written(made.select(space.alias("space"), "kind", "canon", "attempt", F.lower("made").alias("made")), "surrogates")
        # a surrogate's number of holders, and whether the corpus has it as an original
        holders = made.groupBy("space", "made").agg(F.count_distinct("kind", "canon").alias("n"), F.min(F.struct("attempt", "kind", "canon")).alias("keeps")).where("n > 1")
        shared = made.join(holders, ["space", "made"], "left_semi").join(holders.select("space", "made", "keeps"), ["space", "made"]).where("struct(attempt, kind, canon) != keeps").select("kind", "canon")
        real = made.select("space", F.lower("canon").alias("made")).distinct()
        taken = made.join(real, ["space", "made"], "left_semi").select("kind", "canon")
        again = written(shared.union(taken).distinct(), "collisions")
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        now = made.select("kind", "canon", "attempt").join(again.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    left = [r.kind for r in again.select("kind").distinct().collect()]  # kinds are few
    raise ValueError(f"surrogates of {', '.join(sorted(left))} still collide after {ATTEMPTS} attempts")


def session_key(spark: SparkSession) -> str:
    """The session's key, or a new one that no later run can make again."""
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None) or _random.token_hex(32)


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """documents with surrogates in text (n_chars follows), and n_entities, entity_kinds (one for each mention).

    Null text stays null, with no entities; texts without entities stay as they are. Repeated rows get equal
    results. Columns n_entities and entity_kinds of the input are replaced, all others carried as they come, whatever
    their names.
    """
    cols = [c for c in documents.columns if c not in ("n_entities", "entity_kinds")]
    keyed = documents.select(F.struct("*").alias("doc"), _found(F.col("text")).alias("found"))
    keyed = keyed.withColumn("id", F.when(F.size("found") > 0, F.sha2("doc.text", 256)))
    each = keyed.where(F.size("found") > 0).select("id", F.explode("found").alias("v")).where("v.kind != 'number'").select("id", F.explode(parts(F.col("v.kind"), F.col("v.value"))).alias("p"))
    mentions = written(each.select("id", "p.kind", "p.canon").distinct(), "pii-mentions")
    odd = written(resolve(mentions.select("kind", "canon").distinct(), key), "pii-attempts")
    tries = mentions.join(odd, ["kind", "canon"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias("tries"))
    tries = written(tries, "pii-tries")
    small = (tries.agg(F.sum(F.size("tries"))).first()[0] or 0) <= 5 * BROADCAST_ROWS
    df = join_checked(keyed, tries, "id") if small else keyed.join(tries, "id", "left")
    attempt = lambda p: F.coalesce(F.try_element_at("tries", F.concat_ws("\x1f", p["kind"], p["canon"])), F.lit(0))
    made = F.transform("found", lambda v: _render(v["kind"], v["value"], F.transform(parts(v["kind"], v["value"]), lambda p: surrogate(p["kind"], p["canon"], attempt(p), key))))
    some = F.size("found") > 0
    df = df.withColumn("made", F.when(some, made)).withColumn("gaps", F.when(some, F.split("doc.text", ANY, -1)))
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("made", i), F.lit("")))), "")
    kinds = F.when(some, F.filter(F.transform("found", lambda v: v["kind"]), lambda k: k != "number")).otherwise(F.array().cast("array<string>"))
    df = df.select("doc", F.when(some, text).otherwise(F.col("doc.text")).alias("text"), kinds.alias("kinds"))
    swapped = {"text": F.col("text")}
    if "n_chars" in cols:
        swapped["n_chars"] = F.when(F.size("kinds") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return df.select(*[swapped.get(c, F.col("doc").getField(c)).alias(c) for c in cols], F.col("kinds").alias("entity_kinds"), F.size("kinds").cast("long").alias("n_entities"))
