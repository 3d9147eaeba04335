"""Secret scans: patterns with code-point spans, and sliding-window Shannon entropy by character class.

Native: DataFrame functions only. A pattern's spans come from the lengths of the pieces that it splits the text
into. Candidate strings (long runs of key characters) get a window of fixed width slid over them, over what the
patterns leave of them; the counts of the characters change by one in, one out at each step, and so does the sum that
gives the entropy. Each window is held against the bits of the narrowest class that has all its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns of the base scan. hex and access need a length, which the quantifier states without changing
#: any match that is long enough; assign keeps its +, as a short match hides what it covers.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Candidates for the entropy scan, and their alphabet by class.
LEAST_CANDIDATE = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Window width, and for each class, narrowest first, its characters and the bits at which a window of it is a secret.
WIDTH = 20
CLASSES = {"hex": (r"[0-9a-fA-F]", 3.0), "letters": (r"[A-Za-z]", 4.0), "alnum": (r"[0-9A-Za-z]", 3.7), "base64": (r"[0-9A-Za-z+/_=-]", 3.9)}
#: A candidate that matches any of these whole patterns is no secret: numbers, words of one case that marks join, names
#: that say so, dates, and what begins with one.
ALLOW = (r"[0-9]+", r"[a-z_=/-]+", r"[A-Z_=/-]+", r".*(?i:example).*", r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*")
#: Matches walked at a time: a list that grows by one is copied each time, so it is kept short.
RUN = 128


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array of struct(start, end, kind, value): leftmost non-overlapping matches, by code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    kindof = "array<struct<start:int,end:int,kind:string,value:string>>"
    empty = F.array().cast(kindof)
    total = lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + p["gap"] + F.length(p["value"]))
    # runs of RUN matches; where each begins; then the matches inside it
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / RUN).cast("int") - 1, F.lit(0))), lambda j: F.slice(pairs, j * RUN + 1, RUN))
    begins = F.aggregate(F.transform(runs, total), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def walked(run, begin):
        one = lambda a, p: F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + F.length(p["value"])).alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value"))
        return F.aggregate(run, F.struct(begin.alias("at"), empty.alias("out")), lambda a, p: F.struct((a["at"] + p["gap"] + F.length(p["value"])).alias("at"), F.concat(a["out"], F.array(one(a, p))).alias("out")), lambda a: a["out"])

    return F.when(F.regexp_like(text, F.lit(pattern)), F.flatten(F.zip_with(runs, begins, walked))).otherwise(empty)


def _entropy_sum(c: Column) -> Column:
    """c log2 c for a count."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


#: Counts of up to WIDTH are packed, so many bits each, so many in a word.
_BITS, _EACH = 5, 12
_WORDS = -(-len(ALPHABET) // _EACH)


def best_entropies(value: Column, width: int = WIDTH, classes=None) -> Column:
    """For each class the largest Shannon entropy in bits of any `width` adjacent characters (of all, if fewer) whose
    narrowest class it is; -1 where no window is. An array in the classes' order.

    Each step puts one character in and takes one out: two counts change, their terms of the sum, and how many
    characters each class lacks. Counts of up to 31 are packed in a few words.
    """
    classes = classes or CLASSES
    assert width < 1 << _BITS
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    lacks = lambda c: [F.when(c.rlike(p), 0).otherwise(1) for p, _ in classes.values()]
    known = F.transform(chars, lambda c: F.struct((F.instr(F.lit(ALPHABET), c) - 1).alias("code"), F.array(*lacks(c)).alias("lacks")))
    # old: the character that leaves
    steps = lambda ks: F.transform(ks, lambda k, i: F.struct(k.alias("new"), F.when(i >= width, F.get(ks, i - width)).alias("old"), F.least(F.lit(width), F.size(ks)).alias("least")))

    def read(counts, code):
        return F.call_function("shiftright", F.get(counts, F.floor(code / _EACH).cast("int")), F.pmod(code, F.lit(_EACH)) * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def add(counts, code, by):
        unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(_EACH)) * _BITS)
        return F.transform(counts, lambda c, i: F.when(i == F.floor(code / _EACH).cast("int"), c + unit * by).otherwise(c))

    def step(a, p):
        into = read(a["counts"], p["new"]["code"])
        s1 = a["sum"] - _entropy_sum(into) + _entropy_sum(into + 1)
        with_new = add(a["counts"], p["new"]["code"], 1)
        full = p["old"].isNotNull()

        def left(x):
            leaving = read(x["c"], p["old"]["code"])
            return F.struct(add(x["c"], p["old"]["code"], -1).alias("counts"), (s1 - _entropy_sum(leaving) + _entropy_sum(leaving - 1)).alias("sum"), F.zip_with(x["l"], p["old"]["lacks"], lambda u, v: u - v).alias("lacks"), a["n"].alias("n"))

        now = F.struct(with_new.alias("c"), F.zip_with(a["lacks"], p["new"]["lacks"], lambda u, v: u + v).alias("l"))
        moved = F.get(F.transform(F.array(now), lambda x: F.when(full, left(x)).otherwise(F.struct(x["c"].alias("counts"), s1.alias("sum"), x["l"].alias("lacks"), (a["n"] + 1).alias("n")))), F.lit(0))

        def rated(x):
            bits = F.log2(x["n"].cast("double")) - x["sum"] / x["n"]
            narrowest = F.array_position(x["lacks"], 0) - 1
            best = F.transform(a["best"], lambda b, j: F.when((j == narrowest) & (x["n"] >= p["least"]), F.greatest(b, bits)).otherwise(b))
            return F.struct(x["counts"].alias("counts"), x["sum"].alias("sum"), x["lacks"].alias("lacks"), x["n"].alias("n"), best.alias("best"))

        return F.get(F.transform(F.array(moved), rated), F.lit(0))

    n = len(classes)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), n).alias("lacks"), F.lit(0).alias("n"), F.array_repeat(F.lit(-1.0), n).alias("best"))
    return F.get(F.transform(F.array(known), lambda ks: F.aggregate(steps(ks), start, step, lambda a: a["best"])), F.lit(0))


def secrets(documents: DataFrame, text: str = "text", keep=("doc_id",), width: int = WIDTH, classes=None, allow=ALLOW) -> DataFrame:
    """keep columns and `base`, `added`: arrays of struct(start, end, kind, value) by start, for each row.

    Null text counts as empty and has no spans; repeated rows each get theirs. `added` has entropy spans (kinds
    entropy_hex and so on: the first class of which a window reaches its bits) outside every base span; allow-listed
    candidates are left out.
    """
    classes = classes or CLASSES
    body = F.coalesce(F.col(text), F.lit(""))
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    assign = F.filter(spans(body, ASSIGN, "assign"), lambda s: F.length(value(s)) >= LEAST_VALUE)
    df = documents.select(*keep, assign.alias("_assign"), spans(body, ACCESS, "access").alias("_access"), spans(body, HEX, "hex").alias("_hex"), spans(body, CANDIDATE, "entropy").alias("_candidates"))
    order = {"assign": 0, "access": 1, "hex": 2}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    base = F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    df = df.select(*keep, F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))).alias("base"), "_candidates")

    def secret(s):
        bits = best_entropies(s["value"], width, classes)

        def named(b):
            kind = F.lit(None).cast("string")
            for j, (name, (_, least)) in reversed(list(enumerate(classes.items()))):
                kind = F.when(F.get(b, F.lit(j)) >= least, F.lit(f"entropy_{name}")).otherwise(kind)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), s["value"].alias("value"))

        return F.get(F.transform(F.array(bits), named), F.lit(0))

    def free(s):
        """What base spans leave of a candidate, where it is long enough."""
        part = lambda a, z: F.filter(F.array(F.struct(a.alias("start"), z.alias("end"), F.lit("entropy").alias("kind"), F.substring(s["value"], a - s["start"] + 1, z - a).alias("value"))), lambda x: x["end"] - x["start"] >= LEAST_CANDIDATE)
        over = F.filter("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        cut = F.aggregate(over, F.struct(s["start"].alias("at"), empty.alias("out")), lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.concat(a["out"], part(a["at"], F.greatest(a["at"], b["start"]))).alias("out")))
        return F.when(F.size(over) == 0, F.array(s)).otherwise(F.get(F.transform(F.array(cut), lambda c: F.concat(c["out"], part(c["at"], F.greatest(c["at"], s["end"])))), F.lit(0)))

    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    rest = F.flatten(F.transform("_candidates", free))
    rest = F.filter(rest, lambda s: ~s["value"].rlike("|".join(f"^(?:{p})$" for p in allow) or "^$"))
    df = df.withColumn("_rest", rest)
    added = F.when(F.size("_rest") > 0, F.filter(F.transform("_rest", secret), lambda s: s["kind"].isNotNull())).otherwise(empty)
    return df.select(*keep, "base", added.alias("added"))


def joined(found) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(documents: DataFrame) -> DataFrame:
    s = secrets(documents)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return s.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_entropy"))
