"""Personal data: base patterns, candidate spans scored by boosted trees, calibrated thresholds.

Base spans are leftmost non-overlapping matches of fixed patterns, checked (octets, Luhn, digit
counts) and never dropped. Beyond them high-recall generators propose overlapping candidates
(secrets in assignments of any length from six characters on, bare random strings, card numbers inside longer digit runs, phones without
a plus, written-out mail addresses, social security numbers, IBANs). Boosted trees score each from
its format and its left and right context; a span is added if its calibrated probability reaches
the threshold of its kind and no base span and no better candidate overlaps it.

The trees are fitted once a session on a bounded synthetic sample (SAMPLE texts, seeded) whose
candidates and features come from the very expressions used on the corpus. A third of the candidates
grows the trees, a third calibrates their scores, and a third selects each kind's threshold: the lowest that
keeps PRECISION there. Context is at most CONTEXT characters on either side, from the match before to the
match after. Scoring is a SQL expression. Nothing here runs Python on executors.

Positions are code points, ends exclusive. Defined cases: a null text is empty; a null doc_id is
kept; repeated rows give one row each; an empty table gives no rows; other columns are ignored by
:func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import let, read, text_of, total, unpacked, whole, with_text

#: Order of kinds in results: the base kinds first.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
SAMPLE, SEED, PRECISION = 3000, 7, 0.99

# The patterns equal the plain ones (see PLAIN) but are possessive and anchored at the starts of
# runs, so that long texts take linear time and no recursion. \\G allows a start at a match's end.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of 13 to 19 digits only: the others would be dropped, and none of them begins inside a run.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": PLAIN["phone"],
}
#: A cheap necessary condition for each base pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

_NAMES = r"(?i:passw(?:or)?d|pwd|passphrase|secret|token|key|credentials?|auth)"
_VALUE = r"[^\s\"'`<>,;()\[\]{}]"
#: What is assigned to a secret's name, from six characters on and of any of them; closing punctuation stays out.
ASSIGNED = rf"(?<=[:=\s\"'])(?<={_NAMES}[\"']?\s{{0,2}}[:=]{{1,2}}\s{{0,2}}[\"']?)(?![:=])(?={_VALUE}{{6}}){_VALUE}*[^\s\"'`<>,;()\[\]{{}}.:?]"

#: (kind, pattern) of the generators; a candidate is the whole match.
GENERATORS = (
    ("secret", r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[0-9A-Za-z+/_=-]{16,}+(?![0-9A-Za-z+/_=-])"),
    ("secret", ASSIGNED),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?i:dot)[\])]\x20?|\.)[A-Za-z0-9-]*[A-Za-z])++"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"),
)
#: Characters of context on either side.
CONTEXT = 28
#: A cheap necessary condition for a generator.
GATES = {ASSIGNED: rf"{_NAMES}[\"']?\s{{0,2}}[:=]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)).cast("long")

    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return total(F.transform(each, weight)) % 10 == 0


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, left, right>> of a pattern's leftmost non-overlapping matches.

    The pieces between matches (split) and the matches (extract) come in the same order.
    """

    def placed(both: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            piece, value = F.get(both["pieces"], i), F.get(both["found"], i)
            start = acc["at"] + F.length(piece)
            one = F.struct(
                start.alias("start"),
                (start + F.length(value)).alias("end"),
                value.alias("value"),
                F.substring(piece, -CONTEXT, CONTEXT).alias("left"),
                F.substring(F.get(both["pieces"], i + 1), 1, CONTEXT).alias("right"),
            )
            return F.struct((start + F.length(value)).alias("at"), F.array_append(acc["out"], one).alias("out"))

        walk = F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1), zero, step, lambda acc: acc["out"])
        return F.when(F.size(both["found"]) > 0, walk).otherwise(zero["out"])

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(both, placed)).otherwise(none)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end>> of a base kind."""

    def valid(m: Column) -> Column:
        digits = _digits(m["value"])
        if kind == "ip":
            return F.forall(F.split(m["value"], "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
                F.split(m["value"], "\\."), lambda p: F.coalesce(F.ltrim(F.substring(p, -3, 3), F.lit("0")).try_cast("int"), F.lit(0)) <= 255
            )
        if kind == "card":
            return _luhn(digits)
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)

    found = F.transform(F.filter(_matches(text, BASE[kind]), valid), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    if kind not in NEEDS:
        return found
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def candidates(text: Column) -> Column:
    """Every generator's spans with value and context; spans of different generators may overlap."""

    def tagged(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), *[m[n].alias(n) for n in ("start", "end", "value", "left", "right")]))

    def gated(pattern: str) -> Column:
        found = _matches(text, pattern)
        if pattern not in GATES:
            return found
        none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
        return F.when(F.regexp_like(text, F.lit(GATES[pattern])), found).otherwise(none)

    # Both generators of secrets may propose the same span.
    return F.array_distinct(F.concat(*[tagged(KINDS.index(kind), gated(pattern)) for kind, pattern in GENERATORS]))


def _count(value: Column, characters: str) -> Column:
    return F.length(value) - F.length(F.translate(value, characters, ""))


def features(c: Column) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    v, left, right = c["value"], c["left"], c["right"]
    digits = _digits(v)

    def flag(x: Column) -> Column:
        return F.when(x, 1.0).otherwise(0.0)

    def near(pattern: str) -> Column:
        return flag(F.regexp_like(left, F.lit(f"(?i){pattern}")))

    return [
        c["kind"].cast("double"),
        F.length(v).cast("double"),
        (F.length(digits) / F.length(v)).cast("double"),
        F.when(F.length(digits) > 0, flag(_luhn(digits))).otherwise(0.0),
        (_count(F.lower(v), "0123456789abcdef") / F.length(v)).cast("double"),
        (_count(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / F.length(v)).cast("double"),
        (_count(v, " .-()[]") / F.length(v)).cast("double"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).cast("double"),
        ((F.size(F.split(v, "(?<=[a-z])(?=[A-Z0-9])")) - 1) / F.length(v)).cast("double"),
        near(r"(token|secret|passw|pwd|api.?key|auth|bearer|credential)"),
        near(r"[:=]\s*[\"']?$"),
        near(r"(phone|tel\b|call|mobile|fax|contact)"),
        near(r"(card|visa|account|iban|ssn|social|pay)"),
        near(r"(order|version|isbn|commit|sha|id|no\.?|part|build|page)\W*$"),
        flag(F.regexp_like(left, F.lit(r"[0-9A-Za-z]$"))) + flag(F.regexp_like(right, F.lit(r"^[0-9A-Za-z]"))),
    ]



def _synthetic(n: int, seed: int) -> list[tuple[str, int, int]]:
    """(text, start, end) with one personal span, or start -1 if the inserted thing is harmless."""
    rng = random.Random(seed)
    syllables = "th er on an re in ed nd ha es la de que ou ment ch sch ver un os ar".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def number(k: int) -> str:
        return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(k - 1))

    def with_luhn(k: int, good: bool) -> str:
        while True:
            s = number(k)
            t = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s))))
            if (t % 10 == 0) == good:
                return s

    def random_string(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    base64 = letters + "0123456789"
    names = ("token", "secret", "api_key", "api-key", "password", "passwd", "pwd", "auth", "access_token", "credential", "client_secret", "private_key", "passphrase", "DB_PASSWORD", "SECRET_KEY")
    pick = rng.choice

    def assigned() -> tuple[str, str]:
        """What stands before and after the value that a secret's name is given, in several notations."""
        name, quote = pick(names), pick(('"', "'", ""))
        if rng.random() < 0.3:
            name = pick((name.upper(), name.capitalize(), f"{word()}_{name}"))
        if rng.random() < 0.2:
            return f'"{name}": "', '",'
        return f"{pick(('', '', 'export ', 'my ', 'the ', '--'))}{name}{pick((' = ', '=', ': ', ' := ', ':'))}{quote}", quote

    def identifier() -> str:
        a, b, c = word(), word(), word()
        return pick((a + b, (a + b).capitalize(), f"{a}_{b}", f"{a}-{b}", f"{a}.{b}", f"{a}_{b}_{c}", f"{a}{b.capitalize()}{c.capitalize()}", f"{a}/{b}/{c}", f"${a.upper()}_{b.upper()}", f"{a}_{b}2"))

    def made() -> tuple[str, str, str, bool]:
        """Left, span, right, and whether the span is personal."""
        k = rng.randrange(22)
        if k in (0, 1, 2):  # random values of all lengths and alphabets
            left, right = assigned()
            alphabet = pick((hexes, hexes, base64, base64 + "+/", letters, letters))
            return left, random_string(alphabet, 13, pick((24, 40, 64, 600))) + pick(base64), right, True
        if k == 3:  # short ones, with a digit, a capital and maybe signs
            left, right = assigned()
            mixed = [*random_string(base64 + "!@#$%&*_", 4, 12), pick("0123456789"), pick("ABCDEFGHKLMNPQRSTUVWXYZ"), pick(hexes)]
            rng.shuffle(mixed)
            return left, "".join(mixed[:-1]) + pick(base64), right, True
        if k in (4, 5):  # names, paths and variables where a value might stand
            left, right = assigned()
            return left, identifier(), right, False
        if k == 6:
            return pick(("bearer ", "Bearer: ", "Authorization: Bearer ", "api key ", "secret ", "auth token ", "password is ")), random_string(base64, 24, 80), "", True
        if k == 7:  # digests and identifiers of things
            return pick(("commit ", "sha ", "sha1: ", "sha256=", "md5 ", "etag: ", "checksum ", "id ", "page/", "build ", "")), random_string(hexes, 32, 64), "", False
        if k == 8:
            return pick(("id ", "uuid: ", "", "part ")), "-".join(random_string(hexes, n, n) for n in (8, 4, 4, 4, 12)), "", False
        if k == 9:  # long names without a secret's context
            return "", pick(("-", "_")).join(word() for _ in range(5)) + f"-{rng.randint(1, 99)}", "", False
        if k == 10:
            return "", pick("=-_") * rng.randint(16, 60) + str(rng.randint(0, 9)), "", False
        if k in (11, 12):
            return pick(("", "", "card ", "visa: ", "pay with ", "cc ")), with_luhn(pick((14, 15, 16, 16, 16, 19)), True), "", True
        if k in (13, 14):
            return pick(("", "order ", "id ", "no. ", "tracking ", "timestamp: ", "isbn ", "total: ", "order = ", "page: ")), with_luhn(pick((13, 14, 15, 16, 16, 16, 19)), False), "", False
        if k == 15:
            grouped = pick((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(3)} {number(3)} {number(4)}"))
            return pick(("call ", "phone: ", "tel ", "mobile ", "fax: ", "contact ", "call us at ", "Phone ")), grouped, "", True
        if k == 16:
            return pick(("version ", "part ", "no. ", "build ", "order ", "page ")), f"{number(3)}{pick('.-')}{number(3)}{pick('.-')}{number(4)}" if rng.random() < 0.5 else f"{number(3)} {number(3)}-{number(4)}", "", False
        if k == 17:
            at, dot = pick((" [at] ", "(at)", " (AT) ", "[at]")), pick((" [dot] ", "(dot)", ".", "[dot]"))
            return pick(("", "mail ", "write to ")), f"{pick((word(), word() + '.' + word(), pick(letters[26:])))}{at}{word()}xx{dot}{pick(('com', 'org', 'de', 'co.uk'))}", "", True
        if k == 18:
            return pick(("ssn ", "social security ", "ssn: ", "social security number ")), f"{number(3)}-{number(2)}-{number(4)}", "", True
        if k == 19:
            return pick(("part ", "order ", "isbn ", "", "no. ")), f"{number(3)}-{number(2)}-{number(4)}", "", False
        if k == 20:
            groups = " ".join(number(4) for _ in range(rng.randint(3, 6)))
            account = f"{pick(('DE', 'FR', 'ES', 'GB', 'IT', 'NL'))}{number(2)} {groups} {number(2)}"
            return pick(("iban ", "account ", "", "pay to ", "IBAN: ")), account if rng.random() < 0.5 else account.replace(" ", ""), "", True
        code = f"{random_string('ABCDEFGHJKLMNPQRSTUVWXYZ', 2, 2)}{number(2)}{random_string('ABCDEFGHJKLMNPQRSTUVWXYZ0123456789', 12, 20)}"
        return pick(("part ", "order ", "build ", "version ", "no. ")), code, "", False

    rows = []
    for _ in range(n):
        left, span, right, personal = made()
        head = f"{prose(rng.randint(3, 9))} {left}"
        rows.append((f"{head}{span}{right} {prose(rng.randint(3, 9))}.", len(head) if personal else -1, len(head) + len(span)))
    return rows


@functools.lru_cache(maxsize=4)
def _fitted(session: int, spark: SparkSession, sample: int, seed: int) -> tuple[boosting.Model, dict[int, float]]:
    rows = spark.createDataFrame(_synthetic(sample, seed), "text string, s int, e int")
    found = rows.select("s", "e", F.explode(candidates(F.col("text"))).alias("c"))
    inside = (F.col("s") >= 0) & (F.col("c.start") <= F.col("s")) & (F.col("c.end") >= F.col("e")) & (F.col("c.end") - F.col("c.start") <= F.col("e") - F.col("s") + 2)
    table = found.select(F.array(*features(F.col("c"))).alias("x"), inside.cast("int").alias("y"), F.col("c.kind").alias("kind")).orderBy("kind", "y", F.xxhash64("x")).collect()
    x, y, kinds = np.array([r.x for r in table]), np.array([r.y for r in table]), np.array([r.kind for r in table])
    part = np.arange(len(x)) % 3  # rows are in order of kind and truth, so every part has its share of each
    model = boosting.fit(x, y, part)
    p = model.probability(x)
    thresholds = {kind: boosting.threshold(p[mine], y[mine], PRECISION) for kind in range(len(KINDS)) if (mine := (kinds == kind) & (part == 2)).any()}
    return model, {kind: thresholds.get(kind, 1.0) for kind in range(len(KINDS))}


def model_for(spark: SparkSession, sample: int = SAMPLE, seed: int = SEED) -> tuple[boosting.Model, dict[int, float]]:
    """The trees and the threshold of each kind; fitted at the first call of a session."""
    return _fitted(id(spark), spark, sample, seed)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _part(a: Column, b: Column) -> Column:
    """Whether a is a part of b, of its kind."""
    return (a["kind"] == b["kind"]) & (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (a["end"] - a["start"] < b["end"] - b["start"])


def spans(text: Column, spark: SparkSession) -> Column:
    """struct<base, all>: arrays of struct<kind, start, end>, by kind as in KINDS, then start."""
    model, thresholds = model_for(spark)
    by_kind = [F.transform(base_spans(text, kind), _tagger(i)) for i, kind in enumerate(KINDS[:4])]
    base = F.concat(*by_kind)
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv])

    def scored(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), model.score(features(c)).alias("p"))

    def choose(both: Column) -> Column:
        likely = F.filter(F.transform(both["proposed"], scored), lambda s: s["p"] >= limit[s["kind"]])

        def best(chosen: Column) -> Column:
            def stays(s: Column) -> Column:
                def beats(o: Column) -> Column:
                    # A part of a secret never stands against the whole.
                    return _overlap(o, s) & (_part(s, o) | ~_part(o, s) & (F.struct(o["p"], o["end"] - o["start"], -o["start"], -o["kind"]) > F.struct(s["p"], s["end"] - s["start"], -s["start"], -s["kind"])))

                return ~F.exists(both["base"], lambda b: _overlap(b, s)) & ~F.exists(chosen, beats)

            return F.array_distinct(F.transform(F.filter(chosen, stays), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

        return F.struct(both["base"].alias("base"), F.array_sort(F.concat(both["base"], let(likely, best))).alias("all"))

    return let(F.struct(base.alias("base"), candidates(text).alias("proposed")), choose)


def _tagger(kind: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, and all spans and their number of every row."""
    found = docs.select("doc_id", spans(text_of("text"), docs.sparkSession).alias("_s"))
    counts = [F.size(F.filter("_s.base", _is(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(written(F.col("_s.base")), 256).alias("base_sha256"), written(F.col("_s.all")).alias("spans"), F.size("_s.all").cast("long").alias("n_spans"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def redact(docs: DataFrame) -> DataFrame:
    """docs with each personal span in text replaced by <KIND>; overlapping spans become one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def rebuilt(pair: Column) -> Column:
        ordered = F.array_sort(F.transform(pair["s"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            fresh = F.array(F.substring(pair["t"], acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(pair["t"], acc["at"] + 1, F.length(pair["t"]))))

    rows = docs.select(whole(docs), spans(text_of("text"), docs.sparkSession)["all"].alias("_s"))
    own = F.col("_row")["text"]
    text = F.when(F.size("_s") == 0, own).otherwise(let(F.struct(own.alias("t"), F.col("_s").alias("s")), rebuilt))
    rows = rows.select("_row", text.alias("_text")).select(with_text(docs, F.col("_text")))
    return unpacked(rows, docs)


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


QUERIES = {"op10_private_data": op10_private_data}
