"""Personal data: generators propose spans, boosted trees on format and context decide.

Four base kinds are found by pattern and check (parts of an address, Luhn, number of digits) and always stay.
Beside them, generators of high recall propose spans that may overlap: long
numbers, secrets, disguised e-mail addresses, IBANs, version 6 addresses.  Each
candidate is described by its format and by the words before it; gradient-boosted
trees score it, and a threshold calibrated for its generator decides.  Of overlapping spans the
best scored stays, and none that touches a base span.

The trees are fitted by ``pyspark.ml`` on ``SAMPLE_ROWS`` labelled candidates, made by SQL from
the formats below; half of them calibrate the thresholds.  The fitted trees become one SQL expression, so a
document is judged within its row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Base kinds in order, with a cheap necessary condition and the pattern.
BASE = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+){3}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Blanks and hyphens that do not stand between two digits; without them a run of digits is one class repeated.
LOOSE, DIGIT_RUN = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", r"[0-9][0-9\x20-]*+"

#: Generators: kind of the span, pattern.
GENERATORS = (
    ("secret", r"(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{14,}"),
    ("number", r"[0-9(][0-9\x20().-]{6,40}[0-9]"),
    ("email", r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,64}){1,4}"),
    ("ip", r"(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}"),
)
#: A text without any of these has no candidate.
GATES = (r"[A-Za-z0-9_/+-]{14}", r"[0-9][0-9\x20().-]{6}", r"@|\(at\)|\[at\]", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")
CUES = {
    "cue_secret": r"(?i)(?:token|key|secret|passw|pwd|auth|session|credential)",
    "cue_contact": r"(?i)(?:mail|contact|phone|tel\b|call|fax|mobile|reach)",
    "cue_account": r"(?i)(?:card|visa|credit|account|iban|bank|ssn|social)",
    "cue_other": r"(?i)(?:order|version|date|page|isbn|year|item|part|since|model|chapter|figure)",
}
SAMPLE_ROWS, TREES, DEPTH, PRECISION = 8_000, 15, 4, 0.98
CONTEXT = 32


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Starts come from the lengths of the pieces between the matches.
    """
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("v")))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("out"))

    found = F.filter(both, lambda x: x["v"].isNotNull())
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass Luhn's check."""
    d = F.split(F.reverse(v), "")
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def with_base(docs: DataFrame) -> DataFrame:
    """Add ``_base``: array<struct<s, e, k>> of the base spans, k the kind's number; by start, then kind."""
    t = F.col("_t")
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def gated(gate: Column, found: Column) -> Column:
        return F.when(gate, found).otherwise(empty)

    loose = F.regexp_replace(t, LOOSE, "x")
    raw = docs.withColumns({
        "_0": gated(t.contains("@"), spans(t, EMAIL)),
        "_1": gated(t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), spans(t, IP)),
        "_2": F.when(t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), loose),
        "_3": gated(t.contains("+"), spans(t, PHONE)),
    }).withColumn("_2", F.when(F.col("_2").isNotNull(), spans(F.col("_2"), DIGIT_RUN)).otherwise(empty))
    small = lambda p: F.when(F.length(F.regexp_replace(p, r"^0+(?=[0-9])", "")) <= 3, F.regexp_replace(p, r"^0+(?=[0-9])", "").cast("int") <= 255).otherwise(False)
    keep = {
        "_1": lambda x: F.forall(F.split(x["v"], r"\."), small),
        "_2": lambda x: F.length(digits(x["v"])).between(12, 19) & luhn(digits(x["v"])),
        "_3": lambda x: F.length(digits(x["v"])).between(9, 15),
    }
    kept = raw.withColumns({k: F.filter(k, f) for k, f in keep.items()})

    def tagged_as(k: int) -> Column:
        return F.transform(f"_{k}", lambda x: F.struct(x["s"], x["e"], F.lit(k).alias("k")))

    tagged = [tagged_as(k) for k in range(len(BASE))]
    # start, then kind, then end
    order = F.transform(F.array_sort(F.transform(F.concat(*tagged), lambda x: F.struct(x["s"], x["k"], x["e"]))), lambda x: F.struct(x["s"], x["e"], x["k"]))
    return kept.withColumns({"_n": F.array(*[F.size(f"_{k}") for k in range(len(BASE))]), "_base": order}).drop("_0", "_1", "_2", "_3")


FEATURES = (*[f"is_{k}" for k, _ in GENERATORS], "length", "n_digits", "n_letters", "n_upper", "n_groups", "n_distinct", "luhn", "hexadecimal",
            "dated", "touches", "assigned", *CUES)


def features(v: Column, before: Column, after: Column, generator: Column) -> Column:
    """struct of FEATURES of a candidate ``v`` with the text around it; all doubles."""
    d = digits(v)
    yes = lambda c: c.cast("double")
    values = {f"is_{k}": yes(generator == i) for i, (k, _) in enumerate(GENERATORS)}
    values |= {
        "length": yes(F.length(v)), "n_digits": yes(F.length(d)), "n_letters": yes(F.length(F.regexp_replace(v, r"[^A-Za-z]", ""))),
        "n_upper": yes(F.length(F.regexp_replace(v, r"[^A-Z]", ""))), "n_groups": yes(F.size(F.split(v, r"[^A-Za-z0-9]+"))),
        "n_distinct": yes(F.size(F.array_distinct(F.split(v, "")))), "luhn": yes((d != "") & luhn(d)),
        "hexadecimal": yes(v.rlike(r"^[0-9a-fA-F]+$")), "dated": yes(v.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|[01][0-9][0-3][0-9]|$)")),
        "touches": yes(before.rlike(r"[\p{L}0-9_.@/-]$") | after.rlike(r"^[\p{L}0-9_@/-]")), "assigned": yes(before.rlike(r"""[=:]\s*["']?$""")),
    }
    values |= {name: yes(before.rlike(pattern)) for name, pattern in CUES.items()}
    return F.struct(*[values[n].alias(n) for n in FEATURES])


def labelled_candidates(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, generator, label, v, before, after): formats of personal data and of what resembles them, digits and words from hashes.

    The count of rows is the bound of the fit.
    """

    def pick(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def one_of(values: list[str], salt: int) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), pick(len(values), salt))

    dig = F.substring(F.regexp_replace(F.sha2(F.concat(F.lit("d"), F.col("id").cast("string")), 512), "[a-f]", ""), 1, 40)
    hexa, word = F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 18), "0123456789", "ghijklmnop")
    cut = lambda a, n: F.substring("_d", a, n)
    part = lambda c, a, least, most, salt: F.substring(c, F.lit(a), least + pick(most - least + 1, salt))
    year, letters = F.concat(one_of(["19", "20"], 9), cut(1, 2)), F.concat("_w", F.reverse("_w"), F.upper("_w"))
    name, place = part(F.col("_w"), 1, 2, 8, 11), part(F.col("_w"), 9, 3, 9, 12)
    secret, number, email, ip, iban = range(5)
    formats: list[tuple[int, int, Column]] = [
        # generator, label, text
        (number, 1, cut(1, 16)), (number, 1, F.concat_ws(" ", cut(1, 4), cut(5, 4), cut(9, 4), cut(13, 4))), (number, 1, F.concat_ws("-", cut(1, 4), cut(5, 4), cut(9, 4), cut(13, 4))),
        (number, 1, F.concat(F.lit("("), cut(1, 3), F.lit(") "), cut(4, 3), F.lit("-"), cut(7, 4))), (number, 1, F.concat_ws("-", cut(1, 3), cut(4, 3), cut(7, 4))),
        (number, 1, F.concat_ws("-", cut(1, 3), cut(4, 2), cut(6, 4))),
        (secret, 1, part(F.col("_h"), 1, 32, 64, 13)), (secret, 1, part(F.col("_h"), 5, 16, 40, 14)), (secret, 1, F.concat(F.lit("sk_"), part(F.col("_h"), 3, 20, 40, 15))),
        (secret, 1, F.base64(F.unhex(part(F.col("_h"), 1, 24, 40, 16)))),
        (email, 1, F.concat(name, F.lit(" (at) "), place, F.lit(".com"))), (email, 1, F.concat(name, F.lit("[at]"), place, F.lit("[dot]org"))),
        (email, 1, F.concat(name, F.lit(" @ "), place, one_of([".com", ".net", ".org"], 5))), (email, 1, F.concat(name, F.lit("."), place, F.lit("(at)"), place, F.lit(" (dot) fr"))),
        (ip, 1, F.concat_ws(":", *[F.substring("_h", 1 + 4 * i, 4) for i in range(8)])),
        (iban, 1, F.concat(one_of(["DE", "FR", "ES", "GB"], 5), cut(1, 18))), (iban, 1, F.concat_ws(" ", F.concat(one_of(["DE", "FR", "IT"], 5), cut(1, 2)), cut(3, 4), cut(7, 4), cut(11, 4), cut(15, 4))),
        (number, 0, F.concat_ws("-", year, cut(3, 2), cut(5, 2))), (number, 0, F.concat_ws(".", cut(3, 2), cut(5, 2), year)), (number, 0, F.concat_ws("-", year, year)),
        (number, 0, F.concat(cut(1, 1), F.lit("."), cut(2, 9))), (number, 0, F.concat_ws(".", cut(1, 1), cut(2, 3), cut(5, 3), cut(8, 3))), (number, 0, cut(1, 8)), (number, 0, F.concat(year, cut(3, 10))),
        (number, 0, F.concat_ws(" ", *[cut(1 + 2 * i, 2) for i in range(8)])), (number, 0, F.concat_ws(" ", *[cut(1 + i, 1) for i in range(12)])), (number, 0, F.concat(F.lit("978-"), cut(1, 1), F.lit("-"), cut(2, 4), F.lit("-"), cut(6, 4), F.lit("-"), cut(10, 1))),
        (secret, 0, part(F.lower(letters), 1, 14, 54, 13)), (secret, 0, part(F.lower(letters), 7, 14, 40, 14)), (secret, 0, part(letters, 20, 14, 34, 15)), (secret, 0, part(F.upper(letters), 3, 14, 50, 16)),
        (secret, 0, F.concat_ws("-", name, place, part(F.col("_w"), 4, 5, 12, 17))), (secret, 0, F.concat_ws("/", place, name, part(F.col("_w"), 4, 5, 12, 17))), (secret, 0, F.concat_ws("_", place, part(F.col("_w"), 4, 9, 14, 17), name)),
        (secret, 0, F.concat(part(F.lower(letters), 1, 12, 20, 18), year)), (secret, 0, F.concat_ws("-", part(F.col("_w"), 1, 8, 14, 17), year, cut(1, 2))), (secret, 0, F.repeat(F.lit("-"), 14 + pick(20, 13))), (secret, 0, F.repeat(F.lit("ab"), 8 + pick(20, 13))),
        (email, 0, F.concat(name, F.lit(" @ "), cut(1, 2), F.lit("."), cut(3, 2))), (email, 0, F.concat(F.lit("@"), name, F.lit("."), cut(3, 1))), (email, 0, F.concat(cut(1, 2), F.lit("@"), cut(1, 3), F.lit("."), cut(3, 2))),
        (ip, 0, F.concat_ws(":", cut(1, 2), cut(3, 2), cut(5, 2), cut(7, 2))),
        (iban, 0, F.concat(F.upper(F.substring("_w", 1, 2)), cut(1, 2), F.upper(F.substring("_w", 3, 12)))),
    ]
    cue = one_of(["", "", "", "see the ", "order ", "since ", "date: ", "page ", "version ", "card ", "call me at ", "my phone is ", "account ", "reach me: ", "item "], 6)
    with_cue = F.when(F.col("generator") == secret, F.when(F.col("label") == 1, one_of(['token = "', "password=", "api_key: ", "secret ", 'auth_token="', "session="], 7)).otherwise(
        one_of(["", "", "the ", "see ", "a key ", "model ", "part "], 7))).otherwise(cue)
    made = spark.range(0, rows, 1, 4).withColumns({"_d": dig, "_h": hexa, "_w": word, "_f": pick(len(formats), 1)})
    texts = F.array(*[F.struct(F.lit(g).alias("generator"), F.lit(lab).alias("label"), v.alias("v")) for g, lab, v in formats])
    out = made.withColumn("_x", F.get(texts, F.col("_f"))).select("id", "_x.*")
    stray = F.when(pick(6, 8) == 0, one_of(["-", "x", "_", "7"], 10)).otherwise(F.lit(""))
    return out.withColumns({"before": F.concat(F.lit("then "), with_cue), "after": F.concat(F.when(F.col("label") == 0, stray).otherwise(F.lit("")), F.lit(" and"))})


def tree_column(node, get) -> Column:
    """A fitted tree as nested conditions over ``get(feature number)``."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(get(split.featureIndex()) <= F.lit(float(split.threshold())), tree_column(node.leftChild(), get)).otherwise(tree_column(node.rightChild(), get))


class Detector:
    """Fitted trees and the threshold of each generator."""

    def __init__(self, spark: SparkSession, rows: int = SAMPLE_ROWS):
        made = labelled_candidates(spark, rows)
        made = made.withColumn("f", features(F.col("v"), F.col("before"), F.col("after"), F.col("generator"))).select("id", "generator", "label", "f.*")
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("id", "generator", F.col("label").cast("double").alias("label"), "features")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, stepSize=0.3).fit(vectors.where("id % 2 = 0"))
        self.trees = [(float(w), t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)]
        held = model.transform(vectors.where("id % 2 = 1")).select("generator", "label", F.round(vector_to_array("probability")[1], 6).alias("p"))
        # the lowest score from which on the labelled candidates of a generator have the wanted precision
        at = held.groupBy("generator", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
        above = W.partitionBy("generator").orderBy(F.desc("p"))
        run = at.withColumn("share", F.sum("good").over(above) / F.sum("n").over(above))
        got = {r.generator: r.p for r in run.where(F.col("share") >= PRECISION).groupBy("generator").agg(F.min("p").alias("p")).collect()}
        self.thresholds = [max(0.5, got.get(i, 1.1)) for i in range(len(GENERATORS))]

    def score(self, f: Column) -> Column:
        """The probability that a candidate with the features ``f`` is personal data."""
        margin = reduce(lambda a, b: a + b, [F.lit(w) * tree_column(root, lambda i: f[FEATURES[i]]) for w, root in self.trees])
        return 1 / (1 + F.exp(-2 * margin))

    def detect(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) of every row of ``docs``.

        ``found`` is array<struct<s, e, kind, score>> of all spans (score 1 for base ones) by start, then kind.  Null
        texts are empty; rows that repeat are judged alike; ids pass through, null ones too.
        """
        t = F.col("_t")
        based = with_base(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")))
        none = F.array().cast("array<struct<s:int,e:int,v:string,g:int>>")

        def proposals(i: int) -> Column:
            found = F.transform(spans(t, GENERATORS[i][1]), lambda x: F.struct(x["s"], x["e"], x["v"], F.lit(i).alias("g")))
            return F.when(t.rlike(GATES[i]), found).otherwise(none)

        raw = [proposals(i) for i in range(len(GENERATORS))]
        proposed = based.withColumns({f"_g{i}": c for i, c in enumerate(raw)}).withColumn("_c", F.concat(*[f"_g{i}" for i in range(len(raw))]))
        free = F.filter("_c", lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

        def described(c: Column) -> Column:
            before = F.substring(t, F.greatest(F.lit(1), c["s"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), c["s"]))
            return F.struct(c["s"], c["e"], c["g"], features(c["v"], before, F.substring(t, c["e"] + 1, F.lit(2)), c["g"]).alias("f"))

        limit = F.array(*[F.lit(x) for x in self.thresholds])
        scored = proposed.withColumn("_c", free).withColumn("_c", F.transform("_c", described)).withColumn(
            "_c", F.transform("_c", lambda c: F.struct((-self.score(c["f"])).alias("p"), c["s"], c["e"], c["g"])))
        good = F.array_sort(F.filter("_c", lambda c: -c["p"] >= F.get(limit, c["g"])))
        empty = F.array().cast("array<struct<p:double,s:int,e:int,g:int>>")
        apart = F.aggregate("_c", empty, lambda acc, c: F.when(F.exists(acc, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])), acc).otherwise(F.concat(acc, F.array(c))))
        chosen = scored.withColumn("_c", good).withColumn("_c", apart)
        names = [*BASE, *[k for k, _ in GENERATORS if k not in BASE]]
        kinds = F.array(*[F.lit(n) for n in names])
        own = F.array(*[F.lit(names.index(k)) for k, _ in GENERATORS])
        every = F.array_sort(F.concat(
            F.transform("_base", lambda b: F.struct(b["s"], b["k"], b["e"], F.lit(1.0).alias("score"))),
            F.transform("_c", lambda c: F.struct(c["s"], F.get(own, c["g"]).alias("k"), c["e"], (-c["p"]).alias("score")))))
        name = lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
        return chosen.withColumn("_all", every).select(
            "doc_id", *[F.get("_n", F.lit(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
            F.sha2(F.array_join(F.transform("_base", name), ","), 256).alias("base_sha256"),
            F.array_join(F.transform("_all", name), ",").alias("spans"),
            F.transform("_all", lambda x: F.struct(x["s"], x["e"], F.get(kinds, x["k"]).alias("kind"), x["score"])).alias("found"))
