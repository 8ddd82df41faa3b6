"""Secrets: strong formats by pattern, weak parts of credentials by linking them with one another.

Three base kinds are found by pattern and length and always stay: ``assign`` (a secret word with its value), ``access``
(an access identifier) and ``hex``.  Beside them, weak parts are proposed that mean nothing alone: an identifier
(``user = ada``), a short or unmarked secret, an endpoint (an address or host).  A credential has several parts, so a weak
part is reported only where the parts that complete it stand in its scope: a secret beside an identifier, an identifier beside a
secret, an endpoint beside both.  Base spans count as parts: ``access`` as identifier, the others as secrets.

A scope reaches ``SCOPE`` code points before and behind a part's start and never over an empty line.  Parts and scopes are
joined as sorted intervals within the row, in one sweep over the parts in each direction that carries the nearest part of each role: a document is
judged where it is read, without a shuffle, and the work grows with its parts, not with their pairs.

SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The whole match has 16 characters or more; a shorter one holds no other that is long enough.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

IDENTIFIER, SECRET, ENDPOINT = range(3)
ROLES = ("identifier", "secret", "endpoint")
#: Role of each base kind.
BASE_ROLES = (SECRET, IDENTIFIER, SECRET)
_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: Weak parts in the order in which they win over others that overlap them: role, pattern whose group 1 (at its end) is the part.
GENERATORS = (
    (IDENTIFIER, r"(?:^|[^A-Za-z])(?i:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id|app_?id|tenant(?:_?id)?|key_?id)"
     + _SET + r"([A-Za-z0-9@._+-]{3,64})"),
    (SECRET, r"(?:^|[^A-Za-z])(?i:pass(?:word|wd|phrase)?|pwd|pin|secret(?:_?key)?|token|api_?key|(?:private_?|access_?)?key|auth|credentials?|sig(?:nature)?)"
     + _SET + r"""([^\x00-\x20"',;<>]{4,})"""),
    (ENDPOINT, r"((?:https?|wss?|s?ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x00-\x20\"'<>]+)"),
    (ENDPOINT, r"(?:^|[^A-Za-z])(?i:host(?:name)?|endpoint|server|region|bucket|(?:db_?|base_?)?url)" + _SET + r"([A-Za-z0-9.:/_-]{3,})"),
    (IDENTIFIER, r"(A(?:KIA|SIA)[A-Z0-9]{4,})"),
    (SECRET, r"([A-Za-z0-9+/_-]{16,}={0,2})"),
)
#: A text without this has no part of the generator; each follows from the pattern.
GATES = (r"(?i)(?:user|name|id|login|account|tenant)[\"']?\x20*[:=]", r"(?i)(?:pass|word|wd|phrase|pin|secret|key|token|auth|credentials?|sig|signature)[\"']?\x20*[:=]",
         r"://", r"(?i)(?:host|name|endpoint|server|region|bucket|url)[\"']?\x20*[:=]", r"A(?:KIA|SIA)", r"[A-Za-z0-9+/_-]{16}")
SCOPE = 600
EMPTY_LINE = r"\n[\x20\t\r]*\n"
#: Results of a sweep are gathered in pieces of this many, so that a long sweep copies each of them a few times only.
PIECE = 256
SPAN = "struct<s:int,e:int,v:string>"
PART = "struct<s:int,g:int,e:int,r:int>"


def sweep(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The outputs, an array of type ``kind``, of ``step`` (state, item) -> (state, output) over ``items``."""
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"), none.alias("cur"))

    def merge(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        full = F.size(acc["cur"]) >= PIECE
        return F.struct(after.alias("state"), F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
                        F.concat(F.when(full, none).otherwise(acc["cur"]), F.array(out)).alias("cur"))

    return F.aggregate(items, start, merge, lambda acc: F.concat(F.flatten(acc["done"]), acc["cur"]))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches, in code points, end exclusive; none of them is empty."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["v"])
        return end, F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"))

    # the piece behind the last match has none
    return sweep(F.filter(both, lambda x: x["v"].isNotNull()), F.lit(0), step, SPAN)


def gated(gate: Column, found: Column, kind: str = SPAN) -> Column:
    return F.when(gate, found).otherwise(F.array().cast(f"array<{kind}>"))


def with_base(docs: DataFrame) -> DataFrame:
    """Add ``_n`` (counts by kind) and ``_base``: array<struct<s, g, e, r>> by start, then kind (g = kind - number of kinds, below 0)."""
    t = F.col("_t")
    raw = docs.withColumns({
        "_0": gated(t.rlike(r"(?i)(?:passw|secret|token|api_?key)"), spans(t, ASSIGN)),
        "_1": gated(t.contains("AKIA"), spans(t, ACCESS)),
        "_2": gated(t.rlike(HEX), spans(t, HEX)),
    }).withColumn("_0", F.filter("_0", lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= ASSIGN_LEAST))

    def part(k: int) -> Column:
        return F.transform(f"_{k}", lambda x: F.struct(x["s"], F.lit(k - len(BASE)).alias("g"), x["e"], F.lit(BASE_ROLES[k]).alias("r")))

    kinds = range(len(BASE))
    return raw.withColumns({"_n": F.array(*[F.size(f"_{k}") for k in kinds]), "_base": F.array_sort(F.concat(*[part(k) for k in kinds]))}).drop(
        *[f"_{k}" for k in kinds])


def _weak(t: Column, g: int) -> Column:
    """The weak parts of one generator."""
    role, pattern = GENERATORS[g]
    found = spans(t, pattern)
    if g == len(GENERATORS) - 1:
        mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & (v.rlike("[A-Z]") | v.rlike("^[0-9a-f]+$"))
        found = F.filter(found, lambda x: mixed(x["v"]))
    own = F.transform(found, lambda x: F.struct(
        (x["e"] - F.length(F.regexp_extract(x["v"], pattern, 1))).alias("s"), F.lit(g).alias("g"), x["e"], F.lit(role).alias("r")))
    return gated(t.rlike(GATES[g]), own, PART)


FAR = 1 << 30


def _overlaps(parts: Column, forward: bool) -> Column:
    """For each part: whether a part that wins over it and lies before it (behind it, if not ``forward``) overlaps it; the same of
    base spans; whether a base span holds it.  Parts come by start, then g, and from the end if not ``forward``."""
    n = len(GENERATORS)
    state = F.struct(*[F.lit(-1 if forward else FAR).alias(f"m{g}") for g in range(-1, n - 1)])

    def step(m: Column, x: Column) -> tuple[Column, Column]:
        # the greatest end so far, or the least start, of base spans and of each generator
        edge = {g: m[f"m{g}"] for g in range(-1, n - 1)}
        meets = {g: (edge[g] > x["s"]) if forward else (edge[g] < x["e"]) for g in edge}
        beaten = reduce(lambda a, b: a | b, [meets[g] & (x["g"] > g) for g in range(n - 1)])
        after = F.struct(*[F.when(F.greatest(x["g"], F.lit(-1)) == g, F.greatest(edge[g], x["e"]) if forward else F.least(edge[g], x["s"]))
                           .otherwise(edge[g]).alias(f"m{g}") for g in edge])
        held = (edge[-1] >= x["e"]) if forward else F.lit(False)
        return after, F.struct(beaten.alias("beaten"), meets[-1].alias("base"), held.alias("held"))

    return sweep(parts, state, step, "struct<beaten:boolean,base:boolean,held:boolean>")


def _near(parts: Column, forward: bool) -> Column:
    """For each part the roles that stand before it (behind it) in its scope; a part of role -1 is an empty line."""
    lost = -FAR if forward else FAR
    state = F.struct(*[F.lit(lost).alias(f"r{r}") for r in range(3)])

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        near = F.struct(*[(F.abs(x["s"] - last[f"r{r}"]) <= SCOPE).alias(f"r{r}") for r in range(3)])
        after = F.struct(*[F.when(x["r"] == -1, F.lit(lost)).when(x["r"] == r, x["s"]).otherwise(last[f"r{r}"]).alias(f"r{r}") for r in range(3)])
        return after, near

    return sweep(parts, state, step, "struct<r0:boolean,r1:boolean,r2:boolean>")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found) of every row of ``docs`` (doc_id, text, ...).

    ``found`` is array<struct<s, e, kind>> of the base spans and the linked weak ones, by start, then kind in the order of
    BASE and ROLES; ``spans`` names them in one string, and base_sha256 digests the base ones.  Of weak parts that
    overlap, that of the earlier generator stays; one that a base span holds is no part, and one that overlaps a base
    span and reaches beyond it is reported with it.  Null and empty texts have none; rows that repeat are judged alike; ids of any
    type pass through, null ones too; other columns are ignored, so none can clash; an empty table gives none.
    """
    t = F.col("_t")
    based = with_base(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")))
    gens = range(len(GENERATORS))
    proposed = based.withColumns({f"_w{g}": _weak(t, g) for g in gens}).withColumn("_w", F.concat(*[f"_w{g}" for g in gens]))
    no_part = F.array().cast(f"array<{PART}>")
    some = F.size("_w") > 0
    ordered = proposed.withColumn("_p", F.when(some, F.array_sort(F.concat("_base", "_w"))).otherwise(no_part))
    judged = ordered.withColumns({"_f": _overlaps(F.col("_p"), True), "_b": F.reverse(_overlaps(F.reverse("_p"), False))})
    # base spans, weak parts apart from all that win over them, weak parts that outgrow a base span
    state = F.transform("_p", lambda x, i: F.when(x["g"] < 0, "base").when(
        F.get("_f", i)["beaten"] | F.get("_b", i)["beaten"] | F.get("_f", i)["held"], "none").when(
        F.get("_f", i)["base"] | F.get("_b", i)["base"], "grown").otherwise("weak"))
    named = judged.withColumn("_s", state).withColumns({
        "_grown": F.filter("_p", lambda x, i: F.get("_s", i) == "grown"),
        "_q": F.filter("_p", lambda x, i: F.get("_s", i).isin("base", "weak")),
    })
    breaks = F.transform(spans(t, EMPTY_LINE), lambda x: F.struct(x["s"], F.lit(len(GENERATORS)).alias("g"), x["e"], F.lit(-1).alias("r")))
    linked = named.withColumn("_q", F.when(F.exists("_q", lambda x: x["g"] >= 0), F.array_sort(F.concat("_q", breaks))).otherwise(no_part)).withColumns(
        {"_f": _near(F.col("_q"), True), "_b": F.reverse(_near(F.reverse("_q"), False))})

    def completed(x: Column, i: Column) -> Column:
        near = [F.get("_f", i)[f"r{r}"] | F.get("_b", i)[f"r{r}"] for r in range(3)]
        return (x["g"] >= 0) & (x["r"] >= 0) & F.when(x["r"] == IDENTIFIER, near[SECRET]).when(x["r"] == SECRET, near[IDENTIFIER]).otherwise(
            near[IDENTIFIER] & near[SECRET])

    kinds = F.array(*[F.lit(k) for k in (*BASE, *ROLES)])
    own = lambda x: F.struct(x["s"], (x["r"] + len(BASE)).alias("k"), x["e"])
    every = F.array_sort(F.concat(
        F.transform("_base", lambda x: F.struct(x["s"], (x["g"] + len(BASE)).alias("k"), x["e"])),
        F.transform("_grown", own), F.transform(F.filter("_q", completed), own)))
    name = lambda k, x: F.concat_ws(":", F.get(kinds, k), x["s"].cast("string"), x["e"].cast("string"))
    return linked.withColumn("_all", every).select(
        "doc_id", *[F.get("_n", F.lit(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(F.array_join(F.transform("_base", lambda x: name(x["g"] + len(BASE), x)), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("_all", lambda x: name(x["k"], x)), ",").alias("spans"),
        F.transform("_all", lambda x: F.struct(x["s"], x["e"], F.get(kinds, x["k"]).alias("kind"))).alias("found"))
