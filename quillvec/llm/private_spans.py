"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are what four base patterns match and what looser patterns (obfuscated
addresses, defanged network numbers, national phone numbers, 15-digit cards) add.
Seven labelers vote for, against or not at all on each: the strict pattern, a
validity test, a gazetteer, the words on both sides, a cue of a person or an address, the
form in which digits or names are grouped, and the neighbouring characters. Words on a side
are those up to the next match of the same pattern.
Votes of all documents are counted by pattern of votes, a table of at most 8748
rows; expectation-maximisation on it estimates how reliable each labeler
is, and a logistic classifier is trained on the resulting probabilities. The
classifier is then a column expression over the votes. Valid base matches are
always kept; the classifier decides on the others.

Everything is built-in expressions over the scan; nothing but vote counts is
shuffled or collected.

Defined results: null and empty texts have no spans; places are code points, the
end exclusive; spans of different kinds may overlap; repeated rows are judged
alike; columns called like those this adds (``spans``, ``_spans``) are replaced; an empty table gives no rows and a classifier that accepts nothing more.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"

# Possessive forms of the agreed patterns: a run is tried from its start (or from
# the end of the last match) only, so a long run costs linear time and no stack.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?+[\[(]at[\])]\x20?+{_HOST}++(?:(?:\x20?+[\[(]dot[\])]\x20?+|\.){_HOST}++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z+-])3[47][0-9]{2}[\x20-]?+[0-9]{6}[\x20-]?+[0-9]{5}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?+|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}

# Gazetteers and context words of the four kinds: our own choice.
DOMAINS = (
    "com org net edu gov mil int io info biz name pro dev app me co tv de fr es uk eu us ca au ch at it nl "
    "be dk se no fi pl cz pt ie gr ro hu ru ua tr in jp cn kr br mx ar cl za nz sg hk"
).split()
PERSON = (
    r"\b(?:my|our|your|his|her|mein|meine|unser|ihre?|mon|ma|notre|votre|mi|su|nuestro|mr|mrs|ms|dr|herr|frau|"
    r"monsieur|madame|se[nñ]or|se[nñ]ora|name|call me|dear|signed|from|to|cc|user|customer|patient|employee|"
    r"street|road|avenue|stra[sß]e|stra(?:ss|ß)e|rue|calle|plaza|platz|zip|city|apt)\b"
)
CONTEXT = {
    "email": r"e-?mail|mail|contact|kontakt|courriel|correo|write|reach",
    "ip": r"\bip\b|address|adresse|host|server|client|login",
    "card": r"card|visa|credit|karte|carte|tarjeta|amex|payment",
    "phone": r"phone|\btel|call|fax|mobile|cell|anruf|appel|ll[aá]m",
}
AGAINST = r"version|build|release|isbn|issn|sku|serial|order|invoice|price|total|figure|section"
CONTEXT_CHARS = 24
LABELERS = ("strict", "valid", "listed", "context", "person", "form", "border")


class Model(NamedTuple):
    """``intercept`` per kind and ``weights`` per labeler for votes against and for."""

    intercept: dict[str, float]
    weights: dict[str, tuple[float, float]]
    reliability: dict[str, float]


def _total(some: Column) -> Column:
    return F.aggregate(some, F.lit(0), lambda a, x: a + x)


def _located(staged: DataFrame, text: Column, wanted: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Adds, by name, the matches of ``(pattern, guard, loose)`` with their places.

    Places follow from the lengths of what lies between matches and in them. The
    running sums go by stretches of about the square root of the number of matches:
    inside a stretch and over the stretches before it, so a text with very many
    matches costs little more per match than others. Every array is a column that later
    steps use more than once; otherwise the optimiser would put its expression into
    the functions that run for each element.
    """
    span = "array<struct<start:int,end:int,m:string,loose:boolean,before:string,after:string>>"

    def add(staged: DataFrame, part: str, make) -> DataFrame:
        # A kind without matches has no arrays at all.
        def made(name: str) -> Column:
            return F.when(F.coalesce(F.size(f"{name}_found"), F.lit(0)) > 0, make(name))

        return staged.withColumns({f"{name}{part}": made(name) for name in wanted})

    def step(name: str) -> Column:
        return F.ceil(F.sqrt(F.size(f"{name}_sizes"))).cast("int")

    def size(name: str) -> Column:
        between = F.slice(f"{name}_gaps", F.lit(1), F.size(f"{name}_found")).alias("gap")
        pairs = F.arrays_zip(between, F.col(f"{name}_found").alias("m"))
        return F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["m"]))

    def stretch(name: str) -> Column:
        of = F.sequence(F.lit(0), F.floor((F.size(f"{name}_sizes") - 1) / step(name)).cast("int"))
        return F.transform(of, lambda k: _total(F.slice(f"{name}_sizes", k * step(name) + 1, step(name))))

    def before(name: str) -> Column:
        of = F.sequence(F.lit(0), F.size(f"{name}_sums") - 1)
        return F.transform(of, lambda k: _total(F.slice(f"{name}_sums", F.lit(1), k)))

    def end(name: str) -> Column:
        def upto(x: Column, i: Column) -> Column:
            k = F.floor(i / step(name)).cast("int")
            inside = _total(F.slice(f"{name}_sizes", k * step(name) + 1, i - k * step(name) + 1))
            return F.get(F.col(f"{name}_before"), k) + inside

        return F.when(F.size(f"{name}_before") > 0, F.transform(f"{name}_sizes", upto))

    def placed(name: str) -> Column:
        count = F.size(f"{name}_found")
        pairs = F.arrays_zip(
            F.col(f"{name}_found").alias("m"),
            F.col(f"{name}_ends").alias("end"),
            F.slice(f"{name}_gaps", F.lit(1), count).alias("before"),
            F.slice(f"{name}_gaps", F.lit(2), count).alias("after"),
        )
        return F.transform(
            pairs,
            lambda p: F.struct(
                (p["end"] - F.char_length(p["m"])).alias("start"),
                p["end"].alias("end"),
                p["m"].alias("m"),
                F.lit(wanted[name][2]).alias("loose"),
                F.right(p["before"], F.lit(CONTEXT_CHARS)).alias("before"),
                F.left(p["after"], F.lit(CONTEXT_CHARS)).alias("after"),
            ),
        ).cast(span)

    staged = staged.withColumns(
        {
            f"{name}_found": F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
            for name, (pattern, guard, _) in wanted.items()
        }
    )
    staged = add(staged, "_gaps", lambda name: F.split(text, wanted[name][0], -1))
    for part, make in (
        ("_sizes", size),
        ("_sums", stretch),
        ("_before", before),
        ("_ends", end),
        ("", placed),
    ):
        staged = add(staged, part, make)
    parts = ("found", "gaps", "sizes", "sums", "before", "ends")
    staged = staged.drop(*(f"{name}_{part}" for name in wanted for part in parts))
    return staged.withColumns({name: F.coalesce(F.col(name), F.array().cast(span)) for name in wanted})


def _guards(text: Column) -> dict[str, tuple[Column, Column]]:
    """Cheap tests that a text can hold a base match or a loose match of a kind."""
    bracket = text.contains("at)") | text.contains("at]")
    return {
        "email": (text.contains("@"), bracket),
        "ip": (text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), text.contains("[.]")),
        "card": (
            text.rlike(r"[0-9](?:[\x20-]?+[0-9]){15}"),
            text.rlike(r"3[47][0-9]{2}[\x20-]?+[0-9]{6}"),
        ),
        "phone": (text.contains("+"), text.rlike(r"[0-9]{3}[.-][0-9]{4}")),
    }


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid_base(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(m)).otherwise(False)
    return n.between(8, 15)


def _votes(kind: str, s: Column) -> Column:
    """The votes on a candidate, each -1, 0 or 1."""
    m, before, after = s["m"], F.lower(s["before"]), F.lower(s["after"])
    digits = _digits(m)
    valid = {
        "email": m.rlike(r"[A-Za-z]{2,}$"),
        "ip": _valid_base("ip", F.regexp_replace(m, r"[\[\]]", "")),
        "card": F.when(F.char_length(digits).between(13, 19), _luhn(m)).otherwise(False),
        "phone": F.char_length(digits).between(8, 15) | (F.char_length(digits) == 10),
    }[kind]
    listed = {
        "email": F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(DOMAINS),
        "ip": ~m.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\D"),
        "card": digits.rlike("^[3-6]"),
        "phone": digits.rlike("^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
    }[kind]

    form = {
        # Two names or initials before the sign, or a single word and no digits after it.
        "email": m.rlike(r"^[A-Za-z]+(?:[._-][A-Za-z]+)*[0-9]{0,4}\W"),
        "ip": m.rlike(r"^(?:10|127|172|192)\D") | ~m.rlike(r"(?:^|\D)[0-9](?:\D+[0-9]){3}$"),
        "card": m.rlike(r"^[0-9]{4}(?:[\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$|^[0-9]{16}$"),
        "phone": m.rlike(r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,5}){1,4}$")
        | m.rlike(r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}$"),
    }[kind]
    broken = {
        "email": m.rlike(r"\.\.|^[.%+-]"),
        "ip": m.rlike(r"(?:^|\D)0[0-9]"),
        "card": m.rlike(r"[\x20-](?:[0-9]{1,2}[\x20-]){3}"),
        "phone": m.rlike(r"[.-]{2}|\([^)]*$"),
    }[kind]

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    none = F.lit(False)
    return F.struct(
        vote(s["valid"], ~s["loose"] & ~s["valid"]).alias("strict"),
        vote(valid, ~valid).alias("valid"),
        vote(listed, ~listed).alias("listed"),
        vote(
            before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind]), before.rlike(AGAINST)
        ).alias("context"),
        vote(before.rlike(PERSON) | after.rlike(PERSON), before.rlike(r"[=<>/{}\[\]|]\s*$")).alias("person"),
        vote(form & ~broken, broken).alias("form"),
        vote(none, before.rlike(r"[\w$€£#]$") | after.rlike(r"^\w")).alias("border"),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_spans``: an array of candidates with kind, place, base flag and votes."""
    raw = whole(text)
    staged = docs.withColumn("_text", raw)
    raw = F.col("_text")
    guards = _guards(raw)
    staged = _located(
        staged,
        raw,
        {f"_b_{k}": (BASE[k], guards[k][0], False) for k in KINDS}
        | {f"_l_{k}": (LOOSE[k], guards[k][1], True) for k in KINDS},
    )

    def checked(kind: str) -> Column:
        def fields(s: Column, valid: Column) -> Column:
            return F.struct(s["start"], s["end"], s["m"], s["loose"], s["before"], s["after"], valid.alias("valid"))

        base = F.transform(f"_b_{kind}", lambda s: fields(s, _valid_base(kind, s["m"])))
        loose = F.transform(f"_l_{kind}", lambda s: fields(s, F.lit(False)))
        return F.concat(base, loose)

    staged = staged.withColumns({f"_c_{k}": checked(k) for k in KINDS}).drop(
        *(f"_{p}_{k}" for p in "bl" for k in KINDS)
    )
    # A candidate that overlaps a valid base match is no other find.
    staged = staged.withColumn(
        "_base", F.flatten(F.array(*(F.filter(f"_c_{k}", lambda s: s["valid"]) for k in KINDS)))
    )

    def open_(s: Column) -> Column:
        return s["valid"] | ~F.exists(
            "_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        )

    def voted(rank: int, kind: str) -> Column:
        return F.transform(
            F.filter(f"_c_{kind}", open_),
            lambda s: F.struct(
                F.lit(rank).alias("rank"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["valid"].alias("base"),
                _votes(kind, s).alias("votes"),
            ),
        )

    return staged.withColumn(
        "_spans", F.flatten(F.array(*(voted(i, k) for i, k in enumerate(KINDS))))
    ).drop("_text", "_base", *(f"_c_{k}" for k in KINDS))


def vote_counts(found: DataFrame) -> list[tuple]:
    """``(kind rank, votes, count)`` over all candidates: at most ``4 * 3**7`` rows."""
    # A condition on the array would be moved below the steps that make it, with all of
    # their expressions put into one; on the exploded rows it stays where it is.
    rows = (
        found.select(F.explode_outer("_spans").alias("s"))
        .where("s is not null")
        .select("s.rank", *(F.col(f"s.votes.{v}").alias(v) for v in LABELERS))
        .groupBy("rank", *LABELERS)
        .count()
        .collect()
    )
    return sorted((r["rank"], tuple(r[v] for v in LABELERS), r["count"]) for r in rows)


def fit(counts: list[tuple], rounds: int = 50, steps: int = 400) -> Model:
    """EM over the vote counts, then a logistic classifier on its probabilities."""
    side = {-1: 0, 0: 1, 1: 2}
    truth = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v, _ in counts]
    prior, table = {}, {}
    for _ in range(rounds):
        for k in range(len(KINDS)):
            of = [(t, n) for (kind, _, n), t in zip(counts, truth, strict=True) if kind == k]
            prior[k] = (1 + sum(t * n for t, n in of)) / (2 + sum(n for _, n in of))
        for j in range(len(LABELERS)):
            for y in (0, 1):
                mass = [1.0, 1.0, 1.0]
                for (_, v, n), t in zip(counts, truth, strict=True):
                    mass[side[v[j]]] += n * (t if y else 1 - t)
                table[j, y] = [m / sum(mass) for m in mass]
        new = []
        for k, v, _ in counts:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(
                math.log(table[j, 1][side[x]] / table[j, 0][side[x]]) for j, x in enumerate(v)
            )
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        truth = new
    # Gradient steps with a small penalty; every row of the table weighs by its log count.
    width = len(KINDS) + 2 * len(LABELERS)
    weight = [0.0] * width
    rows = [
        ([k] + [len(KINDS) + 2 * j + (x > 0) for j, x in enumerate(v) if x], t, math.log1p(n))
        for (k, v, n), t in zip(counts, truth, strict=True)
    ]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        slope = [0.002 * w for w in weight]
        for places, t, n in rows:
            p = 1 / (1 + math.exp(-sum(weight[i] for i in places)))
            for i in places:
                slope[i] += (p - t) * n / total
        weight = [w - 2.0 * s for w, s in zip(weight, slope, strict=True)]
    base = len(KINDS)
    return Model(
        {k: weight[i] for i, k in enumerate(KINDS)},
        {v: (weight[base + 2 * j], weight[base + 2 * j + 1]) for j, v in enumerate(LABELERS)},
        {
            v: table[j, 1][2] / (table[j, 1][2] + table[j, 0][2]) if table else 0.5
            for j, v in enumerate(LABELERS)
        },
    )


def _accepts(model: Model, s: Column) -> Column:
    """At least two labelers for it, and the classifier's probability over one half."""
    intercept = F.element_at(F.array(*(F.lit(model.intercept[k]) for k in KINDS)), s["rank"] + 1)
    score, agree = intercept, F.lit(0)
    for v in LABELERS:
        against, for_ = model.weights[v]
        score = score + F.when(s["votes"][v] < 0, against).when(s["votes"][v] > 0, for_).otherwise(0.0)
        agree = agree + F.when(s["votes"][v] > 0, 1).when(s["votes"][v] < 0, -1).otherwise(0)
    return s["base"] | ((score > 0) & (agree >= 2))


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` plus ``spans``: an array of (rank, kind, start, end, base) by kind and start."""
    found = candidates(docs, text)
    model = model or fit(vote_counts(found))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform(
        F.filter("_spans", lambda s: _accepts(model, s)),
        lambda s: F.struct(
            s["rank"], s["start"], s["end"], s["base"], F.element_at(names, s["rank"] + 1).alias("kind")
        ),
    )
    return found.withColumn("spans", F.array_sort(spans)).drop("_spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` (the last as text)."""
    found = find(docs, text)
    base = F.filter("spans", lambda s: s["base"])

    def count(rank: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")

    counts = {f"n_{k}": count(i) for i, k in enumerate(KINDS)}
    return (
        found.withColumn("_base", base)
        .withColumns({**counts, "base_sha256": F.sha2(joined(F.col("_base")), 256), "spans": joined(F.col("spans"))})
        .drop("_base")
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null stays null."""
    found = find(docs, text)
    by_place = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        kept = F.when(
            s["start"] >= acc["at"],
            F.concat(
                acc["out"],
                F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]),
                F.lit("["),
                F.upper(s["kind"]),
                F.lit("]"),
            ),
        ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("out"))

    masked = F.aggregate(
        by_place,
        start,
        put,
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(text))),
    )
    return found.withColumn(
        text, F.when(F.size("spans") > 0, masked).otherwise(F.col(text))
    ).drop("spans")
