"""Personal data by weak supervision, with DataFrame functions only.

Four kinds of spans are found by exact patterns (the base rules, which stay in any case) and by looser ones: addresses
written out, sixteen digits beside other digits, numbers without a country code, addresses of eight groups. Labelers of three
sorts vote on every span (patterns and checksums, lists of known names and prefixes, words around it), for, against or not
at all. Votes are counted by pattern over all documents; expectation-maximisation estimates from the counts how each labeler
votes on true and on false spans, and a logistic regression, trained on the resulting probabilities, decides which of the
looser spans are added.

What leaves a task before the counts is a row per pattern of votes, of which there are at most KINDS x 3^labelers x shapes,
whatever the number of documents; the driver sees their sums per round, and coefficients. Spans stay in their document's row.

Defined results: null text counts as empty, and has no spans; a text of any length is searched whole, prefix sums by
blocks keep the work near the number of spans; rows are independent but for the counts, so repeated rows and those without
an id stay as they are (each copy counts); an added span overlaps no base span and no other added one; where no span at all
is found, none is added; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL = "[A-Za-z0-9._%+-]"
#: The base rules. A run is entered at its start only, and kept whole (possessive), so that long runs take linear time; a
#: card has sixteen digits at least, which a run of digits either has or has not.
BASE = {
    EMAIL: rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9]){15,}+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_AT, _DOT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_LONG = r"[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}|[0-9]{13,19}"
#: The looser rules, in one pattern, so that their spans are disjoint.
LOOSE = "(?i)" + "|".join((
    rf"(?<!{LOCAL}){LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z:.])(?:[0-9a-f]{1,4}::?){2,7}[0-9a-f]{1,4}(?![0-9A-Za-z:])",
    rf"(?<![0-9])(?:{_LONG})(?![0-9])",
    r"(?<![0-9A-Za-z+().:-])(?:(?:\+|00[\x20-]?)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])",
))
#: Texts without any of these have no looser span.
_WORTH = r"(?i)[0-9](?:[\x20./()-]{0,2}[0-9]){5}|[0-9a-f]::?[0-9a-f]{1,4}:|\x20dot\x20|[(\[{]\x20?(?:at|dot)|\x20@|@\x20"
#: Code points before and after a span in which words speak for it or against it.
BEFORE, AFTER = 48, 24

# Lists of known names and prefixes.
DOMAINS = "com org net edu gov info biz io co de fr es it uk us eu ch at nl be pl se no dk fi pt ru cn jp kr in br ca au mx"
ISSUERS = r"^(?:4|5[1-5]|2(?:2[2-9]|[3-6][0-9]|7[01]|720)|3[4-8]|6(?:011|4[4-9]|5))"
CALLING = r"^\+?(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PRIVATE = r"^0*(?:0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    EMAIL: "e-?mails?|mail|contact|write to|reach|correo|courriel|kontakt|adresse",
    IP: "ips?|ip address|address|host|server|login|client|adresse|direcci[oó]n",
    CARD: "cards?|credit|debit|visa|mastercard|amex|payment|tarjeta|carte|karte|kreditkarte",
    PHONE: "phone|tel|telephone|call|mobile|cell|fax|whatsapp|tel[eé]fono|t[eé]l[eé]phone|telefon|rufen",
}
AGAINST = "version|release|order|invoice|isbn|issn|doi|serial|sku|part|ref|reference|chapter|page|pages|section|total|price|token|hash|date|time"
LABELERS = ("form", "checksum", "list", "words for", "words against", "edges")

#: Rounds of expectation-maximisation, its prior counts of votes against, none and for, of true spans and of false ones, and
#: the least probability of an added span.
ROUNDS, PRIOR, SURE = 20, ((1.0, 2.0, 4.0), (4.0, 2.0, 1.0)), 0.9
#: Entries that one step of a running sum copies.
BLOCK = 256


def running(values, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What ``op`` makes of all values before each, by blocks: an array grows by steps of one within a block only."""

    def within(block, first):
        state = F.struct(first.alias("so_far"), F.filter(F.array(first), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(block, state, lambda s, v: F.struct(op(s["so_far"], v).alias("so_far"), F.array_append(s["out"], s["so_far"]).alias("out")), lambda s: s["out"])

    count = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK))))
    firsts = within(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, v: op(a, v))), zero)
    return F.coalesce(F.flatten(F.zip_with(blocks, firsts, within)), F.filter(F.array(zero), lambda _: F.lit(False)))


def digits(piece) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def luhn(number) -> Column:
    back = F.reverse(number)
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def holds(kind: int, piece) -> Column:
    """Whether a match of a base rule is a span."""
    n = F.length(digits(piece))
    if kind == IP:
        return piece.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == CARD:
        return F.when((n >= 16) & (n <= 19), luhn(digits(piece))).otherwise(False)
    return (n >= 8) & (n <= 15) if kind == PHONE else F.lit(True)


def located(pieces, gaps) -> Column:
    """start, end, piece, before and after of each match, from the matches and the text around them."""
    steps = F.zip_with(pieces, F.slice(gaps, F.lit(1), F.size(pieces)), lambda p, g: F.length(p) + F.length(g))
    at = F.arrays_zip(pieces.alias("piece"), F.slice(gaps, F.lit(1), F.size(pieces)).alias("gap"), F.slice(gaps, F.lit(2), F.size(pieces)).alias("next"), running(steps, lambda a, b: a + b, F.lit(0)).alias("sum"))

    def place(m):
        start = m["sum"] + F.length(m["gap"])
        return F.struct(start.alias("start"), (start + F.length(m["piece"])).alias("end"), m["piece"].alias("piece"), F.right(m["gap"], F.lit(BEFORE)).alias("before"), F.left(m["next"], F.lit(AFTER)).alias("after"))

    return F.transform(at, place)


def kind_of(piece) -> Column:
    """The kind of a looser span."""
    return F.when(piece.rlike("[g-zG-Z@]"), EMAIL).when(F.contains(piece, F.lit(":")), IP).when(piece.rlike(f"^(?:{_LONG})$"), CARD).otherwise(PHONE)


def _vote(for_it: Column, against: Column) -> Column:
    return F.when(for_it, 1).when(against, -1).otherwise(0)


def votes(kind, piece, before, after) -> Column:
    """1 (for), -1 (against) or 0 of each labeler; ``kind`` is a number or a column of numbers."""
    number = digits(piece)
    n = F.length(number)
    no, yes = F.lit(False), F.lit(True)
    groups = F.length(piece) - F.length(F.translate(piece, ":", "")) + 1
    short = F.contains(piece, F.lit("::"))
    tld = F.lower(F.regexp_extract(piece, r"([A-Za-z0-9-]+)$", 1))
    near = F.lower(F.concat(before, F.lit(" "), after))
    word = lambda text, words: text.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])").cast("int")
    by_kind = lambda *each: each[kind]() if isinstance(kind, int) else F.element_at(F.array(*[f() for f in each]), kind + 1)
    form = by_kind(
        lambda: _vote(piece.rlike(r"[(\[{]\x20?at|^[^\s@]+@[^\s@]+$"), piece.rlike(r"(?i)\x20at\x20[A-Za-z0-9.-]+$")),
        lambda: _vote(piece.rlike(r"^[0-9.]+$") | (groups == 8) | short, piece.rlike(r"^[0-9]{1,2}(?::[0-9]{2}){2}$")),
        lambda: _vote((n == 16) | (n == 15), (n == 17) | (n == 18)),
        lambda: _vote(piece.rlike(r"^(?:\+|00)|^\("), piece.rlike(r"^(?:(?:19|20)[0-9]{2}[ ./-][0-9]{2}[ ./-][0-9]{2}|[0-9]{2}[ ./-][0-9]{2}[ ./-](?:19|20)?[0-9]{2})$")),
    )
    checksum = by_kind(
        lambda: _vote(tld.rlike("^[a-z]{2,24}$"), yes),
        lambda: _vote(F.contains(piece, F.lit(".")) | (short & (groups < 9)) | (groups == 8), yes),
        lambda: _vote(F.when((n >= 13) & (n <= 19), luhn(number)).otherwise(False), yes),
        lambda: _vote((n >= 9) & (n <= 13), (n < 8) | (n > 15)),
    )
    known = by_kind(
        lambda: _vote(tld.isin(*DOMAINS.split()), no),
        lambda: _vote(piece.rlike("(?i)^(?:2[0-9a-f]{3}|fd[0-9a-f]{2}|fe80):"), piece.rlike(PRIVATE)),
        lambda: _vote(number.rlike(ISSUERS), yes),
        lambda: _vote((piece.rlike(r"^(?:\+|00)") & piece.rlike(CALLING)) | piece.rlike(r"^\(?[2-9][0-9]{2}\b"), piece.rlike(r"^(?:\+|00)")),
    )
    said = by_kind(*[(lambda words: lambda: word(near, words))(CUES[k]) for k in range(len(KINDS))])
    edges = _vote(~before.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"^[\p{L}\p{N}_]"), yes)
    return F.array(form, checksum, known, said, -word(F.lower(before), AGAINST), edges)


def shape(piece) -> Column:
    """A number from 0 to 15: how many digits, and whether with marks between them."""
    n = F.length(digits(piece))
    size = sum(((n >= least).cast("int") for least in (1, 7, 10, 13, 16, 17, 20)), F.lit(0))
    return size * 2 + piece.rlike(r"[0-9][^0-9A-Za-z]+[0-9]").cast("int")


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, spans: kind, start, end, base, votes and shape of all base spans and the looser ones that overlap none of these."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rules = {**{k: BASE[k] for k in range(len(KINDS))}, "loose": LOOSE}
    worth = {EMAIL: F.contains("text", F.lit("@")), PHONE: F.contains("text", F.lit("+")), "loose": F.col("text").rlike(_WORTH)}
    found = lambda k: F.when(worth.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(rules[k]), F.lit(0)))
    rows = rows.select("*", *[found(k).alias(f"pieces_{k}") for k in rules])
    rows = rows.select("*", *[F.when(F.size(f"pieces_{k}") > 0, F.split("text", rules[k], -1)).alias(f"gaps_{k}") for k in rules])
    rows = rows.select("id", *[F.when(F.col(f"gaps_{k}").isNotNull(), located(F.col(f"pieces_{k}"), F.col(f"gaps_{k}"))).alias(f"at_{k}") for k in rules])

    def told(m, kind: int | Column, base: bool):
        number = F.lit(kind) if isinstance(kind, int) else kind
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), number.alias("kind"), F.lit(base).alias("base"), votes(kind, m["piece"], m["before"], m["after"]).alias("votes"), shape(m["piece"]).alias("shape"))

    def by_base(k: int) -> Column:
        return F.transform(F.filter(f"at_{k}", lambda m: holds(k, m["piece"])), lambda m: told(m, k, True))

    parts = [by_base(k) for k in range(len(KINDS))]
    parts.append(F.transform("at_loose", lambda m: told(m, kind_of(m["piece"]), False)))
    kind = "array<struct<start:int,end:int,kind:int,base:boolean,votes:array<int>,shape:int>>"
    every = F.array_sort(F.flatten(F.array(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts])))
    rows = rows.select("id", F.when(F.greatest(*[F.size(f"at_{k}") for k in rules]) > 0, every).alias("every"))
    ends = running(F.transform("every", lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest, F.lit(0))
    far = (1 << 31) - 1
    starts = F.reverse(running(F.reverse(F.transform("every", lambda s: F.when(s["base"], s["start"]).otherwise(far))), F.least, F.lit(far)))
    free = F.filter(F.arrays_zip(F.col("every").alias("s"), ends.alias("ended"), starts.alias("starts")), lambda x: x["s"]["base"] | ((x["ended"] <= x["s"]["start"]) & (x["starts"] >= x["s"]["end"])))
    return rows.select("id", F.when(F.col("every").isNotNull(), F.transform(free, lambda x: x["s"])).alias("spans"))


def patterns(found: DataFrame) -> DataFrame:
    """kind, votes, shape, n: how many spans have them. Few rows, in one partition."""
    return cut(found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")).coalesce(1))


def reliabilities(seen: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over patterns: per kind the log odds of a true span, and per kind, labeler and vote (-1, 0, 1)
    the log of how much likelier the vote is on a true span than on a false one."""
    width = 3 * len(LABELERS)
    # the first round counts votes
    odds, ratio = [0.0] * len(KINDS), [float(v) for _ in KINDS for _ in LABELERS for v in (-1, 0, 1)]
    for _ in range(rounds):
        each = seen.select("kind", "n", likelihood(odds, ratio).alias("p"), F.posexplode("votes").alias("labeler", "vote"))
        sums = each.groupBy("kind", "labeler", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()  # a row for each vote a labeler can give
        counted = {(r["kind"], r["labeler"], r["vote"]): (r["yes"], r["no"]) for r in sums}
        before = ratio
        odds, ratio = [], []
        for k in range(len(KINDS)):
            of = [[[counted.get((k, j, v), (0.0, 0.0))[side] + PRIOR[side][v + 1] for v in (-1, 0, 1)] for side in (0, 1)] for j in range(len(LABELERS))]
            yes, no = (sum(counted.get((k, 0, v), (0.0, 0.0))[side] for v in (-1, 0, 1)) + 1 for side in (0, 1))
            odds.append(math.log(yes / no))
            for true, false in of:
                ratio += [math.log(a / sum(true)) - math.log(b / sum(false)) for a, b in zip(true, false, strict=True)]
        if max(abs(a - b) for a, b in zip(before, ratio, strict=True)) < 1e-4:
            break
    assert len(ratio) == width * len(KINDS)
    return odds, ratio


def likelihood(odds: list[float], ratio: list[float]) -> Column:
    """The probability that a span of these votes is true, of labelers that err independently of each other."""
    table = F.array(*map(F.lit, ratio))
    by_labeler = F.transform("votes", lambda v, j: F.element_at(table, F.col("kind") * (3 * len(LABELERS)) + j * 3 + v + 2))
    return 1 / (1 + F.exp(-(F.element_at(F.array(*map(F.lit, odds)), F.col("kind") + 1) + F.aggregate(by_labeler, F.lit(0.0), lambda s, x: s + x))))


def features(s) -> Column:
    """kind, votes for and votes against by kind, and shape, as zeros and ones."""
    one = lambda c: c.cast("double")
    out = [one(s["kind"] == k) for k in range(len(KINDS))]
    for j in range(len(LABELERS)):
        v = F.element_at(s["votes"], j + 1)
        out += [one((s["kind"] == k) & (v == sign)) for k in range(len(KINDS)) for sign in (1, -1)]
    return F.array(*out, *[one(s["shape"] == i) for i in range(16)])


def classifier(seen: DataFrame) -> Callable[[Column], Column]:
    """Log odds of a span (a struct of kind, votes, shape) as a logistic regression learns them from the probabilities of
    ``reliabilities``. Two rows of weight one for each kind, all votes for and all against, hold it where nothing is seen."""
    odds, ratio = reliabilities(seen)
    told = seen.select(F.struct("kind", "votes", "shape").alias("s"), "n", likelihood(odds, ratio).alias("p"))
    fixed = seen.sparkSession.range(2 * len(KINDS)).select(F.struct((F.col("id") % len(KINDS)).cast("int").alias("kind"), F.array_repeat(F.when(F.col("id") < len(KINDS), 1).otherwise(-1), len(LABELERS)).alias("votes"), F.lit(0).alias("shape")).alias("s"), F.lit(1).cast("long").alias("n"), F.when(F.col("id") < len(KINDS), 1.0).otherwise(0.0).alias("p"))
    both = told.unionByName(fixed).coalesce(1).select(array_to_vector(features(F.col("s"))).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("x"))
    train = both.select("features", "x.label", "x.weight").filter("weight > 0")
    model = LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-4, standardization=False).fit(train)
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    return lambda s: F.aggregate(F.zip_with(features(s), weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, b: a + b)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """id_col and spans (kind, start and end in code points, end exclusive, base: by a base rule), by kind and start."""
    found = cut(candidates(docs, id_col, text_col))
    odds = classifier(patterns(found))
    least = math.log(sure / (1 - sure))
    kept = F.filter("spans", lambda s: s["base"] | (odds(s) >= least))
    order = F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(order, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select(F.col("id").alias(id_col), F.coalesce(named, F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")).alias("spans"))


def written(spans) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
