"""Personal data by patterns and by weak supervision, in native column expressions.

Base kinds are found by pattern alone and always stay. Further spans come from candidates of the kinds
secret, ssn, iban and name, on which three labelers vote: a regex labeler on the value's own shape, a
gazetteer labeler with lists of given names, places, countries and harmless codes, and a context labeler
on the words and characters around it. Expectation-maximisation over the counts of all vote patterns of
a kind (a table bounded by the number of patterns, from the whole corpus) estimates how far each labeler
is to be trusted. Its posteriors train a logistic classifier of votes and shape, again on counts; the
classifier, as a column expression, decides each candidate.

Work on a text is linear in its length but for the running sums over its spans, which go by blocks of
BLOCK spans; a very long text is one row in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.shared import free_names, materialize, renamed

#: Kinds in the order that spans with one start take.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "ssn", "iban", "name")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
#: Spans that one running sum goes over at a time, and code points in a piece of a text that is cut.
BLOCK, CHUNK = 512, 4096

# The contract's patterns in a form that never backtracks over a run: possessive groups, which Java
# matches without recursion, and starts only at a run's first character or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Words that announce a secret: what follows one and = or : is a candidate, whatever it is made of.
_CUES = "password|passwd|pwd|passphrase|passwort|kennwort|contraseña|mot de passe|token|secret|api[_-]?key|access[_-]?key|credential"
#: Parts that the lower-cased text holds where a cue stands: plain searches, which cost far less than the pattern.
_CUE_PARTS = ("pass", "pwd", "kennwort", "contrase", "token", "secret", "key", "credential")
CUED = rf"(?<=(?i:{_CUES})[\"']? ?[=:] ?[\"']?)[^\s\"'<>,;=:]{{4,}}+"
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
NAME = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}{1,14}+ \p{Lu}\p{Ll}{1,19}+(?![\p{L}\p{N}_])"

# Shapes of keys that public services issue (cloud access key, code host token, model service key), runs
# of hex digits too long for words, words that announce a kind, given names, places, and country codes of bank accounts.
KEY_SHAPES = "^(AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{16,}|[0-9a-f]{16,})$"
PLAIN_SHAPES = "^([A-Za-z]+[-_/]?[0-9]{1,4}|[0-9]{1,4}[-_/]?[A-Za-z]+|[A-Za-z0-9]+(-[a-z]+){2,}|[A-Za-zÀ-ÿ]+|[0-9]{1,4})$"
SECRET_WORDS = rf"(?i)({_CUES}|auth|ssn|social security)"
HARMLESS_WORDS = "(?i)(isbn|issn|doi|figure|table|version|http|www|sku|model|part)"
NAME_WORDS = r"(?i)(?<![a-z])(mr|mrs|ms|miss|dr|prof|sir|madam|herr|frau|monsieur|madame|señora?|name|named|contact|author|dear|regards|signed|by) ?[.:,]? ?$"
ACCOUNT_WORDS = "(?i)(iban|account|konto|compte|cuenta|bank)"
GIVEN_NAMES = (
    "Adam Alan Albert Alice Amanda Amy Ana Andrea Andreas Andrew Angela Ann Anna Anne Anthony Antonio Barbara Benjamin Bernd Brian Camille Carlos Carmen"
    " Carol Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Deborah Dennis Diana Diego Dieter Donald Dorothy Edward Elena"
    " Elizabeth Emily Emma Eric Erika Eva Felix Fernando Francisco Frank Franz George Gerhard Hannah Hans Heinrich Heinz Helen Helga Henry Isabel Jacques"
    " James Jane Janet Jason Javier Jean Jeffrey Jennifer Jessica Joan Johann John Jonathan Jorge Jose José Joseph Joshua Juan Judith Julia Julie Karen Karl"
    " Katherine Kathleen Kenneth Kevin Klaus Laura Lauren Linda Lisa Louis Louise Lucia Luis Manuel Margaret Maria Marie Mark Martha Martin Mary Matthew"
    " Megan Melissa Michael Michel Miguel Monika Nancy Nathalie Nicholas Nicolas Nicole Olivia Pablo Pamela Patricia Patrick Paul Pedro Peter Philip Philippe"
    " Pierre Rachel Raymond Rebecca Richard Robert Rosa Rosemary Ryan Samantha Samuel Sandra Sara Sarah Scott Sergio Sharon Sofia Sophie Stefan Stephanie"
    " Stephen Steven Susan Susanne Teresa Thomas Timothy Ursula Victoria Virginia Walter Werner William Wolfgang"
).split()
PLACES = (
    "Africa America Asia Athens Australia Austria Bavaria Berlin Boston Brazil Britain California Canada Chicago China Cologne England Europe Florida France"
    " Geneva Germany Greece Hamburg India Ireland Italy Japan London Madrid Mexico Milan Moscow Munich Norway Oxford Paris Poland Portugal Prague Rome"
    " Russia Scotland Seville Spain Sweden Switzerland Texas Tokyo Turkey Vienna Wales Washington York Zurich"
    " University Street Road Avenue River Mountain Church House North South East West New Saint United Kingdom States"
).split()
IBAN_COUNTRIES = "AD AE AL AT BA BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR".split()
CONTEXT_CHARS = 24

_SPAN = "struct<start:bigint,end:bigint,value:string>"
_WIDE = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array in arrays of at most BLOCK items each, at least one."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _before(values: Column, add) -> Column:
    """What add() makes of all values before each; values: an array of bigint, one a block."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(values, first, step, lambda acc: acc["out"])


def matches(text: Column, pattern: str, guard: str | Column, context: bool = False) -> Column:
    """The leftmost non-overlapping matches as (start, end, value), in code points; texts without `guard` cost one look.

    context: also `before`, the last CONTEXT_CHARS characters from the previous match on, and `after`, one character.
    """
    kind = _WIDE if context else _SPAN

    def steps(m: Column, gaps: Column) -> Column:
        def step(found: Column, i: Column) -> Column:
            fields = [F.get(gaps, i).alias("gap"), found.alias("found")]
            if context:
                before = F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(gaps, i))
                after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(m, i + 1), F.lit("")))
                fields += [F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), F.left(after, F.lit(1)).alias("after")]
            return F.struct(*fields)

        return F.transform(m, step)

    def put(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        more = [x["before"].alias("before"), x["after"].alias("after")] if context else []
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("value"), *more)
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def place(blocks: Column) -> Column:
        size = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["gap"]) + F.length(x["found"]))
        none = F.array().cast(f"array<{kind}>")

        def of(starts: Column) -> Column:
            spans = lambda b, i: F.aggregate(b, F.struct(F.get(starts, i).alias("at"), none.alias("out")), put, lambda acc: acc["out"])
            return F.flatten(F.transform(blocks, spans))

        return _let(_before(F.transform(blocks, size), lambda a, x: a + x), of)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = _let(found, lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda gaps: _let(_let(steps(m, gaps), _blocks), place))))
    looked = F.rlike(text, F.lit(guard)) if isinstance(guard, str) else guard
    return F.coalesce(F.when(looked, both), F.array().cast(f"array<{kind}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn check."""

    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:
            x = F.ascii(F.substring(d, F.length(d) - i, F.lit(1))) - 48
            twice = x * 2
            return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + digit(i))

    return _let(_digits(value), total) % 10 == 0


def _octet(part: Column) -> Column:
    x = F.ltrim(part, F.lit("0"))
    return (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))


def base_spans(text: Column) -> Column:
    """A struct with an array of (start, end, value) for each base kind."""
    phone_digits = lambda s: F.length(_digits(s["value"])).between(9, 15)
    return F.struct(
        matches(text, EMAIL, "@").alias("email"),
        F.filter(matches(text, IP, r"[0-9]\.[0-9]"), lambda s: F.forall(F.split(s["value"], r"\."), _octet)).alias("ip"),
        F.filter(matches(text, CARD, "[0-9](?:[ -]?[0-9]){11}"), lambda s: luhn(s["value"])).alias("card"),
        F.filter(matches(text, PHONE, r"\+[0-9]"), phone_digits).alias("phone"),
    )


def iban_valid(value: Column) -> Column:
    """Whether the country, check digits and rest leave 1 modulo 97, letters counting from A = 10."""

    def remainder(x: Column) -> Column:
        turned = F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4))
        step = lambda acc, c: F.when(c <= "9", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))

    return _let(F.replace(value, F.lit(" "), F.lit("")), remainder) == 1


def _listed(value: Column, words: list[str]) -> Column:
    return value.isin(words)


def _votes(kind: str, s: Column) -> tuple[Column, Column, Column]:
    """The regex, gazetteer and context labelers' votes on a candidate of the kind: 1 for, -1 against, 0 none."""
    value, before, after = s["value"], s["before"], s["after"]
    vote = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)
    if kind == "iban":  # the check digits of all candidates are right
        listed = _listed(F.left(value, F.lit(2)), IBAN_COUNTRIES)
        return vote(F.length(F.replace(value, F.lit(" "), F.lit(""))) >= 15, F.lit(False)), vote(listed, ~listed), vote(F.rlike(before, F.lit(ACCOUNT_WORDS)), F.lit(False))
    if kind == "name":
        first, last = F.substring_index(value, " ", 1), F.substring_index(value, " ", -1)
        place = _listed(first, PLACES) | _listed(last, PLACES)
        opens = F.rlike(before, F.lit("(^|[.!?:\\n] ?)$"))  # a sentence's first word is capitalised anyway
        return vote(F.lit(False), opens), vote(_listed(first, GIVEN_NAMES) & ~place, place), vote(F.rlike(before, F.lit(NAME_WORDS)), F.lit(False))
    regex = vote(F.lit(True) if kind == "ssn" else F.rlike(value, F.lit(KEY_SHAPES)), F.rlike(value, F.lit(PLAIN_SHAPES)))
    gazetteer = vote(F.rlike(before, F.lit(SECRET_WORDS)), F.rlike(before, F.lit(HARMLESS_WORDS)))
    context = vote(F.rlike(before, F.lit("[=:] ?[\"']?$")), F.rlike(before, F.lit("[./@&#]$")) | F.rlike(after, F.lit("[/@=&]")))
    return regex, gazetteer, context


def _cued(text: Column) -> Column:
    return _let(F.lower(text), lambda low: _any(*[F.contains(low, F.lit(part)) for part in _CUE_PARTS])) & F.rlike(text, F.lit("[=:]"))


def candidates(text: Column) -> Column:
    """An array of candidate spans with votes (-1, 0, 1) and shape features."""

    def rated(kind: str):
        def rate(s: Column) -> Column:
            value = s["value"]
            digits = F.length(_digits(value))
            shape = F.struct(
                (F.length(value) >= 18).cast("int").alias("long"),
                F.rlike(value, F.lit("^([0-9a-f]+|[0-9A-Z]+)$")).cast("int").alias("one_case"),
                (4 * digits >= F.length(value)).cast("int").alias("many_digits"),
                F.rlike(value, F.lit("[0-9][A-Za-z]+[0-9]")).cast("int").alias("mixed"),
            )
            votes = F.struct(*[v.alias(n) for n, v in zip(VOTERS, _votes(kind, s), strict=True)])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), votes.alias("votes"), shape.alias("shape"))

        return rate

    return F.concat(
        _let(matches(text, CUED, _cued(text), True), lambda cued: F.transform(F.concat(cued, _apart(matches(text, SECRET, "[0-9]", True), cued)), rated("secret"))),
        F.transform(matches(text, SSN, "[0-9]-[0-9]{2}-[0-9]", True), rated("ssn")),
        F.transform(F.filter(matches(text, IBAN, "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", True), lambda s: iban_valid(s["value"])), rated("iban")),
        F.transform(matches(text, NAME, r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}", True), rated("name")),
    )


VOTERS = ("regex", "gazetteer", "context")
SHAPES = ("long", "one_case", "many_digits", "mixed")


@dataclass(frozen=True)
class Model:
    """What the corpus taught: the labelers' accuracies and the classifier's weights."""

    prior: float
    #: By voter: how often a vote that isn't 0 is right.
    accuracy: dict[str, float]
    intercept: float
    weights: dict[str, float]

    def accepts(self, c: Column) -> Column:
        """Whether the classifier takes candidate c for personal data."""
        score = F.lit(self.intercept)
        for name in VOTERS:
            for vote in (-1, 1):
                score = score + F.when(c["votes"][name] == vote, self.weights[f"{name}{vote:+d}"]).otherwise(0.0)
        for name in SHAPES:
            score = score + c["shape"][name] * F.lit(self.weights[name])
        return score > 0


def learn(patterns: list[tuple[tuple[int, ...], tuple[int, ...], float]], rounds: int = 50) -> Model:
    """EM and classifier from (votes, shape, count) of all candidates; there are few such patterns in any corpus.

    A labeler has one accuracy for the votes that it casts; that it casts none says nothing. Accuracies
    start at 0.8 with ten pseudo-votes and stay from 0.6 to 0.99: a labeler is never worse than chance,
    which keeps the two classes from changing places, also without any candidate. The prior stays under
    one half, so that a candidate that no labeler speaks for isn't taken. The classifier weighs a pattern by the
    logarithm of its count: frequent patterns must not drown the rest.
    """
    plain = [((v,) * len(VOTERS), (shape,) * len(SHAPES), 1.0) for v in (-1, 0, 1) for shape in (0, 1)]
    rows = sorted(patterns) + plain
    votes, shapes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    count = np.array([r[2] for r in rows], dtype=float)
    accuracy, prior = np.full(len(VOTERS), 0.8), 0.5
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-logit))
        right = np.where(votes > 0, posterior[:, None], 1 - posterior[:, None])
        cast = (votes != 0) * count[:, None]
        accuracy = np.clip(((right * cast).sum(axis=0) + 8) / (cast.sum(axis=0) + 10), 0.6, 0.99)
        prior = float(np.clip((posterior @ count + 1) / (count.sum() + 2), 0.05, 0.3))
    x = np.column_stack([np.ones(len(rows)), *[votes[:, k] == v for k in range(len(VOTERS)) for v in (-1, 1)], shapes]).astype(float)
    weight, w = np.log1p(count) / np.log1p(count).sum(), np.zeros(x.shape[1])
    penalty = 1e-3 * np.eye(len(w))
    for _ in range(40):  # Newton's method on the penalised log-likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - posterior)) + penalty @ w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        w -= np.linalg.solve(hessian, gradient)
    names = [f"{name}{vote:+d}" for name in VOTERS for vote in (-1, 1)] + list(SHAPES)
    rounded = [round(float(v), 6) for v in w]
    return Model(round(prior, 6), dict(zip(VOTERS, accuracy.round(6).tolist(), strict=True)), rounded[0], dict(zip(names, rounded[1:], strict=True)))


def train(found: DataFrame) -> dict[str, Model]:
    """learn() by kind on the candidates of all rows: found has them in array column `more`."""
    fields = ["c.kind"] + [f"c.votes.{v}" for v in VOTERS] + [f"c.shape.{s}" for s in SHAPES]
    keys = [F.col(f).alias(f"k{i}") for i, f in enumerate(fields)]
    counted = found.select(F.explode("more").alias("c")).groupBy(*keys).count()
    patterns: dict[str, list] = {kind: [] for kind in ADDED_KINDS}
    for r in counted.collect():  # at most 4 * 3**3 * 2**4 rows
        patterns[r[0]].append((tuple(r[1 : 1 + len(VOTERS)]), tuple(r[1 + len(VOTERS) : -1]), float(r[-1])))
    return {kind: learn(rows) for kind, rows in patterns.items()}


def _kind_spans(base: Column) -> Column:
    """All base spans as (start, rank, end, kind), sorted."""
    def ranked(kind: str, rank: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    each = [F.transform(base[kind], ranked(kind, i)) for i, kind in enumerate(BASE_KINDS)]
    return F.sort_array(F.concat(*each))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the base, which is sorted; base: a column or variable."""
    over = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])

    def bounds(b: Column) -> Column:
        end = F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: F.greatest(acc, x["end"]))
        return F.struct(F.get(b, F.lit(0))["start"].alias("start"), end.alias("end"), b.alias("items"))

    def free(blocks: Column) -> Column:
        return F.filter(spans, lambda c: ~F.exists(blocks, lambda b: over(b, c) & F.exists(b["items"], lambda x: over(x, c))))

    return F.when(F.size(base) == 0, spans).otherwise(_let(F.transform(_blocks(base), bounds), free))


def added_spans(base: Column, more: Column, models: dict[str, Model]) -> Column:
    """Candidates that their kind's model accepts and that overlap no base span, in the shape of _kind_spans()."""
    accepted = F.filter(more, lambda c: _any(*[(c["kind"] == kind) & m.accepts(c) for kind, m in models.items()]))

    def shaped(c: Column) -> Column:
        rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).cast("int") - 1
        return F.struct(c["start"].alias("start"), rank.alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"))

    return F.transform(_apart(accepted, base), shaped)


def _any(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _found(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {"base": _kind_spans(base_spans(t)), "more": candidates(t)}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row: arrays of (start, rank, end, kind), sorted by start, then kind.

    Positions are code points, ends exclusive. A null text counts as empty and has no spans. Added spans
    overlap no base span; of one start the kinds go in the order of KINDS. Texts are searched whole, at any
    length. Repeated rows and null ids each come back; an empty table gives an empty result, by models
    that know of no candidate; other columns are not read.
    """
    rows = renamed(docs, id=id_col, text=text_col)
    # one scan of the texts: spans are few and narrow beside them
    found = materialize(rows.select(F.col("id").cast("long").alias("id"), *[c.alias(n) for n, c in _found(F.col("text")).items()]), "pii")
    added = added_spans(F.col("base"), F.col("more"), train(found))
    return found.select("id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


_CUT = "struct<from:bigint,to:bigint,kind:string>"


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first names the cut."""
    none = F.array().cast(f"array<{_CUT}>")

    def put(acc: Column, s: Column) -> Column:
        new = F.struct(acc["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.array_append(acc["out"], new).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        )

    end = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: F.greatest(acc, x["end"]))

    def cuts(blocks: Column) -> Column:
        def of(at: Column) -> Column:
            own = lambda b, i: F.aggregate(b, F.struct(F.get(at, i).alias("at"), none.alias("out")), put, lambda acc: acc["out"])
            return F.flatten(F.transform(blocks, own))

        return _let(_before(F.transform(blocks, end), F.greatest), of)

    def written_out(chunks: Column) -> Column:
        """The parts between the cuts, from the chunks that they lie in: no part is counted from the text's start."""

        def part(a: Column, b: Column) -> Column:
            first, last = F.shiftright(a, 12).cast("int"), F.shiftright(b - 1, 12).cast("int")
            place = (a % CHUNK).cast("int") + 1
            across = F.concat(
                F.substring(F.get(chunks, first), place, F.lit(CHUNK)),
                F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                F.substring(F.get(chunks, last), F.lit(1), ((b - 1) % CHUNK).cast("int") + 1),
            )
            return F.when(b <= a, "").when(first == last, F.substring(F.get(chunks, first), place, (b - a).cast("int"))).otherwise(across)

        pieces = F.transform(_let(_blocks(spans), cuts), lambda c: F.concat(part(c["from"], c["to"]), F.lit("<"), F.upper(c["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), part(end(spans), F.length(text).cast("bigint")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(chunks, written_out)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by its kind; all columns and rows stay, a null text stays null.

    One pass finds the base spans and the candidates, and writes them beside the rows; the models are
    trained on the candidates of all rows, and a second pass cuts. Repeated rows each come back, cut alike;
    an empty table stays empty.
    """
    base, more = free_names(docs, "base_spans", "candidates")
    text = F.col(f"`{text_col}`")
    found = materialize(docs.withColumns({n: c for n, c in zip((base, more), _found(text).values(), strict=True)}), "pii-rows")
    models = train(found.select(F.col(more).alias("more")))
    spans = F.sort_array(F.concat(F.col(base), added_spans(F.col(base), F.col(more), models)))
    cut = F.when(text.isNotNull(), F.when(F.size(base) + F.size(more) > 0, _let(spans, lambda s: redacted(text, s))).otherwise(text))
    return found.withColumn(text_col, cut).drop(base, more)
