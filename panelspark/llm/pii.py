"""Personal data: weak labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates of each kind come from one expression. The four base kinds (e-mail address, IP address,
payment card, phone number) have an exact check, and what passes it is always reported; nothing is
estimated for them. Candidates of the other kinds (secret, local phone number, social security number,
bank account, person with a title) that no base span overlaps are judged.

Five labelers look at each of these: its form (expressions, check digits), what is known (issuers' prefixes,
lengths by country, names; published examples), the words before it, the words after it, and the variety
of its characters. Each votes yes or no, or abstains. How often each combination of votes occurs in the
whole corpus is counted; this table has no more rows than there are combinations. On it, and for each
kind apart, expectation-maximisation estimates the share of true spans and how often each labeler that votes
says yes on true and on false ones. Whether it votes says nothing, yes never speaks against a span and no never for one: a
corpus that shows one combination only can't turn votes round. A prior worth some spans holds what the counts leave open.
A logistic classifier over kind, votes and length is then trained on the estimated probabilities, of all
combinations: those that don't occur have a little weight, so no vote is ever met unprepared. A span on which nobody votes isn't reported.

DataFrame functions only; candidates are found and placed within each row, and nothing but the
counts is shuffled.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "local_phone", "ssn", "iban", "person")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Expressions of the candidates. An e-mail address can only begin where a run of its characters does, or
#: where the last one ended; this and possessive repeats keep the search linear without changing a match.
FIND = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,80}|sk_live_[0-9A-Za-z]{16,64}|[0-9a-f]{32,128})(?![0-9A-Za-z_])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof)\. \p{Lu}\p{L}{1,40}(?: \p{Lu}\p{L}{1,40})?",
}
#: A text without any of these has no candidate.
PREFILTER = r"[0-9@]|(?:Mr|Mrs|Ms|Dr|Prof)\. |AKIA|gh[pousr]_|xox[abp]-|sk_live_|[a-f]{32}"
#: Labelers. ``form``: expressions for and against; plain hexadecimal digits may be a digest, so their form says nothing. A bank account has check digits instead.
FORM = {
    "secret": (r"^(?![0-9a-f]+$)(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])", r"^(?:[0-9]+|[a-f]+)$"),
    "local_phone": (r"^(?:\([2-9][0-8][0-9]\)|[2-9][0-8][0-9])[ .-][2-9](?!11)[0-9]{2}[ .-][0-9]{4}$", r"^\(?[01]|^\(?[0-9]{3}\)?[ .-](?:[01]|.11)|^\([0-9]{3}[ .-]|^[0-9]{3}\)"),
    "ssn": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9)|-00-|-0000$"),
    "person": (r"^\p{L}+\. \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$", r"\. (?:.* )?\p{Lu}{2,}"),
}
#: ``known``: expressions for and against; lengths of bank accounts by country, and names and other words, are below.
KNOWN = {
    "secret": (r"^(?:AKIA|gh[pousr]_|xox[abp]-|sk_live_)", r"EXAMPLE|^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$"),
    "local_phone": (r"^\(?8(?:00|33|44|55|66|77|88)\)?[ .-]", r"555[ .-]01[0-9]{2}$"),
    "ssn": (r"^$", r"^(?:078-05-1120|219-09-9999|123-45-6789|987-65-432[0-9])$"),
}
#: Characters of a bank account number, by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23,
    GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15,
    PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VG=24, XK=20,
)
NAMES = (
    "Adam Alan Albert Alex Alexander Ali Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Ben Benjamin Brian Camille Carl Carlos Carmen Carol Catherine Charles Charlotte "
    "Chris Christian Christine Claire Clara Claudia Daniel David Diana Diego Dieter Dominique Edward Elena Elizabeth Emily Emma Eric Erika Eva Fatima Felix Fernando Francesca Francisco Frank George Giulia "
    "Hannah Hans Heike Helen Henri Henry Hugo Ian Ines Isabel Ivan Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johann John Jonas Jose Joseph Juan Julia Julien Karen Karl Kevin Klaus "
    "Laura Lea Leo Linda Lisa Louis Lucas Lucia Luis Luke Marco Margaret Maria Marie Mark Martin Mary Matthew Max Michael Michelle Miguel Mohamed Monika Nancy Natalie Nicolas Nina Olga Oliver Pablo Patricia "
    "Patrick Paul Pedro Peter Philip Pierre Rachel Robert Rosa Ruth Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Susan Thomas Ursula Victor Walter William Yusuf"
).split()
SURNAMES = (
    "Anderson Bauer Becker Bernard Brown Chen Clark Cohen Davis Diaz Dubois Durand Fernandez Fischer Garcia Gomez Gonzalez Hall Harris Hernandez Hill Hoffmann Hughes Jackson Johnson Jones Khan Kim King "
    "Klein Koch Kumar Laurent Lee Lefebvre Lewis Lopez Martinez Meyer Miller Moore Moreau Morris Muller Murphy Nguyen Novak Patel Perez Petit Ramirez Richter Rivera Robinson Rodriguez Romero Rossi Sanchez "
    "Schmidt Schneider Schulz Schwarz Scott Singh Smith Taylor Thompson Torres Turner Wagner Walker Wang Weber White Williams Wilson Wolf Wood Wright Young Zimmermann"
).split()
NO_NAMES = "The This That These And But For From With When Where Who Inc Ltd Llc Corp Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December Street Avenue Road Chapter Section Figure Table".split()
#: ``before``: words before a span that speak for it; those that speak against any.
BEFORE = {
    "secret": r"(?i)(?:token|secret|password|passwd|\bkey|api_?key|access_?key|private_?key|credentials?|auth\w*)\W{0,6}$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|number is|reach me at|ring)\W{0,12}$",
    "ssn": r"(?i)(?:ssn|social security)\W{0,12}(?:no|number)?\W{0,4}$",
    "iban": r"(?i)(?:iban|account|bank|transfer to)\W{0,12}$",
    "person": r"(?i)(?:patient|dear|signed|name|by|with|met|for|to|from)\W{0,6}$",
}
NOT_BEFORE = r"(?i)(?:version|release|isbn|issn|sha|sha1|sha256|md5|digest|checksum|hash|commit|revision|build|order|invoice|ticket|part|serial|example|sample|page|fig)\W{0,6}(?:no|number|id)?\W{0,4}$"
#: ``after``: the same for what follows.
AFTER = {
    "secret": r"^[\"']",
    "local_phone": r"(?i)^\W{0,3}(?:ext|extension|x[0-9]|mobile|home|office|cell|fax)",
    "ssn": r"(?i)^\W{0,3}(?:dob|born|expires)",
    "iban": r"(?i)^\W{0,4}(?:bic|swift)",
    "person": r"(?i)^,? (?:m\.?d|ph\.?d|esq|said|says|wrote|lives|was|is|has|will)\b",
}
NOT_AFTER = r"(?i)^\W{0,3}(?:checksum|digest|sha|md5|bytes|pages?|edition|version|isbn|commit|pcs|units|usd|eur)\b"
#: ``variety``: letters and digits that occur (no at most, yes at least), and runs that aren't by chance.
VARIETY = {"secret": (5, 10), "local_phone": (2, 5), "ssn": (2, 5), "iban": (2, 5)}
RUNS = r"0123456|1234567|2345678|3456789|9876543|8765432"
VOTES = ("form", "known", "before", "after", "variety")
NO, YES, ABSTAIN = 0, 1, 2
#: Votes (no, yes) that each labeler is taken to have cast on true and on false spans before the first is counted, and true
#: and false spans of a kind. A no of ``known`` (published examples, impossible lengths) is hardly ever cast on a true one.
PRIOR = {True: (0.5, 3.0), False: (3.0, 0.5)}
PRIOR_KNOWN = {True: (0.005, 3.0), False: (3.0, 0.5)}
SHARE_PRIOR = (1.0, 2.0)
#: So much of a kind's spans the prior of votes is worth besides, and the largest share that counts when spans are judged: votes must speak for them.
PRIOR_SHARE, SHARE_MOST = 0.03, 0.4
#: Weight in training that all combinations of votes share, whether they occur or not, besides that of a kind's spans.
UNSEEN = 0.06
#: Lengths are told apart in so many steps of so many characters.
SIZES, SIZE_STEP = 4, 12
SPAN = "struct<start: int, kind: int, end: int, form: int, known: int, before: int, after: int, variety: int, size: int>"
SHORT = "struct<start: int, kind: int, end: int>"
#: Items of a scan that are taken together, and code points of the blocks that a text is cut into for redaction.
RUN, BLOCK = 256, 4096
NOWHERE = (1 << 31) - 1


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, start: Column, kind: str, step) -> Column:
    """What ``step(state, item)`` gives for each item from left to right: the next state, and an array of ``kind`` to append.

    Results are appended to runs of RUN items, so a long array isn't copied once for each item.
    """
    none = F.array().cast(f"array<{kind}>")

    def over(whole: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            state, out = step(acc["state"], x)
            return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

        def run(acc: Column, at: Column) -> Column:
            fresh = F.struct(acc["state"].alias("state"), none.alias("out"))
            return F.aggregate(F.slice(whole, at, RUN), fresh, one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["runs"], F.array(a["out"])).alias("runs")))

        begins = F.sequence(F.lit(1), F.size(whole), F.lit(RUN))
        first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("runs"))
        return F.when(F.size(whole) > 0, F.aggregate(begins, first, run, lambda a: F.flatten(a["runs"]))).otherwise(none)

    return _let(items, over)


def _two_sided(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAIN)


def _check_digits(account: Column) -> Column:
    """Whether a bank account's remainder by 97 is 1: letters count from 10, the first four characters go last."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), "")

    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (total * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), add) == 1


def votes(kind: str, span: Column, left: Column, right: Column) -> list[Column]:
    """What each labeler says of a candidate of a kind that isn't a base kind: in the order of VOTES."""
    if kind == "iban":
        form = _two_sided(_check_digits(span), F.lit(True))
        lengths = F.create_map(*(F.lit(x) for kv in IBAN_LENGTH.items() for x in kv))
        right_length = F.coalesce(F.length(F.replace(span, F.lit(" "), F.lit(""))) == lengths[F.substring(span, 1, 2)], F.lit(False))
        known = _two_sided(right_length, F.lit(True))
    else:
        form = _two_sided(*(span.rlike(e) for e in FORM[kind]))
        words = F.split(span, " ")
        any_of = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
        if kind == "person":
            known = _two_sided(any_of(NAMES + SURNAMES), any_of(NO_NAMES))
        else:  # a published example says no, whatever it begins with
            known = F.when(span.rlike(KNOWN[kind][1]), NO).otherwise(_two_sided(span.rlike(KNOWN[kind][0]), F.lit(False)))
    before = _two_sided(left.rlike(BEFORE[kind]), left.rlike(NOT_BEFORE))
    after = _two_sided(right.rlike(AFTER[kind]), right.rlike(NOT_AFTER))
    if kind == "person":
        return [form, known, before, after, F.lit(ABSTAIN)]
    few, many = VARIETY[kind]
    n = F.size(F.array_remove(F.array_distinct(F.split(F.regexp_replace(span, "[^0-9A-Za-z]", ""), "")), ""))
    enough = (n >= many) & ~span.rlike("^[0-9a-f]+$") if kind == "secret" else n >= many
    poor = (n <= few) | span.rlike(RUNS)
    return [form, known, before, after, _two_sided(enough & ~poor, poor)]


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        back = F.reverse(F.split(digits, ""))  # Luhn: from the right, every second digit doubled

        def add(total: Column, d: Column) -> Column:
            n, double = d["d"].cast("int"), d["i"] % 2 == 1
            return total + F.when(double & (n > 4), 2 * n - 9).when(double, 2 * n).otherwise(n)

        placed = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
        return F.when(F.length(digits).between(14, 19), F.aggregate(placed, F.lit(0), add) % 10 == 0).otherwise(False)
    return F.lit(True)


def _placer(number: int, kind: str):
    """Places one match; the state is where the last one ended."""

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["m"])
        said = [F.lit(ABSTAIN)] * len(VOTES) if kind in BASE else votes(kind, x["m"], F.right(x["gap"], F.lit(40)), F.substring(x["next"], 1, 24))
        size = F.lit(0) if kind in BASE else F.least(F.lit(SIZES - 1), F.floor(F.length(x["m"]) / SIZE_STEP).cast("int"))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), *(v.alias(n) for n, v in zip(VOTES, said, strict=True)), size.alias("size"))
        return end, F.when(_valid(kind, x["m"]), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return place


def _is_base(s: Column) -> Column:
    return s["kind"] < len(BASE)


def _clear(spans: Column) -> Column:
    """The base spans, and those that none of them overlaps; sorted."""
    kept_if = lambda test, s: F.when(test, F.array(s)).otherwise(F.array().cast(f"array<{SPAN}>"))

    def from_left(reach: Column, s: Column) -> tuple[Column, Column]:
        """Drops what begins before a base span ends."""
        return F.when(_is_base(s), F.greatest(reach, s["end"])).otherwise(reach), kept_if(_is_base(s) | (s["start"] >= reach), s)

    def from_right(next_base: Column, s: Column) -> tuple[Column, Column]:
        """Drops what ends behind the beginning of the next base span."""
        return F.when(_is_base(s), s["start"]).otherwise(next_base), kept_if(_is_base(s) | (s["end"] <= next_base), s)

    left = _scan(F.sort_array(spans), F.lit(0), SPAN, from_left)
    return F.sort_array(_scan(F.reverse(left), F.lit(NOWHERE), SPAN, from_right))


def _placed(found: Column, number: int, kind: str):
    def placed(gaps: Column) -> Column:
        after = F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0)))
        zipped = F.arrays_zip(found.alias("m"), gaps.alias("gap"), after.alias("next"))
        return _scan(F.filter(zipped, lambda x: x["m"].isNotNull()), F.lit(0), SPAN, _placer(number, kind))

    return placed


def candidates(text: Column) -> Column:
    """Array of the candidate spans of a whole text (code points, end exclusive): checked base spans, and others beside them."""
    none = F.array().cast(f"array<{SPAN}>")
    of_kinds = []
    for number, kind in enumerate(KINDS):
        found, between = F.regexp_extract_all(text, F.lit(FIND[kind]), F.lit(0)), F.split(text, FIND[kind], -1)
        of_kinds.append(F.when(text.rlike(FIND[kind]), _let(between, _placed(found, number, kind))).otherwise(none))
    return F.when(text.rlike(PREFILTER), _clear(F.concat(*of_kinds))).otherwise(none)


JUDGED = range(len(BASE), len(KINDS))


def estimate(counts: list[tuple], rounds: int = 100) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """EM over rows (kind, votes..., size, n), for each kind alone: share of true spans, and rates of the labelers' votes.

    Rates are an array [true or false, labeler, vote]. Labelers are taken as independent given the truth, and abstain as often on
    true spans as on false ones. If yes would be rarer on true spans than on false ones, the labeler counts as saying
    nothing: both get the common rate. Kinds without any span keep the priors.
    """
    table = np.array(counts, "f8").reshape(-1, len(VOTES) + 3)
    shares, rates = {}, {}
    prior = np.array([[(PRIOR_KNOWN if v == "known" else PRIOR)[c] for v in VOTES] for c in (False, True)])
    for kind in JUDGED:
        rows = table[table[:, 0] == kind]
        said, n = rows[:, 1:-2].astype(int), rows[:, -1]
        before = prior * (1 + PRIOR_SHARE * n.sum() / prior.sum(2, keepdims=True))
        voting = np.array([(n * (said[:, j] != ABSTAIN)).sum() + 1 for j in range(len(VOTES))]) / (n.sum() + 2)
        share, rate = SHARE_PRIOR[0] / sum(SHARE_PRIOR), _rates(before, voting)
        for _ in range(rounds if len(rows) else 0):
            p = posterior(said, share, rate)
            seen = np.array([[[(n * q * (said[:, j] == v)).sum() for v in (NO, YES)] for j in range(len(VOTES))] for q in (1 - p, p)])
            rate = _rates(seen + before, voting)
            share = float((n @ p + SHARE_PRIOR[0]) / (n.sum() + sum(SHARE_PRIOR)))
        shares[kind], rates[kind] = share, rate
    return shares, rates


def _rates(votes: np.ndarray, voting: np.ndarray) -> np.ndarray:
    """Rates [true or false, labeler, vote] from votes [true or false, labeler, no or yes] and how often each labeler votes."""
    both = votes.sum(0)
    given = votes / votes.sum(2, keepdims=True)
    turned = given[1, :, YES] < given[0, :, YES]
    given = np.where(turned[None, :, None], (both / both.sum(1, keepdims=True))[None], given)
    return np.concatenate([given * voting[None, :, None], np.broadcast_to(1 - voting[None, :, None], (2, len(voting), 1))], 2)


def posterior(said: np.ndarray, share: float, rate: np.ndarray) -> np.ndarray:
    """The probability that spans with these votes are true."""
    logit = np.full(len(said), np.log(share / (1 - share)))
    for j in range(len(VOTES)):
        logit += np.log(rate[1, j, said[:, j]] / rate[0, j, said[:, j]])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


#: Weights of a kind: its own, three for each labeler (that of abstaining stays 0), one for each length.
WEIGHTS = 1 + 3 * len(VOTES) + SIZES


def _features(said: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = np.zeros((len(said), WEIGHTS))
    x[:, 0] = 1
    for j in range(len(VOTES)):
        for v in (NO, YES):
            x[:, 1 + 3 * j + v] = said[:, j] == v
    x[np.arange(len(said)), 1 + 3 * len(VOTES) + size] = 1
    return x


def train(counts: list[tuple]) -> np.ndarray:
    """Weights of the span classifier, kinds by features: logistic regression (ridge, Newton steps) on the probabilities of ``estimate``."""
    shares, rates = estimate(counts)
    seen = {tuple(map(int, r[:-1])): float(r[-1]) for r in counts}
    every = np.array(list(product((NO, YES, ABSTAIN), repeat=len(VOTES))))
    said, size = np.repeat(every, SIZES, 0), np.tile(np.arange(SIZES), len(every))
    x, out = _features(said, size), np.zeros((len(KINDS), WEIGHTS))
    for kind in JUDGED:
        n = np.array([seen.get((kind, *map(int, v), int(z)), 0.0) for v, z in zip(said, size, strict=True)])
        n = n + UNSEEN * (n.sum() + 1) / len(n)
        p, n, w = posterior(said, min(shares[kind], SHARE_MOST), rates[kind]), n / n.sum(), np.zeros(WEIGHTS)
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (p - q)) - 1e-5 * w
            curve = (x * (n * q * (1 - q))[:, None]).T @ x + 1e-5 * np.eye(WEIGHTS)
            w = w + np.linalg.solve(curve, gradient)
        for j in range(len(VOTES)):  # as in the probabilities, whatever the fit leaves
            w[1 + 3 * j + NO], w[1 + 3 * j + YES] = min(w[1 + 3 * j + NO], 0), max(w[1 + 3 * j + YES], 0)
        out[kind] = np.round(w, 6)
    return out


def _accepts(span: Column, weights: np.ndarray, threshold: float) -> Column:
    table = F.array(*(F.lit(float(w)) for w in weights.ravel()))
    at = span["kind"] * WEIGHTS
    logit = F.get(table, at) + F.get(table, at + (1 + 3 * len(VOTES)) + span["size"])
    for j, name in enumerate(VOTES):
        logit = logit + F.get(table, at + (1 + 3 * j) + span[name])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) >= threshold


def fit(found: DataFrame, column: str = "candidates") -> np.ndarray:
    """The classifier's weights, from how often each combination of kind, votes and length occurs in all of ``found``."""
    spans = found.select(F.explode(column).alias("s")).filter(F.col("s.kind") >= len(BASE))
    counts = spans.groupBy("s.kind", *(F.col(f"s.{v}").alias(v) for v in VOTES), "s.size").count()
    return train(sorted(tuple(r) for r in counts.collect()))  # len(JUDGED) * 3 ** len(VOTES) * SIZES rows at most


def decide(found: DataFrame, column: str = "candidates", threshold: float = 0.5, weights: np.ndarray | None = None) -> DataFrame:
    """Adds ``spans``: array of struct(start, kind, end), sorted; kinds are positions in KINDS. A column of that name is replaced.

    Base spans stay; of the others those that the classifier accepts. Without ``weights``, they are fitted on
    ``found``, which is then read twice: give a written table.
    """
    weights = fit(found, column) if weights is None else weights
    taken = F.filter(column, lambda s: _is_base(s) | _accepts(s, weights, threshold))
    return found.withColumn("spans", F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def find(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``candidates``. A null text counts as empty and has none; a column of that name is replaced."""
    return docs.withColumn("candidates", candidates(common.text_or_empty(text)))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by its first kind in brackets; null stays null."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    size = F.length(text)
    end = F.struct(size.alias("start"), F.lit(len(KINDS)).alias("kind"), size.alias("end"))  # stands for what follows the last span

    def over(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a - first * BLOCK + 1, b - a)

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            fresh = F.array(between(at, s["start"]), F.coalesce(F.get(names, s["kind"]), F.lit("")))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, fresh).otherwise(F.array().cast("array<string>"))

        return F.array_join(_scan(F.concat(spans, F.array(end)), F.lit(0), "string", step), "")

    done = _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), over)
    return F.when(F.size(spans) == 0, text).otherwise(done)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    decided = decide(common.written(found, "candidates")[0])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return decided.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
