"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

One pass over the texts finds the base spans (fixed patterns with checks) and candidate spans of
further kinds, each with the votes of its labelers (patterns and checks, gazetteers, context, shape)
and hashed features. Only (kind, votes) counts go to the driver, a table that the labelers bound; expectation-
maximisation there estimates each labeler's reliabilities and the probability behind each
combination of votes. With these as soft labels a naive Bayes span classifier is trained from
sums per kind and hashed feature, again a bounded table, and judges each candidate. Base spans stay
whatever the classifier says.

Defined results: null text is empty and has no spans; ids, ties and repeated rows need no care, as
rows are independent; a text may be of any length, as every pattern runs in linear time; an empty
table gives an empty result; other columns are kept by ``redacted`` and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import released
from .common import ROWS, arrow_map, record, table, text_of, tidy, written

Span = tuple[int, int]
BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "national_id", "iban", "postal", "birth")
KINDS = BASE + ADDED

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, as it ends with whole runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain; found from the @, so in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    some = _DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if some else [], "card": cards(text) if some else [], "phone": phones(text) if some and "+" in text else []}


#: Common given names and surnames for the gazetteers, and words that announce or rule out personal data (fixed values).
GIVEN = frozenset("""
    Alice Alexander Amelia Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Bob Brian Camille Carlos Carmen Carol Charles Charlotte Chiara Chloe
    Christian Christine Christopher Claire Claudia Daniel David Deborah Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Felix Florian Francesca
    Francesco Frank François Frederic Gabriel George Giovanni Giulia Grace Hannah Hans Heinrich Helen Helga Henri Henry Hiroshi Ibrahim Ingrid Isabella Isabelle Ivan
    Jack Jacob James Jan Jane Janet Javier Jean Jennifer Jessica Johanna Johannes John Jonathan Jorge Joseph José Joshua Juan Julia Julie Jürgen Karen Karl Katharina
    Kenji Kenneth Kevin Klaus Klara Laura Lena Leon Linda Lisa Louis Luca Lucas Lucía Luis Luise Lukas Manuel Marco Margaret Maria María Marie Mario Mark Marta Martin
    Mary Matthew Max Maximilian Michael Michel Miguel Mohammed Monika Nancy Natalia Nathalie Nicholas Nicole Nina Noah Nora Olga Oliver Olivia Oscar Pablo Patricia
    Patrick Paul Paula Pedro Peter Petra Philip Pierre Rachel Rebecca Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Simon Sofia Sophia Sophie
    Stefan Stephen Susan Thomas Ursula Victoria William Wolfgang
""".split())
SURNAMES = frozenset("""
    Anderson Bauer Becker Bernard Brown Clark Davis Diaz Dubois Durand Fernandez Ferrari Fischer García Garcia Gonzalez Green Hall Harris Hernandez Hoffmann Jackson
    Johnson Jones Kim Klein Koch Kowalski Lee Leroy Lewis Lopez López Martin Martinez Martínez Meyer Miller Moore Moreau Müller Nguyen Novak Patel Perez Petit Ramirez
    Richter Rivera Robinson Rodriguez Rossi Roux Ruiz Sanchez Santos Schmidt Schneider Schulz Silva Simon Singh Smith Suzuki Tanaka Taylor Thomas Thompson Torres
    Wagner Walker Weber White Williams Wilson Wolf Wright Young Zimmermann
""".split())
#: Capitalised words that begin or end other things than names: function words, months, and kinds of organisations, places and departments (fixed values).
NOT_NAMES = frozenset("""
    A An And As At But By For From He Her His How I If In It Its My No Not Of On Or Our She So That The Their Then There These They This Those To We What When Where Which Who Why With You Your
    Der Die Das Ein Eine Und Im Am Le La Les Un Une Et El Los Las Una Y En
    January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
    Academy Agency Airport Association Avenue Bank Bay Board Book Bridge Building Bureau Castle Center Centre Chapter Church City Club College Committee Company Corp Corporation Council Country County Court
    Customer Day Department Desk Development District East Edition Engineering Festival Foundation Fund Garden Gate Group Hall Help Hill Hospital Hotel House Human Inc Institute International Island Journal Kingdom
    Lake Law League Library Limited Line Ltd Machine Management Manager Market Media Ministry Mountain Museum National New News North Office Old Open Park Part Party Policy Press Prize Program Project Public Relations
    Republic Research Resources Review River Road Royal Sales School Science Second Section Series Service Services Society South Source Square Station Street Studies Support System Systems Team Technology Times Tower Town
    Trust Union United University Valley Village War West World
""".split())
#: What stands before things, not people.
ARTICLES = ("the ", "a ", "an ", "this ", "that ", "its ", "der ", "die ", "das ", "dem ", "le ", "la ", "el ", "los ", "las ", "une ", "un ")
_SENTENCE_END = ".!?\n:;|"
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
CUES = {
    "name": ("name is", "named", "signed", "regards", "contact", "heiße", "heißt", "m'appelle", "me llamo", "se llama", "name:", "patient", "customer", "employee", "dear", "sincerely", "cordially", "yours"),
    "national_id": ("ssn", "social security", "national id", "tax id", "steuer", "nif", "dni", "insurance n", "identity n", "social sec"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "transfer", "pay to"),
    "postal": ("zip", "postal", "plz", "code postal", "address", "street", "postleitzahl", "avenue", "straße", "lives in", "lives at", "moved to", "mail to"),
    "birth": ("born", "birth", "dob", "geboren", "né le", "née le", "nacido", "nacida", "geb.", "birthday", "naissance"),
}
#: What stands before numbers that aren't personal.
OTHERWISE = ("order", "invoice", "part no", "item", "version", "page", "chapter", "serial", "model", "isbn", "build", "ticket", "total", "about", "released", "published", "updated", "expires")
COUNTRIES = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26}
STATES = frozenset("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())
#: Numbers that examples use, and that nobody has.
DUMMIES = frozenset(("123-45-6789", "078-05-1120", "219-09-9999", "111-11-1111", "555-55-5555"))
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,30}"
_NAME_WORD = rf"{_CAP}(?:[-'’]{_CAP})?"
_PARTICLES = r"(?:(?:de|del|della|da|di|van|von|der|den|la|le|bin|al)\x20){0,2}"
CANDIDATES = {
    "name": re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.?\x20)?{_NAME_WORD}\x20(?:[A-Z]\.\x20)?{_PARTICLES}{_NAME_WORD}(?!\w)"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "postal": re.compile(r"(?<![\w.,-])[0-9]{5}(?:-[0-9]{4})?(?![\w-]|[.,]\w)"),
    "birth": re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-]|\.\w)"),
}
NEAR, CLOSE, BUCKETS = 40, 16, 1 << 12
#: Labelers of a kind; each answers for, against, or abstains.
LABELERS = 5
_TOWN = re.compile(r"\x20" + _CAP)
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?\x20{_CAP}")
_COUNTED = re.compile(r"\x20(?:[a-zß-öø-ÿ]+|%|€|\$)")
_CLOCK = re.compile(r"(?<![0-9])[0-9]{1,2}:[0-9]{2}(?![0-9])")


def iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def plausible_id(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def plausible_date(span: str) -> bool:
    parts = [int(p) for p in re.split(r"[./-]", span)]
    day, month = (parts[2], parts[1]) if parts[0] > 31 else sorted(parts[:2], reverse=True) if parts[1] > 12 or parts[0] > 12 else parts[:2]
    return 1 <= day <= 31 and 1 <= month <= 12


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Of each labeler: 1 for, 0 against, -1 abstains. A check that nearly all spans pass votes only against."""
    span, before = text[a:b], text[max(0, a - NEAR) : a].lower()
    cue = any(c in before for c in CUES[kind])
    other = any(c in before[-CLOSE:] for c in OTHERWISE)
    context = 1 if cue and not other else 0 if other else -1
    alone = -1 if (a == 0 or text[a - 1] in " (\n\"':") and (b == len(text) or text[b] in " ,.;)\n\"'") else 0
    if kind == "name":
        words = span.replace(".", "").split(" ")
        own = words[1:] if words[0] in TITLES else words
        starts = a == 0 or text[:a].rstrip(" ")[-1:] in _SENTENCE_END if a < 2 else text[a - 2 : a].strip(" ")[-1:] in (*_SENTENCE_END, "")
        # a gazetteer says nothing about names that it lacks; other lists and articles say what isn't a name
        given = 1 if own[0].split("-")[0] in GIVEN else 0 if own[0] in NOT_NAMES or len(set(own)) == 1 else -1
        surname = 1 if own[-1] in SURNAMES else 0 if own[-1] in NOT_NAMES else -1
        return (1 if words[0] in TITLES else -1, given, surname, 1 if cue else 0 if before.endswith(ARTICLES) else -1, 0 if starts else -1)
    if kind == "national_id":
        others = text[max(0, a - 4 * NEAR) : b + 4 * NEAR]
        return (int(plausible_id(span)), context, alone, 0 if span in DUMMIES or len(set(span)) <= 2 else -1, 1 if "@" in others or _TITLED.search(others) else -1)
    if kind == "iban":
        size = COUNTRIES.get(span[:2])
        return (int(iban_ok(span)), context, alone, int(size is not None), -1 if size is None else int(size == len(span.replace(" ", ""))))
    said = int(cue and not other)  # bare numbers and dates are common, so a missing cue speaks against them
    if kind == "postal":
        state = text[max(0, a - 3) : a - 1] in STATES and text[a - 1 : a] == " "
        return (said, int(state or _TOWN.match(text, b) is not None), alone, 0 if span[2:5] == "000" or span[:3] == "000" else -1, 0 if _COUNTED.match(text, b) else -1)
    year = int(re.search("(?:19|20)[0-9]{2}", span)[0])
    return (-1 if plausible_date(span) else 0, said, alone, int(1900 <= year <= 2008), 0 if _CLOCK.search(text[max(0, a - 12) : b + 12]) else -1)


def features(kind: str, text: str, a: int, b: int) -> list[int]:
    """Hashed features of a span and what stands around it."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-zß-öø-ÿ]", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]", "A", text[a:b]))))
    left = re.findall(r"\w+|[^\w\s]", text[max(0, a - NEAR) : a].lower())[-2:]
    right = re.findall(r"\w+|[^\w\s]", text[b : b + NEAR].lower())[:1]
    raw = [f"s={shape}", f"n={min(b - a, 40) // 4}", *(f"l{i}={w}" for i, w in enumerate(reversed(left))), *(f"r={w}" for w in right), *(f"w={w}" for w in text[a:b].split(" ")[:4])]
    return [zlib.crc32(f"{kind}:{x}".encode()) % BUCKETS for x in raw]


def candidates(text: str, base: dict[str, list[Span]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind, start, end, votes as base-3 number, features); spans that touch base spans are left to these."""
    taken = sorted(s for own in base.values() for s in own)
    digits = _DIGIT.search(text) is not None
    out = []
    for k, kind in enumerate(ADDED):
        if kind != "name" and not digits:
            continue
        at = 0
        for m in CANDIDATES[kind].finditer(text):
            a, b = m.span()
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at < len(taken) and taken[at][0] < b:
                continue
            out.append((k, a, b, packed(votes(kind, text, a, b)), features(kind, text, a, b)))
    return out


FOUND = "row_id long, base array<struct<k:int,s:int,e:int>>, cand array<struct<k:int,s:int,e:int,v:int,f:array<int>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over ``id, text``: base spans and candidates."""
    base_type = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
    cand_type = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("v", pa.int32()), ("f", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()  # workers are used again, also after packing
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                base, cand = [], []
                for text in b["text"].to_pylist():
                    own = base_spans(text)
                    base.append([{"k": k, "s": s, "e": e} for k, kind in enumerate(BASE) for s, e in own[kind]])
                    cand.append([dict(zip("ksevf", c, strict=True)) for c in candidates(text, own)])
                yield record(row_id=b["id"], base=pa.array(base, base_type), cand=pa.array(cand, cand_type))

    return docs.mapInArrow(tidy(run), FOUND)


#: Where EM starts: how often a labeler that votes is right, and the share of personal data among candidates.
RIGHT, SHARE = 0.8, 0.3
#: What the start weighs in each step, in votes; it keeps the classes' meaning where few labelers vote.
STRENGTH = 10
#: Labelers that go by lists: titles, gazetteers and cues of names.
TRUSTED = {"name": (0, 1, 2, 3)}


def em(counts: dict[tuple[int, ...], float], rounds: int = 50, trusted: tuple[int, ...] = ()) -> dict[tuple[int, ...], float]:
    """The probability of being personal data behind each combination of votes, all of one kind.

    Labelers are independent given the truth; an abstention says nothing. The start trusts each
    labeler alike, so the larger class of agreeing votes is the one they vote for. Labelers in ``trusted``
    never count for less than at the start: where lists and cues don't meet, votes alone can't tell which of them are wrong.
    """
    if not counts:
        return {}
    votes_ = np.array(list(counts), dtype=int)
    n = np.array([counts[k] for k in counts], dtype=float)
    said = [votes_ == 0, votes_ == 1]
    start = np.array([[RIGHT, 1 - RIGHT], [1 - RIGHT, RIGHT]])  # by truth: votes against, votes for
    rate = np.repeat(start[:, :, None], votes_.shape[1], axis=2)
    sure = np.isin(np.arange(votes_.shape[1]), trusted)
    prior, post = SHARE, np.zeros(len(n))
    for _ in range(rounds):
        log = [np.log(p) + sum((said[a] * np.log(rate[y, a])).sum(axis=1) for a in (0, 1)) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        prior = float(np.clip((n @ post + SHARE * STRENGTH) / (n.sum() + STRENGTH), 0.01, 0.99))
        for y, weight in ((0, n * (1 - post)), (1, n * post)):
            got = np.stack([weight @ said[a] for a in (0, 1)]) + STRENGTH * start[y][:, None]
            right = np.where(sure, np.maximum(got[y] / got.sum(axis=0), RIGHT), got[y] / got.sum(axis=0))
            rate[y, y], rate[y, 1 - y] = right, 1 - right
    return {k: float(p) for k, p in zip(counts, post, strict=True)}


def packed(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def unpacked(v: int) -> tuple[int, ...]:
    return tuple(v // 3**i % 3 - 1 for i in range(LABELERS))


class Classifier(NamedTuple):
    """Naive Bayes by kind: the prior log odds, and the weight of each feature, from counts of its own kind."""

    prior: dict[int, float]
    weight: np.ndarray

    def takes(self, c: dict) -> bool:
        return self.prior[c["k"]] + float(self.weight[c["k"], c["f"]].sum()) > 0


#: Added to each count of a feature.
SMOOTHING = 0.1


def classifier(found: DataFrame) -> Classifier:
    """From a table of ``scanned``; all that is collected is bounded by kinds, votes and buckets."""
    cand = found.select(F.explode("cand").alias("c"))
    votes_ = cand.groupBy("c.k", "c.v").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds * 3**LABELERS rows
    posterior, prior = {}, {}
    for k in range(len(ADDED)):
        counts = {unpacked(r["v"]): float(r["n"]) for r in votes_ if r["k"] == k}
        found_ = em(counts, trusted=TRUSTED.get(ADDED[k], ()))
        posterior |= {(k, v): p for v, p in found_.items()}
        yes = sum(counts[v] * p for v, p in found_.items())
        prior[k] = math.log((yes + 0.5) / (sum(counts.values()) - yes + 0.5))
    # as an Arrow table: a list of rows would go through workers of another kind, which each executor keeps beside its own
    soft = found.sparkSession.createDataFrame(pa.table({"k": pa.array([k for k, _ in posterior], pa.int32()), "v": pa.array([packed(v) for _, v in posterior], pa.int32()), "p": pa.array(list(posterior.values()), pa.float64())}))
    per = cand.select("c.k", "c.v", F.explode("c.f").alias("f")).join(F.broadcast(soft), ["k", "v"])
    sums = per.groupBy("k", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # at most kinds * BUCKETS rows
    table_ = np.zeros((2, len(ADDED), BUCKETS))
    for r in sums:
        table_[:, r["k"], r["f"]] = r["no"], r["yes"]
    seen = np.maximum((table_.sum(axis=0) > 0).sum(axis=1), 1)  # features of a kind
    table_ += SMOOTHING
    total = table_.sum(axis=2, keepdims=True) - SMOOTHING * (BUCKETS - seen)[None, :, None]
    share = np.log(table_ / total)
    return Classifier(prior, share[1] - share[0])


def accepted(cand: list[dict], model: Classifier) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the candidates that the classifier takes, as indices into ``KINDS``."""
    return [(len(BASE) + c["k"], c["s"], c["e"]) for c in cand if model.takes(c)]


def written_as(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e in spans))


def digests(found: DataFrame) -> DataFrame:
    model = classifier(found)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, spans = [[], [], [], []], [], []
        for base, cand in zip(b["base"].to_pylist(), b["cand"].to_pylist(), strict=True):
            own = [(x["k"], x["s"], x["e"]) for x in base]
            for k in range(4):
                n[k].append(sum(x[0] == k for x in own))
            sha.append(hashlib.sha256(written_as(own).encode()).hexdigest())
            spans.append(written_as(own + accepted(cand, model)))
        counts = {f"n_{kind}": pa.array(n[k], pa.int64()) for k, kind in enumerate(BASE)}
        return record(doc_id=b["row_id"], **counts, base_sha256=pa.array(sha, pa.string()), spans=pa.array(spans, pa.string()))

    return arrow_map(found, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each row."""
    return digests(written(scanned(text_of(docs, id_col, text_col)), "pii", rows=ROWS))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``<KIND>`` in place of each span; of overlapping spans the first, then the longest, is named."""
    out, last = [], 0
    for s, e, k in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1], x[2])):
        if s >= last:
            out += [text[last:s], f"<{KINDS[k].upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; null texts stay null and all columns stay."""
    plain = docs.select(F.lit(0).cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    model = classifier(written(scanned(plain).where(F.size("cand") > 0).select("cand"), "pii", rows=ROWS))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        released()
        texts = []
        for text in b[text_col].to_pylist():
            if text is not None:
                own = base_spans(text)
                spans = [(BASE.index(k), s, e) for k, found in own.items() for s, e in found]
                text = redact(text, spans + accepted([dict(zip("ksevf", c, strict=True)) for c in candidates(text, own)], model))
            texts.append(text)
        at = b.schema.get_field_index(text_col)
        return b.set_column(at, text_col, pa.array(texts, b.schema.field(at).type))

    return arrow_map(docs, run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
