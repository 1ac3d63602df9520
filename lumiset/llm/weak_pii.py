"""Personal data by aggregated weak supervision (operator 5).

Candidate spans are e-mail addresses, IP addresses, card and phone numbers by their base patterns, and looser candidates of
these and further kinds (secrets, account numbers, social security numbers, names). Five labelers vote on each candidate for,
against or not at all: a strict form, a checksum or plausibility rule, a gazetteer, cue words to the left, and the span's
surroundings. They vote on look-alikes too, which are never added: numbers that fail a checksum or have a wrong length, joined
words, dates, pairs of capitalised words. Expectation-maximisation over the counts of vote patterns, which Spark takes over all
of these in all texts, estimates how reliable each labeler is for each kind, from a stated belief and from all kinds where a kind
is rare; its posteriors then train a logistic span classifier on the span's shape and votes, which corrects what the belief says
of the votes alone. Base spans always stay; the classifier adds looser candidates that overlap none of them and that one
labeler at least votes for.

Defined cases: null text is empty text (no spans, the digest of the empty string); without candidates the classifier adds
nothing; spans of one kind never overlap; equal starts are listed in the order of ``KINDS``; repeated rows are searched each;
null ids are kept; extra columns are ignored. Offsets are code points, ends are exclusive. Every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn", "name")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Cue words by kind, and the gazetteer: frequent given names of four languages, and top-level domains.
CUES = {
    "email": "mail email e-mail contact courriel correo kontakt",
    "ip": "ip host server address adresse client",
    "card": "card visa mastercard amex credit karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono",
    "secret": "token key secret password passwd pwd api bearer credential",
    "iban": "iban account konto compte cuenta bank",
    "ssn": "ssn social security",
    "name": "name named contact dear sincerely regards from by called author",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
GIVEN = frozenset(
    """alexander alice amanda amy andrea andrew angela anna anne anthony antoine antonio barbara benjamin brian camille carlos
    carmen carol catherine charles charlotte christian christine christopher claire claudia daniel david deborah diego dominique
    donald donna dorothy edward elena elizabeth emily emma eric esther eva felix fernando francesca francisco franz frank gabriel
    george gerard hannah hans heinrich helen helga ines isabel jacques james jan jane javier jean jennifer jeremy jessica joan
    johannes john jonas jorge jose joseph juan julia julie julien karen karl katharina kevin klaus laura lea leon linda lisa louis
    lucas lucia luis lukas manuel marco margaret maria marie mark markus marta martin mary mateo matthew max michael michelle
    miguel monica nancy natalie nathalie nicolas nicole olivier pablo pamela patricia patrick paul pedro peter petra philippe pierre
    rafael raul rebecca richard robert rosa ruth sabine samuel sandra sara sarah sebastian sergio simon sofia sophie stefan stephanie
    stephen steven susan sven sylvie teresa theresa thomas tobias ursula valentina victor vincent werner william wolfgang""".split()
)
TOP = frozenset(
    """com org net edu gov mil int info biz io co me eu de at ch fr be lu nl uk ie us ca mx es pt it br ar cl pe ve au nz za in cn
    jp kr ru ua pl cz sk hu ro bg gr tr se no dk fi is ee lv lt""".split()
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_HIDDEN_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)+")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches from left to right, found from their @ signs: what stands before one is the run of local characters up to it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start and then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def loose_spans(text: str, digits: bool = True) -> list[tuple[str, int, int]]:
    """Candidates beyond the base patterns."""
    out = []
    if digits:
        for kind, pattern in (("secret", _SECRET), ("iban", _IBAN), ("ssn", _SSN), ("phone", _LOCAL_PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "at)" in text or "at]" in text:
        out += [("email", *m.span()) for m in _HIDDEN_MAIL.finditer(text)]
    return out + [("name", *m.span()) for m in _NAME.finditer(text)]


_LOOKALIKES = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?![A-Za-z0-9.-])")), ("phone", re.compile(r"(?<![0-9.+-])[0-9]{7,13}+(?![0-9-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z]+[_-])[A-Za-z_-]{20,}+(?![A-Za-z0-9_-])")), ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{2,10}+(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))[0-9]{2,4}-[0-9]{2,3}-[0-9]{2,4}(?![0-9-])")), ("name", re.compile(r"(?<=[a-z,] )(?!(?:Mr|Mrs|Ms|Dr|Prof)\b)[A-Z][a-z]++ [A-Z][a-z]++(?![A-Za-z])")),
)


def lookalikes(text: str) -> list[tuple[str, int, int]]:
    """Spans that miss what makes a kind: they stand for false spans when reliabilities are estimated."""
    out = [(kind, *m.span()) for kind, pattern in _LOOKALIKES for m in pattern.finditer(text)]
    for m in _IP.finditer(text):
        if not all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and not luhn(digits):
            out.append(("card", *m.span()))
    return out


def _plausible(kind: str, value: str) -> int:
    digits = _NOT_DIGIT.sub("", value)
    if kind == "iban":
        moved = "".join(str(int(c, 36)) for c in (value.replace(" ", "")[4:] + value[:4]))
        return 1 if int(moved) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
    if kind == "secret":
        mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
        return 1 if mixed >= 6 and len(set(value)) >= 8 else -1 if mixed <= 2 else 0
    if kind in ("card", "phone", "ip"):
        return -1 if len(set(digits)) <= 2 or (kind == "card" and not luhn(digits)) else 1 if kind == "card" else 0
    return 0


def votes(text: str, kind: str, start: int, end: int, base: bool, lookalike: bool = False) -> str:
    """A sign for each labeler: form, plausibility, gazetteer, cue words in the 40 characters before, surroundings."""
    value, left = text[start:end], text[max(0, start - 40) : start]
    form = -1 if lookalike else 1 if base or kind == "ssn" or (kind == "secret" and re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", value)) else 0
    words = {w.lower() for w in _WORD.findall(value)}
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if words & TOP else -1
    elif kind == "name":
        gazetteer = 1 if words & GIVEN else 0
    cue = 1 if {w.lower() for w in _WORD.findall(left)[-4:]} & CUES[kind] else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    joined = (before.isalnum() and kind != "email") or after.isalnum() or after == "_"
    quoted = before in ('"', "'", ":", "=") and before != ""
    around = -1 if joined else 1 if quoted else 0
    return "".join("-0+"[v + 1] for v in (form, _plausible(kind, value), gazetteer, cue, around))


def shape(text: str, start: int, end: int) -> str:
    """Length and share of digits of a span, in a few steps each."""
    n, part = end - start, text[start:end]
    return f"{min(3, n // 12)}{min(3, sum(c.isdigit() for c in part) * 4 // max(1, len(part)))}"


#: How often a labeler is believed to vote against, not at all and for: on false spans, and on true ones. A belief counts as BELIEF
#: spans for all kinds together, and what all kinds show as SHARED spans for each kind.
VOTES = np.array([
    [[0.5, 0.4, 0.1], [0.02, 0.48, 0.5]], [[0.5, 0.4, 0.1], [0.002, 0.508, 0.49]], [[0.3, 0.6, 0.1], [0.1, 0.5, 0.4]], [[0.01, 0.89, 0.1], [0.01, 0.49, 0.5]], [[0.4, 0.5, 0.1], [0.05, 0.65, 0.3]],
]).transpose(1, 0, 2)
BELIEF, SHARED = 40, 40
_ODDS = np.log(VOTES[1] / VOTES[0])


@dataclass
class Model:
    """``reliability[y, labeler, vote]`` of all kinds, the share of true spans by kind, and what the classifier adds to the votes."""

    reliability: np.ndarray
    prior: dict
    weights: dict
    cut: float = 0.5

    def probability(self, kind: str, vote: str, form: str) -> float:
        """How likely a span is true; under one half where no labeler votes for it."""
        z = believed(vote) + sum(self.weights.get(f, 0.0) for f in _inputs(kind, vote, form))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return p if "+" in vote else min(p, 0.49)


def believed(vote: str) -> float:
    """Log odds of a true span by its votes under the stated belief."""
    return float(sum(_ODDS[j, "-0+".index(c)] for j, c in enumerate(vote)))


def _inputs(kind: str, vote: str, form: str) -> list[str]:
    return ["1", f"k{kind}", f"l{form[0]}", f"d{form[1]}", *(f"v{i}{c}" for i, c in enumerate(vote))]


def aggregate(counts: list[tuple[str, str, str, int]], rounds: int = 40) -> Model:
    """EM over (kind, votes, shape, count), then the classifier on its posteriors.

    A kind has its own prior and its own P(vote | y), drawn to those of all kinds. It starts from what the votes say by belief.
    """
    labelers = 5
    if not counts:
        return Model(VOTES, {}, {"1": -1.0})
    kinds = sorted({k for k, *_ in counts})
    kind = np.array([kinds.index(k) for k, *_ in counts])
    vote = np.array([["-0+".index(c) for c in v] for _, v, _, _ in counts])
    n = np.array([c for *_, c in counts], float)
    belief = np.array([believed(v) for _, v, _, _ in counts])
    y = 1 / (1 + np.exp(-belief))
    for _ in range(rounds):
        own = np.zeros((len(kinds), 2, labelers, 3))
        for j in range(labelers):
            np.add.at(own, (kind, 1, j, vote[:, j]), n * y)
            np.add.at(own, (kind, 0, j, vote[:, j]), n * (1 - y))
        shared = own.sum(0) + BELIEF * VOTES
        shared /= shared.sum(2, keepdims=True)
        reliability = own + SHARED * shared
        reliability /= reliability.sum(3, keepdims=True)
        prior = np.array([(1 + (n * y)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(kinds))])
        logit = np.log(prior / (1 - prior))[kind] + sum(np.log(reliability[kind, 1, j, vote[:, j]] / reliability[kind, 0, j, vote[:, j]]) for j in range(labelers))
        y = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    names = sorted({f for k, v, s, _ in counts for f in _inputs(k, v, s)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    for i, (k, v, s, _) in enumerate(counts):
        x[i, [place[f] for f in _inputs(k, v, s)]] = 1
    w, weight = np.zeros(len(names)), n / n.sum()
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(belief + x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(names))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * w)
        w += step / max(1.0, float(np.abs(step).max()) / 3)
        if np.abs(step).max() < 1e-6:
            break
    return Model(shared, dict(zip(kinds, prior.tolist(), strict=True)), dict(zip(names, w.tolist(), strict=True)))


_ANY_DIGIT = re.compile("[0-9]")


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    digits = _ANY_DIGIT.search(text) is not None
    base = base_spans(text) if digits or "@" in text else []
    return [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, digits)]


def seen(text: str) -> list[tuple[str, str, str]]:
    """Kind, votes and shape of each candidate and look-alike of a text."""
    rows = [(k, votes(text, k, a, b, base), shape(text, a, b)) for k, a, b, base in candidates(text)]
    return rows + [(k, votes(text, k, a, b, False, True), shape(text, a, b)) for k, a, b in lookalikes(text)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from all candidates and look-alikes of all texts; the driver receives the counts of vote and shape patterns, of
    which there are few."""

    def start():
        return seen

    rows = per_text(docs, "kind string, votes string, shape string", start, id_col, text_col, many=True)
    counts = rows.groupBy("kind", "votes", "shape").count().collect()
    return aggregate(sorted((r["kind"], r["votes"], r["shape"], r["count"]) for r in counts))


def find(text: str, model: Model) -> tuple[list, list]:
    """Base spans, and all spans, each by start and kind."""
    found = candidates(text)
    base = [(k, a, b) for k, a, b, is_base in found if is_base]
    taken = sorted((a, b) for _, a, b in base)
    out, ends = list(base), {}
    for k, a, b, is_base in sorted(found, key=lambda s: (s[1], ORDER[s[0]])):
        if is_base or a < ends.get(k, 0) or any(a < d and c < b for c, d in taken):
            continue
        if model.probability(k, votes(text, k, a, b, False), shape(text, a, b)) >= model.cut:
            out.append((k, a, b))
            ends[k] = b
    return base, sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = box.value

        def row(text: str) -> tuple:
            base, spans = find(text, model)
            return (*(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

        return row

    return per_text(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", start, id_col, text_col)


def mask(text: str, spans: list) -> str:
    """The text with each span written as its kind in brackets; where spans overlap, their union is one, named by the first."""
    out, done = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[done:a], f"[{k.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``; null text stays null, other columns stay as they were."""
    box = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def start():
        model = box.value
        return lambda text: (mask(text, find(text, model)[1]),)

    rest = F.struct(F.col("text").isNull().alias("_none"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c != "text"])
    masked = per_text(docs.select(rest.alias("_row"), "doc_id", "text"), "_masked string", start, keep=("_row",))
    return masked.select(*[(F.when(~F.col("_row._none"), F.col("_masked")) if c == "text" else F.col(f"_row._{k}")).alias(c) for k, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))
