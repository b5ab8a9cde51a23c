"""Personal data and secrets by weak supervision.

Candidate spans are found with broad patterns.  Four labelers vote on each, for
(1), against (-1) or not at all (0): a strict *pattern* with its check digits or
ranges, a *gazetteer* (top-level domains, card issuers, calling codes, reserved
networks, key prefixes, names), the *context* words before it, and its *shape*.
Expectation-maximisation over the counts of vote patterns estimates, for each
kind of span, how reliable each labeler is and how likely the kind is; the
posteriors are then the soft labels of a logistic span classifier over features
of the span, which decides.  Counts of patterns and of features come from all
documents; how many distinct ones there are depends on the labelers alone, so
what the driver gets is bounded, and documents are read once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import FOLDED, Slice, slices

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "secret", "person")
LABELERS = ("pattern", "gazetteer", "context", "shape")
THRESHOLD = 0.5
CONTEXT = 40  # bytes before a span that the context labeler reads

TLDS = frozenset(b"com org net edu gov mil int info biz io ai app dev co uk us ca de fr es it nl be ch at se no fi dk pl pt ie eu ru cn jp kr in br mx ar cl au nz za tr gr cz hu ro bg ua il".split())
NAMES = b"Alexander Alexandra Andrew Angela Anthony Barbara Benjamin Brandon Brenda Brian Catherine Charles Charlotte Christine Christopher Claudia Cynthia Daniel Deborah Dennis Dorothy Edward Elizabeth Emily Franck Gabriel George Gregory Heather Isabella Jacqueline James Janet Jeffrey Jennifer Jessica Joseph Joshua Julia Katherine Kenneth Kimberly Laura Lawrence Margaret Matthew Melissa Michael Michelle Nancy Natalie Nicholas Olivia Pamela Patricia Patrick Rachel Rebecca Richard Robert Samantha Samuel Sandra Sarah Sharon Sophia Stephanie Stephen Steven Susan Thomas Timothy Vanessa Victoria Virginia Walter William".split()

GIVEN = frozenset(NAMES) | frozenset("Adam Alan Albert Alejandro Alice Amy Ana Anna Anne Antonio Arthur Bernard Camille Carla Carlos Carmen Carol Chloé David Diego Donald Elena Emma Eric Erik Eva Fernando Florian François Frank Franz Friedrich Gary Gerhard Hannah Hans Heinrich Helen Henry Hélène Ingrid Isabel Jack Jacques Jane Jason Javier Jean Joan Johann Johannes John Jonathan Jorge José Juan Julie Jürgen Karen Karl Kevin Klaus Lars Léa Linda Lisa Louis Lucas Lucía Luis Luise Manuel Manon Maria María Marie Mark Markus Martin Mary Max Miguel Monika Nicolas Pablo Paul Pedro Peter Petra Philip Philippe Pierre Rafael Ruth Ryan Sabine Sara Scott Simon Sofía Stefan Sylvie Teresa Thierry Tom Ursula Uwe Véronique Wolfgang Yves".encode().split())
#: Capitalised words that are hardly ever part of a person's name.
NO_NAMES = frozenset(b"Academy Act Agreement America Apache April August Avenue Bank Center City College Commons Company Copyright Corporation County December Department East February Foundation Friday General Government Group High Inc Institute International January July June Lake Law License Limited March May Monday Mount National New North November October Park Public Republic River Road Saturday School Sea September Software Source South State States Street Sunday The This Thursday Tuesday United University Version Wednesday West World".split())

_SEP = rb"(?:[ ./-]|\xc2\xa0)"
_U, _L = rb"(?:[A-Z]|\xc3[\x80-\x9e])", rb"(?:[a-z]|\xc3[\x9f-\xbf])"
_CAP = _U + rb"(?:['-]?" + _U + rb"?" + _L + rb"){1,24}(?![\w\x80-\xff])"
_TITLE = rb"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Mme|Mlle|M\.|Monsieur|Madame|Herr|Frau|Sr|Sra|Srta|Don|Do\xc3\xb1a)\.? "
_CUES = ("name is ", "Name: ", "name: ", "named ", "called ", "I am ", "Dear ", "dear ", "Hello ", "Hi ", "Sincerely, ", "Regards, ", "regards, ", "appelle ", "nomme ", "Cher ", "Chère ", "llamo ", "llama ", "nombre es ", "Estimado ", "Estimada ", "heiße ", "heißt ", "Name ist ", "Lieber ", "Liebe ", "Contact ", "contact ")
_CUE = b"(?:" + b"|".join(b"(?<=" + c.encode() + b")" for c in _CUES) + b")"
_LINK = rb"(?: (?:[A-Z]\.|von|van|de|der|del|da|di|la|le|du|dos)){0,2} "
_GIVEN = b"(?:" + b"|".join(sorted(GIVEN)) + b")"

_PATTERNS: dict[str, re.Pattern] = {
    "email": re.compile(rb"(?<![\w.%+-])[A-Za-z0-9\x80-\xff][A-Za-z0-9\x80-\xff._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    "phone": re.compile(
        rb"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{3,4}(?!\w|[.-]\d)|(?<![\w.])\+\d{8,15}(?!\w)"
        # French and Spanish numbers, those with a country code, and any run of groups with 8 digits or more
        rb"|(?<![\w.+])(?:(?:\+|00)33S?(?:\(0\)S?)?[1-9]|0[1-9])(?:S?\d\d){4}(?!\w|[.-]\d)|(?<![\w.+])(?:(?:\+|00)34S?)?[6-9]\d\d(?:S\d\d){3}(?!\w|[.-]\d)"
        rb"|(?<![\w.])(?=(?:\D{0,3}\d){8})(?:\+|00)\d{1,3}(?:S?\(0\))?(?:S?\(?\d{1,4}\)?){2,6}(?!\w|[.-]\d)"
        rb"|(?<![\w.+])(?=\(?\d(?:\)?S?\d){7})(?:\(\d{2,5}\)S?\d{2,8}(?:S\d{2,8}){0,4}|\d{2,5}(S)\d{2,8}(?:\1\d{2,8}){0,4})(?!\w|[.-]\d)".replace(b"S", _SEP)
    ),
    "card": re.compile(rb"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"),
    "ip": re.compile(rb"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)(?![A-Za-z_])"),
    "ssn": re.compile(rb"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "iban": re.compile(rb"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(rb"(?<![A-Za-z0-9])(?:(?:token|api[_-]?key|secret|passw(?:or)?d|pwd|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}[\"']?|(?:AKIA|ghp_|gho_|sk-|sk_live_|xox[abp]-)[A-Za-z0-9_-]{12,}|[A-Za-z0-9_+/-]{32,}(?![A-Za-z0-9]))", re.IGNORECASE),
    "person": re.compile(rb"(?<![\w\x80-\xff])(?:" + _TITLE + _CAP + b"(?:" + _LINK + _CAP + b"){0,2}|" + _CUE + b"(?!" + _TITLE + b")" + _CAP + b"(?:" + _LINK + _CAP + b"){0,2}|" + _GIVEN + _LINK + _CAP + b"|(?!" + _CAP + b" (?:" + _GIVEN + b" " + _U + b"|" + _TITLE + b"))" + _CAP + _LINK + _CAP + b")"),
}
_POSITIVE: dict[str, re.Pattern] = {
    "email": re.compile(rb"e-?mail|contact|write|address|mailto", re.I), "phone": re.compile(rb"phone|call|tel|mobile|fax|dial|reach", re.I), "card": re.compile(rb"card|visa|master|amex|credit|payment|charge", re.I), "ip": re.compile(rb"\bip\b|host|server|address|login|from|client", re.I),
    "ssn": re.compile(rb"ssn|social|security", re.I), "iban": re.compile(rb"iban|bank|account|transfer", re.I), "secret": re.compile(rb"token|key|secret|password|pwd|credential|auth", re.I), "person": re.compile(rb"\b(?:name[ds]?|mr|mrs|dr|dear|sincerely|contact|called|i am|hello|hi|regards|appelle|nomme|cher|ch\xc3\xa8re|llam[oa]|nombre|estimad[oa]|hei\xc3\x9f[et]|lieber?)(?![\w\x80-\xff])", re.I),
}
_NEGATIVE: dict[str, re.Pattern] = {
    "email": re.compile(rb"example of|format", re.I), "phone": re.compile(rb"isbn|order|serial|page|invoice", re.I), "card": re.compile(rb"isbn|tracking|serial|order|timestamp", re.I), "ip": re.compile(rb"version|release|section|\bv$|license", re.I),
    "ssn": re.compile(rb"part|serial|order", re.I), "iban": re.compile(rb"serial|part", re.I), "secret": re.compile(rb"sha\d*|md5|checksum|commit|hash", re.I), "person": re.compile(rb"street|city|county|river|university", re.I),
}
_KEYED = re.compile(rb"(?:token|api[_-]?key|secret|passw(?:or)?d|pwd|access[_-]?key)\s{0,3}[=:]", re.I)
_KEY_PREFIX = re.compile(rb"(?:AKIA|ghp_|gho_|sk-|sk_live_|xox[abp]-)", re.I)
#: Keys of known length and alphabet.
_KEY_FORM = re.compile(rb"AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{12,}")
#: Dates, addresses and social security numbers aren't telephone numbers; these are, without a country code.
_NO_PHONE = re.compile(rb"(?:19|20)\d\d[-./ ]\d\d[-./ ]\d\d(?:\D.*)?|\d\d[-./]\d\d[-./](?:19|20)\d\d|\d{1,3}(?:\.\d{1,3}){3}|\d{3}-\d{2}-\d{4}|(?:19|20)\d\d\D(?:19|20)\d\d")
_NATIONAL = re.compile(rb"0[1-9](?:\D{0,2}\d\d){4}|[2-9]\d\d[ .-]?[2-9]\d\d[ .-]\d{4}|[67]\d\d(?:\D{1,2}\d\d){3}")
_ISSUER = re.compile(rb"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|30[0-5]|3[68]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = c - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _iban(span: bytes) -> bool:
    s = span.replace(b" ", b"")
    return int("".join(str(int(chr(c), 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(s: bytes) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in map(s.count, set(s))) if n else 0.0


def judge(kind: str, span: bytes, before: bytes) -> tuple[tuple[int, int, int, int], int]:
    """The labelers' votes on a span, and its features as bits."""
    digits = bytes(c for c in span if 48 <= c <= 57)
    pattern = gazetteer = shape = 0
    separated = any(c in span for c in b" .-()")
    if kind == "email":
        local, _, domain = span.rpartition(b"@")
        tld = domain.rpartition(b".")[2].lower()
        pattern = 1 if tld.isalpha() and len(tld) > 1 and b".." not in local and not local.endswith(b".") else -1
        gazetteer = 1 if tld in TLDS else 0
        shape = 1 if len(local) > 1 else -1
    elif kind == "phone":
        groups = re.findall(rb"\d+", span)
        trunk = digits.startswith(b"0") and 9 <= len(digits) <= 12 and len(groups) > 1
        number = not 8 <= len(digits) <= 15 or _NO_PHONE.fullmatch(span)
        pattern = -1 if number else 1 if span.startswith((b"+", b"(", b"00")) or trunk or _NATIONAL.fullmatch(span) else 0
        gazetteer = 1 if re.match(rb"\+(?:1|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])", span) else 0
        series = not pattern and len(groups) > 3  # numbers one after another
        shape = 1 if 9 + (pattern < 1) <= len(digits) <= 15 and separated and not series else -1 if len(digits) < 9 else 0
    elif kind == "card":
        pattern = 1 if luhn(digits) else -1
        gazetteer = 1 if _ISSUER.match(digits) else 0
        shape = 1 if len(digits) in (15, 16) and len(set(digits)) > 2 else -1
    elif kind == "ip":
        parts = span.split(b".")
        pattern = 1 if all(int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if int(parts[0]) in (0, 127, 255) or parts.count(b"0") > 2 else 0
        shape = 1 if max(map(int, parts)) > 20 and all(p == b"0" or not p.startswith(b"0") for p in parts) else -1
    elif kind == "ssn":
        area, group, serial = span.split(b"-")
        pattern = -1 if area in (b"000", b"666") or area >= b"900" or group == b"00" or serial == b"0000" else 1
        gazetteer = -1 if span in (b"078-05-1120", b"219-09-9999", b"123-45-6789") else 0
        shape = 1 if len(set(digits)) > 2 else -1
    elif kind == "iban":
        pattern = 1 if _iban(span) else -1
        gazetteer = 1 if span[:2] in (b"DE", b"FR", b"ES", b"IT", b"NL", b"BE", b"AT", b"CH", b"GB", b"IE", b"PT", b"PL", b"SE", b"FI", b"DK", b"NO") else 0
        shape = 1 if len(digits) > 8 else -1
    elif kind == "secret":
        body = re.split(rb"[=:]\s*", span)[-1].strip(b"\"'")
        pattern = 1 if _KEYED.match(span) or _KEY_FORM.fullmatch(span) else 0
        gazetteer = 1 if _KEY_PREFIX.match(body) else 0
        mixed = bool(digits) and any(chr(c).isalpha() for c in body)
        shape = 1 if mixed and _entropy(body) > 2.8 else -1
    else:
        titled = re.match(_TITLE, span)
        own = span[titled.end() :].split() if titled else span.split()
        known, odd = own[0] in GIVEN, any(w in NO_NAMES for w in own) or len(set(own)) < len(own)
        pattern = 1 if titled else 0
        gazetteer = 1 if known and not odd else -1 if odd else 0
        shape = -1 if odd or not titled and len(own) < 2 else 1 if titled or known else 0
    good, bad = _POSITIVE[kind].search(before), _NEGATIVE[kind].search(before)
    context = 1 if good and not bad else -1 if bad and not good else 0
    bits = (pattern > 0) | (gazetteer > 0) << 1 | (shape > 0) << 2 | (good is not None) << 3 | (bad is not None) << 4 | separated << 5 | (len(digits) * 2 > len(span)) << 6 | (len(span) > 12) << 7 | (pattern < 0) << 8 | (gazetteer < 0) << 9
    return (pattern, gazetteer, context, shape), bits


FEATURE_BITS = 10
_HOT = np.zeros(256, dtype=bool)
_HOT[list(b"@0123456789=:")] = True
#: What keys are made of; a run of it as short as ``sk-`` and 12 more may be a secret.
_KEY_BYTE = np.zeros(256, dtype=bool)
_KEY_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")] = True
SHORTEST_RUN = 15
_cue_hashes = np.unique(next(slices(pa.array([" ".join(c.strip(" ,:").split()[-1] for c in _CUES)]), FOLDED)).hashes)
_REACH, _PERSON_REACH = 120, 480  # of digits and keys, and of names


def _hot(s: Slice) -> np.ndarray:
    """Bytes near which every candidate but persons lies."""
    inside = np.concatenate([[False], _KEY_BYTE[s.data], [False]])
    cut = np.zeros(len(inside), dtype=bool)
    cut[s.offsets] = True  # runs end with their rows
    begins, stops = (np.flatnonzero(x) for x in (inside[1:] & (~inside[:-1] | cut[:-1]), inside[:-1] & (~inside[1:] | cut[:-1])))
    runs = begins[stops - begins >= SHORTEST_RUN]
    return np.unique(np.concatenate([np.flatnonzero(_HOT[s.data]), runs]))


def _hot_names(s: Slice) -> np.ndarray:
    """Where persons may begin: at capitalised words with another one among the next three, or after a cue word."""
    first = s.data[s.starts]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3)
    padded = np.concatenate([capital, np.zeros(3, dtype=bool)])
    near = padded[1:-2] | padded[2:-1] | padded[3:]
    cued = np.zeros(len(capital), dtype=bool)
    at = np.flatnonzero(capital[1:])
    cued[at + 1] = np.isin(s.hashes[at], _cue_hashes)
    return s.starts[capital & (near | cued)]


def _windows(s: Slice, hot: np.ndarray, reach: int) -> Iterator[tuple[int, int, int]]:
    """(row, from, to): the stretches of a slice around the hot bytes, cut at white space."""
    if not len(hot):
        return
    row = np.searchsorted(s.offsets, hot, side="right") - 1
    opens = np.flatnonzero(np.concatenate([[True], (hot[1:] - hot[:-1] > reach) | (row[1:] != row[:-1])]))
    for a, b in zip(opens, np.concatenate([opens[1:], [len(hot)]])):
        r = int(row[a])
        lo, hi = max(int(hot[a]) - reach, int(s.offsets[r])), min(int(hot[b - 1]) + reach, int(s.offsets[r + 1]))
        while lo > s.offsets[r] and s.data[lo - 1] > 32:
            lo -= 1
        while hi < s.offsets[r + 1] and s.data[hi] > 32:
            hi += 1
        yield r, lo, hi


def candidates(s: Slice) -> dict[int, list[tuple]]:
    """Of each row with any: (start, end, kind, votes, features), places in bytes from the row's beginning."""
    found: dict[int, set[tuple]] = {}
    person = (KINDS.index("person"),)
    rest = tuple(k for k in range(len(KINDS)) if k not in person)
    for kinds, hot, reach in ((rest, _hot(s), _REACH), (person, _hot_names(s), _PERSON_REACH)):
        for r, lo, hi in _windows(s, hot, reach):
            text, base = s.data[lo:hi].tobytes(), lo - int(s.offsets[r])
            for k in kinds:
                kind = KINDS[k]
                if kind == "email" and b"@" not in text:
                    continue
                for m in _PATTERNS[kind].finditer(text):
                    at = lo + m.start()
                    before = s.data[max(int(s.offsets[r]), at - CONTEXT) : at].tobytes()
                    votes, bits = judge(kind, m.group(), before)
                    code = sum((v + 1) * 3**j for j, v in enumerate(votes))
                    found.setdefault(r, set()).add((base + m.start(), base + m.end(), k, code, bits))
    return {r: sorted(x) for r, x in found.items()}


_SPANS = "doc_id bigint, spans array<struct<start:int,stop:int,kind:int,votes:int,bits:int>>"
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "stop", "kind", "votes", "bits")]))


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): a row for each row of docs that has candidates, with them; places in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for s in slices(batch.column(1), FOLDED):
                for r, found in candidates(s).items():
                    own = s.data[s.offsets[r] : s.offsets[r + 1]]
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    rows.append(s.rows.start + r)
                    spans.append([{"start": int(chars[a]), "stop": int(chars[b]), "kind": k, "votes": v, "bits": f} for a, b, k, v, f in found])
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

    return common.id_and_text(docs).mapInArrow(run, _SPANS)


#: Real spans that fail a check of digits or ranges: a misprint, known beforehand and not estimated.
FAILED_CHECK = 0.001
#: Others that pass one: of random digits, a tenth has the right check digit.
CHANCE = 0.1
#: Prior P(vote is -1, 0, 1 | a span isn't, is real), of a labeler that checks digits or ranges and of the others.
CHECKED = ((0.70, 0.26, 0.04), (FAILED_CHECK, 0.399, 0.601))
PLAIN = ((0.20, 0.75, 0.05), (0.05, 0.55, 0.40))
#: Votes that a prior is worth.
WORTH = 10.0


def _monotone(weight: np.ndarray) -> np.ndarray:
    """P(outcome | class) from weights (2, 3); outcomes that speak for the wrong class are pooled over both."""
    p = weight / weight.sum(axis=1, keepdims=True)
    total = weight.sum(axis=1)
    pooled = [v for v in (0, 1) if p[1, v] > p[0, v]]
    for v in pooled:
        p[:, v] = (p[:, v] * total).sum() / total.sum()
    rest = [v for v in range(3) if v not in pooled]
    if pooled:
        p[:, rest] *= ((1 - p[:, pooled].sum(axis=1)) / p[:, rest].sum(axis=1))[:, None]
    return p


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, checks: tuple[int, ...] = (0,)) -> tuple[np.ndarray, float, np.ndarray]:
    """EM for one kind: (patterns, labelers) of votes and their counts to each labeler's P(vote | class), the share of class 1 and each pattern's posterior.

    A labeler has three outcomes, of which to abstain is one.  What is given:
    Dirichlet priors worth ``WORTH`` votes; that labelers are monotone, so neither a
    vote against nor silence is likelier for a real span than for another; and, of
    ``checks``, the labelers of digits and ranges, how often a real span fails
    (``FAILED_CHECK``) and at most how often another one passes (``CHANCE``), which is
    arithmetic.  All else is estimated.  The prior of the share of real spans counts
    for a tenth of the spans, so it is the same at every size.
    """
    share = 0.5
    start = np.array([[CHECKED if j in checks else PLAIN for j in range(votes.shape[1])]])[0].transpose(1, 0, 2)
    table, prior = start.copy(), WORTH * start
    post = np.zeros(len(votes))
    for _ in range(rounds):
        log = [np.log(p) + sum(np.log(table[c, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for c, p in ((0, 1 - share), (1, share))]
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        share = float((counts @ now + (WORTH + 0.1 * counts.sum()) / 2) / (1.1 * counts.sum() + WORTH))
        for c, w in ((0, counts * (1 - now)), (1, counts * now)):
            for j in range(votes.shape[1]):
                table[c, j] = prior[c, j] + np.bincount(votes[:, j] + 1, w, minlength=3)
        table = np.stack([_monotone(table[:, j]) for j in range(votes.shape[1])], axis=1)
        for j in checks:
            table[1, j, 1:] *= (1 - FAILED_CHECK) / table[1, j, 1:].sum()
            table[1, j, 0] = FAILED_CHECK
            if table[0, j, 2] > CHANCE:
                table[0, j, :2] *= (1 - CHANCE) / table[0, j, :2].sum()
                table[0, j, 2] = CHANCE
        done, post = np.abs(now - post).max(initial=0) < 1e-9, now
        if done:
            break
    return table, share, post


RIDGE = 0.1


def train(kind: np.ndarray, votes: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (kinds, 1 + features) of the span classifier, from counts of (kind, votes, features)."""
    codes = (votes[:, None] // 3 ** np.arange(len(LABELERS))) % 3 - 1
    weights = np.zeros((len(KINDS), 1 + FEATURE_BITS))
    for k in range(len(KINDS)):
        own = kind == k
        if not own.any():
            continue
        c = counts[own].astype(float)
        _, _, post = estimate(codes[own], c)
        x = np.concatenate([np.ones((own.sum(), 1)), (bits[own][:, None] >> np.arange(FEATURE_BITS)) & 1], axis=1).astype(float)
        w = weights[k]
        for _ in range(100):  # Newton steps, with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (c * (post - p)) - RIDGE * w
            hessian = (x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
    return weights


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, stop, kind, score): spans that are personal data or secrets, in characters, the end excluded.

    Of spans that overlap, the likeliest stays (then the longest, then the
    first).  Null and empty texts have none; very long ones are searched whole; a null doc_id stays null; repeated
    rows give repeated spans; other columns are ignored; an empty table gives
    none.
    """
    found = common.stored(find_candidates(docs), "spans")
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.bits").count().collect()  # at most as many as there are combinations
    rows.sort()
    kind, votes, bits, counts = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
    weights = train(kind, votes, bits, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, spans in enumerate(batch.column(1).to_pylist()):
                scored = []
                for x in spans:
                    w = weights[x["kind"]]
                    z = w[0] + sum(w[1 + j] for j in range(FEATURE_BITS) if x["bits"] >> j & 1)
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                    if p >= threshold:
                        scored.append((-p, x["start"] - x["stop"], x["start"], x["kind"]))
                taken: list[tuple[int, int]] = []
                for p, length, start, k in sorted(scored):
                    stop = start - length
                    if all(stop <= a or b <= start for a, b in taken):
                        taken.append((start, stop))
                        out.append((row, start, stop, KINDS[k], -p))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.float64())], ["doc_id", "start", "stop", "kind", "score"])

    return found.mapInArrow(run, "doc_id bigint, start int, stop int, kind string, score double")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
