"""Template residue, stand-in copy, error pages and script notices in place of content.

A regularised linear classifier scores every sentence of every text by hashed n-grams (words, pairs of neighbouring
words, pairs of their shapes), its length, and whether it stands in the title line. Its labels are weak: response statuses and
phrases of failed pages, notices, fields and stand-in copy (``_SEEDS``), unless the place quotes or explains them. It is
fitted on a bounded sample of texts of some hosts; its threshold is set, and its quality measured, on hosts it has not
seen. The phrases are used for nothing but the labels: which texts come out, the classifier alone decides. Because it is
linear, scoring takes a table lookup per word and per pair of words; what a word adds is computed once per distinct word
of a worker.

Defined results: a null, empty or blank text is no case; every text is scored in full; repeated rows give one row for
each distinct id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from passagemill.llm.encode import slices
from passagemill.session import spread

#: Texts that are labelled for fitting, about; of their sentences without a cue, one in so many is fitted on.
SAMPLE_TEXTS, PLAIN_SHARE = 10_000, 4
#: Hash buckets of the weights; strength of the regularisation; weight of a positive sentence; fitting steps.
BUCKETS, RIDGE, POSITIVE_WEIGHT, STEPS = 1 << 20, 0.4, 4.0, 50
#: One host in so many is kept out of the fit.
HELD_OUT = 5
#: Thresholds that are tried on the hosts kept out.
THRESHOLDS = tuple(t / 4 for t in range(-4, 13))

_TOKEN = regex.compile(r"\n|\p{N}+(?:[.,:/-]\p{N}+)*|[\p{L}\p{M}]+|_+|[^\s\p{L}\p{M}\p{N}_]+")
_ENDS = frozenset("\n . ! ? । … !! ?! - – —".split(" "))

# weak labels; the lists are ours and open-ended, as any phrase that pages of this kind use may stand here
_SEEDS = {
    "status": r"\b(?:error|http|status|fehler|erreur)\s*[:#-]?\s*[45]\d\d\b"
    r"|\b(?:40[0134589]|410|429|50[0234])\b\s*[-–—:|]?\s*(?:not found|forbidden|bad (?:gateway|request)|internal server error|(?:service )?unavailable|gateway time-?out|unauthori[sz]ed|too many requests|gone|error)"
    r"|\"status\"\s*:\s*\"?(?:error|fail|[45]\d\d)",
    "failed": r"page not found|(?:could|can) ?not find (?:that|the|this) page|page (?:cannot|can not|can't|could not) be (?:displayed|found|shown)|something went wrong"
    r"|(?:page|site) has moved|no longer exists|access (?:is )?denied|permission to (?:view|access)|too many requests|requests? (?:was |has been )?blocked|connection (?:failed|refused|timed out)"
    r"|application error|stack trace|(?:under|down for|scheduled) maintenance|back (?:shortly|soon)|be right back|session (?:has|is) (?:expired|timed out)|checking (?:that|if|whether|your browser|you)"
    r"|you are (?:a )?human|upstream server|gateway time-?out|bad gateway|internal server error|service (?:temporarily )?unavailable|temporarily unavailable|try again (?:later|in a)"
    r"|seite nicht gefunden|zugriff verweigert|versuchen sie es (?:bitte )?später|serverfehler|wartungsarbeiten|sitzung ist abgelaufen"
    r"|página no encontrada|acceso denegado|error del servidor|inténte(?:lo|nte) (?:de nuevo )?más tarde|sesión ha (?:caducado|expirado)|en mantenimiento"
    r"|page introuvable|accès (?:refusé|interdit)|erreur (?:du |de )?serveur|veuillez réessayer|session a expiré|en maintenance"
    r"|पृष्ठ नहीं मिला|पेज नहीं मिला|सर्वर में त्रुटि|पुनः प्रयास करें|पहुँच अस्वीकृत|अनुमति नहीं",
    "scripts": r"(?:enable|allow|turn on|activate) (?:javascript|js\b|scripts|cookies)|javascript is (?:disabled|off|required|not)|requires? (?:javascript|cookies)|needs? (?:scripts|javascript)"
    r"|scripting switched off|(?:cookies|scripts|cookies and scripts) must be|without script|\bnoscript\b|turn them on and reload"
    r"|activer javascript|activez javascript|aktivieren sie (?:bitte )?(?:javascript|cookies)|activ[ea]r? javascript|habilit[ea]r? javascript|जावास्क्रिप्ट",
    "copy": r"\blorem\b|\bipsum\b|dummy (?:copy|text)|your (?:heading|title|text|headline|subtitle) (?:goes )?here|(?:sample|example) text|placeholder|click to edit|(?:replace|insert|type) (?:this|your) (?:paragraph|text|copy|headline)"
    r"|description of [^.\n]{0,40} to follow|(?:copy|text|content|details) to (?:come|follow)|filler text|layout review only|texto de relleno|texto de ejemplo|texto simulado|platzhalter|hier (?:steht|kommt|folgt) (?:später |bald |noch )?(?:der|ein|ihr) text|aquí (?:va|irá) (?:el|su) texto|ici (?:viendra|votre) (?:le )?texte|blindtext|beispieltext|mustertext|texte (?:d'attente|à remplacer|de remplacement|factice|de remplissage|d'exemple)|नमूना पाठ|यहाँ पाठ",
    "filler": r"^\s*(?:x{2,}\s*){4,}$|^\s*(?:[asdfghjkl]{1,12} +){6,}[asdfghjkl]{1,12}\s*$|^\s*(?:[qwertyuiop]{1,12} +){8,}[qwertyuiop]{1,12}\s*$|\b(?P<again>text|test|content|foo bar|foo|abc|asdf|qwerty|lorem ipsum|copy|blah|words?|dummy|sample|filler|placeholder)(?:[ /,]+(?P=again)){3,}",
    "field": r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|<%[^<>\n]{0,60}%>|[$#]\{[^{}\n]{1,40}\}|%\(\w+\)[sd]|\[\[[^\[\]\n]{1,40}\]\]|<<[^<>\n]{1,40}>>|«\w+_\w+»|@@\w+@@|\b__\w+__\b|%[a-z]+(?:_[a-z]+)+%"
    r"|(?<![\w{$#])\{(?:\w+(?:_\w+)*|\d)\}|\[●\]|_{4,}|\${2,}|\bxx\.xx\b|\bdd/mm/yyyy\b|\byyyy-mm-dd\b|\[object object\]|<(?:value )?missing[^<>\n]{0,20}>|<value [^<>\n]{1,20}>|\bnan\b|(?<!\b(?:was|is|are|were|be|been|as|remains?|left) )\bundefined\b(?! (?:for|in|by|until|under)\b)|(?<![\w%])%[sd]\b"
    r"|[<\[](?:insert|enter|your|add|todo|tbd|tbc)\b[^<>\[\]\n]{0,40}[>\]]|\[[^\[\]\n]{1,50} (?:to be (?:added|confirmed|supplied)|here)\]|[<\[][a-z]+(?:_[a-z]+)+[>\]]|\[[^\[\]\n]{0,30}(?:का नाम|einfügen|eintragen|ergänzen|insertar|aquí|ici|à (?:compléter|renseigner|insérer|définir))\]"
    r"|\[(?:nom|nombre|name|fecha|date|datum|importe|montant|betrag)\b[^\[\]\n]{0,40}\]|\((?:fill in|fill out|insert|enter|add|tbd|tbc|to be (?:added|confirmed))\b[^()\n]{0,40}\)",
}
_SEED = {k: regex.compile(v, regex.M) for k, v in _SEEDS.items()}  # for lower-case text
_QUOTES = "\"'`“”‘’„"
_TOLD = regex.compile(r"\b(?:explains?|explained|phrase|says?|said|saw|seen|wrote|writes|calls?|called|designers?|means?|report|recorded|steps|leaflet|brochure|kept|sagt|nennt|dice|dijo|appelle|कहते)\b", regex.I)
#: A sentence about a scheme tells of something that happened to it.
_ABOUT = regex.compile(r"\b(?:of|for|from)\s+(?:[\w-]+\s+){1,4}fund\b", regex.I)
#: A sentence that tells of a message has more to say than the message, which takes less than this share of it.
_TOLD_SHARE = 0.5
_CUE = regex.compile(r"script|404|50[0-4]|403|lorem|ipsum|placeholder|template|field|sample|copy|page|server|access|session|maintenance|unavailable|denied|undefined|error|request|moved|human|insert|code|browser|cookie|[{}\[\]<>$#%_@`]", regex.I)


def lower(text: str) -> str:
    """Lower-case form in which every character keeps its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _told(text: str, a: int, b: int) -> bool:
    """Whether a message lies in a sentence that tells of it or quotes it."""
    line = text.rfind("\n", 0, a) + 1
    stop = text.find("\n", b)
    stop = stop if stop >= 0 else len(text)
    left = max(text.rfind(x, line, a) for x in (". ", "! ", "? ", "। "))
    right = min((e for x in (". ", "! ", "? ", "। ") if (e := text.find(x, b, stop)) >= 0), default=stop)
    sentence = text[line if left < 0 else left + 2 : right]
    if b - a < _TOLD_SHARE * len(sentence) and (_TOLD.search(sentence) or _ABOUT.search(sentence)):
        return True
    return a > 0 and text[a - 1] in _QUOTES and text[b : b + 2].strip(",. ")[:1] in tuple(_QUOTES)


def labelled_places(text: str) -> list[tuple[int, int]]:
    """Places of a text that hold a seed and neither quote nor explain it."""
    out, low = [], lower(text)
    for kind, pattern in _SEED.items():
        for m in pattern.finditer(low):
            a, b = m.span()
            if kind == "field":
                told = a > 0 and b < len(text) and text[a - 1] in _QUOTES and text[b] in _QUOTES
            else:
                told = kind != "filler" and _told(text, a, b)
            if not told:
                out.append((a, b))
    return out


def _shape(token: str) -> str:
    return "9" * min(len(token), 4) if token[0].isnumeric() else token.lower()


_ROWS = tuple(map(frozenset, ("asdfghjkl", "qwertyuiop", "zxcvbnm")))


def _kind(token: str) -> str:
    """What is left of a token when its letters don't count: signs as they are, numbers and words by class; words of
    one letter repeated, or of one row of the keyboard, have their own classes."""
    first = token[0]
    if first.isnumeric():
        return "9"
    if not first.isalpha():
        return token if first != "_" else "_" * min(len(token), 3)
    letters = frozenset(token.lower())
    if len(letters) == 1:
        return "w1"
    return next((f"row{i}" for i, row in enumerate(_ROWS) if letters <= row), "w")


@lru_cache(1 << 17)
def _hashes(token: str) -> tuple[int, int]:
    """Hash values of a word and of its kind."""
    return zlib.crc32(_shape(token).encode("utf-8", "surrogatepass")), zlib.crc32(b"kind " + _kind(token).encode("utf-8", "surrogatepass"))


def _pair_buckets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _own_bucket(name: str) -> int:
    return zlib.crc32(f"own {name}".encode()) % BUCKETS


_LENGTH_BUCKETS = np.array([_own_bucket(f"length {i}") for i in range(12)])
_TITLE, _BIAS = _own_bucket("title"), _own_bucket("bias")


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 11)


def sentences(text: str) -> Iterator[tuple[list[str], int, int, bool]]:
    """(tokens, start, end, whether in the title line) of every sentence of a text."""
    tokens, start, end, title = [], 0, 0, True
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in _ENDS:
            if tokens:
                yield tokens, start, end, title
                tokens = []
            title = title and t != "\n"
        else:
            if not tokens:
                start = m.start()
            tokens.append(t)
            end = m.end()
    if tokens:
        yield tokens, start, end, title


def _buckets(tokens: list[str], title: bool) -> np.ndarray:
    """All features of a sentence, as 32-bit integers."""
    both = np.array([_hashes(t) for t in tokens], np.uint64).T
    extra = [_BIAS, _LENGTH_BUCKETS[min(len(tokens).bit_length() - 1, 11)], *([_TITLE] if title else [])]
    return np.concatenate([both[0] % BUCKETS, _pair_buckets(both[:, :-1], both[:, 1:]).ravel(), extra]).astype(np.int32)


@dataclass
class Classifier:
    weights: np.ndarray
    threshold: float
    held_out: dict[str, float]  # quality on sentences of hosts outside the fit


def fit_logistic(flat: np.ndarray, size: np.ndarray, label: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression over hashed features, by limited-memory BFGS.

    ``flat`` holds the buckets of all sentences one after the other, ``size`` how many each has.
    """
    used, flat = np.unique(flat, return_inverse=True)
    starts = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    sign, weight = np.where(label, 1.0, -1.0), np.where(label, POSITIVE_WEIGHT, 1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * np.add.reduceat(w[flat], starts)
        slope = -sign * weight / (1 + np.exp(np.clip(margin, -50, 50)))
        value = (weight * np.logaddexp(0, -margin)).sum() + ridge / 2 * w @ w
        return value, np.bincount(flat, slope[row], len(used)) + ridge * w

    w = np.zeros(len(used))
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, kept = -slope, []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            kept.append(a)
            step = step - a * y
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            step = step + (a - y @ step / (s @ y)) * s
        rate = 1.0 if past else 1.0 / max(np.abs(slope).sum() ** 0.5, 1.0)
        for _ in range(20):
            new_value, new_slope = loss(w + rate * step)
            if new_value <= value + 1e-4 * rate * (slope @ step):
                break
            rate /= 2
        else:
            break
        s, y = rate * step, new_slope - slope
        w, gain, value, slope = w + s, value - new_value, new_value, new_slope
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y)]
        if gain < 1e-5 * abs(value):
            break
    out = np.zeros(BUCKETS)
    out[used] = w
    return out


#: What the seeds look like, so that a small or one-sided sample holds each kind: whole sentences, and fields that are
#: set into plain sentences of the sample.
_MESSAGES = (
    "Error 404 : page not found|500 - Internal Server Error|502 Bad Gateway|503 Service Unavailable|403 Forbidden|504 Gateway Timeout|Access denied|Page not found|Too many requests|Your session has expired|Under maintenance , back shortly"
    "|Something went wrong|This page has moved or no longer exists|The page cannot be displayed|Database connection failed|Application error : stack trace follows|Request blocked|Checking that you are human|Seite nicht gefunden"
    "|Zugriff verweigert|Página no encontrada|Acceso denegado|Page introuvable|Accès refusé|पृष्ठ नहीं मिला|सर्वर में त्रुटि हुई|{\"status\": \"error\", \"title\": \"Access denied\"}|<html><h1>Access denied</h1>|Please enable JavaScript to view this page|JavaScript is disabled in your browser|Cookies and scripts must be allowed"
    "|This site needs scripts to run|Veuillez activer JavaScript|Bitte aktivieren Sie JavaScript|Active JavaScript para ver esta página|जावास्क्रिप्ट चालू करें|noscript|Lorem ipsum dolor sit amet|Your heading here|Sample text goes here"
    "|Dummy copy for layout review only|Replace this paragraph|Click to edit this block|Caption placeholder|Short description to follow|Copy to come / copy to come / copy to come|text text text text text text|test test test test test"
    "|content content content content|foo bar foo bar foo bar|abc abc abc abc abc abc|qwerty qwerty qwerty qwerty|blah blah blah blah|xxxx xx xxxxx xxx xxxxxx xx|sdf kjh asdg hjkl fgh dsa lkj|Texto de relleno por sustituir|Platzhaltertext|Hier steht später der Text|Texte à remplacer|Texte de remplacement à compléter|Texto de ejemplo|यहाँ नमूना पाठ आएगा"
).split("|")
_FIELDS = (
    "{{ name }}|{{nav_date}}|{{ scheme.name }}|${date}|${plan_type}|[[name]]|[[plan_type]]|<%= name %>|<%= nav_date %>|{% name %}|{% plan_type %}|#{name}|#{nav_date}|%(name)s|%(plan_type)s|%NAV_DATE%|%NAME%|@@NAME@@|@@PLAN_TYPE@@"
    "|__NAME__|__NAV_DATE__|{0}|{1}|{name}|{PLAN_TYPE}|<<name>>|<<plan_type>>|[●]|________|____|$$|[insert date]|[insert name]|[TODO figure]|[TODO]|<value missing>|<missing>|[object Object]|NaN%|NaN|undefined|DD/MM/YYYY|XX.XX%|XX"
    "|«plan_name»|«name»|%s|%d|<INSERT NAME>|<INSERT NAV_DATE>|<plan_name>|<nav_date>|[FUND_NAME]|[NAV_DATE]|[Name to be added]|[to be confirmed]|[Insert fund name here]|(fill in amount)|[Name einfügen]|[nom à compléter]|[insertar nombre]|$$PLAN$$|[योजना का नाम]"
).split("|")
#: What looks like a field at first sight and is ordinary writing.
_ORDINARY = "[1]|[4]|[A]|[B]|[sic]|(a/b)|(see below)|x < y|a > b|<Annex>|{A, B}|{Growth, IDCW}|100%|5 %|$5|#3|* 2|name_of@mail.example|§ 4|&amp;|\"so called\"|'as is'|**note**".split("|")
#: Of the plain sentences that are fitted on, one in so many also comes with a field set into it, with the same kind of
#: field in quotes (as in texts that explain it), with ordinary signs, torn, and with stray characters.
#: MASHED: sentences of keys struck at random, of each kind.
WITH_FIELD, WITH_QUOTED, WITH_ORDINARY, TORN, MASHED, NOISY = 2, 6, 8, 3, 60, 4
#: Stray characters that get into texts, within words as well.
_STRAY = ("\f", "\t\t", "\u2028", "\u200b", "\ufeff", "\xa0\xa0", "     ", "=====", "0000", "№", "ß", "İ", "→", "🚀", "基金", "ファンド", "नि")


def _variants(tokens: list[str], seed: int) -> Iterator[tuple[list[str], bool]]:
    """Further sentences to fit on that are made of a plain one, with their labels."""
    rng = np.random.default_rng(seed)
    at = int(rng.integers(len(tokens)))
    for share, quote in ((WITH_FIELD, ""), (WITH_QUOTED, "\"'`"[seed % 3])):
        if rng.integers(share) == 0:
            field = _FIELDS[rng.integers(len(_FIELDS))]
            if rng.integers(2):  # what a field is called says little
                inner = "_".join(tokens[int(rng.integers(len(tokens)))] for _ in range(int(rng.integers(1, 3))))
                field = field.replace("name", inner.lower()).replace("NAME", inner.upper())
            yield _TOKEN.findall(" ".join([*tokens[:at], quote + field + quote, *tokens[at + 1 :]])), not quote
    if rng.integers(WITH_ORDINARY) == 0:
        yield _TOKEN.findall(" ".join([*tokens[:at], _ORDINARY[rng.integers(len(_ORDINARY))], *tokens[at:]])), False
    if rng.integers(NOISY) == 0:
        cut = int(rng.integers(len(tokens[at]) + 1))
        stray = _STRAY[rng.integers(len(_STRAY))] if rng.integers(4) else rng.bytes(int(rng.integers(4, 40))).hex()
        yield _TOKEN.findall(" ".join([*tokens[:at], tokens[at][:cut] + stray + tokens[at][cut:], *tokens[at + 1 :]])), False
    if len(tokens) > 2 and rng.integers(TORN) == 0:
        cut = int(rng.integers(1, len(tokens)))
        part = list(tokens[:cut] if rng.random() < 0.5 else tokens[cut:])
        end = 0 if rng.random() < 0.5 else -1
        if part[end].isalpha() and len(part[end]) > 2:  # tears go through words as well
            part[end] = part[end][: int(rng.integers(1, len(part[end])))]
        yield part, False


def _messages() -> Iterator[list[str]]:
    """Sentences that are residue wherever they stand."""
    rng = np.random.default_rng(2)
    for m in _MESSAGES:
        for variant in (m, m.upper()):
            yield from (tokens for tokens, *_ in sentences(variant))
    for letters in ("asdfghjkl", "qwertyuiop", "zxcvbnm", "x"):
        for _ in range(MASHED):
            yield ["".join(rng.choice(list(letters), int(rng.integers(2, 10)))) for _ in range(int(rng.integers(4, 24)))]


def _sampled(documents: DataFrame, item: str, text: str, host: str, texts: int) -> DataFrame:
    """(buckets, label, made_up, held_out) of sentences of about ``texts`` texts, chosen by hash, and of variants."""
    share = min(1.0, texts / max(documents.count(), 1))
    chosen = F.pmod(F.xxhash64(F.col(item), F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    kept = F.pmod(F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("")), F.lit(5)), F.lit(HELD_OUT)) == 0
    rows = documents.where(chosen & F.col(text).isNotNull()).select(F.col(text).alias("text"), kept.alias("held_out"))
    schema = "buckets array<int>, label boolean, made_up boolean, held_out boolean"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, held in zip(*(c.to_pylist() for c in batch.columns)):
                places = labelled_places(value)
                for tokens, a, b, title in sentences(value):
                    hit = any(x < b and a < y for x, y in places)
                    if hit or _CUE.search(value, a, b):
                        out.append((_buckets(tokens, title), hit, False, held))
                        continue
                    seed = zlib.crc32(f"{a} {value[:40]}".encode("utf-8", "surrogatepass"))
                    if seed % PLAIN_SHARE == 0:
                        out.append((_buckets(tokens, title), False, False, held))
                        if not held:
                            out += [(_buckets(t, title), is_residue, True, False) for t, is_residue in _variants(tokens, seed)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int32())), *(pa.array(c, pa.bool_()) for c in columns[1:])], names=["buckets", "label", "made_up", "held_out"])

    return spread(rows).mapInArrow(label, schema)


def train(documents: DataFrame, item: str = "doc_id", text: str = "text", host: str = "source", texts: int = SAMPLE_TEXTS) -> Classifier:
    """Fit on hosts that are not held out, set the threshold on those that are."""
    sample = _sampled(documents, item, text, host, texts).toArrow().combine_chunks()
    label, made_up, held = (np.asarray(sample.column(c)) for c in ("label", "made_up", "held_out"))
    lists = sample.column("buckets")
    lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    more = [_buckets(t, False) for t in _messages()]
    fit = ~held
    weights = fit_logistic(
        np.concatenate([flat[np.repeat(fit, size)], *more]),
        np.r_[size[fit], [len(m) for m in more]],
        np.r_[label[fit], np.ones(len(more), bool)],
    )
    seen = held & ~made_up
    score = np.array([weights[x].sum() for x in np.split(flat[np.repeat(seen, size)], np.cumsum(size[seen])[:-1])]) if seen.any() else np.zeros(0)
    truth = label[seen]
    best, threshold = -1.0, 0.0
    for t in THRESHOLDS:
        hit = score > t
        f = 2 * (hit & truth).sum() / max(hit.sum() + truth.sum(), 1)
        if f > best + 1e-9 or abs(f - best) <= 1e-9 and abs(t) < abs(threshold):
            best, threshold = f, t
    hit = score > threshold
    quality = {"sentences": float(len(truth)), "positives": float(truth.sum()), "precision": float((hit & truth).sum() / max(hit.sum(), 1)), "recall": float((hit & truth).sum() / max(truth.sum(), 1))}
    return Classifier(weights, threshold, quality)


class _Scorer:
    """Scores texts; remembers what each distinct word adds."""

    MOST = 400_000

    def __init__(self, classifier: Classifier):
        self.c = classifier
        self.length = classifier.weights[_LENGTH_BUCKETS]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.own, self.hash, self.kind, self.ends = np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.index) > self.MOST:
            self.clear()
        new = sorted(set(tokens).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            w = self.c.weights
            word, kind = np.array([_hashes(t) for t in new], np.uint64).T
            self.own = np.r_[self.own, np.where([t in _ENDS for t in new], 0.0, w[(word % BUCKETS).astype(np.int64)])]
            self.hash, self.kind = np.r_[self.hash, word], np.r_[self.kind, kind]
            self.ends = np.r_[self.ends, np.array([(t in _ENDS) + (t == "\n") for t in new], np.int8)]
        return np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of the highest sentence of each text; minus infinity for texts without any."""
        split = [_TOKEN.findall(t) if t else [] for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        rows = self._rows([t for s in split for t in s])
        out = np.full(len(texts), -np.inf)
        if not len(rows):
            return out
        of_text = np.repeat(np.arange(len(texts)), size)
        end = self.ends[rows] > 0
        new_text = np.r_[True, of_text[1:] != of_text[:-1]]
        lines = np.cumsum(self.ends[rows] == 2)
        first = np.flatnonzero(new_text)
        lines_before = np.r_[0, lines][first]
        title = lines == np.repeat(lines_before, size[size > 0])
        sentence = np.cumsum(end | new_text)  # an end opens the next sentence, to which it adds nothing itself
        n = int(sentence[-1]) + 1
        score = np.bincount(sentence, self.own[rows], n)
        near = np.flatnonzero((sentence[1:] == sentence[:-1]) & ~end[:-1])
        a, b = rows[near], rows[near + 1]
        pairs = sum(self.c.weights[_pair_buckets(h[a], h[b])] for h in (self.hash, self.kind))
        score += np.bincount(sentence[near], pairs, n)
        words = np.bincount(sentence, ~end, n).astype(np.int64)
        score += self.length[_length_class(words)] + self.c.weights[_BIAS]
        in_title = np.zeros(n, bool)
        in_title[sentence[title & ~end]] = True
        score += in_title * self.c.weights[_TITLE]
        owner = np.zeros(n, np.int64)
        owner[sentence] = of_text
        some = words > 0
        np.maximum.at(out, owner[some], score[some])
        return out


_SCORERS: dict[int, _Scorer] = {}


def _scorer(broadcast) -> _Scorer:
    if broadcast.value is not getattr(_SCORERS.get(0), "c", None):
        _SCORERS[0] = _Scorer(broadcast.value)
    return _SCORERS[0]


def score_texts(documents: DataFrame, classifier: Classifier, item: str = "doc_id", text: str = "text", least: float | None = None) -> DataFrame:
    """(item, score): how far the most suspect sentence of each text lies above the threshold; with ``least``, of the
    texts that score more."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    schema = T.StructType([documents.schema[item], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                score = scorer.scores(texts[a:b]) - scorer.c.threshold
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=[item, "score"])
                yield out if least is None else out.filter(pa.array(score > least))

    return spread(documents.select(item, text)).mapInArrow(run, schema)


def residue(documents: DataFrame, item: str = "doc_id", text: str = "text", host: str = "source", classifier: Classifier | None = None) -> DataFrame:
    """(item, score) of the texts that hold residue in place of content: those over the classifier's threshold."""
    classifier = classifier or train(documents, item, text, host)
    return score_texts(documents, classifier, item, text, 0.0).groupBy(item).agg(F.max("score").alias("score"))
