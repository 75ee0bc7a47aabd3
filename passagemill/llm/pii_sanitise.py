"""Personal information inside free text: found by what the corpus says about its surroundings, and replaced.

Every place that has the form of a value (an address of electronic mail, a run of digits, a capitalised name behind an
announcing word, ...) is a candidate term. How strongly a candidate reveals a protected entity is estimated from
co-occurrence over the whole corpus: the share of labelled texts with the entity among those in which the same form
stands in the same surroundings, smoothed from the words around it to the nearest word to the form alone, against the
share among all labelled texts. The logarithm of the ratio is their pointwise mutual information; shares count up to
a cap, so that no category is too common to be disclosed. Candidates over the disclosure threshold are generalised to
a typed placeholder; the rest of the text stays as it is. The label of a category over the cap, which nearly any text
may have, counts only for the candidates of a text that are announced or clear, if it has such.

Labels are the rows that name their categories (in any letter case, at times incomplete) and the values that must not
be echoed. No text is judged by its own labels. Words that announce or rule out a value act as a prior, which matters only where the corpus has few cases.

Defined results: null and empty texts have no values and come back as they are; repeated rows count once; where values
overlap, the one of the clearer form counts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from passagemill.session import cut_lineage

#: Weight of what is known one step less closely; the least probability and information that count as disclosure.
SMOOTHING, LEAST_PROBABILITY, LEAST_INFORMATION = 4.0, 0.5, 1.0
#: Shares of categories count up to this, at which the least probability has the least information.
MOST_SHARE = LEAST_PROBABILITY / math.exp(LEAST_INFORMATION + 1e-9)

_EDGE = r"(?<![\p{L}\p{M}\p{N}])"
_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)", r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)"
_EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+-])(?:[\p{{L}}\p{{N}}_-]+\s?(?:[(\[{{]\s?dot\s?[)\]}}]|\sdot\s)\s?)*+[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*(?:{_AT}[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)+|\s+at\s+[\p{{L}}\p{{N}}-]+(?:\s+dot\s+[\p{{L}}\p{{N}}-]+)+)", regex.I
)
_PAN = regex.compile(rf"{_EDGE}(?:[A-Z]{{3}}[\s.-]?[A-Z]{{2}}[\s.-]?\d{{4}}[\s.-]?[A-Z]|[a-z]{{5}}[.-]?\d{{4}}[.-]?[a-z]|[A-Za-z]{{5}}\d{{4}}[A-Za-z])(?![\p{{L}}\p{{N}}])")
_PAN_LOOSE = regex.compile(rf"{_EDGE}[a-z]{{3}}\s?[a-z]{{2}}\s\d{{4}}\s[a-z](?![\p{{L}}\p{{N}}])", regex.I)
_IFSC = regex.compile(rf"{_EDGE}[A-Z]{{4}}[\s.-]?0[\s.-]?[A-Z0-9]{{6}}(?![\p{{L}}\p{{N}}])", regex.I)
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|शून्य|एक|दो|तीन|चार|पाँच|पांच|छह|छः|सात|आठ|नौ)"
_SPELLED = regex.compile(rf"{_EDGE}(?:(?:double|triple)\s+)?{_DIGIT_WORD}(?:[\s,-]+(?:(?:double|triple)\s+)?{_DIGIT_WORD}){{3,17}}(?![\p{{L}}\p{{M}}\p{{N}}])", regex.I)
_BRACKETED = regex.compile(r"(?<![\p{L}\p{N}])\((?:\+?\d{1,3}|0?\d{2,5})\)[\s-]?\d{2,5}(?:[\s.-]?\d{2,5}){1,3}(?!\d)")
_PLUS = regex.compile(r"(?:\+|(?<![\p{L}\p{N}])00(?=[1-9]))\s?\d{1,3}[\s\xa0.-]?(?:\(\d{1,5}\)[\s-]?)?\d{1,5}(?:[\s\xa0.-]?\d{1,6}){1,9}(?!\d)")
_GROUPS = regex.compile(r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}][.,/-])\d+(?:[  .\-‐-–]\d+)*(?![\p{L}\p{N}]|[.,/-]\d)")
# what a text must have to hold a value of a form at all, tried before the form itself
_SPOKEN_AT = regex.compile(r"[(\[{]\s?at\s?[)\]}]|\sat\s(?s:.*)\sdot\s", regex.I)
_PAN_END = regex.compile(r"\d{4}[\s.-]?[A-Za-z]")
_DIGITS = regex.compile(r"\d+")
_HOUSE = r"(?:(?:flat|house|plot|door|apt|apartment|unit|villa|shop|room|suite|tower|wing|floor|bungalow|quarter|h\.?\s?no|d\.?\s?no|मकान|फ्लैट|प्लॉट)\.?\s*(?:no\.?|number|नंबर)?\s*[:#-]?\s*(?:[\p{L}]?[-/]?\d+[\p{L}\d]*|[A-Z]\b)(?:[/-][\p{L}\d]+)*|\d{1,2}(?:st|nd|rd|th)\s+floor|[A-Z][-/]\d{1,4}(?![\p{L}\p{N}])|#?\d{1,4}[\p{L}]?(?:[/-][\p{L}\d]{1,4}){0,3}(?![\p{L}\p{N}]))"
_ROAD = r"(?:street|st|road|rd|nagar|marg|lane|ln|layout|cross|gali|avenue|ave|colony|chowk|circle|drive|enclave|vihar|path|bagh|puram|main|block|square|way|boulevard|close|terrace|gardens?)"
_STREETS = frozenset((*_ROAD[3:-1].replace("gardens?", "garden|gardens").split("|"), "sector", "phase", "ward"))
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_DIGIT_WORDS = frozenset(_DIGIT_WORD[3:-1].split("|"))
_NO_FIRM = r"(?!\s+(?:partners|capital|bank|trust|funds?|advis[eo]rs|securities|ltd|limited|plc|group|associates|holdings|investments?|index|steel|mills|works)\b)"
_ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}/.-]){_HOUSE}(?:,?\s+{_HOUSE}){{0,3}},?\s+(?:(?:[\p{{L}}'’-]+\s+){{1,3}}(?:apartments?|heights|towers?|residency|society|villas?|complex|mansion|court|house),\s+(?:{_HOUSE},?\s+)?)?(?:(?:(?!{_ROAD}\b)[\p{{L}}\p{{M}}'’-]+\s+){{1,3}}?{_ROAD}\b\.?{_NO_FIRM}|(?:sector|phase|block|ward)\s+\d+[\p{{L}}]?)"
    rf"(?:[,\s]+(?:apt|flat|unit|sector|phase)\.?\s+\d+[\p{{L}}]?)?(?:\s*[,\n]\s*[\p{{L}}\p{{M}}'’-]+(?:\s*[-–,]?\s*(?:\p{{Lu}}{{2}}\s+)?\d{{3}}\s?\d{{2,3}}(?!\d))?)?",
    regex.I,
)
_TITLE = r"(?:(?:mrs?|ms|mx|miss|dr|shri|shrimati|sri|smt|kum|kumari|prof|adv|capt|col|maj|sir|madam|er|श्री|श्रीमती|सुश्री|डॉ|कुमारी)\b\.?\s+)"
_ANNOUNCE = regex.compile(
    rf"{_EDGE}(?:(?:(?:my|full|his|her)\s+)?name(?:\s+is\b|\s*[:=-])|i\s+am\b|i['’]m\b|this\s+is\b|(?:kind\s+|best\s+|warm\s+)?regards\b|sincerely\b|yours\s+\w+|thanks\b|held\s+by\b|signed(?:\s+by)?\b|holder\b|nominee\s+is\b|on\s+behalf\s+of|call\s+me\b|(?:मेरा\s+|मेरी\s+)?नाम(?![\p{{L}}\p{{M}}])|मैं(?![\p{{L}}\p{{M}}]))[\s,:–-]*{_TITLE}*|{_EDGE}{_TITLE}+",
    regex.I,
)
_NAME_PART = regex.compile(r"(?:\p{L}\.|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*)(?:[  ]+|(?=[,.;:!?।)\n]|$))")
#: Words that are no part of a name.
_COMMON = frozenset(
    "a an the and or of for in on at by to from with is are was were be been am do does did has have had can could will would shall should may might must not no yes my your his her our their its me you he she it we they i this that these those what which when where who whom why how please explain tell give send show find need want looking asking writing agrees here there also now then than after before until since about into over under fund funds plan scheme sip nav otp pan ifsc uid aadhaar aadhar account bank phone mobile tel whatsapp email mail passcode code kyc folio address post courier ring reach reply write pay credit branch tax card series form ticket batch voucher transaction what's market so very just new old interested happy sorry sure glad है हैं का की के में और से को पर यह वह क्या मुझे मेरा मेरी लिखें नहीं".split()
)
_END = regex.compile(r"[.!?।;\n](?=\s|$)|\s-\s|^-\s|[)\]}]|^\W*(?=[({\[])")
_SHORTENED = regex.compile(r"(?:^|[^\p{L}])(?:no|tel|mrs?|ms|dr|ph|mob|a/c|acc|ac|acct|smt|st|rs|shri)\.\s*$", regex.I)
_VALUE = regex.compile(r"\d{3,}")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:/[\p{L}\p{M}]+)?|[@#₹$€%]")

#: Words that announce a value of a category, and words that rule values out: the prior where the corpus is silent.
ANNOUNCING = {
    "email": "mail email inbox reply write send mailto",
    "phone": "phone mobile cell tel call ring reach whatsapp contact telephone फ़ोन फोन मोबाइल",
    "pan": "pan tax form card",
    "aadhaar": "aadhaar aadhar aadhaar uid आधार uidai",
    "account": "account a/c acct bank savings credit खाता",
    "ifsc": "ifsc branch code",
    "otp": "otp passcode password verification pin code one-time ओटीपी",
    "name": "name am regards held holder mother father wife husband nominee this नाम मैं writing agrees sincerely",
    "address": "live moved address courier post home here पता at",
}
ANNOUNCING = {c: frozenset(w.split()) for c, w in ANNOUNCING.items()}
RULED_OUT = frozenset("folio ticket voucher batch transaction ref plan series clause version page counter sip isin rs inr ₹ $ € nav shows units january february march april may june july august september october november december since until between".split())
#: What a form alone says of each category it may be, before any text has been seen.
_CLEAR = {"email": 0.9, "pan": 0.85, "ifsc": 0.85, "address": 0.8}
_RANK = {"email": 0, "address": 1, "pan": 2, "ifsc": 2, "phone": 3, "aadhaar": 3, "account": 3, "otp": 4, "name": 5}
CATEGORIES = tuple(_RANK)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    form: str
    categories: tuple[str, ...]


def _digit_categories(groups: list[int], separator: str, first: str) -> tuple[str, ...]:
    """What a number of these groups of digits may be: groupings in use, and digits in groups of at most two, as they
    are read out."""
    n, g = sum(groups), tuple(groups)
    read_out = len(g) > 3 and max(g[:-1]) <= 2 and g[-1] <= 3
    out = []
    if n == 12 and (read_out or g in ((12,), (4, 4, 4), (3, 3, 3, 3), (6, 6))):
        out.append("aadhaar")
    national = n == 10 or n == 11 and first == "0" or n in (12, 13) and first == "9"
    if national and (read_out or g in ((10,), (5, 5), (3, 3, 4), (4, 3, 3), (2, 4, 4), (4, 6), (3, 7), (5, 3, 2), (3, 2, 2, 3), (3, 2, 3, 2), (11,), (6, 5), (1, 5, 5), (1, 10), (4, 3, 4), (4, 7), (3, 8), (1, 3, 3, 4), (2, 10), (2, 5, 5), (2, 3, 3, 4))) or g in ((12,),) and first == "9":
        out.append("phone")
    if separator != "." and 9 <= n <= 18 and (read_out or len(g) == 1 or len(g) >= 3 and all(3 <= x for x in g[:-1]) and all(x <= 5 for x in g[:-1])):
        out.append("account")
    if (n in (4, 6) and max(g) == 1 or g in ((4,), (6,), (3, 3), (2, 2), (2, 2, 2))) and separator != ".":
        out.append("otp")
    return tuple(out)


#: Digits that a value has at most; no longer run of groups is one number.
MOST_DIGITS = 18


def _numbers(text: str) -> Iterator[Candidate]:
    for m in _GROUPS.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start()) for p in _DIGITS.finditer(m[0])]
        marks = [text[a[1] : b[0]] for a, b in zip(parts, parts[1:])]
        i = 0
        while i < len(parts):
            last, digits, groups = i, 0, []
            while last < len(parts) and digits + parts[last][1] - parts[last][0] <= MOST_DIGITS and (last < i + 2 or marks[last - 1] == marks[i]):
                groups.append(parts[last][1] - parts[last][0])
                digits += groups[-1]
                last += 1
            for j in range(last, i, -1):
                if "." in marks and (i, j) != (0, len(parts)):  # parts of decimals are no values
                    continue
                own = groups[: j - i]
                mark = marks[i] if j - i > 1 else ""
                categories = _digit_categories(own, mark, text[parts[i][0]])
                if categories:
                    lead = "0" if text[parts[i][0]] == "0" else "6" if text[parts[i][0]] in "6789" else "1"
                    for k in range(i, j - 1) if j - i > 2 else ():  # a number may follow the last digits of an address
                        if own[k - i : k - i + 2] == [5, 5] and text[parts[k][0]] in "6789":
                            yield Candidate(parts[k][0], parts[k + 1][1], "n5+5 within", ("phone",))
                    form = "+".join(map(str, own)) if len(own) < 5 else "read out"
                    yield Candidate(parts[i][0], parts[j - 1][1], f"n{sum(own)}:{form} {mark.strip()}{lead if sum(own) > 9 else ''}", categories)
                    i = j
                    break
            else:
                i += 1


def candidates(text: str) -> list[Candidate]:
    """Places with the form of a value; overlaps are left to the decision."""
    out = [Candidate(m.start(), m.end(), "email@" if "@" in m[0] else "email at", ("email",)) for m in _EMAIL.finditer(text)] if "@" in text or _SPOKEN_AT.search(text) else []
    words = _LETTERS.findall(text.lower())
    numeric = _DIGITS.search(text) is not None
    pans = [m for m in _PAN.finditer(text)] if (maybe_pan := numeric and _PAN_END.search(text)) else []
    out += [Candidate(m.start(), m.end(), "pan", ("pan",)) for m in pans]
    if numeric:
        out += [Candidate(m.start(), m.end(), "pan loose", ("pan",)) for m in (_PAN_LOOSE.finditer(text) if maybe_pan else ()) if not any(m.start() < p.end() and p.start() < m.end() for p in pans)]
        out += [Candidate(m.start(), m.end(), "ifsc", ("ifsc",)) for m in _IFSC.finditer(text)]
        out += [Candidate(m.start(), m.end(), "phone +", ("phone",)) for m in _PLUS.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
        out += [Candidate(m.start(), m.end(), "phone ()", ("phone",)) for m in _BRACKETED.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 13]
        out += _numbers(text)
        out += [Candidate(m.start(), m.end(), "address", ("address",)) for m in (_ADDRESS.finditer(text) if not _STREETS.isdisjoint(words) else ())]
    for m in _SPELLED.finditer(text) if sum(w in _DIGIT_WORDS for w in words) > 3 else ():
        n = sum({"double": 1, "triple": 2}.get(w, 1) for w in _LETTERS.findall(m[0].lower()))
        categories = _digit_categories([n], "", "9") or (("account",) if 9 <= n <= 18 else ())
        if categories:
            out.append(Candidate(m.start(), m.end(), f"spelled {n}", categories))
    clearer = [(c.start, c.end) for c in out]
    for m in _ANNOUNCE.finditer(text):
        at, parts = m.end(), []
        while p := _NAME_PART.match(text, at):
            word = p[0].strip("  .").lower()
            initial = len(p[0].rstrip()) == 2 and p[0].rstrip().endswith(".")
            if any(a <= p.start() < b for a, b in clearer) or word in _COMMON and not initial or not parts and word in ("mr", "mrs", "ms", "dr"):
                break
            parts.append((p.start(), p.start() + len(p[0].rstrip())))
            at = p.end()
            if at >= len(text) or text[at - 1] not in "  ":
                if not initial:
                    break
        if parts:
            first = text[parts[0][0]]
            out.append(Candidate(parts[0][0], parts[-1][1], f"name {'lower' if first.islower() else 'upper'}{min(len(parts), 2)}", ("name",)))
    return out


def _left(text: str, at: int) -> list[str]:
    """The last three words before a place, in its own clause."""
    before = text[max(0, at - 60) : at]
    cut = 0
    for m in _END.finditer(before):
        if not _SHORTENED.search(before[: m.end()]):
            cut = m.end()
    for m in _VALUE.finditer(before, cut):  # what announces another value says nothing of this one
        cut = m.end()
    return [w.lower() for w in _WORD.findall(before[cut:])][-3:]


def _right(text: str, at: int) -> list[str]:
    after = text[at : at + 60]
    m = _END.search(after)
    return [w.lower() for w in _WORD.findall(after[: m.start()] if m else after)][:3]


def surroundings(text: str, c: Candidate) -> tuple[str, str, list[str]]:
    """Keys of the nearest and of the wider surroundings of a candidate, and the words themselves."""
    left, right = _left(text, c.start), _right(text, c.end)
    kind = c.form.split(" ")[0]
    if kind[0] == "n" and kind[1].isdigit():  # what announces a long number announces it in any length and grouping
        digits = int(kind[1:].partition(":")[0].partition("+")[0])
        kind = f"n{digits}" if 5 != digits < 9 else "long number"
    if left:
        near, wide = left[-1], " ".join(left)
        if c.categories == ("name",):
            wide += f" _ {right[0] if right else ''}"
    else:
        near, wide = f"_ {right[0] if right else ''}", f"_ {' '.join(right)}"
    return f"{kind}|{near}", f"{kind}|{wide}", left or right


def _prior(category: str, words: list[str]) -> float | None:
    if category in _CLEAR:
        return None
    if any(w in ANNOUNCING[category] for w in words) and not any(w in RULED_OUT for w in words):
        return 0.9
    return 0.05 if any(w in RULED_OUT for w in words) else None


_FOUND = "id string, start int, end int, category string, form string, near string, wide string, prior double, label boolean, explained boolean, own array<int>"


def _candidate_rows(rows: DataFrame) -> DataFrame:
    """A row for each candidate and category that it may be; label is null where nothing is known, and explained says
    that a likelier candidate of the text, or one around it, is of the same category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FOUND.split(", ")]
        for batch in batches:
            out = []
            for key, text, categories, echo in zip(*(c.to_pylist() for c in batch.columns)):
                known = None if categories is None else {(c or "").lower() for c in categories}
                placed = [(c, *surroundings(text, c)) for c in candidates(text or "")]
                likely = {x for c, _, _, words in placed for x in c.categories if x in _CLEAR or (_prior(x, words) or 0) > LEAST_PROBABILITY}
                widest, upto = set(), dict.fromkeys(CATEGORIES, 0)
                for c, *_ in sorted(placed, key=lambda p: (p[0].start, -p[0].end)):
                    for x in c.categories:
                        if c.end > upto[x]:
                            widest.add((x, c.start, c.end))
                            upto[x] = c.end
                first, own = len(out), {}
                for c, near, wide, words in placed:
                    echoed = bool(echo) and text.startswith(echo, c.start)
                    for category in c.categories:
                        label = True if echoed and len(c.categories) == 1 else None if known is None else category in known
                        prior = _prior(category, words)
                        weaker = category in likely and category not in _CLEAR and (prior or 0) <= LEAST_PROBABILITY
                        explained = not (echoed and len(c.categories) == 1) and (weaker or (category, c.start, c.end) not in widest)
                        keys = [(category, n, x) for n, x in enumerate((c.form, near, wide))]
                        out.append([key, c.start, c.end, category, c.form, near, wide, prior, label, explained, keys])
                        for k in keys if label is not None else ():
                            seen = own.setdefault(k, [0, 0, 0])
                            seen[0] += 1
                            seen[1] += label
                            seen[2] += label and explained
                for row in out[first:]:
                    row[-1] = [x for k in row[-1] for x in own.get(k, (0, 0, 0))]
            columns = list(zip(*out)) if out else [[]] * len(names)
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, _FOUND)


def _smoothed(level: int, parent: Column, common: list[str]) -> Column:
    """Share of labelled hits at a level of surroundings, without the labels of the candidate's own text."""
    own = lambda i: F.element_at("own", 3 * level + i)
    own_hits = own(2) - F.when(F.col("category").isin(common), own(3)).otherwise(0)
    n = F.coalesce(F.col(f"n{level}") - own(1), F.lit(0))
    return (F.coalesce(F.col(f"h{level}") - own_hits, F.lit(0)) + SMOOTHING * parent) / (n + SMOOTHING)


def disclosures(rows: DataFrame, item: str = "id", text: str = "question", categories: str = "pii_categories", echo: str = "must_not_echo") -> DataFrame:
    """(id, start, end, category, probability, information) of every candidate over the threshold, overlaps included."""
    plain = rows.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text"), F.col(categories).alias("categories"), F.col(echo).alias("echo")).distinct()
    found = cut_lineage(_candidate_rows(plain))
    marked = plain.where(F.col("categories").isNotNull()).select(F.transform("categories", lambda c: F.lower(c)).alias("categories"))
    shares = marked.agg(F.count("*").alias("texts"), *(F.sum(F.array_contains("categories", c).cast("long")).alias(c) for c in CATEGORIES)).first()
    share = {c: ((shares[c] or 0) + 1) / (shares["texts"] + 10) for c in CATEGORIES}
    common = [c for c in CATEGORIES if share[c] > MOST_SHARE]
    labelled = found.where(F.col("label").isNotNull())
    hit = F.sum((F.col("label") & ~(F.col("explained") & F.col("category").isin(common))).cast("long"))
    # forms and categories are few by construction; surroundings are as many as the language has, so these are joined
    forms = labelled.groupBy("category", "form").agg(F.count("*").alias("n0"), hit.alias("h0"))
    near = labelled.groupBy("category", "near").agg(F.count("*").alias("n1"), hit.alias("h1"))
    wide = labelled.groupBy("category", "wide").agg(F.count("*").alias("n2"), hit.alias("h2"))
    base = F.element_at(F.create_map(*(F.lit(x) for c in CATEGORIES for x in (c, min(MOST_SHARE, share[c])))), F.col("category"))
    clear = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in _CLEAR.items() for x in p)), F.col("category")), base)
    joined = found.join(F.broadcast(forms), ["category", "form"], "left").join(near, ["category", "near"], "left").join(wide, ["category", "wide"], "left")
    p0 = _smoothed(0, clear, common)
    p1 = _smoothed(1, F.coalesce(F.col("prior"), p0), common)
    p2 = _smoothed(2, F.coalesce((p1 + F.col("prior")) / 2, p1), common)
    scored = joined.select("id", "start", "end", "category", p2.alias("probability"), F.log(p2 / base).alias("information"))
    return scored.where((F.col("probability") >= LEAST_PROBABILITY) & (F.col("information") >= LEAST_INFORMATION))


def settle(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping values, the one of the clearer form, then the likelier, then the longer; in order of place. A part
    of a value is no value of the same category."""
    out: list[tuple[int, int, str, float]] = []
    found = [v for v in found if not any(o[2] == v[2] and o[0] <= v[0] and v[1] <= o[1] and o[:2] != v[:2] for o in found)]
    for v in sorted(found, key=lambda v: (_RANK[v[2]], -v[3], v[0] - v[1], v[0])):
        if not any(v[0] < o[1] and o[0] < v[1] for o in out):
            out.append(v)
    return sorted(out)


def _per_text(rows: DataFrame, **columns: str) -> DataFrame:
    item = columns.get("item", "id")
    over = disclosures(rows, **columns)
    lists = over.groupBy("id").agg(F.collect_list(F.struct("start", "end", "category", "probability")).alias("found"))
    return lists if item == "id" else lists.withColumnRenamed("id", item)


def personal_information(rows: DataFrame, **columns: str) -> DataFrame:
    """(id, category, start_at, end_at): each piece of personal information."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, v[2], v[0], v[1]) for key, found in zip(*(c.to_pylist() for c in batch.columns)) for v in settle([(f["start"], f["end"], f["category"], f["probability"]) for f in found])]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["id", "category", "start_at", "end_at"])

    return _per_text(rows, **columns).mapInArrow(run, "id string, category string, start_at int, end_at int")


def sanitised(rows: DataFrame, item: str = "id", text: str = "question", **columns: str) -> DataFrame:
    """(id, text, sanitised, pii_categories) of every text, each value replaced by its category in capitals and brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, founds = (c.to_pylist() for c in batch.columns)
            new, names = [], []
            for value, found in zip(texts, founds):
                settled = settle([(f["start"], f["end"], f["category"], f["probability"]) for f in found or []])
                for a, b, category, _ in reversed(settled):
                    value = f"{value[:a]}[{category.upper()}]{value[b:]}"
                new.append(value)
                names.append(sorted({s[2] for s in settled}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(new, pa.string()), pa.array(names, pa.list_(pa.string()))], names=["id", "text", "sanitised", "pii_categories"])

    found = _per_text(rows, item=item, text=text, **columns)
    plain = rows.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text")).distinct()
    return plain.join(found, "id", "left").mapInArrow(run, "id string, text string, sanitised string, pii_categories array<string>")
